"""Stream queries, drained over the event table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wordreel.operators import jobs as J
from wordreel.plans.clip_queries import NOW, good_jobs
from wordreel.plans.registry import query
from wordreel.plans.sql import part, sql
from wordreel.session import run_folder
from wordreel.sources import tables as T
from wordreel.streaming import progress as L

STATUS = """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'transcribing'
 WHEN 'view' THEN 'rendering' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"""


def progress(spark, d):
    """The event table as a stream of job progress, dealt out of order over several files."""
    rows = T.table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(STATUS).alias("status"))
    folder = run_folder(spark, "progress")
    rows.repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(4))).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def progress_by_time(spark, d, slices=4):
    """The same in slices of time, one file each, without order inside a slice."""
    rows = T.table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(STATUS).alias("status"))
    folder = run_folder(spark, "slices")
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    at = F.floor((F.unix_micros("ts") - low) * slices / (high - low + 1))
    for k in range(slices):     # one after the other: a stream reads files by their age
        rows.filter(at == k).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode(
            "append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(spark, name, start, read):
    folder = run_folder(spark, name)
    out = os.path.join(folder, "out")
    start(out, os.path.join(folder, "state")).awaitTermination()
    return read(spark, out)


part("progress", f"""
SELECT event_id, user_id AS job, ts, {STATUS} AS status,
       event_type IN ('purchase', 'error') AS final FROM events""")


@query("latest_status", sql("""
SELECT job, coalesce(min_by(status, ts) FILTER (final), max_by(status, ts)) AS status,
       coalesce(min_by(event_id, ts) FILTER (final), max_by(event_id, ts)) AS event_id
FROM progress GROUP BY job"""))
def latest_status(spark, d):
    states = _drain(spark, "latest", lambda out, state: L.write_changes(
        progress(spark, d), out, state), L.states)
    return L.latest_status(states).select("job", "status", "event_id")


part("stretches", """
SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 1800 SECOND THEN 1 ELSE 0 END)
          OVER (PARTITION BY job ORDER BY ts) AS stretch
FROM (SELECT *, lag(ts) OVER (PARTITION BY job ORDER BY ts) AS before FROM progress)""")


@query("stale_stream", sql("""
SELECT job, cast(floor(epoch(max(ts))) AS BIGINT) + 1800 AS failed_s,
       max_by(status, ts) AS last_status
FROM stretches WHERE stretch = 1 GROUP BY job
HAVING NOT bool_or(final)
   AND max(ts) + INTERVAL 1800 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""))
def stale_stream(spark, d):
    failures = _drain(spark, "failures", lambda out, state: L.write_failures(
        progress_by_time(spark, d), out, state), lambda s, p: s.read.parquet(p))
    # The table's times have no zone; neither has this count of seconds.
    failed = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00',"
                    " cast(failed_at AS timestamp_ntz))")
    return failures.select("job", failed.alias("failed_s"), "last_status")


@query("retention_stream", sql("SELECT id, path FROM gone_paths"))
def retention_stream(spark, d):
    def clean():
        return J.object_paths_of(J.expired_jobs(good_jobs(spark, d), F.lit(NOW))).select("id", "path")

    return _drain(spark, "retention", lambda out, state: L.retention_stream(
        progress(spark, d), clean, out, state, drain=True),
        lambda s, p: s.read.parquet(p)).select("id", "path").distinct()
