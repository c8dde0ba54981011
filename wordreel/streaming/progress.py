"""Job progress as a stream: latest state, silence timeout, retention cadence.

The state of a job is kept by Spark's state store, so a batch costs what it
touches. Latest states do not depend on the order or on the number of times an
event arrives. Failures for silence come from timers on the events' own clock, each
once; an event that comes late is not dropped, it counts unless its job is
decided already.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordreel import fixed
from wordreel.session import children, remove

def _said() -> Column:
    return F.struct("ts", "event_id", "status")


def _final() -> Column:
    return F.col("status").isin(*fixed.FINAL_STATUSES)


# Latest state ------------------------------------------------------------------

def changes(events: DataFrame) -> DataFrame:
    """(job, done, open) of (event_id, job, ts, status): first final and newest other event.

    On a stream in update mode these are the jobs that a batch has touched.
    """
    return events.groupBy("job").agg(F.min(F.when(_final(), _said())).alias("done"),
                                     F.max(F.when(~_final(), _said())).alias("open"))


def write_changes(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the touched jobs of every batch as `batch=N` under `path`.

    A batch that is run again replaces what it wrote. Nothing of earlier batches is
    read or written; see `compact`.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    return (changes(events).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(keep).start())


def _whole(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders `kind=N` that were written to the end."""
    found = [n for n in children(spark, path) if n.startswith(f"{kind}=")]
    return sorted(int(n.partition("=")[2]) for n in found
                  if "_SUCCESS" in children(spark, os.path.join(path, n)))


def _current(spark: SparkSession, path: str) -> list[str]:
    """The newest base and the batches after it."""
    base = _whole(spark, path, "base")[-1:]
    after = [b for b in _whole(spark, path, "batch") if not base or b > base[0]]
    return ([os.path.join(path, f"base={base[0]}")] if base else []) + [
        os.path.join(path, f"batch={b}") for b in after]


def states(spark: SparkSession, path: str) -> DataFrame:
    """(job, done, open) after all batches that were written whole.

    What a batch says of a job holds all that came before, and a half-written batch
    is not read, so a reader sees some moment between two batches.
    """
    return spark.read.parquet(*_current(spark, path)).groupBy("job").agg(
        F.min("done").alias("done"), F.max("open").alias("open"))


def compact(spark: SparkSession, path: str) -> None:
    """Write one base of all batches so far; older bases and batches that it holds go.

    The base before the new one and its batches stay for readers that have begun.
    """
    batches, bases = _whole(spark, path, "batch"), _whole(spark, path, "base")
    if not batches or (bases and bases[-1] >= batches[-1]):
        return
    states(spark, path).write.mode("overwrite").parquet(os.path.join(path, f"base={batches[-1]}"))
    if bases:
        for kind, numbers in (("base", bases[:-1]), ("batch", batches)):
            for n in numbers:
                if n <= bases[-1]:
                    remove(spark, os.path.join(path, f"{kind}={n}"))


def latest_status(states: DataFrame) -> DataFrame:
    """(job, status, at, event_id): the first final status stands, until then the newest."""
    state = F.coalesce("done", "open")
    return states.select("job", state["status"].alias("status"), state["ts"].alias("at"),
                         state["event_id"].alias("event_id"))


# Silence -----------------------------------------------------------------------

Stretch = list      # [began, last, event_id of last, last status, whether it was finished], us


def joined(stretches: list[Stretch], seconds: int) -> list[Stretch]:
    """Stretches of activity in order, those less than `seconds` apart as one."""
    out: list[Stretch] = []
    for s in sorted(stretches):
        if out and s[0] < out[-1][1] + seconds * 1_000_000:
            last = out[-1]
            newest = max(last, s, key=lambda x: (x[1], x[2]))
            out[-1] = [last[0], *newest[1:4], last[4] or s[4]]
        else:
            out.append(list(s))
    return out


def _watch(seconds: int):
    """The state of one job: its open stretches, or that it is decided."""
    wait = seconds * 1_000_000

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Stretch] | None = json.loads(state.get[0]) if state.exists else []
        if held is not None and not state.hasTimedOut:
            for part in rows:
                us = part["ts"].astype("datetime64[us]").astype("int64")
                held = joined(held + [
                    [t, t, int(e), s, s in fixed.FINAL_STATUSES]
                    for t, e, s in zip(us.tolist(), part["event_id"], part["status"])], seconds)
        said = []
        if held:
            first, now = held[0], state.getCurrentWatermarkMs() * 1000
            if first[1] + wait <= now:
                if not first[4]:
                    said = [(key[0], pd.Timestamp(first[1] + wait, unit="us"), first[3],
                             fixed.STALE_MESSAGE)]
                held = None
            else:       # due as soon as the clock has reached the end of the stretch
                state.setTimeoutTimestamp(-(-(first[1] + wait) // 1000) - 1)
        state.update((json.dumps(held),))
        if said:
            yield pd.DataFrame(said, columns=["job", "failed_at", "last_status", "error"])

    return run


def stale_failures(events: DataFrame, delay: str = "10 minutes",
                   seconds: int = fixed.STALE_SECONDS) -> DataFrame:
    """(job, failed_at, last_status, error) as a stream: jobs silent for `seconds`, each once.

    Only the first stretch of activity of a job decides; what comes after its end or
    after it was given up is ignored. It has ended once the newest event of all is
    `delay` past it. The answer is that of all events if none comes later than `delay`
    behind the newest. One that does is not dropped: it still counts as long as its
    job is undecided.
    """
    # Timers run on the earlier of two clocks, that of the events and that of arrival. Only
    # the latter's column is handed on: Spark drops rows that are late by it, and none is.
    clocked = events.withColumn("clock", F.col("ts")).withWatermark("clock", delay).select(
        "job", "event_id", "ts", "status").withColumn(
        "arrival", F.current_timestamp()).withWatermark("arrival", "0 seconds")
    return clocked.groupBy("job").applyInPandasWithState(
        _watch(seconds), "job bigint, failed_at timestamp, last_status string, error string",
        "held string", "append", GroupStateTimeout.EventTimeTimeout)


def write_failures(events: DataFrame, path: str, checkpoint: str,
                   delay: str = "10 minutes") -> StreamingQuery:
    """Append each failure once to the table under `path`, over restarts too."""
    writer = (stale_failures(events, delay).writeStream.outputMode("append").format("parquet")
              .option("path", path).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True))
    # Two clocks in one query are allowed where it keeps one state only, as here; the
    # query takes the setting along when it starts.
    conf, name = events.sparkSession.conf, "spark.sql.streaming.statefulOperator.allowMultiple"
    before = conf.get(name, None)
    conf.set(name, "false")
    try:
        return writer.start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


# Retention ---------------------------------------------------------------------

def retention_stream(activity: DataFrame, clean: Callable[[], DataFrame], path: str,
                     checkpoint: str, every: dt.timedelta = dt.timedelta(minutes=30),
                     drain: bool = False, clock: Callable[[], float] = time.time) -> StreamingQuery:
    """Run `clean()` at most once per interval while there is activity.

    `clean` returns what is to be removed; each run writes its own report, named by
    its time in milliseconds. The last whole report says when the last run was, so a
    restart within the interval does not run again. With `drain` the stream ends when
    there is nothing more to read.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        now, spark = int(clock() * 1000), batch.sparkSession
        last = _whole(spark, path, "run")[-1:]
        if not last or now - last[0] > every / dt.timedelta(milliseconds=1):
            clean().write.mode("overwrite").parquet(os.path.join(path, f"run={now}"))

    writer = activity.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(
        processingTime=f"{int(every.total_seconds())} seconds")
    return writer.start()
