"""The job table: feeds, staleness, retention, deletion batches, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordreel import fixed
from wordreel.functions.text import base_name
from wordreel.operators.scan import join_takes, position_block, ranked, running

BATCH_BLOCK = 65_536


def seconds_of(text: str | Column) -> Column:
    """Epoch seconds of a time text; NULL if it cannot be read."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unix_timestamp(F.try_to_timestamp(c))


def check_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, rejects) by the domains of kind and status, defaults filled in."""
    filled = jobs.withColumns({
        "status": F.coalesce("status", F.lit("queued")),
        "notified": F.coalesce("notified", F.lit(False)), "seen": F.coalesce("seen", F.lit(False)),
        "updated_s": F.coalesce("updated_s", "created_s"),
        "expires_s": F.coalesce("expires_s", F.col("created_s") + fixed.RETENTION_SECONDS)})
    problem = (F.when(F.col("user_id").isNull(), "user_id is missing")
               .when(~F.coalesce(F.col("kind").isin(*fixed.JOB_KINDS), F.lit(False)), "unknown kind")
               .when(~F.col("status").isin(*fixed.JOB_STATUSES), "unknown status"))
    tagged = filled.withColumn("problem", problem)
    return (tagged.filter("problem IS NULL").drop("problem"), tagged.filter("problem IS NOT NULL"))


def recent_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The newest `n` jobs of each user; each task sends at most `n` rows per user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_s"), F.desc("id"))
    return jobs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def unseen(jobs: DataFrame) -> DataFrame:
    """Finished jobs the user has not seen, ranked newest first, however many a user has."""
    found = jobs.filter(~F.col("seen") & F.col("status").isin(*fixed.FINAL_STATUSES))
    return ranked(found, ["user_id"], [F.desc("created_s"), F.desc("id")], "rank")


def mark_seen(jobs: DataFrame, acks: DataFrame) -> DataFrame:
    """Set `seen` on the ids a user names, where they are that user's own."""
    named = acks.select("user_id", "id").distinct().withColumn("ack", F.lit(True))
    return jobs.join(named, ["user_id", "id"], "left").withColumn(
        "seen", F.col("seen") | F.coalesce("ack", F.lit(False))).drop("ack")


def _silent(now: Column) -> Column:
    silent = F.coalesce(now - seconds_of("updated_at") > fixed.STALE_SECONDS, F.lit(False))
    return F.col("status").isin(*fixed.ACTIVE_STATUSES) & silent


def silent_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter(_silent(now))


def mark_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """Active jobs without a sign of life for half an hour have failed.

    `updated_at` is text; a time that cannot be read leaves the job alone.
    """
    stale = _silent(now)
    return jobs.withColumns({"error": F.when(stale, fixed.STALE_MESSAGE).otherwise(F.col("error")),
                             "status": F.when(stale, "failed").otherwise(F.col("status"))})


def expired_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter(F.col("expires_s") < now)


def surviving_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter(~F.coalesce(F.col("expires_s") < now, F.lit(False)))


def object_paths_of(jobs: DataFrame) -> DataFrame:
    """(id, user_id, pos, path): the stored objects of jobs, source before output."""
    paths = F.posexplode(F.array("source_path", "output_path")).alias("pos", "path")
    return jobs.select("id", "user_id", paths).filter(F.coalesce("path", F.lit("")) != "")


def deletion_batches(paths: DataFrame, n: int = fixed.DELETE_BATCH) -> DataFrame:
    """(batch, paths): at most `n` paths each, in order of job id.

    Paths are counted per block of ids, then per block of blocks; a single task sees
    one row for each of the latter.
    """
    placed = paths.withColumn("at", F.col("id") * 2 + F.col("pos")).withColumn(
        "blk_", position_block("at", BATCH_BLOCK))
    counted = running(placed, [], "blk_", ["at"], sums={"before": F.lit(1)}, deep=True)
    return counted.groupBy(F.floor(F.col("before") / n).cast("bigint").alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("at", "path"))).alias("found")).select(
        "batch", F.col("found.path").alias("paths"))


def expired_objects(listing: DataFrame, now: Column,
                    age: int = fixed.CLIP_TTL_SECONDS) -> DataFrame:
    """Objects older than `age` by their update time, else creation; unreadable ones stay."""
    stamp = seconds_of(F.coalesce(F.nullif("updated_at", F.lit("")), "created_at"))
    return listing.filter(F.coalesce(now - stamp > age, F.lit(False)))


def stale_files(listing: DataFrame, now: Column, age: int = fixed.RETENTION_SECONDS) -> DataFrame:
    """Files not modified for `age` seconds; a report, nothing is deleted here."""
    return listing.filter(F.col("modified_s") < now - age)


def list_files(spark, path: str) -> DataFrame:
    """(path, modified_s, length) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.unix_timestamp("modificationTime").alias("modified_s"), "length")


def user_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("user_id").agg(
        F.count("*").alias("total_jobs"), F.sum(F.coalesce("clips", F.lit(0))).alias("total_clips"),
        F.count_if(~F.col("status").isin(*fixed.FINAL_STATUSES)).alias("active_jobs"))


def purged_jobs(jobs: DataFrame, now: Column, age: int = fixed.JOB_TTL_SECONDS) -> DataFrame:
    """Job records that are kept; a missing creation time counts as now."""
    return jobs.filter(F.coalesce("created_s", now) >= now - age)


def user_objects(listing: DataFrame, users: DataFrame) -> DataFrame:
    """Everything stored for the given users, for deletion of their accounts."""
    return join_takes(listing, users.select("user_id").distinct(), on="user_id")


def owned() -> Column:
    """Whether an upload lies in the caller's own folder."""
    return F.startswith(F.col("storage_path"), F.concat(F.col("user_id").cast("string"), F.lit("/")))


def safe_name(file_name: str | Column) -> Column:
    return F.substring(F.replace(base_name(file_name), F.lit(" "), F.lit("_")), 1, 120)


def object_path(kind: str, file_name: Column) -> Column:
    """user/sources/job/file or user/outputs/job/file."""
    return F.concat_ws("/", F.col("user_id").cast("string"), F.lit(kind),
                       F.col("id").cast("string"), file_name)


def content_type_of(file_name: Column) -> Column:
    return F.when(F.endswith(file_name, F.lit(".mp4")), "video/mp4").when(
        F.endswith(file_name, F.lit(".mov")), "video/quicktime").otherwise("text/plain")
