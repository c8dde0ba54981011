"""The retake run: phrases to groups and prompts, then replies to suggested cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordreel.operators import retakes as R
from wordreel.operators.scan import join_takes
from wordreel.session import settle
from wordreel.sources import tables as T
from wordreel.sources.replies import parse_replies


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.phrase_bounds_punct(T.words(spark, sf_dir))


def bounded_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured takes break at their pauses, the others at punctuation."""
    w = T.words(spark, sf_dir)
    by_pause = R.phrase_bounds_measured(w, T.pauses(w)).withColumnRenamed("boundary", "paused")
    # One row per block of words, so that words need not move to their take's row.
    measured = join_takes(w.select("take_id", "blk").distinct(),
                          T.media(spark, sf_dir).select("take_id", "measured"))
    both = R.phrase_bounds_punct(by_pause).join(measured, ["take_id", "blk"])
    return both.withColumn("boundary", F.when(F.col("measured"), F.col("paused"))
                           .otherwise(F.col("boundary")))


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.usable_of(bounded(spark, sf_dir))


def grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Usable phrases, and the attempts of each group."""
    phrases = settle(usable(spark, sf_dir), "usable")
    members = R.groups(R.best_links(phrases))
    return phrases, settle(R.attempts(members, phrases), "attempts")


def replies_of(members: DataFrame) -> DataFrame:
    """A reply for every group, made from its key: confirmations, refusals, noise, failures."""
    sizes = members.groupBy("take_id", "grp").agg(F.count("*").alias("size"))
    pick = F.col("take_id") + F.col("grp") * 3
    keep = (pick % F.col("size")).cast("string")
    yes = F.concat(F.lit('{"retake": true, "keep": '), keep,
                   F.lit(', "confidence": 0.8, "reason": "second is complete"}'))
    fence = F.lit("`" * 3)
    body = (F.when(pick % 5 == 0, F.concat(fence, F.lit("json\n"), yes, F.lit("\n"), fence))
            .when(pick % 5 == 1, F.concat(F.lit("Sure: "), yes, F.lit(" Done.")))
            .when(pick % 5 == 2, F.lit('{"retake": "true", "keep": 0}'))
            .when(pick % 5 == 3, yes)
            .otherwise(F.lit('{"retake": true, "keep": 1.0}')))
    failed = pick % 11 == 10
    return sizes.select("take_id", "grp", "size", (~failed).alias("ok"),
                        F.when(~failed, body).alias("body"), F.when(failed, F.concat(
                            F.lit("no answer for "), F.col("grp").cast("string"))).alias("error"))


def judged(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    replies = settle(replies_of(members), "replies")
    answered = parse_replies(replies).select("take_id", "grp", "answer")
    sizes = replies.select("take_id", "grp", "size")
    verdicts = R.before_failure(R.verdicts(answered, sizes), replies)
    return replies, verdicts
