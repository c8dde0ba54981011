"""Interval algebra on takes: merge, complement, offsets, assignment and re-timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordreel import fixed
from wordreel.operators.scan import (
    blocked, carried, join_takes, position_block, running, time_block, with_neighbours)

JOIN_SPAN_MS = 60_000   # bucket width of interval joins


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str,
                    order: Sequence[str], payload: Column, rank: Column) -> DataFrame:
    """Merge touching or overlapping intervals; `payload` of the highest `rank` stays.

    Intervals are first merged inside blocks of time. What a block needs to know
    of the earlier ones is how far they reach and where that island began, one
    row per block; both follow from the blocks' totals. Only islands that go on in a
    later block travel, at most one of each block. `start` must not fall along `order`.
    """
    blocked = df.withColumn("blk_", time_block(start))
    w = Window.partitionBy(*keys, "blk_").orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    local = (
        blocked.withColumn("opens_", opens)
        .withColumn("isle_", F.sum("opens_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "blk_", "isle_").agg(
            F.min(start).alias(start), F.max(end).alias(end),
            F.max_by(payload, rank).alias("payload"), F.max(rank).alias("rank"))
    )

    totals = local.groupBy(*keys, "blk_").agg(F.max(end).alias("far_"), F.max(start).alias("last_"))
    before = Window.partitionBy(*keys).orderBy("blk_").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("reach_", F.max("far_").over(before))
        .withColumn("own_", F.when(F.col("reach_").isNull() | (F.col("last_") > F.col("reach_")),
                                   F.col("last_")))
        .withColumn("root_", F.max("own_").over(before))
        .select(*keys, "blk_", "reach_", "root_")
    )
    joined = local.join(carry, [*keys, "blk_"])
    goes_on = F.coalesce(F.col(start) <= F.col("reach_"), F.lit(False))
    more = joined.filter(goes_on).groupBy(*keys, "root_").agg(
        F.max(end).alias("m_end"), F.max_by("payload", "rank").alias("m_payload"),
        F.max("rank").alias("m_rank")).withColumnRenamed("root_", "m_root")
    first = joined.filter(~goes_on).select(*keys, "blk_", start, end, "payload", "rank")
    both = first.join(more.withColumn("blk_", time_block("m_root")), [*keys, "blk_"], "left")
    own = F.coalesce(F.col("m_root") == F.col(start), F.lit(False))
    return both.select(
        *keys, start, F.when(own, F.greatest(end, "m_end")).otherwise(F.col(end)).alias(end),
        F.when(own & (F.col("m_rank") > F.col("rank")), F.col("m_payload"))
        .otherwise(F.col("payload")).alias("payload"))


def keep_segments(cuts: DataFrame, media: DataFrame) -> DataFrame:
    """(take_id, start_ms, end_ms): what is left of [0, duration] without the cuts."""
    lengths = media.select("take_id", "duration_ms")
    cuts = cuts.select("take_id", "start_ms", "end_ms")
    held = running(cuts.withColumn("blk_", time_block("start_ms")), ["take_id"], "blk_",
                   ["start_ms", "end_ms"], maxima={"reach": F.col("end_ms")})
    between = join_takes(
        held.select("take_id", F.greatest(F.lit(0), F.coalesce("reach", F.lit(0))).alias("pos"),
                    F.col("start_ms").alias("next")).filter("next > pos"),
        lengths,
    ).select("take_id", F.col("pos").alias("start_ms"),
             F.least("next", "duration_ms").alias("end_ms"))
    last = cuts.groupBy("take_id").agg(F.max("end_ms").alias("reach"))
    tail = lengths.join(last, "take_id", "left").select(
        "take_id", F.greatest(F.lit(0), F.coalesce("reach", F.lit(0))).alias("start_ms"),
        F.col("duration_ms").alias("end_ms"))
    return between.unionByName(tail).filter(
        F.col("end_ms") - F.col("start_ms") > fixed.SLIVER_MS)


def with_offsets(kept: DataFrame) -> DataFrame:
    """Add the number of each kept span and where it begins on the new timeline."""
    blocked = kept.select("take_id", "start_ms", "end_ms").withColumn("blk_", time_block("start_ms"))
    return running(blocked, ["take_id"], "blk_", ["start_ms"], sums={
        "seg": F.lit(1), "offset_ms": F.col("end_ms") - F.col("start_ms")}).drop("blk_")


def total_length(kept: DataFrame) -> DataFrame:
    return kept.groupBy("take_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("new_duration_ms"),
        F.count("*").alias("spans"))


def buckets(low: Column, high: Column, span: int = JOIN_SPAN_MS) -> Column:
    """Every bucket an interval touches."""
    return F.sequence(position_block(low, span), position_block(F.greatest(low, high), span))


def interval_join(left: DataFrame, right: DataFrame, lo: tuple[Column, Column],
                  hi: tuple[Column, Column], on: Column, how: str = "inner") -> DataFrame:
    """Join rows of one take whose intervals share a bucket and meet `on`.

    Both sides are spread over the buckets they touch, so a long take is many
    join keys. A pair that shares several buckets is kept in the first of them.
    """
    l = left.withColumn("lo_", position_block(lo[0], JOIN_SPAN_MS)).withColumn(
        "bin_", F.explode(buckets(*lo)))
    r = right.withColumn("hi_", position_block(hi[0], JOIN_SPAN_MS)).withColumn(
        "bin_", F.explode(buckets(*hi)))
    r = r.withColumnRenamed("take_id", "r_take_id").withColumnRenamed("bin_", "r_bin_")
    meets = ((F.col("take_id") == F.col("r_take_id")) & (F.col("bin_") == F.col("r_bin_")) & on
             & (F.col("bin_") == F.greatest("lo_", "hi_")))
    joined = l.join(r, meets, how)
    return joined.drop("lo_", "hi_", "bin_", "r_take_id", "r_bin_")


def by_words(words: DataFrame, spans: DataFrame, low: Column, high: Column,
             lo: Column, hi: Column) -> DataFrame:
    """`spans` of a take, each with the block `blk` of every block of words that it meets.

    `low` and `high` bound what a word looks at, [lo, hi] is the interval of a span.
    Words stay where they lie; blocks of words, one row each, are joined to the spans.
    """
    reach = words.groupBy("take_id", "blk").agg(F.min(low).alias("low_"), F.max(high).alias("high_"))
    seen = spans.withColumns({"from_": lo, "to_": hi})
    met = interval_join(
        reach, seen, (F.col("low_"), F.col("high_")), (F.col("from_"), F.col("to_")),
        (F.col("from_") <= F.col("high_")) & (F.col("to_") >= F.col("low_")))
    return met.drop("low_", "high_", "from_", "to_").repartition("take_id", "blk")


def assign_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Give each word the kept span it overlaps most, the first of equals.

    Words without length belong to the span that contains them; words that
    touch no span are gone. `spans` comes from `with_offsets`.

    Words and spans are put in one row of time per block of words, where a word follows
    the last span that begins before it. That span is the answer unless another one
    begins inside the word; only such words, a small part, are joined to spans.
    """
    said = blocked(words).select("take_id", "blk", "idx", "start_ms", "end_ms", "text")
    s = spans.select(
        "take_id", "seg", "offset_ms", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    near = with_neighbours(s, ["take_id"], "seg", next={"next_s": "s"})
    until = F.greatest("s", "e", F.coalesce(F.col("next_s") - 1, "e"))
    marks = by_words(said, near, F.col("start_ms"), F.col("start_ms"), F.col("s"), until)
    marks = marks.select("take_id", "blk", F.col("s").alias("at_"), F.lit(0).alias("kind_"),
                         F.struct("seg", "offset_ms", "s", "e", "next_s").alias("span"))
    timed = said.withColumns({"at_": F.col("start_ms"), "kind_": F.lit(1)})
    w = Window.partitionBy("take_id", "blk").orderBy("at_", "kind_")
    placed = timed.unionByName(marks, allowMissingColumns=True).withColumn(
        "span", F.last("span", ignorenulls=True).over(w)).filter("kind_ = 1").select(
        "take_id", "blk", "idx", "start_ms", "end_ms", "text", "span.*")
    flat = F.col("end_ms") <= F.col("start_ms")
    # a word without length at the begin of a span may stand at the end of the one before
    sure = F.coalesce(F.col("s").isNotNull() & F.when(flat, F.col("s") < F.col("start_ms")).otherwise(
        F.col("next_s").isNull() | (F.col("next_s") >= F.col("end_ms"))), F.lit(False))
    held = F.when(flat, F.col("start_ms") <= F.col("e")).otherwise(F.col("start_ms") < F.col("e"))
    rest = _by_overlap(placed.filter(~sure).select(*said.columns), s)
    # Those are few; words of one position, as of a take that is given twice, go by their time.
    rest = rest.repartition("take_id", "blk").sortWithinPartitions("take_id", "blk", "idx", "start_ms")
    out = placed.filter(sure & held).drop("next_s").unionByName(rest)
    return out if carried(words) else out.drop("blk")


def _by_overlap(words: DataFrame, s: DataFrame) -> DataFrame:
    """Words with the one of all spans they touch that they overlap most."""
    flat = F.col("end_ms") <= F.col("start_ms")
    inside = (F.col("s") <= F.col("start_ms")) & (F.col("start_ms") <= F.col("e"))
    over = (F.col("start_ms") < F.col("e")) & (F.col("end_ms") > F.col("s"))
    pairs = interval_join(
        words, s, (F.col("start_ms"), F.col("end_ms")), (F.col("s"), F.col("e")),
        F.when(flat, inside).otherwise(over))
    # Overlap first, then the lower span, as one number: plain columns keep the
    # aggregation in its hash table, where a struct would have to be sorted.
    overlap = F.greatest(F.lit(0), F.least("end_ms", "e") - F.greatest("start_ms", "s"))
    rank = overlap.cast("decimal(18,0)") * F.lit(10 ** 18).cast("decimal(19,0)") - F.col("seg")
    return pairs.withColumn("rank_", rank).groupBy(*words.columns).agg(
        *[F.max_by(c, "rank_").alias(c) for c in ("seg", "offset_ms", "s", "e")])


def retime(assigned: DataFrame) -> DataFrame:
    """Clip each word to its span and move it onto the new timeline."""
    start = F.col("offset_ms") + F.greatest(F.lit(0), F.col("start_ms") - F.col("s"))
    end = F.col("offset_ms") + F.least(F.col("e") - F.col("s"), F.col("end_ms") - F.col("s"))
    return assigned.select(
        "take_id", *[b for b in [carried(assigned)] if b], "idx", start.alias("start_ms"),
        F.when(end <= start, start + fixed.MIN_WORD_MS).otherwise(end).alias("end_ms"),
        "text", "seg")


def apply_cuts(words: DataFrame, cuts: DataFrame, media: DataFrame) -> DataFrame:
    """Words that survive the automatic cuts, on the shortened timeline.

    They keep their positions; see `renumbered` before detecting on them again.
    """
    spans = with_offsets(keep_segments(cuts.filter("auto"), media))
    return retime(assign_words(words, spans))


def renumbered(words: DataFrame) -> DataFrame:
    """Words with positions 0, 1, 2, ... again, as every scan over neighbours needs them."""
    counted = running(blocked(words), ["take_id"], "blk", ["idx"], sums={"new_": F.lit(1)})
    out = counted.withColumn("idx", F.col("new_")).drop("new_")
    return out if carried(words) else out.drop("blk")


def everything_cut(kept: DataFrame, media: DataFrame) -> DataFrame:
    """Takes of which nothing is left: an error for them, not an empty file."""
    gone = media.select("take_id").join(kept.select("take_id").distinct(), "take_id", "left_anti")
    return gone.withColumn("error", F.lit("Nothing to export: every span was cut"))
