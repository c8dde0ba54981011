"""Canonical tables derived from the given parquet tables.

There is no transcript among the given tables, so every word of ``documents``
becomes a spoken word with a timing that follows from its position and its
punctuation. The other canonical tables follow from the words or from the order
and event tables. All of it is one read of the source and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wordreel.operators.scan import BLOCK, carried, with_neighbours

TOKENS = r"split(btrim(text, ' \n\r\t'), '[ \n\r\t]+')"


def duration(text: str) -> str:
    return f"100L + 60L * least(length({text}), 12)"


def gap(text: str, idx: str) -> str:
    return f"""CASE WHEN right({text}, 1) IN ('.', '!', '?') THEN 500L + ({idx} * 37) % 900
              WHEN right({text}, 1) IN (',', ';', ':') THEN 250L + ({idx} * 29) % 300
              WHEN {idx} % 17 = 0 THEN 300L + ({idx} * 13) % 400
              ELSE ({idx} * 7) % 60 END"""


DURATION, GAP = duration("text"), gap("text", "idx")
FPS = """element_at(array(23.976D, 25.0D, 29.97D, 30.0D, 59.94D), cast(take_id % 5 + 1 as int))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str, timed: bool = False) -> DataFrame:
    """(take_id, blk, part): tokens in blocks of one row each; with `timed` also `carry`,
    the time that the blocks before take.

    A document is one row anyway, so what its earlier blocks add up to is found
    in that row; only documents of several blocks are added up. What is shuffled
    are blocks, so that a long document is many tasks' work. A block travels as one
    text, `carry` and its tokens parted by blanks, which no token has: a fraction of
    the bytes of an array, and one column, so that all readers of a plan share the shuffle.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("take_id"),
                                                    F.expr(TOKENS).alias("toks"))
    last = f"greatest(size(toks) - 1, 0) div {BLOCK}"
    part = f"slice(toks, cast(b * {BLOCK} + 1 as int), {BLOCK})"
    carry = "'0'"
    if timed:
        step = f"{duration('x')} + {gap('x', 'acc.idx')}"
        docs = docs.withColumn("sums", F.expr(
            f"CASE WHEN size(toks) > {BLOCK} THEN transform(sequence(0, {last} - 1), b ->"
            f" aggregate({part}, named_struct('ms', 0L, 'idx', b * {BLOCK}L),"
            f" (acc, x) -> named_struct('ms', acc.ms + {step}, 'idx', acc.idx + 1L)).ms) END"))
        carry = ("cast(coalesce(aggregate(slice(sums, 1, cast(b as int)), 0L, (acc, x) -> acc + x),"
                 " 0L) as string)")
    cut = f"transform(sequence(0, {last}), b -> concat({carry}, ' ', array_join({part}, ' ')))"
    out = docs.select("take_id", F.posexplode(F.expr(cut)).alias("blk", "said"))
    sent = out.select("take_id", F.col("blk").cast("bigint").alias("blk"), "said").repartition(
        "take_id", "blk")
    part_ = F.expr(f"slice(split(said, ' '), 2, {BLOCK})").alias("part")
    if not timed:
        return sent.select("take_id", "blk", part_)
    return sent.select("take_id", "blk", part_,
                       F.substring_index("said", " ", 1).cast("bigint").alias("carry"))


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    # With the outer form Spark adds no filter on the array, which would split the text again.
    return rows.select("take_id", "blk", *keep, F.posexplode_outer("part").alias("at", "text")).filter(
        "text <> ''").select(
        "take_id", "blk", (F.col("blk") * BLOCK + F.col("at")).alias("idx"), "text", *keep)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(take_id, blk, idx, text): words in order, spread by block of a take."""
    return _exploded(blocks(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(take_id, blk, idx, start_ms, end_ms, text, hinglish, devanagari); one read, one shuffle."""
    timed = _exploded(blocks(spark, sf_dir, timed=True), "carry").withColumn(
        "dur_", F.expr(DURATION))
    before = Window.partitionBy("take_id", "blk").orderBy("idx").rowsBetween(
        Window.unboundedPreceding, -1)
    spent = F.sum(F.col("dur_") + F.expr(GAP)).over(before)
    start = F.col("carry") + F.coalesce(spent, F.lit(0))
    missing = F.lit(None).cast("string")
    return timed.withColumn("start_ms", start).select(
        "take_id", "blk", "idx", "start_ms", (F.col("start_ms") + F.col("dur_")).alias("end_ms"),
        "text", missing.alias("hinglish"), missing.alias("devanagari"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per take; the length is one second more than the last word.

    The last word ends where all steps but the last gap are summed, and a document
    is one row, so its words are added up in place: one read and no shuffle.
    """
    step = f"{duration('x')} + {gap('x', 'acc.idx')}"
    ends = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("take_id"), F.expr(TOKENS).alias("toks")).filter(
        "element_at(toks, 1) <> ''").select("take_id", F.expr(
            "aggregate(toks, named_struct('ms', 0L, 'idx', 0L),"
            f" (acc, x) -> named_struct('ms', acc.ms + {step}, 'idx', acc.idx + 1L),"
            f" acc -> acc.ms - ({gap('element_at(toks, -1)', '(acc.idx - 1)')}))").alias("last_ms"))
    return media_of(ends)


def media_of(ends: DataFrame) -> DataFrame:
    return ends.select(
        "take_id",
        (F.col("last_ms") + 1000).alias("duration_ms"),
        F.expr(FPS).alias("fps"),
        F.lit(1080).alias("width"),
        F.lit(1920).alias("height"),
        (F.col("take_id") % 7 != 0).alias("has_audio"),
        F.when(F.col("take_id") % 7 != 0, (F.col("take_id") % 3).cast("int")).alias("channels"),
        F.expr("CASE WHEN take_id % 7 <> 0 THEN element_at(array(44100, 48000, 22050),"
               " cast(take_id % 3 + 1 as int)) END").alias("sample_rate"),
        (F.col("take_id") % 2 == 0).alias("measured"),
        F.concat(F.lit("/media/take & "), F.col("take_id").cast("string"), F.lit(".mp4"))
        .alias("file_name"),
    )


def pauses(words: DataFrame, min_ms: int = 300) -> DataFrame:
    """(take_id, start_ms, end_ms): gaps between neighbours in takes that were measured."""
    near = with_neighbours(words.filter("take_id % 2 = 0"), ["take_id"], "idx",
                           prev={"prev_end": "end_ms"}, block=carried(words))
    return near.filter(F.col("start_ms") - F.col("prev_end") >= min_ms).select(
        "take_id", F.col("prev_end").alias("start_ms"), F.col("start_ms").alias("end_ms")
    )


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pauses(words(spark, sf_dir))
