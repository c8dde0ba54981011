"""Line sources: silence detector logs and subtitle tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordreel.functions.text import strip
from wordreel.operators.scan import position_block, running

# What marks the lines.
SILENCE_START = r"silence_start: (-?[\d.]+)"
SILENCE_END = r"silence_end: (-?[\d.]+)"
CUE_ARROW = "-->"
TRACK_LANGUAGES = ("en", "en-US", "en-GB")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(take_id, line_no, line): one file per take, lines numbered within it.

    A long file is read by several tasks; lines are counted in each of their
    pieces, then by what the pieces before hold.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("take_id"),
        F.col("_metadata.file_block_start").alias("blk_"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return running(rows, ["take_id"], "blk_", ["at"], sums={"line_no": F.lit(1)}).select(
        "take_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def silences_from_log(lines: DataFrame) -> DataFrame:
    """(take_id, start_ms, end_ms): the i-th start of a take with its i-th end.

    A start without an end, at the end of the file, is dropped.
    """
    def events(pattern: str, name: str) -> DataFrame:
        found = lines.withColumn("said", F.regexp_extract_all("line", F.lit(pattern)))
        one = found.select("take_id", "line_no", F.posexplode("said").alias("at", "value"))
        # Several reports on one line keep their order.
        placed = one.withColumn("blk_", position_block("line_no"))
        return running(placed, ["take_id"], "blk_", ["line_no", "at"],
                       sums={"n": F.lit(1)}).select(
            "take_id", "n", F.round(F.col("value").cast("double") * 1000).cast("bigint").alias(name))

    return events(SILENCE_START, "start_ms").join(
        events(SILENCE_END, "end_ms"), ["take_id", "n"]).drop("n")


def cues_from_vtt(lines: DataFrame) -> DataFrame:
    """(take_id, line_no, t, text): the first text line of every timed cue, tags removed."""
    text = strip("line")
    timing = F.contains(text, F.lit(CUE_ARROW))
    clean = strip(F.regexp_replace(text, "<[^>]+>", ""))
    says = ~timing & (clean != "") & ~F.startswith(text, F.lit("WEBVTT")) & ~text.rlike(r"^\d")
    marked = lines.select(
        "take_id", "line_no", position_block("line_no").alias("blk_"),
        F.when(timing, F.substring(strip(F.substring_index(text, CUE_ARROW, 1)), 1, 8)).alias("t"),
        F.when(says, clean).alias("text"))
    cue = running(marked, ["take_id"], "blk_", ["line_no"],
                  maxima={"cue": F.when(F.col("t").isNotNull(), F.col("line_no"))})
    cue = cue.withColumn("cue", F.coalesce(F.when(F.col("t").isNotNull(), F.col("line_no")), "cue"))
    # A timing line without a time silences what follows it.
    return cue.filter("cue IS NOT NULL").groupBy("take_id", "cue").agg(
        F.max("t").alias("t"),
        F.min_by(F.struct("line_no", "text"), F.when(F.col("text").isNotNull(), F.col("line_no")))
        .alias("first")).filter("first IS NOT NULL AND t <> ''").select("take_id", "first.line_no", "t",
                                                            "first.text")


def transcript_text(cues: DataFrame) -> DataFrame:
    """(take_id, line_no, sub, line): `[time] text` lines in the order of the track."""
    from wordreel.operators.captions import text_lines

    return text_lines(cues, F.col("line_no"), F.array(
        F.concat(F.lit("["), F.col("t"), F.lit("] "), F.col("text"))))


def pick_tracks(files: DataFrame) -> DataFrame:
    """(video, file): the track of the preferred language, else the first that begins alike.

    `files` has (video, file); both are names without a folder.
    """
    wanted = F.array(*[F.concat("video", F.lit(f".{code}.vtt")) for code in TRACK_LANGUAGES])
    rank = F.array_position(wanted, F.col("file"))
    tracks = files.filter(F.startswith("file", "video") & F.endswith("file", F.lit(".vtt")))
    return tracks.groupBy("video").agg(F.min_by(
        "file", F.struct(F.when(rank > 0, rank).otherwise(99), "file")).alias("file"))
