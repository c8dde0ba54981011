"""Transcript sources: recognizer output and saved transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordreel import fixed
from wordreel.functions.text import strip
from wordreel.operators.scan import join_takes

SEGMENTS = (
    "struct<language: string, backend: string,"
    " segments: array<struct<start: double, end: double, text: string,"
    " words: array<struct<word: string, start: double, end: double>>>>,"
    " words: array<struct<start: double, end: double, text: string, hinglish: string,"
    " devanagari: string>>>"
)


def ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def transcript_words(parsed: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Words of transcripts (take_id, t), `t` as SEGMENTS.

    A saved word list is taken as it is. Else the words of all segments, blanks
    dropped; a transcript without any word falls back to its segments as words.
    All of it happens inside the row of the transcript.
    """
    kept = (lambda w: F.lit(True)) if keep_blank else (lambda w: w["text"] != "")
    no_text = F.lit(None).cast("string")
    one = lambda start, end, text: F.struct(
        start.alias("start"), end.alias("end"), text.alias("text"), no_text.alias("hinglish"),
        no_text.alias("devanagari"))
    segments = F.coalesce("t.segments", F.array().cast(
        "array<struct<start: double, end: double, text: string,"
        " words: array<struct<word: string, start: double, end: double>>>>"))
    spoken = F.filter(F.flatten(F.transform(segments, lambda s: F.transform(
        F.coalesce(s["words"], F.array().cast(
            "array<struct<word: string, start: double, end: double>>")),
        lambda w: one(w["start"], w["end"], strip(w["word"]))))), kept)
    whole = F.filter(F.transform(segments, lambda s: one(s["start"], s["end"], strip(s["text"]))),
                     kept)
    listed = parsed.withColumn("spoken_", spoken).withColumn(
        "list_", F.when(F.size(F.coalesce("t.words", F.array().cast(
            "array<struct<start: double, end: double, text: string, hinglish: string,"
            " devanagari: string>>"))) > 0, F.col("t.words"))
        .when(F.size("spoken_") > 0, F.col("spoken_")).otherwise(whole))
    return listed.select("take_id", F.posexplode("list_").alias("idx", "w")).select(
        "take_id", F.col("idx").cast("bigint").alias("idx"), ms(F.col("w.start")).alias("start_ms"),
        ms(F.col("w.end")).alias("end_ms"), "w.text", "w.hinglish", "w.devanagari")


def parse_transcripts(rows: DataFrame, body: str = "body") -> DataFrame:
    """(take_id, t) from JSON texts; texts that are no transcript have a NULL `t`."""
    t = F.from_json(body, SEGMENTS)
    said = t["segments"].isNotNull() | t["words"].isNotNull()
    return rows.select("take_id", F.when(said, t).alias("t"))


def rejected_transcripts(parsed: DataFrame) -> DataFrame:
    """(take_id, error) of texts that have neither segments nor words."""
    return parsed.filter("t IS NULL").select("take_id", F.lit(fixed.BAD_TRANSCRIPT).alias("error"))


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words, rejects) of every JSON file under a path, one document per file.

    A JSON document over several lines cannot be split, so each file is one row.
    """
    rows = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("take_id"), F.col("value").alias("body"))
    parsed = parse_transcripts(rows)
    return transcript_words(parsed), rejected_transcripts(parsed)


def write_transcripts(words: DataFrame, path: str) -> None:
    """Word rows as JSON lines, one file set per call."""
    words.write.mode("errorifexists").json(path)


def clamp_words(words: DataFrame, media: DataFrame) -> DataFrame:
    """Hold word ends inside the clip."""
    held = join_takes(words, media.select("take_id", "duration_ms"))
    return held.withColumn("end_ms", F.least("end_ms", "duration_ms")).drop("duration_ms")
