"""Media facts from a probe's JSON, and what stands in where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PROBE = (
    "struct<streams: array<struct<codec_type: string, width: int, height: int,"
    " r_frame_rate: string, channels: int, sample_rate: string>>,"
    " format: struct<duration: string>>"
)


def media_from_probe(rows: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(media, rejects) from (take_id, body); a file without sound has no channel count."""
    said = rows.select("take_id", F.from_json(body, PROBE).alias("p"))
    streams = F.coalesce("p.streams", F.array().cast(
        "array<struct<codec_type: string, width: int, height: int, r_frame_rate: string,"
        " channels: int, sample_rate: string>>"))
    said = said.withColumns({
        "v": F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0)),
        "a": F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))})
    ratio = F.split("v.r_frame_rate", "/")
    fps = F.round(F.try_divide(F.get(ratio, F.lit(0)).try_cast("double"),
                               F.get(ratio, F.lit(1)).try_cast("double")), 3)
    length = F.col("p.format.duration").try_cast("double")
    said = said.withColumns({"fps": fps, "length": length})
    error = (F.when(F.col("v").isNull(), "No video stream found")
             .when(F.col("fps").isNull(), "Bad frame rate")
             .when(F.col("length").isNull(), "No duration"))
    said = said.withColumn("error", error)
    sound = F.col("a").isNotNull()
    media = said.filter("error IS NULL").select(
        "take_id", F.round(F.col("length") * 1000).cast("bigint").alias("duration_ms"), "fps",
        "v.width", "v.height", sound.alias("has_audio"),
        F.nullif("a.channels", F.lit(0)).alias("channels"),
        F.nullif(F.col("a.sample_rate").try_cast("int"), F.lit(0)).alias("sample_rate"))
    return media, said.filter("error IS NOT NULL").select("take_id", "error")


def default_media(words: DataFrame) -> DataFrame:
    """Takes nobody probed: upright video at 30 frames, as long as their last word."""
    last = F.max_by("end_ms", "idx").alias("duration_ms")
    return words.groupBy("take_id").agg(last).select(
        "take_id", "duration_ms", F.lit(30.0).alias("fps"), F.lit(1080).alias("width"),
        F.lit(1920).alias("height"))
