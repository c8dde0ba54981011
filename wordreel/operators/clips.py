"""Clip candidates: content types, limits, ranking, windows, sampling plans, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordreel import fixed
from wordreel.operators.scan import join_takes, ranked, running, time_block


def content_type(videos: DataFrame) -> DataFrame:
    """Add `content_type` from title, description, tags and the transcript's beginning.

    Substrings count, also inside longer words; the first type that matches wins.
    """
    none = F.lit("")
    seen = F.lower(F.concat_ws(
        " ", F.lower(F.coalesce("title", none)), F.lower(F.coalesce("description", none)),
        F.lower(F.coalesce(F.array_join("tags", " "), none)),
        F.substring(F.coalesce("transcript", none), 1, fixed.CONTENT_PREFIX_CHARS)))
    kind = F.lit("general")
    for name, marks in reversed(fixed.CONTENT_TYPES):
        kind = F.when(seen.rlike("|".join(marks)), name).otherwise(kind)
    return videos.withColumn("content_type", kind)


def dimension(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def with_criteria(videos: DataFrame) -> DataFrame:
    """Add what to look for in the video's type, and the line for a wished style."""
    spark = videos.sparkSession
    guide = dimension(spark, fixed.CONTENT_CRITERIA, "content_type string, criteria string")
    style = dimension(spark, fixed.CLIP_STYLES, "clip_style string, wish string")
    general = dict(fixed.CONTENT_CRITERIA)["general"]
    out = videos.join(F.broadcast(guide), "content_type", "left").join(
        F.broadcast(style), "clip_style", "left")
    directive = F.when(F.col("wish").isNotNull() & (F.col("clip_style") != "auto"), F.concat(
        F.lit("Wanted above all: "), F.upper("clip_style"), F.lit(". "), F.col("wish")))
    return out.withColumns({"criteria": F.coalesce("criteria", F.lit(general)),
                            "directive": directive}).drop("wish")


def _given(name: str) -> Column:
    """A number that was really given: zero counts as not set."""
    return F.nullif(F.col(name), F.lit(0))


def selection_limits(requests: DataFrame) -> DataFrame:
    """Add min_len, max_len (seconds), count_low and count_high."""
    low = F.greatest(F.lit(5), F.least(F.coalesce(_given("min_clip_length"), F.lit(20)), F.lit(120)))
    high = F.greatest(low + 5, F.least(F.coalesce(_given("max_clip_length"), F.lit(60)), F.lit(180)))
    exact = F.greatest(F.lit(1), F.least(_given("clip_count"), F.lit(10)))
    wanted = _given("clip_count").isNotNull()
    return requests.withColumns({
        "min_len": low, "max_len": high,
        "count_low": F.when(wanted, exact).otherwise(F.lit(3)),
        "count_high": F.when(wanted, exact).otherwise(F.lit(5))})


def clip_prompts(videos: DataFrame) -> DataFrame:
    """(video_id, body): the question to the model, from type, limits and transcript."""
    amount = F.when(F.col("count_low") == F.col("count_high"), F.col("count_low").cast("string")) \
        .otherwise(F.concat(F.col("count_low").cast("string"), F.lit(" to "),
                            F.col("count_high").cast("string")))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(
        F.lit("Title: "), "title", F.lit("\n"))).otherwise("")
    words = F.when(F.coalesce("transcript", F.lit("")) != "", F.concat(
        F.lit("\nTranscript:\n"), "transcript")).otherwise("\nNo transcript; go by the frames.")
    return videos.select("video_id", F.concat(
        title, F.lit("Kind: "), "content_type", F.lit("\nPick the best "), amount,
        F.lit(" moments of "), F.col("min_len").cast("string"), F.lit(" to "),
        F.col("max_len").cast("string"), F.lit(" seconds, without overlap, best first.\nLook for: "),
        "criteria", F.coalesce(F.concat(F.lit("\n"), "directive"), F.lit("")), words,
        F.lit('\nAnswer with a JSON array of {"start_time", "end_time", "description", "hook", '
              '"virality_score", "clip_type"}.')).alias("body"))


def rank_clips(listed: DataFrame, *keys: str) -> DataFrame:
    """(keys, rank, clip fields) from `clips` arrays, best score first, else as replied.

    The array is sorted where it lies; nothing is shuffled.
    """
    scored = F.transform("clips", lambda c, i: F.struct(
        (-F.coalesce(c["virality_score"], F.lit(0.0))).alias("worst"), i.alias("pos"), c.alias("c")))
    return listed.select(*keys, F.posexplode(F.array_sort(scored)).alias("rank", "s")).select(
        *keys, F.col("rank").cast("bigint").alias("rank"), "s.c.*")


def clamp_clips(clips: DataFrame, media: DataFrame, on: str = "video_id") -> DataFrame:
    """Hold the window inside the video; the end is at least a second after the start."""
    held = join_takes(clips, media.select(on, "duration_ms"), on=on)
    start = F.greatest(F.lit(0), F.least(F.coalesce("start_ms", F.lit(0)), "duration_ms"))
    end = F.least(F.coalesce("end_ms", F.lit(10_000)), "duration_ms")
    return held.withColumn("start_ms", start).withColumn(
        "end_ms", F.greatest(F.col("start_ms") + 1000, end))


def audit_clips(clips: DataFrame, media: DataFrame, limits: DataFrame,
                on: str = "video_id") -> DataFrame:
    """Report columns per clip: what was asked of the model, now checked. No row is dropped."""
    held = join_takes(clips, media.select(on, "duration_ms"), on=on)
    held = join_takes(held, limits.select(on, "min_len", "max_len"), on=on)
    blocked = held.withColumn("blk_", time_block("start_ms"))
    seen = running(blocked, [on], "blk_", ["start_ms", "end_ms", "clip_id"],
                   maxima={"reach": F.col("end_ms")})
    length = F.col("end_ms") - F.col("start_ms")
    return seen.select(
        on, "clip_id",
        F.coalesce(F.col("start_ms") < F.col("reach"), F.lit(False)).alias("overlaps"),
        ((F.col("start_ms") >= 0) & (F.col("end_ms") <= F.col("duration_ms"))).alias("inside"),
        ((length >= F.col("min_len") * 1000) & (length <= F.col("max_len") * 1000)).alias("fits"))


def audit_counts(clips: DataFrame, limits: DataFrame, on: str = "video_id") -> DataFrame:
    n = clips.groupBy(on).agg(F.count("*").alias("clips"))
    return limits.join(n, on, "left").select(
        on, F.coalesce("clips", F.lit(0)).alias("clips"),
        F.coalesce("clips", F.lit(0)).between(F.col("count_low"), F.col("count_high"))
        .alias("count_fits"))


def keyframe_plan(media: DataFrame, on: str = "take_id") -> DataFrame:
    """Evenly spaced interior instants: 12 with a transcript, 20 without; 60 s if unknown."""
    n = F.when(F.col("has_transcript"), 12).otherwise(20)
    length = F.coalesce("duration_ms", F.lit(60_000))
    one = media.select(on, n.alias("n"), length.alias("length"), F.explode(F.sequence(F.lit(1), n))
                       .alias("frame"))
    # Tenths of a second, half up, from whole numbers.
    tenth = F.floor((F.col("length") * F.col("frame") * 2 + (F.col("n") + 1) * 100)
                    / ((F.col("n") + 1) * 200)).cast("bigint")
    return one.select(on, F.col("frame").cast("bigint").alias("frame"), (tenth * 100).alias("at_ms"))


def face_plan(clips: DataFrame, *keys: str) -> DataFrame:
    """One instant per two seconds of a clip, in the middle of its share."""
    length = F.col("end_ms") - F.col("start_ms")
    n = F.greatest(F.lit(1), F.floor(length / 2000)).cast("bigint")
    one = clips.select(*keys, "start_ms", length.alias("length"), n.alias("n"),
                       F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))
    at = F.col("start_ms") + F.floor((F.col("i") * 2 + 1) * F.col("length") / (F.col("n") * 2))
    return one.select(*keys, "i", at.cast("bigint").alias("at_ms"))


def face_centers(detections: DataFrame, on: str) -> DataFrame:
    """Mean centre of all found faces as fractions, and the offset towards it."""
    mid = detections.groupBy(on).agg(
        F.avg((F.col("x") + F.col("w") / 2) / F.col("frame_w")).alias("cx"),
        F.avg((F.col("y") + F.col("h") / 2) / F.col("frame_h")).alias("cy"))
    held = lambda c: F.greatest(F.lit(0.25), F.least(F.lit(0.75), F.col(c)))
    return mid.select(on, "cx", "cy", ((held("cx") - 0.5) * 200).cast("bigint").alias("dx"),
                      ((held("cy") - 0.5) * 200).cast("bigint").alias("dy"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add `error`: the first rule a request breaks, NULL if none."""
    styles = [s for s, _ in fixed.CLIP_STYLES]
    captions = [p[0] for p in fixed.CLIP_PRESETS]
    within = lambda c, lo, hi: F.col(c).isNull() | F.col(c).between(lo, hi)
    return requests.withColumn("error", (
        F.when(~F.col("clip_style").isin(styles), "Invalid clip_style")
        .when(~F.col("caption_style").isin(captions), "Invalid caption_style")
        .when(~within("clip_count", 1, 10), "clip_count must be between 1 and 10")
        .when(~within("min_clip_length", 5, 120), "min_clip_length must be between 5 and 120 seconds")
        .when(~within("max_clip_length", 10, 180),
              "max_clip_length must be between 10 and 180 seconds")
        .when(F.col("min_clip_length") > F.col("max_clip_length"),
              "min_clip_length cannot exceed max_clip_length")))


def request_key() -> Column:
    """First 16 hex digits of the hash over everything that shapes a result."""
    number = lambda c: F.coalesce(_given(c).cast("string"), F.lit(""))
    raw = F.concat_ws("||", F.col("user_id").cast("string"), "url",
                      F.coalesce("instructions", F.lit("")), "clip_style", "caption_style",
                      number("clip_count"), number("min_clip_length"), number("max_clip_length"))
    return F.substring(F.sha2(raw, 256), 1, 16)


FILTER_BITS = 25        # a filter has 2 ** 25 bits: 4 MB, whatever it was made of


def maybe_wanted(history: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """Rows of `history` without almost all whose key is not in `wanted`; none that is goes.

    The wanted keys set bits of a table of fixed size, which every task has, so rows
    that nobody asks for are dropped where they are read, before any shuffle.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS).cast("bigint"))
    part, bit = F.shiftright(at, 15), at.bitwiseAND(F.lit((1 << 15) - 1).cast("bigint"))
    bits = wanted.select(part.alias("part_"), bit.alias("bit_")).groupBy("part_").agg(
        F.bitmap_construct_agg("bit_").alias("bits_"))     # at most 1,024 rows of 4 KB
    found = history.withColumns({"part_": part, "bit_": bit}).join(F.broadcast(bits), "part_")
    byte = F.conv(F.hex(F.substring("bits_", (F.col("bit_") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    on = F.expr("bit_ % 8").cast("int")
    return found.withColumn("on_", on).withColumn("byte_", byte.cast("int")).filter(
        "(shiftright(byte_, on_) & 1) = 1").drop("part_", "bit_", "bits_", "on_", "byte_")


def dedupe_requests(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Add `key` and `job`: the finished job to reuse, else the first request of that key.

    `job` equals the request's own id where the work must be done. A key many
    ask for is reduced to its first request before the shuffle, and of a long
    history only what may be asked for is shuffled.
    """
    keyed = requests.withColumn("key", request_key())
    first = keyed.groupBy("key").agg(F.min("request_id").alias("first"))
    past = maybe_wanted(done.select("key", F.col("job_id").alias("finished")), first)
    owner = first.join(past, "key", "left")
    owned = join_takes(keyed, owner, on="key")
    return owned.withColumn("cached", F.col("finished").isNotNull()).withColumn(
        "job", F.coalesce("finished", "first")).drop("finished", "first")


def job_outcome(results: DataFrame) -> DataFrame:
    """(job_id, status, message): any clip made is a success, with a warning if not all."""
    per = results.groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("made"))
    bad = (F.col("n") - F.col("made")).cast("string")
    total = F.col("n").cast("string")
    return per.select(
        "job_id", F.when(F.col("made") > 0, "completed").otherwise("failed").alias("status"),
        F.when(F.col("made") == 0, F.concat(F.lit("All "), total, F.lit(
            " clips failed to render/upload")))
        .when(F.col("made") < F.col("n"), F.concat(bad, F.lit(" of "), total, F.lit(" clips failed")))
        .alias("message"))


def retry_once(attempts: DataFrame, *keys: str) -> DataFrame:
    """Of up to two attempts per clip: made if either worked, the last error if not."""
    return attempts.filter("attempt <= 2").groupBy(*keys).agg(
        F.bool_or("ok").alias("ok"),
        F.max_by("error", F.when(~F.col("ok"), F.col("attempt"))).alias("error")).withColumn(
        "error", F.when(~F.col("ok"), F.col("error")))


def human_time(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(seconds <= 0, "expired").when(hours > 0, F.concat(
        hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("m")))


def clip_library(clips: DataFrame, now: Column, tie: str = "clip_id") -> DataFrame:
    """Unexpired clips with the seconds left, ranked newest first for each user.

    `created_at` is text, `now` epoch seconds; a creation time that cannot be read
    counts as now. Clips of one second are ranked by `tie`, the larger first.
    """
    made = F.coalesce(F.unix_timestamp(F.expr("try_to_timestamp(created_at)")), now)
    left = made + fixed.CLIP_TTL_SECONDS - now
    live = clips.withColumns({"created_s": made, "expires_in_seconds": left}).filter(
        "expires_in_seconds > 0").withColumn(
        "expires_in_human", human_time(F.col("expires_in_seconds")))
    return ranked(live, ["user_id"], [F.desc("created_s"), F.desc(tie)], "rank")


def catalogue(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """(kind, id, label, description, anim_type, asked): what can be asked for.

    Clip styles have a description, caption styles an animation; `asked` counts
    the requests (clip_style, caption_style) that name each.
    """
    listed = spark.createDataFrame(
        [("clip", i, text, None) for i, text in fixed.CLIP_STYLES]
        + [("caption", p[0], None, p[fixed.CLIP_ANIMATION]) for p in fixed.CLIP_PRESETS],
        "kind string, id string, description string, anim_type string")
    named = requests.select(F.explode(F.array(
        F.struct(F.lit("clip").alias("kind"), F.col("clip_style").alias("id")),
        F.struct(F.lit("caption").alias("kind"), F.col("caption_style").alias("id")))).alias("x"))
    asked = named.groupBy("x.kind", "x.id").agg(F.count("*").alias("asked"))
    return listed.join(asked, ["kind", "id"], "left").select(
        "kind", "id", F.initcap(F.replace("id", F.lit("_"), F.lit(" "))).alias("label"),
        "description", "anim_type", F.coalesce("asked", F.lit(0)).alias("asked"))


def clip_rows(clips: DataFrame) -> DataFrame:
    """Rows for the clip table: texts cut to their columns, empty options left out."""
    short = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return clips.select(
        "user_id", "job_id", "filename",
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("job_id").cast("string"),
                    "filename").alias("storage_path"),
        short("description", 500), short("source_url", 500),
        F.bround("start_time", 2).alias("start_time"), F.bround("end_time", 2).alias("end_time"),
        F.nullif(F.substring("hook", 1, 300), F.lit("")).alias("hook"),
        F.nullif("virality_score", F.lit(0)).alias("virality_score"),
        F.nullif(F.substring("clip_type", 1, 50), F.lit("")).alias("clip_type"))
