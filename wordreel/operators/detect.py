"""Detectors: dead air, filler sounds, stutters, and their merged cut list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordreel import fixed
from wordreel.functions.text import clean_token, display_text, ends_clause, hundredths
from wordreel.operators.intervals import merge_intervals
from wordreel.operators.scan import carried, join_takes, position_block, with_neighbours
from wordreel.session import settle

CUT = ["take_id", "start_ms", "end_ms", "reason", "confidence_pct", "text", "auto", "ord"]
# Cuts of one start keep the order silence, filler, repeat, then word position.
SILENCE_RANK, FILLER_RANK, REPEAT_RANK, RETAKE_RANK = 0, 1, 2, 3
RANK_STEP = 1 << 40
CANDIDATE = "candidate"


@dataclass(frozen=True)
class Lexicon:
    """Word lists; short by nature, so they are literals in the plan."""

    nonlexical: tuple[str, ...] = fixed.NONLEXICAL_FILLERS
    lexical: tuple[str, ...] = fixed.LEXICAL_FILLERS
    reduplicated: tuple[str, ...] = fixed.REDUPLICATED

    def table(self, spark) -> DataFrame:
        rows = [(t, "nonlexical") for t in self.nonlexical]
        rows += [(t, "lexical") for t in self.lexical]
        rows += [(t, "reduplicated") for t in self.reduplicated]
        return spark.createDataFrame(rows, "token string, class string")


@dataclass(frozen=True)
class TightenConfig:
    silence: bool = True
    min_gap_ms: int = 400
    keep_padding_ms: int = 120
    fillers: bool = True
    lexical_fillers: bool = True
    auto_pct: int = 70
    suggest_pct: int = 45
    min_pause_ms: int = 250
    repeats: bool = True
    edge_padding_ms: int = 60


def requested_gap_ms(seconds: float) -> int:
    """A caller's shortest gap, held between 0.15 and 2 seconds."""
    return round(max(0.15, min(2.0, seconds)) * 1000)


def with_gaps(words: DataFrame) -> DataFrame:
    """Add `gap_before` and `gap_after` in ms, 0 at the ends of the take."""
    near = with_neighbours(words, ["take_id"], "idx", prev={"prev_end": "end_ms"},
                           next={"next_start": "start_ms"}, block=carried(words))
    return near.withColumns({
        "gap_before": F.coalesce(F.col("start_ms") - F.col("prev_end"), F.lit(0)),
        "gap_after": F.coalesce(F.col("next_start") - F.col("end_ms"), F.lit(0)),
    }).drop("prev_end", "next_start")


def with_context(words: DataFrame) -> DataFrame:
    """Everything the single-word detectors look at, in one pass over the words."""
    lies = [b for b in [carried(words)] if b]
    shown = words.select("take_id", *lies, "idx", "start_ms", "end_ms", display_text().alias("raw"))
    near = with_neighbours(
        shown.withColumn("token", clean_token("raw")), ["take_id"], "idx",
        prev={"prev_start": "start_ms", "prev_end": "end_ms", "prev_raw": "raw",
              "prev_token": "token"},
        next={"next_start": "start_ms"}, block=carried(words),
    )
    return near.withColumns({
        "gap_before": F.coalesce(F.col("start_ms") - F.col("prev_end"), F.lit(0)),
        "gap_after": F.coalesce(F.col("next_start") - F.col("end_ms"), F.lit(0)),
    })


def _ordinal(rank: int) -> Column:
    return F.col("idx") + F.lit(rank * RANK_STEP)


def _pause_confidence(gap: Column, cfg: TightenConfig) -> Column:
    points = F.floor((gap - cfg.min_gap_ms + 10) / 20).cast("bigint") + 60
    return F.least(F.lit(100), points).cast("int")


def _cut(start: Column, end: Column, reason: str, pct: Column, text: Column, auto: Column,
         ordinal: Column) -> Column:
    return F.struct(
        start.alias("start_ms"), end.alias("end_ms"), F.lit(reason).alias("reason"),
        pct.cast("int").alias("confidence_pct"), text.alias("text"), auto.alias("auto"),
        ordinal.cast("bigint").alias("ord"),
    )


def _gap_cut(cfg: TightenConfig) -> Column:
    left = F.col("gap_before") - 2 * cfg.keep_padding_ms
    found = (F.col("gap_before") >= cfg.min_gap_ms) & (left > fixed.MIN_SILENCE_LEFT_MS)
    return F.when(found, _cut(
        F.col("prev_end") + cfg.keep_padding_ms, F.col("start_ms") - cfg.keep_padding_ms, "silence",
        _pause_confidence(F.col("gap_before"), cfg),
        F.concat(hundredths(F.col("gap_before")), F.lit("s pause")), F.lit(True),
        _ordinal(SILENCE_RANK)))


def _sound_cut(lexicon: Lexicon) -> Column:
    return F.when(F.col("token").isin(list(lexicon.nonlexical)), _cut(
        F.col("start_ms"), F.col("end_ms"), "filler", F.lit(100), F.col("raw"), F.lit(True),
        _ordinal(FILLER_RANK)))


def _repeat_cut(lexicon: Lexicon) -> Column:
    stutter = (
        (F.col("prev_token") != "")
        & (F.col("prev_token") == F.col("token"))
        & ~ends_clause("prev_raw")
        & ~F.contains("prev_raw", F.lit("-"))
        & ~F.contains("raw", F.lit("-"))
        & ~F.col("token").isin(list(lexicon.reduplicated))
        & (F.col("gap_before") <= fixed.REPEAT_MAX_GAP_MS)
    )
    return F.when(stutter, _cut(
        F.col("prev_start"), F.col("prev_end"), "repeat", F.lit(fixed.REPEAT_CONFIDENCE),
        F.col("prev_raw"), F.lit(True), _ordinal(REPEAT_RANK)))


def _cuts_of(context: DataFrame, found: list[Column], *keep: str) -> DataFrame:
    """At most a few cuts per word, taken out of one pass."""
    some = context.filter(F.coalesce(*found).isNotNull())
    one = some.select("take_id", *keep, F.explode(F.array(*found)).alias("cut"))
    return one.filter("cut IS NOT NULL").select("take_id", "cut.*", *keep).select(*CUT, *keep)


def gap_cuts(words: DataFrame, cfg: TightenConfig = TightenConfig()) -> DataFrame:
    """Dead air seen as a gap between two words."""
    return _cuts_of(with_context(words), [_gap_cut(cfg)])


def repeat_cuts(words: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """The earlier of two equal neighbouring words, unless meant as such."""
    return _cuts_of(with_context(words), [_repeat_cut(lexicon)])


def nonlexical_cuts(words: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    shown = words.select("take_id", "idx", "start_ms", "end_ms", display_text().alias("raw"))
    return _cuts_of(shown.withColumn("token", clean_token("raw")), [_sound_cut(lexicon)])


def silence_cuts(silences: DataFrame, cfg: TightenConfig = TightenConfig()) -> DataFrame:
    """Dead air as measured on the sound, with breathing room left at both ends."""
    gap = F.col("end_ms") - F.col("start_ms")
    return silences.filter(gap - 2 * cfg.keep_padding_ms > fixed.MIN_SILENCE_LEFT_MS).select(
        "take_id",
        (F.col("start_ms") + cfg.keep_padding_ms).alias("start_ms"),
        (F.col("end_ms") - cfg.keep_padding_ms).alias("end_ms"),
        F.lit("silence").alias("reason"),
        _pause_confidence(gap, cfg).alias("confidence_pct"),
        F.concat(hundredths(gap), F.lit("s silence")).alias("text"),
        F.lit(True).alias("auto"),
        F.col("start_ms").alias("ord"),
    )


def token_medians(words: DataFrame) -> DataFrame:
    """Typical length of a token in a take that says it at least twice.

    `percentile` counts equal lengths before the shuffle, so a token said a
    billion times still arrives as a few thousand counts.
    """
    spoken = words.select("take_id", clean_token(display_text()).alias("token"),
                          (F.col("end_ms") - F.col("start_ms")).alias("dur"))
    return (
        spoken.groupBy("take_id", "token")
        .agg(F.percentile("dur", 0.5).alias("median_ms"), F.count("*").alias("said"))
        .filter("said >= 2")
    )


def _lexical_words(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    return with_context(words).filter(F.col("token").isin(list(lexicon.lexical))).select(
        "take_id", "idx", "start_ms", "end_ms", F.col("raw").alias("text"), "token",
        "gap_before", "gap_after")


def filler_scores(words: DataFrame, lexicon: Lexicon = Lexicon(),
                  cfg: TightenConfig = TightenConfig()) -> DataFrame:
    """Score 0..100 for every lexical filler: how much it looks like stalling."""
    return score(settle(_lexical_words(words, lexicon), "lexical-words"), cfg)


def score(near: DataFrame, cfg: TightenConfig = TightenConfig()) -> DataFrame:
    """Scores for all lexical words of the takes, given with their gaps."""
    typical = (
        near.groupBy("take_id", "token")
        .agg(F.percentile(F.col("end_ms") - F.col("start_ms"), 0.5).alias("median_ms"),
             F.count("*").alias("said"))
        .filter("said >= 2")
    )

    # Uses of the token within 15 s: windows of five minutes, edges copied over.
    span, reach = 300_000, fixed.FILLER_WINDOW_MS
    home = position_block("start_ms", span)
    at = F.col("start_ms") - home * span
    copies = (F.when(at < reach, F.array(home, home - 1))
              .when(at >= span - reach, F.array(home, home + 1)).otherwise(F.array(home)))
    w = Window.partitionBy("take_id", "token", "bin_").orderBy("start_ms").rangeBetween(-reach, reach)
    counted = (
        near.withColumn("bin_", F.explode(copies))
        .withColumn("nearby", F.count("*").over(w))
        .filter(F.col("bin_") == home)
    )
    counted = join_takes(counted, typical, how="left", on=["take_id", "token"])
    drawn_out = (F.col("median_ms") > 0) & (
        (F.col("end_ms") - F.col("start_ms")) * 10 >= F.col("median_ms") * fixed.DRAWN_OUT_TIMES_TEN)
    points = (
        F.when(F.col("gap_before") >= cfg.min_pause_ms, fixed.PAUSE_BEFORE_POINTS).otherwise(0)
        + F.when(F.col("gap_after") >= cfg.min_pause_ms, fixed.PAUSE_AFTER_POINTS).otherwise(0)
        + F.when(drawn_out, fixed.DRAWN_OUT_POINTS).otherwise(0)
        + F.when(F.col("nearby") >= fixed.FILLER_WINDOW_COUNT, fixed.CRUTCH_POINTS).otherwise(0)
    )
    return counted.select("take_id", "idx", "start_ms", "end_ms", "token", "text",
                          F.least(F.lit(100), points).cast("int").alias("score"))


def classify(scores: DataFrame, cfg: TightenConfig = TightenConfig()) -> DataFrame:
    """Scores to cuts: below the lower threshold nothing, above the upper one automatic."""
    return scores.filter(F.col("score") >= cfg.suggest_pct).select(
        "take_id", "start_ms", "end_ms", F.lit("filler").alias("reason"),
        F.col("score").alias("confidence_pct"), "text",
        (F.col("score") >= cfg.auto_pct).alias("auto"), _ordinal(FILLER_RANK).alias("ord"))


def detect(words: DataFrame, silences: DataFrame | None = None, media: DataFrame | None = None,
           cfg: TightenConfig = TightenConfig(), lexicon: Lexicon = Lexicon()) -> DataFrame:
    """All raw cuts. With `silences`, takes marked measured use those and no word gaps.

    The words are read once. That pass writes the finished cuts and, as
    candidates, all lexical words; a small part of the words, which the scores
    then read as often as they need.
    """
    context = with_context(words)
    in_pass = []
    if cfg.silence and silences is None:
        in_pass.append(_gap_cut(cfg))
    elif cfg.silence:
        context = join_takes(context, media.select("take_id", "measured"), how="left")
        in_pass.append(F.when(~F.coalesce("measured", F.lit(False)), _gap_cut(cfg)))
    if cfg.fillers:
        in_pass.append(_sound_cut(lexicon))
    if cfg.repeats:
        in_pass.append(_repeat_cut(lexicon))
    with_scores = cfg.fillers and cfg.lexical_fillers
    if with_scores:
        in_pass.append(F.when(F.col("token").isin(list(lexicon.lexical)), _cut(
            F.col("start_ms"), F.col("end_ms"), CANDIDATE, F.lit(None), F.col("raw"), F.lit(False),
            F.col("idx"))))

    if not in_pass:
        out = _cuts_of(context.filter(F.lit(False)), [_gap_cut(cfg)])
    elif not with_scores:
        out = _cuts_of(context, in_pass)
    else:
        found = settle(_cuts_of(context, in_pass, "token", "gap_before", "gap_after"), "found")
        lexical = found.filter(F.col("reason") == CANDIDATE).withColumnRenamed("ord", "idx")
        out = found.filter(F.col("reason") != CANDIDATE).select(*CUT).unionByName(
            classify(score(lexical, cfg), cfg))
    if cfg.silence and silences is not None:
        out = out.unionByName(silence_cuts(silences, cfg))
    return out


def merge_cuts(cuts: DataFrame, media: DataFrame | None = None,
               cfg: TightenConfig = TightenConfig()) -> DataFrame:
    """Pad, hold inside the take and merge; automatic and suggested cuts stay apart.

    A merged cut speaks for its most confident member, the earliest of equals.
    `ord` of the result rises with the start, automatic before suggested.
    """
    pad = cfg.edge_padding_ms
    end = F.col("end_ms") + pad
    if media is not None:
        cuts = join_takes(cuts, media.select("take_id", "duration_ms"), how="left")
        end = F.least(end, F.col("duration_ms"))
    padded = cuts.withColumns({
        "a": F.greatest(F.lit(0), F.col("start_ms") - pad), "b": end,
    }).filter("b > a")
    merged = merge_intervals(
        padded, ["take_id", "auto"], "a", "b", ["start_ms", "ord"],
        F.struct("reason", "confidence_pct", "text"),
        F.struct("confidence_pct", -F.col("start_ms"), -F.col("ord")))
    return merged.select(
        "take_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), "payload.reason",
        "payload.confidence_pct", "payload.text", "auto",
        (F.col("a") * 2 + F.when(F.col("auto"), 0).otherwise(1)).alias("ord"))


def summarize(cuts: DataFrame, media: DataFrame) -> DataFrame:
    """One row per take: length before and after, what is removed, how many cuts."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    per_take = cuts.groupBy("take_id").agg(
        F.sum(F.when(F.col("auto"), length).otherwise(0)).alias("removed_ms"),
        F.count_if("auto").alias("auto_cuts"), F.count_if(~F.col("auto")).alias("suggested_cuts"))
    out = media.select("take_id", "duration_ms").join(per_take, "take_id", "left").na.fill(0)
    return out.select(
        "take_id", F.col("duration_ms").alias("original_ms"),
        (F.col("duration_ms") - F.col("removed_ms")).alias("tightened_ms"), "removed_ms",
        # Tenths of a percent, half up, from whole numbers.
        F.when(F.col("duration_ms") > 0, F.floor((F.col("removed_ms") * 2000 + F.col("duration_ms"))
               / (F.col("duration_ms") * 2))).otherwise(0).cast("bigint").alias("removed_permille"),
        "auto_cuts", "suggested_cuts")


def by_reason(cuts: DataFrame) -> DataFrame:
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    return cuts.groupBy("take_id", "reason").agg(
        F.count("*").alias("cuts"), F.sum(length).alias("total_ms"))


def report(cuts: DataFrame, n: int = 40) -> DataFrame:
    """The first `n` cuts of each take by start, and how many follow.

    The rank filter is applied before the shuffle as well, so a take with very
    many cuts sends `n` rows per task.
    """
    w = Window.partitionBy("take_id").orderBy("start_ms", "ord")
    first = cuts.withColumn("line", F.row_number().over(w)).filter(F.col("line") <= n)
    total = cuts.groupBy("take_id").agg(F.count("*").alias("all_cuts"))
    return first.join(total, "take_id").select(
        "take_id", F.col("line").cast("bigint").alias("line"),
        F.when(F.col("auto"), "cut").otherwise("sugg").alias("mark"),
        "start_ms", "end_ms", "reason", "confidence_pct", "text",
        F.greatest(F.lit(0), F.col("all_cuts") - n).alias("more"))
