"""Queries on words, detectors, merged cuts and the new timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordreel.functions.text import clean_token, display_text, norm_token
from wordreel.operators import detect as D, intervals as I
from wordreel.plans import tighten as P
from wordreel.plans.registry import query
from wordreel.plans.sql import clean, merged, norm, part, sql
from wordreel.session import settle
from wordreel.sources import tables as T

CUT_COLS = ["take_id", "start_ms", "end_ms", "reason", "confidence_pct", "text", "auto"]


def _cuts(df):
    return df.select(*CUT_COLS).withColumn("confidence_pct", F.col("confidence_pct").cast("bigint"))


def _cut_sql(name: str) -> str:
    return sql("SELECT take_id, start_ms, end_ms, reason, cast(confidence_pct AS BIGINT) AS "
               f"confidence_pct, text, auto FROM {name}")


@query("words", sql("SELECT take_id, idx, start_ms, end_ms, text FROM words"))
def words(spark, d):
    return T.words(spark, d).select("take_id", "idx", "start_ms", "end_ms", "text")


@query("words_checksum", sql("""
SELECT count(*) AS n, cast(sum(start_ms) AS BIGINT) AS sum_start,
       cast(sum(end_ms) AS BIGINT) AS sum_end, cast(sum(length(text)) AS BIGINT) AS sum_len
FROM words"""))
def words_checksum(spark, d):
    return T.words(spark, d).agg(
        F.count("*").alias("n"), F.sum("start_ms").alias("sum_start"),
        F.sum("end_ms").alias("sum_end"), F.sum(F.length("text")).alias("sum_len"))


@query("display_text", sql("""
SELECT take_id, idx, coalesce(nullif(hinglish, ''), nullif(said, ''), nullif(devanagari, ''), '')
         AS shown
FROM (SELECT take_id, idx, CASE idx % 3 WHEN 0 THEN concat('h', text) WHEN 1 THEN '' END AS hinglish,
             CASE WHEN idx % 4 < 3 THEN text ELSE '' END AS said,
             CASE WHEN idx % 5 < 4 THEN reverse(text) END AS devanagari FROM spoken)"""))
def shown(spark, d):
    forms = T.tokens(spark, d).select(
        "take_id", "idx",
        F.expr("CASE idx % 3 WHEN 0 THEN concat('h', text) WHEN 1 THEN '' END").alias("hinglish"),
        F.expr("CASE WHEN idx % 4 < 3 THEN text ELSE '' END").alias("text"),
        F.expr("CASE WHEN idx % 5 < 4 THEN reverse(text) END").alias("devanagari"))
    return forms.select("take_id", "idx", display_text().alias("shown"))


@query("token_forms", sql(f"""
SELECT take_id, idx, {clean('text')} AS clean, {norm('text')} AS norm FROM spoken"""))
def token_forms(spark, d):
    return T.tokens(spark, d).select(
        "take_id", "idx", clean_token("text").alias("clean"), norm_token("text").alias("norm"))


@query("word_gaps", sql("SELECT take_id, idx, gap_before, gap_after FROM gaps"))
def word_gaps(spark, d):
    return D.with_gaps(T.words(spark, d)).select("take_id", "idx", "gap_before", "gap_after")


@query("lexicon_use", sql(f"""
SELECT take_id, class, count(*) AS said FROM (
  SELECT take_id, unnest(CASE WHEN token = 'er' THEN ['nonlexical']
      WHEN token IN ('the', 'and', 'of', 'de', 'la', 'der', 'que') THEN ['lexical']
      WHEN token IN ('to', 'le') THEN ['reduplicated'] ELSE [] END) AS class
  FROM (SELECT take_id, {clean('text')} AS token FROM spoken)) GROUP BY take_id, class"""))
def lexicon_use(spark, d):
    said = T.tokens(spark, d).select("take_id", clean_token("text").alias("token"))
    # The lexicon is a fixed list of a few dozen tokens.
    return said.join(F.broadcast(P.LEXICON.table(spark)), "token").groupBy("take_id", "class").agg(
        F.count("*").alias("said"))


@query("media", sql("""
SELECT take_id, duration_ms, fps, has_audio, cast(channels AS BIGINT) AS channels,
       cast(sample_rate AS BIGINT) AS sample_rate, measured, file_name FROM media"""))
def media(spark, d):
    return T.media(spark, d).select(
        "take_id", "duration_ms", "fps", "has_audio", F.col("channels").cast("bigint"),
        F.col("sample_rate").cast("bigint"), "measured", "file_name")


@query("silences", sql("SELECT take_id, start_ms, end_ms FROM silences"))
def silences(spark, d):
    return T.silences(spark, d)


part("measured_cuts", """
SELECT take_id, start_ms + 120 AS start_ms, end_ms - 120 AS end_ms, 'silence' AS reason,
       least(100, 60 + cast(floor((end_ms - start_ms - 400 + 10) / 20) AS BIGINT))
         AS confidence_pct,
       (end_ms - start_ms + 5) // 1000 || '.' ||
       lpad(cast((end_ms - start_ms + 5) // 10 % 100 AS VARCHAR), 2, '0') || 's silence' AS text,
       true AS auto, 0 AS rnk, start_ms AS pos
FROM silences WHERE end_ms - start_ms - 240 > 50""")


@query("silence_cuts", _cut_sql("measured_cuts"))
def silence_cuts(spark, d):
    return _cuts(D.silence_cuts(T.silences(spark, d)))


@query("gap_cuts", _cut_sql("raw_gap"))
def gap_cuts(spark, d):
    return _cuts(D.gap_cuts(T.words(spark, d)))


@query("repeat_cuts", _cut_sql("raw_repeat"))
def repeat_cuts(spark, d):
    return _cuts(D.repeat_cuts(T.words(spark, d), P.LEXICON))


@query("nonlexical_cuts", _cut_sql("raw_sound"))
def nonlexical_cuts(spark, d):
    return _cuts(D.nonlexical_cuts(T.words(spark, d), P.LEXICON))


@query("token_medians", sql("SELECT take_id, token, median_ms, said FROM medians"))
def token_medians(spark, d):
    return D.token_medians(T.words(spark, d))


@query("filler_scores", sql(
    "SELECT take_id, idx, token, cast(score AS BIGINT) AS score FROM scores"))
def filler_scores(spark, d):
    return D.filler_scores(T.words(spark, d), P.LEXICON).select(
        "take_id", "idx", "token", F.col("score").cast("bigint"))


@query("filler_levels", _cut_sql("raw_lexical"))
def filler_levels(spark, d):
    return _cuts(D.classify(D.filler_scores(T.words(spark, d), P.LEXICON)))


part("switched_cuts", """
SELECT * FROM measured_cuts
UNION ALL SELECT * FROM raw_gap WHERE take_id % 2 <> 0
UNION ALL SELECT * FROM raw_sound UNION ALL SELECT * FROM raw_lexical
UNION ALL SELECT * FROM raw_repeat""")


@query("detect_measured", _cut_sql("switched_cuts"))
def detect_measured(spark, d):
    w, m = P.inputs(spark, d)
    return _cuts(D.detect(w, T.pauses(w), m, lexicon=P.LEXICON))


@query("detect_no_fillers", sql("""
SELECT take_id, start_ms, end_ms, reason, cast(confidence_pct AS BIGINT) AS confidence_pct, text,
       auto
FROM (SELECT * FROM long_gaps UNION ALL SELECT * FROM raw_repeat)""", long_gaps="""
SELECT take_id, prev_end + 120 AS start_ms, start_ms - 120 AS end_ms, 'silence' AS reason,
       least(100, 60 + (gap_before - 800 + 10) // 20) AS confidence_pct,
       (gap_before + 5) // 1000 || '.' ||
       lpad(cast((gap_before + 5) // 10 % 100 AS VARCHAR), 2, '0') || 's pause' AS text,
       true AS auto, 0 AS rnk, idx AS pos
FROM gaps WHERE gap_before >= 800"""))
def detect_no_fillers(spark, d):
    cfg = D.TightenConfig(min_gap_ms=D.requested_gap_ms(0.8), fillers=False)
    return _cuts(D.detect(T.words(spark, d), cfg=cfg, lexicon=P.LEXICON))


@query("merged_cuts", _cut_sql("cuts"))
def merged_cuts(spark, d):
    return _cuts(P.cuts(spark, d))


@query("merged_measured_cuts", sql(
    "SELECT take_id, start_ms, end_ms, reason, cast(confidence_pct AS BIGINT) AS confidence_pct, "
    "text, auto FROM cuts", **merged("switched_cuts")))
def merged_measured_cuts(spark, d):
    w, m = P.inputs(spark, d)
    raw = settle(D.detect(w, T.pauses(w), m, lexicon=P.LEXICON), "raw-cuts")
    return _cuts(D.merge_cuts(raw, m))


part("per_take", """
SELECT take_id, sum(CASE WHEN auto THEN end_ms - start_ms ELSE 0 END) AS removed,
       count(*) FILTER (auto) AS auto_cuts, count(*) FILTER (NOT auto) AS suggested_cuts
FROM cuts GROUP BY take_id""")


@query("summary", sql("""
SELECT m.take_id, duration_ms AS original_ms,
       cast(duration_ms - coalesce(removed, 0) AS BIGINT) AS tightened_ms,
       cast(coalesce(removed, 0) AS BIGINT) AS removed_ms,
       cast((coalesce(removed, 0) * 2000 + duration_ms) // (duration_ms * 2) AS BIGINT)
         AS removed_permille,
       coalesce(auto_cuts, 0) AS auto_cuts, coalesce(suggested_cuts, 0) AS suggested_cuts
FROM media m LEFT JOIN per_take USING (take_id)"""))
def summary(spark, d):
    return P.summary(spark, d)


@query("summary_by_reason", sql("""
SELECT take_id, reason, count(*) AS cuts, cast(sum(end_ms - start_ms) AS BIGINT) AS total_ms
FROM cuts GROUP BY take_id, reason"""))
def summary_by_reason(spark, d):
    return D.by_reason(P.cuts(spark, d))


@query("cut_report", sql("""
SELECT take_id, line, CASE WHEN auto THEN 'cut' ELSE 'sugg' END AS mark, start_ms, end_ms, reason,
       cast(confidence_pct AS BIGINT) AS confidence_pct, text, greatest(0, n - 40) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY start_ms, NOT auto) AS line,
             count(*) OVER (PARTITION BY take_id) AS n FROM cuts) WHERE line <= 40"""))
def cut_report(spark, d):
    out = D.report(P.tightened(spark, d)[2])
    return out.withColumn("confidence_pct", F.col("confidence_pct").cast("bigint"))


@query("kept_spans", sql("SELECT take_id, start_ms, end_ms FROM kept"))
def kept_spans(spark, d):
    return P.kept(*P.tightened(spark, d)[1:])


@query("kept_offsets", sql("SELECT take_id, seg, start_ms, end_ms, offset_ms FROM spans"))
def kept_offsets(spark, d):
    return P.spans(*P.tightened(spark, d)[1:]).select(
        "take_id", "seg", "start_ms", "end_ms", "offset_ms")


@query("new_length", sql("""
SELECT take_id, cast(sum(end_ms - start_ms) AS BIGINT) AS new_duration_ms, count(*) AS spans
FROM kept GROUP BY take_id"""))
def new_length(spark, d):
    return I.total_length(P.kept(*P.tightened(spark, d)[1:]))


@query("assigned_words", sql("SELECT take_id, idx, seg FROM assigned"))
def assigned_words(spark, d):
    words, media, merged = P.tightened(spark, d)
    return I.assign_words(words, P.spans(media, merged)).select("take_id", "idx", "seg")


@query("retimed_words", sql("SELECT take_id, idx, start_ms, end_ms, text, seg FROM retimed"))
def retimed_words(spark, d):
    return P.retimed(spark, d).drop("blk")


@query("everything_cut", sql("""
SELECT take_id, 'Nothing to export: every span was cut' AS error FROM media WHERE take_id % 10 = 0"""))
def everything_cut(spark, d):
    """Takes of which nothing is left: in every tenth one cut covers all."""
    _, media, cuts = P.tightened(spark, d)
    whole = media.filter("take_id % 10 = 0").select(
        "take_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    applied = cuts.filter("auto").select("take_id", "start_ms", "end_ms").unionByName(whole)
    return I.everything_cut(I.keep_segments(applied, media), media)


@query("detected_again", sql("""
SELECT take_id, count(*) AS words, max(idx) AS last, cast(sum(gap_before) AS BIGINT) AS gaps
FROM (SELECT take_id, idx, coalesce(start_ms - lag(end_ms) OVER w, 0) AS gap_before
      FROM (SELECT take_id, row_number() OVER (PARTITION BY take_id ORDER BY idx) - 1 AS idx,
                   start_ms, end_ms FROM retimed) WINDOW w AS (PARTITION BY take_id ORDER BY idx))
GROUP BY take_id"""))
def detected_again(spark, d):
    """Gaps between the words that are left, their positions counted anew."""
    again = D.with_gaps(I.renumbered(P.retimed(spark, d)))
    return again.groupBy("take_id").agg(
        F.count("*").alias("words"), F.max("idx").alias("last"),
        F.sum("gap_before").cast("bigint").alias("gaps"))
