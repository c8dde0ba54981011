"""Queries on sources and sinks, romanization and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordreel import fixed
from wordreel.functions.text import clean_token
from wordreel.operators import clips as K, quality as Q, retakes as R, romanize as Z
from wordreel.plans import retakes as RP, tighten as P
from wordreel.plans.registry import query
from wordreel.plans.sql import clean, part, sql
from wordreel.session import settle
from wordreel.sources import logs as G, probe, replies as Y, tables as T, transcripts as S

# Transcripts -----------------------------------------------------------------


def transcript_rows(spark, d):
    """A recognizer's JSON for every conversation turn; every third has no word timings."""
    said = T.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("take_id"), "turn", "text",
        F.expr(T.TOKENS).alias("toks"))
    word = F.transform("toks", lambda w, i: F.struct(
        F.when(i % 7 == 6, F.lit(" ")).otherwise(F.concat(F.lit(" "), w)).alias("word"),
        (i * 0.25).alias("start"), (i * 0.25 + 0.2).alias("end")))
    none = F.array().cast("array<struct<word: string, start: double, end: double>>")
    segment = F.struct(F.lit(0.5).alias("start"), (F.size("toks") * 0.25).alias("end"), "text",
                       F.when(F.col("turn") % 3 == 0, none).otherwise(word).alias("words"))
    return said.select("take_id", F.to_json(F.struct(
        F.lit("en").alias("language"), F.array(segment).alias("segments"))).alias("body"))


part("turns", r"""
SELECT conv_id * 1000 + turn AS take_id, turn, text,
       list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda x: x <> '') AS toks
FROM conversations""")


@query("transcript_words", sql(r"""
SELECT take_id, row_number() OVER (PARTITION BY take_id ORDER BY i) - 1 AS idx,
       i * 250 AS start_ms, i * 250 + 200 AS end_ms, text
FROM (SELECT take_id, unnest(range(len(toks))) AS i, unnest(toks) AS text FROM turns
      WHERE turn % 3 <> 0) WHERE i % 7 <> 6
UNION ALL
SELECT take_id, 0, 500, len(toks) * 250, regexp_replace(text, '^\s+|\s+$', '', 'g')
FROM turns WHERE turn % 3 = 0 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''"""))
def transcript_words(spark, d):
    return S.transcript_words(S.parse_transcripts(transcript_rows(spark, d))).select(
        "take_id", "idx", "start_ms", "end_ms", "text")


@query("blank_words", sql(r"""
SELECT take_id, idx, start_ms, end_ms, text FROM (
  SELECT take_id, i AS idx, i * 250 AS start_ms, i * 250 + 200 AS end_ms,
         CASE WHEN i % 7 = 6 THEN '' ELSE text END AS text
  FROM (SELECT take_id, unnest(range(len(toks))) AS i, unnest(toks) AS text FROM turns
        WHERE turn % 3 <> 0)
  UNION ALL
  SELECT take_id, 0, 500, len(toks) * 250, regexp_replace(text, '^\s+|\s+$', '', 'g')
  FROM turns WHERE turn % 3 = 0 OR len(toks) = 0)"""))
def blank_words(spark, d):
    return S.transcript_words(S.parse_transcripts(transcript_rows(spark, d)), keep_blank=True).select(
        "take_id", "idx", "start_ms", "end_ms", "text")


@query("rejected_transcripts", sql("""
SELECT take_id, 'not a transcript: neither segments nor words' AS error FROM turns
WHERE take_id % 5 IN (0, 1)"""))
def rejected_transcripts(spark, d):
    """Two in five texts are cut off or something else than a transcript."""
    k = F.col("take_id") % 5
    rows = transcript_rows(spark, d).withColumn("body", F.when(
        k == 0, F.expr("substring(body, 1, length(body) - 3)")).when(k == 1, '{"language": "en"}')
        .otherwise(F.col("body")))
    return S.rejected_transcripts(S.parse_transcripts(rows))


@query("clamped_words", sql("""
SELECT take_id, idx, start_ms, least(end_ms, duration_ms - 3000) AS end_ms
FROM words JOIN media USING (take_id)"""))
def clamped_words(spark, d):
    short = T.media(spark, d).withColumn("duration_ms", F.col("duration_ms") - 3000)
    return S.clamp_words(T.words(spark, d), short).select("take_id", "idx", "start_ms", "end_ms")


# Logs, tracks, probes, replies -------------------------------------------------

def log_lines(spark, d):
    """Two log lines per measured pause, and for some takes a last start without an end."""
    s = T.silences(spark, d)
    at = lambda c: (F.col(c) / 1000.0).cast("string")
    starts = s.select("take_id", F.col("start_ms").alias("line_no"), F.concat(
        F.lit("[silencedetect @ 0x1] silence_start: "), at("start_ms")).alias("line"))
    ends = s.select("take_id", F.col("end_ms").alias("line_no"), F.concat(
        F.lit("[silencedetect @ 0x1] silence_end: "), at("end_ms"),
        F.lit(" | silence_duration: "), ((F.col("end_ms") - F.col("start_ms")) / 1000.0)
        .cast("string")).alias("line"))
    tail = T.media(spark, d).filter("take_id % 4 = 0").select(
        "take_id", F.col("duration_ms").alias("line_no"),
        F.concat(F.lit("silence_start: "), at("duration_ms")).alias("line"))
    return starts.unionByName(ends).unionByName(tail)


@query("silences_from_log", sql("SELECT take_id, start_ms, end_ms FROM silences"))
def silences_from_log(spark, d):
    return G.silences_from_log(settle(log_lines(spark, d), "log-lines"))


def track_lines(spark, d):
    """A subtitle track per conversation: number, timing and two text lines per turn."""
    t = T.table(spark, d, "conversations")
    s = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(F.lit("00:"), s(F.floor(F.col("turn") / 60)), F.lit(":"), s(F.col("turn") % 60))
    flat = F.regexp_replace("text", r"[ \n\r\t]+", " ")
    lines = F.array(
        F.when(F.col("turn") == 0, "WEBVTT").otherwise(""), F.col("turn").cast("string"),
        F.concat(clock, F.lit(".250 --> "), clock, F.lit(".900 align:start")),
        F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.concat(F.lit("<c.x>Says: "), flat,
                                                                 F.lit("</c>"))),
        F.lit("and more"))
    return t.select(F.col("conv_id").alias("take_id"), "turn", F.posexplode(lines).alias("at", "line")
                    ).select("take_id", (F.col("turn") * 5 + F.col("at")).alias("line_no"), "line")


@query("cues_from_vtt", sql(r"""
SELECT conv_id AS take_id, turn * 5 + CASE WHEN turn % 5 = 4 THEN 4 ELSE 3 END AS line_no,
       '00:' || lpad(cast(turn // 60 AS VARCHAR), 2, '0') || ':' ||
       lpad(cast(turn % 60 AS VARCHAR), 2, '0') AS t,
       CASE WHEN turn % 5 = 4 THEN 'and more' ELSE regexp_replace(regexp_replace(
           'Says: ' || regexp_replace(text, '[ \n\r\t]+', ' ', 'g'), '<[^>]+>', '', 'g'),
           '^\s+|\s+$', '', 'g') END AS text FROM conversations"""))
def cues_from_vtt(spark, d):
    return G.cues_from_vtt(track_lines(spark, d))


@query("track_choice", sql("""
SELECT 'v' || c_custkey AS video, 'v' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.en.vtt'
   WHEN c_custkey % 3 = 1 THEN '.en-GB.vtt' ELSE '.de.vtt' END AS file FROM customer"""))
def track_choice(spark, d):
    video = F.concat(F.lit("v"), F.col("c_custkey").cast("string"))
    k = F.col("c_custkey") % 3
    ends = (F.when(k == 0, F.array(F.lit(".de.vtt"), F.lit(".en-US.vtt"), F.lit(".en.vtt")))
            .when(k == 1, F.array(F.lit(".de.vtt"), F.lit(".en-GB.vtt"), F.lit(".mp4")))
            .otherwise(F.array(F.lit(".fr.vtt"), F.lit(".de.vtt"))))
    files = T.table(spark, d, "customer").select(video.alias("video"), F.explode(ends).alias("end"))
    return G.pick_tracks(files.select("video", F.concat("video", "end").alias("file")))


def probe_rows(spark, d):
    k = F.col("o_orderkey")
    rate = F.element_at(F.array(*[F.lit(r) for r in (
        "30000/1001", "25/1", "24000/1001", "60000/1001", "0/0")]), (k % 5 + 1).cast("int"))
    video = F.concat(F.lit('{"codec_type": "video", "width": '), (k % 1000 + 2).cast("string"),
                     F.lit(', "height": 720, "r_frame_rate": "'), rate, F.lit('"}'))
    audio = F.concat(F.lit('{"codec_type": "audio", "channels": '), (k % 3).cast("string"),
                     F.lit(', "sample_rate": "48000"}'))
    streams = (F.when(k % 7 == 0, audio).when(k % 4 == 0, video)
               .otherwise(F.concat(audio, F.lit(", "), video)))
    return T.table(spark, d, "orders").select(k.alias("take_id"), F.concat(
        F.lit('{"streams": ['), streams, F.lit('], "format": {"duration": "'),
        (k % 5000).cast("string"), F.lit('.250000"}}')).alias("body"))


@query("media_from_probe", sql("""
SELECT o_orderkey AS take_id, o_orderkey % 5000 * 1000 + 250 AS duration_ms,
       ([29.97, 25.0, 23.976, 59.94])[o_orderkey % 5 + 1]::DOUBLE AS fps,
       o_orderkey % 1000 + 2 AS width, 720::BIGINT AS height, o_orderkey % 4 <> 0 AS has_audio,
       CASE WHEN o_orderkey % 4 <> 0 THEN nullif(o_orderkey % 3, 0) END AS channels,
       CASE WHEN o_orderkey % 4 <> 0 THEN 48000 END AS sample_rate
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 4"""))
def media_from_probe(spark, d):
    return probe.media_from_probe(probe_rows(spark, d))[0].select(
        "take_id", "duration_ms", "fps", *[F.col(c).cast("bigint") for c in ("width", "height")],
        "has_audio", *[F.col(c).cast("bigint") for c in ("channels", "sample_rate")])


@query("rejected_media", sql("""
SELECT o_orderkey AS take_id, CASE WHEN o_orderkey % 7 = 0 THEN 'No video stream found'
       ELSE 'Bad frame rate' END AS error
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 4"""))
def rejected_media(spark, d):
    return probe.media_from_probe(probe_rows(spark, d))[1]


@query("default_media", sql("""
SELECT take_id, arg_max(end_ms, idx) AS duration_ms, 30.0::DOUBLE AS fps FROM words GROUP BY take_id"""))
def default_media(spark, d):
    return probe.default_media(T.words(spark, d)).select("take_id", "duration_ms", "fps")


@query("parsed_replies", sql("""
SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 5) THEN event_id END AS v,
       event_id % 6 IN (0, 1, 2, 4, 5) AS parsed FROM events"""))
def parsed_replies(spark, d):
    k = F.col("event_id")
    plain = F.concat(F.lit('{"v": '), k.cast("string"), F.lit("}"))
    fence = "`" * 3
    body = (F.when(k % 6 == 0, plain)
            .when(k % 6 == 1, F.concat(F.lit(fence + "JSON\n"), plain, F.lit("\n" + fence)))
            .when(k % 6 == 2, F.concat(F.lit("Here: "), plain, F.lit(" as asked")))
            .when(k % 6 == 3, F.lit("no {broken")).when(k % 6 == 4, F.lit("[1, 2]"))
            .otherwise(F.concat(F.lit("  " + fence + "\n"), plain, F.lit(fence))))
    calls = T.table(spark, d, "events").select("event_id", body.alias("body"))
    return Y.parse_replies(calls).select(
        "event_id", F.expr("try_variant_get(answer, '$.v', 'bigint')").alias("v"),
        F.col("answer").isNotNull().alias("parsed"))


@query("clip_rows", sql("""
SELECT doc_id AS user_id, doc_id % 7 AS job_id, 'c.mp4' AS filename,
       doc_id || '/' || doc_id % 7 || '/c.mp4' AS storage_path, text[:500] AS description,
       repeat(source, 60)[:500] AS source_url, round_even(n_chars / 8::DOUBLE, 2) AS start_time,
       round_even(n_chars / 16::DOUBLE, 2) AS end_time,
       CASE WHEN doc_id % 3 > 0 THEN text[:300] END AS hook, nullif(doc_id % 11, 0) AS virality_score,
       nullif(repeat(lang, cast(doc_id % 40 AS INTEGER))[:50], '') AS clip_type FROM documents"""))
def clip_rows(spark, d):
    k = F.col("doc_id")
    rows = T.table(spark, d, "documents").select(
        k.alias("user_id"), (k % 7).alias("job_id"), F.lit("c.mp4").alias("filename"),
        F.col("text").alias("description"), F.repeat("source", F.lit(60)).alias("source_url"),
        (F.col("n_chars") / 8).alias("start_time"), (F.col("n_chars") / 16).alias("end_time"),
        F.when(k % 3 > 0, F.col("text")).otherwise("").alias("hook"),
        (k % 11).alias("virality_score"),
        F.expr("repeat(lang, cast(doc_id % 40 as int))").alias("clip_type"))
    return K.clip_rows(rows)


# Romanization ------------------------------------------------------------------

HINDI = (("क्या", "kya"), ("नहीं", "nahin"), ("डॉक्टर", "doktar"), ("समय", "samay"),
         ("\u092c\u095c\u093e", "bad"))


def mixed_words(spark, d):
    """Words of which some are in Devanagari, in runs of a third of the takes."""
    hindi = (F.col("take_id") % 3 == 0) & (F.floor(F.col("idx") / 80) % 2 == 0) \
        & (F.col("idx") % 50 == 7)
    word = F.element_at(F.array(*[F.lit(w) for w, _ in HINDI]),
                        (F.call_function("div", F.col("idx"), F.lit(50).cast("bigint")) % 5 + 1)
                        .cast("int"))
    return T.tokens(spark, d).select("take_id", "idx", F.when(hindi, word).otherwise(
        F.col("text")).alias("text"))


part("mixed_words", f"""
SELECT take_id, idx, idx // 80 AS chunk, hindi, CASE WHEN hindi THEN
         ({[w for w, _ in HINDI]})[idx // 50 % 5 + 1] ELSE text END AS text,
       CASE WHEN hindi THEN ({[w for _, w in HINDI]})[idx // 50 % 5 + 1] ELSE text END AS latin
FROM (SELECT *, take_id % 3 = 0 AND idx // 80 % 2 = 0 AND idx % 50 = 7 AS hindi FROM spoken)""")


@query("romanize_chunks", sql("""
SELECT take_id, chunk, count(*) AS n, bool_or(hindi) AS devanagari
FROM mixed_words GROUP BY take_id, chunk"""))
def romanize_chunks(spark, d):
    return Z.romanize_chunks(mixed_words(spark, d))


@query("romanize_prompts", sql(f"""
SELECT take_id, chunk, '{Z.PROMPT.replace(chr(10), "' || chr(10) || '")}' ||
       cast(to_json(list(text ORDER BY idx)) AS VARCHAR) AS body
FROM mixed_words GROUP BY take_id, chunk HAVING bool_or(hindi)"""))
def romanize_prompts(spark, d):
    return Z.romanize_prompts(mixed_words(spark, d))


@query("romanized_words", sql("""
SELECT take_id, idx, text, CASE
   WHEN bool_or(hindi) OVER c AND (take_id + chunk) % 2 = 0 THEN 'r' || idx
   ELSE latin END AS hinglish
FROM mixed_words WINDOW c AS (PARTITION BY take_id, chunk)"""))
def romanized_words(spark, d):
    words = mixed_words(spark, d)
    shape = Z.romanize_chunks(words).filter("devanagari")
    # Every other reply is one item short.
    n = F.col("n").cast("int") - F.when((F.col("take_id") + F.col("chunk")) % 2 == 0, 0).otherwise(1)
    listed = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(
        F.lit("r"), (F.col("chunk") * 80 + i).cast("string")))
    body = F.when(n > 0, F.to_json(listed)).otherwise("[]")
    replies = shape.select("take_id", "chunk", body.alias("body"))
    return Z.apply_romanization(words, replies).select("take_id", "idx", "text", "hinglish")


# Every small letter stands for a Devanagari one: consonants, signs, the killer, dotted letters.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPELT = "ािकतीमनगु\u0911सलरदहब\u095bयचशधथ\u0949\u095c्\u0945"
part("spelt", f"""
SELECT take_id, idx, translate(lower(text), '{LETTERS}', '{SPELT}') AS given FROM spoken""")
part("rule_carried", f"""
SELECT *, regexp_replace(regexp_replace(translate(given, '{fixed.ROMAN_DOTTED + fixed.ROMAN_NUQTA}',
         '{fixed.ROMAN_PLAIN}'), '([{fixed.ROMAN_CONSONANTS}])', '\\1a', 'g'),
         'a([{fixed.ROMAN_SIGNS + fixed.ROMAN_KILLER}])', '\\1', 'g') AS x FROM spelt""")
part("rule_letters", f"""
SELECT *, replace(translate(regexp_replace(regexp_replace(regexp_replace(x,
         '([{fixed.ROMAN_ASPIRATES}])', '\\1h', 'g'), '([{fixed.ROMAN_AI}])', '\\1i', 'g'),
         '([{fixed.ROMAN_AU}])', '\\1u', 'g'),
         '{fixed.ROMAN_CONSONANTS + fixed.ROMAN_VOWELS + fixed.ROMAN_SIGNS + fixed.ROMAN_OTHER
           + fixed.ROMAN_KILLER}',
         '{fixed.ROMAN_CONSONANT_BASES + fixed.ROMAN_VOWEL_BASES + fixed.ROMAN_SIGN_BASES
           + fixed.ROMAN_OTHER_BASES.replace("'", "''")}'), 'c', 'ch') AS y FROM rule_carried""")


@query("romanize_rules", sql("""
SELECT take_id, idx, given, CASE WHEN NOT regexp_matches(given, '[\\x{0900}-\\x{097F}]') THEN given
  ELSE CASE z """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.ROMAN_EXCEPTIONS) + """
       ELSE z END END AS latin
FROM (SELECT *, regexp_replace(y, '^(.{2,}[^aeiou])a([.,!?]*)$', '\\1\\2') AS z
      FROM rule_letters)"""))
def romanize_rules(spark, d):
    """Every word, its letters taken as Devanagari ones, back in Latin."""
    given = F.translate(F.lower("text"), LETTERS, SPELT)
    return T.tokens(spark, d).select("take_id", "idx", given.alias("given"),
                                     Z.romanize_rules(given).alias("latin"))


# Quality -----------------------------------------------------------------------

part("truth", f"""
SELECT take_id, idx FROM (SELECT take_id, idx, {clean('text')} AS token FROM spoken)
WHERE token = 'er' OR (token IN ('the', 'der', 'la') AND idx % 5 = 0)""")
part("hits", """
SELECT DISTINCT w.take_id, w.idx FROM words w JOIN cuts c ON c.take_id = w.take_id AND c.auto
  AND c.reason IN ('filler', 'repeat') AND c.start_ms * 2 <= w.start_ms + w.end_ms
  AND w.start_ms + w.end_ms < c.end_ms * 2""")
part("judged", """
SELECT take_id, idx, h.idx IS NOT NULL AS cut, t.idx IS NOT NULL AS filler
FROM hits h FULL JOIN truth t USING (take_id, idx)""")


def judged(spark, d):
    words, media, cuts = P.tightened(spark, d)
    token = clean_token("text")
    truth = words.filter((token == "er") | (token.isin("the", "der", "la") & (F.col("idx") % 5 == 0)))
    return media, settle(Q.judged_words(words, cuts, truth.select("take_id", "idx")), "judged")


@query("filler_eval", sql("""
SELECT take_id, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0 END AS recall
FROM (SELECT m.take_id, count(*) FILTER (cut AND filler) AS tp,
             count(*) FILTER (cut AND NOT filler) AS fp, count(*) FILTER (NOT cut AND filler) AS fn
      FROM media m LEFT JOIN judged USING (take_id) GROUP BY m.take_id)"""))
def filler_eval(spark, d):
    return Q.filler_eval(*judged(spark, d))


@query("damaged_words", sql("""
SELECT take_id, idx, text FROM judged JOIN words USING (take_id, idx) WHERE cut AND NOT filler"""))
def damaged_words(spark, d):
    return Q.damaged(judged(spark, d)[1])


part("true_groups", """
SELECT take_id, j AS true_grp, unnest([j, earlier]) AS j FROM pair_scores WHERE score >= 0.3::DOUBLE""")


@query("group_eval", sql("""
SELECT t.take_id, t.true_grp, count(DISTINCT t.j) AS size,
       coalesce(max(b.best), 0) = count(DISTINCT t.j) AS found, coalesce(max(b.touched), 0) AS touched
FROM (SELECT DISTINCT * FROM true_groups) t LEFT JOIN (
  SELECT take_id, true_grp, max(n) AS best, cast(sum(n) AS BIGINT) AS touched FROM (
    SELECT take_id, true_grp, grp, count(*) AS n
    FROM (SELECT DISTINCT * FROM true_groups) JOIN members USING (take_id, j)
    GROUP BY take_id, true_grp, grp) GROUP BY take_id, true_grp) b USING (take_id, true_grp)
GROUP BY t.take_id, t.true_grp"""))
def group_eval(spark, d):
    phrases = settle(RP.usable(spark, d), "usable")
    pairs = R.scored_pairs(phrases).filter("score >= 0.3")
    truth = pairs.select("take_id", F.col("j").alias("true_grp"),
                         F.explode(F.array("j", "earlier")).alias("j")).distinct()
    return Q.group_eval(R.groups(R.best_links(phrases)), truth)


@query("cost_rate", sql("""
SELECT take_id, coalesce(found, 0) AS found,
       coalesce(found, 0) * 60000::DOUBLE / duration_ms AS per_minute,
       coalesce(found, 0) * 60000 <= duration_ms * 4 AS within
FROM media LEFT JOIN counts USING (take_id)"""))
def cost_rate(spark, d):
    counts = R.group_counts(R.groups(R.best_links(RP.usable(spark, d))))
    return Q.cost_rate(counts, T.media(spark, d))
