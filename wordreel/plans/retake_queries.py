"""Queries on phrases, pairs, groups, prompts and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordreel.operators import detect as D, retakes as R
from wordreel.plans import retakes as P, tighten
from wordreel.plans.registry import query
from wordreel.plans.sql import norm, part, sql
from wordreel.session import settle
from wordreel.sources import tables as T

part("punct_bounds", r"""
SELECT *, regexp_matches(text, '[.,!?;:।]\s*$') OR trim(text) = '' AS boundary FROM gaps""")
part("pause_bounds", """
SELECT g.*, EXISTS (SELECT 1 FROM silences s WHERE s.take_id = g.take_id
         AND s.end_ms - s.start_ms >= 450 AND s.start_ms < g.start_ms + g.dur_next
         AND s.end_ms > g.end_ms - 50) AS boundary
FROM (SELECT *, gap_after + (end_ms - start_ms) AS dur_next FROM gaps) g""")
part("mixed_bounds", """
SELECT p.take_id, p.idx, p.start_ms, p.end_ms, p.text,
       CASE WHEN p.take_id % 2 = 0 THEN s.boundary ELSE p.boundary END AS boundary
FROM punct_bounds p JOIN pause_bounds s USING (take_id, idx)""")


def _phrases(bounds: str) -> dict[str, str]:
    return {
        "word_phrases": f"""
SELECT *, coalesce(sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY take_id
         ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
       {norm('text')} AS token FROM {bounds}""",
        "all_phrases": """
SELECT take_id, min(idx) AS i0, max(idx) + 1 AS i1, arg_min(start_ms, idx) AS start_ms,
       arg_max(end_ms, idx) AS end_ms, string_agg(text, ' ' ORDER BY idx) AS text,
       list(token ORDER BY idx) FILTER (token <> '') AS tokens
FROM word_phrases GROUP BY take_id, p HAVING count(*) FILTER (token <> '') > 0""",
    }


for _n, _b in _phrases("punct_bounds").items():
    part(_n, _b)
part("usable", """
SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY i0) - 1 AS j FROM all_phrases
WHERE len(tokens) BETWEEN 6 AND 40""")
part("sets", """
SELECT take_id, j, start_ms, end_ms, greatest(0, end_ms - start_ms) AS dur,
       list_distinct(tokens) AS bag,
       list_distinct(list_transform(range(1, len(tokens)),
                     lambda i: tokens[i] || ' ' || tokens[i + 1])) AS grams FROM usable""")
part("near_pairs", """
SELECT *, max(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY take_id, j ORDER BY earlier DESC)
         AS stopped
FROM (SELECT l.take_id, l.j, e.j AS earlier, l.start_ms - e.end_ms > 45000 AS far,
             l.bag AS bag, e.bag AS ebag, l.grams AS grams, e.grams AS egrams,
             l.dur AS dur, e.dur AS edur
      FROM sets l JOIN sets e ON l.take_id = e.take_id AND e.j BETWEEN l.j - 8 AND l.j - 1)""")
part("pair_counts", """
SELECT take_id, j, earlier, len(list_intersect(bag, ebag)) AS shared,
       len(list_intersect(grams, egrams)) AS shared2, least(len(bag), len(ebag)) AS small,
       least(len(grams), len(egrams)) AS small2, least(dur, edur) AS shorter,
       greatest(dur, edur) AS longer
FROM near_pairs WHERE stopped = 0""")
part("pair_scores", """
SELECT take_id, j, earlier,
       CASE WHEN (longer = 0 OR shorter::DOUBLE / longer >= 0.4::DOUBLE) AND shared >= 3
                 AND shared2 >= 1
            THEN 0.6::DOUBLE * (shared::DOUBLE / small) + 0.4::DOUBLE * (shared2::DOUBLE / small2)
            ELSE 0.0::DOUBLE END AS score FROM pair_counts""")
part("links", """
SELECT take_id, j, earlier, score FROM (
  SELECT *, row_number() OVER (PARTITION BY take_id, j ORDER BY score DESC, earlier) AS rn
  FROM pair_scores WHERE score >= 0.35::DOUBLE) WHERE rn = 1""")
part("chains", """--recursive
SELECT take_id, j, earlier AS root FROM links
UNION ALL
SELECT c.take_id, c.j, l.earlier FROM chains c JOIN links l ON l.take_id = c.take_id AND l.j = c.root""")
part("roots", "SELECT take_id, j, min(root) AS root FROM chains GROUP BY take_id, j")
part("opened", """
SELECT take_id, root, count(*) OVER (PARTITION BY take_id ORDER BY first_j
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp
FROM (SELECT take_id, root, min(j) AS first_j FROM roots GROUP BY take_id, root)""")
part("members", """
SELECT o.take_id, o.grp, r.j FROM opened o JOIN roots r USING (take_id, root)
UNION ALL SELECT take_id, grp, root FROM opened""")
part("attempts", """
SELECT m.take_id, m.grp, m.j, u.i0, u.start_ms, u.end_ms, u.text,
       row_number() OVER (PARTITION BY m.take_id, m.grp ORDER BY m.j) - 1 AS at,
       count(*) OVER (PARTITION BY m.take_id, m.grp) AS size
FROM members m JOIN usable u USING (take_id, j)""")
part("answers", """
SELECT take_id, grp, any_value(size) AS size, (take_id + grp * 3) % 11 <> 10 AS ok,
       (take_id + grp * 3) % 5 IN (0, 1, 3) AS yes,
       (take_id + grp * 3) % any_value(size) AS keep
FROM attempts GROUP BY take_id, grp""")
part("failures", "SELECT take_id, min(grp) AS broke FROM answers WHERE NOT ok GROUP BY take_id")
part("confirmed", """
SELECT a.take_id, a.grp, a.keep FROM answers a LEFT JOIN failures f USING (take_id)
WHERE ok AND yes AND (broke IS NULL OR grp < broke)""")
part("counts", """
SELECT take_id, max(grp) + 1 AS found, least(12, max(grp) + 1) AS asked,
       greatest(0, max(grp) + 1 - 12) AS skipped FROM members GROUP BY take_id""")

PHRASE_SQL = """
SELECT w.take_id, i0, i1, p.start_ms, p.end_ms, len(tokens) AS n, idx, w.text, token
FROM all_phrases p JOIN word_phrases w ON w.take_id = p.take_id AND w.idx >= i0 AND w.idx < i1"""


@query("phrases_punct", sql(PHRASE_SQL))
def phrases_punct(spark, d):
    return R.phrase_words(P.bounded(spark, d))


@query("phrases_measured", sql(PHRASE_SQL, **_phrases("mixed_bounds")))
def phrases_measured(spark, d):
    return R.phrase_words(P.bounded_measured(spark, d))


@query("usable_phrases", sql("SELECT take_id, j, i0, i1, len(tokens) AS n FROM usable"))
def usable_phrases(spark, d):
    return P.usable(spark, d).select("take_id", "j", "i0", "i1",
                                     F.size("tokens").cast("bigint").alias("n"))


@query("phrase_pairs", sql("SELECT take_id, j, earlier, score FROM pair_scores"))
def phrase_pairs(spark, d):
    return R.scored_pairs(P.usable(spark, d))


@query("best_links", sql("SELECT take_id, j, earlier, score FROM links"))
def best_links(spark, d):
    return R.best_links(P.usable(spark, d))


@query("retake_groups", sql("SELECT take_id, grp, j FROM members"))
def retake_groups(spark, d):
    return R.groups(R.best_links(P.usable(spark, d)))


@query("group_counts", sql("SELECT take_id, found, asked, skipped FROM counts"))
def group_counts(spark, d):
    return R.group_counts(R.groups(R.best_links(P.usable(spark, d))))


@query("retake_prompts", sql(f"""
SELECT take_id, grp, "at" + 1 AS line_no, '[' || cast("at" AS VARCHAR) || '] ' ||
       (start_ms + 50) // 1000 || '.' || (start_ms + 50) // 100 % 10 || 's-' ||
       (end_ms + 50) // 1000 || '.' || (end_ms + 50) // 100 % 10 || 's: ' || text AS line
FROM attempts WHERE grp < 12
UNION ALL
SELECT take_id, grp, 0, '{R.PROMPT_HEAD}' FROM attempts WHERE grp < 12 AND "at" = 0
UNION ALL
SELECT take_id, grp, size + 1, '' FROM attempts WHERE grp < 12 AND "at" = 0
UNION ALL
SELECT take_id, grp, size + 2, '{R.PROMPT_TAIL}' FROM attempts WHERE grp < 12 AND "at" = 0"""))
def retake_prompts(spark, d):
    return R.retake_prompts(R.cap_groups(P.grouped(spark, d)[1]))


@query("retake_wave", sql("""
SELECT a.take_id, grp, CASE WHEN ok THEN 1 ELSE 2 END::BIGINT AS attempt
FROM answers a LEFT JOIN (SELECT take_id, min(grp) AS broke FROM answers
                          WHERE grp < 2 AND NOT ok GROUP BY take_id) f USING (take_id)
WHERE CASE WHEN broke IS NOT NULL THEN grp = broke ELSE grp >= 2 AND grp < 2 + 3 END"""))
def retake_wave(spark, d):
    """The second wave, three questions to a take, after a first one of two."""
    members = P.grouped(spark, d)[1]
    digests = settle(R.prompt_digests(R.retake_prompts(members)), "digests")
    first = P.replies_of(members).filter("grp < 2").join(digests, ["take_id", "grp"])
    return R.next_prompts(digests, first.select("digest", "ok"), width=3, tries=2).select(
        "take_id", "grp", "attempt")


@query("retake_verdicts", sql("SELECT take_id, grp, keep, 80::BIGINT AS confidence_pct FROM confirmed"))
def retake_verdicts(spark, d):
    return P.judged(P.grouped(spark, d)[1])[1].select(
        "take_id", "grp", "keep", F.col("confidence_pct").cast("bigint"))


@query("retake_cuts", sql("""
SELECT a.take_id, a.start_ms, a.end_ms, 'retake' AS reason, 80::BIGINT AS confidence_pct,
       a.text[:120] AS text, false AS auto
FROM attempts a JOIN confirmed c USING (take_id, grp) WHERE a.at <> c.keep"""))
def retake_cuts(spark, d):
    members = P.grouped(spark, d)[1]
    return R.retake_cuts(members, P.judged(members)[1]).drop("ord").withColumn(
        "confidence_pct", F.col("confidence_pct").cast("bigint"))


@query("retake_report", sql("""
SELECT a.take_id, a.grp, a.at AS "at", c.keep, 'second is complete' AS reason, a.start_ms, a.end_ms,
       a.text, a.at <> c.keep AS dropped
FROM attempts a JOIN confirmed c USING (take_id, grp)"""))
def retake_report(spark, d):
    members = P.grouped(spark, d)[1]
    return R.retake_report(members, P.judged(members)[1]).drop("confidence_pct")


@query("retake_status", sql("""
SELECT m.take_id,
       CASE WHEN coalesce(found, 0) = 0 THEN 'none-found' WHEN broke IS NOT NULL THEN 'model-error'
            WHEN coalesce(n, 0) = 0 THEN 'none-confirmed' ELSE 'ok' END AS status,
       'no answer for ' || broke AS error,
       coalesce(broke + 1, asked, 0) AS asked,
       coalesce(CASE WHEN broke IS NOT NULL THEN found - broke - 1 ELSE skipped END, 0) AS skipped
FROM media m LEFT JOIN counts USING (take_id) LEFT JOIN failures USING (take_id)
LEFT JOIN (SELECT take_id, count(*) AS n FROM confirmed GROUP BY take_id) USING (take_id)"""))
def retake_status(spark, d):
    members = P.grouped(spark, d)[1]
    replies, verdicts = P.judged(members)
    return R.retake_status(T.media(spark, d), R.group_counts(members), replies, verdicts)


@query("retake_status_no_model", sql("""
SELECT take_id, 'no-model' AS status, NULL::VARCHAR AS error, 0::BIGINT AS asked,
       0::BIGINT AS skipped FROM media"""))
def retake_status_no_model(spark, d):
    takes = T.media(spark, d)
    none = takes.filter("false").select("take_id")
    return R.retake_status(takes, none, none, none, model=False)


part("silence_spans", """
SELECT take_id, start_ms, end_ms FROM cuts WHERE reason = 'silence'""")
part("cut_bounds", """
SELECT g.*, EXISTS (SELECT 1 FROM silence_spans s WHERE s.take_id = g.take_id
         AND s.end_ms - s.start_ms >= 450 AND s.start_ms < g.end_ms + g.gap_after
         AND s.end_ms > g.end_ms - 50) AS boundary FROM gaps g""")


@query("phrases_from_cuts", sql(PHRASE_SQL, **_phrases("cut_bounds")))
def phrases_from_cuts(spark, d):
    words, _, cuts = tighten.tightened(spark, d)
    return R.phrase_words(R.phrase_bounds_measured(words, R.pauses_of_cuts(cuts)))


@query("promoted_cuts", sql("""
SELECT take_id, start_ms, end_ms, reason, cast(confidence_pct AS BIGINT) AS confidence_pct, text,
       auto FROM cuts
UNION ALL
SELECT a.take_id, a.start_ms, a.end_ms, 'retake', 80, a.text[:120], true
FROM attempts a JOIN confirmed c USING (take_id, grp) WHERE a.at <> c.keep"""))
def promoted_cuts(spark, d):
    members = P.grouped(spark, d)[1]
    found = R.retake_cuts(members, P.judged(members)[1])
    out = R.promote(tighten.cuts(spark, d), found)
    return out.select("take_id", "start_ms", "end_ms", "reason",
                      F.col("confidence_pct").cast("bigint"), "text", "auto")


@query("reply_errors", sql("""
SELECT event_id,
  CASE WHEN s IN (401, 403) THEN p || ' rejected the API key (HTTP ' || s || ')'
       WHEN s = 429 THEN p || ' rate limit or quota reached (HTTP 429)'
       WHEN s >= 500 THEN p || ' is having trouble (HTTP ' || s || ')'
       ELSE p || ' returned HTTP ' || s || ': ' ||
            replace(trim(props || chr(10) || repeat(event_type || ' ', 40)), chr(10), ' ')[:160]
  END AS error
FROM (SELECT *, ([200, 401, 403, 429, 500, 503, 404, 400])[event_id % 8 + 1] AS s,
             CASE WHEN user_id % 2 = 0 THEN 'First' ELSE 'Second' END AS p FROM events)
WHERE s <> 200"""))
def reply_errors(spark, d):
    calls = T.table(spark, d, "events").select(
        "event_id", F.expr("element_at(array(200, 401, 403, 429, 500, 503, 404, 400),"
                           " cast(event_id % 8 + 1 as int))").alias("http_status"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'First' ELSE 'Second' END").alias("provider"),
        F.expr("concat(props, '\n', repeat(concat(event_type, ' '), 40))").alias("body"))
    return R.reply_errors(calls).select("event_id", "error")
