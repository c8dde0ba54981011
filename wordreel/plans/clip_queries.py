"""Queries on clip candidates and the job table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordreel import fixed
from wordreel.operators import clips as K, jobs as J
from wordreel.plans.registry import query
from wordreel.plans.sql import part, sql
from wordreel.session import run_folder
from wordreel.sources import replies as Y, tables as T
from wordreel.sources.job_table import JobTable

STYLES = [s for s, _ in fixed.CLIP_STYLES]
CAPTIONS = [p[0] for p in fixed.CLIP_PRESETS]


def _pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


# Videos ------------------------------------------------------------------------

def videos(spark, d):
    k = F.col("page_id")
    return T.table(spark, d, "pages").select(
        k.alias("video_id"), F.col("url").alias("title"), F.lit(None).cast("string").alias("description"),
        F.when(k % 9 == 0, F.array(F.lit("Daily"), F.lit("x"))).alias("tags"),
        F.col("html").alias("transcript"), _pick([*STYLES, "odd"], k % 7).alias("clip_style"),
        F.when(k % 3 > 0, k % 13).alias("clip_count"),
        F.when(k % 4 > 0, k % 130).alias("min_clip_length"),
        F.when(k % 5 > 0, k % 200).alias("max_clip_length"))


_RULES = "\n".join(f"WHEN regexp_matches(seen, '{'|'.join(m)}') THEN '{n}'"
                   for n, m in fixed.CONTENT_TYPES)
part("videos", f"""
SELECT *, CASE {_RULES} ELSE 'general' END AS content_type FROM (
  SELECT page_id AS k, page_id AS video_id, url AS title, html AS transcript,
         ({[*STYLES, 'odd']})[page_id % 7 + 1] AS clip_style,
         nullif(CASE WHEN page_id % 3 > 0 THEN page_id % 13 END, 0) AS wanted,
         nullif(CASE WHEN page_id % 4 > 0 THEN page_id % 130 END, 0) AS lo,
         nullif(CASE WHEN page_id % 5 > 0 THEN page_id % 200 END, 0) AS hi,
         lower(url || '  ' || CASE WHEN page_id % 9 = 0 THEN 'daily x' ELSE '' END || ' ' ||
               html[:500]) AS seen FROM pages)""")
part("limits", """
SELECT *, greatest(1, least(wanted, 10)) AS exact,
       greatest(5, least(coalesce(lo, 20), 120)) AS min_len,
       greatest(greatest(5, least(coalesce(lo, 20), 120)) + 5, least(coalesce(hi, 60), 180)) AS max_len
FROM videos""")


@query("content_type", sql("SELECT video_id, content_type FROM videos"))
def content_type(spark, d):
    return K.content_type(videos(spark, d)).select("video_id", "content_type")


def _quoted(rows):
    return ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in rows)


part("criteria", f"SELECT * FROM (VALUES {_quoted(fixed.CONTENT_CRITERIA)}) t(content_type, criteria)")
part("wishes", f"SELECT * FROM (VALUES {_quoted(fixed.CLIP_STYLES)}) t(clip_style, wish)")


@query("criteria", sql("""
SELECT video_id, criteria, CASE WHEN clip_style <> 'auto' AND wish IS NOT NULL
       THEN 'Wanted above all: ' || upper(clip_style) || '. ' || wish END AS directive
FROM videos JOIN criteria USING (content_type) LEFT JOIN wishes USING (clip_style)"""))
def criteria(spark, d):
    return K.with_criteria(K.content_type(videos(spark, d))).select("video_id", "criteria", "directive")


@query("selection_limits", sql("""
SELECT video_id, min_len, max_len, coalesce(exact, 3) AS count_low, coalesce(exact, 5) AS count_high
FROM (SELECT * REPLACE (CASE WHEN wanted IS NULL THEN NULL ELSE exact END AS exact) FROM limits)"""))
def selection_limits(spark, d):
    return K.selection_limits(videos(spark, d)).select(
        "video_id", *[F.col(c).cast("bigint") for c in ("min_len", "max_len", "count_low", "count_high")])


@query("clip_prompts", sql("""
SELECT video_id, 'Title: ' || title || chr(10) || 'Kind: ' || content_type || chr(10) ||
  'Pick the best ' || CASE WHEN wanted IS NULL THEN '3 to 5' ELSE exact::VARCHAR END ||
  ' moments of ' || min_len || ' to ' || max_len ||
  ' seconds, without overlap, best first.' || chr(10) || 'Look for: ' || criteria ||
  CASE WHEN clip_style <> 'auto' AND wish IS NOT NULL
       THEN chr(10) || 'Wanted above all: ' || upper(clip_style) || '. ' || wish ELSE '' END ||
  chr(10) || 'Transcript:' || chr(10) || transcript || chr(10) ||
  'Answer with a JSON array of {"start_time", "end_time", "description", "hook", "virality_score", "clip_type"}.'
  AS body
FROM limits JOIN criteria USING (content_type) LEFT JOIN wishes USING (clip_style)"""))
def clip_prompts(spark, d):
    known = K.with_criteria(K.content_type(videos(spark, d)))
    return K.clip_prompts(K.selection_limits(known))


# Clips -------------------------------------------------------------------------

def clip_replies(spark, d):
    """A reply with three clips for every line item."""
    q = F.col("l_quantity").cast("bigint")
    clip = lambda start, score: F.concat(
        F.lit('{"start_time": '), start.cast("string"), F.lit(', "end_time": '),
        (start + q).cast("string"), score, F.lit(', "clip_type": "story"}'))
    scored = lambda v: F.concat(F.lit(', "virality_score": '), v.cast("string"))
    body = F.concat(F.lit("```json\n["), clip(F.col("l_linenumber") * 20, scored(q % 10 + 1)),
                    F.lit(", "), clip(F.col("l_partkey") % 50, scored(F.col("l_suppkey") % 10 + 1)),
                    F.lit(", "), clip(F.col("l_suppkey") % 70, F.lit("")), F.lit("]\n```"))
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                body.alias("body"))


@query("ranked_clips", sql("""
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY rid
         ORDER BY score DESC, pos) - 1 AS rank, start_time::DOUBLE AS start_time, score
FROM (SELECT row_number() OVER () AS rid, * FROM lineitem) l, LATERAL (
  SELECT 0 AS pos, l_linenumber * 20 AS start_time, cast(l_quantity AS BIGINT) % 10 + 1 AS score
  UNION ALL SELECT 1, l_partkey % 50, l_suppkey % 10 + 1
  UNION ALL SELECT 2, l_suppkey % 70, 0)"""))
def ranked_clips(spark, d):
    out = K.rank_clips(Y.clip_lists(clip_replies(spark, d)), "l_orderkey", "l_linenumber", "l_partkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "rank", "start_time",
                      F.coalesce("virality_score", F.lit(0)).cast("bigint").alias("score"))


def clips(spark, d):
    start = F.col("l_linenumber") * 20_000 + F.col("l_partkey") % 10 * 1000
    return T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        (F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("clip_id"),
        start.alias("start_ms"), (start + F.col("l_quantity").cast("bigint") * 1000).alias("end_ms"))


def clip_media(spark, d):
    k = F.col("o_orderkey")
    return T.table(spark, d, "orders").select(
        k.alias("video_id"), (30_000 + F.col("o_totalprice").cast("bigint") % 150_000)
        .alias("duration_ms"), (5 + k % 20).alias("min_len"), (30 + k % 15).alias("max_len"),
        (1 + k % 3).alias("count_low"), (2 + k % 4).alias("count_high"))


part("clip_table", """
SELECT l_orderkey AS video_id, l_partkey * 10000 + l_suppkey AS clip_id,
       l_linenumber * 20000 + l_partkey % 10 * 1000 AS start_ms,
       l_linenumber * 20000 + l_partkey % 10 * 1000 + cast(l_quantity AS BIGINT) * 1000 AS end_ms
FROM lineitem""")
part("clip_media", """
SELECT o_orderkey AS video_id, 30000 + cast(floor(o_totalprice) AS BIGINT) % 150000 AS duration_ms,
       5 + o_orderkey % 20 AS min_len, 30 + o_orderkey % 15 AS max_len, 1 + o_orderkey % 3 AS count_low,
       2 + o_orderkey % 4 AS count_high FROM orders""")
part("held_clips", """
SELECT video_id, clip_id, s AS start_ms, greatest(s + 1000, least(end_ms, duration_ms)) AS end_ms
FROM (SELECT *, greatest(0, least(start_ms, duration_ms)) AS s
      FROM clip_table JOIN clip_media USING (video_id))""")


@query("clamped_clips", sql("SELECT video_id, clip_id, start_ms, end_ms FROM held_clips"))
def clamped_clips(spark, d):
    return K.clamp_clips(clips(spark, d), clip_media(spark, d)).select(
        "video_id", "clip_id", "start_ms", "end_ms")


@query("clip_audit", sql("""
SELECT video_id, clip_id, coalesce(start_ms < max(end_ms) OVER (PARTITION BY video_id
         ORDER BY start_ms, end_ms, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
         AS overlaps, start_ms >= 0 AND end_ms <= duration_ms AS inside,
       end_ms - start_ms BETWEEN min_len * 1000 AND max_len * 1000 AS fits
FROM clip_table JOIN clip_media USING (video_id)"""))
def clip_audit(spark, d):
    facts = clip_media(spark, d)
    return K.audit_clips(clips(spark, d), facts, facts)


@query("clip_counts", sql("""
SELECT m.video_id, count(c.video_id) AS clips,
       count(c.video_id) BETWEEN any_value(count_low) AND any_value(count_high) AS count_fits
FROM clip_media m LEFT JOIN clip_table c USING (video_id) GROUP BY m.video_id"""))
def clip_counts(spark, d):
    return K.audit_counts(clips(spark, d), clip_media(spark, d))


@query("keyframe_plan", sql("""
SELECT take_id, frame, (len * frame * 2 + (n + 1) * 100) // ((n + 1) * 200) * 100 AS at_ms
FROM (SELECT take_id, CASE WHEN take_id % 10 = 0 THEN 60000 ELSE duration_ms END AS len,
             CASE WHEN take_id % 3 > 0 THEN 12 ELSE 20 END AS n,
             unnest(range(1, CASE WHEN take_id % 3 > 0 THEN 13 ELSE 21 END)) AS frame FROM media)"""))
def keyframe_plan(spark, d):
    m = T.media(spark, d).select(
        "take_id", F.when(F.col("take_id") % 10 > 0, F.col("duration_ms")).alias("duration_ms"),
        (F.col("take_id") % 3 > 0).alias("has_transcript"))
    return K.keyframe_plan(m)


@query("face_plan", sql("""
SELECT video_id, clip_id, i, start_ms + ((i * 2 + 1) * len) // (n * 2) AS at_ms
FROM (SELECT *, unnest(range(n)) AS i FROM (
  SELECT *, end_ms - start_ms AS len, greatest(1, (end_ms - start_ms) // 2000) AS n FROM clip_table))"""))
def face_plan(spark, d):
    return K.face_plan(clips(spark, d), "video_id", "clip_id")


@query("face_centers", sql("""
SELECT l_orderkey, cx, cy, cast(trunc((greatest(0.25, least(0.75, cx)) - 0.5) * 200) AS BIGINT) AS dx,
       cast(trunc((greatest(0.25, least(0.75, cy)) - 0.5) * 200) AS BIGINT) AS dy
FROM (SELECT l_orderkey, avg((l_partkey % 900 + l_suppkey % 64 / 2::DOUBLE) / 1024::DOUBLE) AS cx,
             avg((l_suppkey % 400 + l_partkey % 64 / 2::DOUBLE) / 512::DOUBLE) AS cy
      FROM lineitem GROUP BY l_orderkey)"""))
def face_centers(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    found = T.table(spark, d, "lineitem").select(
        "l_orderkey", (p % 900).alias("x"), (s % 64).alias("w"), F.lit(1024).alias("frame_w"),
        (s % 400).alias("y"), (p % 64).alias("h"), F.lit(512).alias("frame_h"))
    return K.face_centers(found, "l_orderkey")


# Requests ----------------------------------------------------------------------

def requests(spark, d):
    k = F.col("c_custkey")
    return T.table(spark, d, "customer").select(
        k.alias("request_id"), F.col("c_nationkey").alias("user_id"),
        F.concat(F.lit("https://video.example/"), (k % 4).cast("string")).alias("url"),
        F.when(k % 6 == 0, F.col("c_mktsegment")).alias("instructions"),
        _pick([*STYLES, "odd"], k % 7).alias("clip_style"),
        _pick([*CAPTIONS, "odd"], k % 5).alias("caption_style"),
        F.when(k % 2 > 0, k % 13).alias("clip_count"),
        F.when(k % 11 > 0, k % 140).alias("min_clip_length"),
        F.when(k % 17 > 0, k % 200).alias("max_clip_length"))


part("requests", f"""
SELECT c_custkey AS request_id, c_nationkey AS user_id,
       'https://video.example/' || c_custkey % 4 AS url,
       CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END AS instructions,
       ({[*STYLES, 'odd']})[c_custkey % 7 + 1] AS clip_style,
       ({[*CAPTIONS, 'odd']})[c_custkey % 5 + 1] AS caption_style,
       CASE WHEN c_custkey % 2 > 0 THEN c_custkey % 13 END AS n,
       CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 140 END AS lo,
       CASE WHEN c_custkey % 17 > 0 THEN c_custkey % 200 END AS hi FROM customer""")


@query("validated_requests", sql("""
SELECT request_id, CASE WHEN clip_style = 'odd' THEN 'Invalid clip_style'
  WHEN caption_style = 'odd' THEN 'Invalid caption_style'
  WHEN n NOT BETWEEN 1 AND 10 THEN 'clip_count must be between 1 and 10'
  WHEN lo NOT BETWEEN 5 AND 120 THEN 'min_clip_length must be between 5 and 120 seconds'
  WHEN hi NOT BETWEEN 10 AND 180 THEN 'max_clip_length must be between 10 and 180 seconds'
  WHEN lo > hi THEN 'min_clip_length cannot exceed max_clip_length' END AS error FROM requests"""))
def validated_requests(spark, d):
    return K.validate_requests(requests(spark, d)).select("request_id", "error")


part("asked", """
SELECT * FROM requests
UNION ALL
SELECT * REPLACE (request_id + 10000000 AS request_id) FROM requests WHERE request_id % 3 > 0""")
part("keyed", """
SELECT request_id, user_id, sha256(user_id || '||' || url || '||' || coalesce(instructions, '') || '||'
  || clip_style || '||' || caption_style || '||' || coalesce(nullif(n, 0)::VARCHAR, '') || '||' ||
  coalesce(nullif(lo, 0)::VARCHAR, '') || '||' || coalesce(nullif(hi, 0)::VARCHAR, ''))[:16] AS key
FROM asked""")


@query("request_cache", sql("""
SELECT request_id, key, done IS NOT NULL AS cached,
       coalesce(done, min(request_id) OVER (PARTITION BY key)) AS job
FROM keyed LEFT JOIN (SELECT key, 20000000 + min(request_id) AS done FROM keyed
                      WHERE user_id % 2 = 0 GROUP BY key) USING (key)"""))
def request_cache(spark, d):
    """Requests, two thirds of them asked again, beside the finished jobs of half the users."""
    once = requests(spark, d)
    asked = once.unionByName(once.filter("request_id % 3 > 0").withColumn(
        "request_id", F.col("request_id") + 10_000_000))
    done = asked.filter("user_id % 2 = 0").withColumn("key", K.request_key()).groupBy("key").agg(
        (F.min("request_id") + 20_000_000).alias("job_id"))
    return K.dedupe_requests(asked, done).select("request_id", "key", "cached", "job")


@query("job_outcome", sql("""
SELECT job_id, CASE WHEN made > 0 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN made = 0 THEN 'All ' || n || ' clips failed to render/upload'
            WHEN made < n THEN (n - made) || ' of ' || n || ' clips failed' END AS message
FROM (SELECT l_orderkey AS job_id, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS made
      FROM lineitem GROUP BY l_orderkey)"""))
def job_outcome(spark, d):
    return K.job_outcome(T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_returnflag") != "R").alias("ok")))


@query("retried_clips", sql("""
SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey % 3 = 0 AS ok,
       CASE WHEN NOT (o_orderstatus = 'F' OR o_orderkey % 3 = 0) THEN 'second ' || o_orderstatus END
         AS error FROM orders"""))
def retried_clips(spark, d):
    o = T.table(spark, d, "orders")
    first = o.select("o_orderkey", F.lit(1).alias("attempt"), (F.col("o_orderstatus") == "F")
                     .alias("ok"), F.lit("first").alias("error"))
    again = o.filter("o_orderstatus <> 'F'").select(
        "o_orderkey", F.lit(2).alias("attempt"), (F.col("o_orderkey") % 3 == 0).alias("ok"),
        F.concat(F.lit("second "), "o_orderstatus").alias("error"))
    return K.retry_once(first.unionByName(again), "o_orderkey")


NOW_EVENTS = 1705320000  # 2024-01-15 12:00 UTC, inside the events


@query("clip_library", sql(f"""
SELECT event_id, user_id, left_s AS expires_in_seconds,
       row_number() OVER (PARTITION BY user_id ORDER BY left_s DESC, event_id DESC) AS rank,
       CASE WHEN left_s >= 3600 THEN left_s // 3600 || 'h ' ELSE '' END || left_s % 3600 // 60 || 'm'
         AS expires_in_human
FROM (SELECT *, 21600 + CASE WHEN event_id % 50 = 0 THEN 0
                             ELSE cast(epoch(date_trunc('second', ts)) AS BIGINT) - {NOW_EVENTS} END
             AS left_s FROM events) WHERE left_s > 0"""))
def clip_library(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    made = T.table(spark, d, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 50 == 0, "soon").otherwise(text)
        .alias("created_at"))
    return K.clip_library(made, F.lit(NOW_EVENTS), "event_id").select(
        "event_id", "user_id", "expires_in_seconds", "expires_in_human",
        F.col("rank").cast("bigint").alias("rank"))


_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_LISTED = ", ".join(
    [f"('clip', {_quoted(i)}, {_quoted(text)}, NULL)" for i, text in fixed.CLIP_STYLES]
    + [f"('caption', {_quoted(p[0])}, NULL, {_quoted(p[fixed.CLIP_ANIMATION])})"
       for p in fixed.CLIP_PRESETS])


@query("catalogue", sql(f"""
SELECT kind, id, array_to_string(list_transform(string_split(id, '_'),
                                 lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label,
       description, anim_type, CASE kind WHEN 'clip'
         THEN (SELECT count(*) FROM requests r WHERE r.clip_style = t.id)
         ELSE (SELECT count(*) FROM requests r WHERE r.caption_style = t.id) END AS asked
FROM (VALUES {_LISTED}) t(kind, id, description, anim_type)"""))
def catalogue(spark, d):
    return K.catalogue(spark, requests(spark, d))


# Jobs --------------------------------------------------------------------------

NOW = 896659200  # 1998-06-01, inside the orders


def jobs(spark, d):
    k = F.col("o_orderkey")
    created = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    text = F.concat(F.date_format(F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 5000)"),
                                  "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    user = F.col("o_custkey").cast("string")
    return T.table(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"),
        _pick(["transcribe", "render", "convert"], F.when(k % 13 == 0, 2).otherwise(k % 2))
        .alias("kind"),
        F.when(k % 17 != 0, _pick(fixed.JOB_STATUSES, k % 6)).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.when(k % 3 > 0, F.concat(user, F.lit("/sources/"), k.cast("string"))).alias("source_path"),
        F.when(k % 6 == 4, F.concat(user, F.lit("/outputs/"), k.cast("string"))).alias("output_path"),
        (k % 4 == 0).alias("seen"), F.lit(None).cast("boolean").alias("notified"),
        created.alias("created_s"), F.lit(None).cast("bigint").alias("updated_s"),
        F.when(k % 29 != 0, text).otherwise("soon").alias("updated_at"),
        F.when(k % 5 > 0, created + 48 * 3600).alias("expires_s"), (k % 4).alias("clips"))


part("raw_jobs", f"""
SELECT o_orderkey AS id, o_custkey AS user_id,
       (['transcribe', 'render', 'convert'])[CASE WHEN o_orderkey % 13 = 0 THEN 2
         ELSE o_orderkey % 2 END + 1] AS kind,
       CASE WHEN o_orderkey % 17 <> 0 THEN ({list(fixed.JOB_STATUSES)})[o_orderkey % 6 + 1]
            ELSE 'queued' END AS status,
       CASE WHEN o_orderkey % 3 > 0 THEN o_custkey || '/sources/' || o_orderkey END AS source_path,
       CASE WHEN o_orderkey % 6 = 4 THEN o_custkey || '/outputs/' || o_orderkey END AS output_path,
       o_orderkey % 4 = 0 AS seen, cast(epoch(o_orderdate) AS BIGINT) AS created_s,
       cast(epoch(o_orderdate) AS BIGINT) + 172800 AS expires_s, o_orderkey % 4 AS clips,
       CASE WHEN o_orderkey % 29 <> 0 THEN cast(epoch(o_orderdate) AS BIGINT) + o_orderkey % 5000 END
         AS touched_s FROM orders""")
part("jobs", "SELECT * FROM raw_jobs WHERE kind <> 'convert'")


def good_jobs(spark, d):
    return J.check_jobs(jobs(spark, d))[0]


@query("checked_jobs", sql("""
SELECT id, user_id, kind, status, seen, created_s, created_s AS updated_s, expires_s FROM jobs"""))
def checked_jobs(spark, d):
    return good_jobs(spark, d).select("id", "user_id", "kind", "status", "seen", "created_s",
                                      "updated_s", "expires_s")


@query("rejected_jobs", sql("SELECT id, 'unknown kind' AS problem FROM raw_jobs WHERE kind = 'convert'"))
def rejected_jobs(spark, d):
    return J.check_jobs(jobs(spark, d))[1].select("id", "problem")


@query("recent_jobs", sql("""
SELECT * FROM (SELECT user_id, id, status, row_number() OVER (PARTITION BY user_id
    ORDER BY created_s DESC, id DESC) AS rank FROM jobs) WHERE rank <= 50"""))
def recent_jobs(spark, d):
    return J.recent_jobs(good_jobs(spark, d)).select(
        "user_id", "id", "status", F.col("rank").cast("bigint"))


@query("unseen_jobs", sql("""
SELECT user_id, id, status, created_s, row_number() OVER (PARTITION BY user_id
       ORDER BY created_s DESC, id DESC) AS rank
FROM jobs WHERE NOT seen AND status IN ('completed', 'failed')"""))
def unseen_jobs(spark, d):
    return J.unseen(good_jobs(spark, d)).select(
        "user_id", "id", "status", "created_s", F.col("rank").cast("bigint").alias("rank"))


@query("marked_seen", sql("""
SELECT id, seen OR (id % 10 < 3 AND id % 2 = 0) AS seen FROM jobs"""))
def marked_seen(spark, d):
    own = good_jobs(spark, d)
    # Odd ids are named by a user they do not belong to.
    acks = own.filter("id % 10 < 3").select(
        "id", (F.col("user_id") + F.col("id") % 2).alias("user_id"))
    return J.mark_seen(own, acks).select("id", "seen")


part("aged_jobs", f"""
SELECT *, status IN ('queued', 'transcribing', 'romanizing', 'rendering')
          AND coalesce({NOW} - touched_s > 1800, false) AS stale FROM jobs""")


@query("stale_jobs", sql(f"""
SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status,
       CASE WHEN stale THEN '{fixed.STALE_MESSAGE}' END AS error FROM aged_jobs"""))
def stale_jobs(spark, d):
    return J.mark_stale(good_jobs(spark, d), F.lit(NOW)).select("id", "status", "error")


part("gone_paths", f"""
SELECT id, 0 AS pos, source_path AS path FROM jobs WHERE expires_s < {NOW} AND source_path IS NOT NULL
UNION ALL
SELECT id, 1, output_path FROM jobs WHERE expires_s < {NOW} AND output_path IS NOT NULL""")


@query("expired_paths", sql("SELECT id, path FROM gone_paths"))
def expired_paths(spark, d):
    return J.object_paths_of(J.expired_jobs(good_jobs(spark, d), F.lit(NOW))).select("id", "path")


@query("surviving_jobs", sql(f"SELECT id FROM jobs WHERE expires_s >= {NOW}"))
def surviving_jobs(spark, d):
    return J.surviving_jobs(good_jobs(spark, d), F.lit(NOW)).select("id")


@query("job_table", sql(f"""
SELECT id, seen OR (id % 10 < 3 AND id % 2 = 0) AS seen,
       CASE WHEN stale THEN 'failed' ELSE status END AS status
FROM aged_jobs WHERE expires_s >= {NOW}"""))
def job_table(spark, d):
    """The jobs as files, after acknowledgements, a check for silence and a purge."""
    table = JobTable(spark, run_folder(spark, "jobs"))
    own = good_jobs(spark, d)
    table.create(own, 8)
    table.mark_seen(own.filter("id % 10 < 3").select(
        "id", (F.col("user_id") + F.col("id") % 2).alias("user_id")))
    table.mark_stale(F.lit(NOW))
    table.purge(F.lit(NOW))
    return table.read().select("id", "seen", "status")


@query("deletion_batches", sql("""
SELECT n // 100 AS batch, count(*) AS size, string_agg(path, ',' ORDER BY n) AS paths
FROM (SELECT path, row_number() OVER (ORDER BY id, pos) - 1 AS n FROM gone_paths) GROUP BY n // 100"""))
def deletion_batches(spark, d):
    paths = J.object_paths_of(J.expired_jobs(good_jobs(spark, d), F.lit(NOW)))
    return J.deletion_batches(paths).select(
        "batch", F.size("paths").cast("bigint").alias("size"), F.array_join("paths", ",").alias("paths"))


@query("expired_objects", sql(f"""
SELECT id FROM jobs WHERE {NOW} - CASE WHEN id % 7 = 0 THEN created_s ELSE touched_s END > 21600"""))
def expired_objects(spark, d):
    made = F.concat(F.date_format(F.expr(
        "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, created_s)"),
        "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    listing = good_jobs(spark, d).select(
        "id", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("updated_at")).alias("updated_at"),
        made.alias("created_at"))
    return J.expired_objects(listing, F.lit(NOW)).select("id")


@query("stale_files", sql(f"SELECT id FROM jobs WHERE created_s < {NOW} - 259200"))
def stale_files(spark, d):
    listing = good_jobs(spark, d).withColumn("modified_s", F.col("created_s"))
    return J.stale_files(listing, F.lit(NOW), fixed.WORK_TTL_SECONDS).select("id")


@query("user_stats", sql("""
SELECT user_id, count(*) AS total_jobs, cast(sum(clips) AS BIGINT) AS total_clips,
       count(*) FILTER (status NOT IN ('completed', 'failed')) AS active_jobs
FROM jobs GROUP BY user_id"""))
def user_stats(spark, d):
    return J.user_stats(good_jobs(spark, d))


@query("kept_job_records", sql(f"""
SELECT id FROM jobs WHERE id % 19 = 0 OR created_s >= {NOW} - 7200"""))
def kept_job_records(spark, d):
    records = good_jobs(spark, d).withColumn("created_s", F.when(F.col("id") % 19 > 0, F.col("created_s")))
    return J.purged_jobs(records, F.lit(NOW)).select("id")


@query("account_objects", sql("""
SELECT id, unnest(paths) AS path
FROM (SELECT id, list_filter([source_path, output_path], lambda p: p IS NOT NULL) AS paths FROM jobs
      WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))"""))
def account_objects(spark, d):
    """All that is stored for users who leave: what they sent and what was made of it."""
    leaving = T.table(spark, d, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("user_id"))
    return J.user_objects(J.object_paths_of(good_jobs(spark, d)), leaving).select("id", "path")


@query("owned_uploads", sql("""
SELECT id, id % 2 = 0 AS own FROM jobs WHERE source_path IS NOT NULL"""))
def owned_uploads(spark, d):
    asked = good_jobs(spark, d).filter("source_path IS NOT NULL").select(
        "id", (F.col("user_id") + F.col("id") % 2).alias("user_id"),
        F.col("source_path").alias("storage_path"))
    return asked.select("id", J.owned().alias("own"))


@query("object_layout", sql("""
SELECT id, user_id || '/outputs/' || id || '/' || name AS path,
       CASE id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'video/quicktime' ELSE 'text/plain' END AS mime
FROM (SELECT *, ('my_take_' || id || repeat('x', cast(id % 200 AS INTEGER)))[:100] ||
             (['.mp4', '.mov', '.srt'])[id % 3 + 1] AS name FROM jobs)"""))
def object_layout(spark, d):
    j = good_jobs(spark, d)
    k = F.col("id")
    raw = F.concat(F.substring(F.concat(F.lit("my take "), k.cast("string"), F.expr(
        "repeat('x', cast(id % 200 as int))")), 1, 100), _pick([".mp4", ".mov", ".srt"], k % 3))
    name = J.safe_name(F.concat(F.lit("up/load s/"), raw))
    return j.select("id", J.object_path("outputs", name).alias("path"),
                    J.content_type_of(name).alias("mime"))
