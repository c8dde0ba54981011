"""Queries on styles, cues, events, subtitle documents and edit timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordreel import fixed
from wordreel.functions import timefmt as tf
from wordreel.operators import captions as C, timeline as L
from wordreel.operators.scan import join_takes
from wordreel.plans import tighten as P
from wordreel.plans.registry import query
from wordreel.plans.sql import part, sql
from wordreel.session import run_folder, settle
from wordreel.sources import sinks, tables as T

NAMES = [p[0] for p in fixed.STYLE_PRESETS]


def styles_of(rows):
    """(style_id, style) of the presets, numbered in their order."""
    place = F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.col("preset")) - 1
    # The presets are a fixed list in the code.
    return F.broadcast(rows).select(place.alias("style_id"), F.struct(*rows.columns).alias("style"))


def styled(words):
    """Words that can be shown, each with the number of its take's style."""
    return C.display_words(words).withColumn("style_id", F.col("take_id") % 4)


def cue_rows(spark, d):
    per_line = styles_of(C.presets(spark)).select("style_id", "style.words_per_line")
    shown = join_takes(styled(T.words(spark, d)), per_line, on="style_id")
    return C.cues(shown, F.col("words_per_line"))


def heads_of(spark, d, styles, head):
    """The head of every take's document, also where nothing can be shown."""
    takes = T.media(spark, d).select("take_id", (F.col("take_id") % 4).alias("style_id"))
    return join_takes(takes, styles, on="style_id").select("take_id", head.alias("head"))


def style_requests(spark, d):
    """A request per customer: presets, overrides, unknown names and broken JSON."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(n) for n in [*NAMES, "neon"]]), (k % 5 + 1).cast("int"))
    size = (k % 230).cast("string")
    made = (F.when(k % 7 == 0, F.concat(F.lit('{"font_size": '), size, F.lit("}")))
            .when(k % 7 == 1, F.lit("not json"))
            .when(k % 7 == 2, F.concat(F.lit('{"preset": "'), name, F.lit(
                '", "animation": {"type": "pop", "duration_ms": 20}}')))
            .when(k % 7 == 3, F.concat(F.lit('{"preset": "'), name, F.lit(
                '", "highlight_color": "'), F.col("c_mktsegment"), F.lit('"}')))
            .otherwise(F.concat(F.lit('{"preset": "'), name, F.lit('", "font_size": '), size,
                                F.lit(', "words_per_line": '), (k % 11).cast("string"), F.lit("}"))))
    return T.table(spark, d, "customer").select(k.alias("request_id"), made.alias("style_json"))


part("requested", f"""
SELECT c_custkey AS k, c_custkey AS request_id, c_custkey % 7 AS form, c_mktsegment AS seg,
       CASE WHEN c_custkey % 7 = 0 THEN 'default'
            ELSE ({[*NAMES, 'neon']})[c_custkey % 5 + 1] END AS preset FROM customer""")
part("preset_rows", """
SELECT * FROM (VALUES
 ('default', 'Arial Black', 72, 3, '#FFFF00', '#00000099', 4, 3, 320, 'none', 150),
 ('bold_impact', 'Arial Black', 80, 3, '#FFFF00', '#00000099', 5, 3, 320, 'pop', 150),
 ('subtle', 'Inter', 56, 4, '#88FF88', '#00000044', 2, 1, 300, 'fade', 200),
 ('karaoke', 'Arial Black', 72, 5, '#FF5500', '#00000099', 4, 2, 320, 'karaoke', 150))
 t(preset, font, size0, per0, high0, shadow, outline_w, shadow_w, margin, anim0, ms0)""")
part("resolved", """
SELECT request_id, preset, font, CASE WHEN form IN (0, 4, 5, 6) THEN k % 230 ELSE size0 END AS size,
       CASE WHEN form IN (4, 5, 6) THEN k % 11 ELSE per0 END AS per_line,
       CASE WHEN form = 3 THEN seg ELSE high0 END AS high,
       CASE WHEN form = 2 THEN 'pop' ELSE anim0 END AS anim,
       CASE WHEN form = 2 THEN 20 ELSE ms0 END AS ms
FROM requested JOIN preset_rows USING (preset) WHERE form <> 1""")


@query("resolved_styles", sql("""
SELECT request_id, preset, font, cast(size AS BIGINT) AS font_size,
       cast(per_line AS BIGINT) AS words_per_line, high AS highlight_color, anim,
       cast(ms AS BIGINT) AS duration_ms FROM resolved"""))
def resolved_styles(spark, d):
    ok, _ = C.resolve_styles(style_requests(spark, d), C.presets(spark))
    return ok.select("request_id", "preset", "font", F.col("font_size").cast("bigint"),
                     F.col("words_per_line").cast("bigint"), "highlight_color",
                     F.col("animation.type").alias("anim"),
                     F.col("animation.duration_ms").cast("bigint").alias("duration_ms"))


@query("rejected_styles", sql("""
SELECT request_id, CASE WHEN form = 1 THEN 'style is not a JSON object'
                        ELSE 'unknown preset neon' END AS error
FROM requested WHERE form = 1 OR preset = 'neon'"""))
def rejected_styles(spark, d):
    return C.resolve_styles(style_requests(spark, d), C.presets(spark))[1]


@query("style_problems", sql("""
SELECT request_id, concat_ws(',',
    CASE WHEN size NOT BETWEEN 24 AND 200 THEN 'font_size' END,
    CASE WHEN per_line NOT BETWEEN 1 AND 8 THEN 'words_per_line' END,
    CASE WHEN ms NOT BETWEEN 50 AND 1000 THEN 'animation.duration_ms' END,
    CASE WHEN high NOT LIKE '#%' THEN 'highlight_color' END) AS problems FROM resolved"""))
def style_problems(spark, d):
    ok, _ = C.resolve_styles(style_requests(spark, d), C.presets(spark))
    return C.validate_styles(ok).select("request_id", F.array_join("problems", ",").alias("problems"))


@query("subtitle_colors", sql("""
SELECT o_orderkey, '&H' || CASE WHEN o_orderkey % 2 = 0 THEN
           lpad(upper(to_hex(255 - o_orderkey % 256)), 2, '0') ELSE '00' END
       || upper(hx[5:6] || hx[3:4] || hx[1:2]) AS color
FROM (SELECT o_orderkey, substr(sha256(cast(o_orderkey AS VARCHAR)), 1, 6) AS hx FROM orders)"""))
def subtitle_colors(spark, d):
    key = F.col("o_orderkey")
    hx = F.concat(F.lit("#"), F.substring(F.sha2(key.cast("string"), 256), 1, 6))
    alpha = F.when(key % 2 == 0, F.lpad(F.lower(F.hex(key % 256)), 2, "0")).otherwise("")
    return T.table(spark, d, "orders").select(
        "o_orderkey", C.subtitle_color(F.concat(hx, alpha)).alias("color"))


@query("display_words", sql("""
SELECT take_id, row_number() OVER (PARTITION BY take_id ORDER BY idx) - 1 AS rn, start_ms, end_ms,
       shown
FROM (SELECT *, coalesce(nullif(CASE idx % 3 WHEN 0 THEN lower(text) WHEN 1 THEN '' ELSE ' ' END,
                                ''), text) AS shown FROM words) WHERE trim(shown) <> ''"""))
def display_words(spark, d):
    w = T.words(spark, d).withColumn(
        "hinglish", F.expr("CASE idx % 3 WHEN 0 THEN lower(text) WHEN 1 THEN '' ELSE ' ' END"))
    return C.display_words(w, "hinglish").drop("blk")


part("styled_words", """
SELECT w.*, idx AS rn, p.*, idx // per0 AS cue, idx % per0 AS pos
FROM words w JOIN preset_rows p
  ON p.preset = (['default', 'bold_impact', 'subtle', 'karaoke'])[take_id % 4 + 1]""")
part("cue_rows", """
SELECT take_id, cue, min(start_ms) AS start_ms, arg_max(end_ms, idx) AS end_ms,
       string_agg(text, ' ' ORDER BY idx) AS text FROM styled_words GROUP BY take_id, cue""")


def srt(ms: str) -> str:
    return (f"lpad(cast({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(cast({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(cast({ms} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || "
            f"lpad(cast({ms} % 1000 AS VARCHAR), 3, '0')")


def ass(ms: str) -> str:
    cs = f"(({ms} % 60000 + 5) // 10)"
    return (f"cast({ms} // 3600000 AS VARCHAR) || ':' || "
            f"lpad(cast({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(cast({cs} // 100 AS VARCHAR), 2, '0') || '.' || "
            f"lpad(cast({cs} % 100 AS VARCHAR), 2, '0')")


@query("cues", sql("SELECT take_id, cue, start_ms, end_ms, text FROM cue_rows"))
def cues(spark, d):
    return cue_rows(spark, d)


def _srt_sql(rows: str) -> str:
    return f"""
SELECT take_id, cue AS line_no, unnest(range(len(ls))) AS sub, unnest(ls) AS line
FROM (SELECT take_id, cue, CASE WHEN cue > 0 THEN [''] ELSE [] END || [cast(cue + 1 AS VARCHAR),
        {srt('start_ms')} || ' --> ' || {srt('end_ms')}] || string_split(text, chr(10)) AS ls
      FROM {rows})"""


def files_of(spark, write, suffix):
    """(take_id, bytes, md5) of the files that `write` leaves, one for each take."""
    folder = run_folder(spark, "files")
    write(folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select(
        F.regexp_extract("path", r"([^/]+)\.\w+$", 1).cast("bigint").alias("take_id"),
        F.length("content").cast("bigint").alias("bytes"), F.md5("content").alias("md5"))


def files_sql(lines, end="chr(10)"):
    """The same from SQL for the lines."""
    return f"""SELECT take_id, octet_length(encode(body)) AS bytes, md5(body) AS md5 FROM (
  SELECT take_id, string_agg(line || {end}, '' ORDER BY line_no, sub) AS body
  FROM ({lines}) GROUP BY take_id)"""


@query("srt_documents", sql(_srt_sql("cue_rows")))
def srt_documents(spark, d):
    return C.srt_lines(cue_rows(spark, d))


@query("srt_files", sql(files_sql(_srt_sql("cue_rows"))))
def srt_files(spark, d):
    return files_of(spark, lambda to: sinks.srt_files(cue_rows(spark, d), to), ".srt")


@query("tightened_srt", sql(_srt_sql("""
(SELECT take_id, rn // 3 AS cue, arg_min(start_ms, rn) AS start_ms,
        arg_max(end_ms, rn) AS end_ms, string_agg(text, ' ' ORDER BY rn) AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY take_id ORDER BY idx) - 1 AS rn
       FROM retimed) GROUP BY take_id, rn // 3)""")))
def tightened_srt(spark, d):
    return C.srt_lines(C.cues(C.display_words(P.retimed(spark, d)), 3))


part("event_times", """
SELECT take_id, n, start_ms, CASE WHEN until <= start_ms THEN start_ms + 100 ELSE until END AS end_ms
FROM (SELECT take_id, rn AS n, start_ms, coalesce(lead(start_ms) OVER c, end_ms) AS until
      FROM styled_words WHERE anim0 <> 'karaoke'
      WINDOW c AS (PARTITION BY take_id, cue ORDER BY idx))
UNION ALL
SELECT take_id, min(rn), min(start_ms), arg_max(end_ms, idx)
FROM styled_words WHERE anim0 = 'karaoke' GROUP BY take_id, cue""")
WHITE = r"'{\c&H00FFFFFF\alpha&H00\fscx100\fscy100}'"
part("cue_texts", """
SELECT take_id, cue, any_value(anim0) AS anim,
       list(CASE WHEN anim0 = 'fade' THEN shown ELSE replace(upper(shown), 'ẞ', 'SS') END
            ORDER BY idx) AS ts,
       list(greatest((end_ms - start_ms) // 10, 10) ORDER BY idx) AS cs
FROM (SELECT *, replace(replace(text, '{', ''), '}', '') AS shown FROM styled_words)
GROUP BY take_id, cue""")


def _bodies(pop: str, fade: str, none: str) -> str:
    return rf"""
SELECT w.take_id, w.rn AS n, list_aggregate(list_transform(t.ts, lambda x, i:
    CASE WHEN i <= w.pos THEN {WHITE} || x
         WHEN i = w.pos + 1 THEN CASE anim WHEN 'pop' THEN '{pop}' WHEN 'fade' THEN '{fade}'
              ELSE '{none}' END || x || {WHITE}
         ELSE '{{\c&H00FFFFFF\alpha&HAA\fscx100\fscy100}}' || x END), 'string_agg', ' ') || {WHITE}
       AS body
FROM styled_words w JOIN cue_texts t USING (take_id, cue) WHERE anim0 <> 'karaoke'
UNION ALL
SELECT w.take_id, w.rn, list_aggregate(list_transform(t.ts, lambda x, i:
       '{{\kf' || cast(t.cs[i] AS VARCHAR) || '}}' || x), 'string_agg', ' ')
FROM styled_words w JOIN cue_texts t USING (take_id, cue) WHERE anim0 = 'karaoke' AND w.pos = 0"""


EVENT_SQL = """SELECT e.take_id, e.n, e.start_ms, e.end_ms, b.body
FROM event_times e JOIN event_bodies b USING (take_id, n)"""


@query("word_events", sql(EVENT_SQL, event_bodies=_bodies(
    r"{\c&H0000FFFF\alpha&H00\fscx50\fscy50\t(0,90,\fscx115\fscy115)\t(90,150,\fscx100\fscy100)}",
    r"{\c&H0088FF88\alpha&HFF\t(0,200,\alpha&H00)}",
    r"{\c&H0000FFFF\alpha&H00\fscx112\fscy112}")))
def word_events(spark, d):
    styles = styles_of(C.presets(spark))
    return C.word_events(styled(T.words(spark, d)), styles, C.style_markup())


CLIP_EVENTS = dict(
    cue_texts="""
SELECT take_id, cue, any_value(anim0) AS anim,
       list(replace(upper(shown), 'ẞ', 'SS') ORDER BY idx) AS ts,
       list(greatest((end_ms - start_ms) // 10, 10) ORDER BY idx) AS cs
FROM (SELECT *, replace(replace(text, '{', ''), '}', '') AS shown FROM styled_words)
GROUP BY take_id, cue""",
    event_bodies=_bodies(
        r"{\c&H0000FFFF\alpha&H00\fscx50\fscy50\t(0,150,\fscx115\fscy115)"
        r"\t(150,250,\fscx100\fscy100)}",
        r"{\c&H0088FF88\alpha&HFF\t(0,200,\alpha&H00)}",
        r"{\c&H0000FFFF\alpha&H00\fscx115\fscy115}"))


@query("clip_word_events", sql(EVENT_SQL, **CLIP_EVENTS))
def clip_word_events(spark, d):
    styles = styles_of(C.clip_presets(spark))
    return C.word_events(styled(T.words(spark, d)), styles, C.clip_markup())


@query("karaoke_cues", sql("""
SELECT take_id, n, start_ms, end_ms FROM event_times WHERE take_id % 4 = 3"""))
def karaoke_cues(spark, d):
    styles = styles_of(C.presets(spark)).filter(F.col("style.animation.type") == "karaoke")
    return C.word_events(styled(T.words(spark, d)), styles, C.style_markup()).drop("body")


ASS_SQL = f"""
SELECT take_id, 0::BIGINT AS line_no, unnest(range(len(ls))) AS sub, unnest(ls) AS line
FROM (SELECT m.take_id, string_split(regexp_replace(h.head, chr(10) || '$', ''), chr(10)) AS ls
      FROM media m JOIN heads h ON h.k = m.take_id % 4)
UNION ALL
SELECT e.take_id, e.n + 1, 0, 'Dialogue: 0,' || {ass('e.start_ms')} || ',' || {ass('e.end_ms')} ||
       ',Caption,,0,0,0,,' || b.body
FROM event_times e JOIN event_bodies b USING (take_id, n)"""


def _ass_sql(heads: str, **local) -> str:
    return sql(ASS_SQL, heads=heads, **local)


def _heads(rows) -> str:
    """Header texts per preset, from (font, size, big, text, high, shadow, outline_w, shadow_w, margin)."""
    def line(name, size, color, r):
        return (f"Style: {name},{r[0]},{size},{color},&H000000FF,&H00000000,{r[5]},"
                f"-1,0,0,0,100,100,2,0,1,{r[6]},{r[7]},2,40,40,{r[8]},1\n")

    texts = []
    for k, r in enumerate(rows):
        text = ("[Script Info]\nScriptType: v4.00+\nPlayResX: 1080\nPlayResY: 1920\nWrapStyle: 1\n\n"
                + C.STYLE_HEAD + line("Caption", r[1], r[3], r) + line("Highlight", r[2], r[4], r)
                + C.EVENT_HEAD)
        texts.append(f"({k}, '" + text.replace("\n", "' || chr(10) || '") + "')")
    return "SELECT * FROM (VALUES " + ", ".join(texts) + ") t(k, head)"


W = "&H00FFFFFF"
STYLE_BODIES = _bodies(
    r"{\c&H0000FFFF\alpha&H00\fscx50\fscy50\t(0,90,\fscx115\fscy115)\t(90,150,\fscx100\fscy100)}",
    r"{\c&H0088FF88\alpha&HFF\t(0,200,\alpha&H00)}",
    r"{\c&H0000FFFF\alpha&H00\fscx112\fscy112}")


STYLE_HEADS = _heads([
    ("Arial Black", 72, 80, W, "&H0000FFFF", "&H66000000", 4, 3, 320),
    ("Arial Black", 80, 89, W, "&H0000FFFF", "&H66000000", 5, 3, 320),
    ("Inter", 56, 62, W, "&H0088FF88", "&HBB000000", 2, 1, 300),
    ("Arial Black", 72, 80, W, "&H000055FF", "&H66000000", 4, 2, 320)])


@query("ass_documents", _ass_sql(STYLE_HEADS, event_bodies=STYLE_BODIES))
def ass_documents(spark, d):
    styles = styles_of(C.presets(spark))
    events = C.word_events(styled(T.words(spark, d)), styles, C.style_markup())
    return C.ass_lines(events, heads_of(spark, d, styles, C.style_header(F.lit(1080), F.lit(1920))))


@query("ass_files", sql(files_sql(ASS_SQL), heads=STYLE_HEADS, event_bodies=STYLE_BODIES))
def ass_files(spark, d):
    styles = styles_of(C.presets(spark))
    events = C.word_events(styled(T.words(spark, d)), styles, C.style_markup())
    heads = heads_of(spark, d, styles, C.style_header(F.lit(1080), F.lit(1920)))
    return files_of(spark, lambda to: sinks.ass_files(events, heads, to), ".ass")


@query("clip_ass_documents", _ass_sql(_heads([
    ("Arial Black", 72, 80, W, "&H0000FFFF", "&H66000000", 4, 3, 320),
    ("Arial Black", 80, 89, W, "&H0000FFFF", "&H66000000", 5, 3, 320),
    ("Inter", 56, 62, W, "&H0088FF88", "&H44000000", 2, 1, 300),
    ("Arial Black", 72, 80, W, "&H000055FF", "&H66000000", 4, 2, 320)]), **CLIP_EVENTS))
def clip_ass_documents(spark, d):
    styles = styles_of(C.clip_presets(spark))
    events = C.word_events(styled(T.words(spark, d)), styles, C.clip_markup())
    return C.ass_lines(events, heads_of(spark, d, styles, C.clip_header()))


# Timelines -------------------------------------------------------------------

part("rates", """
SELECT *, cast(round_even(fps, 0) AS BIGINT) AS base,
       abs(fps - round_even(fps, 0) * 1000::DOUBLE / 1001::DOUBLE) < 0.01::DOUBLE AS ntsc FROM media""")
part("media_rates", """
SELECT *, ntsc AND base IN (30, 60) AS dropped,
       CASE WHEN ntsc THEN base * 1000::DOUBLE / 1001::DOUBLE ELSE base::DOUBLE END AS rate
FROM rates""")
part("framed", """
SELECT k.*, rate, base, dropped, ntsc, file_name,
       cast(round_even(start_ms / 1000::DOUBLE * rate, 0) AS BIGINT) AS src_in,
       cast(round_even(end_ms / 1000::DOUBLE * rate, 0) AS BIGINT) AS src_out
FROM kept k JOIN media_rates USING (take_id)""")
part("edit_events", """
SELECT *, row_number() OVER w - 1 AS n,
       cast(sum(src_out - src_in) OVER w - (src_out - src_in) AS BIGINT) AS rec_in,
       cast(sum(src_out - src_in) OVER w AS BIGINT) AS rec_out
FROM framed WHERE src_out > src_in WINDOW w AS (PARTITION BY take_id ORDER BY start_ms)""")


def timecode(frame: str) -> str:
    skip = "CASE WHEN base = 30 THEN 2 ELSE 4 END"
    label = (f"(CASE WHEN dropped THEN {frame} + ({skip}) * (9 * ({frame} // (base * 600 - ({skip}) * 9))"
             f" + greatest(0, ({frame} % (base * 600 - ({skip}) * 9) - ({skip})) // (base * 60 - ({skip}))))"
             f" ELSE {frame} END)")
    two = lambda x: f"lpad(cast({x} AS VARCHAR), 2, '0')"
    return (f"{two(f'{label} // (base * 3600)')} || ':' || {two(f'{label} // (base * 60) % 60')}"
            f" || ':' || {two(f'{label} // base % 60')} || CASE WHEN dropped THEN ';' ELSE ':' END"
            f" || {two(f'{label} % base')}")


def events_of(spark, d):
    _, media, cuts = P.tightened(spark, d)
    kept = settle(P.kept(media, cuts), "kept")
    return media, cuts, settle(L.edit_events(kept, media), "events")


@query("timebase", sql("""
SELECT take_id, base, dropped AS drop_frame, rate FROM media_rates"""))
def timebase(spark, d):
    return L.with_rate(T.media(spark, d)).select("take_id", "base", "drop_frame", "rate")


@query("edit_events", sql(
    "SELECT take_id, n, src_in, src_out, rec_in, rec_out FROM edit_events"))
def edit_events(spark, d):
    return events_of(spark, d)[2].drop("fps")


@query("timecodes", sql(f"""
SELECT e.take_id, e.n, {timecode('src_in')} AS src_in, {timecode('rec_out')} AS rec_out
FROM edit_events e"""))
def timecodes(spark, d):
    fps = F.col("fps")
    return events_of(spark, d)[2].select(
        "take_id", "n", tf.timecode(F.col("src_in"), fps).alias("src_in"),
        tf.timecode(F.col("rec_out"), fps).alias("rec_out"))


@query("rational_times", sql("""
SELECT take_id, n, CASE WHEN src_in = 0 THEN '0s' WHEN ntsc
         THEN src_in * 1001 || '/' || base * 1000 || 's' ELSE src_in || '/' || base || 's' END AS start,
       CASE WHEN ntsc THEN 1001 || '/' || base * 1000 || 's' ELSE 1 || '/' || base || 's' END AS frame
FROM edit_events"""))
def rational_times(spark, d):
    fps = F.col("fps")
    return events_of(spark, d)[2].select(
        "take_id", "n", tf.rational(F.col("src_in"), fps).alias("start"),
        tf.frame_duration(fps).alias("frame"))


EDL_SQL = f"""
SELECT take_id, n AS line_no, unnest(range(len(ls))) AS sub, unnest(ls) AS line FROM (
  SELECT take_id, n, CASE WHEN n = 0 THEN ['TITLE: TIGHTENED', 'FCM: ' ||
           CASE WHEN dropped THEN 'DROP FRAME' ELSE 'NON-DROP FRAME' END, ''] ELSE [''] END || [
         lpad(cast(n + 1 AS VARCHAR), cast(greatest(3, length(cast(n + 1 AS VARCHAR))) AS INTEGER), '0')
         || '  ' || rpad(upper(regexp_replace('take' || take_id || 'mp4', '[^a-z0-9]', '', 'g'))[:8],
                         8, ' ')
         || ' AA/V  C        ' || {timecode('src_in')} || ' ' || {timecode('src_out')} || ' ' ||
         {timecode('rec_in')} || ' ' || {timecode('rec_out')},
         '* FROM CLIP NAME: take & ' || take_id || '.mp4'] AS ls
  FROM edit_events)"""


@query("edl_documents", sql(EDL_SQL))
def edl_documents(spark, d):
    media, _, events = events_of(spark, d)
    return L.edl_lines(events, media)


@query("edl_files", sql(files_sql(EDL_SQL, "chr(13) || chr(10)")))
def edl_files(spark, d):
    media, _, events = events_of(spark, d)
    return files_of(spark, lambda to: sinks.edl_files(events, media, to), ".edl")


part("hints", """--materialized
SELECT take_id, cast(round_even(start_ms / 1000::DOUBLE * rate, 0) AS BIGINT) AS frame,
       coalesce(nullif(text, ''), reason) AS label, start_ms * 2 + 1 AS ord
FROM cuts JOIN media_rates USING (take_id) WHERE NOT auto""")
part("events_once", """--materialized
SELECT take_id, n, src_in, src_out FROM edit_events""")
part("markers", """
SELECT e.take_id, e.n, c.frame, c.label, c.ord
FROM hints c JOIN events_once e ON e.take_id = c.take_id AND e.src_in <= c.frame
     AND c.frame < e.src_out""")


@query("placed_markers", sql("SELECT take_id, n, frame, label, ord FROM markers"))
def placed_markers(spark, d):
    _, cuts, events = events_of(spark, d)
    return L.place_markers(events, cuts).drop("fps")


def rational(frame: str) -> str:
    return (f"CASE WHEN {frame} = 0 THEN '0s' WHEN ntsc THEN {frame} * 1001 || '/' || base * 1000 "
            f"|| 's' ELSE {frame} || '/' || base || 's' END")


def escaped(x: str) -> str:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{raw}', '{code}')"
    return x


ONE_FRAME = "CASE WHEN ntsc THEN 1001 || '/' || base * 1000 || 's' ELSE 1 || '/' || base || 's' END"
part("shown_events", """--materialized
SELECT take_id, n, src_in, src_out, rec_in, rec_out, ntsc, base, dropped FROM edit_events""")
part("placed_once", """--materialized
SELECT take_id, n, frame, label, ord FROM markers""")
part("whole_takes", """
SELECT m.*, t.total, t.last, cast(round_even(duration_ms / 1000::DOUBLE * rate, 0) AS BIGINT) AS frames
FROM media_rates m JOIN (SELECT take_id, max(rec_out) AS total, max(n) AS last FROM shown_events
                         GROUP BY take_id) t USING (take_id)""")
FCPXML_SQL = f"""
SELECT take_id, 0::BIGINT AS line_no, unnest(range(len(ls))) AS sub, unnest(ls) AS line FROM (
  SELECT take_id, ['<?xml version="1.0" encoding="UTF-8"?>', '<!DOCTYPE fcpxml>',
    '<fcpxml version="1.10">', '  <resources>',
    '    <format id="r1" name="TakeFormat" frameDuration="' || {ONE_FRAME} ||
      '" width="1080" height="1920"/>',
    '    <asset id="r2" name="take &amp; ' || take_id || '.mp4" start="0s" duration="' ||
      {rational('frames')} || '" format="r1" hasVideo="1" hasAudio="' ||
      CASE WHEN has_audio THEN '1' ELSE '0' END || '"' || CASE WHEN has_audio AND channels > 0
      THEN ' audioSources="1" audioChannels="' || channels || '"' ELSE '' END || '>',
    '      <media-rep kind="original-media" src="file:///media/take%20%26%20' || take_id || '.mp4"/>',
    '    </asset>', '  </resources>', '  <library>', '    <event name="Takes">',
    '      <project name="take &amp; ' || take_id || '">',
    '        <sequence format="r1" duration="' || {rational('total')} || '" tcStart="0s" tcFormat="' ||
      CASE WHEN dropped THEN 'DF' ELSE 'NDF' END || '"' ||
      CASE WHEN has_audio AND channels = 1 THEN ' audioLayout="mono"'
           WHEN has_audio AND channels = 2 THEN ' audioLayout="stereo"' ELSE '' END ||
      CASE WHEN has_audio AND sample_rate = 44100 THEN ' audioRate="44.1k"'
           WHEN has_audio AND sample_rate = 48000 THEN ' audioRate="48k"' ELSE '' END || '>',
    '          <spine>'] AS ls FROM whole_takes)
UNION ALL
SELECT take_id, n + 1, 0, '            <asset-clip ref="r2" name="take &amp; ' || take_id ||
  '.mp4" offset="' || {rational('rec_in')} || '" start="' || {rational('src_in')} || '" duration="' ||
  {rational('(src_out - src_in)')} || '" format="r1" tcFormat="' ||
  CASE WHEN dropped THEN 'DF' ELSE 'NDF' END ||
  CASE WHEN (take_id, n) IN (SELECT (take_id, n) FROM placed_once) THEN '">' ELSE '"/>' END
FROM shown_events
UNION ALL
SELECT p.take_id, p.n + 1, p.ord + 1, '              <marker start="' || {rational('p.frame')} ||
  '" duration="' || {ONE_FRAME} || '" value="' || {escaped('p.label')} || '"/>'
FROM placed_once p JOIN shown_events e USING (take_id, n)
UNION ALL
SELECT DISTINCT take_id, n + 1, {L.LAST}, '            </asset-clip>' FROM placed_once
UNION ALL
SELECT take_id, last + 2, unnest(range(6)), unnest(['          </spine>', '        </sequence>',
  '      </project>', '    </event>', '  </library>', '</fcpxml>']) FROM whole_takes"""


@query("fcpxml_documents", sql(FCPXML_SQL))
def fcpxml_documents(spark, d):
    media, cuts, events = events_of(spark, d)
    return L.fcpxml_lines(events, L.place_markers(events, cuts), media)


@query("fcpxml_files", sql(files_sql(FCPXML_SQL)))
def fcpxml_files(spark, d):
    media, cuts, events = events_of(spark, d)
    markers = L.place_markers(events, cuts)
    return files_of(spark, lambda to: sinks.fcpxml_files(events, markers, media, to), ".fcpxml")


part("damaged_events", """--materialized
SELECT take_id, n, src_in, CASE WHEN take_id % 5 = 3 AND n = 0 THEN src_in ELSE src_out END AS src_out,
       rec_in + CASE WHEN take_id % 5 = 2 AND n = 2 THEN 3 ELSE 0 END AS rec_in,
       rec_out + CASE WHEN take_id % 5 = 2 AND n = 2 THEN 3 ELSE 0 END AS rec_out
FROM edit_events WHERE NOT (take_id % 5 = 1 AND n = 1)""")
part("stray_markers", """
SELECT take_id, count(*) FILTER (m.frame < e.src_in OR m.frame >= e.src_out) AS stray
FROM (SELECT take_id, n, frame + CASE WHEN ord % 7 = 0 THEN 1000000 ELSE 0 END AS frame
      FROM placed_once) m JOIN damaged_events e USING (take_id, n) GROUP BY take_id""")


@query("timeline_audit", sql("""
SELECT e.*, coalesce(stray, 0) AS stray
FROM (SELECT take_id, count(*) FILTER (rec_in <> before) AS gaps,
             count(*) FILTER (src_out <= src_in) AS empty,
             cast(max(rec_out) - sum(src_out - src_in) AS BIGINT) AS off_total
      FROM (SELECT *, coalesce(lag(rec_out) OVER (PARTITION BY take_id ORDER BY n), 0) AS before
            FROM damaged_events) GROUP BY take_id) e
LEFT JOIN stray_markers USING (take_id)"""))
def timeline_audit(spark, d):
    """What the audit finds in timelines of which most were damaged, each fifth take its own way."""
    _, cuts, events = events_of(spark, d)
    k, n = F.col("take_id") % 5, F.col("n")
    late = F.when((k == 2) & (n == 2), 3).otherwise(0)
    damaged = events.filter(~((k == 1) & (n == 1))).withColumns({
        "src_out": F.when((k == 3) & (n == 0), F.col("src_in")).otherwise(F.col("src_out")),
        "rec_in": F.col("rec_in") + late, "rec_out": F.col("rec_out") + late})
    markers = L.place_markers(events, cuts).withColumn(
        "frame", F.col("frame") + F.when(F.col("ord") % 7 == 0, 1_000_000).otherwise(0))
    return L.timeline_audit(settle(damaged, "damaged"), markers)


@query("audio_attributes", sql("""
SELECT take_id, CASE WHEN has_audio AND channels = 1 THEN 'mono'
                     WHEN has_audio AND channels = 2 THEN 'stereo' END AS layout,
       CASE WHEN has_audio THEN CASE sample_rate WHEN 44100 THEN '44.1k' WHEN 48000 THEN '48k' END
       END AS rate FROM media"""))
def audio_attributes(spark, d):
    has = F.col("has_audio")
    return T.media(spark, d).select(
        "take_id", L.audio_layout(F.col("channels"), has).alias("layout"),
        L.audio_rate(F.col("sample_rate"), has).alias("rate"))


@query("media_uris", sql("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0
    THEN 'file:///C:/My%20Clips/' || replace(p_name, ' ', '%20') || '%20%26%20' || p_partkey || '.mp4'
    ELSE 'file:///media/' || replace(p_name, ' ', '%20') || '%2B' || replace(p_brand, '#', '%23')
         || '.mp4' END AS uri FROM part"""))
def media_uris(spark, d):
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(
        F.lit("C:\\My Clips\\"), "p_name", F.lit(" & "), F.col("p_partkey").cast("string"),
        F.lit(".mp4"))).otherwise(F.concat(F.lit("/media/"), "p_name", F.lit("+"), "p_brand",
                                           F.lit(".mp4")))
    return T.table(spark, d, "part").select("p_partkey", L.media_uri(path).alias("uri"))
