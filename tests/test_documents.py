"""Captions, edit lists and timelines as text."""

import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from tests.test_intervals import CUTS
from wordreel import fixed
from wordreel.functions import timefmt as tf
from wordreel.operators import captions as C, timeline as L

NTSC30, NTSC60 = 30000 / 1001, 60000 / 1001


def body(lines, end="\n"):
    """The document of the only take, every line with its end."""
    return "".join(r.line + end for r in lines.orderBy("line_no", "sub").collect())


# Labels at the places where drop-frame counting skips.
@pytest.mark.parametrize("fps,frame,label", [
    (NTSC30, 0, "00:00:00;00"), (NTSC30, 1799, "00:00:59;29"), (NTSC30, 1800, "00:01:00;02"),
    (NTSC30, 17981, "00:09:59;29"), (NTSC30, 17982, "00:10:00;00"), (NTSC30, 107892, "01:00:00;00"),
    (NTSC60, 3599, "00:00:59;59"), (NTSC60, 3600, "00:01:00;04"), (25.0, 25, "00:00:01:00"),
    (25.0, 90000, "01:00:00:00"), (30.0, 30, "00:00:01:00"), (24000 / 1001, 24, "00:00:01:00"),
])
def test_timecode_checkpoints(spark, fps, frame, label):
    row = spark.range(1).select(tf.timecode(F.lit(frame), F.lit(fps)).alias("t")).first()
    assert row.t == label


def test_time_texts(spark):
    row = spark.range(1).select(
        tf.srt_time(F.lit(3_661_007)).alias("a"), tf.ass_time(F.lit(3_661_074)).alias("b"),
        tf.ass_time(F.lit(59_996)).alias("c"), tf.rational(F.lit(0), F.lit(NTSC30)).alias("d"),
        tf.rational(F.lit(2), F.lit(29.97)).alias("e"), tf.rational(F.lit(2), F.lit(25.0)).alias("f"),
        *[tf.length_ms(F.lit(t)).alias(f"g{i}") for i, t in enumerate(
            ["60", "1:00", " 1:02.5 ", "inf", "nan", "0", "-3", "a:b", ""])]).first()
    assert list(row) == ["01:01:01,007", "1:01:01.07", "0:00:60.00", "0s", "2002/30000s", "2/25s",
                         60_000, 60_000, 62_500, None, None, None, None, None, None]


KEEP = [(0, 6050), (8000, 12300), (14900, 20000), (20000, 20010)]


def timeline(spark, media, fps, name="/tmp/My Clip.mov"):
    m = media({1: 20_100}).withColumns({"fps": F.lit(fps), "file_name": F.lit(name)})
    kept = spark.createDataFrame([(1, a, b) for a, b in KEEP],
                                 "take_id bigint, start_ms bigint, end_ms bigint")
    return m, L.edit_events(kept, m)


@pytest.mark.parametrize("fps", [NTSC30, 25.0, NTSC60])
def test_record_times_are_contiguous(spark, media, fps):
    _, events = timeline(spark, media, fps)
    rows = events.orderBy("n").collect()
    assert rows[0].rec_in == 0
    assert all(a.rec_out == b.rec_in for a, b in zip(rows, rows[1:]))
    assert all(r.src_out > r.src_in for r in rows)
    assert rows[-1].rec_out == sum(r.src_out - r.src_in for r in rows)


def test_edit_list(spark, media):
    m, events = timeline(spark, media, NTSC30)
    lines = body(L.edl_lines(events, m), "\r\n").split("\r\n")
    assert lines[1] == "FCM: DROP FRAME" and not any("\n" in x for x in lines)
    assert lines[3].startswith("001  MYCLIPMO AA/V  C        00:00:00;00 ")
    assert lines[4] == "* FROM CLIP NAME: My Clip.mov"
    m, events = timeline(spark, media, 25.0, "/tmp/--.--")
    text = body(L.edl_lines(events, m))
    assert "NON-DROP FRAME" in text and "SOURCE   AA/V" in text


def test_timeline_document_is_well_formed_and_markers_lie_in_their_clip(spark, media):
    m, events = timeline(spark, media, NTSC30, "/tmp/a & b.mp4")
    cuts = spark.createDataFrame(
        [(1, 3200, 3300, "filler", 50, "matlab <b>", False, 1), (1, 16000, 16100, "repeat", 50, "", False, 2),
         (1, 7000, 7100, "filler", 50, "inside a cut", False, 3),
         (1, 5000, 5100, "filler", 50, "applied", True, 4)], CUTS)
    placed = L.place_markers(events, cuts)
    assert sorted(r.label for r in placed.collect()) == ["matlab <b>", "repeat"]
    assert [tuple(r)[1:] for r in L.timeline_audit(events, placed).collect()] == [(0, 0, 0, 0)]
    dom = xml.dom.minidom.parseString(body(L.fcpxml_lines(events, placed, m)).encode())
    assert len(dom.getElementsByTagName("asset-clip")) == events.count()
    assert len(dom.getElementsByTagName("marker")) == 2
    asset = dom.getElementsByTagName("asset")[0]
    assert asset.getAttribute("audioChannels") == "2" and asset.getAttribute("name") == "a & b.mp4"
    seq = dom.getElementsByTagName("sequence")[0]
    assert (seq.getAttribute("audioLayout"), seq.getAttribute("audioRate")) == ("stereo", "48k")
    unknown = m.withColumn("channels", F.lit(None).cast("int")).withColumn("sample_rate", F.lit(22050))
    text = body(L.fcpxml_lines(events, placed, unknown))
    assert "audioChannels" not in text and "audioRate" not in text and 'hasAudio="1"' in text


@pytest.mark.parametrize("path,uri", [
    ("C:\\Users\\a\\My Clips\\take 1.mp4", "file:///C:/Users/a/My%20Clips/take%201.mp4"),
    ("/tmp/a b+~*.mp4", "file:///tmp/a%20b%2B~%2A.mp4"), ("/tmp/é.mov", "file:///tmp/%C3%A9.mov")])
def test_media_uris(spark, path, uri):
    assert spark.range(1).select(L.media_uri(F.lit(path)).alias("u")).first().u == uri


# Captions ----------------------------------------------------------------------

def style(spark, **changes):
    df = C.presets(spark).filter(F.col("preset") == changes.pop("preset", "default"))
    for name, value in changes.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(F.lit(0).alias("style_id"), F.struct("*").alias("style"))


def events(spark, words, said, **changes):
    shown = C.display_words(words({1: said})).withColumn("style_id", F.lit(0))
    return C.word_events(shown, style(spark, **changes), C.style_markup()).orderBy("n").collect()


SAID = [(0, 400, "one"), (400, 400, "{two}"), (400, 900, "three"), (1000, 1040, "four")]


def test_events_last_until_the_next_word_and_never_no_time(spark, words):
    got = events(spark, words, SAID)
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 400), (400, 500), (400, 900), (1000, 1040)]
    white = "{\\c&H00FFFFFF\\alpha&H00\\fscx100\\fscy100}"
    dim = white.replace("&H00\\f", "&HAA\\f")
    big = "{\\c&H0000FFFF\\alpha&H00\\fscx112\\fscy112}"
    assert got[1].body == f"{white}ONE {big}TWO{white} {dim}THREE{white}"


def test_pop_fade_and_karaoke_markup(spark, words):
    pop = events(spark, words, SAID[:1], preset="bold_impact")[0].body
    assert pop.startswith("{\\c&H0000FFFF\\alpha&H00\\fscx50\\fscy50\\t(0,90,\\fscx115\\fscy115)"
                          "\\t(90,150,\\fscx100\\fscy100)}ONE")
    fade = events(spark, words, SAID[:1], preset="subtle")[0].body
    assert fade.startswith("{\\c&H0088FF88\\alpha&HFF\\t(0,200,\\alpha&H00)}one")
    one = events(spark, words, SAID, preset="karaoke")
    assert [r.body for r in one] == ["{\\kf40}ONE {\\kf10}TWO {\\kf50}THREE {\\kf10}FOUR"]


def test_subtitle_document_header(spark, words):
    shown = C.display_words(words({1: SAID})).withColumn("style_id", F.lit(0))
    rows = C.word_events(shown, style(spark), C.style_markup())
    heads = shown.filter("rn = 0").join(style(spark), "style_id").select(
        "take_id", C.style_header(F.lit(640), F.lit(360)).alias("head"))
    lines = body(C.ass_lines(rows, heads)).split("\n")
    assert body(C.ass_lines(rows.filter("false"), heads)).endswith("Effect, Text\n")
    assert lines[:5] == ["[Script Info]", "ScriptType: v4.00+", "PlayResX: 640", "PlayResY: 360",
                         "WrapStyle: 1"]
    assert lines[8] == ("Style: Caption,Arial Black,72,&H00FFFFFF,&H000000FF,&H00000000,&H66000000,"
                        "-1,0,0,0,100,100,2,0,1,4,3,2,40,40,320,1")
    assert lines[9].startswith("Style: Highlight,Arial Black,80,&H0000FFFF")
    assert lines[13].startswith("Dialogue: 0,0:00:00.00,0:00:00.40,Caption,,0,0,0,,")


def test_srt_skips_blanks_and_numbers_cues(spark, words):
    said = [(0, 100, "a"), (100, 200, " "), (200, 300, "b"), (300, 400, ""), (400, 61_500, "c ")]
    assert body(C.srt_lines(C.cues(C.display_words(words({1: said})), 2))) == ("1\n00:00:00,000 --> 00:00:00,300\na b\n\n2\n00:00:00,400 --> 00:01:01,500\nc \n")


def test_a_long_document_has_the_shape_of_a_short_one(spark, words):
    said = [(i * 10, i * 10 + 9, f"w{i}") for i in range(12_000)]
    lines = C.srt_lines(C.cues(C.display_words(words({1: said})), 1))
    assert lines.columns == ["take_id", "line_no", "sub", "line"]
    assert lines.count() == 4 * 12_000 - 1
    whole = body(lines)
    assert whole.count(" --> ") == 12_000 and whole.endswith("w11999\n")


def test_upper_case_of_sharp_s_only_where_asked(spark, words):
    said = [(0, 400, "Straße")]
    assert "STRASSE" in events(spark, words, said)[0].body
    assert "Straße" in events(spark, words, said, preset="subtle")[0].body


def test_style_requests(spark):
    asked = spark.createDataFrame([
        (1, '{"preset": "subtle", "font_size": 60, "animation": {"type": "pop"}}'),
        (2, '{"font_size": 10, "text_color": "red", "animation": {"type": "spin"}}'),
        (3, '{"preset": "nope"}'), (4, "oops"), (5, '{"font_size": "big"}')],
        "request_id bigint, style_json string")
    ok, bad = C.resolve_styles(asked, C.presets(spark))
    rows = {r.request_id: r for r in C.validate_styles(ok).collect()}
    assert (rows[1].font, rows[1].font_size, tuple(rows[1].animation)) == ("Inter", 60, ("pop", 50, 115, 150))
    assert rows[1].problems == []
    assert rows[2].problems == ["font_size", "text_color", "animation.type"]
    assert sorted(r.request_id for r in bad.collect()) == [3, 4, 5]


@pytest.mark.parametrize("given,wanted", [("#FF5500", "&H000055FF"), ("00000099", "&H66000000"),
                                          ("#abcdef00", "&HFFEFCDAB")])
def test_colors(spark, given, wanted):
    assert spark.range(1).select(C.subtitle_color(F.lit(given)).alias("c")).first().c == wanted


def test_presets_are_valid(spark):
    assert all(r.problems == [] for r in C.validate_styles(C.presets(spark)).collect())
    assert len(fixed.CLIP_PRESETS) == 4
