import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wordreel.operators import (
    captions as C, clips as K, jobs as J, quality as Q, romanize as Z, timeline as T)
from wordreel.sources import logs as G, probe, sinks, transcripts as S
from wordreel.streaming import progress as L


def test_transcript_files(spark, tmp_path):
    docs = {
        "a": {"segments": [{"start": 0, "end": 2, "text": "hi there", "words": [
            {"word": " hi", "start": 0.0, "end": 0.4}, {"word": "  ", "start": 0.4, "end": 0.5}]},
            {"start": 2, "end": 3, "text": "x", "words": [{"word": "x", "start": 2.005, "end": 3}]}]},
        "b": {"segments": [{"start": 1, "end": 2, "text": " only text "}, {"start": 2, "end": 3, "text": " "}]},
        "c": {"words": [{"start": 0.1, "end": 0.2, "text": "क्या", "hinglish": "kya"}]},
    }
    for name, body in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False, indent=1))
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "e.json").write_text('{"language": "en"}')
    words, rejects = S.read_transcripts(spark, str(tmp_path))
    assert sorted(r.take_id[-6] for r in rejects.collect()) == ["d", "e"]
    rows = words.orderBy("take_id", "idx").collect()
    got = [(r.take_id[-6], r.idx, r.start_ms, r.end_ms, r.text, r.hinglish) for r in rows]
    assert got == [("a", 0, 0, 400, "hi", None), ("a", 1, 2005, 3000, "x", None),
                   ("b", 0, 1000, 2000, "only text", None), ("c", 0, 100, 200, "क्या", "kya")]


def test_silence_log_pairs_starts_with_ends(spark, tmp_path):
    (tmp_path / "t.log").write_text(
        "frame=1\n[silencedetect @ 0x1] silence_start: 0.5\n[x] silence_end: 1.25 | "
        "silence_duration: 0.75\n[x] silence_start: 3\n[x] silence_end: 4.5\n[x] silence_start: 9\n")
    got = sorted(tuple(r)[1:] for r in G.silences_from_log(G.read_lines(spark, str(tmp_path))).collect())
    assert got == [(500, 1250), (3000, 4500)]


def test_subtitle_track(spark, tmp_path):
    (tmp_path / "t.vtt").write_text(
        "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\n<c>Hello</c> you\nsecond line\n\n"
        "2\n00:00:03.500 --> 00:00:04.000\n42 is a number\n<i></i>\nfine\n\nstray\n")
    cues = G.cues_from_vtt(G.read_lines(spark, str(tmp_path)))
    got = [(r.t, r.text) for r in cues.orderBy("line_no").collect()]
    assert got == [("00:00:01", "Hello you"), ("00:00:03", "fine")]
    assert [r.line for r in G.transcript_text(cues).orderBy("line_no").collect()] == [
        "[00:00:01] Hello you", "[00:00:03] fine"]


def test_many_reports_on_one_line_keep_their_order(spark):
    line = " ".join(f"silence_start: {i} silence_end: {i}.5" for i in range(1_500))
    lines = spark.createDataFrame([("t", 0, line), ("t", 1, "silence_start: 9000"),
                                   ("t", 2, "silence_end: 9001")],
                                  "take_id string, line_no bigint, line string")
    got = sorted(tuple(r)[1:] for r in G.silences_from_log(lines).collect())
    assert got == [(i * 1000, i * 1000 + 500) for i in range(1_500)] + [(9_000_000, 9_001_000)]


def test_probe(spark):
    rows = spark.createDataFrame([
        (1, json.dumps({"streams": [{"codec_type": "video", "width": 640, "height": 360,
                                     "r_frame_rate": "30000/1001"}], "format": {"duration": "12.3456"}})),
        (2, "{}"), (3, "junk"),
        (4, json.dumps({"streams": [{"codec_type": "video", "r_frame_rate": "25/0"}],
                        "format": {"duration": "1"}}))], "take_id bigint, body string")
    ok, bad = probe.media_from_probe(rows)
    r = ok.first()
    assert (r.fps, r.duration_ms, r.has_audio, r.channels) == (29.97, 12346, False, None)
    assert sorted((b.take_id, b.error) for b in bad.collect()) == [
        (2, "No video stream found"), (3, "No video stream found"), (4, "Bad frame rate")]


@pytest.mark.parametrize("word,latin", [
    ("क्या", "kya"), ("नहीं", "nahin"), ("तरह", "tarah"), ("चुनौतियां", "chunautiyan"), ("मैं", "main"),
    ("अच्छा", "achchh"), ("hello", "hello"), ("यानी", "yani"), ("बात,", "bat,"), ("है।", "hai."),
    ("कमल", "kamal"), ("सड़क", "sadak"), ("न", "na"), ("घर", "ghar"), ("डॉक्टर", "doktar"),
    ("ऑफ", "oph"), ("\u092c\u095c\u093e", "bad"), ("\u095b\u0930\u0942\u0930", "jarur")])
def test_romanization_rules(spark, word, latin):
    assert spark.range(1).select(Z.romanize_rules(F.lit(word)).alias("x")).first().x == latin


def test_replies_of_the_wrong_length_fall_back(spark):
    said = [(1, i, "क्या" if i == 3 else f"w{i}") for i in range(100)]
    words = spark.createDataFrame(said, "take_id bigint, idx bigint, text string")
    reply = "```json\n" + json.dumps([f"r{i}" for i in range(80)]) + "\n```"
    for body, third, first in ((reply, "r3", "r0"), ('["x"]', "kya", "w0"), ("no", "kya", "w0")):
        replies = spark.createDataFrame([(1, 0, body)], "take_id bigint, chunk bigint, body string")
        got = {r.idx: r.hinglish for r in Z.apply_romanization(words, replies).collect()}
        assert (got[3], got[0], got[99]) == (third, first, "w99")


def text_of(folder):
    """What part files, in the order of their names, hold together."""
    return b"".join(f.read_bytes() for f in sorted(folder.glob("part-*")))


def test_documents_byte_for_byte(spark, words, media, tmp_path):
    said = {1: [(0, 900, "a"), (900, 950, "b")], 2: [(i * 10, i * 10 + 9, f"w{i}")
                                                     for i in range(9_000)]}
    shown = C.display_words(words(said))
    sinks.write_srt(C.cues(shown, 1), str(tmp_path / "srt"))
    lines = spark.read.parquet(str(tmp_path / "srt"))
    sinks.write_text(lines, str(tmp_path / "short"), 1)
    sinks.write_text(lines, str(tmp_path / "long"), 2)
    assert text_of(tmp_path / "short") == (
        b"1\n00:00:00,000 --> 00:00:00,900\na\n\n2\n00:00:00,900 --> 00:00:00,950\nb\n")
    whole = text_of(tmp_path / "long")
    assert whole.count(b"\n\n") == 8_999 and whole.endswith(b"\nw8999\n")
    assert [int(x.split(b"\n")[0]) for x in whole.split(b"\n\n")] == list(range(1, 9_001))

    kept = spark.createDataFrame([(1, 0, 6_050), (1, 8_000, 12_300)],
                                 "take_id bigint, start_ms bigint, end_ms bigint")
    one = media({1: 20_100})
    edits = T.edit_events(kept, one)
    sinks.write_edl(edits, one, str(tmp_path / "edl"))
    sinks.write_text(spark.read.parquet(str(tmp_path / "edl")), str(tmp_path / "cut"), 1, "\r\n")
    cut = text_of(tmp_path / "cut")
    assert cut.count(b"\n") == cut.count(b"\r\n") == 8 and cut.endswith(b".mp4\r\n")
    assert b"\r\n\r\n002  " in cut and not cut.endswith(b"\r\n\r\n")

    none = spark.createDataFrame([], "take_id bigint, n bigint, fps double, frame bigint, "
                                     "label string, ord bigint")
    sinks.write_fcpxml(edits, none, one, str(tmp_path / "xml"))
    sinks.write_text(spark.read.parquet(str(tmp_path / "xml")), str(tmp_path / "line"), 1)
    assert text_of(tmp_path / "line").startswith(b"<?xml ") and text_of(
        tmp_path / "line").endswith(b"</fcpxml>\n")


def test_clip_rows_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "f.mp4", "d" * 600, "u", 1.234, 2.345, "", 0, "t")],
                                 "user_id bigint, job_id bigint, filename string, description string, "
                                 "source_url string, start_time double, end_time double, hook string, "
                                 "virality_score int, clip_type string")
    sinks.write_clips(rows, str(tmp_path / "clips"))
    sinks.write_clips(rows, str(tmp_path / "clips"))
    back = spark.read.parquet(str(tmp_path / "clips")).collect()
    assert len(back) == 2 and len(back[0].description) == 500
    assert (back[0].hook, back[0].virality_score, back[0].storage_path) == (None, None, "1/2/f.mp4")


def test_one_file_for_each_take(spark, words, tmp_path):
    """Takes of all sizes; one lies over several tasks, one task holds many."""
    said = {t: [(i * 10, i * 10 + 9, f"w{t}x{i}") for i in range(1 + t % 4)] for t in range(1, 100)}
    said[40] = [(i * 10, i * 10 + 9, f"w{i}é") for i in range(20_000)]
    lines = C.srt_lines(C.cues(C.display_words(words(said)), 1))
    (tmp_path / "srt").mkdir()
    (tmp_path / "srt" / "7.srt").write_text("old")
    (tmp_path / "srt" / "900.srt").write_text("another take's")
    sinks.write_files(lines, str(tmp_path / "srt"), ".srt", "\r\n")
    want = {}
    for r in lines.orderBy("take_id", "line_no", "sub").collect():
        want[r.take_id] = want.get(r.take_id, b"") + r.line.encode() + b"\r\n"
    got = {int(f.stem): f.read_bytes() for f in (tmp_path / "srt").glob("*.srt")}
    assert got.pop(900) == b"another take's" and got == want and len(want) == 99
    assert sorted(f.name for f in (tmp_path / "srt").iterdir() if f.suffix != ".srt") == ["_SUCCESS"]
    sinks.write_files(lines.filter("false"), str(tmp_path / "none"), ".srt")
    assert [f.name for f in (tmp_path / "none").iterdir()] == ["_SUCCESS"]


def test_a_writer_that_fails_leaves_whole_files_only(tmp_path):
    from wordreel.sources.take_files import Edges, TakeFileWriter
    w = TakeFileWriter(str(tmp_path / "out"), ".txt", "\n", False)
    for task, (first, last) in enumerate([(b"1a\n", b"2a\n"), (b"2b\n", b"2c\n"), (b"2d\n", b"3a\n")]):
        (tmp_path / "out" / "_parts" / f"{task}-first").write_bytes(first)
        (tmp_path / "out" / "_parts" / f"{task}-last").write_bytes(last)
    part = lambda k, which: str(tmp_path / "out" / "_parts" / f"{k}-{which}")
    ends = [("1", "2"), ("2", "2"), ("2", "3")]
    w.commit([Edges(k, [(a, part(k, "first")), (b, part(k, "last"))])
              for k, (a, b) in reversed(list(enumerate(ends)))] + [None])
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == {
        "1.txt": b"1a\n", "2.txt": b"2a\n2b\n2c\n2d\n", "3.txt": b"3a\n", "_SUCCESS": b""}
    again = TakeFileWriter(str(tmp_path / "out"), ".txt", "\n", False)
    again.abort([])
    assert len(list((tmp_path / "out").iterdir())) == 4
    TakeFileWriter(str(tmp_path / "out"), ".txt", "\n", True)
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["_parts"]


def test_a_change_of_jobs_rewrites_the_buckets_it_touches(spark, tmp_path):
    from wordreel.sources.job_table import JobTable
    rows = [(i, i % 7, "queued" if i % 2 else "completed", False, None, "2024-01-01T00:00:00Z", i * 10)
            for i in range(200)]
    jobs = spark.createDataFrame(rows, "id bigint, user_id bigint, status string, seen boolean, "
                                       "error string, updated_at string, expires_s bigint")
    table = JobTable(spark, str(tmp_path / "jobs"))
    table.create(jobs, 16)
    before = {r.id: r for r in table.read().collect()}
    assert len(before) == 200
    held = table.read()                         # a reader that has begun keeps its moment
    acks = spark.createDataFrame([(3, 3), (5, 4), (5, 5)], "id bigint, user_id bigint")
    assert 1 <= len(table.mark_seen(acks)) <= 2
    files = lambda v: list((tmp_path / "jobs" / "x").parent.glob(f"version={v}-*/bucket=*/*.parquet"))
    assert 1 <= len(files(1)) <= 2
    assert {r.id for r in table.read().filter("seen").collect()} == {3, 5}
    assert held.filter("seen").count() == 0 and table.read().count() == 200
    assert table.mark_seen(acks.filter("id > 1000")) == []
    assert len(table.purge(F.lit(15))) <= 2
    assert {r.id for r in table.read().collect()} == set(range(2, 200))
    assert len(table.mark_stale(F.lit(1704067200 + 3600))) == 16
    assert {r.status for r in table.read().filter("id % 2 = 1").collect()} == {"failed"}
    # a writer that began on an older list is refused, and nothing of it is seen
    late = JobTable(spark, str(tmp_path / "jobs"))
    now = late._list()
    late._list = lambda: now | {"number": now["number"] - 1}
    with pytest.raises(FileExistsError):
        late.mark_seen(acks.withColumn("id", F.col("id") + 4).withColumn("user_id", F.col("id") % 7))
    assert {r.id for r in table.read().filter("seen").collect()} == {3, 5}
    table.vacuum()
    assert len(list((tmp_path / "jobs").glob("list-*.json"))) == 2 and table.read().count() == 198


def test_a_long_history_is_filtered_before_it_is_joined(spark):
    history = spark.range(300_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), "id")
    wanted = history.filter("id % 1000 = 7").select("key")
    left = {r.id for r in K.maybe_wanted(history, wanted).collect()}
    assert set(range(7, 300_000, 1000)) <= left and len(left) < 330
    assert K.maybe_wanted(history, wanted.filter("false")).count() == 0


def test_old_files_are_listed_not_deleted(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    files = J.list_files(spark, str(tmp_path))
    now = files.first().modified_s
    assert J.stale_files(files, F.lit(now + 48 * 3600)).count() == 0
    assert J.stale_files(files, F.lit(now + 48 * 3600 + 1)).count() == 1
    assert (tmp_path / "x.bin").exists()


def test_content_types_are_substrings_in_order(spark):
    rows = [(1, "A ghost story", ""), (2, "Learn to react", ""), (3, "Plain", "x" * 500 + "podcast"),
            (4, "My Daily life", ""), (5, None, None)]
    df = spark.createDataFrame(rows, "video_id int, title string, transcript string").withColumns({
        "description": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>")})
    got = {r.video_id: r.content_type for r in K.content_type(df).collect()}
    assert got == {1: "podcast/interview", 2: "tutorial/educational", 3: "general", 4: "vlog", 5: "general"}


def test_word_hits_and_group_recall(spark, words):
    from tests.test_intervals import CUTS
    w = words({1: [(0, 100, "a"), (100, 201, "b"), (300, 400, "c")]})
    cuts = spark.createDataFrame([(1, 50, 150, "filler", 90, "", True, 0), (1, 300, 350, "repeat", 90, "", True, 1),
                                  (1, 0, 900, "silence", 90, "", True, 2), (1, 0, 900, "filler", 50, "", False, 3)], CUTS)
    assert sorted(r.idx for r in Q.word_hits(w, cuts).collect()) == [0]
    truth = spark.createDataFrame([(1, 1)], "take_id bigint, idx bigint")
    judged = Q.judged_words(w, cuts, truth)
    r = Q.filler_eval(w.select("take_id").distinct(), judged).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (0, 1, 1, 0.0, 0.0)
    assert [d.idx for d in Q.damaged(judged).collect()] == [0]
    members = spark.createDataFrame([(1, 0, 3), (1, 0, 4), (1, 1, 8)], "take_id int, grp int, j int")
    true = spark.createDataFrame([(1, 0, 3), (1, 0, 4), (1, 1, 4), (1, 1, 8), (1, 2, 9)],
                                 "take_id int, true_grp int, j int")
    got = {r.true_grp: (r.found, r.touched) for r in Q.group_eval(members, true).collect()}
    assert got == {0: (True, 2), 1: (False, 2), 2: (False, 0)}


# Streams -----------------------------------------------------------------------

def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


SCHEMA = "event_id bigint, job bigint, ts timestamp, status string"
EVENTS = [
    (1, 1, at(0), "queued"), (2, 1, at(10), "rendering"), (3, 1, at(20), "completed"),
    (4, 1, at(25), "rendering"), (5, 2, at(0), "queued"), (6, 2, at(5), "rendering"),
    (7, 2, at(50), "completed"), (8, 3, at(300), "queued"), (2, 1, at(10), "rendering")]


def put(spark, tmp_path, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(
        str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


ORDERS = {"in order": (EVENTS[:5], EVENTS[5:]), "late": (EVENTS[7:], EVENTS[3:7], EVENTS[:3]),
          "one by one": [[e] for e in reversed(EVENTS)]}


@pytest.mark.parametrize("order", ORDERS)
def test_final_states_stand_whatever_the_order(spark, tmp_path, order):
    """The stream is drained once after every part of the events."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k, part in enumerate(ORDERS[order]):
        L.write_changes(put(spark, tmp_path, part), out, state).awaitTermination()
        # a batch writes the jobs that it touches and no others
        newest = max((tmp_path / "out").glob("batch=*"), key=lambda p: int(p.name[6:]))
        assert {r.job for r in spark.read.parquet(str(newest)).collect()} == {e[1] for e in part}
        if k == 1:
            L.compact(spark, out)
    want = {1: "completed", 2: "completed", 3: "queued"}

    def seen():
        return {r.job: r.status for r in L.latest_status(L.states(spark, out)).collect()}

    assert seen() == want
    # a batch that is not written to the end is not read
    half = tmp_path / "out" / "batch=1000"
    spark.createDataFrame([(1, (at(0), 9, "failed"), None)],
                          "job bigint, done struct<ts: timestamp, event_id: bigint, status: string>,"
                          " open struct<ts: timestamp, event_id: bigint, status: string>"
                          ).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert seen() == want
    L.compact(spark, out)
    L.compact(spark, out)
    assert seen() == want
    assert len(L._whole(spark, out, "base")) <= 2


def failures(spark, tmp_path, parts, delay):
    for part in parts:
        L.write_failures(put(spark, tmp_path, part), str(tmp_path / "out"), str(tmp_path / "state"),
                         delay).awaitTermination()
    return sorted((r.job, r.failed_at, r.last_status) for r in
                  spark.read.parquet(str(tmp_path / "out")).collect())


END = (99, 9, at(3000), "completed")    # moves the clock past all delays


@pytest.mark.parametrize("order", ORDERS)
def test_silent_jobs_fail_once(spark, tmp_path, order):
    """Events come up to five hours late here; a second drain says nothing twice."""
    got = failures(spark, tmp_path, [*ORDERS[order], [END], [END], [(100, 9, at(3001), "queued")]],
                   "6 hours")
    assert got == [(2, at(35), "rendering"), (3, at(330), "queued")]


def test_a_failure_is_said_when_the_clock_is_past_it(spark, tmp_path):
    one, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part, want in (([(1, 1, at(0), "queued")], []), ([(2, 2, at(39), "completed")], []),
                       ([(3, 2, at(40), "completed")], [1]), ([(4, 1, at(41), "queued")], [1]),
                       ([(5, 3, at(0), "queued")], [1, 3])):
        L.write_failures(put(spark, tmp_path, part), one, state).awaitTermination()
        assert sorted(r.job for r in spark.read.parquet(one).collect()) == want


def test_an_event_that_comes_late_joins_two_stretches(spark, tmp_path):
    parts = [[(1, 1, at(0), "queued"), (2, 1, at(45), "rendering")],
             [(3, 1, at(25), "rendering"), (4, 2, at(500), "queued")]]
    assert failures(spark, tmp_path, parts, "30 minutes") == [(1, at(75), "rendering")]


def test_retention_keeps_its_cadence_over_restarts(spark, tmp_path):
    report = spark.createDataFrame([("a",)], "path string")
    out, now = tmp_path / "out", [1_000_000.0]

    def start(k):
        stream = put(spark, tmp_path, [(k, 1, at(k), "queued")])
        L.retention_stream(stream, lambda: report, str(out), str(tmp_path / "state"), drain=True,
                           clock=lambda: now[0]).awaitTermination()
        return len(list(out.glob("run=*")))

    assert start(1) == 1
    now[0] += 1799
    assert start(2) == 1        # started again within the half hour
    now[0] += 2
    assert start(3) == 2
    (max(out.glob("run=*")) / "_SUCCESS").unlink()      # that run did not end
    now[0] += 1
    assert start(4) == 3
