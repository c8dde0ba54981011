from wordreel.operators import detect as D

LEX = D.Lexicon()


def say(tokens, step=300, length=200, gaps=None):
    """Words of `length` ms every `step` ms; `gaps` adds silence before a position."""
    out, at = [], 0
    for i, t in enumerate(tokens):
        at += (gaps or {}).get(i, 0)
        out.append((at, at + length, t))
        at += step
    return out


def test_gap_threshold_is_exact_and_text_half_up(words):
    w = words({1: [(0, 1000, "a"), (1400, 1500, "b"), (1899, 2000, "c"), (2675, 2700, "d")]})
    got = sorted(tuple(r) for r in D.gap_cuts(w).select(
        "start_ms", "end_ms", "confidence_pct", "text").collect())
    assert got == [(1120, 1280, 60, "0.40s pause"), (2120, 2555, 74, "0.68s pause")]


def test_repeat_guards(words):
    takes = {
        1: say(["main", "main"]), 2: say(["main.", "main"]), 3: say(["alag", "alag"]),
        4: say(["re-do", "re-do"]), 5: say(["a", "a", "a"]),
        6: [(0, 100, "x"), (450, 500, "x"), (851, 900, "x")], 7: say(["Main,", "main"]),
    }
    got = sorted((r.take_id, r.start_ms) for r in D.repeat_cuts(words(takes)).collect())
    assert got == [(1, 0), (5, 0), (5, 300), (6, 0)]


def test_sounds_are_cut_on_sight_and_scored_words_only_in_context(words):
    takes = {1: say(["so", "umm", "we", "Hmm,"]), 2: say(["so", "we", "go"])}
    cuts = D.detect(words(takes)).collect()
    assert sorted((r.take_id, r.text) for r in cuts) == [(1, "Hmm,"), (1, "umm")]


def test_one_pause_drawn_out_and_repeated_reaches_auto(words):
    # 35 + 20 + 15: three ordinary uses and one drawn out with a pause before it.
    said = [(0, 200, "matlab"), (210, 400, "x"), (410, 610, "matlab"), (620, 800, "y"),
            (810, 1010, "matlab"), (1020, 1100, "z"), (1400, 1800, "matlab"), (1810, 1900, "q")]
    scores = {r.idx: r.score for r in D.filler_scores(words({1: said})).collect()}
    assert scores == {0: 15, 2: 15, 4: 15, 6: 70}
    assert [(r.confidence_pct, r.auto) for r in D.classify(D.filler_scores(words({1: said})))
            .collect()] == [(70, True)]


def test_token_forms(spark):
    from wordreel.functions.text import clean_token, norm_token
    df = spark.createDataFrame([("—Hello!—",), ("  “x ",), ("don't",), ("क्या",), ("-a b-",)],
                               "t string")
    got = [tuple(r) for r in df.select(clean_token("t"), norm_token("t")).collect()]
    assert got[0] == ("hello", "hello")
    assert got[2] == ("don't", "dont")
    assert got[3][1] == "कय"
    assert got[4] == ("a b", "a b")


def test_measured_takes_use_silences_and_no_gaps(spark, words, media):
    w = words({1: say(["a", "b"], gaps={1: 900}), 2: say(["a", "b"], gaps={1: 900})})
    quiet = spark.createDataFrame([(1, 250, 1150)], "take_id bigint, start_ms bigint, end_ms bigint")
    from pyspark.sql import functions as F
    m = media({1: 5000, 2: 5000}).withColumn("measured", F.col("take_id") == 1)
    got = sorted((r.take_id, r.start_ms, r.text) for r in D.detect(w, quiet, m).collect())
    assert got == [(1, 370, "0.90s silence"), (2, 320, "1.00s pause")]


def test_suggestions_do_not_swallow_automatic_cuts(spark, media):
    from tests.test_intervals import CUTS
    rows = [(1, 1000, 2000, "silence", 80, "a", True, 0), (1, 1500, 3000, "filler", 60, "b", False, 1)]
    got = sorted((r.start_ms, r.end_ms, r.auto) for r in D.merge_cuts(
        spark.createDataFrame(rows, CUTS), media({1: 9000})).collect())
    assert got == [(940, 2060, True), (1440, 3060, False)]


def test_summary_and_report(spark, media):
    from tests.test_intervals import CUTS
    rows = [(1, i * 1000, i * 1000 + 100, "silence", 80, "a", i % 2 == 0, i) for i in range(50)]
    cuts = spark.createDataFrame(rows, CUTS)
    s = D.summarize(cuts, media({1: 100_000, 2: 5_000})).orderBy("take_id").collect()
    assert (s[0].removed_ms, s[0].auto_cuts, s[0].suggested_cuts, s[0].removed_permille) == (
        2500, 25, 25, 25)
    assert (s[1].tightened_ms, s[1].auto_cuts) == (5000, 0)
    lines = D.report(cuts).collect()
    assert len(lines) == 40 and {r.more for r in lines} == {10}
