import pytest
from pyspark.sql import functions as F

from wordreel.operators import retakes as R
from wordreel.sources.replies import parse_replies


def lines(*spoken, gap=900):
    """Phrases as words of 200 ms; returns words and the pauses between phrases."""
    words, pauses, at = [], [], 0
    for text in spoken:
        for t in text.split():
            words.append((at, at + 200, t))
            at += 200
        pauses.append((at, at + gap))
        at += gap
    return words, pauses[:-1]


LINE = "so the thing about compound interest is simple"
AGAIN = "so the thing with compound interest is very simple"
OTHER = "today we will cook rice and two green beans"


def prepared(spark, words, *spoken):
    said, pauses = lines(*spoken)
    quiet = spark.createDataFrame([(1, a, b) for a, b in pauses],
                                  "take_id bigint, start_ms bigint, end_ms bigint")
    return R.usable_of(R.phrase_bounds_measured(words({1: said}), quiet))


def members(spark, words, *spoken):
    usable = prepared(spark, words, *spoken)
    return usable, R.attempts(R.groups(R.best_links(usable)), usable)


def test_measured_pauses_split_phrases_and_short_ones_are_not_usable(spark, words):
    got = prepared(spark, words, LINE, "yes", OTHER, AGAIN).orderBy("j").collect()
    assert [(r.j, r.i0, len(r.tokens)) for r in got] == [(0, 0, 8), (1, 9, 9), (2, 18, 9)]


def test_punctuation_and_empty_text_split(words):
    w = words({1: [(0, 1, "a."), (1, 2, "b"), (2, 3, ""), (3, 4, "c"), (4, 5, "…")]})
    got = sorted((r.i0, r.i1, r.text) for r in R.phrases(R.phrase_bounds_punct(w)).collect())
    assert got == [(0, 1, "a."), (1, 3, "b"), (3, 5, "c …")]


def test_chain_of_attempts_is_one_group_in_opening_order(spark, words):
    usable, m = members(spark, words, LINE, OTHER, AGAIN, LINE + " really", OTHER)
    got = {}
    for r in m.collect():
        got.setdefault(r.grp, []).append(r.j)
    assert {g: sorted(j) for g, j in got.items()} == {0: [0, 2, 3], 1: [1, 4]}


def test_walk_back_stops_at_the_first_phrase_too_far_away(spark):
    # The second phrase ends late although it starts first: only it is near enough,
    # and the one before it is beyond the stop.
    tokens = LINE.split()
    rows = [(1, 0, 0, 0, 100_000, tokens), (1, 1, 10, 1_000, 3_000, tokens),
            (1, 2, 20, 60_000, 62_000, tokens)]
    df = spark.createDataFrame(rows, "take_id bigint, j bigint, i0 bigint, start_ms bigint, "
                                     "end_ms bigint, tokens array<string>")
    pairs = sorted((r.j, r.e.j) for r in R.candidate_pairs(df).collect())
    assert pairs == [(1, 0)]


def test_furthest_back_wins_ties(spark, words):
    usable = prepared(spark, words, LINE, LINE, LINE)
    links = {r.j: r.earlier for r in R.best_links(usable).collect()}
    assert links == {1: 0, 2: 0}


def test_long_chain_of_links(spark):
    n = 300
    links = spark.range(1, n).select(F.lit(1).cast("bigint").alias("take_id"), F.col("id").alias("j"),
                                     (F.col("id") - 1).alias("earlier"))
    got = R.groups(links)
    assert got.count() == n and got.select("grp").distinct().count() == 1


def test_endless_phrase_is_counted_not_collected(spark, words):
    said = [(i * 10, i * 10 + 9, "w") for i in range(10_000)] + [(100_000 + i * 10, 100_009 + i * 10,
            f"t{i}" + ("." if i == 6 else "")) for i in range(7)]
    said[9_999] = (99_990, 99_999, "w.")
    got = R.usable_of(R.phrase_bounds_punct(words({1: said}))).collect()
    assert [(r.i0, r.i1, r.j) for r in got] == [(10_000, 10_007, 0)]
    whole = R.phrases(R.phrase_bounds_punct(words({1: said}))).filter("i0 = 0").first()
    assert (whole.n, whole.i1, whole.text, whole.tokens) == (10_000, 10_000, None, None)
    rows = R.phrase_words(R.phrase_bounds_punct(words({1: said})))
    first = rows.filter("i0 = 0").orderBy("idx").collect()
    assert [r.idx for r in first] == list(range(10_000))
    assert {(r.i1, r.n, r.token, r.start_ms, r.end_ms) for r in first} == {
        (10_000, 10_000, "w", 0, 99_999)}
    assert first[-1].text == "w." and rows.count() == 10_007


GOOD = '{"retake": true, "keep": 1, "confidence": 0.8, "reason": "fine"}'
BAD = ["not json at all", '{"retake": true}', '{"retake": true, "keep": 99}', "",
       '{"retake": "true", "keep": 0}', '{"retake": "false", "keep": 0}', '{"retake": 1, "keep": 0}',
       '{"retake": true, "keep": true}', '{"retake": true, "keep": "1"}',
       '{"retake": true, "keep": 1.0}', '{"retake": true, "keep": -1}', '{"retake": false, "keep": 1}',
       "[1]", "null"]


def verdicts(spark, bodies, size=3):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)],
                                 "take_id bigint, grp bigint, body string")
    return R.verdicts(parse_replies(rows), rows.select("take_id", "grp", F.lit(size).alias("size")))


def test_malformed_replies_cut_nothing(spark):
    assert verdicts(spark, BAD).count() == 0


@pytest.mark.parametrize("confidence,pct", [("0.8", 80), ("7", 100), ("-2", 0), ('"x"', 0),
                                            ("null", 0), ('"0.5"', 50)])
def test_confidence_is_held_between_zero_and_one(spark, confidence, pct):
    body = '```json\n{"retake": true, "keep": 0, "confidence": ' + confidence + "}\n```"
    assert [r.confidence_pct for r in verdicts(spark, [body]).collect()] == [pct]


def test_cuts_and_status(spark, words, media):
    _, m = members(spark, words, LINE, AGAIN, OTHER, OTHER)
    m = m.cache()
    takes = media({1: 90_000, 2: 1_000})
    counts = R.group_counts(m)

    def run(bodies):
        rows = spark.createDataFrame(
            [(1, g, b is not None, b, None if b else f"call {g} failed") for g, b in enumerate(bodies)],
            "take_id bigint, grp bigint, ok boolean, body string, error string")
        sizes = m.groupBy("take_id", "grp").agg(F.count("*").alias("size"))
        judged = R.before_failure(R.verdicts(parse_replies(rows), sizes), rows)
        status = R.retake_status(takes, counts, rows, judged).orderBy("take_id").collect()
        return R.retake_cuts(m, judged).collect(), [tuple(r)[1:] for r in status]

    cuts, status = run([GOOD, GOOD])
    assert len(cuts) == 2 and not any(c.auto for c in cuts)
    assert status == [("ok", None, 2, 0), ("none-found", None, 0, 0)]
    cuts, status = run(['{"retake": false}'] * 2)
    assert cuts == [] and status[0] == ("none-confirmed", None, 2, 0)
    cuts, status = run([None, GOOD])
    assert cuts == [] and status[0] == ("model-error", "call 0 failed", 1, 1)
    none = R.retake_status(takes, counts, None, None, model=False).first()
    assert none.status == "no-model"
    assert R.group_counts(m, 1).first().skipped == 1


def test_a_group_is_one_question_whatever_its_size(spark):
    rows = [(1, g, at, at * 1000, at * 1000 + 500, f"line {at}")
            for g, n in ((0, 2), (1, 300)) for at in range(n)]
    m = spark.createDataFrame(rows, "take_id bigint, grp bigint, at bigint, start_ms bigint, "
                                    "end_ms bigint, text string")
    asked = R.retake_prompts(m).orderBy("grp", "line_no").collect()
    for grp, n in ((0, 2), (1, 300)):
        lines = [r.line for r in asked if r.grp == grp]
        assert lines[0] == R.PROMPT_HEAD and lines[-2:] == ["", R.PROMPT_TAIL]
        assert len(lines) == n + 3 and lines[n].startswith(f"[{n - 1}] ")


def test_report_names_what_is_dropped(spark, words):
    _, m = members(spark, words, LINE, AGAIN)
    judged = spark.createDataFrame([(1, 0, 1, 80, "complete")], "take_id bigint, grp bigint, "
                                   "keep bigint, confidence_pct int, reason string")
    assert [(r.at, r.dropped) for r in R.retake_report(m, judged).orderBy("at").collect()] == [
        (0, True), (1, False)]


def test_pauses_of_padded_cuts(spark):
    cuts = spark.createDataFrame([(1, 100, 700, "silence"), (1, 900, 950, "filler")],
                                 "take_id bigint, start_ms bigint, end_ms bigint, reason string")
    assert [tuple(r) for r in R.pauses_of_cuts(cuts).collect()] == [(1, 100, 700)]


def test_waves_ask_nothing_twice(spark):
    lines = [(t, g, n, f"line {t if g else 0} {g} {n}") for t in (1, 2, 3) for g in range(5)
             for n in range(3)]
    digests = R.prompt_digests(spark.createDataFrame(
        lines, "take_id bigint, grp bigint, line_no bigint, line string"))
    of = {(r.take_id, r.grp): r.digest for r in digests.collect()}
    # the first question of all takes is the same, all others differ
    assert len({of[t, 0] for t in (1, 2, 3)}) == 1 and len(set(of.values())) == 13
    log = []

    def wave(width=2, tries=2):
        replies = spark.createDataFrame([(of[k], ok) for k, ok in log], "digest string, ok boolean")
        return {(r.take_id, r.grp): r.attempt
                for r in R.next_prompts(digests, replies, width, tries).collect()}

    assert wave() == {(1, 0): 1, (1, 1): 1, (2, 1): 1, (3, 1): 1}
    log += [((1, 0), True), ((1, 1), True), ((2, 1), False)]       # then the run broke off
    assert wave() == {(1, 2): 1, (1, 3): 1, (2, 1): 2, (3, 1): 1, (3, 2): 1}
    log += [((2, 1), False), ((3, 1), True), ((3, 2), True), ((1, 2), True), ((1, 3), True)]
    assert wave() == {(1, 4): 1, (3, 3): 1, (3, 4): 1}             # take 2 has failed for good
    log += [((1, 4), True), ((3, 3), False)]
    assert wave() == {(3, 3): 2}
    assert wave(tries=1) == {}
    changed = R.prompt_digests(spark.createDataFrame(
        [(1, 0, 0, "line 0 0 0 new")], "take_id bigint, grp bigint, line_no bigint, line string"))
    assert changed.first().digest not in of.values()
