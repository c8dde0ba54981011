import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordreel.llm import lattice
from wordreel.llm.base import held_out, tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(PATH)


def paths(pieces, log_p, word):
    """All segmentations of a word, one by one: (log weight, pieces)."""
    of = {p: i for i, p in enumerate(pieces.pieces)}
    text = lattice.START + word

    def walk(at):
        if at == len(text):
            yield 0.0, []
        for end in range(at + 1, len(text) + 1):
            i = of.get(text[at:end])
            if i is not None:
                for w, rest in walk(end):
                    yield log_p[i] + w, [i, *rest]

    return list(walk(0))


@pytest.mark.parametrize("word", [b"the", b"banana", "ñu".encode(), b"x", b"interval"])
def test_forward_sums_all_segmentations(pieces, word):
    ways = paths(pieces, pieces.log_p, word)
    got = pieces.lattice([word]).log_likelihood(pieces.log_p)[0][0]
    assert len(ways) > 1
    assert abs(got - math.log(math.fsum(math.exp(w) for w, _ in ways))) < 1e-9


def test_expected_uses_are_those_of_the_segmentations(pieces):
    ways = paths(pieces, pieces.log_p, b"banana")
    total = math.fsum(math.exp(w) for w, _ in ways)
    want = np.zeros(len(pieces.log_p))
    for w, used in ways:
        for i in used:
            want[i] += 3 * math.exp(w) / total
    got = pieces.lattice([b"banana", b"orange"]).expected(pieces.log_p, np.array([3.0, 0.0]))
    assert np.abs(got - want).max() < 1e-9


def test_long_words_do_not_underflow(pieces):
    word = bytes(range(97, 123)) * 400
    got = pieces.lattice([word]).log_likelihood(pieces.log_p)[0][0]
    assert math.isfinite(got) and got < -5_000


def test_words_of_one_length_cover_all():
    words = [b"a", b"bb", b"c", b"dd" * 900, b"e"]
    seen = sorted(int(i) for part in lattice.same_length(words, 2) for i in part)
    assert seen == list(range(5))


def plain(docs, held):
    """Counts, totals and the base score by plain code."""
    count, n = Counter(), 0
    for i, t in docs:
        if not held(i):
            count.update(lattice.tokens(t or ""))
            n += 1
    tokens = sum(count.values()) + n
    kinds = len(count) + (n > 0)
    out = {}
    for i, t in docs:
        words = lattice.tokens(t or "")
        base = sum(math.log10((count[w] + 1) / (tokens + kinds + 1)) for w in words)
        base += math.log10((n + 1) / (tokens + kinds + 1))
        out.setdefault((i, len(words) + 1), []).append(
            (sum(w in count for w in words) + (n > 0), base))
    return tokens, out


def check(got, docs, held):
    tokens, want = plain(docs, held)
    assert len(got) == len(docs)
    for r in got:
        assert r["train_tokens"] == tokens
        assert any(r["n_known"] == known and abs(r["base_score"] - base) < 1e-6 * max(1, -base)
                   for known, base in want[(r["doc_id"], r["n_tokens"])])
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_given_documents(documents, monkeypatch):
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = lattice.score(documents, held_out("doc_id", 7, 2), group="lang").collect()
    check(got, docs, held)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    # with few words sent and the rest joined nothing changes
    monkeypatch.setattr(lattice, "SHARE", 50)
    again = lattice.score(documents, held_out("doc_id", 7, 2), group="lang").collect()
    one, two = ({r["doc_id"]: r["score"] for r in x} for x in (got, again))
    assert all(abs(one[i] - two[i]) < 1e-6 * max(1, -one[i]) for i in one)


def test_odd_rows(odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    nobody, everybody = (lambda i: False), (lambda i: True)
    check(lattice.score(odd, F.lit(False), group="lang").collect(), docs, nobody)
    check(lattice.score(odd, F.lit(False)).collect(), docs, nobody)
    check(lattice.score(odd, F.lit(True)).collect(), docs, everybody)
    assert lattice.score(empty, F.lit(False)).count() == 0


def test_weights_are_one_distribution(spark):
    # all one-letter words, the end and what is left for longer words add up to one
    rows = [(1, "a b a", "x"), (2, "b c", "y"), (3, "c c c a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn(
        "grp", F.when(F.col("lang") == "x", 0).otherwise(1))
    counts = lattice.word_counts(df, 2)
    model, _ = lattice.weights_of(counts, [2, 1])
    log_p = lattice.fit(counts, PATH, 2, rounds=1)
    scored = {bytes(r["word"]): r for r in lattice.word_paths(counts, log_p, PATH).select(
        "word", "q0", "q1", *model.columns()).collect()}
    for g, end in enumerate(model.ends()):
        whole = 10 ** end + sum(10 ** r[f"s{g}"] for r in scored.values())
        # what the subword paths give to words that were never seen
        d, t, k = model.discount, model.tokens[g], model.kinds[g]
        own = 1 - sum(10 ** r[f"q{g}"] for r in scored.values())
        paths_all = 1 - sum((2 * 10 ** r["q0"] + 10 ** r["q1"]) / 3 for r in scored.values())
        unseen = d * k / t * ((1 - lattice.ELSEWHERE) * own
                              + lattice.ELSEWHERE * model.spare() * paths_all)
        assert abs(whole + unseen - 1) < 1e-9


def test_known_text_is_likelier(documents):
    some = documents.filter("n_chars > 200").limit(40)
    shuffled = some.withColumn("text", F.reverse("text")).withColumn("doc_id", F.col("doc_id") + 10**9)
    both = lattice.score(some.unionByName(shuffled), F.col("doc_id") >= 10**9)
    got = {r["doc_id"]: r["score"] for r in both.collect()}
    assert all(got[i] > got[i + 10**9] for i in got if i < 10**9)
