import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordreel.llm import language, quality
from wordreel.llm.base import held_out

EN = "the old house by the lake was sold and nobody knew who would live there next "
DE = "das alte haus am see wurde verkauft und niemand wusste wer dort wohnen sollte "


@pytest.fixture(scope="module")
def two_languages(spark):
    rows = [(i, (EN if i % 2 else DE) * 4 + str(i), "en" if i % 2 else "de") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_of_unseen_text(spark, two_languages, odd):
    model = language.train(two_languages, F.lit(True))
    assert {lang for lang, _ in model.dictionaries} == {"en", "de"}
    texts = [(1, "nobody would live there by the lake next"), (2, "wer sollte dort am see wohnen"),
             (3, None), (4, ""), (5, "12 !! 34")]
    got = {r["doc_id"]: r for r in language.predict(
        spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    for i in (3, 4, 5):
        assert got[i]["lang_pred"] == language.UNKNOWN and got[i]["rejected"]
    out = language.predict(odd, model, prefix="p_")
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns


def test_every_language_has_a_dictionary_however_many_there_are(spark, monkeypatch):
    rng = np.random.default_rng(0)
    letters = [chr(c) for c in [*range(97, 123), *range(0x430, 0x450), *range(0x3B1, 0x3C9)]]
    rows, words = [], {}
    for k in range(600):
        words[k] = ["".join(rng.choice(letters, 7)) for _ in range(6)]
        rows += [(k * 3 + j, " ".join(rng.choice(words[k], 40)), f"l{k:03}") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(4)
    monkeypatch.setattr(language, "MODEL_BYTES", 600 * 400)
    model = language.train(docs, F.lit(True))
    assert len(model.dictionaries) == 600
    assert sum(len(raw) for _, raw in model.dictionaries) <= language.MODEL_BYTES
    predict = language.predictor(model)
    asked = range(0, 600, 50)
    got = predict([" ".join(rng.choice(words[k], 30)) for k in asked])[0]
    assert list(got) == [f"l{k:03}" for k in asked]


def test_clashing_names_are_refused(spark, odd, two_languages):
    with pytest.raises(ValueError):
        language.predict(odd, language.train(two_languages, F.lit(True)))


def test_nothing_to_learn_from(empty, odd):
    model = language.train(empty, F.lit(True))
    assert model.dictionaries == ()
    got = language.predict(odd, model, prefix="p_").collect()
    assert {r["p_lang_pred"] for r in got} == {language.UNKNOWN}
    assert language.predict(empty, model, prefix="p_").count() == 0


def test_equal_sizes_are_rejected():
    many = language.predictor(language.Model((("a", b"xyz"), ("b", b"xyz"))))
    lang, score, margin, rejected = many(["some text"])
    assert (lang[0], score[0], margin[0], rejected[0]) == ("a", 0.5, 0.0, True)


def test_clean_short_texts_stay(two_languages):
    many = language.predictor(language.train(two_languages, F.lit(True)))
    texts = ["Who.", "The old", "knew", "Wer.", "Das alte", "und"]
    lang, score, margin, rejected = many(texts)
    assert lang == ("en", "en", "en", "de", "de", "de") and not any(rejected)
    assert min(margin) >= language.MIN_MARGIN and min(score) > 0.5


def test_clean_short_documents_pass_the_stage(spark, documents):
    import corpus_pipeline

    short = documents.filter("length(text) < 40 AND text RLIKE '[a-z]{3}'")
    ids = [(10**6 + i, t, lang) for i, (t, lang) in enumerate(
        [("This.", "en"), ("Der Weg.", "de"), ("La vie.", "fr"), ("El camino", "es")])]
    more = spark.createDataFrame(ids, "doc_id bigint, text string, lang string")
    docs = documents.unionByName(more, allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert kept >= {i for i, _, _ in ids} | {r["doc_id"] for r in short.collect()}


def test_all_sampled_documents_share_the_dictionary(spark):
    rows = [(i, f"mark{chr(97 + i // 26)}{chr(97 + i % 26)} " * 2_000 + "ending " * 2_000, "en")
            for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    raw = language.train(df, F.lit(True), dictionary_bytes=10_000).dictionaries[0][1]
    assert len(raw) <= 10_000 and b"ending" in raw
    assert len(set(re.findall(rb"mark\w\w", raw))) > 15
    parts = language.shared([b"a" * 5, b"b" * 900, b"c" * 900], 300)
    assert len(parts) <= 300 and parts.count(b"a") == 5 and abs(
        parts.count(b"b") - parts.count(b"c")) < 3 and parts.count(b"b") > 140


def test_long_text_is_judged_whole(two_languages):
    many = language.predictor(language.train(two_languages, F.lit(True)))
    mixed = EN * 30 + DE * 3_000
    assert many([mixed])[0][0] == "de"


def test_held_out_languages(documents):
    model = language.train(documents, ~held_out("doc_id", 5))
    got = language.predict(documents.filter(held_out("doc_id", 5)), model, prefix="p_").select(
        F.avg((F.col("p_lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert got > 0.9


def test_held_out_is_the_remainder_of_the_checksum(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint")
    for r in rows.select("doc_id", held_out("doc_id", 5).alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    null = spark.createDataFrame([(None,)], "doc_id bigint")
    assert null.select(held_out("doc_id", 5)).first()[0]


# --- quality --------------------------------------------------------------

def test_pairs_order_what_is_preferred():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    good = x[:, 0] - 0.5 * x[:, 1] > 0
    w = quality.fit_pairs(x, good, pairs=5_000)
    s = x @ w
    assert (s[good][:, None] > s[~good]).mean() > 0.98


def test_threshold_stands_at_the_share():
    s = np.arange(10.0)
    assert quality.threshold_at(s, np.ones(10), 0.3) == 2.5
    assert quality.threshold_at(s, np.ones(10), 0.0) == 0.5


def test_held_out_labels(spark, documents):
    from tests.llm.conftest import SF

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents, labels, ~held_out("doc_id", 5))
    got = quality.score(documents, model, prefix="q_").join(labels, "doc_id").filter(
        held_out("doc_id", 5))
    assert got.select(F.avg((F.col("q_predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    bad = got.filter((F.col("q_score") < 0) | (F.col("q_score") > 1)
                     | ((F.col("q_score") >= 0.3) != (F.col("q_predicted") == 1)))
    assert bad.count() == 0


def test_odd_rows_are_scored(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (5, None), (6, 7)],
                                   "doc_id bigint, quality int")
    model = quality.train(odd, labels, F.lit(True))
    got = quality.score(odd, model, prefix="q_").collect()
    assert len(got) == 12 and all(0 <= r["q_score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"] or "", r["q_score"]) == r["q_score"]
    assert quality.score(empty, model, prefix="q_").count() == 0


def test_labels_of_one_class_teach_nothing(spark, odd):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    model = quality.train(odd, labels, F.lit(True))
    assert {round(r["q_score"], 6) for r in quality.score(odd, model, prefix="q_").collect()} == {0.3}


def marked_texts(spark, n):
    """Texts with labels that their capitals only hint at, and their features in memory."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghij    XYZ12.,!?\n"))
    texts = ["".join(rng.choice(letters, 80)) for _ in range(n)]
    x = np.array([quality.features(t) for t in texts])
    good = x[:, 0] - np.median(x[:, 0]) + 0.1 * rng.normal(size=n) < 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)],
                                   "doc_id bigint, quality int")
    return docs, labels, x, good


def test_all_labelled_documents_are_learned_from(spark):
    docs, labels, x, good = marked_texts(spark, 18_000)
    assert min(good.sum(), (~good).sum()) > 8_000
    model = quality.train(docs, labels, F.lit(True))
    s = quality.strengths(x, np.array(model.weights))
    bad, ordered = int((~good).sum()), np.sort(s)
    assert ordered[bad - 1] < ordered[bad]
    assert model.threshold == (ordered[bad - 1] + ordered[bad]) / 2
    assert model.scale == pytest.approx(4 / s.std(), rel=1e-6)
    got = quality.score(docs, model, prefix="q_")
    assert got.filter("q_predicted = 0").count() == bad
    assert quality.train(docs.repartition(3), labels, F.lit(True)) == model


def test_weights_are_those_of_all_pairs(spark):
    docs, labels, x, good = marked_texts(spark, 500)
    model = quality.train(docs, labels, F.lit(True))
    d = (x[good][:, None] - x[~good]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(20):
        q = quality.loses(d @ w)
        hess = (d * (q * (1 - q))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w))
        w -= np.linalg.solve(hess, quality.RIDGE * w - q @ d / len(d))
    assert np.abs(np.array(model.weights) - w).max() < 2e-3 * np.abs(w).max()
    assert np.allclose(quality.fit_pairs(x, good, pairs=1_000), w, atol=2e-3 * np.abs(w).max())


@pytest.mark.parametrize("values", [
    [0.0, 1.0], [2.5] * 7, [-1e9, 0.1, 0.1, 0.1, 0.1 + 1e-16, 0.1 + 1e-12, 7.0],
    [1.0, 2.0, 2.0, 2.0, 3.0], [0.1 * i ** 3 - 40 for i in range(30)], [5e-324, 0.0, -5e-324, 1e300]])
def test_threshold_of_spread_out_scores(spark, monkeypatch, values):
    monkeypatch.setattr(quality, "BUCKETS", 4)
    s, n = np.sort(values), len(values)
    scores = spark.createDataFrame([(v,) for v in values], "s_ double").repartition(2).cache()
    for bad in {1, n // 3 + 1, n // 2, n - 1}:
        got = quality.threshold_of(scores, bad, n, float(s[0]), float(s[-1]))
        assert got == quality.threshold_at(s, np.ones(n), bad / n) == (s[bad - 1] + s[bad]) / 2
