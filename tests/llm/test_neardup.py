import random
import re

import numpy as np
from pyspark.sql import functions as F

from wordreel.llm import neardup


def plain_classes(docs, least=0.8):
    """Components of documents by plain Jaccard similarity of their five-word shingles."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else {t or ""}
    root = {i: i for i in sets}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[max(of(a), of(b))] = min(of(a), of(b))
    return {i: of(i) for i in ids}


def made(n=60, copies=12, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        docs.append((len(docs), " ".join(rng.choices(vocab, k=rng.randrange(60, 160)))))
    for i in range(copies):         # near copies: one word in about a hundred changed
        words = docs[0][1].split()
        words[rng.randrange(len(words))] = f"new{i}"
        docs.append((len(docs), " ".join(words)))
    for i in range(5):
        docs.append((len(docs), docs[1][1]))
    half = docs[2][1].split()       # half of a text is no near copy
    docs.append((len(docs), " ".join(half[: len(half) // 2] + rng.choices(vocab, k=60))))
    return docs


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in neardup.classify(df).collect()}


def test_classes_of_made_copies(spark):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert classes(df) == plain_classes(docs)


def test_given_documents(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got, want = classes(documents), plain_classes(docs)
    same = sum(got[i] == want[i] for i in want)
    assert same >= len(want) - 2        # a pair right at the threshold may fall either way


def test_odd_rows(odd, empty):
    got = neardup.classify(odd).collect()
    assert len(got) == odd.count()
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts))
    # null and empty are one class, the repeated row stays once, upper case is a copy
    assert sum(1 for _, t in texts if not t) == 1
    assert sum(1 for _, t in texts if t and t.lower().startswith("the house")) == 1
    assert {i for i, _ in texts} >= {5, 6, 7, 9}
    assert neardup.classify(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_long_common_passage_links_nothing(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(90)) + " " + passage)
            for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert len(set(classes(df).values())) == 80


def test_samples_agree_as_often_as_sets_are_alike():
    sampler = neardup.Sampler(rows=1, bands=400)
    a = np.arange(0, 90, dtype=np.uint64) * np.uint64(7919)
    b = np.arange(10, 100, dtype=np.uint64) * np.uint64(7919)
    shingle = np.concatenate([a, b])
    keys = sampler.keys(np.array([0, 90, 180]), shingle, np.ones(180, np.float32))
    assert abs((keys[0] == keys[1]).mean() - 0.8) < 0.07


def test_weights_count_in_the_similarity():
    a = (np.array([1, 2], np.uint64), np.array([1.0, 3.0], np.float32))
    b = (np.array([2, 5], np.uint64), np.array([2.0, 1.0], np.float32))
    assert abs(neardup.weighted_jaccard(a, b) - 2 / 5) < 1e-6


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(200)],
                                  "a string, b string")
    got = neardup.components(links)
    assert got.select("class").distinct().count() == 1 and got.count() == 201
    assert neardup.components(links.filter("false")).count() == 0


def test_frequent_shingles_weigh_less(spark):
    docs = [(i, f"all of these words are common then x{i} y{i} z{i} u{i} v{i} w{i}")
            for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    idf = neardup.idf_table(df, counters=1 << 16)
    _, shingle, _ = neardup.Shingler().sets(["all of these words are", "x1 y1 z1 u1 v1"])
    w = idf[(shingle & np.uint64(len(idf) - 1)).astype(int)]
    assert 1 <= w.min() < w.max() <= 1 + neardup.IDF_SHARE
    common, rare = (idf[int(neardup.Shingler().sets([t])[1][0]) & (len(idf) - 1)]
                    for t in ("all of these words are", "x1 y1 z1 u1 v1"))
    assert common < rare


def test_class_size_counts_rows(spark):
    df = spark.createDataFrame(made(), "doc_id bigint, text string")
    got = neardup.classify(df)
    n = got.groupBy("class_id").agg(F.count("*").alias("n"), F.max("class_size").alias("m"),
                                    F.sum(F.col("kept").cast("int")).alias("k"))
    assert n.filter("n <> m OR k <> 1").count() == 0


def brute_classes(spark, docs, least=0.8):
    """Components of documents by weighted Jaccard similarity of all pairs."""
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    idf = neardup.idf_table(df)
    bounds, shingle, times = neardup.Shingler().sets([t for _, t in docs])
    w = neardup.weights(shingle, times, idf)
    names, token = np.unique(shingle, return_inverse=True)
    total = np.array([w[a:b].sum() for a, b in zip(bounds, bounds[1:])])
    dense = np.zeros((len(docs), len(names)), np.float32)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        dense[i, token[a:b]] = w[a:b]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        mine = token[bounds[i]: bounds[i + 1]]
        both = np.minimum(dense[i + 1:, mine], dense[i, mine]).sum(axis=1)
        for j in np.flatnonzero(both >= least * (total[i] + total[i + 1:] - both)) + i + 1:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return df.repartition(5), {docs[i][0]: docs[r][0] for i, r in enumerate(root)}


def families(n, seed):
    """Texts of one template in pairs that are alike only to each other, and a chain of versions."""
    rng = random.Random(seed)
    said = lambda k: [f"s{rng.randrange(10**7)}" for _ in range(k)]
    template, docs = said(70), []
    for _ in range(n):
        words = template + said(40)
        docs.append(" ".join(words))
        words[90 + rng.randrange(15)] = said(1)[0]
        docs.append(" ".join(words))
    version = said(100)
    for _ in range(n):
        version[rng.randrange(100)] = said(1)[0]
        version[rng.randrange(100)] = said(1)[0]
        docs.append(" ".join(version))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_families_equal_brute_force(spark):
    df, want = brute_classes(spark, families(700, 11))
    assert len(set(want.values())) > 100
    assert classes(df) == want


def test_blocks_hold_every_pair(spark):
    rng = random.Random(2)
    rows = [("k", f"n{i:03}", "big" if i < 60 else f"n{i:03}", rng.uniform(20, 60), 100)
            for i in range(150)]
    df = spark.createDataFrame(
        [(1, *r[1:]) for r in rows], "key bigint, node string, class string, weight double, size bigint")
    met = set()
    by_piece = {}
    for r in neardup.block_pairs(df, 0.8, block=16).collect():
        by_piece.setdefault(r["piece"], []).append((r["block"], r["node"]))
    for piece in by_piece.values():
        single = len({b for b, _ in piece}) == 1
        assert len(piece) < 80
        met |= {tuple(sorted((x, y))) for a, x in piece for b, y in piece
                if x != y and (single or a != b)}
    want = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[2] != y[2]
            and min(x[3], y[3]) >= 0.8 * max(x[3], y[3])}
    assert want <= met
