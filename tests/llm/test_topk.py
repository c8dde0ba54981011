import math
import random

import pytest
from pyspark.sql import functions as F

from wordreel.llm import topk


def brute(rows, is_query, k):
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in fit if is_query(i)}):
        best = sorted((-max(sum(a * b for a, b in zip(u, v)) for j, u in fit if j == q), i)
                      for i, v in fit if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])}
    return out


def got(df, k=20):
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k)
            .select("query_id", "rank", "vec_id", "score").collect()}


SCHEMA = "vec_id bigint, embedding array<float>, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("shard,block", [(4096, 1024), (16, 3)])
def test_random_vectors(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", block)
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 0.2), 3) for _ in range(20)]) for i in range(230)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]      # ties
    df = frame(spark, rows).repartition(5)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(df, 7) == brute(rows, lambda i: i % 20 == 0, 7)


def test_odd_vectors(spark):
    rows = [(0, [0.5, -0.5]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]),
            (80, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [0.25, 0.25]), (2, [0.25, 0.25]),
            (3, []), (4, [-1.0, 1.0]), (100, [0.1, 0.1])]
    assert got(frame(spark, rows)) == brute(rows, lambda i: i % 20 == 0, 20)
    assert got(frame(spark, [])) == set()
    assert got(frame(spark, [(0, [1.0])])) == set()


def test_large_components_stay_exact(spark):
    rows = [(i, [float(10**7 + i), float(3 * 10**6 - i)]) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(df) == brute(rows, lambda i: i % 20 == 0, 20)


def test_huge_components_are_held_in_a_long(spark):
    """Finite floats of any size: components and scores end where a 64-bit integer ends."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([3e38, -3e38, 1e17, -1e9, 0.5]) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    hold = lambda x: min(max(x, topk.LEAST), topk.MOST)
    v = {r["vec_id"]: [min(max(math.floor(64 * x), -(1 << 63)), topk.MOST) for x in r["embedding"]]
         for r in df.collect()}
    want = set()
    for q in range(0, 60, 20):
        best = sorted((-hold(sum(a * b for a, b in zip(v[q], v[i]))), i) for i in v if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:20])}
    assert got(df) == want


def test_bounds_keep_every_competitive_row():
    import numpy as np

    rng = np.random.default_rng(1)
    shard = rng.integers(-30, 30, (24, 500)).astype(float)
    query = rng.integers(-30, 30, 24).astype(float)
    scores = query @ shard
    low, high = shard.min(axis=1), shard.max(axis=1)
    for t in (None, int(np.sort(scores)[-20]), int(scores.max()), int(scores.max()) + 1):
        rows, s = topk.max_score(query, shard, low, high, t)
        assert (scores[rows[: len(s)]] == s).all()
        must = set(np.flatnonzero(scores >= t)) if t is not None else set(range(500))
        assert must <= set(rows[: len(s)].tolist())
