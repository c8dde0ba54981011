"""Quality by pairwise preference: a Bradley-Terry model on text features.

Each pair of a good and a bad training document is one comparison; the weights
maximise the likelihood that the good one wins, that is the logistic loss on the
difference of their features, over all pairs of all labelled documents. A pair's
loss depends on two scores only, so a pass over the documents sums their features
by class at the points of a fine grid of scores, and points are compared with
points. A document's score is its strength, put on a 0 to 1 scale on which 0.3
stands at the quantile of all training scores that equals the share of bad
documents.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wordreel.llm.base import attach
from wordreel.session import settle

CUT = 0.3
RIDGE = 1e-3
STEPS = 25              # Newton steps at most
ENOUGH = 1e-9           # what a step must promise to gain
GRID = 1 / 64           # between two points; what holds at a score is read off the line between them
POINTS = 8_192          # points at most, whatever the weights
WIDE = 32               # steps of the grid that share their second moments
FIXED = float(1 << 30)  # sums are of whole multiples of 1 / FIXED, so their order does not matter
BUCKETS = 4_096         # ranges of scores counted at once

_CLASS = np.zeros(256, np.int64)        # 0 lower case and the rest
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[[*range(0, 9), 11, 12, *range(14, 32), 127]] = 7
_CLASS[128:] = 8
KINDS = 9
FEATURES = 18


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters and words; all zeros for an empty text."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_CLASS[data], minlength=KINDS) / len(data)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    out[0:7] = np.sqrt(share[[1, 2, 3, 4, 5, 6, 7]])
    out[7] = np.minimum(share[1] * 5, 1)
    out[8] = np.minimum((share[5] + share[6]) * 20, 1)
    out[9] = sum(map(operator.eq, words, words[1:])) / n
    out[10] = min(out[9] * 20, 1)
    out[11] = len(set(words)) / n
    out[12] = 1 - len(set(lines)) / max(len(lines), 1)
    out[13] = min(len(text) / n / 20, 1)
    out[14] = 1 / (1 + np.log1p(n))
    out[15] = sum(len(w) == 1 for w in words) / n
    out[16] = len(max(words, key=len, default="")) > 40
    out[17] = 1
    return out


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float
    scale: float


def strengths(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in one order, so that equal rows score alike in every batch."""
    s = np.zeros(len(x))
    for k, v in enumerate(w):
        s += x[:, k] * v
    return s


def loses(margin: np.ndarray) -> np.ndarray:
    """Probability that the better one of a pair loses."""
    return 1 / (1 + np.exp(np.clip(margin, -30, 30)))


Terms = tuple[float, np.ndarray, np.ndarray]


def newton(at: Callable[[np.ndarray], Terms], size: int) -> np.ndarray:
    """The least of a convex function of `size` weights; `at` gives value, gradient, Hessian."""
    w = np.zeros(size)
    value, grad, hess = at(w)
    for _ in range(STEPS):
        step = np.linalg.solve(hess, grad)
        if grad @ step < ENOUGH:
            break
        now = at(w - step)
        while now[0] > value + GRID ** 2 / 8 and grad @ step > ENOUGH:
            step = step / 2
            now = at(w - step)
        w = w - step
        value, grad, hess = now
    return w


def with_ridge(value: float, grad: np.ndarray, hess: np.ndarray, w: np.ndarray) -> Terms:
    return value + RIDGE / 2 * (w @ w), grad + RIDGE * w, hess + RIDGE * np.eye(len(w))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 1 << 16) -> np.ndarray:
    """Bradley-Terry weights of rows in memory: all pairs, about `pairs` at a time."""
    a, b = x[good], x[~good]
    if not len(a) or not len(b):
        return np.zeros(x.shape[1])
    rows = max(pairs // len(b), 1)

    def at(w: np.ndarray) -> Terms:
        value, grad, hess = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for i in range(0, len(a), rows):
            d = (a[i:i + rows, None] - b).reshape(-1, len(w))
            margin = d @ w
            q = loses(margin)
            value += np.logaddexp(0, -margin).sum()
            grad -= q @ d
            hess += (d * (q * (1 - q))[:, None]).T @ d
        n = len(a) * len(b)
        return with_ridge(value / n, grad / n, hess / n, w)

    return newton(at, x.shape[1])


def grid(w: np.ndarray) -> float:
    return max(GRID, float(np.abs(w).sum()) / POINTS)


def grid_sums(x: np.ndarray, good: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Columns good, place, row and the sums of the features and of ones, FEATURES + 1 columns.

    Row FEATURES + 1 stands for a point: each document counts at the two points
    around its score, by how near they are. The other rows stand for a wide part
    of the grid: row FEATURES for its sums, row i for its sums times feature i.
    """
    s = strengths(x, w) / grid(w)
    place = np.floor(s).astype(np.int64)
    order = np.lexsort((place, good))
    z = np.column_stack([x, np.ones(len(x))])[order]
    good, place, up = good[order].astype(np.int64), place[order], (s - place)[order, None]
    keys, sums = [], []

    def add(by: np.ndarray, row: int, what: np.ndarray, shift: int = 0) -> None:
        at = np.flatnonzero(np.concatenate(
            [[True], (by[1:] != by[:-1]) | (good[1:] != good[:-1])]))
        keys.append([good[at], by[at] + shift, np.full(len(at), row)])
        sums.append(np.add.reduceat(np.rint(what * FIXED).astype(np.int64), at))

    add(place, FEATURES + 1, z * (1 - up))
    add(place, FEATURES + 1, z * up, 1)
    for i in range(FEATURES + 1):
        add(place // WIDE, i, z * z[:, i:i + 1])
    return [*np.concatenate(keys, axis=1), *np.concatenate(sums).T]


def pair_terms(rows: list[np.ndarray], w: np.ndarray) -> Terms:
    """Value, gradient and Hessian of the loss over all pairs, from the sums of `grid_sums`.

    The Hessian only steers the steps; it takes all pairs of two wide parts to
    have the curvature that their mean scores have.
    """
    good, place, row = rows[:3]
    sums = np.column_stack(rows[3:]) / FIXED
    point = row == FEATURES + 1
    low = place[point].min()
    size = int(place[point].max() - low) + 1
    n, x, m, f, h = [], [], [], [], []
    for mine in (good == 1, good == 0):
        at = np.zeros((size, sums.shape[1]))
        at[place[point & mine] - low] = sums[point & mine]
        n.append(at[:, -1])
        x.append(at[:, :-1])
        mine = mine & ~point
        wide, to = np.unique(place[mine], return_inverse=True)
        part = np.zeros((len(wide), sums.shape[1], sums.shape[1]))
        part[to, row[mine]] = sums[mine]
        m.append(part[:, -1, -1])
        f.append(part[:, -1, :-1])
        h.append(part[:, :-1, :-1])
    margin = np.arange(1 - size, size) * grid(w)
    q = loses(margin)

    def against(those: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        return np.convolve(those, kernel)[size - 1:2 * size - 1]

    value = n[0] @ against(n[1], np.logaddexp(0, -margin))
    grad = against(n[0], q[::-1]) @ x[1] - against(n[1], q) @ x[0]
    mean = [(b @ w) / a for a, b in zip(m, f)]
    q = loses(mean[0][:, None] - mean[1])
    bend = q * (1 - q)
    cross = f[0].T @ bend @ f[1]
    hess = (np.tensordot(bend @ m[1], h[0], 1) + np.tensordot(m[0] @ bend, h[1], 1)
            - cross - cross.T)
    total = n[0].sum() * n[1].sum()
    return with_ridge(value / total, grad / total, hess / total, w)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x_").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit_grid(known: DataFrame) -> np.ndarray:
    """Bradley-Terry weights over all pairs of rows with q_ = 1 and q_ = 0.

    One job a step. What returns to the driver is bounded by the grid.
    """
    names = ["good", "place", "row", *[f"v{k}" for k in range(FEATURES + 1)]]

    def at(w: np.ndarray) -> Terms:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    good = batch.column("q_").to_numpy(zero_copy_only=False) == 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=pa.int64()) for c in grid_sums(matrix(batch), good, w)],
                        names=names)

        got = (known.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
               .groupBy(*names[:3]).agg(*[F.sum(c).alias(c) for c in names[3:]]).toArrow())
        return pair_terms([got.column(c).to_numpy() for c in names], w)

    return newton(at, FEATURES)


def threshold_at(scores: np.ndarray, weight: np.ndarray, share: float) -> float:
    """Half way between the scores on either side of the weighted quantile `share`."""
    order = np.argsort(scores, kind="stable")
    s, below = scores[order], np.cumsum(weight[order]) / weight.sum()
    k = int(np.searchsorted(below, share, side="right"))
    k = min(max(k, 1), len(s) - 1) if len(s) > 1 else 0
    return float((s[k - 1] + s[k]) / 2) if len(s) > 1 else float(s[0])


def threshold_of(scores: DataFrame, bad: int, n: int, lo: float, hi: float) -> float:
    """`threshold_at` the share bad / n of the column s_ of `n` rows from `lo` to `hi`.

    The range that holds the row of rank `bad` is cut into buckets until it is one value.
    """
    below, after = 0, hi
    while lo < hi:
        place = (F.col("s_") - F.lit(lo)) / F.lit(hi - lo) * F.lit(BUCKETS)
        got = sorted(scores.filter(F.col("s_").between(lo, hi))
                     .groupBy(F.least(F.floor(place), F.lit(BUCKETS - 1)).alias("b"))
                     .agg(F.min("s_").alias("lo"), F.max("s_").alias("hi"),
                          F.count(F.lit(1)).alias("n")).collect())
        k = int(np.searchsorted(below + np.cumsum([r["n"] for r in got]), bad))
        if k + 1 < len(got):
            after = got[k + 1]["lo"]
        below += sum(r["n"] for r in got[:k])
        lo, hi, upto = got[k]["lo"], got[k]["hi"], below + got[k]["n"]
        if lo == hi and upto == bad:
            return threshold_at(np.array([lo, after]), np.array([bad, n - bad]), bad / n)
    return lo


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id",
          text: str = "text", quality: str = "quality") -> Model:
    """A model from all labelled documents.

    `learn` is a condition on the key. Labels are 0 or 1; others and null ones
    are left out, of several labels of a document the lowest holds. Without
    documents of both classes every document scores the same.
    """
    marked = (labels.select(F.col(key).alias("k_"), F.col(quality).cast("int").alias("q_"))
              .filter("q_ IN (0, 1) AND k_ IS NOT NULL").groupBy("k_").agg(F.min("q_").alias("q_")))
    marked = marked.withColumn(key, F.col("k_")).filter(learn).drop(key)
    rows = (docs.filter(learn).select(F.col(key).alias("k_"), F.col(text).alias("t_"))
            .filter("k_ IS NOT NULL"))
    # texts stay where they are, their features go to the labels
    rows = attach(rows, "t_", lambda: lambda ts: [[features(t).tolist() for t in ts]],
                  [T.StructField("x_", T.ArrayType(T.DoubleType()))]).drop("t_")
    known = settle(rows.join(marked, "k_").select("q_", "x_"), "quality-features")
    count = {r["q_"]: r["n"] for r in
             known.groupBy("q_").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return Model((0.0,) * FEATURES, 0.0, 1.0)
    w = fit_grid(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(strengths(matrix(batch), w))], names=["s_"])

    scores = settle(known.select("x_").mapInArrow(run, "s_ double"), "quality-scores")
    lo, hi = scores.agg(F.min("s_"), F.max("s_")).first()
    n = count[0] + count[1]
    t = threshold_of(scores, count[0], n, lo, hi)
    if lo == hi:
        return Model(tuple(w.tolist()), t, 4.0)
    d = (F.col("s_") - F.lit(lo)) / F.lit(hi - lo)
    first, second = scores.agg(F.sum(F.round(d * FIXED).cast("long")),
                               F.sum(F.round(d * d * FIXED).cast("long"))).first()
    spread = (hi - lo) * max(second / FIXED / n - (first / FIXED / n) ** 2, 0.0) ** 0.5 or 1.0
    return Model(tuple(w.tolist()), t, 4 / spread)


def scorer(model: Model):
    w = np.array(model.weights)
    shift = np.log(CUT / (1 - CUT))

    def many(texts: list) -> tuple[list, list]:
        if not texts:
            return [], []
        s = strengths(np.array([features(t) for t in texts]), w)
        p = 1 / (1 + np.exp(-np.clip((s - model.threshold) * model.scale + shift, -700, 700)))
        p = np.where(s >= model.threshold, np.maximum(p, CUT), np.minimum(p, np.nextafter(CUT, 0)))
        return p.tolist(), (p >= CUT).astype(np.int32).tolist()

    return many


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= 0.3).

    Null counts as empty; both score as a text whose every share is 0. Repeated
    rows score alike.
    """
    fields = [T.StructField(f"{prefix}score", T.DoubleType()),
              T.StructField(f"{prefix}predicted", T.IntegerType())]
    return attach(docs, text, lambda: scorer(model), fields)
