"""Exact top-k by inner product with MaxScore.

Components are terms, vectors are documents; in a shard of vectors a query's
terms are ordered by the most that each can add there. The terms whose bounds
together cannot lift a vector over the k-th best score so far are non-essential:
only the others are scored for all vectors, and the rest is probed, term group by
term group, for those that can still get there.

Shards are dealt once, some to a lane; a task keeps the shards of its lane and
takes one block of queries after the other through them, so the threshold rises
from shard to shard. Vectors are shuffled once, queries once per lane, and of a
lane come k rows per query, which are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wordreel.session import settle

K = 20
SHARD = 4_096           # vectors of a shard
LANE = 16               # shards of a lane, about; a task holds one lane in memory
QUERIES = 1_024         # queries of a block
GROUP = 8               # terms probed at a time
SCALE = 64


def quantised(df: DataFrame, vector: str, key: str, scale: int = SCALE) -> DataFrame:
    """(id, v): components as floor(scale * x); rows that cannot take part are left out.

    These are null and empty vectors and those with a null or non-finite
    component, and rows without an id. A finite component beyond a 64-bit integer
    counts as the end of that range, and so does a score; equal scores go by id.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    inf = F.lit(math.inf)
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return (df.select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fit & (F.size("v") > 0))
            .select("id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v")))


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(ids, data, kind): vectors packed by `rows`, in every task on its own, one row per block.

    `kind` is the narrowest type that holds the block's components.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[int]] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= rows:
                yield packed(ids[:rows], vectors[:rows])
                del ids[:rows], vectors[:rows]
        if ids:
            yield packed(ids, vectors)

    def packed(ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        width = max(map(len, vectors))
        flat = np.zeros((len(ids), width), "<i8")       # shorter vectors end in zeros
        for i, v in enumerate(vectors):
            flat[i, : len(v)] = v
        kind = next(k for k in KINDS if flat.min() >= np.iinfo(k).min
                    and flat.max() <= np.iinfo(k).max)
        return pa.RecordBatch.from_arrays(
            [pa.array([np.array(ids, "<i8").tobytes()]), pa.array([flat.astype(kind).tobytes()]),
             pa.array([kind])], names=["ids", "data", "kind"])

    return df.mapInArrow(run, "ids binary, data binary, kind string")


KINDS = ("<i2", "<i4", "<i8")


def _matrix(ids: bytes, data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, kind).reshape(len(i), -1)


class Best:
    """The k best of every query of a block so far; ties go to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.id: list[np.ndarray] = [np.zeros(0, np.int64)] * queries

    def threshold(self, q: int) -> int | None:
        """A score below this cannot enter; lower ones may yet count as the end of the range."""
        full = len(self.score[q]) == self.k and self.score[q][-1] > LEAST
        return int(self.score[q][-1]) if full else None

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[q], score])
        i = np.concatenate([self.id[q], ids])
        if len(s) > 4 * self.k:         # what is below the k-th best need not be sorted
            least = np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[s >= least], i[s >= least]
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]


def exact_type(*matrices: np.ndarray) -> type:
    """Floats if every inner product is exact in them, else 64-bit or Python's integers."""
    most = 2        # a bound is a difference of two products
    for m in matrices:
        most *= max(int(m.max(initial=0)), -int(m.min(initial=0)), 1)
    most *= matrices[0].shape[1]
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


LEAST, MOST = 1 - (1 << 63), (1 << 63) - 1


def as_long(score: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond count as the end of the range."""
    if score.dtype == object:
        score = np.array([min(max(int(s), LEAST), MOST) for s in score], np.int64)
    return score.astype(np.int64)


def essential(gain: np.ndarray, least: int, threshold: int | None) -> int:
    """How many terms, of descending gain, are essential.

    A vector whose essential terms all add their least scores below `threshold`
    whatever its other terms add: before the last essential term no vector can
    be ruled out, after it some can. Without a threshold all terms are essential.
    """
    if threshold is None:
        return len(gain)
    left = np.cumsum(gain[::-1])[::-1]      # what a term and those after it can add
    return int(np.count_nonzero(np.asarray(left + least >= threshold, bool)))


def max_score(query: np.ndarray, shard: np.ndarray, low: np.ndarray, high: np.ndarray,
              threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `shard` (terms by vectors) that may score `threshold` or more, and their scores."""
    up = query >= 0
    bound = np.where(up, query * high, query * low)     # the most a term can add
    worst = np.where(up, query * low, query * high)     # and the least
    order = np.argsort(worst - bound, kind="stable")
    n = essential((bound - worst)[order], worst.sum(), threshold)
    rows = np.arange(shard.shape[1])
    if n == len(order):
        score = query @ shard
        if threshold is not None:
            keep = np.asarray(score >= threshold, bool)
            rows, score = rows[keep], score[keep]
        return rows, score
    if n == 0:
        return rows[:0], np.zeros(0, query.dtype)
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)    # what terms from here on can add
    score = query[order[:n]] @ shard[order[:n]]
    while True:
        keep = np.asarray(score + rest[n] >= threshold, bool)
        rows, score = rows[keep], score[keep]
        if n == len(order) or not len(rows):
            return rows, score
        terms = order[n: n + GROUP]
        score = score + query[terms] @ shard[np.ix_(terms, rows)]
        n = min(n + GROUP, len(order))


def search(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query by inner product.

    Both sides are (id, v) with integer components; vectors of different lengths
    meet as if the shorter one ended in zeros. A row is no candidate of a query
    with the same id. Ties go to the smaller id; a query with fewer candidates
    gets all of them. Rows that repeat an id are candidates each. No queries or
    no rows give no result.
    """
    spark = rows.sparkSession
    shards = settle(_blocks(rows, SHARD), "shards")
    n = shards.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, -(-n // LANE), min(n, tasks))
    # the stated queries against all rows, block by block: a lane's shards, then all query blocks
    dealt = shards.select(
        F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"),
        F.lit(False).alias("asks"), "ids", "data", "kind")
    asked = _blocks(queries, QUERIES).select(
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.lit(True).alias("asks"), "ids", "data", "kind")
    met = (dealt.unionByName(asked).repartitionById(lanes, "lane")
           .sortWithinPartitions("lane", "asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for lane, asks, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if lane != now:
                    now, held = lane, []
                if not asks:
                    held.append(_matrix(*block))
                    continue
                ids, block = _matrix(*block)
                best = Best(len(ids), k)
                for row_ids, shard in held:
                    step(ids, block, row_ids, shard, best)
                yield result(ids, best)

    def step(ids, block, row_ids, shard, best: Best) -> None:
        width = max(block.shape[1], shard.shape[1])
        block = np.pad(block, ((0, 0), (0, width - block.shape[1])))
        shard = np.pad(shard, ((0, 0), (0, width - shard.shape[1])))
        kind = exact_type(block, shard)
        block, shard = block.astype(kind), np.ascontiguousarray(shard.T.astype(kind))
        low, high = shard.min(axis=1), shard.max(axis=1)
        for q in range(len(ids)):
            rows_at, score = max_score(block[q], shard, low, high, best.threshold(q))
            other = row_ids[rows_at] != ids[q]
            best.add(q, as_long(score[other]), row_ids[rows_at[other]])

    def result(ids: np.ndarray, best: Best) -> pa.RecordBatch:
        n = [len(s) for s in best.score]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best.id)),
             pa.array(np.concatenate(best.score))], names=["query_id", "vec_id", "score"])

    some = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k(df: DataFrame, is_query: Column, vector: str = "embedding", key: str = "vec_id",
          k: int = K, scale: int = SCALE) -> DataFrame:
    """`search` of the rows of a table that meet a condition on the key, among all others."""
    rows = quantised(df, vector, key, scale)
    queries = quantised(df.filter(is_query), vector, key, scale)
    return search(queries, rows, k)
