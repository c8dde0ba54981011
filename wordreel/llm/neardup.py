"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

Pass 1 counts in how many documents each five-word shingle stands, in a table of
a fixed number of hashed counters. Pass 2 draws improved consistent weighted
samples of each document's weighted shingles; samples are banded into keys. First
every text is compared with the most central text that it shares a bucket with.
Pairs are verified by exact weighted Jaccard similarity and linked texts get one
class. Then every bucket that still holds several classes is compared exhaustively:
all pairs of its texts that are not of one class and whose weights allow the
similarity. Large buckets are cut into blocks by weight and each pair of blocks is
a piece of work of bounded size, so no bucket lands in one task. No pair that shares
a key is left out; a family of m texts that stay apart costs about m * m / 2
comparisons, but only m * m / BLOCK rows.

Equal texts are one node from the start, so copies cost nothing beyond their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordreel.llm.base import CHUNK, U64, Powers, chunks, mix, word_spans
from wordreel.session import settle

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 3, 14         # 0.8 similar texts share a band with probability 0.9999
BLOCK = 512                 # texts of a bucket that are compared in one piece, about
BLOCK_CHARS = 1 << 21       # and their characters
COUNTERS = 1 << 18          # hashed document-frequency counters
IDF_SHARE = 0.25            # how much the rarest shingle weighs more than one that all texts have
SAMPLES = 1 << 16           # size of the tables that the samples' random numbers come from


# --- shingles -------------------------------------------------------------

class Shingler:
    """Sets of shingles of many texts at a time."""

    def __init__(self, words: int = WORDS):
        self.words, self.powers = words, Powers()
        self.order = [U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(words)]

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of each text in (shingle, times): 48-bit hashes, ascending within a text.

        A text of fewer words than a shingle has is one shingle; one without
        words has none.
        """
        low = [t.lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b" ".join(low), np.uint8)
        start, end = word_spans(data)
        word = self.powers.span(self.powers.sums(data), start, end) if len(start) \
            else np.zeros(0, U64)
        ends = np.cumsum([len(t) + 1 for t in low])
        doc = np.searchsorted(ends, start, side="right")
        count = np.bincount(doc, minlength=len(low))
        first = np.cumsum(count) - count
        k = self.words
        if len(word) >= k:
            full = word[: len(word) - k + 1] * self.order[0]
            for i in range(1, k):
                full += word[i: len(word) - k + 1 + i] * self.order[i]
            same = doc[: len(full)] == doc[k - 1:]
            full, owner = full[same], doc[: len(same)][same]
        else:
            full, owner = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            brief = [np.add.reduce(word[first[d]: first[d] + count[d]]
                                   * np.array(self.order[: count[d]])) for d in short]
            full = np.concatenate([full, np.array(brief, U64)])
            owner = np.concatenate([owner, short])
        key = (owner.astype(U64) << U64(48)) | (mix(full) >> U64(16))
        key, times = np.unique(key, return_counts=True)
        bounds = np.searchsorted(key >> U64(48), np.arange(len(low) + 1, dtype=U64))
        return bounds, key & U64((1 << 48) - 1), times


def text_chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    for a, b in chunks(texts):
        for c in range(a, b, 1 << 15):      # a chunk's texts are numbered in 16 bits
            yield c, texts[c: min(b, c + (1 << 15))]


# --- weights --------------------------------------------------------------

def idf_table(docs: DataFrame, counters: int = COUNTERS, share: float = IDF_SHARE,
              words: int = WORDS) -> np.ndarray:
    """A weight for every hashed counter, from all texts (column `text`).

    The mean load that chance puts on a counter is taken off, so a counter that
    holds no frequent shingle counts as one rare one. Weights go from 1 for a
    shingle of all texts to 1 + share. The table's size does not follow the data.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shingler, rows = np.zeros(counters, np.int64), Shingler(words), 0
        for batch in batches:
            rows += batch.num_rows
            for _, texts in text_chunks(batch, "text"):
                _, shingle, _ = shingler.sets(texts)
                total += np.bincount((shingle & U64(counters - 1)).astype(np.int64),
                                     minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))],
            names=["counter", "n"])

    got = (docs.select("text").mapInArrow(count, "counter int, n bigint")
           .groupBy("counter").agg(F.sum("n").alias("n")).toPandas())
    at, n = got["counter"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    total = np.zeros(counters)
    total[at[at >= 0]] = n[at >= 0]
    docs_n = float(n[at < 0].sum())
    load = (total.sum() - total) / (counters - 1)
    df = np.clip(total - load, 1, max(docs_n, 1))
    return (1 + share * np.log((1 + docs_n) / (1 + df)) / np.log(2 + docs_n)).astype(np.float32)


def weights(shingle: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times inverse document frequency."""
    tf = 1 + np.log(times.astype(np.float32))
    return tf * idf[(shingle & U64(len(idf) - 1)).astype(np.int64)]


def _running(weight: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])


# --- samples --------------------------------------------------------------

class Sampler:
    """Improved consistent weighted sampling; `bands` keys of `rows` samples each."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.r = rng.gamma(2.0, 1.0, SAMPLES).astype(np.float32) + np.float32(1e-6)
        self.shift = rng.random(SAMPLES).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, SAMPLES) + 1e-12).astype(np.float32)
        self.mult = rng.integers(1, 1 << 63, rows * bands, dtype=U64) | U64(1)
        self.plus = rng.integers(0, 1 << 63, rows * bands, dtype=U64)

    def keys(self, bounds: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> list:
        """Per text an array of band keys; none for a text without shingles."""
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        out: list = [[] for _ in size]
        if not len(full):
            return out
        starts, size = bounds[:-1][full], size[full]
        h, lw = mix(shingle), np.log(weight)
        owner = np.repeat(np.arange(len(full)), size)
        got = np.empty((len(full), self.rows * self.bands), U64)
        for k in range(self.rows * self.bands):
            limb = (h * self.mult[k] + self.plus[k]).view(np.uint16).reshape(-1, 4)
            r, beta = self.r[limb[:, 3]], self.shift[limb[:, 2]]
            t = np.floor(lw / r + beta)
            a = self.ln_c[limb[:, 1]] - r * (t - beta) - r
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), size))
            hit = hit[np.unique(owner[hit], return_index=True)[1]]     # the smallest on ties
            got[:, k] = mix(h[hit] ^ (t[hit].astype(np.int64).astype(U64) * U64(0x9E3779B1)))
        key = np.zeros((len(full), self.bands), U64)
        for j in range(self.rows):
            key = mix(key * U64(31) + got[:, j::self.rows] + U64(j + 1))
        key = mix(key ^ np.arange(self.bands, dtype=U64))     # bands keep apart
        for row, d in zip(key.view(np.int64), full):
            out[d] = row
        return out


def sketches(docs: DataFrame, idf, words: int = WORDS) -> DataFrame:
    """Of every row of (doc_id, text) doc_id, node (a digest of the text), band keys, the
    weight of all its shingles and its number of characters."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, table = Shingler(words), Sampler(), idf.value
        for batch in batches:
            keys: list = []
            total: list[float] = []
            size: list[int] = []
            for _, texts in text_chunks(batch, "text"):
                bounds, shingle, times = shingler.sets(texts)
                weight = weights(shingle, times, table)
                keys += sampler.keys(bounds, shingle, weight)
                total += np.diff(_running(weight)[bounds]).tolist()
                size += map(len, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(total, pa.float64()), pa.array(size, pa.int64())],
                names=["doc_id", "node", "bands", "weight", "size"])

    return rows.mapInArrow(run, "doc_id bigint, node string, bands array<bigint>, "
                                "weight double, size bigint")


# --- verification ---------------------------------------------------------

def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two (shingle, weight) pairs with ascending shingles."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = np.minimum(a[1][at[hit]], b[1][hit]).sum() if hit.any() else 0.0
    whole = a[1].sum() + b[1].sum() - both
    return float(both / whole) if whole else 1.0


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float = SIMILARITY) -> DataFrame:
    """Of (a, b) pairs of nodes those whose texts are at least `least` similar."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(), idf.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in chunks([x + y for x, y in zip(left, right)]):
                for c in range(a, b, 1 << 14):
                    d = min(b, c + (1 << 14))
                    bounds, shingle, times = shingler.sets(left[c:d] + right[c:d])
                    w = weights(shingle, times, table)
                    sets = [(shingle[i:j], w[i:j]) for i, j in zip(bounds, bounds[1:])]
                    for i in range(d - c):
                        keep[c + i] = weighted_jaccard(sets[i], sets[i + d - c]) >= least
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a string, b string")


# --- classes --------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, class): class is the smallest node that links lead to.

    Every round each node takes the smallest class among its neighbours and then
    the class of that class, so chains shrink by more than half; rounds end when
    no row changes.
    """
    edges = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .distinct(), "edges")
    state = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("class"))
                   .select("node", F.least("node", "class").alias("class")), "classes")
    while True:
        near = (edges.join(state.select(F.col("node").alias("b"), "class"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near")))
        step = state.join(near, "node").select(
            "node", F.col("class").alias("old"), F.least("class", "near").alias("via"))
        jump = state.select(F.col("node").alias("via"), F.col("class").alias("far"))
        done = settle(step.join(jump, "via").select(
            "node", "old", F.least("via", "far").alias("class")), "classes")
        if done.filter("old <> class").isEmpty():
            return done.select("node", "class")
        state = done.select("node", "class")


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` after more links; only classes that one of them touches are looked at."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = settle(ends.join(classes, "node", "left").withColumn(
        "class", F.coalesce("class", "node")), "ends")
    between = (links.join(named.select(F.col("node").alias("a"), F.col("class").alias("from")), "a")
               .join(named.select(F.col("node").alias("b"), F.col("class").alias("to")), "b")
               .filter(F.col("from") != F.col("to"))
               .select(F.col("from").alias("a"), F.col("to").alias("b")))
    moved = components(between).select(F.col("node").alias("class"), F.col("class").alias("now"))
    every = classes.unionByName(named.join(classes, "node", "left_anti").select("node", "class"))
    return settle(every.join(moved, "class", "left").select(
        "node", F.coalesce("now", "class").alias("class")), "classes")


def _stars(buckets: DataFrame, centre: DataFrame) -> DataFrame:
    """(a, b, n): every node of a bucket of (key, node) with the most central one."""
    ranked = buckets.join(centre, "node")
    leader = ranked.groupBy("key").agg(F.max(F.struct("n", "node")).alias("top"))
    return (buckets.join(leader.select("key", F.col("top.node").alias("a"),
                                       F.col("top.n").alias("n")), "key")
            .filter("a <> node").select("a", F.col("node").alias("b"), "n"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- buckets as a whole ---------------------------------------------------

def open_buckets(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node, class, weight, size) of buckets with several classes; of buckets with equal
    members one."""
    placed = settle(members.join(classes, "node", "left").select(
        "key", "node", F.coalesce("class", "node").alias("class"), "weight", "size"), "placed")
    several = (placed.groupBy("key").agg(
        F.min("class").alias("least"), F.max("class").alias("most"),
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark_2"))
        .filter("least <> most").groupBy("n", "mark", "mark_2").agg(F.min("key").alias("key")))
    return placed.join(several.select("key"), "key")


def block_pairs(members: DataFrame, least: float, block: int = BLOCK,
                chars: int = BLOCK_CHARS) -> DataFrame:
    """(piece, block, node, class): pieces of work that hold every pair of nodes of a bucket
    that is not of one class and whose weights are close enough.

    A bucket of up to `block` texts and `chars` characters is one piece. Others are
    cut by weight, texts of a class that fills a block apart, and dealt to blocks by
    hash; every two blocks make a piece, unless both are of one class or their weights
    are too far apart.
    """
    width = 1.001 * max(-math.log(max(least, 1e-3)), 1e-2)
    whole = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    wide = whole.filter((F.col("n") > block) | (F.col("s") > chars)).select("key")
    large = (members.join(wide, "key").groupBy("key", "class").count()
             .filter(F.col("count") >= block)
             .select("key", "class", F.col("class").alias("apart")))
    small = members.join(wide, "key", "left_anti").select(
        F.xxhash64("key", F.lit("whole")).alias("piece"), F.lit(0).cast("bigint").alias("block"),
        "node", "class")

    cut = settle(members.join(wide, "key").join(large, ["key", "class"], "left").select(
        "key", "node", "class", "size", F.coalesce("apart", F.lit("")).alias("apart"),
        F.floor(F.log(F.greatest("weight", F.lit(1e-9))) / width).alias("step")), "cut")
    groups = (cut.groupBy("key", "apart", "step")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
              .select("key", "apart", "step", F.greatest(
                  F.ceil(F.col("n") / block), F.ceil(F.col("s") / chars), F.lit(1))
                  .alias("blocks")))
    dealt = cut.join(groups, ["key", "apart", "step"]).select(
        "key", F.xxhash64("key", "apart", "step", F.pmod(F.xxhash64("node"), "blocks"))
        .alias("block"), "node", "class")
    blocks = groups.select("key", "apart", "step", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("i")).select(
        "key", "apart", "step", F.xxhash64("key", "apart", "step", "i").alias("block"))
    other = blocks.select("key", F.col("apart").alias("apart_2"), F.col("step").alias("step_2"),
                          F.col("block").alias("block_2"))
    pieces = (blocks.join(other, "key")
              .filter((F.col("block") <= F.col("block_2"))
                      & (F.abs(F.col("step") - F.col("step_2")) <= 1)
                      & ((F.col("apart") != F.col("apart_2")) | (F.col("apart") == "")))
              .select("key", F.xxhash64("block", "block_2").alias("piece"),
                      F.explode(F.array_distinct(F.array("block", "block_2"))).alias("block")))
    return small.unionByName(pieces.join(dealt, ["key", "block"]).select(
        "piece", "block", "node", "class"))


def linked(sets: list, piece: tuple, least: float) -> Iterator[tuple[int, int]]:
    """Links between the classes of one piece: as many as join all that any pair joins.

    `sets` holds (shingle, weight) pairs, `piece` the block and the class of each. Two
    texts of one block are compared if the piece has no other block.
    """
    block, group = (np.unique(np.array(x), return_inverse=True)[1] for x in piece)
    single = block.max() == 0
    size = np.array([len(x) for x, _ in sets])
    start = np.cumsum(size) - size
    token = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)[1]
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    total = np.diff(_running(weight)[np.append(start, len(weight))])
    own = np.zeros(int(token.max()) + 1 if len(token) else 0)
    near = least - 1e-6         # sums in another order; what is found is decided below
    for x in range(len(sets) - 1):
        at = np.arange(x + 1, len(sets))
        at = at[(group[at] != group[x]) & (single | (block[at] != block[x])) & (size[at] > 0)
                & (total[at] >= near * total[x]) & (total[x] >= near * total[at])]
        if not len(at) or not size[x]:
            continue
        mine = token[start[x]: start[x] + size[x]]
        own[mine] = weight[start[x]: start[x] + size[x]]
        for c in range(0, len(at), 64):         # bounds the memory of a comparison
            part = at[c: c + 64]
            first = np.cumsum(size[part]) - size[part]
            where = np.repeat(start[part] - first, size[part]) + np.arange(size[part].sum())
            both = np.add.reduceat(np.minimum(weight[where], own[token[where]]), first)
            for y in part[both >= near * (total[x] + total[part] - both)]:
                if group[y] != group[x] and weighted_jaccard(sets[x], sets[y]) >= least:
                    yield x, int(y)
                    group[group == group[y]] = group[x]
        own[mine] = 0


def compared(pieces: DataFrame, texts: DataFrame, idf, least: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links that join all classes of `pieces` that any pair joins."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (pieces.join(texts, "node").select("piece", "block", "class", "node", "text")
            .repartition(tasks, "piece").sortWithinPartitions("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table = Shingler(), idf.value
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            """Of the rows of whole pieces."""
            sets: list = []
            texts = [r[4] for r in rows]
            for a, b in chunks(texts):
                for c in range(a, b, 1 << 15):
                    bounds, shingle, times = shingler.sets(texts[c: min(b, c + (1 << 15))])
                    w = weights(shingle, times, table)
                    sets += [(shingle[i:j], w[i:j]) for i, j in zip(bounds, bounds[1:])]
            left, right, a = [], [], 0
            for b in range(1, len(rows) + 1):
                if b == len(rows) or rows[b][0] != rows[a][0]:
                    if b - a > 1:
                        for x, y in linked(sets[a:b], tuple(zip(*rows[a:b]))[1:3], least):
                            left.append(rows[a + x][3])
                            right.append(rows[a + y][3])
                    a = b
            return pa.RecordBatch.from_arrays(
                [pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > CHUNK and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    return rows.mapInArrow(run, "a string, b string")


def classify(docs: DataFrame, text: str = "text", key: str = "doc_id",
             least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, node, class_id, class_size, kept.

    Texts of one class are linked by weighted Jaccard similarity of at least
    `least` over five-word shingles, directly or through others of the class;
    class_id is the smallest doc_id of the class, class_size its number of rows,
    and `kept` marks the rows with that id (and, if it stands for several
    texts, with the smallest digest). Null texts are empty texts. Texts without a
    word, and empty ones, are of one class only with equal texts; texts of fewer
    than five words only with texts of the same words. Repeated rows get equal
    rows. A null doc_id never names a class that has another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(rows))       # 1 MB, whatever the data
    sketch = settle(sketches(rows, idf), "sketches")
    nodes = sketch.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"),
        F.first("weight").alias("weight"), F.first("size").alias("size"),
        F.count(F.lit(1)).alias("copies"))

    wide = nodes.select("node", F.explode("bands").alias("key"), "weight", "size")
    sizes = wide.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = settle(wide.join(sizes, "key"), "members")
    centre = settle(members.groupBy("node").agg(F.sum("n").alias("n")), "centre")
    nearest = _stars(members.select("key", "node"), centre).groupBy("b").agg(F.max(F.struct("n", "a")).alias("top"))
    tried = settle(_ordered(nearest.select(F.col("top.a").alias("a"), "b")), "pairs")

    # the text of one row of every node that any bucket compares
    wanted = centre.select("node").join(nodes.select("node", "doc_id"), "node")
    of = rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("node_"),
                     F.col("doc_id").alias("id_"), F.coalesce("text", F.lit("")).alias("text"))
    texts = settle(of.join(wanted, (F.col("node_") == F.col("node"))
                           & F.col("id_").eqNullSafe(F.col("doc_id")))
                   .select("node", "text"), "texts")

    classes = components(verified(tried, texts, idf, least))
    pieces = block_pairs(open_buckets(members, classes), least)
    classes = joined_classes(classes, settle(compared(pieces, texts, idf, least), "links"))

    ids = nodes.select("node", "doc_id", "copies").join(classes, "node", "left").withColumn(
        "class", F.coalesce("class", "node"))
    named = ids.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    ids = ids.select("node", "class").join(named, "class").select(
        "node", "class_id", "class_size", (F.col("node") == F.col("first.node")).alias("named"))
    return sketch.select("doc_id", "node").join(ids, "node").select(
        "doc_id", "node", "class_id", "class_size",
        (F.col("named") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id",
             least: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of every class of near duplicates, all columns as they are."""
    kept = (classify(docs, text, key, least).filter("kept")
            .select(F.col("doc_id").alias("kept_id__"), F.col("node").alias("kept_node__"))
            .distinct())
    rows = docs.withColumn("node__", F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(kept, (F.col("node__") == F.col("kept_node__"))
                     & F.col(key).cast("bigint").eqNullSafe(F.col("kept_id__")), "left_semi")
    return rows.dropDuplicates([key, "node__"]).drop("node__")
