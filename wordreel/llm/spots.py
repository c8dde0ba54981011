"""Document fingerprints from spot signatures.

A spot is a common word; its signature is the spot with the chain of content
words that follow it. The set of a text's signatures is its fingerprint: page
furniture, which has few common words, leaves little trace in it. Likeness is the
Jaccard coefficient of two sets, which cannot reach a threshold unless the sets'
sizes are that close: searches are partitioned by size and look at neighbouring
partitions only.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordreel.llm.base import U64, Powers, chunks, mix, word_spans

CHAIN = 2                   # content words of a signature
LEAST = 0.8
BEGINS = 256                # characters by which rows of one id are dealt to parts
SAMPLE = 64                 # rows a part from which those cuts are taken
# fixed values: common words of English, French, German and Spanish
SPOTS = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on "
          "or that the their they this to was were which with you",
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par "
          "pas pour qu que qui sa se son sur un une",
    "de": "als auch auf aus bei das dem den der des die ein eine einer es für im ist mit nicht "
          "sich sie und von war wie zu zum zur",
    "es": "al como con de del el ella en es está la las lo los más no para pero por que se sin "
          "son su un una y",
}


class Spotter:
    """Signature sets of many texts at a time."""

    def __init__(self, spots: Sequence[str] | None = None, chain: int = CHAIN):
        words = sorted(set(spots if spots is not None else " ".join(SPOTS.values()).split()))
        self.chain, self.powers = chain, Powers()
        raw = [w.encode("utf-8") for w in words]
        sums = self.powers.sums(np.frombuffer(b" ".join(raw) or b" ", np.uint8))
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1 if raw else np.zeros(0, np.int64)
        starts = ends - np.array([len(r) for r in raw], np.int64)
        self.spots = np.sort(self.powers.span(sums, starts, ends))

    def sets(self, texts: Sequence[str]) -> np.ndarray:
        """Ascending unique numbers text << 32 | signature.

        A text with words but without a signature has one of all its bytes, an
        empty text none.
        """
        low = [t.lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b" ".join(low), np.uint8)
        start, end = word_spans(data)
        word = self.powers.span(self.powers.sums(data), start, end) if len(start) \
            else np.zeros(0, U64)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), start, side="right")
        spot = np.zeros(len(word), bool)
        if len(self.spots) and len(word):
            at = np.searchsorted(self.spots, word)
            at[at == len(self.spots)] = 0
            spot = self.spots[at] == word
        content, anchors = np.flatnonzero(~spot), np.flatnonzero(spot)
        nxt = np.searchsorted(content, anchors)
        value = mix(word[anchors])
        found = np.zeros(len(anchors), np.int64)
        for i in range(self.chain):
            at = np.minimum(nxt + i, max(len(content) - 1, 0))
            there = (nxt + i < len(content))
            if len(content):
                there &= owner[content[at]] == owner[anchors]
                value = np.where(there, mix(value * U64(31) + word[content[at]]), value)
            found += there
        ok = found > 0
        key = (owner[anchors[ok]].astype(U64) << U64(32)) | (value[ok] >> U64(32))
        bare = np.ones(len(texts), bool)
        bare[owner[anchors[ok]]] = False
        rest = [(i << 32) | int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "replace"),
                                                           digest_size=4).digest(), "big")
                for i in np.flatnonzero(bare) if texts[i]]
        return np.unique(np.concatenate([key, np.array(rest, U64)]))


def fingerprints_of(keys: np.ndarray, n: int) -> list[str]:
    """Hex of each text's signatures, ascending, eight digits each."""
    bounds = np.searchsorted(keys >> U64(32), np.arange(n + 1, dtype=U64))
    values = (keys & U64(0xFFFFFFFF)).astype(">u4")
    return [values[a:b].tobytes().hex() for a, b in zip(bounds, bounds[1:])]


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard coefficients of the i-th sets of a and b; 1 for two empty ones."""
    size = [np.bincount((x >> U64(32)).astype(np.int64), minlength=n) for x in (a, b)]
    both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> U64(32)).astype(np.int64),
                       minlength=n)
    whole = size[0] + size[1] - both
    return np.where(whole > 0, both / np.maximum(whole, 1), 1.0)


# --- searching ------------------------------------------------------------

def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, signatures): ascending signature numbers of every row; null as empty."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter()
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in chunks(texts):
                keys = spotter.sets(texts[a:b])
                bounds = np.searchsorted(keys >> U64(32), np.arange(b - a + 1, dtype=U64))
                values = (keys & U64(0xFFFFFFFF)).astype(np.int64)
                out += [values[i:j] for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.int64()))],
                names=["doc_id", "signatures"])

    return rows.mapInArrow(run, f"doc_id {kind}, signatures array<bigint>")


def search(queries: DataFrame, rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(query_id, doc_id, likeness) of all pairs at least `least` like; both from `fingerprints`.

    Partition p holds sets of sizes (1/least)**p up to the next power; a set's
    partners lie in its own partition or the ones beside it. Only the prefix of a
    set that every partner must share is looked up, rarest signatures first by
    their own number, and pairs that meet are compared whole. Empty sets have no
    partners; a document is a partner of itself under another id only.
    """
    ratio = math.log(1 / least)
    size = F.size("signatures")

    def keyed(df: DataFrame, spread: bool) -> DataFrame:
        prefix = size - F.ceil(size * F.lit(least)).cast("int") + 1
        df = df.filter(size > 0).withColumn("n", size).withColumn(
            "p", F.floor(F.log(F.size("signatures")) / ratio + 1e-9).cast("int"))
        df = df.withColumn("sig", F.explode(F.slice("signatures", F.lit(1), prefix)))
        if spread:
            df = df.withColumn("p", F.explode(F.array(F.col("p") - 1, F.col("p"),
                                                      F.col("p") + 1)))
        return df

    left = keyed(queries, True).select(F.col("doc_id").alias("query_id"), "p", "sig",
                                       F.col("n").alias("n_query"))
    right = keyed(rows, False).select("doc_id", "p", "sig", "n")
    pairs = (left.join(right, ["p", "sig"])
             .filter((F.col("n") >= F.col("n_query") * least)
                     & (F.col("n_query") >= F.col("n") * least)
                     & (F.col("query_id") != F.col("doc_id")))
             .select("query_id", "doc_id").distinct())
    whole = (pairs.join(queries.select(F.col("doc_id").alias("query_id"),
                                       F.col("signatures").alias("a")), "query_id")
             .join(rows.select("doc_id", F.col("signatures").alias("b")), "doc_id"))
    both = F.size(F.array_intersect("a", "b"))
    return whole.select("query_id", "doc_id", (both / (F.size("a") + F.size("b") - both))
                        .alias("likeness")).filter(F.col("likeness") >= least).distinct()


# --- neighbours and edits -------------------------------------------------

def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple:
    """(part, halo, doc_id, text) dealt so that each part holds consecutive ids and the row
    after its last, marked as halo; and the number of parts.

    Rows are ordered by id and text; a null id stands as the smallest long. Parts are
    cut near quantiles of the ids, so ids may be of any kind and density. An id
    that fills several quantiles (nulls, repeats) is cut as often, near quantiles
    of how its texts begin, from a sample of about `SAMPLE` rows a part. Quantiles
    are doubles, which hold no id beyond 2**53 exactly: a part begins at its
    smallest real place.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = 4 * tasks           # so that the hash of the parts is dealt evenly
    cut = rows.agg(F.min(ids).alias("least"), F.count(F.lit(1)).alias("rows"),
                   F.percentile_approx(ids, [i / n for i in range(1, n)], 20 * n).alias("at")).first()
    filled = Counter(cut["at"] or [])
    often = [i for i, m in filled.items() if m > 1]         # fewer than n
    begins = F.substring("text", 1, BEGINS)
    rows = rows.withColumn("begins", F.when(ids.isin(often), begins).otherwise(F.lit(""))
                           if often else F.lit(""))
    near = [(i, "") for i in {cut["least"] or 0, *filled}]
    if often:
        rate = min(1.0, SAMPLE * n / cut["rows"])
        drawn: dict[int, list[str]] = {}
        for i, t in (rows.filter(ids.isin(often) & (F.rand(7) < rate))     # equal texts too
                     .select(ids, "begins").collect()):
            drawn.setdefault(i, []).append(t)
        for i, some in drawn.items():
            some.sort()
            near += {(i, some[j * len(some) // filled[i]]) for j in range(1, filled[i])}
    near.sort()

    def places(batch: pa.RecordBatch) -> list[tuple[int, str]]:
        return list(zip(batch.column(0).fill_null(-(1 << 63)).to_pylist(),
                        batch.column(1).to_pylist()))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, str]] = {}
        for batch in batches:
            for place in places(batch):
                p = bisect_right(near, place)
                found[p] = min(place, found.get(p, place))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()),
             pa.array([k[0] for k in found.values()], pa.int64()),
             pa.array([k[1] for k in found.values()], pa.string())],
            names=["part", "id", "begins"])

    firsts = (rows.select("doc_id", "begins").mapInArrow(smallest, "part int, id bigint, begins string")
              .groupBy("part").agg(F.min(F.struct("id", "begins")).alias("at"))
              .select("at.id", "at.begins").collect())      # at most two rows a part
    bounds = sorted(tuple(r) for r in firsts) or [(0, "")]
    parts = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = places(batch)
            part = np.array([bisect_right(bounds, x) - 1 for x in place], np.int64)
            after: dict[int, tuple[str, int]] = {}      # the row after a part: the least text
            for i, p in enumerate(part.tolist()):
                if place[i] == bounds[p]:
                    this = (batch.column(2)[i].as_py(), i)
                    after[p] = min(this, after.get(p, this))
            first = np.array([i for _, i in after.values()], np.int64)
            both = pa.Table.from_batches([batch, batch.take(pa.array(first))]).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([part, (part[first] - 1) % parts]).astype(np.int32)),
                 pa.array(np.repeat([False, True], [len(part), len(first)])),
                 both.column(0).combine_chunks(), both.column(2).combine_chunks()],
                names=["part", "halo", "doc_id", "text"])

    dealt = rows.select("doc_id", "begins", "text").mapInArrow(
        run, "part int, halo boolean, doc_id bigint, text string")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "halo", ids, "text")


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first ones of the following."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def compare_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    (to the edited text), near_next (to the next document, ascending doc_id, the
    first after the last). Null texts are empty; the fingerprint of an empty text
    is empty, and two empty ones are alike. Rows of one id follow each other by
    text; null ids come first. A single document is its own next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter()
        held: list[tuple] = []      # rows of one part, the last still without a next one
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            """Of rows (part, halo, id, text); the last one is only the next of the one before."""
            texts = [r[3] for r in rows]
            pairs = [i for i in range(len(rows) - 1)
                     if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            changed = [edited(texts[i], texts[i + 1]) for i in pairs]
            whole = spotter.sets(texts)
            own = _renumber(whole, pairs)
            follow = _renumber(whole, [i + 1 for i in pairs])
            new = spotter.sets(changed)
            n = len(pairs)
            return pa.RecordBatch.from_arrays([
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
                         pa.string()),
                pa.array(fingerprints_of(own, n), pa.string()),
                pa.array(fingerprints_of(new, n), pa.string()),
                pa.array(likeness(own, new, n), pa.float64()),
                pa.array(likeness(own, follow, n), pa.float64())],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > 1 << 19 or len(held) > 1 << 14:
                    yield done(held)
                    held, size = held[-1:], len(row[3])
        if held:
            yield done(held)

    return with_next(docs, text, key).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")


def _renumber(keys: np.ndarray, texts: Sequence[int]) -> np.ndarray:
    """The sets of some texts, numbered in their order; texts must ascend."""
    owner = (keys >> U64(32)).astype(np.int64)
    place = np.full(int(owner.max()) + 1 if len(owner) else 0, -1, np.int64)
    chosen = np.array(texts, np.int64)
    inside = chosen < len(place)
    place[chosen[inside]] = np.flatnonzero(inside)
    to = place[owner]
    ok = to >= 0
    return (to[ok].astype(U64) << U64(32)) | (keys[ok] & U64(0xFFFFFFFF))
