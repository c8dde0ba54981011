"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest pieces that still fit; then its
smallest piece gives way to two unpacked pieces if they fill the widened gap more
tightly. Which pieces of one length are taken makes no difference, so the packing
itself needs only the count of every length, a table as long as a sequence,
whatever the number of documents. Equal bins are made many at a time. What comes
out are ranges of ranks within a length; every piece finds its place from its own
rank, which is counted block by block.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wordreel.llm.base import tokenizer_file
from wordreel.session import settle

SEQUENCE = 2048
END_ID = 0
PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "rid bigint, part int")


# --- tokens ---------------------------------------------------------------

def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_encoder(path: str, plain: bool = False):
    """text -> numpy uint32 ids, equal to the tokenizer file's own encoding.

    The vocabulary of the file is run by tiktoken, several times faster; the two
    agree as ids stand in the order of merges, which is checked here. Texts with
    a special token's own spelling go to the tokenizers library, unless `plain`
    has them read as ordinary text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of_char = _byte_of_char()
    ranks = {bytes(of_char[c] for c in token): i
             for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][m.replace(" ", "")] for m in merged]
    if any(a >= b for a, b in zip(order, order[1:])):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    # fixed value: the splitting pattern that byte-level tokenizers of this kind use
    pattern = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if not plain and any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """Cut n ids into pieces of `size`; what is left over stands first."""
    first = n % size or size
    return [(0, min(first, n)), *[(a, a + size) for a in range(first, n, size)]]


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
              size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, rid, part.

    `rid` is unique and `part` a block of rows of one task; both mean something
    only in a written table.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for i, (a, b) in enumerate(piece_bounds(len(ids), size)):
                    out.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names)

    done = rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, "
                                "ids_crc32 bigint")
    return done.withColumns({"rid": F.monotonically_increasing_id(),
                             "part": F.spark_partition_id()})


# --- packing --------------------------------------------------------------

@dataclass(frozen=True)
class Run:
    """Pieces of `length` with ranks first..last-1 fill bins from `bin` on, `each` to a bin."""

    length: int
    first: int
    last: int
    each: int
    bin: int
    offset: int


def _best_pair(left: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """The two available lengths with the largest sum in (above, room]."""
    a = np.flatnonzero(left)
    a = a[a < room]
    if not len(a):
        return None
    at = np.searchsorted(a, room - a, side="right") - 1
    ok = at >= 0
    # a length may stand for both only if there are two of it
    same = ok & (a[np.maximum(at, 0)] == a) & (left[a] < 2)
    at = np.where(same, at - 1, at)
    ok = at >= 0
    if not ok.any():
        return None
    total = np.where(ok, a + a[np.maximum(at, 0)], -1)
    best = int(total.argmax())
    return (int(a[best]), int(a[at[best]])) if total[best] > above else None


def best_two_fit(counts: np.ndarray, size: int) -> list[Run]:
    """Pack counts[length] pieces of every length 1..size; see the module's text."""
    left = np.asarray(counts, np.int64).copy()
    used = np.zeros_like(left)
    runs: list[Run] = []
    bins = 0
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return runs
        content: dict[int, int] = {}
        gap = size
        while True:
            at = int(np.searchsorted(have, gap, side="right")) - 1
            if at < 0:
                break
            length = int(have[at])
            k = min(int(left[length]), gap // length)
            content[length] = k
            gap -= k * length
            have = have[:at]
        smallest = min(content)
        if gap and sum(content.values()) > 1:
            rest = left.copy()
            for length, k in content.items():
                rest[length] -= k
            pair = _best_pair(rest, gap + smallest, smallest)
            if pair:
                content[smallest] -= 1
                for length in pair:
                    content[length] = content.get(length, 0) + 1
                content = {x: k for x, k in content.items() if k}
        times = min(int(left[x]) // k for x, k in content.items())
        offset = 0
        for length in sorted(content, reverse=True):
            k = content[length]
            first = int(used[length])
            runs.append(Run(length, first, first + k * times, k, bins, offset))
            used[length] += k * times
            left[length] -= k * times
            offset += k * length
        bins += times


def place(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to a written table with length, rid and part."""
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # <= size rows
        counts[r["length"]] = r["n"]
    runs = sorted(best_two_fit(counts, size), key=lambda r: (r.length, r.first))
    # at most a few times `size` kinds of bins of at most 2 * sqrt(size) lengths each
    table = pieces.sparkSession.sparkContext.broadcast(
        np.array([(r.length, r.first, r.each, r.bin, r.offset) for r in runs], np.int64)
        .reshape(-1, 5))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    before = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0))
                             .alias("before"))
    in_part = Window.partitionBy("length", "part").orderBy("rid")
    ranked = (pieces.withColumn("local", F.row_number().over(in_part) - 1)
              .join(before, ["length", "part"])
              .withColumn("rank", (F.col("before") + F.col("local")).cast("bigint")))
    keep = [c for c in pieces.columns if c not in ("rid", "part")]
    ranked = ranked.select(*keep, "rank")
    at_length, at_rank = keep.index("length"), len(keep)
    names = [*keep, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        width = np.int64(1) << 44       # ranks stay below
        starts = t[:, 0] * width + t[:, 1]
        for batch in batches:
            length = batch.column(at_length).to_numpy()
            rank = batch.column(at_rank).to_numpy()
            r = t[np.searchsorted(starts, length * width + rank, side="right") - 1] \
                if len(rank) else t[:0]
            i = rank - r[:, 1]
            each = np.maximum(r[:, 2], 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(r[:, 3] + i // each),
                 pa.array(r[:, 4] + i % each * length)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text",
         size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenize documents and place all their pieces in sequences of at most `size` ids.

    Every document ends with `end_id`, so an empty or null text is one piece of
    one id. Longer documents are cut into pieces of `size` ids, the rest first.
    Rows with a null or a repeated id are documents like others. Sequences are
    numbered from 0; pieces of one sequence lie side by side from offset 0. An
    empty table packs into no rows.
    """
    pieces = settle(tokenized(docs, path or tokenizer_file("byte_bpe_50k.json"), key, text, size,
                              end_id), "pieces")
    return place(pieces, size)
