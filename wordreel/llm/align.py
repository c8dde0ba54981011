"""How two tokenizers' tokens correspond, by an external count of linked pairs.

Both cut the same bytes. Where an end of a token of A is an end of a token of B,
a group ends, and the two tokens that end there are linked. How often each pair
of ids is linked in the whole corpus is counted in the manner of an external sort:

1. Texts are worked on in blocks of about a million records (pair, document).
   A block is sorted and dealt by the radix of the B id into slots; each slot's part
   is a run: its pairs with their sums, in frames of zstd, and beside them the
   documents of each pair.
2. The runs of a slot are merged by a heap over their heads, in several levels if
   there are many. As the B id leads the order, all pairs of a B id come out in a
   row, and its highest count is known when the last has come.
3. The counts go back to the runs, whose documents' shares are summed per block.

Only pairs meet in one place, once per block however many documents have them, so a
pair that every document has costs no more than any other. No task holds more than
one slot's counts and a bounded number of runs; everything between the steps
is a written table or a shuffle of whole runs.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wordreel.llm.base import attach, tokenizer_file
from wordreel.llm.packing import byte_encoder
from wordreel.llm.words import byte_of_char
from wordreel.session import settle

SLOTS = 128             # parts that pairs are dealt to by their B id
BLOCK = 1_000_000       # records of a block, about; a document stays whole
BLOCK_DOCS = 1 << 18    # documents of a block, at most
FRAME = 512             # pairs that are unpacked at once
FAN = 512               # runs merged or answered at once, in expectation
STRETCH = 1 << 18       # code points that are encoded together, about

NEW = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# --- two encodings of one text --------------------------------------------

def stretches(text: str, size: int) -> Iterator[str]:
    """The text in pieces that both tokenizers encode alike on their own.

    A cut stands before a single space between other characters, which begins a
    token with both; each piece after the first is given without that space.
    """
    start = at = 0
    while len(text) - start > size:
        at = text.find(" ", max(at, start + size))
        if at < 0 or at + 1 >= len(text):
            break
        if text[at - 1].isspace() or text[at + 1].isspace():
            at += 1
            continue
        yield text[start:at]
        start = at = at + 1
    yield text[start:]


class Pair:
    """Both tokenizers, what their ids spell, and how ids are written."""

    def __init__(self, path_a: str, path_b: str, stretch: int = STRETCH):
        import sentencepiece

        self.stretch = stretch
        self.encode_a = byte_encoder(path_a, plain=True)
        of_char = byte_of_char()
        spec = json.load(open(path_a, encoding="utf-8"))
        spelled = {i: bytes(of_char[c] for c in t) for t, i in spec["model"]["vocab"].items()
                   if all(c in of_char for c in t)}
        self.spell_a = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.encode_b = lambda t: np.array(model.encode(t, num_threads=1), np.int64)
        self.spell_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                        else model.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(model.get_piece_size())]
        # cuts hold for B if no piece goes on after a space inside it
        self.whole = any(b" " in s.lstrip(b" ") for s in self.spell_b)
        self.size_a = np.array([len(s) for s in self.spell_a], np.int64)
        self.size_b = np.array([len(s) for s in self.spell_b], np.int64)
        self.width = len(self.spell_a)          # a pair's key is b * width + a
        # decimal ids with what follows them inside and at the end of a group
        self.written = [f"{i}{end}".encode() for ends, n in ((",|", len(self.spell_a)),
                                                             (",;", len(self.spell_b)))
                        for end in ends for i in range(n)]
        self.start_b = 2 * len(self.spell_a)

    def pieces(self, text: str) -> Iterator[tuple[np.ndarray, ...] | None]:
        """Per stretch the ids of A and B and the places where both end; None if bytes differ."""
        for t in [text] if self.whole else stretches(text, self.stretch):
            a, b = self.encode_a(" " + t).astype(np.int64), self.encode_b(t)
            want = b" " + t.encode()
            if any(b"".join(map(s.__getitem__, x.tolist())) != want
                   for s, x in ((self.spell_a, a), (self.spell_b, b))):
                yield None
                return
            end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            at = np.searchsorted(end_b, end_a)
            last_a = np.flatnonzero(end_b[at] == end_a)
            yield a, b, last_a, at[last_a]

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        """The ids of A and B, group by group; none without tokens."""
        out: list[tuple[list[int], list[int]]] = []
        for piece in self.pieces(text) if text else ():
            if piece is None:
                return []
            a, b, last_a, last_b = piece
            out += zip([x.tolist() for x in np.split(a, last_a[:-1] + 1)],
                       [x.tolist() for x in np.split(b, last_b[:-1] + 1)])
        return out

    def spelled_groups(self, a, b, last_a, last_b) -> bytes:
        """`a1,a2|b1;a3|b2,b3;` with a semicolon at the end."""
        many_a, many_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        code_a, code_b = a.copy(), b + self.start_b
        code_a[last_a] += len(self.spell_a)
        code_b[last_b] += len(self.spell_b)
        out = np.empty(len(a) + len(b), np.int64)
        # the B tokens of earlier groups stand before an A token, and the A tokens
        # of a group before its B tokens
        out[np.arange(len(a)) + np.repeat(last_b + 1 - many_b, many_a)] = code_a
        out[np.arange(len(b)) + np.repeat(last_a + 1, many_b)] = code_b
        return b"".join(map(self.written.__getitem__, out.tolist()))

    def measure(self, text: str | None) -> tuple[tuple[int, int, int, int, str], np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256) and the key of every link."""
        nothing = (0, 0, 0, 0, ""), np.zeros(0, np.int64)
        if not text:
            return nothing
        n_a = n_b = 0
        digest, held, keys = hashlib.sha256(), b"", []
        for piece in self.pieces(text):
            if piece is None:
                return nothing
            a, b, last_a, last_b = piece
            n_a, n_b = n_a + len(a), n_b + len(b)
            digest.update(held)
            held = self.spelled_groups(*piece)
            keys.append(b[last_b] * self.width + a[last_a])
        digest.update(held[:-1])
        key = np.concatenate(keys)
        return (n_a, n_b, len(key), len(key), digest.hexdigest()), key


# --- runs -----------------------------------------------------------------

def packed(*columns: np.ndarray) -> bytes:
    """Equally long columns of integers as one zstd frame, byte planes side by side."""
    import zstandard

    raw = np.array(columns, "<i8").reshape(len(columns), -1)
    planes = raw.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()
    return struct.pack("<I", len(columns)) + zstandard.compress(planes, 1)


def unpacked(frame: bytes) -> np.ndarray:
    import zstandard

    n, = struct.unpack_from("<I", frame)
    planes = np.frombuffer(zstandard.decompress(frame[4:]), np.uint8).reshape(n, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(n, -1)


def framed(keys: np.ndarray, sums: np.ndarray) -> bytes:
    """A run: sorted pairs and their sums in frames of `FRAME` pairs."""
    out = []
    for i in range(0, len(keys), FRAME):
        part = keys[i: i + FRAME]
        frame = packed(np.diff(part, prepend=0), sums[i: i + FRAME])
        out += [struct.pack("<I", len(frame)), frame]
    return b"".join(out)


def frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(run):
        size, = struct.unpack_from("<I", run, at)
        step, sums = unpacked(run[at + 4: at + 4 + size])
        yield np.cumsum(step), sums
        at += 4 + size


def records(run: bytes) -> Iterator[tuple[int, int]]:
    for keys, sums in frames(run):
        yield from zip(keys.tolist(), sums.tolist())


def merged(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """All pairs of sorted runs in order, each once with its whole sum: a heap over the heads."""
    held, total = -1, 0
    for key, n in heapq.merge(*map(records, runs)):
        if key != held:
            if total:
                yield held, total
            held, total = key, 0
        total += n
    if total:
        yield held, total


class Block:
    """Records (pair, document) of documents that were read one after the other."""

    def __init__(self, number: int):
        self.number, self.docs, self.size = number, 0, 0
        self.keys, self.times, self.at = [], [], []

    def add(self, links: np.ndarray) -> int:
        """Take a document's links; its place in the block."""
        keys, times = np.unique(links, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.at.append(np.full(len(keys), self.docs, np.int64))
        self.size += len(keys)
        self.docs += 1
        return self.docs - 1

    def full(self, most: int) -> bool:
        return self.size >= most or self.docs >= BLOCK_DOCS

    def runs(self, width: int, slots: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Per slot: its pairs with sums, and for each pair its documents and times."""
        key, times, at = (np.concatenate(x) if x else np.zeros(0, np.int64)
                          for x in (self.keys, self.times, self.at))
        slot = key // width % slots
        order = np.lexsort((key, slot))
        key, times, at, slot = key[order], times[order], at[order], slot[order]
        bound = np.searchsorted(slot, np.arange(slots + 1))
        for s in np.flatnonzero(np.diff(bound)):
            k, t, d = (x[bound[s]: bound[s + 1]] for x in (key, times, at))
            first = np.flatnonzero(np.diff(k, prepend=-1))
            yield (int(s), framed(k[first], np.add.reduceat(t, first)),
                   struct.pack("<I", len(u := packed(np.diff(np.append(first, len(k))))))
                   + u + packed(d, t))


def _measured(docs: DataFrame, text: str, path_a: str, path_b: str, slots: int,
              most: int) -> DataFrame:
    """One row per document and one per run; `slot` is null with documents."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in NEW]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"),
                       F.struct(*(others or [F.lit(True).alias("none")])).alias("row"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("at", T.LongType()),
        T.StructField("row", rows.schema["row"].dataType),
        *[T.StructField(c, T.LongType()) for c in NEW[:4]],
        T.StructField("groups_sha256", T.StringType()), T.StructField("slot", T.IntegerType()),
        T.StructField("pairs", T.BinaryType()), T.StructField("uses", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, first = Pair(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(first)
        row_type = None

        def of_block() -> Iterator[pa.RecordBatch]:
            for slot, pairs, uses in block.runs(pair.width, slots):
                nulls = [pa.nulls(1, row_type), *[pa.nulls(1, pa.int64())] * 4,
                         pa.nulls(1, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.number]), pa.nulls(1, pa.int64()), *nulls,
                     pa.array([slot], pa.int32()), pa.array([pairs], pa.binary()),
                     pa.array([uses], pa.binary())], names)

        for batch in batches:
            row_type = batch.column(1).type
            where, seen = [], []
            for t in batch.column(0):
                figures, links = pair.measure(t.as_py())
                where.append((block.number, block.add(links)))
                seen.append(figures)
                if block.full(most):
                    yield from of_block()
                    block = Block(block.number + 1)
            n = len(where)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in zip(*where)], batch.column(1),
                     *[pa.array(c, pa.int64()) for c in list(zip(*seen))[:4]],
                     pa.array([s[4] for s in seen], pa.string()), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
        if row_type is not None:
            yield from of_block()

    return rows.mapInArrow(run, schema)


# --- counts ---------------------------------------------------------------

def _level(table: pa.Table) -> pa.Table:
    """Several runs of a slot merged into one."""
    out = list(merged([x.as_py() for x in table["pairs"]]))
    keys, sums = (np.array(c, np.int64) for c in zip(*out))
    return pa.table({"slot": table["slot"][:1], "run": table["part"][:1].cast(pa.int64()),
                     "pairs": pa.array([framed(keys, sums)], pa.binary())})


def _counted(width: int):
    """The last level: every pair of a slot, its count, and whether its B id has no higher one."""
    def run(table: pa.Table) -> pa.Table:
        keys, sums, best = [], [], []
        whole = merged([x.as_py() for x in table["pairs"]])
        for _, of_b in itertools.groupby(whole, lambda r: r[0] // width):
            row = list(of_b)
            most = max(n for _, n in row)
            keys += [k for k, _ in row]
            sums += [n for _, n in row]
            best += [n == most for _, n in row]
        return pa.table({"slot": table["slot"][:1],
                         "counts": pa.array([packed(np.array(keys), np.array(sums),
                                                    np.array(best))], pa.binary())})

    return run


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _count_runs(runs: DataFrame, blocks: int, width: int, fan: int) -> DataFrame:
    """(slot, counts) from runs (slot, run, pairs) of so many blocks."""
    while blocks > fan:
        blocks = -(-blocks // fan)
        part = F.pmod(F.xxhash64("run"), F.lit(blocks)).alias("part")
        runs = (runs.select("slot", part, "pairs").repartition(_tasks(runs), "slot", "part")
                .groupBy("slot", "part")
                .applyInArrow(_level, "slot int, run bigint, pairs binary"))
    return (runs.select("slot", "pairs").repartition(_tasks(runs), "slot").groupBy("slot")
            .applyInArrow(_counted(width), "slot int, counts binary"))


def _shares(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What each run's documents get: links whose count is highest, and the sum of counts."""
    block, share = [], []
    if counts.num_rows:
        key, n, best = unpacked(counts["counts"][0].as_py())
    for number, pairs, uses in zip(runs["block"].to_pylist(), runs["pairs"], runs["uses"]):
        own = np.concatenate([k for k, _ in frames(pairs.as_py())])
        uses = uses.as_py()
        size, = struct.unpack_from("<I", uses)
        many = unpacked(uses[4: 4 + size])[0]
        at, times = unpacked(uses[4 + size:])
        of = np.repeat(np.searchsorted(key, own), many)
        block.append(number)
        share.append(packed(*_summed(at, times * best[of], times * n[of])))
    return pa.table({"block": pa.array(block, pa.int64()), "share": pa.array(share, pa.binary())})


def _summed(at: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values' sums for each place, whole numbers throughout."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return [at[first], *[np.add.reduceat(v[order], first) for v in values]]


def _per_document(table: pa.Table) -> pa.Table:
    """The shares of all runs of a block, summed for each of its documents."""
    at, best, total = _summed(*np.concatenate(
        [unpacked(x.as_py()) for x in table["share"]], axis=1))
    return pa.table({"block": pa.array(np.full(len(at), table["block"][0].as_py())),
                     "at": pa.array(at), "n_best": pa.array(best), "count_sum": pa.array(total)})


class Alignment:
    """Documents aligned once and written; what is counted from them is read from there."""

    def __init__(self, docs: DataFrame, text: str = "text", path_a: str | None = None,
                 path_b: str | None = None, slots: int = SLOTS, fan: int = FAN,
                 block: int = BLOCK):
        self.path_a = path_a or tokenizer_file("byte_bpe_50k.json")
        self.path_b = path_b or tokenizer_file("piece_bpe_32k.model")
        self.fan, self.width = fan, Pair(self.path_a, self.path_b).width
        table = settle(
            _measured(docs, text, self.path_a, self.path_b, slots, block), "aligned")
        self.none = not [c for c in docs.columns if c != text and c not in NEW]
        self.rows = table.filter(F.col("slot").isNull()).select(
            "block", "at", "row", *NEW[:4], "groups_sha256")
        self.runs = table.filter(F.col("slot").isNotNull()).select(
            "slot", "block", "pairs", "uses")
        self.blocks = self.runs.agg(F.count_distinct("block")).head()[0]
        self.counts = settle(
            _count_runs(self.runs.select("slot", F.col("block").alias("run"), "pairs"),
                        self.blocks, self.width, fan), "aligned-counts")

    def documents(self) -> DataFrame:
        """The documents' other columns and the columns `NEW`."""
        salts = max(1, -(-self.blocks // self.fan))
        salt = F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")
        keys = ["slot", "salt"]
        tasks = _tasks(self.runs)
        asked = self.runs.select(salt, "*").repartition(tasks, *keys).groupBy(*keys)
        told = self.counts.withColumn("salt", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))).repartition(
            tasks, *keys).groupBy(*keys)
        shares = asked.cogroup(told).applyInArrow(_shares, "block bigint, share binary")
        sums = shares.repartition(tasks, "block").groupBy("block").applyInArrow(
            _per_document, "block bigint, at bigint, n_best bigint, count_sum bigint")
        zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_best", "count_sum")}
        out = self.rows.join(sums, ["block", "at"], "left").withColumns(zero)
        return out.select(*([] if self.none else ["row.*"]), *NEW)

    def pairs(self) -> DataFrame:
        """(a, b, n, best): every linked pair of ids, how often, and whether no other A id
        is linked to the B id more often."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for counts in batch.column(0):
                    key, n, best = unpacked(counts.as_py())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key % width).astype(np.int32)),
                         pa.array((key // width).astype(np.int32)), pa.array(n),
                         pa.array(best.astype(bool))], ["a", "b", "n", "best"])

        return self.counts.select("counts").mapInArrow(
            run, "a int, b int, n bigint, best boolean")


def align(docs: DataFrame, text: str = "text", path_a: str | None = None,
          path_b: str | None = None) -> DataFrame:
    """`docs` without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is encoded with a space before it, without special tokens; their
    spelling inside a text is ordinary text. A null or empty text, and one whose tokens
    of either side do not spell it, has no tokens: zeros and an empty digest. A pair's
    count is over all documents, repeated rows and null keys included. Other columns
    stay; one that has the name of a new column gives way to it. An empty table stays
    empty. A text of any length is encoded in stretches.
    """
    return Alignment(docs, text, path_a, path_b).documents()


def groups(docs: DataFrame, text: str = "text", path_a: str | None = None,
           path_b: str | None = None, name: str = "groups") -> DataFrame:
    """`docs` with the groups of a text: array<struct<a: array<int>, b: array<int>>>."""
    path_a = path_a or tokenizer_file("byte_bpe_50k.json")
    path_b = path_b or tokenizer_file("piece_bpe_32k.model")
    ids = T.ArrayType(T.IntegerType())

    def make():
        pair = Pair(path_a, path_b)
        return lambda texts: [[[{"a": a, "b": b} for a, b in pair.groups(t)] for t in texts]]

    return attach(docs, text, make, [T.StructField(name, T.ArrayType(T.StructType(
        [T.StructField("a", ids), T.StructField("b", ids)])))])
