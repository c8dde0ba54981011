"""Repeated strings of a fixed length, by parsing the corpus into phrases.

A rolling hash puts triggers into the text: of all grams of a window of `LENGTH`
bytes the one of least hash is the window's trigger, so equal windows have it at
the same place. The windows of one trigger make a phrase, and every window of the
corpus lies in exactly one. The dictionary holds the distinct phrases.

Whether a window occurs elsewhere is a question about the corpus order cut at
`LENGTH` bytes: do its neighbours agree with it? It is answered from the
dictionary, coarse to fine. A trigger gram that occurs once settles its phrase
(nothing repeats), a phrase that occurs twice settles all its windows, and only
the windows of phrases that share a gram but not all of their bytes are compared
themselves, once per distinct phrase.

Texts go through a shuffle twice, compressed, and only those that a filter of
fixed size cannot rule out; the joins behind it are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wordreel.llm.base import MIX1, U64, Powers, chunks, mix
from wordreel.session import settle

LENGTH = 200
GRAM = 64
FILTER_BITS = 1 << 27
GROUP = 512         # distinct phrases of one gram that are compared in one group


# --- parsing --------------------------------------------------------------

class Parser:
    """Phrases of many texts at a time; positions count from the start of the chunk."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.powers = length, gram, Powers()

    def phrases(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Per phrase: doc (index), lo and hi (its first and last window's start in the
        text), gram and phrase hashes, and `at`, the text's place in the chunk."""
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        data = np.frombuffer(b"".join(texts), np.uint8)
        none = np.zeros(0, np.int64)
        if not (size >= self.length).any():
            return dict(doc=none, lo=none, hi=none, gram=none, phrase=none, at=none)
        n, k = len(data), self.gram
        m = self.length - k + 1
        sums = self.powers.sums(data)
        raw = sums[k:] - sums[:-k]
        raw *= self.powers.down[: len(raw)]
        order = raw ^ (raw >> U64(31))
        order *= MIX1
        order &= U64(0xFFFFFFFF00000000)
        order |= np.arange(len(order), dtype=U64)       # the leftmost of equal grams
        padded = np.full(-(-len(order) // m) * m, np.iinfo(np.uint64).max, U64)
        padded[: len(order)] = order
        block = padded.reshape(-1, m)
        head = np.minimum.accumulate(block, axis=1).ravel()
        tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - self.length + 1
        trigger = (np.minimum(tail[:windows], head[m - 1: m - 1 + windows])
                   & U64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 2, np.int32)
        ok = size >= self.length
        inside[starts[ok]] += 1
        np.subtract.at(inside, ends[ok] - self.length + 1, 1)
        inside = np.cumsum(inside)[:windows] > 0
        change = np.ones(windows, bool)
        change[1:] = trigger[1:] != trigger[:-1]
        first, last = inside & change, inside.copy()
        first[1:] |= inside[1:] & ~inside[:-1]
        last[:-1] &= change[1:] | ~inside[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        doc = np.searchsorted(ends, lo, side="right")
        return dict(doc=doc, lo=lo - starts[doc], hi=hi - starts[doc], at=starts[doc],
                    gram=mix(raw[trigger[lo]]).view(np.int64),
                    phrase=self.powers.span(sums, lo, hi + self.length).view(np.int64))


def _utf8(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _phrase_rows(parser: Parser, batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """Of a batch of (doc, th, text): phrases of chunk after chunk, `doc` within the batch."""
    texts = _utf8(batch.column("text").to_pylist())
    for a, b in chunks(texts):
        got = parser.phrases(texts[a:b])
        got["doc"] = got["doc"] + a
        yield got


# --- filters of fixed size ------------------------------------------------

def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS):
    """A broadcast bitmap of a well-mixed integer column: no false negatives.

    It only spares rows a shuffle; an exact join follows wherever it is used.
    """
    at = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for r in rows:
        start = (r["bucket"] - 1) * len(r["bits"])
        table[start: start + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(U64) & U64(len(table) * 8 - 1)
    return (table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


# --- passes over the corpus -----------------------------------------------

def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, th, text): an id and a hash of the text tell rows with one id apart."""
    doc, th = _identity(key, text)
    return docs.select(doc.alias("doc"), th.alias("th"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def gram_counts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, gram)
        for batch in batches:
            for got in _phrase_rows(parser, batch):
                yield pa.RecordBatch.from_arrays([pa.array(got["gram"])], names=["gram"])

    return (rows.select("text").mapInArrow(run, "gram bigint").groupBy("gram")
            .agg(F.count(F.lit(1)).alias("n")))


def shared_phrases(rows: DataFrame, grams: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, phrase, doc, th, lo, hi) of all phrases whose gram is one of `grams`."""
    table = key_filter(grams, "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, bits = Parser(length, gram), table.value
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for got in _phrase_rows(parser, batch):
                ok = passes(bits, got["gram"])
                of = got["doc"][ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got["gram"][ok]), pa.array(got["phrase"][ok]), pa.array(doc[of]),
                     pa.array(th[of]), pa.array(got["lo"][ok].astype(np.int32)),
                     pa.array(got["hi"][ok].astype(np.int32))],
                    names=["gram", "phrase", "doc", "th", "lo", "hi"])

    found = rows.mapInArrow(run, "gram bigint, phrase bigint, doc bigint, th bigint, lo int, hi int")
    return found.join(grams.select("gram"), "gram")


def _with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc, th, packed text, list): texts of the documents that have a list."""
    keyed = lists.select("doc", "th", "list", F.xxhash64("doc", "th").alias("key_"))
    table = key_filter(keyed, "key_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ok = passes(table.value, batch.column(3).to_numpy())
            batch = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([pack(t) for t in _utf8(batch.column(2).to_pylist())], pa.binary())],
                names=["doc", "th", "packed"])

    texts = rows.select("doc", "th", "text", F.xxhash64("doc", "th").alias("key_")).mapInArrow(
        run, "doc bigint, th bigint, packed binary")
    return texts.join(keyed.drop("key_"), ["doc", "th"])


def _phrase_bytes(rows: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """(gram, doc, th, lo, single, large, bytes) of one occurrence of every phrase of `reps`."""
    lists = reps.groupBy("doc", "th").agg(F.collect_list(
        F.struct("gram", "lo", "hi", "single", "large")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for doc, th, packed, of in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = unpack(packed) if packed else b""
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["gram"] for x in of], pa.int64()),
                    pa.array([doc] * len(of), pa.int64()), pa.array([th] * len(of), pa.int64()),
                    pa.array([x["lo"] for x in of], pa.int32()),
                    pa.array([x["single"] for x in of], pa.bool_()),
                    pa.array([x["large"] for x in of], pa.bool_()),
                    pa.array([text[x["lo"]: x["hi"] + length] for x in of], pa.binary())],
                    names=["gram", "doc", "th", "lo", "single", "large", "bytes"])

    joined = _with_lists(rows, lists)
    # a batch of few rows stands for a whole text each: join the small batches again
    return joined.mapInArrow(_rebatched(run), "gram bigint, doc bigint, th bigint, lo int, "
                                              "single boolean, large boolean, bytes binary")


def _rebatched(run, rows: int = 4_000):
    """`run` with its small result batches put together."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return whole


def _window_hashes(powers: Powers, parts: list[bytes], length: int):
    """(part, start within the part, hash) of every window of the parts."""
    size = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(size) - size
    count = np.maximum(size - length + 1, 0)
    part = np.repeat(np.arange(len(parts)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = starts[part] + within
    sums = powers.sums(np.frombuffer(b"".join(parts), np.uint8))
    return part, within, powers.span(sums, at, at + length)


def _small_groups(phrases: DataFrame, length: int) -> DataFrame:
    """(doc, th, lo, hi): runs of repeated windows of single phrases, gram by gram."""
    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = table.combine_chunks()
        part, within, h = _window_hashes(powers_of[0], cols["bytes"].to_pylist(), length)
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        single = cols["single"].to_numpy(zero_copy_only=False)
        hit = np.flatnonzero((times[inverse] > 1) & single[part])
        if not len(hit):
            return
        p, w = part[hit], within[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(hit)) - 1
        lo = cols["lo"].to_numpy()[p[a]]
        yield pa.RecordBatch.from_arrays(
            [cols["doc"].combine_chunks().take(pa.array(p[a])),
             cols["th"].combine_chunks().take(pa.array(p[a])),
             pa.array((lo + w[a]).astype(np.int32)), pa.array((lo + w[b]).astype(np.int32))],
            names=["doc", "th", "lo", "hi"])

    powers_of: list[Powers] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers_of[:] = [Powers()]
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows >= 4 * GROUP:
                gram = held["gram"].to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))      # the last gram may go on
                if cut:
                    yield from resolve(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from resolve(held)

    return (phrases.filter("NOT large").select("gram", "doc", "th", "lo", "single", "bytes")
            .repartition("gram").sortWithinPartitions("gram")
            .mapInArrow(run, "doc bigint, th bigint, lo int, hi int"))


def _large_groups(phrases: DataFrame, length: int) -> DataFrame:
    """The same for grams of many phrases: windows are counted, whatever task holds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for i in range(0, whole.num_rows, 4_000):
                batch = whole.slice(i, 4_000)
                part, within, h = _window_hashes(powers, batch.column(5).to_pylist(), length)
                lo = batch.column(3).to_numpy()[part]
                take = pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(h.view(np.int64)),
                     batch.column(1).take(take), batch.column(2).take(take),
                     pa.array((lo + within).astype(np.int32)), batch.column(4).take(take)],
                    names=["gram", "window", "doc", "th", "lo", "single"])

    windows = settle(
        phrases.filter("large").select("gram", "doc", "th", "lo", "single", "bytes")
        .mapInArrow(run, "gram bigint, window bigint, doc bigint, th bigint, lo int, single boolean"),
        "windows")
    twice = (windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .drop("n"))
    return (windows.filter("single").join(twice, ["gram", "window"])
            .select("doc", "th", "lo", F.col("lo").alias("hi")))


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, th, kind, lo, hi) by which a text's repeated windows are known.

    Windows lo..hi of kind 0 (a phrase that shares its gram) all repeat unless a
    row of kind 1 with this lo says that the phrase occurs once; those of kind 2
    repeat.
    """
    shared = gram_counts(rows, length, gram).filter("n > 1")
    found = settle(shared_phrases(rows, settle(shared.select("gram"), "grams"), length, gram),
                   "phrases")
    kinds = settle(found.groupBy("gram", "phrase").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "lo", "hi")).alias("rep")),
        "dictionary")
    # phrases whose gram stands in a phrase that occurs once
    mixed = kinds.groupBy("gram").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m"))
    reps = (kinds.join(mixed.filter("least = 1 AND m > 1"), "gram")
            .select("gram", "rep.*", (F.col("n") == 1).alias("single"),
                    (F.col("m") > GROUP).alias("large")))
    phrases = settle(_phrase_bytes(rows, reps, length), "phrase-bytes")
    some = _small_groups(phrases, length).unionByName(_large_groups(phrases, length))
    return (found.select("doc", "th", F.lit(0).alias("kind"), "lo", "hi")
            .unionByName(kinds.filter("n = 1").select("rep.doc", "rep.th", F.lit(1).alias("kind"),
                                                      "rep.lo", "rep.hi"))
            .unionByName(some.withColumn("kind", F.lit(2))))


def removed_spans(found: list, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte ranges that repeated windows cover, from rows of `repeated_windows`."""
    once = {x["lo"] for x in found if x["kind"] == 1}
    runs = sorted((x["lo"], x["hi"] + length) for x in found
                  if x["kind"] == 2 or x["kind"] == 0 and x["lo"] not in once)
    out: list[list[int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made smaller so that no character is cut."""
    out = []
    for a, b in spans:
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
          T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id",
                   length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document doc_id, th, spans and kept (the bytes that stay), if any go.

    A byte goes if a string of `length` bytes covers it that starts at another
    place too, in the same text or in another; matches never cross documents.
    Documents that lose nothing have no row; (doc_id, th) may repeat for repeated
    rows, which lose the same bytes. th is a 64-bit hash of the text, null as
    empty.
    """
    rows = _identified(docs, key, text)
    lists = settle(repeated_windows(rows, length, gram).groupBy("doc", "th").agg(
        F.collect_list(F.struct("kind", "lo", "hi")).alias("list")), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            for doc, th, packed, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = removed_spans(found, length)
                if spans:
                    whole = unpack(packed)
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(whole[at:a])
                        at = b
                    kept.append(whole[at:])
                    rest = b"".join(kept)
                    out.append((doc, th, sum(b - a for a, b in spans), len(spans),
                                hashlib.sha256(rest).hexdigest(),
                                [{"start": a, "end": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, arrow)],
                names=["doc", "th", "n_removed", "n_spans", "kept_sha256", "spans"])

    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return _with_lists(rows, lists).mapInArrow(
        run, "doc bigint, th bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
             "spans array<struct<start: bigint, end: bigint>>")


def _identity(key: str, text: str) -> tuple[Column, Column]:
    """The id and 64 bits of the text; rows without an id go by 128 bits of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return (F.coalesce(F.col(key).cast("bigint"), F.xxhash64(whole, F.lit("no id"))),
            F.xxhash64(whole))


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH,
            gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs`.

    Null texts are empty. Texts shorter than `length` bytes keep everything. Of an
    empty table nothing comes out. Repeated rows repeat each other and so lose
    everything from `length` bytes on.
    """
    found = settle(remove_repeats(docs, text, key, length, gram).drop("spans"), "removed")
    found = found.dropDuplicates(["doc", "th"])
    doc, th = _identity(key, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), doc.alias("doc"), th.alias("th"),
                       F.octet_length(whole).cast("bigint").alias("n_bytes"),
                       F.sha2(whole, 256).alias("sha_"))
    return rows.join(found, ["doc", "th"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "sha_").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    length: int = LENGTH, chars: str | None = "n_chars") -> DataFrame:
    """`docs` with repeated strings cut out of the text, never within a character.

    All rows and columns stay; the column `chars`, if there is one, is counted
    anew. A null text stays null.
    """
    spans = settle(remove_repeats(docs, text, key, length).select("doc", "th", "spans"),
                   "removed").dropDuplicates(["doc", "th"])
    doc, th = _identity(key, text)
    keyed = docs.withColumns({"doc__": doc, "th__": th})
    joined = keyed.join(spans.select(F.col("doc").alias("doc__"), F.col("th").alias("th__"),
                                     F.col("spans").alias("spans__")),
                        ["doc__", "th__"], "left").select(*docs.columns, "spans__")
    at, cut = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, found in zip(batch.column(at).to_pylist(), batch.column(cut).to_pylist()):
                if found:
                    whole, kept, begin = t.encode("utf-8"), [], 0
                    for a, b in whole_characters(whole, [(x["start"], x["end"]) for x in found]):
                        kept.append(whole[begin:a])
                        begin = b
                    t = (b"".join(kept) + whole[begin:]).decode("utf-8")
                out.append(t)
            cols = list(batch.columns[:cut])
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:cut])

    done = joined.mapInArrow(run, docs.schema)
    if chars and chars in docs.columns:
        done = done.withColumn(chars, F.when(F.col(text).isNull(), F.col(chars)).otherwise(
            F.char_length(text)).cast(docs.schema[chars].dataType))
    return done
