"""What the operators of this subpackage share.

Rows are read by Arrow batches; a batch is worked on in chunks of about a
megabyte of text, so memory does not follow the number of rows of a batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CHUNK = 1 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64

MakeArrays = Callable[[], Callable[[list], Sequence]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column, modulus: int, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; a null id is always held out."""
    crc = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(True))


def attach(df: DataFrame, column: str, make: MakeArrays, fields: Sequence[T.StructField]) -> DataFrame:
    """All columns of `df` and those that `make()` computes from one of them.

    `make` is called once per task and returns a function from a list of values
    to one sequence per new field.
    """
    types = {f.name: f.dataType for f in fields}
    clash = set(types) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(t) for t in types.values()]
    names = [*df.columns, *types]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            new = compute(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(v, type=t) for v, t in zip(new, arrow)]], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; equal in, equal out, on every machine."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= MIX1
    x ^= x >> U64(27)
    x *= MIX2
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            def grown(b: int) -> np.ndarray:
                out = np.full(n, b, U64)
                out[0] = 1
                return np.cumprod(out, dtype=U64)

            self.up, self.down = grown(self.base), grown(self.inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums that `span` reads; one more than `data`."""
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * self.up[: len(data)], dtype=U64, out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal contents give equal hashes wherever they stand."""
        return mix((sums[end] - sums[start]) * self.down[start] ^ (end - start).astype(U64))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters, digits and bytes of other scripts."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def chunks(texts: Sequence[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes together; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; every operator takes the path as a parameter."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def bounded_sample(df: DataFrame, by: str, key: Column, rows: int, values: int = 512) -> DataFrame:
    """About `rows` rows of each of the `values` most frequent values of `by`.

    One count per value, then a filter by the hash of `key` against a table of
    at most `values` rows: no sort, no group in one task, no shuffle of what the
    rows hold. Values with fewer rows are kept whole.
    """
    spread = F.pmod(F.xxhash64(key), F.lit(1_000_000))
    counts = (df.groupBy(by).agg(F.count(F.lit(1)).alias("n__"))
              .orderBy(F.desc("n__"), by).limit(values))
    return (df.join(F.broadcast(counts), by)
            .filter(spread < F.lit(rows) * F.lit(1e6) / F.col("n__")).drop("n__"))
