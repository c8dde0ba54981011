"""Ordered computations over one take that do not need the take in one task.

A take can be most of the corpus, so no window here is partitioned by the take
alone. Rows are cut into blocks of a bounded span (of position or of time):

* ``with_neighbours`` copies the few rows at a block's edge into the next block
  and runs lag/lead per block: one shuffle, no join;
* ``running`` computes prefix sums and prefix maxima per block, then adds what
  the earlier blocks of the take contribute, which is one row per block, and where
  those are many themselves (``deep``) one row per block of blocks;
* ``ranked`` numbers rows along any order: they are sorted over all tasks, numbered
  within tasks, and what earlier tasks hold is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordreel.session import settle

BLOCK = 4096            # rows of one take per block of positions
SPAN_MS = 600_000       # width of one block of time


def position_block(position: str | Column, size: int = BLOCK) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.call_function("div", position.cast("bigint"), F.lit(size).cast("bigint"))


def time_block(ms: str | Column, span: int = SPAN_MS) -> Column:
    return position_block(ms, span)


def carried(words: DataFrame) -> str | None:
    """The block column of words that lie by blocks already, `blk`; None for others.

    It never decreases along the positions of a take. Work by (take, `blk`) leaves such
    words where they are: only rows about blocks move between tasks.
    """
    return "blk" if "blk" in words.columns else None


def blocked(words: DataFrame) -> DataFrame:
    """`words` with their block `blk`."""
    return words if carried(words) else words.withColumn("blk", position_block("idx"))


def _halo(df: DataFrame, position: str, size: int, before: int, after: int) -> DataFrame:
    """Copy the last `before` rows of each block forward and the first `after` back."""
    home = position_block(position, size)
    offset = F.col(position) - home * F.lit(size)
    copies = F.when(F.lit(False), F.array(home))
    if before:
        copies = copies.when(offset >= size - before, F.array(home, home + 1))
    if after:
        copies = copies.when((offset < after) & (home > 0), F.array(home, home - 1))
    return df.withColumn("blk_", F.explode(copies.otherwise(F.array(home))))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
    size: int = BLOCK,
    block: str | None = None,
) -> DataFrame:
    """Add columns of the previous and next row of the take.

    `prev` and `next` map a new column to the column it is read from;
    `position` must count 0, 1, 2, ... within the keys. Rows that have a `block` (see
    `carried`) stay in it: the edges of blocks, two rows each, travel instead.
    """
    if block:
        return _with_edges(df, keys, position, prev or {}, next or {}, block)
    w = Window.partitionBy(*keys, "blk_").orderBy(position)
    out = _halo(df, position, size, before=1 if prev else 0, after=1 if next else 0)
    new = {n: F.lag(c).over(w) for n, c in (prev or {}).items()}
    new |= {n: F.lead(c).over(w) for n, c in (next or {}).items()}
    out = out.withColumns(new)
    return out.filter(F.col("blk_") == position_block(position, size)).drop("blk_")


def _with_edges(df: DataFrame, keys: Sequence[str], position: str, prev: dict[str, str],
                next: dict[str, str], block: str) -> DataFrame:
    w = Window.partitionBy(*keys, block).orderBy(position)
    local = df.withColumns(
        {f"l_{n}": F.lag(c).over(w) for n, c in prev.items()}
        | {f"l_{n}": F.lead(c).over(w) for n, c in next.items()}
        | {"head_": F.lag(F.lit(True), 1, False).over(w), "tail_": F.lead(F.lit(True), 1, False).over(w)})
    # The keys of the edges are values of their groups, so that no filter on them
    # reaches the source: both readers of `df` then share its shuffles.
    edge = lambda of, off: F.max(F.when(~F.col(off), F.struct(
        *[F.col(c).alias(n) for n, c in of.items()] or [F.lit(0)])))
    edges = local.filter("NOT head_ OR NOT tail_").groupBy(*keys, block).agg(
        *[F.max(k).alias(f"k_{k}") for k in [*keys, block]],
        edge(prev, "tail_").alias("last_"), edge(next, "head_").alias("first_")).drop(*keys, block)
    along = Window.partitionBy(*[f"k_{k}" for k in keys]).orderBy(f"k_{block}")
    edges = edges.select(*[f"k_{k}" for k in [*keys, block]],
                         F.lag("last_").over(along).alias("before_"),
                         F.lead("first_").over(along).alias("after_"))
    on = [F.col(k) == F.col(f"k_{k}") for k in [*keys, block]]
    return local.join(edges, on, "left").select(
        *df.columns,
        *[F.when(F.col("head_"), F.col(f"l_{n}")).otherwise(F.col("before_")[n]).alias(n)
          for n in prev],
        *[F.when(F.col("tail_"), F.col(f"l_{n}")).otherwise(F.col("after_")[n]).alias(n)
          for n in next])


def with_recent(
    df: DataFrame, keys: Sequence[str], position: str, name: str, value: Column, depth: int,
    size: int = BLOCK, derived: dict[str, Column] | None = None,
) -> DataFrame:
    """Add an array of `value` over the previous `depth` rows, nearest first.

    `derived` columns, which `value` may use, are computed after rows went to their blocks.
    """
    w = Window.partitionBy(*keys, "blk_").orderBy(position).rowsBetween(-depth, -1)
    out = _halo(df, position, size, before=depth, after=0).repartition(*keys, "blk_")
    out = out.withColumns(derived or {})
    out = out.withColumn(name, F.reverse(F.collect_list(value).over(w)))
    return out.filter(F.col("blk_") == position_block(position, size)).drop("blk_")


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str | Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    deep: bool = False,
) -> DataFrame:
    """Add exclusive running sums (0 at the start) and maxima (NULL at the start).

    `block` is a bounded block number that never decreases along `order`.
    `df` is read twice, so hand in a table or a settled frame when it is costly.
    With `deep` no task sees all blocks of a key: blocks are scanned in blocks of
    their own, for keys (or a whole table, without keys) of very many rows.
    """
    sums, maxima = sums or {}, maxima or {}
    values = {f"v_{n}": e for n, e in {**sums, **maxima}.items()}
    base = df.withColumns(values)

    totals = base.groupBy(*keys, block).agg(
        *[F.sum(f"v_{n}").alias(f"t_{n}") for n in sums],
        *[F.max(f"v_{n}").alias(f"t_{n}") for n in maxima],
    )
    carry = _carried(totals, keys, block, [f"t_{n}" for n in sums], [f"t_{n}" for n in maxima], deep)
    carry = carry.withColumnsRenamed({f"t_{n}": f"c_{n}" for n in {**sums, **maxima}})
    in_block = (
        Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = base.withColumns(
        {f"l_{n}": F.coalesce(F.sum(f"v_{n}").over(in_block), F.lit(0)) for n in sums}
        | {f"l_{n}": F.max(f"v_{n}").over(in_block) for n in maxima}
    )
    joined = local.join(carry, [*keys, block])
    done = joined.withColumns(
        {n: F.col(f"l_{n}") + F.col(f"c_{n}") for n in sums}
        | {n: F.greatest(f"l_{n}", f"c_{n}") for n in maxima}
    )
    return done.drop(*[f"{p}_{n}" for n in {**sums, **maxima} for p in "vlc"])


def _carried(totals: DataFrame, keys: Sequence[str], block: str, sums: list[str],
             maxima: list[str], deep: bool) -> DataFrame:
    """For one row per block what the blocks before it hold, under the same names.

    If not `deep`, one window sees all blocks of a key; if so, a block of blocks, and
    what earlier ones of these hold is added: one row for `BLOCK` ** 2 positions.
    """
    group = [*keys, "sup_"] if deep else list(keys)
    rows = totals.withColumn("sup_", position_block(block)) if deep else totals
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        *group, block, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums],
        *[F.max(c).over(before).alias(c) for c in maxima])
    if not deep:
        return local
    above = rows.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums],
                                     *[F.max(c).alias(c) for c in maxima])
    far = _carried(above, keys, "sup_", sums, maxima, False).withColumnsRenamed(
        {c: f"far_{c}" for c in sums + maxima})
    return local.join(far, group).select(
        *keys, block, *[(F.col(c) + F.col(f"far_{c}")).alias(c) for c in sums],
        *[F.greatest(c, f"far_{c}").alias(c) for c in maxima])


def in_order(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """`df` written in this order over all tasks, with the number of the task as `blk_`."""
    return settle(df.repartitionByRange(*order).withColumn(
        "blk_", F.spark_partition_id().cast("bigint")), name)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the rank from 1 within the keys; a key with most of the rows is many tasks' work."""
    placed = in_order(df, [*[F.col(k) for k in keys], *order], f"ranked-{name}")
    counted = running(placed, keys, "blk_", order, sums={name: F.lit(1)})
    return counted.withColumn(name, F.col(name) + 1).drop("blk_")


def numbered(df: DataFrame, keys: Sequence[str], position: str, name: str,
             size: int = BLOCK) -> DataFrame:
    """Add a 0-based dense number along an integer `position`, unique per key."""
    out = df.withColumn("blk_", position_block(position, size))
    return running(out, keys, "blk_", [position], sums={name: F.lit(1)}).drop("blk_")


def join_takes(df: DataFrame, takes: DataFrame, how: str = "inner",
               on: str | Sequence[str] = "take_id") -> DataFrame:
    """Join rows of all kinds of takes to one row per take.

    Where Spark sees that the take side is small it broadcasts it, behind its own
    size check; else adaptive execution splits the rows of a hot take over
    several tasks, as nothing above this join needs them together.
    """
    return df.join(takes, [on] if isinstance(on, str) else list(on), how)
