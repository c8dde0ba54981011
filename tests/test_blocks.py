"""Words stay in the blocks in which they are read: only rows about blocks, cuts and spans move."""

from __future__ import annotations

import duckdb
import pytest

from check import canonical
from wordreel.operators import detect as D, scan as S
from wordreel.plans.registry import load
from wordreel.sources import tables as T

SAID = "so. the the cat of sat on a der mat, and er it ran. to to que it".split()
LONG = 9000             # words of the longest take, over two blocks


def text(take: int, n: int, stop: int) -> str:
    """`n` words; at `stop` a stretch without punctuation begins, longer than a block."""
    said = [SAID[(i * (take + 3) + i // 7) % len(SAID)] for i in range(n)]
    return " ".join(w.strip(".,") if i >= stop else w for i, w in enumerate(said))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("blocks")
    rows = [(1, text(1, LONG, 4000)), (2, text(2, LONG, LONG)), (3, text(3, 4097, 4097)),
            (4, text(4, 4096, 4096)), (5, "one"), (6, " \n "), (7, text(7, 60, 60)), (8, text(8, 300, 90))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(
        f"{folder}/documents.parquet")
    return str(folder)


def moved(plan) -> int:
    """Rows that the shuffles of a plan wrote, those read again counted once."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return moved(plan.executedPlan())
    if "QueryStageExec" in name:
        return moved(plan.plan())
    if name == "ReusedExchangeExec":
        return 0
    written = plan.metrics().get("shuffleRecordsWritten")
    own = written.get().value() if written.isDefined() else 0
    children = plan.children()
    return own + sum(moved(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("name", [
    "ass_documents", "clip_ass_documents", "word_events", "clip_word_events", "karaoke_cues", "cues",
    "srt_documents", "phrases_punct", "phrases_measured", "phrases_from_cuts", "retimed_words",
    "assigned_words", "tightened_srt", "detected_again", "usable_phrases", "merged_cuts"])
def test_words_are_not_shuffled(spark, tables, name):
    found = load()[name]
    df = found.run(spark, tables)
    got = df.toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    want = con.execute(found.sql).df()
    assert canonical(got).equals(canonical(want))
    words = T.words(spark, tables).count()
    df.collect()
    assert moved(df._jdf.queryExecution().executedPlan()) < words


def test_neighbours_over_empty_blocks(spark):
    """The next word may lie several blocks on; nothing is made up at the ends of a take."""
    rows = [(1, 0, 0, 10), (1, 0, 1, 20), (1, 3, 2, 30), (1, 4, 3, None), (2, 0, 0, 40)]
    df = spark.createDataFrame(rows, "take_id long, blk long, idx long, v int")
    out = S.with_neighbours(df, ["take_id"], "idx", prev={"p": "v"}, next={"n": "v"}, block="blk")
    assert sorted(tuple(r) for r in out.select("take_id", "idx", "p", "n").collect()) == [
        (1, 0, None, 20), (1, 1, 10, 30), (1, 2, 20, None), (1, 3, 30, None), (2, 0, None, None)]


def test_merge_over_blocks_of_time(spark):
    """An island that goes on in later blocks is one cut with its best member; others stay."""
    span = S.SPAN_MS
    rows = [(1, 100, span + 5_000, 60), (1, span + 1_000, 2 * span + 900, 90),
            (1, 2 * span + 800, 2 * span + 2_000, 70), (1, 3 * span, 3 * span + 500, 50), (1, 20, 40, 55)]
    cuts = spark.createDataFrame([(t, a, b, "filler", p, f"{p}", True, a) for t, a, b, p in rows],
                                 "take_id long, start_ms long, end_ms long, reason string,"
                                 " confidence_pct int, text string, auto boolean, ord long")
    out = D.merge_cuts(cuts, cfg=D.TightenConfig(edge_padding_ms=0)).select(
        "start_ms", "end_ms", "confidence_pct", "text").collect()
    assert sorted(tuple(r) for r in out) == [
        (20, 40, 55, "55"), (100, 2 * span + 2_000, 90, "90"), (3 * span, 3 * span + 500, 50, "50")]
