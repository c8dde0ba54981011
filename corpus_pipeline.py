"""From raw documents to packed training sequences, stage by stage.

Every stage reads what the one before it kept and is written as Parquet, so a
lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordreel.llm import language, neardup, packing, quality, substrings
from wordreel.llm.base import held_out, table
from wordreel.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
P = "verdict__"     # stands before columns that a stage adds and drops again


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go."""
    model = language.train(docs, ~held_out("doc_id", 5))
    return (language.predict(docs, model, prefix=P).filter(~F.col(f"{P}rejected"))
            .select(*docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5))
    return (quality.score(docs, model, prefix=P).filter(F.col(f"{P}predicted") == 1)
            .select(*docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of smallest id."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that stand in several places."""
    return substrings.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None       # none of the stages can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
