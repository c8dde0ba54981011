"""One list of queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None = None


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql)
        return run

    return add


def load() -> dict[str, Query]:
    """Import every module that registers queries."""
    from wordreel.plans import (  # noqa: F401
        caption_queries, clip_queries, fit_queries, retake_queries, source_queries,
        stream_queries, word_queries)

    return QUERIES
