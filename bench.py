"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default
8) the cores. Each query is first run on the smallest tables, then timed once on
the named ones, written to a sink that keeps every column and drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import Observation, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from wordreel.plans.registry import load  # noqa: E402
from wordreel.session import local_session  # noqa: E402

HEADLINE = (
    "words", "word_gaps", "filler_scores", "merged_cuts", "summary", "kept_offsets", "retimed_words",
    "usable_phrases", "retake_groups", "cues", "word_events", "edit_events", "fit_to_length",
    "clip_audit", "recent_jobs", "user_stats", "latest_status",
)
SMALLEST = "/root/testdata/sf0.001"


def timed(df_of, spark, sf_dir: str) -> tuple[float, int]:
    seen = Observation()
    start = time.time()
    df = df_of(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3), seen.get["rows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="wordreel-bench")
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds, rows, first = load(), {}, {}, {}
    for name in HEADLINE:
        first[name], _ = timed(known[name].run, spark, SMALLEST)
        seconds[name], rows[name] = timed(known[name].run, spark, sf_dir)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "rows": rows,
        "cold_smallest": first, "cpus": os.environ.get("BENCH_CPUS", "8"),
        "spark": spark.version, "driver_memory": "16g"}))


if __name__ == "__main__":
    main()
