"""The job table as files: a change rewrites the buckets it touches and no others.

Rows lie in buckets by a hash of their id. A change finds the buckets that hold rows it
concerns, writes these anew beside the old ones, and then publishes a list of which
version of each bucket is valid. Publishing is one exclusive rename: readers see all of a
change or nothing, and of two writers that began on one list the second is refused.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from wordreel.operators import jobs as J
from wordreel.session import children, publish, read_text, remove

BUCKETS = 64


class JobTable:
    """Jobs under a path; `id` is their key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _lists(self) -> list[int]:
        return sorted(int(n[5:-5]) for n in children(self.spark, self.path)
                      if n.startswith("list-") and n.endswith(".json"))

    def _list(self) -> dict:
        numbers = self._lists()
        if not numbers:
            raise FileNotFoundError(f"no job table under {self.path}")
        return json.loads(read_text(self.spark, self._name(numbers[-1])))

    def _name(self, number: int) -> str:
        return os.path.join(self.path, f"list-{number:08}.json")

    def _bucket_path(self, bucket: str, version: str) -> str:
        return os.path.join(self.path, f"version={version}", f"bucket={bucket}")

    def _rows(self, now: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(now["schema"])
        paths = [self._bucket_path(b, now["valid"][b]) for b in buckets if b in now["valid"]]
        return (self.spark.read.schema(schema).parquet(*paths) if paths
                else self.spark.createDataFrame([], schema))

    def _write(self, rows: DataFrame, number: int, buckets: int) -> dict[str, str]:
        """Write rows by bucket into a folder of this writer's own; version by bucket."""
        version = f"{number}-{uuid.uuid4().hex}"
        folder = os.path.join(self.path, f"version={version}")
        rows.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.partitionBy(
            "bucket").parquet(folder)
        return {n[7:]: version for n in children(self.spark, folder) if n.startswith("bucket=")}

    def create(self, jobs: DataFrame, buckets: int = BUCKETS) -> None:
        found = self._write(jobs, 0, buckets)
        publish(self.spark, self._name(0), json.dumps(
            {"number": 0, "buckets": buckets, "schema": jobs.schema.jsonValue(),
             "valid": found}))

    def read(self) -> DataFrame:
        now = self._list()
        return self._rows(now, list(now["valid"]))

    def change(self, concerned: Callable[[DataFrame], DataFrame],
               make: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Rewrite the buckets of the ids that `concerned(jobs)` names with `make(jobs)`.

        `make` must leave all other rows as they are. At most one number per bucket
        comes to the driver. The buckets that were rewritten are returned.
        """
        now = self._list()
        jobs = self._rows(now, list(now["valid"]))
        ids = concerned(jobs).select(_bucket(now["buckets"]).alias("bucket")).distinct()
        touched = sorted(str(r["bucket"]) for r in ids.collect())
        touched = [b for b in touched if b in now["valid"]]
        if not touched:
            return []
        number = now["number"] + 1
        found = self._write(make(self._rows(now, touched)), number, now["buckets"])
        valid = {b: v for b, v in now["valid"].items() if b not in touched}
        publish(self.spark, self._name(number), json.dumps(
            now | {"number": number, "valid": valid | found}))
        return touched

    def mark_seen(self, acks: DataFrame) -> list[str]:
        """Set `seen` on the jobs that their users name (user_id, id)."""
        return self.change(lambda jobs: acks.select("id").distinct(),
                           lambda jobs: J.mark_seen(jobs, acks))

    def mark_stale(self, now: Column) -> list[str]:
        """Jobs without a sign of life have failed."""
        return self.change(lambda jobs: J.silent_jobs(jobs, now).select("id"),
                           lambda jobs: J.mark_stale(jobs, now))

    def purge(self, now: Column) -> list[str]:
        """Jobs past their retention go."""
        return self.change(lambda jobs: J.expired_jobs(jobs, now).select("id"),
                           lambda jobs: J.surviving_jobs(jobs, now))

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest lists, and versions of buckets that none of them names."""
        numbers = self._lists()
        for n in numbers[:-keep]:
            remove(self.spark, self._name(n))
        named = set()
        for n in numbers[-keep:]:
            named |= {(b, v) for b, v in
                      json.loads(read_text(self.spark, self._name(n)))["valid"].items()}
        for folder in children(self.spark, self.path):
            # a writer that has not published yet is left alone
            if folder.startswith("version=") and int(folder[8:].split("-")[0]) <= numbers[-1]:
                for b in children(self.spark, os.path.join(self.path, folder)):
                    if b.startswith("bucket=") and (b[7:], folder[8:]) not in named:
                        remove(self.spark, os.path.join(self.path, folder, b))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
