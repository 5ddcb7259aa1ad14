"""Keyed Parquet tables: append, merge, first-wins inserts, deletes, and a cache with an age limit.

The table is what the merges of ``operators/merge.py`` make of the last one. A
change is written to a folder of its own by Spark's writer, and then one row
that names the folder is appended to a small table of changes. A write that
dies leaves a folder that no row names, so the next one is not in its way.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.operators import merge


class KeyedTable:
    """A table under ``path`` with unique ``keys``, changed by one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        if not keys:
            raise ValueError("a keyed table needs keys")
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _last(self) -> tuple[int, str] | None:
        """Number and folder of the last change that was finished."""
        try:
            changes = self.spark.read.schema("number bigint, folder string").parquet(f"{self.path}/changes")
        except AnalysisException:  # there is no such folder yet
            return None
        last = changes.agg(F.max(F.struct("number", "folder")).alias("last")).first()["last"]
        return None if last is None else (last["number"], last["folder"])

    def read(self) -> DataFrame | None:
        """The table after the last finished change; None before the first."""
        last = self._last()
        return None if last is None else self.spark.read.parquet(f"{self.path}/{last[1]}")

    def _write(self, df: DataFrame) -> None:
        last, folder = self._last(), f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        row = self.spark.createDataFrame([((last[0] if last else 0) + 1, folder)], "number bigint, folder string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/changes")

    def append(self, rows: DataFrame) -> None:
        """``rows`` as they are, beside what is there; a key that is there already is refused."""
        old = self.read()
        whole = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        if not merge.unique_key_violations(whole, self.keys).isEmpty():
            raise ValueError("a key would stand for more than one row")
        self._write(whole)

    def upsert(self, rows: DataFrame) -> None:
        """Field by field; of several rows of a key in ``rows`` one must be chosen before."""
        old = self.read()
        self._write(rows if old is None else merge.upsert(old, rows, self.keys))

    def insert_new(self, rows: DataFrame) -> None:
        """Rows whose keys are not there yet; of several with one key, one."""
        old = self.read()
        once = rows.dropDuplicates(self.keys)
        self._write(once if old is None else merge.insert_new(old, once, self.keys))

    def delete(self, keys: DataFrame) -> None:
        old = self.read()
        if old is not None:
            self._write(merge.delete(old, keys, self.keys))

    def fresh(self, now: dt.datetime, days: int = 30, at: str = "cached_at") -> DataFrame | None:
        """Rows that are not older than ``days``."""
        old = self.read()
        return None if old is None else old.where(F.col(at) >= F.lit(now - dt.timedelta(days=days)))

    def refresh(self, rows: DataFrame, now: dt.datetime, at: str = "cached_at") -> None:
        """Merges ``rows`` field by field and marks them as of ``now``."""
        self.upsert(rows.withColumn(at, F.lit(now)))
