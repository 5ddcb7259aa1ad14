"""Layouts that serve as indexes: bucketed tables, whose joins need no exchange, and keyed tables in partitions of which writes touch few."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.operators import merge


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table of the catalog, in ``buckets`` files by the hash of ``keys`` and sorted by them; read back.

    Tables of the same keys and number of buckets join, and aggregate by the
    keys, where they lie. ``partition_by`` are columns of few values, by which
    scans are pruned. What the table held is replaced. Rows go to their bucket's task first, so
    a bucket is one file (of each partition).
    """
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


class BucketedTable:
    """Rows with unique ``keys`` under ``path``, in partitions by the keys' hash; a write replaces the partitions that its keys fall into.

    The other partitions' files stay as they are, so a small batch costs what
    its partitions hold. Spark replaces partitions when the whole job has
    succeeded; there is one writer at a time. Deleted rows stay, marked, in
    their partition, as one without rows would not be replaced; reads leave
    them out. Nulls in keys are values like any other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partitions: int = 64):
        if not keys:
            raise ValueError("a keyed table needs keys")
        self.spark, self.path, self.keys, self.partitions = spark, path.rstrip("/"), keys, partitions

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int")

    def _held(self) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return None

    def read(self) -> DataFrame | None:
        """The rows that are there; None before the first write."""
        held = self._held()
        return None if held is None else held.where("not _gone").drop("_gone", "_part")

    def find(self, keys: DataFrame) -> DataFrame | None:
        """The rows of ``keys``: only the partitions that these fall into are read."""
        held, asked = self._held(), keys.select(*self.keys).distinct()
        return None if held is None else self._touched(held, asked).where("not _gone").drop("_gone", "_part").join(asked, self.keys, "left_semi")

    def _touched(self, held: DataFrame, rows: DataFrame) -> DataFrame:
        """The partitions that keys of ``rows`` fall into, at most ``partitions`` numbers."""
        parts = [r["_part"] for r in rows.select(self._part().alias("_part")).distinct().collect()]
        return held.where(F.col("_part").isin(parts))

    def _write(self, rows: DataFrame) -> None:
        placed = rows.withColumn("_part", self._part()).repartition("_part")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path)

    def _changed(self, rows: DataFrame, change) -> None:
        held = self._held()
        if held is None:
            self._write(change(None, rows).withColumn("_gone", F.lit(False)))
            return
        old = self._touched(held, rows).drop("_part")
        live, gone = old.where("not _gone").drop("_gone"), old.where("_gone")
        new = change(live, rows).withColumn("_gone", F.lit(False))
        self._write(new.unionByName(gone.join(rows.select(*self.keys), self.keys, "left_anti"), allowMissingColumns=True))

    def upsert(self, rows: DataFrame) -> None:
        """Field by field: a value that is not null replaces the old one. Keys must be unique in ``rows``."""
        self._changed(rows, lambda old, new: new if old is None else merge.upsert(old, new, self.keys))

    def save_or_update(self, rows: DataFrame, fields: list[str]) -> None:
        """New keys are inserted; of keys that are there, only ``fields`` are replaced. Keys must be unique in ``rows``."""
        self._changed(rows, lambda old, new: new if old is None else merge.save_or_update(old, new, self.keys, fields))

    def insert_new(self, rows: DataFrame) -> None:
        """Rows whose keys are not there yet; of several with one key, one."""
        once = rows.dropDuplicates(self.keys)
        self._changed(once, lambda old, new: new if old is None else merge.insert_new(old, new, self.keys))

    def delete(self, keys: DataFrame) -> None:
        """Marks the rows of ``keys`` as gone; a later write of the key brings it back."""
        held = self._held()
        if held is not None:
            asked = keys.select(*self.keys).distinct().withColumn("_asked", F.lit(True))
            old = self._touched(held, asked).drop("_part").join(asked, self.keys, "left")
            self._write(old.withColumn("_gone", F.col("_gone") | F.col("_asked").isNotNull()).drop("_asked"))
