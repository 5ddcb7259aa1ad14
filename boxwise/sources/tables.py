"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxwise.session import share_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``, by any path that Spark can read."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 150_000) -> DataFrame:
    """``df`` partitioned by a key, in as many partitions as it has ``rows`` rows (but one for each core), so that a task's memory does not grow with the table."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // rows)), key)
