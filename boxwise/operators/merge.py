"""Set operations and keyed writes as DataFrames: first wins, last wins, field-level merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: a value of ``new`` that is not null replaces the old one; rows of either side stay."""
    fields = list(dict.fromkeys([*old.columns, *new.columns]))
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    side = lambda x, df, c: F.col(f"{x}.{c}") if c in df.columns else F.lit(None)
    return joined.select(*[F.coalesce(side("b", new, c), side("a", old, c)).alias(c) for c in fields])


def save_or_update(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``old`` and the rows of new keys; where a key is there already, only ``fields`` are taken from ``new``, nulls as well."""
    there = new.select(*keys, F.struct(*fields).alias("_new"))
    # nulls in keys are values like any other
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = old.alias("a").join(there.alias("b"), on, "left")
    kept = joined.select(*[F.when(F.col("b._new").isNotNull(), F.col(f"b._new.{c}")).otherwise(F.col(f"a.{c}")).alias(c) if c in fields else F.col(f"a.{c}") for c in old.columns])
    added = new.alias("a").join(old.select(*keys).alias("b"), on, "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in ``gone``; an empty list of keys is refused, as it would match every row."""
    if not keys:
        raise ValueError("name the keys to delete by")
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def unique_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand for more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
