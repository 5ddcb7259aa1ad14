"""Ranges of stats by bin, and coloured cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.functions.scalars import colour


def stat_ranges(long: DataFrame, bins: str = "bins", key: str = "stat_key", value: str = "value", width: float = 2.0) -> DataFrame:
    """(bin, key, lower, upper): mean +- ``width`` sample deviations, not across 0 where all values are on one side.

    ``bins`` is an array; a row counts in each of its bins and in ALL.
    """
    each = long.select(F.explode(F.array_union(F.col(bins), F.array(F.lit("ALL")))).alias("bin"), key, value)
    x = F.col(value)
    s = each.groupBy("bin", key).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    lower, upper = F.col("m") - width * F.col("s"), F.col("m") + width * F.col("s")
    return s.select(
        "bin", key,
        F.when((F.col("lo") >= 0) & (lower < 0), 0.0).otherwise(lower).alias("lower"),
        F.when((F.col("hi") <= 0) & (upper > 0), 0.0).otherwise(upper).alias("upper"),
    )


def coloured(long: DataFrame, ranges: DataFrame, on: list[str], value: str = "value", reversed_keys: tuple[str, ...] = (), key: str = "stat_key") -> DataFrame:
    """Rows with the colour of their value in the range of their bin and key; ``transparent`` without one."""
    joined = long.join(ranges, on, "left")
    return joined.withColumn("colour", colour(F.col(value), F.col("lower"), F.col("upper"), F.col(key).isin(*reversed_keys)))


def ranges_as_of(ranges: DataFrame, day: str, on: list[str], as_of: str = "as_of") -> DataFrame:
    """The latest ranges at or before a day, for each of ``on``."""
    return ranges.where(F.col(as_of) <= F.lit(day).cast("date")).groupBy(*on).agg(F.max_by(F.struct("lower", "upper"), as_of).alias("r")).select(*on, "r.*")
