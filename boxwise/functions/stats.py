"""Statistics as column builders: closed forms of resampled ones, exponential weights, weighted means.

Every builder returns a Column that works as an aggregate, also over a window.
Nulls are missing values; they never count as numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def _over(value: Column, window: WindowSpec | None) -> Column:
    return value if window is None else value.over(window)


def bootstrap_mean(x: Column, window: WindowSpec | None = None) -> Column:
    """Expected mean of resamples with replacement: the mean."""
    return _over(F.avg(x), window)


def bootstrap_var(x: Column, window: WindowSpec | None = None) -> Column:
    """Expected sample variance of resamples: the population variance; null for a single row."""
    return F.when(_over(F.count(F.lit(1)), window) > 1, _over(F.var_pop(x), window))


def bayesian_mean(x: Column, window: WindowSpec | None = None) -> Column:
    """Expected mean under Dirichlet(1, ..., 1) row weights, where a null adds nothing but keeps its weight."""
    return F.try_divide(_over(F.sum(x), window), _over(F.count(F.lit(1)), window))


def bayesian_var(x: Column, window: WindowSpec | None = None) -> Column:
    """Expected variance of draws with Dirichlet probabilities: var_pop k / (k + 1) for k values."""
    k = _over(F.count(x), window)
    return _over(F.var_pop(x), window) * k / (k + 1)


def bayesian_var_of_sums(n: Column, total: Column, squares: Column) -> Column:
    """``bayesian_var`` from the number of values, their sum and the sum of their squares."""
    return F.when(n > 0, F.greatest(squares - total * total / n, F.lit(0.0)) / (n + 1))


def exponential_mean(values: Column, rows: Column) -> Column:
    """Exponentially weighted mean of an array, oldest value first, without nulls; the span is ``rows``."""
    return mean_of_sums(exponential_sums(values, rows))


def exponential_var(values: Column, rows: Column) -> Column:
    """Exponentially weighted variance, corrected for bias; null for fewer than two values."""
    return var_of_sums(exponential_sums(values, rows))


def mean_of_sums(s: Column) -> Column:
    return F.try_divide(s["wx"], s["w"])


def var_of_sums(s: Column) -> Column:
    """The variance from a column of ``exponential_sums``; there it is worked out once."""
    mean = mean_of_sums(s)
    biased = F.greatest(F.try_divide(s["wxx"], s["w"]) - mean * mean, F.lit(0.0))
    return F.when(s["n"] > 1, F.try_divide(biased * s["w"] * s["w"], s["w"] * s["w"] - s["ww"]))


def exponential_sums(values: Column, rows: Column) -> Column:
    """Number of values, sums of the weights, their squares, and the weighted values and squares, in one pass from the newest."""
    decay = 1 - 2 / (rows + 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(1.0).alias("next"), *[F.lit(0.0).alias(k) for k in ("w", "ww", "wx", "wxx")])

    def add(s: Column, x: Column) -> Column:
        w = s["next"]
        return F.struct(
            (s["n"] + 1).alias("n"), (w * decay).alias("next"), (s["w"] + w).alias("w"), (s["ww"] + w * w).alias("ww"), (s["wx"] + w * x).alias("wx"), (s["wxx"] + w * x * x).alias("wxx")
        )

    return F.aggregate(F.reverse(values), start, add)


def weighted_mean(x: Column, weight: Column) -> Column:
    """Weighted mean whose weights are those of the values that are there."""
    there = x.isNotNull()
    return F.try_divide(F.sum(F.when(there, weight * x)), F.sum(F.when(there, weight)))


def inverse_variance_weight(variance: Column, least: float = 0.01) -> Column:
    return 1 / F.greatest(variance, F.lit(least))


def z_score(x: Column, mean: Column, variance: Column) -> Column:
    """(x - mean) / root of the variance; 0 where x is the mean of values that do not vary; never infinite."""
    return F.when((x == mean) & (variance == 0), F.lit(0.0)).otherwise(F.try_divide(x - mean, F.sqrt(variance)))


def resampled(df: DataFrame, keys: list[str], value: str, statistic, samples: int = 30, seed: int = 1) -> DataFrame:
    """The resampling itself: ``statistic`` (Column -> aggregate Column) averaged over Poisson bootstrap samples.

    Each row counts Poisson(1) times in each sample, by the hash of its columns
    and its number among rows that are alike, so that a rerun draws the same
    and repeated rows draw apart. The rows of a key are spread over its
    samples, which combine on the map side. A statistic that is no Column
    comes from ``of_values``.
    """
    u = _drawn("_place", "_number", "_sample", seed)
    # inverse distribution function of Poisson(1), whose tail beyond 6 is under 1e-4
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    times = sum(F.when(u >= s, 1).otherwise(0) for s in steps)
    drawn = _in_samples(df, samples).withColumn("_times", times)
    rows = drawn.where("_times > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    each = rows.groupBy(*keys, "_sample").agg(statistic(F.col(value)).alias("_statistic"))
    return each.groupBy(*keys).agg(F.avg("_statistic").alias("statistic"))


def _drawn(place: str, number: str, sample: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(place, number, sample, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _in_samples(df: DataFrame, samples: int) -> DataFrame:
    """Each row once for each sample, with the hash of its columns and its number among rows that are alike.

    Rows that are alike are counted and numbered without being brought together.
    """
    alike = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_alike")).withColumn("_place", F.xxhash64(*df.columns))
    placed = alike.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_alike"))).alias("_number"))
    return placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_sample"))


def dirichlet_resampled(df: DataFrame, keys: list[str], value: str, samples: int = 30, seed: int = 1) -> DataFrame:
    """(keys, mean, var): the Bayesian bootstrap drawn: Dirichlet(1, ..., 1) weights of a key's rows, averaged over samples.

    The weights are exponential draws by hash over their sum. In the mean a
    null adds nothing but keeps its weight; the variance is that of the values
    that are there under their own weights, which is what samples drawn by
    these weights have on average. A key without values gets a mean of null
    and a variance of null. ``bayesian_mean`` and ``bayesian_var`` are what
    both tend to. Sums combine on the map side, so no key is brought together.
    """
    weight = -F.log(1 - _drawn("_place", "_number", "_sample", seed))
    x = F.col(value).cast("double")
    there = F.when(x.isNotNull(), F.col("_weight"))
    rows = _in_samples(df, samples).withColumn("_weight", weight)
    sums = rows.groupBy(*keys, "_sample").agg(F.sum("_weight").alias("w"), F.sum(there).alias("t"), F.sum(there * x).alias("wx"), F.sum(there * x * x).alias("wxx"))
    spread = F.greatest(F.try_divide("wxx", "t") - F.pow(F.try_divide("wx", "t"), F.lit(2)), F.lit(0.0))
    each = sums.select(*keys, F.try_divide("wx", "w").alias("mean"), F.when(F.col("t").isNotNull(), spread).alias("var"))
    return each.groupBy(*keys).agg(F.avg("mean").alias("mean"), F.avg("var").alias("var"))


def of_values(function: Callable[[np.ndarray], float | None]) -> Callable[[Column], Column]:
    """An aggregate of a Python function of a key's values (without nulls), for statistics that no Column gives.

    It fits wherever these builders take a statistic (``F.median`` or a
    lambda do as well, and are the faster way). Spark brings the values of a
    key, or of a key's sample, together for it, so keys should be bounded,
    and takes no other kind of aggregate beside it. The function sees one
    array and gives a number, or None for null.
    """

    @F.arrow_udf("double")
    def aggregate(values: pa.Array) -> float:
        x = values.to_numpy(zero_copy_only=False)  # nulls are NaN there
        found = function(x[~np.isnan(x)])
        return float("nan") if found is None else float(found)

    return lambda x: F.nanvl(aggregate(x.cast("double")), F.lit(None).cast("double"))
