"""Feature groups for prediction, and how they become one matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions.scalars import digitize, ratio_to_baseline
from boxwise.operators.joins import interval_mean
from boxwise.operators.windows import trailing


def matchup_rank(pairs: DataFrame, keys: list[str], distance: str, starter: str, base_starts: str, tie: str) -> DataFrame:
    """Opponents of each key by distance; if the base player starts, the nearest starter comes first."""
    by_distance = Window.partitionBy(*keys).orderBy(distance, tie)
    starters = Window.partitionBy(*keys, starter).orderBy(distance, tie)
    first = F.col(base_starts) & F.col(starter) & (F.row_number().over(starters) == 1)
    ranked = pairs.withColumn("_first", first).withColumn("_place", F.row_number().over(by_distance))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_first"), "_place"))
    return ranked.withColumn("rank", place).drop("_first", "_place")


def distribution(df: DataFrame, group: str, stat: str) -> Column:
    """A stat as a share of its group's sum, all shares summing to 1."""
    return F.try_divide(F.col(stat), F.sum(stat).over(Window.partitionBy(group)))


def with_share(df: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """Adds ``share``, a stat over its sum in the group; the sums combine on the map side, so a group may be of any size."""
    totals = df.groupBy(*keys).agg(F.sum(stat).alias("_total"))
    return df.join(totals, keys).withColumn("share", F.try_divide(stat, "_total")).drop("_total")


def earned_and_given(df: DataFrame, keys: list[str], date: str, stat: str, days: int = 30, least: int = 3, leakage_safe: bool = False) -> DataFrame:
    """Adds ``ratio`` of a stat to its mean within ``days``, where at least ``least`` values make up the mean."""
    mean, count = interval_mean(df, keys, date, stat, days, leakage_safe)
    return df.withColumns({"baseline": mean, "baseline_n": count}).where(F.col("baseline_n") >= least).withColumn("ratio", ratio_to_baseline(F.col(stat), F.col("baseline")))


def target_and_mean(df: DataFrame, keys: list[str], order: list[str], stat: str, window: int) -> DataFrame:
    """Each event's stat with the mean of the ``window`` before it in the same keys; rows without either are left out."""
    mean = F.avg(stat).over(trailing(keys, order, window))
    return df.withColumn("target", F.col(stat)).withColumn("mean", mean).where("target is not null and mean is not null")


def mean_regression_error(df: DataFrame, keys: list[str], order: list[str], stat: str, sizes: list[int], classes: int = 10, limit: float = 3.0) -> DataFrame:
    """(size, n, error): for each window size, how far the class of the mean before an event is from that of the event.

    Both are standardised by the mean and population deviation of the events
    that have a mean, clamped, and put into classes; ``error`` is the mean
    distance over (classes - 1). Events without values before them are left
    out. All sizes are worked out in one pass over the events.
    """
    each = F.array(*[F.struct(F.lit(n).alias("size"), F.avg(stat).over(trailing(keys, order, n)).alias("mean")) for n in sizes])
    rows = df.select(F.col(stat).cast("double").alias("target"), each.alias("each")).where("target is not null").select("target", F.explode("each").alias("e")).select("target", "e.*").where("mean is not null")
    # one row for each size
    scale = rows.groupBy("size").agg(F.round(F.avg("target"), 6).alias("_m"), F.round(F.stddev_pop("target"), 6).alias("_s"))
    put = lambda c: digitize(F.coalesce(F.try_divide(F.col(c) - F.col("_m"), F.col("_s")), F.lit(0.0)), limit, classes)
    judged = rows.join(F.broadcast(scale), "size").withColumn("_off", F.abs(put("target") - put("mean")))
    return judged.groupBy("size").agg(F.count(F.lit(1)).alias("n"), (F.avg("_off") / (classes - 1)).alias("error"))


def running(df: DataFrame, keys: list[str], order: list[str], stats: list[str], size: int = 10) -> DataFrame:
    """Adds for each stat the season mean, the mean and variance of the last ``size``, and season less last (trend)."""
    w, s = trailing(keys, order, size), Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df
    for x in stats:
        out = out.withColumns({f"{x}_season": F.avg(x).over(s), f"{x}_last": F.avg(x).over(w), f"{x}_last_var": F.var_pop(x).over(w)})
        out = out.withColumn(f"{x}_trend", F.coalesce(F.col(f"{x}_season"), F.lit(0.0)) - F.coalesce(F.col(f"{x}_last"), F.lit(0.0)))
    return out


def feature_matrix(base: DataFrame, groups: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Feature groups side by side; a column is named by its group, and columns stand in the order of their names."""
    out = base.select(*keys)
    for name in sorted(groups):
        columns = sorted(c for c in groups[name].columns if c not in keys)
        out = out.join(groups[name].select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in columns]), keys, "left")
    return out.select(*keys, *sorted(c for c in out.columns if c not in keys))


def effect_deltas(players: DataFrame, missing: DataFrame, effects: DataFrame, keys: list[str], one: str, two: str, value: str) -> DataFrame:
    """Per player of ``players``: the mean of a two-player effect over the missing players of its side, less its single effect.

    ``effects`` has a row for each pair (one, two), and with a null ``two``
    for the player alone. Pairs without an effect add nothing; a player
    without any, or without a single effect, has 0.
    """
    # from the pairs that have an effect, not from all pairs of a side
    known = effects.where(F.col(two).isNotNull() & (F.col(one) != F.col(two))).join(players.select(one, *keys), one)
    paired = known.join(missing.withColumnRenamed(one, two).select(two, *keys), [two, *keys]).groupBy(one).agg(F.avg(value).alias("_pair"), F.count(F.lit(1)).alias("pairs"))
    single = effects.where(F.col(two).isNull()).select(one, F.col(value).alias("_single"))
    out = players.join(paired, one, "left").join(single, one, "left")
    delta = F.coalesce(F.col("_pair") - F.col("_single"), F.lit(0.0))
    return out.select(one, *keys, F.coalesce("pairs", F.lit(0)).alias("pairs"), delta.alias("delta"))


def mixed_projection(projections: DataFrame, keys: list[str], mean: str = "mean", variance: str = "var", least: float = 0.01) -> DataFrame:
    """Projections of one target from several models, mixed by inverse variance."""
    w = 1 / F.greatest(F.col(variance), F.lit(least))
    known = projections.where(F.col(mean).isNotNull() & F.col(variance).isNotNull()).withColumn("_w", w)
    sums = known.groupBy(*keys).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col(mean)).alias("wm"), F.sum(F.col("_w") * F.col("_w") * F.col(variance)).alias("wv"), F.count(F.lit(1)).alias("models"))
    return sums.select(*keys, (F.col("wm") / F.col("w")).alias("mean"), (F.col("wv") / F.col("w") / F.col("w")).alias("var"), "models")
