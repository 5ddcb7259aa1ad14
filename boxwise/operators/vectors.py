"""Stat vectors: trailing profile, season to date, splits, allowed stats, trends.

The stages follow each other without recursion: own profiles and z-scores of
outputs, then what a group allows to each position, then an entity's trend
against what its opponents allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions import stats
from boxwise.operators.windows import last_events, to_date, trailing, with_profile


def own_window(df: DataFrame, keys: list[str], order: list[str], stat: str, size: int) -> DataFrame:
    """Adds mean, var, expmean, expvar of the ``size`` events before each, and ``n``, how many there were."""
    return with_profile(df, stat, trailing(keys, order, size))


def season_to_date(df: DataFrame, keys: list[str], order: list[str], stat: str) -> DataFrame:
    """Adds bayes_mean and bayes_var of all events of the keys before each.

    ``order`` is a day and what orders events within it. Sums of days run over
    one row for each day, and sums within a day over that day's rows, so a
    group with very many events does not meet in one task.
    """
    day, *within = order
    x = F.col(stat).cast("double")
    sums = {"_rows": F.count(F.lit(1)), "_n": F.count(x), "_s": F.coalesce(F.sum(x), F.lit(0.0)), "_ss": F.coalesce(F.sum(x * x), F.lit(0.0))}
    days = df.groupBy(*keys, day).agg(*[v.alias(k) for k, v in sums.items()])
    before = to_date(keys, [day])
    days = days.select(*keys, day, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_before{k}") for k in sums])
    inside = to_date([*keys, day], within)
    out = df.join(days, [*keys, day]).withColumns({k: F.col(f"_before{k}") + F.coalesce(v.over(inside), F.lit(0)) for k, v in (
        ("_rows", F.count(F.lit(1))), ("_n", F.count(x)), ("_s", F.sum(x)), ("_ss", F.sum(x * x)),
    )})
    return out.withColumns({
        "bayes_mean": F.when(F.col("_n") > 0, F.try_divide("_s", "_rows")), "bayes_var": stats.bayesian_var_of_sums(F.col("_n"), F.col("_s"), F.col("_ss")),
    }).drop(*sums, *[f"_before{k}" for k in sums])


def output_trend(df: DataFrame, keys: list[str], order: list[str], stat: str, size: int) -> DataFrame:
    """Adds the z-score of each output against its own trailing profile."""
    own = own_window(df, keys, order, stat, size)
    return own.withColumn("z", stats.z_score(F.col(stat), F.col("mean"), F.col("var")))


def splits(df: DataFrame, keys: list[str], order: list[str], stat: str, by: str, values: list, size: int = 200) -> DataFrame:
    """Adds, for each value of ``by``, its mean less the overall mean over the last ``size`` events; 0 without any."""
    w = trailing(keys, order, size)
    total = F.avg(stat).over(w)
    return df.withColumns({
        f"split_{k}": F.coalesce(F.avg(F.when(F.col(by) == v, F.col(stat))).over(w), total) - total for k, v in enumerate(values)
    })


def allowed_by_position(outputs: DataFrame, spine: DataFrame, group: str, season: str, event: str, entity: str, position: str, stat: str, z: str, size: int = 20) -> DataFrame:
    """What a group allowed to each position in its last ``size`` events, by (group, target event, position).

    ``outputs`` has a row for each entity that played against the group:
    columns group, season, event, entity, position (one row for each), the
    stat and its z-score.
    """
    # an event's entities of a position come to one row of sums before it goes to the events after it
    kinds = {"x": F.col(stat).cast("double"), "t": F.col(z).cast("double")}
    sums = [f(v).alias(f"_{k}{name}") for k, v in kinds.items() for name, f in (("n", F.count), ("s", F.sum), ("ss", lambda v: F.sum(v * v)))]
    small = outputs.groupBy(group, season, event, position).agg(F.count(F.lit(1)).alias("_rows"), *sums)
    rows = last_events(spine, small, group, season, event, entity, size).groupBy(group, "target", position)
    total = rows.agg(*[F.sum(c).alias(c) for c in ("_rows", "_xn", "_xs", "_xss", "_tn", "_ts", "_tss")])
    var = lambda k: stats.bayesian_var_of_sums(*[F.col(f"_{k}{name}") for name in ("n", "s", "ss")])
    return total.select(
        group, "target", position, F.col("_rows").alias("n"), F.try_divide("_xs", "_rows").alias("mean"), var("x").alias("var"),
        F.try_divide("_ts", "_rows").alias("trend_mean"), var("t").alias("trend_var"),
    )


def entity_trend(outputs: DataFrame, allowed: DataFrame, on: list[str], entity: str, order: list[str], stat: str, size: int) -> DataFrame:
    """z-score of each output against what its opponent allowed, and its mean and variance over the entity's events before."""
    z = stats.z_score(F.col(stat), F.col("mean"), F.col("var"))
    scored = outputs.join(allowed, on, "left").withColumn("z_allowed", z)
    w = trailing([entity], order, size)
    return scored.withColumns({"trend": stats.bayesian_mean(F.col("z_allowed"), w), "trend_var": stats.bayesian_var(F.col("z_allowed"), w)})


def running_share(df: DataFrame, entity: str, group: str, event: str, stat: str) -> DataFrame:
    """Per entity: the mean of its share in its group's total of an event, over events with a total above 0."""
    total = F.sum(stat).over(Window.partitionBy(group, event))
    shared = df.withColumn("_share", F.when(total > 0, F.col(stat) / total))
    return shared.groupBy(entity).agg(F.avg("_share").alias("share"), F.count("_share").alias("events"))
