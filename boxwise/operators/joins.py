"""Joins of event data: frames, as-of, nearest, interval, reflection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions.scalars import cityblock


def frame_merge(frames: Sequence[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of frames on their keys; of columns that clash, those of the first frame stay."""

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        on = [k for k in keys if k in left.columns and k in right.columns]
        return left.join(right.select(*on, *[c for c in right.columns if c not in left.columns]), on, how)

    return reduce(joined, frames)


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: str, values: list[str]) -> DataFrame:
    """Each left row with the right row of its key that is latest at or before it, by one sort and no range join.

    Both sides are put in one order, right rows first at equal times, and the
    last right row is carried on. Left rows without one get nulls.
    """
    held = F.struct(F.col(right_time).alias("_at"), *values)
    a = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_left"))
    b = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), held.alias("_right"))
    every = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = every.withColumn("_right", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select("_left.*", *[F.col(f"_right.{v}").alias(v) for v in values])


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: str) -> DataFrame:
    """Each left row's nearest right row of its key: the least distance in days, then the least ``tie``.

    Both sides are put in one order of time; the last right row is carried on
    and the next one back, and the nearer of the two is taken, so no pairs are
    made. Left rows that repeat all stay; those whose key has no right row, or
    whose time is null, are left out.
    """
    rest = [c for c in right.columns if c not in left.columns]
    kind = right.schema[tie].dataType
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    a = left.select(*keys, day(left_time).alias("_day"), F.lit(1).alias("_left"), F.lit(None).cast(kind).alias("_tie"), F.struct(*left.columns).alias("_row"))
    b = right.select(*keys, day(right_time).alias("_day"), F.lit(0).alias("_left"), F.col(tie).alias("_tie"), F.struct(day(right_time).alias("at"), F.col(tie).alias("tie"), F.struct(*rest).alias("row")).alias("_other"))
    every = a.unionByName(b, allowMissingColumns=True).where("_day is not null")
    # at one time right rows stand before left ones going on, and after them going back; the least tie is met last, or first
    on = Window.partitionBy(*keys).orderBy("_day", "_left", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy("_day", F.desc("_left"), "_tie").rowsBetween(0, Window.unboundedFollowing)
    both = every.withColumns({"_before": F.last("_other", ignorenulls=True).over(on), "_after": F.first("_other", ignorenulls=True).over(back)}).where("_left = 1")
    far = lambda c: F.struct(F.abs(F.col(f"{c}.at") - F.col("_day")).alias("distance"), F.col(f"{c}.tie").alias("tie"), F.col(f"{c}.row").alias("row"))
    found = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), far(c)) for c in ("_before", "_after")]))
    nearest = F.aggregate(found, F.try_element_at(found, F.lit(1)), lambda x, y: F.when((y["distance"] < x["distance"]) | (y["distance"] == x["distance"]) & (y["tie"] < x["tie"]), y).otherwise(x))
    chosen = both.withColumn("_best", nearest).where("_best is not null")
    return chosen.select("_row.*", *[F.col(f"_best.row.{c}").alias(c) for c in rest], F.col("_best.distance").alias("distance"))


def fuzzy_dates(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, days: int = 120, parts: int = 256) -> DataFrame:
    """Pairs of rows of a key whose dates are at most ``days`` apart, share month and day, or are each other with month and day swapped.

    Dates are matched first, each pair of dates once whatever its reasons; then
    a left row meets the right rows of its key on each date that matches its
    own, so no pair is made twice or for nothing. Rows meet by key and date in
    ``parts`` partitions, which decide the work and not the result. Repeated
    rows give repeated pairs; a row without a date gives none.
    """
    x, y = left.select(F.col(left_date).alias("_x")).distinct(), right.select(F.col(right_date).alias("_y")).distinct()
    swapped = F.when(F.dayofmonth("_y") <= 12, F.make_date(F.year("_y"), F.dayofmonth("_y"), F.month("_y")))
    bucket = F.floor(F.datediff(F.col("_y"), F.lit("1970-01-01")) / (days + 1))
    own = F.floor(F.datediff(F.col("_x"), F.lit("1970-01-01")) / (days + 1))
    # near dates meet in one of two neighbouring buckets, the others on a key of their own
    text = lambda kind, v: F.concat(F.lit(kind), v.cast("string"))
    wanted = F.explode(F.array(text("b", bucket - 1), text("b", bucket), text("b", bucket + 1), text("s", swapped), text("d", F.date_format("_y", "MM-dd"))))
    have = F.explode(F.array(text("b", own), text("s", F.col("_x")), text("d", F.date_format("_x", "MM-dd"))))
    near = F.abs(F.datediff("_x", "_y")) <= days
    dates = x.select("_x", have.alias("_k")).join(y.select("_y", wanted.alias("_k")), "_k").where(near | (F.substring("_k", 1, 1) != "b")).select("_x", "_y").distinct()
    asked = left.withColumn("_x", F.col(left_date)).join(dates, "_x").drop("_x")
    # by number, so that adaptive execution does not join small inputs of a large result to a few tasks
    return asked.repartition(parts, *keys, "_y").join(right.withColumn("_y", F.col(right_date)).repartition(parts, *keys, "_y"), [*keys, "_y"]).drop("_y")


def interval_mean(df: DataFrame, keys: list[str], date: str, value: str, days: int, leakage_safe: bool = False) -> tuple[Column, Column]:
    """(mean, count) of a value within ``days`` of the row's date, or before it only if ``leakage_safe``."""
    day = F.datediff(date, F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1 if leakage_safe else days)
    return F.avg(value).over(w), F.count(value).over(w)


def reflection(df: DataFrame, event: list[str], side: str, stats: list[str], prefix: str = "opp_") -> DataFrame:
    """Each side's row with the sums of the event's other sides, without a self-join."""
    w = Window.partitionBy(*event)
    return df.select("*", *[(F.sum(s).over(w) - F.coalesce(F.col(s), F.lit(0))).alias(prefix + s) for s in stats])


def share_of_total(part: Column, keys: list[str]) -> Column:
    """A part over the sum of its keys' parts; null where that is 0."""
    return F.try_divide(part, F.sum(part).over(Window.partitionBy(*keys)))


def cityblock_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_vec: str, right_vec: str, left_id: str, right_id: str, k: int = 1, finest: float = 1.0, levels: int = 16, direct: int = 4096) -> DataFrame:
    """The k right rows of a key whose vectors are nearest by sum of absolute differences, ties by id; exact, with at most ``direct`` comparisons a vector or by cells.

    A row is not its own neighbour: rows whose ids are equal are left out, and
    ids are those of one right row of a key. Equal vectors of a key are
    searched once, and met once with the k + 1 rows of least id. Vectors of
    keys with up to ``direct`` such right rows are compared with each of these,
    in blocks of ``BLOCK`` vectors. For the others space is cut into cells of
    ``levels`` widths, each twice the one before from ``finest`` on, and one of
    everything. A few right rows of each cell bound how far the k nearest can
    be; then only the cells within that radius are met, of the least width that
    is no narrower than it. ``direct`` and the widths decide the work, not the
    result. Rows without an id or a vector are left out.
    """
    known = left.where(F.col(left_vec).isNotNull() & F.col(left_id).isNotNull()).withColumn("_here", F.col(left_vec))
    rest = [c for c in right.columns if c not in keys]
    points = right.where(F.col(right_vec).isNotNull() & F.col(right_id).isNotNull())
    points = points.select(*keys, F.col(right_vec).alias("_there"), F.col(right_id).alias("_id"), F.struct(*rest).alias("_row"))
    # of equal right vectors, at most k rows and the row itself can be among the nearest
    there = _first(points, [*keys, "_there"], k + 1, "_id").drop("_n")
    asked = known.select(*keys, "_here").distinct()
    large = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > direct).select(*keys)
    far, wide = asked.join(large, keys, "left_semi"), there.join(large, keys, "left_semi")
    by_cells = _first(_within(_radius(far, wide, keys, k + 1, finest, levels), wide, keys, finest, levels), [*keys, "_here"], k + 1, "distance", "_id")
    by_pairs = _by_blocks(asked.join(large, keys, "left_anti"), there.join(large, keys, "left_anti"), keys, k + 1)
    near = by_cells.select(*keys, "_here", "_id", "_row", "distance").unionByName(by_pairs)
    # the k + 1 nearest of a vector as one array, of which each of its rows takes the first k others
    lists = near.groupBy(*keys, "_here").agg(F.array_sort(F.collect_list(F.struct("distance", "_id", "_row")), _by("distance", "_id")).alias("_near"))
    others = F.slice(F.filter("_near", lambda x: x["_id"] != F.col(left_id)), 1, k)
    met = known.join(lists, [*keys, "_here"]).select(*left.columns, F.posexplode(others).alias("_at", "_one"))
    return met.select(*left.columns, *[F.col(f"_one._row.{c}").alias(c) for c in rest], F.col("_one.distance").alias("distance"), (F.col("_at") + 1).alias("place"))


#: Left vectors that meet the right rows of their key at once.
BLOCK = 512


def _by_blocks(asked: DataFrame, points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest points of each vector of ``asked``, by all pairs of a key; distances add up from the first place on."""
    block = F.pmod(F.xxhash64("_here"), F.greatest(F.lit(1), F.ceil(F.col("_asked") / BLOCK)))
    sizes = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_asked"))
    blocks = asked.join(sizes, keys).withColumn("_block", block).groupBy(*keys, "_block").agg(F.collect_list("_here").alias("_heres"))
    # ids as their places in order: numbers whatever their type
    held = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_id", "_there", "_row")), _by("_id")).alias("_held"))
    met = blocks.join(held, keys)

    @F.pandas_udf("array<struct<at:array<int>,distance:array<double>>>")
    def nearest(heres: pd.Series, theres: pd.Series) -> pd.Series:
        return pd.Series([_nearest(_matrix(a), _matrix(b), k) for a, b in zip(heres, theres, strict=True)])

    found = met.withColumn("_found", nearest("_heres", F.transform("_held", lambda x: x["_there"])))
    one = found.select(*keys, "_held", F.explode(F.arrays_zip("_heres", "_found")).alias("_one"))
    each = one.select(*keys, F.col("_one._heres").alias("_here"), F.explode(F.arrays_zip(F.transform("_one._found.at", lambda i: F.get("_held", i)), "_one._found.distance")).alias("_p"))
    return each.select(*keys, "_here", F.col("_p.0._id").alias("_id"), F.col("_p.0._row").alias("_row"), F.col("_p.distance").alias("distance"))


def _by(*fields: str):
    """The order of structs by some of their fields."""

    def compared(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for f in reversed(fields):
            out = F.when(x[f] < y[f], -1).when(x[f] > y[f], 1).otherwise(out)
        return out

    return compared


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors])


def _nearest(here: np.ndarray, there: np.ndarray, k: int) -> list[dict]:
    """Places and distances of the k nearest of ``there``, ties by place."""
    distance = np.zeros((len(here), len(there)))
    for j in range(here.shape[1]):
        distance += np.abs(here[:, j, None] - there[None, :, j])
    n, out = min(k, len(there)), []
    most = np.partition(distance, n - 1, axis=1)[:, n - 1]
    for d, bound in zip(distance, most, strict=True):
        at = np.flatnonzero(~(d > bound))  # no number comes last
        at = at[np.argsort(d[at], kind="stable")][:n]
        out.append({"at": at.astype(np.int32), "distance": d[at]})
    return out


def _first(df: DataFrame, keys: list[str], n: int, *order: str, place: str = "_n") -> DataFrame:
    """The first ``n`` rows of each key in an order, with their ``place``."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def _radius(asked: DataFrame, points: DataFrame, keys: list[str], k: int, finest: float, levels: int) -> DataFrame:
    """The distinct vectors with ``_radius``, no less than the distance of the k-th nearest point; null where a key has fewer."""
    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    width = finest * F.pow(F.lit(2.0), F.col("_level"))
    # the last level is one cell for all
    cell = lambda v: F.when(F.col("_level") < levels, F.transform(v, lambda x: F.floor(x / width))).otherwise(F.array().cast("array<bigint>"))
    here = asked.withColumn("_level", every).withColumn("_cell", cell(F.col("_here")))
    there = points.select(*keys, "_there", "_id").withColumn("_level", every).withColumn("_cell", cell(F.col("_there")))
    few = F.row_number().over(Window.partitionBy(*keys, "_level", "_cell").orderBy(F.xxhash64("_id"), "_id"))
    held = there.withColumn("_n", few).where(F.col("_n") <= 4 * k).groupBy(*keys, "_level", "_cell").agg(F.collect_list("_there").alias("_held"))
    far = F.array_sort(F.transform("_held", lambda v: cityblock(F.col("_here"), v)))
    met = here.join(held.where(F.size("_held") >= k), [*keys, "_level", "_cell"], "left").withColumn("_far", F.try_element_at(far, F.lit(k)))
    return met.groupBy(*keys, "_here").agg(F.min("_far").alias("_radius"))


def _within(asked: DataFrame, points: DataFrame, keys: list[str], finest: float, levels: int) -> DataFrame:
    """Rows of ``asked`` with the points within their radius, met on cells of three signed sums, none of which differs by more than the distance."""
    signed = lambda v, run: F.aggregate(F.transform(v, lambda x, i: F.when(F.floor(i / run) % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda a, x: a + x)
    runs = (1 << 30, 1, 2)
    sums = lambda df, v: df.withColumns({f"_s{j}": signed(F.col(v), run) for j, run in enumerate(runs)})
    width = finest * F.pow(F.lit(2.0), F.col("_level"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_radius") / finest, F.lit(1.0))))).cast("int")
    here = sums(asked, "_here").withColumn("_level", F.when(F.col("_radius").isNull() | (level >= levels), levels).otherwise(level))
    there = sums(points, "_there").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    for j in range(len(runs)):
        s = F.col(f"_s{j}")
        slack = F.col("_radius") + 1e-9 * (1 + F.col("_radius") + F.abs(s))
        cells = F.sequence(F.floor((s - slack) / width), F.floor((s + slack) / width))
        here = here.withColumn(f"_c{j}", F.explode(F.when(F.col("_level") < levels, cells).otherwise(F.array(F.lit(0).cast("bigint")))))
        there = there.withColumn(f"_c{j}", F.when(F.col("_level") < levels, F.floor(s / width)).otherwise(F.lit(0).cast("bigint")))
        there = there.withColumnRenamed(f"_s{j}", f"_t{j}")
    on = [*keys, "_level", *[f"_c{j}" for j in range(len(runs))]]
    # sums are compared first, as that is the cheaper test
    close = reduce(lambda a, b: a & b, [F.abs(F.col(f"_s{j}") - F.col(f"_t{j}")) <= F.col("_radius") + 1e-9 * (1 + F.col("_radius") + F.abs(F.col(f"_s{j}"))) for j in range(len(runs))])
    pairs = here.join(there, on).where(F.col("_radius").isNull() | close).withColumn("distance", cityblock(F.col("_here"), F.col("_there")))
    return pairs.where(F.col("_radius").isNull() | (F.col("distance") <= F.col("_radius"))).select(*keys, "_here", "_id", "_row", "distance")
