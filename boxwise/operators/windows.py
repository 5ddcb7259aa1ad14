"""As-of windows over ordered events of an entity; the target event is never in its own window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from boxwise.functions import stats


def trailing(keys: list[str], order: list[str], size: int) -> WindowSpec:
    """The ``size`` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-size, -1)


def to_date(keys: list[str], order: list[str]) -> WindowSpec:
    """All rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def spine(events: DataFrame, group: str, season: str, event: str, date: str) -> DataFrame:
    """Each group's events of a season with their number ``seq``, from 1, in order of date and event."""
    once = events.select(group, season, event, date).distinct()
    return once.withColumn("seq", F.row_number().over(Window.partitionBy(group, season).orderBy(date, event)))


def last_events(spine_: DataFrame, rows: DataFrame, group: str, season: str, event: str, entity: str, size: int) -> DataFrame:
    """For each event of a group, the rows of its last ``size`` events before it, by ``target``.

    The window counts the group's events: one that an entity missed shrinks
    its sample. Each row goes to the ``size`` events after it and meets them
    by an equality join on (group, season, seq), so no range join is needed.
    """
    seqs = spine_.select(group, season, event, "seq")
    carried = rows.join(seqs, [group, season, event]).withColumnRenamed(event, "_of")
    carried = carried.withColumn("seq", F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + size)))
    return carried.join(seqs.withColumnRenamed(event, "target"), [group, season, "seq"]).withColumnRenamed("_of", event)


def with_profile(df: DataFrame, stat: str, window: WindowSpec) -> DataFrame:
    """Adds mean, var, expmean and expvar of a stat over a bounded window, and ``n``, how many rows it had."""
    x = F.col(stat)
    values, rows = F.collect_list(x).over(window), F.count(F.lit(1)).over(window)
    out = df.withColumns({
        "mean": stats.bootstrap_mean(x, window), "var": stats.bootstrap_var(x, window), "n": rows, "_sums": stats.exponential_sums(values, rows),
    })
    return out.withColumns({"expmean": stats.mean_of_sums(F.col("_sums")), "expvar": stats.var_of_sums(F.col("_sums"))}).drop("_sums")


def days_rest(df: DataFrame, keys: list[str], date: str, cap: int = 10) -> DataFrame:
    """Days since the key's previous date, at most ``cap``, which is also that of a first date."""
    once = df.select(*keys, date).distinct()
    gap = F.datediff(date, F.lag(date).over(Window.partitionBy(*keys).orderBy(date)))
    return once.withColumn("rest", F.least(F.lit(cap), F.coalesce(gap, F.lit(cap))))


def back_to_back(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """+1 or -1 for each pattern of rest: a game the day before, and 2 of 3, 3 of 4, 4 of 5 days with this one."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(date, F.lit("1970-01-01")))
    days = lambda n: F.count(F.lit(1)).over(w.rangeBetween(-n, 0))
    flag = lambda c: F.when(c, 1).otherwise(-1)
    once = df.select(*keys, date).distinct()
    return once.select(
        *keys, date, flag(days(1) >= 2).alias("b2b"), flag(days(2) >= 2).alias("g2of3"), flag(days(3) >= 3).alias("g3of4"), flag(days(4) >= 4).alias("g4of5")
    )


def running_mean(x: str, keys: list[str], order: list[str], size: int = 15) -> Column:
    """Mean of the ``size`` values before; the first row has its own value."""
    return F.coalesce(F.avg(x).over(trailing(keys, order, size)), F.col(x))


def trend_ratio(x: str, keys: list[str], order: list[str], size: int = 15) -> Column:
    """The value over the mean of the ``size`` before it, filled up from it onward where history is short; 0/0 is 1, x/0 is 2."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.collect_list(x).over(w.rowsBetween(-size, -1))
    onward = F.collect_list(x).over(w.rowsBetween(0, size - 1))
    values = F.slice(F.concat(before, onward), F.lit(1), F.lit(size))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return F.when(mean != 0, F.try_divide(F.col(x), mean)).when(F.col(x) == 0, 1.0).otherwise(2.0)


def latest(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """The last ``size`` rows of each key, numbered ``place`` from the newest."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("place", place).where(F.col("place") <= size)


def round_robin(df: DataFrame, date: str, key: str, order: list[str]) -> DataFrame:
    """Rows numbered within (date, key) as ``turn``: sorted by date, turn and key they take turns."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(date, key).orderBy(*order)))
