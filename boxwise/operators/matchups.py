"""Operators on a team's games against its opponents: running form, last matchups, splits, and what positions earn and give up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions import stats
from boxwise.operators.features import with_share
from boxwise.operators.windows import last_events, latest, trailing


def opponent(own: Column, home: Column, away: Column) -> Column:
    """The other side of a game; null for a side that is not in it."""
    return F.when(home == own, away).when(away == own, home)


def own_on_spine(df: DataFrame, spine: DataFrame, group: str, season: str, event: str, entity: str, stat: str, size: int) -> DataFrame:
    """Adds mean, var and ``n`` of an entity's rows among its group's last ``size`` events of the season.

    The window counts the group's events: one that the entity missed shrinks
    the sample. The frame is a range over the events' numbers, so no row is
    copied and no events are joined.
    """
    rows = df.join(spine.select(group, season, event, "seq"), [group, season, event])
    w = Window.partitionBy(entity, group, season).orderBy("seq").rangeBetween(-size, -1)
    x = F.col(stat)
    return rows.withColumns({"mean": stats.bootstrap_mean(x, w), "var": stats.bootstrap_var(x, w), "n": F.count(F.lit(1)).over(w)}).drop("seq")


def recent_within(x: str, keys: list[str], order: list[str], size: int, days: int) -> tuple[Column, Column]:
    """(mean, population variance) of a stat over the last ``size`` rows, of which only those within ``days`` count."""
    day = F.datediff(order[0], F.lit("1970-01-01"))
    held = F.collect_list(F.struct(day.alias("day"), F.col(x).cast("double").alias("x"))).over(trailing(keys, order, size))
    values = F.transform(F.filter(held, lambda r: (r["day"] >= day - days) & r["x"].isNotNull()), lambda r: r["x"])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    mean = F.try_divide(total(values), F.size(values))
    var = F.try_divide(total(F.transform(values, lambda v: (v - mean) * (v - mean))), F.size(values))
    return mean, var


def running_form(df: DataFrame, keys: list[str], season: str, against: str, order: list[str], names: list[str], size: int = 10, days: int = 60) -> DataFrame:
    """Adds for each stat: ``*_season`` (mean of the season before), ``*_last`` and ``*_last_var`` (last ``size`` within ``days``),
    ``*_matchup`` (its value in the last game against the same opponent), and season less last and less matchup.

    A difference of which a side is missing is missing.
    """
    before = Window.partitionBy(*keys, season).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    meetings = Window.partitionBy(*keys, against).orderBy(*order)
    out = df
    for x in names:
        mean, var = recent_within(x, [*keys, season], order, size, days)
        out = out.withColumns({f"{x}_season": F.avg(x).over(before), f"{x}_last": mean, f"{x}_last_var": var, f"{x}_matchup": F.lag(x).over(meetings)})
        out = out.withColumns({f"{x}_trend": F.col(f"{x}_season") - F.col(f"{x}_last"), f"{x}_matchup_trend": F.col(f"{x}_season") - F.col(f"{x}_matchup")})
    return out


def place_splits(df: DataFrame, keys: list[str], order: list[str], stat: str, home: str, against: str, size: int = 200) -> DataFrame:
    """Adds home, road and versus: the mean at home, away, and against this row's opponent, less that of all last ``size`` rows; 0 without any.

    The rows against this opponent are a frame by number within the rows of
    both, so they are those among the last ``size`` of all.
    """
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy("_n").rangeBetween(-size, -1)
    met = Window.partitionBy(*keys, against).orderBy("_n").rangeBetween(-size, -1)
    total = F.avg(stat).over(w)
    part = lambda c: F.coalesce(c, total) - total
    return numbered.withColumns({
        "home": part(F.avg(F.when(F.col(home), F.col(stat))).over(w)), "road": part(F.avg(F.when(~F.col(home), F.col(stat))).over(w)), "versus": part(F.avg(stat).over(met)),
    }).drop("_n")


def reflection_ratings(df: DataFrame, event: list[str]) -> DataFrame:
    """Team rows (T, ORtg, ORB_pct and the event's other team beside them) with DRB_pct, DRtg, NetRtg and T_net."""
    w = Window.partitionBy(*event)
    other = lambda c: F.sum(c).over(w) - F.col(c)
    return df.withColumns({f"opp_{c}": other(c) for c in ("T", "ORtg", "ORB_pct")}).withColumns({
        "DRB_pct": 100 - F.col("opp_ORB_pct"), "DRtg": F.col("opp_ORtg"), "NetRtg": F.col("ORtg") - F.col("opp_ORtg"), "T_net": F.col("T") - F.col("opp_T"),
    })


def shooting_ratios(points: Column, attempts: Column, free: Column, minutes: Column) -> tuple[Column, Column]:
    """Points and free throws for each attempt, of those who played; null without attempts."""
    played = minutes > 0
    return F.when(played, F.try_divide(points, attempts)), F.when(played, F.try_divide(free, attempts))


def position_shares(df: DataFrame, entity: str, position: str, amount: str) -> DataFrame:
    """(entity, position, weight): the share of an entity's amount at each position; none for an entity without any."""
    each = df.groupBy(entity, position).agg(F.sum(amount).alias("_amount")).where("_amount > 0")
    total = each.groupBy(entity).agg(F.sum("_amount").alias("_total"))
    return each.join(total, entity).select(entity, position, (F.col("_amount") / F.col("_total")).alias("weight"))


def weighted_by_position(df: DataFrame, shares: DataFrame, keys: list[str], entity: str, position: str, value: str) -> DataFrame:
    """Per key and position: the mean of a value over rows, each with the weight of its entity at that position."""
    w, x = F.col("weight"), F.col(value)
    rows = df.where(x.isNotNull()).select(*dict.fromkeys([*keys, entity, value])).join(shares, entity)
    return rows.groupBy(*keys, position).agg(F.try_divide(F.sum(w * x), F.sum(w)).alias("given"), F.sum(w).alias("weight"))


def blended(df: DataFrame, shares: DataFrame, given: DataFrame, keys: list[str], entity: str, position: str) -> DataFrame:
    """Rows (keys, entity, ...) with ``blend``: what their key gives each position, by the shares of their entity.

    Weights are those of the positions that are known, so they need not sum to 1.
    """
    known = given.select(*keys, position, "given").where("given is not null")
    pairs = df.select(*keys, entity).distinct().join(shares, entity).join(known, [*keys, position])
    mixed = pairs.groupBy(*keys, entity).agg(F.try_divide(F.sum(F.col("weight") * F.col("given")), F.sum("weight")).alias("blend"))
    return df.join(mixed, [*keys, entity], "left")


def recent_by_position(rows: DataFrame, shares: DataFrame, spine: DataFrame, group: str, season: str, event: str, entity: str, position: str, value: str, size: int = 10) -> DataFrame:
    """(group, season, event, position, given): what a group's rows were worth by position over its last ``size`` events before each event.

    Every row counts at each position of its entity with the entity's share.
    Events are summed first, one row for each position, so what goes on to the
    events after them does not grow with their rows.
    """
    w, x = F.col("weight"), F.col(value)
    each = rows.where(x.isNotNull()).select(group, season, event, entity, value).join(shares, entity).groupBy(group, season, event, position).agg(F.sum(w * x).alias("_wx"), F.sum(w).alias("_w"))
    before = last_events(spine, each, group, season, event, position, size)
    return before.groupBy(group, season, F.col("target").alias(event), position).agg(F.try_divide(F.sum("_wx"), F.sum("_w")).alias("given"))


def play_distribution(rows: DataFrame, shares: DataFrame, group: str, event: str, date: str, entity: str, position: str, stat: str, size: int = 10, days: int = 60) -> DataFrame:
    """(group, entity, position, value, share): each entity's stat an event, by its positions, over the group's latest events.

    These are the last ``size`` of the group's events within ``days`` before
    its last one, that included; an event that an entity missed counts as 0.
    ``share`` is the value over the group's sum.
    """
    events = rows.select(group, event, date).distinct()
    last = latest(events, [group], [date, event], size).drop("place")
    newest = events.groupBy(group).agg(F.max(date).alias("_newest"))
    held = last.join(newest, group).where(F.datediff("_newest", date) < days).select(group, event)
    n = held.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sums = rows.join(held, [group, event], "left_semi").groupBy(group, entity).agg(F.coalesce(F.sum(stat), F.lit(0.0)).alias("_sum"))
    valued = sums.join(n, group).join(shares, entity).select(group, entity, position, (F.col("weight") * F.col("_sum") / F.col("_n")).alias("value"))
    return with_share(valued, [group], "value")


def mean_across(vectors: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One vector for each key: the mean of each stat over the key's vectors, nulls skipped."""
    return vectors.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def position_list(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The distinct positions of a key, sorted, as one text."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(position)), "/").alias("positions"))


def meta(df: DataFrame, rest: DataFrame, cities: DataFrame, team: str, on: list[str]) -> DataFrame:
    """What is shown beside a vector: rest, place, whether it is a home game; home is where ``home`` is the team."""
    joined = df.join(rest, on, "left").join(cities.withColumnsRenamed({"team": "home", "city": "location"}), "home", "left")
    return joined.withColumn("is_home", F.col("home") == F.col(team))


def by_alias(rows: DataFrame, teams: DataFrame, key: str, aliases: str, team: str) -> DataFrame:
    """Rows with the team that has their key among its aliases: the dimension is exploded, so the join is one of equality."""
    known = teams.select(team, F.explode(aliases).alias(key)).distinct()
    return rows.join(known, key)


def translated(code: Column, names: dict[str, str]) -> Column:
    """A code by a short fixed list of names; one that is not listed stays."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def contest_players(players: DataFrame, games: DataFrame, game: str, pid: str, rosters: tuple[str, str]) -> DataFrame:
    """Contest players whose game is known and who are on one of its two rosters, with the ``side`` they are on."""
    home, away = rosters
    joined = players.join(games, game)
    side = F.when(F.array_contains(home, F.col(pid)), home).when(F.array_contains(away, F.col(pid)), away)
    return joined.withColumn("side", side).where("side is not null").drop(home, away)


def stub_rows(games: DataFrame, roster: DataFrame, actual: DataFrame, game: str, team: str, slices: int = 32, parts: int = 256) -> DataFrame:
    """Rows of players of games that are yet to come: their roster's, with null stats, where the game has no actual rows.

    A team's games are dealt into ``slices`` by their hash, each of which meets
    the whole roster, and these to ``parts`` partitions; both decide the work
    and not the result.
    """
    upcoming = games.join(actual.select(game).distinct(), game, "left_anti")
    dealt = upcoming.withColumn("_slice", F.pmod(F.xxhash64(game), F.lit(slices)).cast("int"))
    each = roster.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # by number, so that adaptive execution does not join small inputs of a large result to a few tasks
    stubs = dealt.repartition(parts, team, "_slice").join(each.repartition(parts, team, "_slice"), [team, "_slice"])
    return actual.unionByName(stubs.select(*[c for c in stubs.columns if c in actual.columns]), allowMissingColumns=True)


def numeric_columns(df: DataFrame) -> DataFrame:
    """The columns whose type is a number."""
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return df.select(*[name for name, kind in df.dtypes if kind in kinds or kind.startswith("decimal")])


def playing_days(first: str, last: str, spark, rest_months: tuple[int, ...] = (7, 8, 9)) -> DataFrame:
    """The days from ``first`` to ``last`` but for the months without games."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.where(~F.month("day").isin(*rest_months))
