"""Selection under a budget: combinations, value for cost, and the optimal roster."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_per_cost(players: DataFrame, points: str, cost: str, keys: list[str], tie: str) -> DataFrame:
    """Players of each of ``keys`` ranked by points for cost."""
    value = F.try_divide(F.col(points), F.col(cost))
    ranked = players.withColumn("value", value)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("value"), tie)))


def _combine(players: DataFrame, count: int, points: str, cost: str, pid: str) -> DataFrame:
    """All sets of ``count`` players as (pids, points, cost)."""
    one = players.select(F.array(pid).alias("pids"), F.col(points).alias("points"), F.col(cost).alias("cost"))
    single = players.select(F.col(pid).alias("_pid"), F.col(points).alias("_points"), F.col(cost).alias("_cost"))
    sets = one
    for _ in range(count - 1):
        more = sets.join(single, F.col("_pid") > F.element_at("pids", -1))
        sets = more.select(F.array_append("pids", F.col("_pid")).alias("pids"), (F.col("points") + F.col("_points")).alias("points"), (F.col("cost") + F.col("_cost")).alias("cost"))
    return sets


def roster_combinations(players: DataFrame, slots: Mapping[str, int], low: float, high: float, position: str = "position", points: str = "points", cost: str = "cost", pid: str = "pid") -> DataFrame:
    """Rosters with the given number of players for each position whose cost is in [low, high], for small pools.

    The pools are what a caller has cut to the few best of a position: every
    combination is wanted here, and partial rosters over the budget end early.
    """
    pools = [_combine(players.where(F.col(position) == p), n, points, cost, pid) for p, n in slots.items()]

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])
        joined = a.join(b, F.col("cost") + F.col("_cost") <= high)
        return joined.select(F.concat("pids", "_pids").alias("pids"), (F.col("points") + F.col("_points")).alias("points"), (F.col("cost") + F.col("_cost")).alias("cost"))

    return reduce(both, pools).where(F.col("cost") >= low)


def optimal_rosters(players: DataFrame, slots: Mapping[str, int], budget: int, keep: int = 5, position: str = "position", points: str = "points", cost: str = "cost", pid: str = "pid") -> DataFrame:
    """The ``keep`` best rosters within a budget of whole cost units, by dynamic programming over slots.

    Of the players of one position and cost only the best ``count + keep - 1``
    (points, then ids) can be in one of the best rosters: a roster with a
    lesser one has ``keep`` better rosters of the same cost. What remains of a
    pool is bounded by the costs, whatever its size. After each slot only the
    best ``keep`` partial rosters stay of each cost and last player. A state
    meets players by the costs that it can still pay, an equality join.
    Players of a position are taken in the order of their ids, so no set
    comes twice.
    """
    states = optimal_by_level(players, slots, budget, keep, position, points, cost, pid).drop("place")
    return states.orderBy(F.desc("points"), "cost", "pids").limit(keep)


def optimal_by_level(players: DataFrame, slots: Mapping[str, int], budget: int, keep: int = 5, position: str = "position", points: str = "points", cost: str = "cost", pid: str = "pid") -> DataFrame:
    """The ``keep`` best rosters (pids, points, cost, place) of each cost up to the budget."""
    states = players.sparkSession.range(1).select(F.array().cast("array<bigint>").alias("pids"), F.lit(0.0).alias("points"), F.lit(0).cast("bigint").alias("cost"))
    known = players.select(F.col(position).alias("_position"), F.col(pid).cast("bigint").alias("_pid"), F.col(points).cast("double").alias("_points"), F.col(cost).cast("bigint").alias("_cost"))
    place = F.row_number().over(Window.partitionBy("_position", "_cost").orderBy(F.desc("_points"), "_pid"))
    wanted = F.create_map(*[F.lit(x) for name, count in slots.items() for x in (name, count + keep - 1)])
    best = known.where((F.col("_cost") >= 0) & (F.col("_cost") <= budget)).withColumn("_place", place).where(F.col("_place") <= F.try_element_at(wanted, F.col("_position"))).drop("_place")
    for name, count in slots.items():
        pool = best.where(F.col("_position") == name).drop("_position")
        states = states.withColumn("last", F.lit(-1).cast("bigint"))
        for _ in range(count):
            payable = states.withColumn("_cost", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(budget).cast("bigint") - F.col("cost"))))
            grown = payable.join(pool, "_cost").where(F.col("_pid") > F.col("last"))
            grown = grown.select(F.array_append("pids", F.col("_pid")).alias("pids"), (F.col("points") + F.col("_points")).alias("points"), (F.col("cost") + F.col("_cost")).alias("cost"), F.col("_pid").alias("last"))
            place = F.row_number().over(Window.partitionBy("cost", "last").orderBy(F.desc("points"), "pids"))
            states = grown.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
        place = F.row_number().over(Window.partitionBy("cost").orderBy(F.desc("points"), "pids"))
        states = states.drop("place").withColumn("place", place).where(F.col("place") <= keep).drop("last")
    return states


def best_by_points(players: DataFrame, slots: Mapping[str, int], most: int, keep: int = 5, position: str = "position", points: str = "points", cost: str = "cost", pid: str = "pid") -> DataFrame:
    """For each whole number of points up to ``most``, the ``keep`` cheapest rosters that reach just that many.

    The same search with the two amounts in each other's place: levels are
    points, and of one level the least cost (then ids) is best.
    """
    turned = players.select(F.col(position).alias("position"), F.col(pid).alias("pid"), F.round(F.col(points)).cast("bigint").alias("cost"), (-F.col(cost)).cast("double").alias("points"))
    best = optimal_by_level(turned, slots, most, keep)
    return best.select("pids", F.col("cost").alias("points"), (-F.col("points")).alias("cost"), "place")


def substitutions(
    rosters: DataFrame, players: DataFrame, slots: Mapping[str, int], value: str, margin: float, not_less: str | None = None, once: bool = False, position: str = "position", pid: str = "pid"
) -> DataFrame:
    """(roster's columns, slot, pid, other): players outside a roster who can take one of its slots, with exactly ``margin`` more of ``value``.

    ``pids`` of a roster has one entry for each of ``slots`` in their order,
    null where a slot is empty; an empty slot counts as a value of 0. ``other``
    has the slot's position, and no less of ``not_less`` (points, where the
    value is a cost) than the one who holds it; nobody is compared with an
    empty slot. With ``once`` a player is offered for the first of a roster's
    empty slots alone. Both sides meet by position and value, so the join is
    one of equality. Slots of players that are unknown get no substitutes.
    """
    spots = F.array(*[F.lit(name) for name, count in slots.items() for _ in range(count)])
    open_ = rosters.select(*rosters.columns, F.posexplode("pids").alias("slot", "pid")).withColumn("_position", F.get(spots, F.col("slot")))
    least = F.lit(None).cast("double") if not_less is None else F.col(not_less).cast("double")
    held = players.select(F.col(pid).alias("pid"), F.col(value).cast("double").alias("_held"), least.alias("_least"))
    others = players.select(F.col(pid).alias("other"), F.col(position).alias("_position"), F.col(value).cast("double").alias("_value"), least.alias("_has"))
    filled = open_.where("pid is not null").join(held, "pid")
    empty = open_.where("pid is null").withColumns({"_held": F.lit(0.0), "_least": F.lit(None).cast("double")})
    asked = filled.unionByName(empty).withColumn("_value", F.col("_held") + F.lit(float(margin)))
    pairs = asked.join(others, ["_position", "_value"]).where(~F.array_contains(F.array_compact("pids"), F.col("other")))
    if not_less is not None:
        pairs = pairs.where("_least is null or _has >= _least")
    if once:
        first = Window.partitionBy(*rosters.columns, "other", F.col("pid").isNull()).orderBy("slot")
        pairs = pairs.withColumn("_place", F.row_number().over(first)).where("pid is not null or _place = 1")
    return pairs.select(*rosters.columns, "slot", "pid", "other")


def valid_roster(teams: Column, slots: int, least_teams: int = 3, most_of_team: int = 4) -> Column:
    """A full roster has players of at least ``least_teams`` teams; no team has more than ``most_of_team``."""
    distinct = F.array_distinct(teams)
    counts = F.transform(distinct, lambda t: F.size(F.filter(teams, lambda x: x == t)))
    return (F.size(teams) < slots) & (F.array_max(counts) <= most_of_team) | (F.size(distinct) >= least_teams) & (F.array_max(counts) <= most_of_team)


def roster_key(names: Column) -> Column:
    """Rosters of the same names in any order and case have one key."""
    return F.array_join(F.array_sort(F.transform(names, F.lower)), "|")
