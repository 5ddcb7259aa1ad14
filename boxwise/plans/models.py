"""Queries of features, selection, preprocessing and models, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwise.functions import scalars, stats
from boxwise.operators import features, joins, ml, neural, possessions, processes, roster, windows
from boxwise.plans.base import GAMES, games, half_sql, half_up, r4
from boxwise.plans.profiles import ORDER
from boxwise.sources.tables import dealt, table


def interval_baseline(spark, sf_dir):
    out = features.earned_and_given(games(spark, sf_dir), ["entity"], "day", "qty")
    return out.select("game", "entity", "baseline_n", r4("baseline"), r4("ratio"))


SQL_INTERVAL = f"""WITH {GAMES}, b AS (SELECT *, avg(qty) OVER w AS baseline, count(qty) OVER w AS baseline_n FROM games
  WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 30 DAY FOLLOWING))
SELECT game, entity, baseline_n, round(baseline, 4) AS baseline, round(CASE WHEN baseline > 0 THEN qty / baseline ELSE 1 END, 4) AS ratio FROM b WHERE baseline_n >= 3"""


def distribution_norm(spark, sf_dir):
    per = games(spark, sf_dir).groupBy("grp", "entity").agg(F.sum("qty").alias("qty"))
    return features.with_share(per, ["grp"], "qty").select("grp", "entity", F.round("share", 6).alias("share"))


SQL_NORM = f"WITH {GAMES}, p AS (SELECT grp, entity, sum(qty) AS qty FROM games GROUP BY ALL) SELECT grp, entity, round(qty / nullif(sum(qty) OVER (PARTITION BY grp), 0), 6) AS share FROM p"


def _profiles(spark, sf_dir):
    """Quantity of each customer by priority, as whole numbers, with nation and segment."""
    g = games(spark, sf_dir).groupBy("grp", "entity", "seg")
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    sums = g.agg(*[F.coalesce(F.sum(F.when(F.col("prio") == k, F.col("qty"))), F.lit(0.0)).alias(f"p{i}") for i, k in enumerate(kinds)])
    return sums.select("grp", "entity", "seg", F.array(*[f"p{i}" for i in range(5)]).alias("vec"))


PROFILES = "pr AS (SELECT grp, entity, seg, [" + ", ".join(
    f"coalesce(sum(CASE WHEN prio = '{k}' THEN qty END), 0)" for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
) + "] AS vec FROM games GROUP BY grp, entity, seg)"
L1 = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: abs(x[1] - x[2])))"


def cityblock_rank(spark, sf_dir):
    """The five customers of the same nation and segment with the nearest profile, the nearest starter (urgent buyer) first if the base is one."""
    p = _profiles(spark, sf_dir)
    starter = F.element_at("vec", 1) > F.element_at("vec", 5)
    pool = lambda flag: F.explode(F.when(F.col(flag), F.array(F.lit("every"), F.lit("starters"))).otherwise(F.array(F.lit("every"))))
    base = p.select("grp", "seg", F.col("entity").alias("base"), F.col("vec").alias("base_vec"), starter.alias("starts")).withColumn("pool", pool("starts"))
    others = p.withColumn("starter", starter).withColumn("pool", pool("starter"))
    near = joins.cityblock_nearest(base, others, ["grp", "seg", "pool"], "base_vec", "vec", "base", "entity", 5, finest=16, levels=8)
    # five places go to the five nearest, and the first to the nearest starter, who may be none of them
    pairs = near.where("pool = 'every' or place = 1").select("base", "entity", "distance", "starts", "starter").distinct()
    ranked = features.matchup_rank(pairs, ["base"], "distance", "starter", "starts", "entity")
    return ranked.where("rank <= 5").select("base", "entity", "distance", F.col("rank").cast("bigint").alias("rank"))


SQL_CITY = f"""WITH {GAMES}, {PROFILES}, d AS (
  SELECT a.entity AS base, b.entity, {L1} AS distance, a.vec[1] > a.vec[5] AS starts, b.vec[1] > b.vec[5] AS starter FROM pr a JOIN pr b ON a.grp = b.grp AND a.seg = b.seg AND a.entity <> b.entity
), f AS (SELECT *, starts AND starter AND row_number() OVER (PARTITION BY base, starter ORDER BY distance, entity) = 1 AS first_ FROM d)
SELECT base, entity, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY first_ DESC, distance, entity) AS rank FROM f) WHERE rank <= 5"""


def substitute(spark, sf_dir):
    """For every customer in debt, who is out, the nearest of its nation and segment that is not."""
    p = _profiles(spark, sf_dir)
    debt = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("entity"))
    out = p.join(debt, "entity", "left_semi").select("grp", "seg", F.col("entity").alias("missing"), F.col("vec").alias("vec_a"))
    bench = p.join(out.select(F.col("missing").alias("entity")), "entity", "left_anti").withColumnRenamed("vec", "vec_b")
    return joins.cityblock_nearest(out, bench, ["grp", "seg"], "vec_a", "vec_b", "missing", "entity", finest=16, levels=8).select("missing", "entity", "distance")


SQL_SUBSTITUTE = f"""WITH {GAMES}, {PROFILES} SELECT a.entity AS missing, b.entity, {L1} AS distance FROM pr a JOIN pr b ON a.grp = b.grp AND a.seg = b.seg
WHERE a.entity IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND b.entity NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) QUALIFY row_number() OVER (PARTITION BY a.entity ORDER BY distance, b.entity) = 1"""


def record_streak(spark, sf_dir):
    """Wins (more than the mean of the nation) among the last ten, games away (odd keys) among the last five, and the streak before."""
    g = games(spark, sf_dir).where("qty is not null")
    g = g.join(g.groupBy("grp").agg(F.avg("qty").alias("usual")), "grp").withColumn("win", (F.col("qty") > F.col("usual")).cast("int"))
    every = Window.partitionBy("entity").orderBy(*ORDER)
    g = g.withColumn("run", F.row_number().over(every) - F.row_number().over(Window.partitionBy("entity", "win").orderBy(*ORDER)))
    g = g.withColumn("length", F.row_number().over(Window.partitionBy("entity", "win", "run").orderBy(*ORDER)))
    signed = F.when(F.col("win") == 1, F.col("length")).otherwise(-F.col("length"))
    w10, w5 = windows.trailing(["entity"], ORDER, 10), windows.trailing(["entity"], ORDER, 5)
    return g.select("game", "entity", F.coalesce(F.sum("win").over(w10), F.lit(0)).cast("bigint").alias("wins10"), F.coalesce(F.sum((F.col("game") % 2).cast("int")).over(w5), F.lit(0)).cast("bigint").alias("aways5"), F.coalesce(F.lag(signed).over(every), F.lit(0)).cast("bigint").alias("streak"))


SQL_STREAK = f"""WITH {GAMES}, g AS (SELECT *, CAST(qty > avg(qty) OVER (PARTITION BY grp) AS INT) AS win FROM games WHERE qty IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day, game) - row_number() OVER (PARTITION BY entity, win ORDER BY day, game) AS run FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY entity, win, run ORDER BY day, game) AS len_ FROM r)
SELECT game, entity, CAST(coalesce(sum(win) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wins10,
  CAST(coalesce(sum(game % 2) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS aways5,
  CAST(coalesce(lag(CASE WHEN win = 1 THEN len_ ELSE -len_ END) OVER (PARTITION BY entity ORDER BY day, game), 0) AS BIGINT) AS streak FROM l"""

POINTS = {"qty": 1.0, "price": -1.0, "lines": 1.5}


def _recent(spark, sf_dir):
    """Mean (weights 1, 1.1, 1.2 ... from the newest) and variance of fantasy points over the last ten events of an entity."""
    g = games(spark, sf_dir)
    g = g.withColumn("points", scalars.linear_points({k: F.col(k) for k in POINTS}, POINTS))
    last = windows.latest(g, ["entity"], ORDER, 10)
    weight = 1 + 0.1 * (F.col("place") - 1)
    return last.groupBy("entity", "grp", "seg").agg(stats.weighted_mean(F.col("points"), weight).alias("mean"), F.var_pop("points").alias("var"), F.sum("qty").alias("cost"))


RECENT = """ls AS (SELECT *, coalesce(qty, 0) * 1.0::DOUBLE + coalesce(price, 0) * -1.0::DOUBLE + coalesce(lines, 0) * 1.5::DOUBLE AS points,
  row_number() OVER (PARTITION BY entity ORDER BY day DESC, game DESC) AS place FROM games QUALIFY place <= 10),
rc AS (SELECT entity, grp, seg, sum(points * (1 + 0.1::DOUBLE * (place - 1))) / sum(1 + 0.1::DOUBLE * (place - 1)) AS mean, var_pop(points) AS var, sum(qty) AS cost FROM ls GROUP BY ALL)"""


def weighted_recent_avg(spark, sf_dir):
    return _recent(spark, sf_dir).select("entity", r4("mean"), r4("var"))


SQL_RECENT = f"WITH {GAMES}, {RECENT} SELECT entity, round(mean, 4) AS mean, round(var, 4) AS var FROM rc"


def inverse_variance_mix(spark, sf_dir):
    w = stats.inverse_variance_weight(F.col("var"))
    known = _recent(spark, sf_dir).where("var is not null").withColumn("w", w)
    # sums alone, which combine on the map side: no nation meets in a task
    sums = known.groupBy("grp").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("mean")).alias("wx"), F.sum(F.col("w") * F.col("w") * F.col("var")).alias("wv"))
    return sums.select("grp", F.round(F.col("wx") / F.col("w"), 4).alias("mean"), F.round(F.col("wv") / F.col("w") / F.col("w"), 4).alias("var"))


SQL_MIX = f"""WITH {GAMES}, {RECENT}, w AS (SELECT *, (1 / greatest(var, 0.01)) / sum(1 / greatest(var, 0.01)) OVER (PARTITION BY grp) AS w FROM rc WHERE var IS NOT NULL)
SELECT grp, round(sum(w * mean), 4) AS mean, round(sum(w * w * var), 4) AS var FROM w GROUP BY 1"""


def projection_avg(spark, sf_dir):
    r = _recent(spark, sf_dir)
    return r.groupBy("grp", "seg").agg(F.round(F.avg("mean"), 4).alias("mean"), F.round(F.sum("var") / F.pow(F.count("var"), F.lit(2)), 4).alias("var"), F.count(F.lit(1)).alias("n"))


SQL_PROJ = f"WITH {GAMES}, {RECENT} SELECT grp, seg, round(avg(mean), 4) AS mean, round(sum(var) / pow(count(var), 2), 4) AS var, count(*) AS n FROM rc GROUP BY ALL"


def linear_points(spark, sf_dir):
    g = games(spark, sf_dir)
    variance = {k: v * v for k, v in POINTS.items()}
    return g.select("game", half_up(scalars.linear_points({k: F.col(k) for k in POINTS}, POINTS)).alias("points"), half_up(scalars.linear_points({k: F.col(k) for k in POINTS}, variance)).alias("variance"))


SQL_LINEAR = f"""WITH {GAMES} SELECT game, {half_sql("coalesce(qty, 0) * 1.0::DOUBLE + coalesce(price, 0) * -1.0::DOUBLE + coalesce(lines, 0) * 1.5::DOUBLE")} AS points,
  {half_sql("coalesce(qty, 0) * 1.0::DOUBLE + coalesce(price, 0) * 1.0::DOUBLE + coalesce(lines, 0) * 2.25::DOUBLE")} AS variance FROM games"""


def value_per_cost(spark, sf_dir):
    r = _recent(spark, sf_dir).where("cost > 0").withColumn("mean", F.round("mean", 6))
    out = roster.value_per_cost(r, "mean", "cost", ["seg"], "entity")
    return out.where("rank <= 20").select("seg", "entity", F.col("rank").cast("bigint").alias("rank"), r4("value"))


SQL_VALUE = f"""WITH {GAMES}, {RECENT} SELECT seg, entity, rank, round(value, 4) AS value FROM (
  SELECT *, round(mean, 6) / cost AS value, row_number() OVER (PARTITION BY seg ORDER BY round(mean, 6) / cost DESC, entity) AS rank FROM rc WHERE cost > 0) WHERE rank <= 20"""


def _players(spark, sf_dir):
    """Suppliers as players of three positions, with whole points and costs."""
    kind = F.element_at(F.array(F.lit("g"), F.lit("f"), F.lit("c")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pid"), kind.alias("position"), (F.col("s_suppkey") * 7 % 23 + 1).cast("double").alias("points"), (F.col("s_suppkey") * 5 % 17 + 3).alias("cost")
    )


PLAYERS = "al AS (SELECT s_suppkey AS pid, ['g', 'f', 'c'][CAST(s_suppkey % 3 + 1 AS INT)] AS position, (s_suppkey * 7 % 23 + 1)::DOUBLE AS points, s_suppkey * 5 % 17 + 3 AS cost FROM supplier)"
ROSTERS = """ro AS (SELECT [a.pid, b.pid, c.pid, d.pid, e.pid] AS pids, a.points + b.points + c.points + d.points + e.points AS points, a.cost + b.cost + c.cost + d.cost + e.cost AS cost
  FROM {pool} a JOIN {pool} b ON a.position = 'g' AND b.position = 'g' AND a.pid < b.pid JOIN {pool} c ON c.position = 'f' JOIN {pool} d ON d.position = 'f' AND c.pid < d.pid JOIN {pool} e ON e.position = 'c')"""


def roster_combos(spark, sf_dir):
    """Every roster near the budget from the six players of each position with the most points for their cost."""
    best = roster.value_per_cost(_players(spark, sf_dir), "points", "cost", ["position"], "pid").where("rank <= 6")
    out = roster.roster_combinations(best, {"g": 2, "f": 2, "c": 1}, 20, 35)
    return out.select(F.array_join("pids", ",").alias("pids"), "points", "cost")


SQL_COMBOS = f"""WITH {PLAYERS}, pl AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY position ORDER BY points / cost DESC, pid) <= 6), {ROSTERS.format(pool="pl")}
SELECT array_to_string(pids, ',') AS pids, points, cost FROM ro WHERE cost BETWEEN 20 AND 35"""


def roster_dp(spark, sf_dir):
    """The five best rosters of all players within the budget."""
    out = roster.optimal_rosters(_players(spark, sf_dir), {"g": 2, "f": 2, "c": 1}, 40)
    return out.select(F.array_join("pids", ",").alias("pids"), "points", "cost")


SQL_DP = f"WITH {PLAYERS}, {ROSTERS.format(pool='al')} SELECT array_to_string(pids, ',') AS pids, points, cost FROM ro WHERE cost <= 40 ORDER BY points DESC, cost, pids LIMIT 5"


def position_minutes(spark, sf_dir):
    """Quantity by customer within nation and segment over the nation's last five days."""
    g = games(spark, sf_dir)
    days = windows.latest(g.select("grp", "day").distinct(), ["grp"], ["day"], 5).select("grp", "day")
    return g.join(days, ["grp", "day"]).groupBy("grp", "seg", "entity").agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"))


SQL_MINUTES = f"""WITH {GAMES}, d AS (SELECT grp, day FROM (SELECT DISTINCT grp, day FROM games) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY day DESC) <= 5)
SELECT grp, seg, entity, coalesce(sum(qty), 0) AS qty FROM games JOIN d USING (grp, day) GROUP BY ALL"""


def digitize(spark, sf_dir):
    """Classes of standardised quantities and of the mean before them, and the error of taking the mean as the forecast."""
    t = features.target_and_mean(games(spark, sf_dir), ["entity"], ORDER, "qty", 5)
    s = t.agg(F.avg("target").alias("m"), F.stddev_pop("target").alias("s")).select(F.round("m", 6).alias("m"), F.round("s", 6).alias("s"))
    z = t.crossJoin(F.broadcast(s)).select("game", *[scalars.digitize((F.col(c) - F.col("m")) / F.col("s"), 3.0, 10).alias(f"{c}_class") for c in ("target", "mean")])
    return z.groupBy("target_class", "mean_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("target_class") - F.col("mean_class"))) / 9, 4).alias("error"))


_CLASS = lambda x: "(" + " + ".join(f"CASE WHEN least(3, greatest(-3, {x})) >= {-3 + 6 * k / 8} THEN 1 ELSE 0 END" for k in range(9)) + ")"
SQL_DIGITIZE = f"""WITH {GAMES}, t AS (SELECT * FROM (SELECT qty AS target, avg(qty) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean FROM games) WHERE target IS NOT NULL AND mean IS NOT NULL),
s AS (SELECT round(avg(target), 6) AS m, round(stddev_pop(target), 6) AS s FROM t), c AS (SELECT {_CLASS('(target - m) / s')} AS target_class, {_CLASS('(mean - m) / s')} AS mean_class FROM t, s)
SELECT CAST(target_class AS INT) AS target_class, CAST(mean_class AS INT) AS mean_class, count(*) AS n, round(avg(abs(target_class - mean_class)) / 9, 4) AS error FROM c GROUP BY ALL"""


def impute_scale(spark, sf_dir):
    out = ml.preprocess(games(spark, sf_dir).select("game", "qty", "price", F.lit(None).cast("double").alias("void")), ["qty", "price", "void"])
    return out.select("game", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("qty_z", "price_z", "qty_01", "price_01")])


SQL_SCALE = f"WITH {GAMES}, " + "i AS (SELECT game, coalesce(qty, avg(qty) OVER ()) AS qty, coalesce(price, avg(price) OVER ()) AS price FROM games) SELECT game, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) + 0.0 AS {c}_z, round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 4) + 0.0 AS {c}_01" for c in ("qty", "price")
) + " FROM i"


def possession_box(spark, sf_dir):
    """The formulas on box scores made from line items: suppliers are players, odd and even ones are the teams."""
    # all that follows groups by order, or by order and more, where its lines are
    li = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), "l_orderkey").withColumnRenamed("l_orderkey", "game")
    q = F.col("l_quantity")
    parts = {"MP": q + 8, "FGM": q / 5 + 1, "FGA": q / 2 + 3, "FG3M": q / 20, "FTM": q / 10 + 1, "FTA": q / 8 + 2, "ORB": q / 10 + 1, "DRB": q / 4 + 1, "AST": q / 9, "STL": q / 30, "BLK": q / 25, "TOV": q / 20 + 1, "PF": q / 15 + 1, "PTS": q / 2 + 3}
    box = li.groupBy("game", F.col("l_suppkey").alias("player")).agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    both = possessions.with_totals(box.withColumn("team", F.col("player") % 2), "game", "team")
    out = possessions.possession_columns(both)
    return out.select("game", "player", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("TotPoss", "Stops", "StopPercent", "PProd", "FloorPercent", "ORtg")])


def _possession_sql() -> str:
    parts = {"MP": "q + 8", "FGM": "q / 5 + 1", "FGA": "q / 2 + 3", "FG3M": "q / 20", "FTM": "q / 10 + 1", "FTA": "q / 8 + 2", "ORB": "q / 10 + 1", "DRB": "q / 4 + 1", "AST": "q / 9", "STL": "q / 30", "BLK": "q / 25", "TOV": "q / 20 + 1", "PF": "q / 15 + 1", "PTS": "q / 2 + 3"}
    box = ", ".join(f"sum({v}) AS {k}" for k, v in parts.items())
    own = ", ".join(f"sum({k}) OVER (PARTITION BY game, team) AS t_{k}, sum({k}) OVER (PARTITION BY game) - sum({k}) OVER (PARTITION BY game, team) AS o_{k}" for k in parts)
    d = lambda a, b: f"(({a}) / nullif({b}, 0))"
    missed_t, missed, missed_o = d("t_FTM", "t_FTA"), d("FTM", "FTA"), d("o_FTM", "o_FTA")
    return f"""WITH b AS (SELECT l_orderkey AS game, l_suppkey AS player, l_suppkey % 2 AS team, {box} FROM (SELECT *, l_quantity AS q FROM lineitem) GROUP BY ALL),
s0 AS (SELECT *, {own} FROM b),
s1 AS (SELECT *, {d('MP', 't_MP / 5')} * (1.14 * {d('t_AST - AST', 't_FGM')}) + {d(d('t_AST', 't_MP') + ' * MP * 5 - AST', d('t_FGM', 't_MP') + ' * MP * 5 - FGM')} * (1 - {d('MP', 't_MP / 5')}) AS qast,
  0.5 * {d('(t_PTS - t_FTM) - (PTS - FTM)', '2 * (t_FGA - FGA)')} * AST AS ast_part, (1 - pow(1 - {missed}, 2)) * 0.4 * FTA AS ft_part, t_FGM + (1 - pow(1 - {missed_t}, 2)) * t_FTA * 0.4 AS tsp,
  {d('t_ORB', 't_ORB + o_DRB')} AS orbp FROM s0),
s2 AS (SELECT *, FGM * (1 - 0.5 * {d('PTS - FTM', '2 * FGA')} * qast) AS fg_part, {d('tsp', 't_FGA + t_FTA * 0.4 + t_TOV')} AS play FROM s1),
s3 AS (SELECT *, {d('(1 - orbp) * play', '(1 - orbp) * play + orbp * (1 - play)')} AS ow FROM s2),
s4 AS (SELECT *, ORB * ow * play AS orb_part, 1 - {d('t_ORB', 'tsp')} * ow * play AS kept FROM s3),
s5 AS (SELECT *, (fg_part + ast_part + ft_part) * kept + orb_part AS scposs FROM s4),
s6 AS (SELECT *, scposs + (FGA - FGM) * (1 - 1.07 * orbp) + pow(1 - {missed}, 2) * 0.4 * FTA + TOV AS totposs,
  (2 * (FGM + 0.5 * FG3M) * (1 - 0.5 * {d('PTS - FTM', '2 * FGA')} * qast) + 2 * {d('t_FGM - FGM + 0.5 * (t_FG3M - FG3M)', 't_FGM - FGM')} * 0.5 * {d('(t_PTS - t_FTM) - (PTS - FTM)', '2 * (t_FGA - FGA)')} * AST + FTM) * kept
  + ORB * ow * play * {d('t_PTS', 'tsp')} AS pprod, o_FGA + 0.44 * o_FTM + o_TOV - o_ORB AS tposs, {d('o_ORB', 'o_ORB + t_DRB')} AS dor, {d('o_FGM', 'o_FGA')} AS dfg FROM s5),
s7 AS (SELECT *, {d('dfg * (1 - dor)', 'dfg * (1 - dor) + (1 - dfg) * dor')} AS fmwt FROM s6),
s8 AS (SELECT *, STL + BLK * fmwt * (1 - 1.07 * dor) + DRB * (1 - fmwt) + ({d('o_FGA - o_FGM - t_BLK', 't_MP')} * fmwt * (1 - 1.07 * dor) + {d('o_TOV - t_STL', 't_MP')}) * MP + {d('PF', 't_PF')} * 0.4 * o_FTA * pow(1 - {missed_o}, 2) AS stops FROM s7)
SELECT game, player, round(totposs, 3) + 0.0 AS TotPoss, round(stops, 3) + 0.0 AS Stops, round({d('stops * o_MP', 'tposs * MP')}, 3) + 0.0 AS StopPercent, round(pprod, 3) + 0.0 AS PProd,
  round(CASE WHEN totposs > 0 THEN scposs / totposs END, 3) + 0.0 AS FloorPercent, round(CASE WHEN totposs > 0 THEN 100 * pprod / totposs END, 3) + 0.0 AS ORtg FROM s8"""


def running(spark, sf_dir):
    out = features.running(games(spark, sf_dir), ["entity", "season"], ORDER, ["qty"])
    return out.select("game", *[r4(f"qty_{k}") for k in ("season", "last", "last_var", "trend")])


SQL_RUNNING = f"""WITH {GAMES}, r AS (SELECT game, avg(qty) OVER s AS a, avg(qty) OVER w AS b, var_pop(qty) OVER w AS v FROM games
  WINDOW s AS (PARTITION BY entity, season ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY entity, season ORDER BY day, game ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT game, round(a, 4) AS qty_season, round(b, 4) AS qty_last, round(v, 4) AS qty_last_var, round(coalesce(a, 0) - coalesce(b, 0), 4) AS qty_trend FROM r"""


def feature_matrix(spark, sf_dir):
    g = games(spark, sf_dir)
    rest = windows.days_rest(g, ["entity"], "day").withColumnRenamed("rest", "days")
    location = g.join(rest, ["entity", "day"]).select("game", "days", *[c.alias(f"seg_{k.lower()}") for k, c in scalars.one_hot(F.col("seg"), ["AUTOMOBILE", "BUILDING"]).items()])
    form = windows.trailing(["entity"], ORDER, 5)
    recent = g.select("game", F.round(F.avg("qty").over(form), 4).alias("qty"))
    return features.feature_matrix(g, {"location": location, "form": recent}, ["game"])


SQL_MATRIX = f"""WITH {GAMES}, d AS (SELECT entity, day, least(10, coalesce(date_diff('day', lag(day) OVER (PARTITION BY entity ORDER BY day), day), 10)) AS days FROM (SELECT DISTINCT entity, day FROM games))
SELECT game, round(avg(qty) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS form_qty, CAST(days AS INT) AS location_days,
  CASE WHEN seg = 'AUTOMOBILE' THEN 1 ELSE -1 END AS location_seg_automobile, CASE WHEN seg = 'BUILDING' THEN 1 ELSE -1 END AS location_seg_building FROM games JOIN d USING (entity, day)"""


def _training(spark, sf_dir):
    t = features.running(games(spark, sf_dir), ["entity"], ORDER, ["qty", "lines"]).where("qty is not null and qty_last is not null")
    return t.select("game", F.col("qty").alias("label"), "qty_season", "qty_last", "qty_trend", "lines_last")


def gbt_fit(spark, sf_dir):
    return ml.evaluate_regressor(_training(spark, sf_dir), ["qty_season", "qty_last", "qty_trend", "lines_last"], kind="gbt", iterations=10)


def forest_fit(spark, sf_dir):
    return ml.evaluate_regressor(_training(spark, sf_dir), ["qty_season", "qty_last", "qty_trend", "lines_last"], kind="forest", iterations=10)


def linear_fit(spark, sf_dir):
    return ml.evaluate_regressor(_training(spark, sf_dir), ["qty_season", "qty_last", "qty_trend", "lines_last"], kind="linear")


def _of_segments(spark, sf_dir):
    """Quantity with what came before it and the segment as flags."""
    t = features.running(games(spark, sf_dir), ["entity"], ORDER, ["qty"]).where("qty is not null and qty_last is not null")
    flags = {f"seg_{k}": F.when(F.col("seg") == k, 1.0).otherwise(-1.0) for k in ("AUTOMOBILE", "BUILDING")}
    return t.withColumns(flags).select("grp", "game", F.col("qty").alias("label"), "qty_season", "qty_last", *flags), [["qty_season"], ["qty_last"], list(flags)]


def gp_fit(spark, sf_dir):
    """A Gaussian process for each nation, its kernel learned on a bounded number of its events, its posterior that of all of them."""
    t, parts = _of_segments(spark, sf_dir)
    return processes.learned_process(t, "grp", "game", [c for p in parts for c in p], "label", parts)[0]


def gp_kernels(spark, sf_dir):
    """What was learned: evidence before and after, noise, variances and lengths of each nation."""
    t, parts = _of_segments(spark, sf_dir)
    found = processes.learned_process(t, "grp", "game", [c for p in parts for c in p], "label", parts)[1]
    return found.withColumn("parts", F.to_json("parts"))


def gbt_rounds(spark, sf_dir):
    """Errors of each round of boosting that stops by a validation part: the price of an order from its quantity, its lines and its customer's last orders."""
    t = features.running(games(spark, sf_dir), ["entity"], ORDER, ["qty"])
    return ml.boosted(t.where("price is not null"), ["qty", "lines", "qty_last"], label="price", most=25, rate=0.3)[1]


_INPUTS = ["qty_season", "qty_last", "qty_trend", "lines_last"]


def dae_fit(spark, sf_dir):
    """Error of each epoch of a denoising autoencoder of the features."""
    scaled = ml.preprocess(_training(spark, sf_dir).select("game", *_INPUTS), _INPUTS)
    return neural.fit_autoencoder(scaled, [f"{c}_01" for c in _INPUTS], "game", 3, rate=0.5, epochs=6, batches=4)[1]


def sdae_fit(spark, sf_dir):
    """A stacked autoencoder under a softmax beside the softmax alone, for whether an order's price is a middle one, which no plane parts: errors on the test part, and when each was best. Layers are trained for 15 epochs, then both descend until their rule stops them."""
    inputs = ["qty", "lines", "qty_last"]
    t = features.running(games(spark, sf_dir), ["entity"], ORDER, ["qty"]).where("price is not null")
    t = t.withColumn("label", F.col("price").between(120, 240).cast("int"))
    columns = [f"{c}_z" for c in inputs]
    rows = t.select("game", "label", *inputs).persist()
    train, valid, test = ml.split(ml.preprocess(rows, inputs, limit=3.0), "game")
    held, out = neural.held(neural.batched(test, columns, "game", 1, "label"))[0], []
    for kind, layers in (("stacked", [8, 6]), ("softmax", [])):
        network, _, rule = neural.fit_stacked(train, valid, columns, "label", "game", 2, layers, [0.1, 0.1][: len(layers)], rate=1.0, batches=4, act="tanh", cost="MSE")
        error, n = neural.class_error(held, network, 2)
        out.append((kind, n, error, float(rule.best), rule.best_iteration // 4 + 1))
    for part in (rows, held):
        part.unpersist()
    return spark.createDataFrame(out, "kind string, test bigint, error double, valid_error double, best_epoch int")


def bayesian_drawn(spark, sf_dir):
    """Bayesian bootstrap of the quantities of each nation: the closed forms, and whether 30 draws agree within their deviation."""
    g = games(spark, sf_dir).select("grp", "game", "qty")
    closed = g.groupBy("grp").agg(stats.bayesian_mean(F.col("qty")).alias("mean"), stats.bayesian_var(F.col("qty")).alias("var"), F.count("qty").alias("n"))
    drawn = stats.dirichlet_resampled(g, ["grp"], "qty").select("grp", F.col("mean").alias("d_mean"), F.col("var").alias("d_var"))
    near = (F.abs(F.col("d_mean") - F.col("mean")) <= 6 * F.sqrt((F.col("var") + F.col("mean") * F.col("mean")) / F.col("n") / 30)) & (F.abs(F.col("d_var") - F.col("var")) <= 6 * F.col("var") * F.sqrt(F.lit(4.0) / F.col("n") / 30))
    return closed.join(drawn, "grp").select("grp", r4("mean"), r4("var"), near.alias("agrees"))


SQL_DRAWN = f"WITH {GAMES} SELECT grp, round(sum(qty) / count(*), 4) AS mean, round(var_pop(qty) * count(qty) / (count(qty) + 1), 4) AS var, true AS agrees FROM games GROUP BY 1"


def typical_deviation(spark, sf_dir):
    """A statistic that no Column gives, plugged in: the median distance from the median, of each customer's quantities."""
    g = games(spark, sf_dir).where("qty is not null")

    def median(x: np.ndarray) -> float:
        """What ``np.median`` gives, of a few values in a sixth of its time; NaN sorts last, and one makes it NaN."""
        x, k = np.sort(x), len(x) // 2
        if x[-1] != x[-1]:
            return x[-1]
        return x[k] if len(x) % 2 else (x[k - 1] + x[k]) / 2

    spread = stats.of_values(lambda x: median(np.abs(x - median(x))) if len(x) else None)
    return g.groupBy("entity").agg(spread(F.col("qty")).alias("spread")).select("entity", r4("spread"))


SQL_DEVIATION = f"WITH {GAMES}, m AS (SELECT entity, median(qty) AS m FROM games WHERE qty IS NOT NULL GROUP BY 1) SELECT entity, round(median(abs(qty - m)), 4) AS spread FROM games JOIN m USING (entity) WHERE qty IS NOT NULL GROUP BY 1"


def effect_features(spark, sf_dir):
    """Customers as players of a nation, suppliers on their orders as partners: mean quantity with the suppliers of the nation that are in debt, less the mean of all."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("one"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("two"), "l_quantity")
    both = orders.join(items, "game")
    pairs = both.groupBy("one", "two").agg(F.avg("l_quantity").alias("x"))
    alone = both.groupBy("one").agg(F.avg("l_quantity").alias("x")).select("one", F.lit(None).cast("bigint").alias("two"), "x")
    players = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("one"), F.col("c_nationkey").alias("grp"))
    missing = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("one"), F.col("s_nationkey").alias("grp"))
    out = features.effect_deltas(players, missing, pairs.unionByName(alone), ["grp"], "one", "two", "x")
    return out.select("one", "grp", "pairs", r4("delta"))


SQL_EFFECT = """WITH b AS (SELECT o_custkey AS one, l_suppkey AS two, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
p AS (SELECT one, two, avg(q) AS x FROM b GROUP BY ALL), a AS (SELECT one, avg(q) AS x FROM b GROUP BY ALL),
m AS (SELECT c_custkey AS one, avg(p.x) AS x, count(*) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal < 0 AND s_suppkey <> c_custkey JOIN p ON p.one = c_custkey AND p.two = s_suppkey GROUP BY ALL)
SELECT c_custkey AS one, c_nationkey AS grp, coalesce(n, 0) AS pairs, round(coalesce(m.x - a.x, 0), 4) AS delta FROM customer LEFT JOIN m ON m.one = c_custkey LEFT JOIN a ON a.one = c_custkey"""


def _projections(spark, sf_dir):
    """Two simple models of every event: the entity's last ten, and its nation's season so far."""
    g = games(spark, sf_dir)
    own, season = windows.trailing(["entity"], ORDER, 10), windows.to_date(["grp", "season"], ORDER)
    base = g.select("game", "entity", "qty", F.round(F.avg("qty").over(own), 6).alias("m0"), F.round(F.var_pop("qty").over(own), 6).alias("v0"), F.round(F.avg("qty").over(season), 6).alias("m1"), F.round(F.var_pop("qty").over(season), 6).alias("v1"))
    each = F.explode(F.array(*[F.struct(F.col(f"m{k}").alias("mean"), F.col(f"v{k}").alias("var")) for k in (0, 1)])).alias("p")
    return base, base.select("game", each).select("game", "p.*")


PROJECTIONS = """pj AS (SELECT game, entity, qty, round(avg(qty) OVER a, 6) AS m0, round(var_pop(qty) OVER a, 6) AS v0, round(avg(qty) OVER b, 6) AS m1, round(var_pop(qty) OVER b, 6) AS v1 FROM games
  WINDOW a AS (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY grp, season ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ps AS (SELECT game, unnest([m0, m1]) AS mean, unnest([v0, v1]) AS var FROM pj), w AS (SELECT *, 1 / greatest(var, 0.01) AS w FROM ps WHERE mean IS NOT NULL AND var IS NOT NULL),
mx AS (SELECT game, sum(w * mean) / sum(w) AS mean, sum(w * w * var) / sum(w) / sum(w) AS var, count(*) AS models FROM w GROUP BY 1)"""


def make_projection(spark, sf_dir):
    return features.mixed_projection(_projections(spark, sf_dir)[1], ["game"]).select("game", r4("mean"), r4("var"), "models")


SQL_PROJECTION = f"WITH {GAMES}, {PROJECTIONS} SELECT game, round(mean, 4) AS mean, round(var, 4) AS var, models FROM mx"


def historical_compare(spark, sf_dir):
    """What was, what was projected, and the mean of the last ten, with the errors of both, by nation of the entity."""
    base, each = _projections(spark, sf_dir)
    mixed = features.mixed_projection(each, ["game"]).select("game", "mean")
    joined = base.join(mixed, "game").where("qty is not null and m0 is not null")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("grp"))
    err = lambda c: F.round(F.avg(F.abs(F.col("qty") - F.col(c))), 4)
    return joined.join(people, "entity").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), err("mean").alias("projected_error"), err("m0").alias("average_error"))


SQL_HISTORICAL = f"""WITH {GAMES}, {PROJECTIONS} SELECT c_nationkey AS grp, count(*) AS n, round(avg(abs(qty - mx.mean)), 4) AS projected_error, round(avg(abs(qty - m0)), 4) AS average_error
FROM pj JOIN mx USING (game) JOIN customer ON c_custkey = entity WHERE qty IS NOT NULL AND m0 IS NOT NULL GROUP BY 1"""


def _classes(spark, sf_dir):
    t = _training(spark, sf_dir)
    return t.withColumn("label", F.when(F.col("label") < 60, 0).when(F.col("label") < 130, 1).otherwise(2))


def logistic_fit(spark, sf_dir):
    return ml.evaluate_classifier(_classes(spark, sf_dir), ["qty_season", "qty_last", "qty_trend", "lines_last"], classes=3)


def mlp_fit(spark, sf_dir):
    return ml.evaluate_classifier(_classes(spark, sf_dir), ["qty_season", "qty_last", "qty_trend", "lines_last"], kind="mlp", classes=3)


def param_grid(spark, sf_dir):
    return ml.grid(_training(spark, sf_dir), ["qty_season", "qty_last", "qty_trend", "lines_last"])


PLANS = {
    "effect_features": (effect_features, SQL_EFFECT), "make_projection": (make_projection, SQL_PROJECTION), "historical_compare": (historical_compare, SQL_HISTORICAL),
    "logistic_fit": (logistic_fit, None), "mlp_fit": (mlp_fit, None), "param_grid": (param_grid, None),
    "interval_baseline": (interval_baseline, SQL_INTERVAL), "distribution_norm": (distribution_norm, SQL_NORM), "cityblock_rank": (cityblock_rank, SQL_CITY), "substitute": (substitute, SQL_SUBSTITUTE),
    "record_streak": (record_streak, SQL_STREAK), "weighted_recent_avg": (weighted_recent_avg, SQL_RECENT), "inverse_variance_mix": (inverse_variance_mix, SQL_MIX), "projection_avg": (projection_avg, SQL_PROJ),
    "linear_points": (linear_points, SQL_LINEAR), "value_per_cost": (value_per_cost, SQL_VALUE), "roster_combos": (roster_combos, SQL_COMBOS), "roster_dp": (roster_dp, SQL_DP),
    "position_minutes": (position_minutes, SQL_MINUTES), "digitize": (digitize, SQL_DIGITIZE), "impute_scale": (impute_scale, SQL_SCALE), "possession_box": (possession_box, _possession_sql()),
    "running": (running, SQL_RUNNING), "feature_matrix": (feature_matrix, SQL_MATRIX), "gbt_fit": (gbt_fit, None), "forest_fit": (forest_fit, None), "linear_fit": (linear_fit, None), "gp_fit": (gp_fit, None),
    "gp_kernels": (gp_kernels, None), "gbt_rounds": (gbt_rounds, None), "dae_fit": (dae_fit, None), "sdae_fit": (sdae_fit, None), "bayesian_drawn": (bayesian_drawn, SQL_DRAWN), "typical_deviation": (typical_deviation, SQL_DEVIATION),
}
