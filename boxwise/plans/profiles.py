"""Queries of windows, vectors, ranges and serving, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxwise.functions import scalars
from boxwise.functions.stats import z_score
from boxwise.operators import ranges, serve, vectors, windows
from boxwise.plans.base import GAMES, WINDOW, ewm_sql, games, half_sql, half_up, r4, shown
from boxwise.sources.tables import table

ORDER = ["day", "game"]
_W10 = "OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_MEAN, _VAR = ewm_sql("v", "n")
OWN = f"""
own AS (
  SELECT *, CASE WHEN mean = qty AND var = 0 THEN 0 ELSE (qty - mean) / nullif(sqrt(var), 0) END AS z, {_MEAN} AS expmean, {_VAR} AS expvar
  FROM (
    SELECT *, avg(qty) {_W10} AS mean, CASE WHEN count(*) {_W10} > 1 THEN var_pop(qty) {_W10} END AS var,
      coalesce(list(qty) FILTER (qty IS NOT NULL) {_W10}, []) AS v, count(*) {_W10} AS n
    FROM games
  )
)
"""


def own_window(spark, sf_dir):
    own = vectors.output_trend(games(spark, sf_dir), ["entity"], ORDER, "qty", WINDOW)
    return own.select("game", "entity", r4("mean"), r4("var"), r4("expmean"), r4("expvar"), "n")


SQL_OWN = f"WITH {GAMES}, {OWN} SELECT game, entity, round(mean, 4) AS mean, round(var, 4) AS var, round(expmean, 4) AS expmean, round(expvar, 4) AS expvar, n FROM own"


def output_trend(spark, sf_dir):
    own = vectors.output_trend(games(spark, sf_dir), ["entity"], ORDER, "qty", WINDOW)
    return own.select("game", "entity", "qty", r4("z"))


SQL_TREND = f"WITH {GAMES}, {OWN} SELECT game, entity, qty, round(z, 4) AS z FROM own"


def season_to_date(spark, sf_dir):
    df = vectors.season_to_date(games(spark, sf_dir), ["grp", "season"], ORDER, "qty")
    return df.select("game", "grp", "season", r4("bayes_mean"), r4("bayes_var"))


SQL_SEASON = f"""WITH {GAMES} SELECT game, grp, season, round(sum(qty) OVER w / nullif(count(*) OVER w, 0), 4) AS bayes_mean,
  round(var_pop(qty) OVER w * (count(qty) OVER w) / (count(qty) OVER w + 1), 4) AS bayes_var
FROM games WINDOW w AS (PARTITION BY grp, season ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def group_window(spark, sf_dir):
    """The last ten of a group's own events, by the spine: rows of events before, not a frame over entities."""
    g = games(spark, sf_dir)
    per_day = g.groupBy("grp", "season", "day").agg(F.sum("qty").alias("qty")).withColumn("event", F.datediff("day", F.lit("1970-01-01")))
    spine = windows.spine(per_day, "grp", "season", "event", "day")
    rows = windows.last_events(spine, per_day.select("grp", "season", "event", "qty"), "grp", "season", "event", "grp", WINDOW)
    out = rows.groupBy("grp", "target").agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.var_pop("qty")).alias("var"))
    return out.select("grp", F.col("target").cast("bigint").alias("target"), "n", r4("mean"), r4("var"))


SQL_GROUP = f"""WITH {GAMES}, d AS (SELECT grp, season, day, sum(qty) AS qty FROM games GROUP BY ALL), w AS (
  SELECT grp, CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) AS target, count(*) OVER w AS n, avg(qty) OVER w AS mean, var_pop(qty) OVER w AS var
  FROM d WINDOW w AS (PARTITION BY grp, season ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
) SELECT grp, target, n, round(mean, 4) AS mean, round(CASE WHEN n > 1 THEN var END, 4) AS var FROM w WHERE n > 0"""

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def splits(spark, sf_dir):
    df = vectors.splits(games(spark, sf_dir), ["entity"], ORDER, "qty", "prio", PRIORITIES)
    return df.select("game", "entity", *[r4(f"split_{k}") for k in range(5)])


SQL_SPLITS = f"WITH {GAMES} SELECT game, entity, " + ", ".join(
    f"round(coalesce(avg(CASE WHEN prio = '{p}' THEN qty END) OVER w, avg(qty) OVER w) - avg(qty) OVER w, 4) AS split_{k}" for k, p in enumerate(PRIORITIES)
) + " FROM games WINDOW w AS (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"


def _against(spark, sf_dir):
    g = vectors.output_trend(games(spark, sf_dir), ["entity"], ORDER, "qty", WINDOW)
    # the opponent's events are days on which a nation's customers ordered; entities with little to show are left out
    outputs = g.where("qty >= 20").withColumn("event", F.datediff("day", F.lit("1970-01-01")))
    spine = windows.spine(outputs, "grp", "season", "event", "day")
    allowed = vectors.allowed_by_position(outputs.select("grp", "season", "event", "entity", "seg", "qty", "z"), spine, "grp", "season", "event", "entity", "seg", "qty", "z")
    return outputs, allowed


def against_position(spark, sf_dir):
    _, allowed = _against(spark, sf_dir)
    return allowed.select("grp", F.col("target").cast("bigint").alias("target"), "seg", "n", r4("mean"), r4("var"), r4("trend_mean"), r4("trend_var"))


AGAINST = """
out AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) AS event FROM own WHERE qty >= 20),
sp AS (SELECT grp, season, event, row_number() OVER (PARTITION BY grp, season ORDER BY event) AS seq FROM (SELECT DISTINCT grp, season, event FROM out)),
rw AS (SELECT t.grp, t.event AS target, o.seg, o.qty, o.z FROM out o JOIN sp s USING (grp, season, event)
  JOIN sp t ON t.grp = s.grp AND t.season = s.season AND t.seq BETWEEN s.seq + 1 AND s.seq + 20),
ag AS (SELECT grp, target, seg, count(*) AS n, sum(qty) / count(*) AS mean, var_pop(qty) * count(qty) / (count(qty) + 1) AS var,
  sum(z) / count(*) AS trend_mean, var_pop(z) * count(z) / (count(z) + 1) AS trend_var FROM rw GROUP BY ALL)
"""
SQL_AGAINST = f"WITH {GAMES}, {OWN}, {AGAINST} SELECT grp, target, seg, n, round(mean, 4) AS mean, round(var, 4) AS var, round(trend_mean, 4) AS trend_mean, round(trend_var, 4) AS trend_var FROM ag"


def entity_trend(spark, sf_dir):
    outputs, allowed = _against(spark, sf_dir)
    allowed = allowed.select("grp", F.col("target").alias("event"), "seg", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))
    out = vectors.entity_trend(outputs.drop("mean", "var"), allowed, ["grp", "event", "seg"], "entity", ORDER, "qty", WINDOW)
    return out.select("game", "entity", r4("z_allowed"), r4("trend"), r4("trend_var"))


SQL_ENTITY = f"""WITH {GAMES}, {OWN}, {AGAINST}, zz AS (
  SELECT o.game, o.entity, o.day, CASE WHEN o.qty = am AND av = 0 THEN 0 ELSE (o.qty - am) / nullif(sqrt(av), 0) END AS z_allowed
  FROM out o LEFT JOIN (SELECT target, grp AS agrp, seg AS aseg, round(mean, 6) AS am, round(var, 6) AS av FROM ag) a ON o.grp = agrp AND o.event = target AND o.seg = aseg
) SELECT game, entity, round(z_allowed, 4) AS z_allowed, round(sum(z_allowed) OVER w / nullif(count(*) OVER w, 0), 4) AS trend,
  round(var_pop(z_allowed) OVER w * count(z_allowed) OVER w / (count(z_allowed) OVER w + 1), 4) AS trend_var
FROM zz WINDOW w AS (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


def days_rest(spark, sf_dir):
    return windows.days_rest(games(spark, sf_dir), ["grp", "season"], "day")


SQL_REST = f"""WITH {GAMES}, d AS (SELECT DISTINCT grp, season, day FROM games)
SELECT grp, season, day, CAST(least(10, coalesce(date_diff('day', lag(day) OVER (PARTITION BY grp, season ORDER BY day), day), 10)) AS INT) AS rest FROM d"""


def back_to_back(spark, sf_dir):
    return windows.back_to_back(games(spark, sf_dir), ["entity"], "day")


SQL_B2B = f"""WITH {GAMES}, d AS (SELECT DISTINCT entity, day FROM games), c AS (SELECT *, """ + ", ".join(
    f"count(*) OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND CURRENT ROW) AS c{n}" for n in (1, 2, 3, 4)
) + """ FROM d) SELECT entity, day, CASE WHEN c1 >= 2 THEN 1 ELSE -1 END AS b2b, CASE WHEN c2 >= 2 THEN 1 ELSE -1 END AS g2of3,
  CASE WHEN c3 >= 3 THEN 1 ELSE -1 END AS g3of4, CASE WHEN c4 >= 4 THEN 1 ELSE -1 END AS g4of5 FROM c"""


def trend_ratio(spark, sf_dir):
    g = games(spark, sf_dir).where("qty is not null")
    return g.select("game", "entity", half_up(windows.trend_ratio("qty", ["entity"], ORDER)).alias("ratio"), F.round(windows.running_mean("qty", ["entity"], ORDER), 4).alias("running"))


SQL_RATIO = f"""WITH {GAMES}, g AS (SELECT * FROM games WHERE qty IS NOT NULL), v AS (
  SELECT *, (coalesce(list(qty) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), [])
    || list(qty) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))[1:15] AS vs,
    avg(qty) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS av FROM g
) SELECT game, entity, {half_sql("CASE WHEN list_sum(vs) <> 0 THEN qty / (list_sum(vs) / len(vs)) WHEN qty = 0 THEN 1 ELSE 2 END")} AS ratio, round(coalesce(av, qty), 4) AS running FROM v"""


def latest_rows(spark, sf_dir):
    """A bounded buffer: the last 1500 events of all, by (day, game); each part of the data sends its own last ones."""
    last = games(spark, sf_dir).orderBy(F.desc("day"), F.desc("game")).limit(1500)
    return last.select("game", "day", "entity")


SQL_LATEST = f"WITH {GAMES} SELECT game, day, entity FROM games ORDER BY day DESC, game DESC LIMIT 1500"


def topk_group(spark, sf_dir):
    return windows.latest(games(spark, sf_dir), ["entity"], ORDER, 3).select("entity", "game", F.col("place").cast("bigint").alias("place"))


SQL_TOPK = f"WITH {GAMES} SELECT entity, game, place FROM (SELECT entity, game, row_number() OVER (PARTITION BY entity ORDER BY day DESC, game DESC) AS place FROM games) WHERE place <= 3"


def roundrobin(spark, sf_dir):
    out = windows.round_robin(games(spark, sf_dir), "day", "grp", ["game"])
    return out.select("day", "grp", "game", F.col("turn").cast("bigint").alias("turn"))


SQL_ROBIN = f"WITH {GAMES} SELECT day, grp, game, row_number() OVER (PARTITION BY day, grp ORDER BY game) AS turn FROM games"


def _long(spark, sf_dir):
    g = games(spark, sf_dir).withColumn("rate", scalars.per_unit(F.col("price"), F.col("qty")))
    return serve.long(g, ["game", "entity", "seg", "day"], ["price", "qty", "rate"])


LONG = """lg AS (SELECT game, entity, seg, day, k AS stat_key, v AS value FROM (
  SELECT game, entity, seg, day, unnest(['price', 'qty', 'rate']) AS k, unnest([price, qty, 36 * price / nullif(qty, 0)]) AS v FROM games)),
bn AS (SELECT unnest([seg, 'ALL']) AS bin, stat_key, value FROM lg),
rg AS (SELECT bin, stat_key, CASE WHEN min(value) >= 0 THEN greatest(avg(value) - 2 * stddev_samp(value), 0) ELSE avg(value) - 2 * stddev_samp(value) END AS lower,
  CASE WHEN max(value) <= 0 THEN least(avg(value) + 2 * stddev_samp(value), 0) ELSE avg(value) + 2 * stddev_samp(value) END AS upper FROM bn GROUP BY ALL)"""


def stat_ranges(spark, sf_dir):
    return ranges.stat_ranges(_long(spark, sf_dir).withColumn("bins", F.array("seg"))).select("bin", "stat_key", r4("lower"), r4("upper"))


SQL_RANGES = f"WITH {GAMES}, {LONG} SELECT bin, stat_key, round(lower, 4) AS lower, round(upper, 4) AS upper FROM rg"


def colour_scale(spark, sf_dir):
    long = _long(spark, sf_dir)
    rng = stat_ranges(spark, sf_dir).withColumnRenamed("bin", "seg")
    out = ranges.coloured(long, rng, ["seg", "stat_key"], reversed_keys=("rate",))
    return out.select("game", "stat_key", "colour")


COLOUR = """cl AS (SELECT *, CASE WHEN value <= lower THEN 0.0::DOUBLE WHEN value >= upper THEN 1.0::DOUBLE ELSE (value - lower) / nullif(upper - lower, 0) END AS f0
  FROM lg LEFT JOIN (SELECT bin AS seg, stat_key, round(lower, 4) AS lower, round(upper, 4) AS upper FROM rg) USING (seg, stat_key)),
cc AS (SELECT *, CAST(floor((CASE WHEN stat_key = 'rate' THEN 1 - f0 ELSE f0 END) * 510) AS INT) AS s FROM cl),
co AS (SELECT *, CASE WHEN s IS NULL THEN 'transparent' ELSE format('#{:02x}{:02x}00', least(255, 510 - s), least(255, s)) END AS colour FROM cc)"""
SQL_COLOUR = f"WITH {GAMES}, {LONG}, {COLOUR} SELECT game, stat_key, colour FROM co"


def serve_basic(spark, sf_dir):
    """One row for each event with amount, stats as columns of value and colour."""
    long = _long(spark, sf_dir)
    out = ranges.coloured(long, stat_ranges(spark, sf_dir).withColumnRenamed("bin", "seg"), ["seg", "stat_key"], reversed_keys=("rate",))
    cells = out.withColumn("cell", F.struct(serve.cell(F.col("value")).alias("v"), F.col("colour").alias("c")))
    table_ = serve.wide(cells, ["game", "entity", "seg"], ["price", "qty", "rate"], value=F.col("cell"))
    kept = serve.without_empty(table_.withColumn("amount", F.col("qty.v")), "amount")
    return kept.select("game", "entity", "seg", *[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in ("price", "qty", "rate") for x in ("v", "c")])


SQL_BASIC = f"WITH {GAMES}, {LONG}, {COLOUR} SELECT * FROM (SELECT game, entity, seg, " + ", ".join(
    f"max(CASE WHEN stat_key = '{k}' THEN floor(value * 100 + 0.5) / 100 END) AS {k}_v, max(CASE WHEN stat_key = '{k}' THEN colour END) AS {k}_c" for k in ("price", "qty", "rate")
) + " FROM co GROUP BY game, entity, seg) WHERE coalesce(qty_v, 0) <> 0"


def serve_matchup(spark, sf_dir):
    """Stats as rows and types as columns: own, exponential and their difference, for each entity's latest event."""
    own = vectors.own_window(games(spark, sf_dir), ["entity"], ORDER, "qty", WINDOW)
    last = windows.latest(own, ["entity"], ORDER, 1)
    names = {"mean": "own_mean(10)", "expmean": "exp_+mean", "var": "own_var", "expvar": "exp_var(10)"}
    wide = last.select("entity", *[F.col(c).alias(n) for c, n in names.items()])
    long = serve.long(wide, ["entity"], list(names.values()), "k")
    kind, stat = F.split_part("k", F.lit("_"), F.lit(1)), scalars.clean_key(F.split_part("k", F.lit("_"), F.lit(2)))
    out = serve.wide(long.select("entity", kind.alias("kind"), stat.alias("stat"), "value"), ["entity", "stat"], ["own", "exp"], key="kind")
    return out.select("entity", "stat", F.round("own", 2).alias("own"), F.round("exp", 2).alias("exp"), F.round(F.col("exp") - F.col("own"), 2).alias("expdiff"))


SQL_MATCHUP = f"""WITH {GAMES}, {OWN}, l AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY entity ORDER BY day DESC, game DESC) = 1)
SELECT entity, 'mean' AS stat, round(mean, 2) AS own, round(expmean, 2) AS exp, round(expmean - mean, 2) AS expdiff FROM l
UNION ALL SELECT entity, 'var', round(var, 2), round(expvar, 2), round(expvar - var, 2) FROM l"""


def interval_buckets(spark, sf_dir):
    """Events of a user within the five days before, counted, and their value summed, from the events table."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    w = Window.partitionBy("user_id").orderBy(day).rangeBetween(-5, -1)
    return table(spark, sf_dir, "events").select(
        "event_id", F.count(F.lit(1)).over(w).alias("n"), F.coalesce(F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w), F.lit(0)).alias("cents")
    )


SQL_BUCKETS = """SELECT event_id, count(*) OVER w AS n, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER w, 0) AS BIGINT) AS cents FROM
(SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY d RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)"""

PLANS = {
    "own_window": (own_window, SQL_OWN), "output_trend": (output_trend, SQL_TREND), "season_to_date": (season_to_date, SQL_SEASON),
    "group_window": (group_window, SQL_GROUP), "splits": (splits, SQL_SPLITS), "against_position": (against_position, SQL_AGAINST),
    "entity_trend": (entity_trend, SQL_ENTITY), "days_rest": shown(days_rest, SQL_REST, ("day",)), "back_to_back": shown(back_to_back, SQL_B2B, ("day",)),
    "trend_ratio": (trend_ratio, SQL_RATIO), "latest_rows": shown(latest_rows, SQL_LATEST, ("day",)), "topk_group": (topk_group, SQL_TOPK),
    "roundrobin": shown(roundrobin, SQL_ROBIN, ("day",)), "stat_ranges": (stat_ranges, SQL_RANGES), "colour_scale": (colour_scale, SQL_COLOUR),
    "serve_basic": (serve_basic, SQL_BASIC), "serve_matchup": (serve_matchup, SQL_MATCHUP), "days_window": (interval_buckets, SQL_BUCKETS),
}
