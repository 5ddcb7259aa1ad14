"""Queries of forms by position, samples and writes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwise.operators import features, matchups, merge, ml, people, serve, windows
from boxwise.plans.base import GAMES, games, half_sql, r4
from boxwise.plans.matchups import _SHARES
from boxwise.plans.profiles import ORDER
from boxwise.sources import assembly, resultset
from boxwise.sources.tables import table


def position_form(spark, sf_dir):
    """What a nation's customers earned at each priority over its last ten days of the season, each order over its customer's mean within 120 days, blended by each customer's shares."""
    g = games(spark, sf_dir).where("qty is not null").withColumn("event", F.datediff("day", F.lit("1970-01-01")))
    shares = matchups.position_shares(g, "entity", "prio", "lines")
    rated = features.earned_and_given(g, ["entity"], "day", "qty", days=120).where("lines >= 2")
    spine = windows.spine(g, "grp", "season", "event", "day")
    given = matchups.recent_by_position(rated, shares, spine, "grp", "season", "event", "entity", "prio", "ratio")
    return matchups.blended(g.select("game", "grp", "season", "event", "entity"), shares, given, ["grp", "season", "event"], "entity", "prio").select("game", r4("blend"))


SQL_FORM = f"""WITH {_SHARES}, b AS (SELECT *, avg(qty) OVER w AS base, count(qty) OVER w AS n FROM g
  WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND INTERVAL 120 DAY FOLLOWING)),
rt AS (SELECT grp, season, day, entity, CASE WHEN base > 0 THEN qty / base ELSE 1 END AS ratio FROM b WHERE n >= 3 AND lines >= 2),
ev AS (SELECT grp, season, day, sh.prio, sum(weight * ratio) AS wx, sum(weight) AS w FROM rt JOIN sh USING (entity) GROUP BY ALL),
sp AS (SELECT grp, season, day, row_number() OVER (PARTITION BY grp, season ORDER BY day) AS seq FROM (SELECT DISTINCT grp, season, day FROM g)),
gv AS (SELECT a.grp, a.season, a.day, ev.prio, sum(wx) / nullif(sum(w), 0) AS given FROM sp a JOIN sp b ON a.grp = b.grp AND a.season = b.season AND b.seq BETWEEN a.seq - 10 AND a.seq - 1
  JOIN ev ON ev.grp = b.grp AND ev.season = b.season AND ev.day = b.day GROUP BY ALL),
bl AS (SELECT g.game, sum(weight * given) / nullif(sum(weight), 0) AS blend FROM g JOIN sh USING (entity) JOIN gv ON gv.grp = g.grp AND gv.season = g.season AND gv.day = g.day AND gv.prio = sh.prio GROUP BY 1)
SELECT g.game, round(blend, 4) AS blend FROM g LEFT JOIN bl USING (game)"""


def play_distribution(spark, sf_dir):
    """Shares of each nation's customers and priorities in its quantity of the last ten days with orders, within 60 days."""
    g = games(spark, sf_dir).where("qty is not null").withColumn("event", F.datediff("day", F.lit("1970-01-01")))
    shares = matchups.position_shares(g, "entity", "prio", "lines")
    out = matchups.play_distribution(g, shares, "grp", "event", "day", "entity", "prio", "qty")
    return out.select("grp", "entity", "prio", r4("value"), F.round("share", 6).alias("share"))


SQL_PLAYS = f"""WITH {_SHARES}, d AS (SELECT grp, day FROM (SELECT *, max(day) OVER (PARTITION BY grp) AS newest, row_number() OVER (PARTITION BY grp ORDER BY day DESC) AS k FROM (SELECT DISTINCT grp, day FROM g)) WHERE k <= 10 AND date_diff('day', day, newest) < 60),
n AS (SELECT grp, count(*) AS n FROM d GROUP BY 1), s AS (SELECT grp, entity, sum(qty) AS q FROM g JOIN d USING (grp, day) GROUP BY ALL), v AS (SELECT grp, entity, sh.prio, weight * q / n AS value FROM s JOIN n USING (grp) JOIN sh USING (entity))
SELECT grp, entity, prio, round(value, 4) AS value, round(value / nullif(sum(value) OVER (PARTITION BY grp), 0), 6) AS share FROM v"""


def upsample_recent(spark, sf_dir):
    """Each customer's last seven orders once more, and those of its greatest fifth of quantities once more."""
    out = ml.upsample_samples(games(spark, sf_dir), ["entity"], ORDER, "qty")
    return out.groupBy("game").agg(F.max("copy").cast("bigint").alias("copies"))


SQL_RECENT = f"""WITH {GAMES}, r AS (SELECT game, entity, row_number() OVER (PARTITION BY entity ORDER BY day DESC, game DESC) <= 7 AS last_, CASE WHEN qty IS NOT NULL THEN dense_rank() OVER (PARTITION BY entity ORDER BY abs(qty) DESC NULLS LAST) END AS level FROM games)
SELECT game, CAST(1 + last_::INT + coalesce(level <= greatest(1, floor(max(level) OVER (PARTITION BY entity) * 0.2::DOUBLE)), false)::INT AS BIGINT) AS copies FROM r"""


def mean_error_windows(spark, sf_dir):
    """Error of taking the mean of the last 3, 5 and 10 orders of a customer for the next, in classes."""
    out = features.mean_regression_error(games(spark, sf_dir), ["entity"], ORDER, "qty", [3, 5, 10])
    return out.select("size", "n", r4("error"))


_CLASS = lambda x: "(" + " + ".join(f"CASE WHEN least(3, greatest(-3, {x})) >= {-3 + 6 * k / 8} THEN 1 ELSE 0 END" for k in range(9)) + ")"
SQL_WINDOWS = f"""WITH {GAMES}, t AS (""" + " UNION ALL ".join(f"SELECT {n} AS size, qty AS target, avg(qty) OVER (PARTITION BY entity ORDER BY day, game ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS mean FROM games" for n in (3, 5, 10)) + f"""),
u AS (SELECT * FROM t WHERE target IS NOT NULL AND mean IS NOT NULL), s AS (SELECT size, round(avg(target), 6) AS m, round(stddev_pop(target), 6) AS s FROM u GROUP BY 1)
SELECT size, count(*) AS n, round(avg(abs({_CLASS('(target - m) / s')} - {_CLASS('(mean - m) / s')})) / 9, 4) AS error FROM u JOIN s USING (size) GROUP BY 1"""


def save_or_update(spark, sf_dir):
    """Customers of even keys as they are, then those of keys divisible by three: new ones are inserted, of the others the balance alone is updated."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("balance"))
    new = c.where("k % 3 = 0").select("k", F.lit("NEW").alias("seg"), (-F.col("balance")).alias("balance"))
    return merge.save_or_update(c.where("k % 2 = 0"), new, ["k"], ["balance"])


SQL_SAVE = "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS seg, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"


def clean_nested(spark, sf_dir):
    """Orders with their stats in a struct, an array and a map, cleaned at every depth."""
    g = games(spark, sf_dir)
    ratio = F.when(F.col("lines") > 2, F.col("qty") / 3).otherwise(F.lit(float("nan")))
    nested = g.select("game", F.struct(F.struct(ratio.alias("x")).alias("a"), F.array(ratio, F.col("price")).alias("b")).alias("s"), F.create_map(F.lit("t"), F.when(F.col("game") % 2 == 0, "NaN").otherwise("ok")).alias("m"))
    return serve.cleaned(nested).select("game", F.col("s.a.x").alias("x"), F.get("s.b", F.lit(1)).alias("y"), F.col("m")["t"].alias("t"))


SQL_CLEAN = f"WITH {GAMES} SELECT game, CASE WHEN lines > 2 THEN {half_sql('qty / 3', 2)} END AS x, {half_sql('price', 2)} AS y, CASE WHEN game % 2 = 1 THEN 'ok' END AS t FROM games"


def scale_range(spark, sf_dir):
    """Quantity and price scaled to -1..1."""
    out = ml.preprocess(games(spark, sf_dir).select("game", "qty", "price"), ["qty", "price"], span=(-1.0, 1.0))
    return out.select("game", *[(F.round(f"{c}_01", 4) + F.lit(0.0)).alias(c) for c in ("qty", "price")])


SQL_RANGE = f"WITH {GAMES}, i AS (SELECT game, coalesce(qty, avg(qty) OVER ()) AS qty, coalesce(price, avg(price) OVER ()) AS price FROM games) SELECT game, " + ", ".join(
    f"round(-1 + 2 * (({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())), 4) + 0.0 AS {c}" for c in ("qty", "price")
) + " FROM i"

PLAYER_FRAMES = {"PlayerStats": {"QTY": "q", "LINES": "n"}, "PlayerTrack": {"DIST": "d"}, "Usage": {"USG": "u"}, "Scoring": {"PTS": "p"}, "FourFactors": {"EFG": "e"}, "Misc": {"TOV": "t"}}
_SUMS = {"q": "sum(l_quantity)", "n": "count(*)", "d": "sum(l_linenumber)", "u": "max(l_quantity)", "p": "sum(l_quantity) * 2", "e": "min(l_quantity)", "t": "sum(l_linenumber) + 1"}


def frames_assembly(spark, sf_dir):
    """Six frames of players and two of teams of each order as one JSON document, read back, checked and put side by side."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), (F.col("l_suppkey") % 2).alias("team"), "l_quantity", "l_linenumber").repartition("game")
    sums = [F.expr(e).cast("double").alias(k) for k, e in _SUMS.items()]
    players, teams = li.groupBy("game", "player", "team").agg(*sums), li.groupBy("game", "team").agg(*sums)
    cells = lambda *c: F.array(*[F.col(x).cast("string") for x in c])
    one = lambda name, heads, rows: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, heads)).alias("headers"), F.collect_list(rows).alias("rowSet"))
    # tracking lacks its column in every seventh order, which then goes whole
    heads = {name: ["PLAYER_ID", "TEAM_ID", *own] for name, own in PLAYER_FRAMES.items()}
    sets = [one(name, heads[name], cells("player", "team", *own.values())).alias(name) for name, own in PLAYER_FRAMES.items() if name != "PlayerTrack"]
    track = one("PlayerTrack", ["PLAYER_ID", "TEAM_ID", "DIST"], cells("player", "team", "d"))
    without = one("PlayerTrack", ["PLAYER_ID", "TEAM_ID", "OTHER"], cells("player", "team", "d"))
    sets.append(F.when(F.col("game") % 7 == 0, without).otherwise(track).alias("PlayerTrack"))
    theirs = [one("TeamStats", ["TEAM_ID", "TEAM_QTY"], cells("team", "q")).alias("TeamStats"), one("TeamTrack", ["TEAM_ID", "TEAM_DIST"], cells("team", "d")).alias("TeamTrack")]
    docs = players.groupBy("game").agg(*sets).join(teams.groupBy("game").agg(*theirs), "game")
    docs = docs.select("game", F.to_json(F.struct(F.array(*PLAYER_FRAMES, "TeamStats", "TeamTrack").alias("resultSets"))).alias("doc"))
    keys = {"PLAYER_ID": "bigint", "TEAM_ID": "bigint"}
    mine = {name: keys | {h: "double" for h in own} for name, own in PLAYER_FRAMES.items()}
    both = {"TeamStats": {"TEAM_ID": "bigint", "TEAM_QTY": "double"}, "TeamTrack": {"TEAM_ID": "bigint", "TEAM_DIST": "double"}}
    rows = resultset.result_rows(docs, "doc", ["game"])
    whole = assembly.assembled_whole(rows, "game", mine, both, {"PlayerTrack": ["DIST"]})
    return whole.select("game", F.col("PLAYER_ID").alias("player"), F.col("TEAM_ID").alias("team"), *[F.col(h).alias(h.lower()) for o in PLAYER_FRAMES.values() for h in o], F.col("TEAM_QTY").alias("team_qty"), F.col("TEAM_DIST").alias("team_dist"))


SQL_FRAMES = f"""WITH li AS (SELECT *, l_orderkey AS game, l_suppkey AS player, l_suppkey % 2 AS team FROM lineitem WHERE l_orderkey % 7 <> 0),
p AS (SELECT game, player, team, {", ".join(f"({e})::DOUBLE AS {h.lower()}" for o in PLAYER_FRAMES.values() for h, k in o.items() for e in [_SUMS[k]])} FROM li GROUP BY ALL),
t AS (SELECT game, team, sum(l_quantity) AS team_qty, sum(l_linenumber)::DOUBLE AS team_dist, count(*) OVER (PARTITION BY game) AS two FROM li GROUP BY game, team)
SELECT p.*, team_qty, team_dist FROM p JOIN t USING (game, team) WHERE two = 2"""

_TYPO = """CASE WHEN c_custkey % 3 = 0 THEN {left}(m, 2) || '-' || {right}(m, 4, 3) WHEN c_custkey % 3 = 1 THEN {left}(m, 2) || {right}(m, 4, 3) ELSE m END"""


def people_match(spark, sf_dir):
    """Suppliers and customers as people of two lists, with short names of which some differ by a letter, and birthdays of which some are unknown or swapped."""
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.upper(F.left(F.md5(F.col("s_suppkey").cast("string")), F.lit(6))).alias("name"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("1900-01-01").cast("date")).otherwise(F.date_add(F.lit("1990-01-01"), (F.col("s_suppkey") * 37 % 3000).cast("int"))).alias("day"))
    b = table(spark, sf_dir, "customer").withColumn("m", F.left(F.md5((F.col("c_custkey") % 997 + 1).cast("string")), F.lit(6)))
    b = b.select("c_custkey", F.expr(_TYPO.format(left="left", right="substring")).alias("name"), F.date_add(F.lit("1990-01-01"), ((F.col("c_custkey") % 997 + 1) * 37 % 3000 + F.col("c_custkey") % 4 * 100).cast("int")).alias("day"))
    return people.matched_people(a, b, "s_suppkey", "name", "day", "c_custkey", "name", "day")


SQL_PEOPLE = f"""WITH a AS (SELECT s_suppkey, left(md5(s_suppkey::VARCHAR), 6) AS name, CASE WHEN s_suppkey % 5 = 0 THEN DATE '1900-01-01' ELSE CAST(DATE '1990-01-01' + CAST(s_suppkey * 37 % 3000 AS INT) AS DATE) END AS x FROM supplier),
m AS (SELECT c_custkey, left(md5((c_custkey % 997 + 1)::VARCHAR), 6) AS m FROM customer),
b AS (SELECT c_custkey, {_TYPO.format(left="left", right="substring")} AS name, CAST(DATE '1990-01-01' + CAST((c_custkey % 997 + 1) * 37 % 3000 + c_custkey % 4 * 100 AS INT) AS DATE) AS y FROM m),
p AS (SELECT *, levenshtein(a.name, b.name) AS distance, count(*) OVER (PARTITION BY s_suppkey) AS n FROM a JOIN b ON levenshtein(a.name, b.name) <= 1),
h AS (SELECT *, CASE WHEN x = DATE '1900-01-01' AND n = 1 THEN 'only' WHEN abs(date_diff('day', x, y)) <= 120 OR (day(y) <= 12 AND year(x) = year(y) AND month(x) = day(y) AND day(x) = month(y)) OR (month(x) = month(y) AND day(x) = day(y)) THEN 'birthday' END AS how FROM p)
SELECT s_suppkey, c_custkey, CAST(distance AS INT) AS distance, how FROM h WHERE how IS NOT NULL"""

PLANS = {
    "position_form": (position_form, SQL_FORM), "play_distribution": (play_distribution, SQL_PLAYS), "upsample_recent": (upsample_recent, SQL_RECENT), "mean_error_windows": (mean_error_windows, SQL_WINDOWS),
    "save_or_update": (save_or_update, SQL_SAVE), "clean_nested": (clean_nested, SQL_CLEAN), "scale_range": (scale_range, SQL_RANGE), "frames_assembly": (frames_assembly, SQL_FRAMES), "people_match": (people_match, SQL_PEOPLE),
}
