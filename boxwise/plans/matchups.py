"""Queries of form against opponents, positions, aliases and selection, with their SQL.

A customer's order is a game against one of seven opponents (order key modulo
7), at home if its key is even; its quantity is what the customer scored and 20
for each line what the opponent did.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwise.functions import scalars
from boxwise.operators import joins, matchups, merge, ml, possessions, ranges, roster, windows
from boxwise.plans.base import GAMES, WINDOW, games, half_sql, half_up, r4, shown
from boxwise.plans.models import PLAYERS, ROSTERS, _players
from boxwise.plans.profiles import ORDER, PRIORITIES
from boxwise.sources import resultset
from boxwise.sources.tables import table


def meetings(spark, sf_dir):
    g = games(spark, sf_dir)
    return g.withColumns({"opp": (F.col("game") % 7).cast("int"), "home": F.col("game") % 2 == 0, "opp_qty": (F.col("lines") * 20).cast("double")})


MEETINGS = f"{GAMES}, mt AS (SELECT *, CAST(game % 7 AS INT) AS opp, game % 2 = 0 AS home, CAST(lines * 20 AS DOUBLE) AS opp_qty FROM games)"


def spine_window(spark, sf_dir):
    """An entity's rows among its nation's last ten days of the season with orders."""
    g = games(spark, sf_dir).withColumn("event", F.datediff("day", F.lit("1970-01-01")))
    spine = windows.spine(g, "grp", "season", "event", "day")
    out = matchups.own_on_spine(g, spine, "grp", "season", "event", "entity", "qty", WINDOW)
    return out.select("game", "entity", "n", r4("mean"), r4("var"))


SQL_SPINE = f"""WITH {GAMES}, sp AS (SELECT grp, season, day, row_number() OVER (PARTITION BY grp, season ORDER BY day) AS seq FROM (SELECT DISTINCT grp, season, day FROM games)),
r AS (SELECT * FROM games JOIN sp USING (grp, season, day))
SELECT game, entity, count(*) OVER w AS n, round(avg(qty) OVER w, 4) AS mean, round(CASE WHEN count(*) OVER w > 1 THEN var_pop(qty) OVER w END, 4) AS var FROM r
WINDOW w AS (PARTITION BY entity, grp, season ORDER BY seq RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


def opponent_splits(spark, sf_dir):
    out = matchups.place_splits(meetings(spark, sf_dir).withColumn("at_home", F.col("home")), ["entity"], ORDER, "qty", "at_home", "opp")
    return out.select("game", "entity", r4("home"), r4("road"), r4("versus"))


SQL_PLACES = f"""WITH {MEETINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day, game) AS k FROM mt),
a AS (SELECT *, avg(qty) OVER w AS av, avg(CASE WHEN home THEN qty END) OVER w AS h, avg(CASE WHEN NOT home THEN qty END) OVER w AS r,
  avg(qty) OVER (PARTITION BY entity, opp ORDER BY k RANGE BETWEEN 200 PRECEDING AND 1 PRECEDING) AS v FROM n WINDOW w AS (PARTITION BY entity ORDER BY k RANGE BETWEEN 200 PRECEDING AND 1 PRECEDING))
SELECT game, entity, round(coalesce(h, av) - av, 4) AS home, round(coalesce(r, av) - av, 4) AS road, round(coalesce(v, av) - av, 4) AS versus FROM a"""

FORM = ("season", "last", "last_var", "matchup", "trend", "matchup_trend")


def team_running(spark, sf_dir):
    """Own and opponents' form: season, last ten within 400 days, the last meeting with the same opponent, and the trends."""
    out = matchups.running_form(meetings(spark, sf_dir), ["entity"], "season", "opp", ORDER, ["qty", "opp_qty"], 10, 400)
    return out.select("game", *[half_up(F.col(f"{x}_{k}")).alias(f"{x}_{k}") for x in ("qty", "opp_qty") for k in FORM])


def _form_sql(x: str) -> str:
    s = f"avg({x}) OVER s"
    values = f"list_filter(coalesce(list(CASE WHEN {x} IS NOT NULL THEN {{'d': day, 'x': {x}}} END) OVER w, []), lambda r: r.d >= day - 400)"
    mean = f"(list_sum(list_transform({values}, lambda r: r.x)) / nullif(len({values}), 0))"
    return f"{s} AS {x}_season, {values} AS {x}_values, {mean} AS {x}_last, lag({x}) OVER (PARTITION BY entity, opp ORDER BY day, game) AS {x}_matchup"


def _form_shown(x: str) -> str:
    var = f"list_sum(list_transform({x}_values, lambda r: (r.x - {x}_last) * (r.x - {x}_last))) / nullif(len({x}_values), 0)"
    shown_ = {"season": f"{x}_season", "last": f"{x}_last", "last_var": var, "matchup": f"{x}_matchup", "trend": f"{x}_season - {x}_last", "matchup_trend": f"{x}_season - {x}_matchup"}
    return ", ".join(f"{half_sql(v)} AS {x}_{k}" for k, v in shown_.items())


SQL_FORM = f"""WITH {MEETINGS}, f AS (SELECT *, {_form_sql('qty')}, {_form_sql('opp_qty')} FROM mt
  WINDOW s AS (PARTITION BY entity, season ORDER BY day, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY entity, season ORDER BY day, game ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT game, {_form_shown('qty')}, {_form_shown('opp_qty')} FROM f"""


def _sides(spark, sf_dir):
    """Two sides of an order, odd and even suppliers, with whole numbers in place of ratings."""
    li = table(spark, sf_dir, "lineitem")
    two = li.groupBy(F.col("l_orderkey").alias("game"), (F.col("l_suppkey") % 2).alias("side")).agg(
        F.sum("l_quantity").alias("T"), F.sum(F.col("l_linenumber").cast("double")).alias("ORtg"), F.sum(F.round(F.col("l_discount") * 100)).alias("ORB_pct")
    )
    return two


def team_reflection(spark, sf_dir):
    out = matchups.reflection_ratings(_sides(spark, sf_dir), ["game"])
    return out.select("game", "side", *[F.col(c).alias(c.lower()) for c in ("opp_T", "DRB_pct", "DRtg", "NetRtg", "T_net")])


SQL_TEAM_REFLECTION = """WITH s AS (SELECT l_orderkey AS game, l_suppkey % 2 AS side, sum(l_quantity) AS t, CAST(sum(l_linenumber) AS DOUBLE) AS o, sum(round(l_discount * 100)) AS b FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(t) OVER (PARTITION BY game) - t AS ot, sum(o) OVER (PARTITION BY game) - o AS oo, sum(b) OVER (PARTITION BY game) - b AS ob FROM s)
SELECT game, side, ot AS opp_t, 100 - ob AS drb_pct, oo AS drtg, o - oo AS netrtg, t - ot AS t_net FROM r"""


def shooting_ratios(spark, sf_dir):
    g = games(spark, sf_dir)
    made, free = matchups.shooting_ratios(F.col("price"), F.col("lines") - 1, F.col("total"), F.col("qty"))
    return g.select("game", half_up(made).alias("pts_fga"), half_up(free).alias("fta_fga"))


SQL_SHOOTING = f"WITH {GAMES} SELECT game, CASE WHEN qty > 0 THEN {half_sql('price / nullif(lines - 1, 0)')} END AS pts_fga, CASE WHEN qty > 0 THEN {half_sql('total / nullif(lines - 1, 0)')} END AS fta_fga FROM games"


def position_blend(spark, sf_dir):
    """What a nation gives each position (an order's priority), each customer by its shares of positions, and the blend for each customer."""
    g = games(spark, sf_dir).where("qty is not null")
    usual = g.groupBy("entity").agg(F.avg("qty").alias("usual"))
    rated = g.join(usual, "entity").withColumn("ratio", scalars.ratio_to_baseline(F.col("qty"), F.col("usual")))
    shares = matchups.position_shares(g, "entity", "prio", "lines")
    given = matchups.weighted_by_position(rated, shares, ["grp"], "entity", "prio", "ratio")
    people = g.select("grp", "entity").distinct()
    return matchups.blended(people, shares, given, ["grp"], "entity", "prio").select("grp", "entity", r4("blend"))


def position_given(spark, sf_dir):
    g = games(spark, sf_dir).where("qty is not null")
    shares = matchups.position_shares(g, "entity", "prio", "lines")
    return matchups.weighted_by_position(g, shares, ["grp"], "entity", "prio", "qty").select("grp", "prio", r4("given"), r4("weight"))


_SHARES = f"""{GAMES}, g AS (SELECT * FROM games WHERE qty IS NOT NULL), e AS (SELECT entity, prio, sum(lines) AS a FROM g GROUP BY ALL HAVING sum(lines) > 0),
sh AS (SELECT entity, prio, a / sum(a) OVER (PARTITION BY entity) AS weight FROM e)"""
SQL_GIVEN = f"WITH {_SHARES} SELECT grp, sh.prio, round(sum(weight * qty) / nullif(sum(weight), 0), 4) AS given, round(sum(weight), 4) AS weight FROM g JOIN sh USING (entity) GROUP BY grp, sh.prio"
SQL_BLEND = f"""WITH {_SHARES}, rt AS (SELECT *, CASE WHEN u > 0 THEN qty / u ELSE 1 END AS ratio FROM (SELECT *, avg(qty) OVER (PARTITION BY entity) AS u FROM g)),
gv AS (SELECT grp, sh.prio, sum(weight * ratio) / nullif(sum(weight), 0) AS given FROM rt JOIN sh USING (entity) GROUP BY grp, sh.prio)
SELECT p.grp, p.entity, round(sum(weight * given) / nullif(sum(weight), 0), 4) AS blend FROM (SELECT DISTINCT grp, entity FROM g) p LEFT JOIN sh USING (entity) LEFT JOIN gv ON gv.grp = p.grp AND gv.prio = sh.prio GROUP BY p.grp, p.entity"""


def position_mean(spark, sf_dir):
    """A customer's vectors by priority, averaged over the priorities it has, and the list of these."""
    g = games(spark, sf_dir)
    each = g.groupBy("entity", "prio").agg(F.sum("qty").alias("qty"), F.sum("lines").cast("double").alias("lines"))
    mean = matchups.mean_across(each, ["entity"], ["qty", "lines"])
    return mean.join(matchups.position_list(g, ["entity"], "prio"), "entity").select("entity", r4("qty"), r4("lines"), "positions")


SQL_POSITION_MEAN = f"""WITH {GAMES}, e AS (SELECT entity, prio, sum(qty) AS qty, CAST(sum(lines) AS DOUBLE) AS lines FROM games GROUP BY ALL)
SELECT entity, round(avg(qty), 4) AS qty, round(avg(lines), 4) AS lines, array_to_string(list_sort(list(prio)), '/') AS positions FROM e GROUP BY 1"""


def meta(spark, sf_dir):
    """Rest, place and home of every meeting; the home side of an odd order is its opponent."""
    m = meetings(spark, sf_dir).select("game", "day", F.col("entity").alias("team"), "opp", F.when(F.col("home"), F.col("entity")).otherwise(-F.col("opp").cast("bigint") - 1).alias("home"), F.col("grp"))
    other = matchups.opponent(F.col("team"), F.col("home"), F.when(F.col("home") == F.col("team"), -F.col("opp").cast("bigint") - 1).otherwise(F.col("team")))
    rest = windows.days_rest(m, ["team"], "day")
    cities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team"), F.col("c_mktsegment").alias("city"))
    out = matchups.meta(m.withColumn("against", other), rest, cities, "team", ["team", "day"])
    return out.select("game", "rest", "location", "is_home", "against")


SQL_META = f"""WITH {MEETINGS}, d AS (SELECT entity, day, CAST(least(10, coalesce(date_diff('day', lag(day) OVER (PARTITION BY entity ORDER BY day), day), 10)) AS INT) AS rest FROM (SELECT DISTINCT entity, day FROM games))
SELECT game, rest, CASE WHEN home THEN seg END AS location, home AS is_home, -CAST(opp AS BIGINT) - 1 AS against FROM mt JOIN d USING (entity, day)"""


def alias_join(spark, sf_dir):
    """Nations under two ids, as of teams that moved: customers of an odd key come with the old one."""
    teams = table(spark, sf_dir, "nation").select(F.col("n_name").alias("team"), F.array(F.col("n_nationkey"), F.col("n_nationkey") + 100).alias("all_ids"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + F.when(F.col("c_custkey") % 2 == 1, 100).otherwise(0)).alias("team_id"))
    return matchups.by_alias(rows, teams, "team_id", "all_ids", "team").select("c_custkey", "team_id", "team")


SQL_ALIAS = "SELECT c_custkey, CAST(c_nationkey + CASE WHEN c_custkey % 2 = 1 THEN 100 ELSE 0 END AS INT) AS team_id, n_name AS team FROM customer JOIN nation ON n_nationkey = c_nationkey"
CODES = {"AUTOMOBILE": "AUT", "BUILDING": "BLD", "FURNITURE": "FUR"}


def abbreviation_join(spark, sf_dir):
    """Segments by their abbreviations on one side, in full on the other."""
    known = table(spark, sf_dir, "customer").groupBy(matchups.translated(F.col("c_mktsegment"), CODES).alias("code")).agg(F.count(F.lit(1)).alias("players"))
    rows = meetings(spark, sf_dir).withColumn("code", matchups.translated(F.col("seg"), CODES)).groupBy("code", "opp").agg(F.count(F.lit(1)).alias("games"))
    return rows.join(known, "code").select("code", "opp", "games", "players")


SQL_ABBREVIATION = f"""WITH {MEETINGS}, a AS (SELECT c_mktsegment AS seg, count(*) AS players FROM customer GROUP BY 1)
SELECT CASE seg {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())} ELSE seg END AS code, opp, count(*) AS games, any_value(players) AS players FROM mt JOIN a USING (seg) GROUP BY seg, opp"""


def contest_players(spark, sf_dir):
    """Suppliers asked about an order that are on it, at home those with odd keys."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("pid"))
    ids = lambda odd: F.array_sort(F.collect_set(F.when(F.col("pid") % 2 == odd, F.col("pid"))))
    known = li.groupBy("game").agg(ids(1).alias("home_roster"), ids(0).alias("away_roster"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game"), (F.col("o_orderkey") % 10 + 1).alias("pid"))
    return matchups.contest_players(asked, known, "game", "pid", ("home_roster", "away_roster")).select("game", "pid", "side")


SQL_CONTEST = """SELECT DISTINCT o_orderkey AS game, o_orderkey % 10 + 1 AS pid, CASE WHEN (o_orderkey % 10 + 1) % 2 = 1 THEN 'home_roster' ELSE 'away_roster' END AS side
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = o_orderkey % 10 + 1"""


def stub_rows(spark, sf_dir):
    """Orders without items are yet to come: each supplier of the customer's nation has a row with null stats."""
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player")).agg(F.sum("l_quantity").alias("qty"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("grp"))
    coming = table(spark, sf_dir, "orders").join(people, "o_custkey").select(F.col("o_orderkey").alias("game"), "grp")
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player"), F.col("s_nationkey").alias("grp"))
    return matchups.stub_rows(coming, members, actual, "game", "grp").select("game", "player", "qty")


SQL_STUBS = """WITH a AS (SELECT l_orderkey AS game, l_suppkey AS player, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT o_orderkey, s_suppkey, NULL FROM orders JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_nationkey = c_nationkey WHERE o_orderkey NOT IN (SELECT game FROM a)"""


def box_assembly(spark, sf_dir):
    """Result sets of every order as JSON, read back: orders with exactly two team rows, and their players beside their teams."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player"), (F.col("l_suppkey") % 2).alias("team"), "l_quantity")
    text = lambda *c: F.array(*[F.col(x).cast("string") for x in c])
    made = lambda df, name, heads, *c: df.groupBy("game").agg(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, heads)).alias("headers"), F.collect_list(text(*c)).alias("rowSet")).alias(name))
    players = li.groupBy("game", "player", "team").agg(F.sum("l_quantity").alias("qty"))
    teams = li.groupBy("game", "team").agg(F.sum("l_quantity").alias("qty"))
    docs = made(players, "PlayerStats", ["PLAYER_ID", "TEAM_ID", "QTY"], "player", "team", "qty").join(made(teams, "TeamStats", ["TEAM_ID", "QTY"], "team", "qty"), "game")
    docs = docs.select("game", F.to_json(F.struct(F.array("PlayerStats", "TeamStats").alias("resultSets"))).alias("doc"))
    rows = resultset.result_rows(docs, "doc", ["game"])
    own = resultset.frame(rows, "PlayerStats", {"PLAYER_ID": "bigint", "TEAM_ID": "bigint", "QTY": "double"}, ["game"])
    theirs = resultset.frame(rows, "TeamStats", {"TEAM_ID": "bigint", "QTY": "double"}, ["game"]).withColumnRenamed("QTY", "TEAM_QTY")
    whole = joins.frame_merge([own, theirs], ["game", "TEAM_ID"]).join(resultset.valid_game(rows, "game"), "game", "left_semi")
    return whole.select("game", F.col("PLAYER_ID").alias("player"), F.col("TEAM_ID").alias("team"), F.col("QTY").alias("qty"), F.col("TEAM_QTY").alias("team_qty"))


SQL_ASSEMBLY = """WITH p AS (SELECT l_orderkey AS game, l_suppkey AS player, l_suppkey % 2 AS team, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL),
t AS (SELECT *, sum(qty) OVER (PARTITION BY game, team) AS team_qty, min(team) OVER (PARTITION BY game) <> max(team) OVER (PARTITION BY game) AS two FROM p)
SELECT game, player, team, qty, team_qty FROM t WHERE two"""


def roster_by_points(spark, sf_dir):
    """For each total of points the two cheapest rosters."""
    out = roster.best_by_points(_players(spark, sf_dir), {"g": 2, "f": 2, "c": 1}, 60, keep=2)
    return out.select(F.array_join("pids", ",").alias("pids"), F.col("points").cast("double").alias("points"), F.col("cost").cast("bigint").alias("cost"), F.col("place").cast("bigint").alias("place"))


SQL_BY_POINTS = f"""WITH {PLAYERS}, {ROSTERS.format(pool='al')}, k AS (SELECT *, row_number() OVER (PARTITION BY points ORDER BY cost, pids) AS place FROM ro WHERE points <= 60)
SELECT array_to_string(pids, ',') AS pids, points, cost, place FROM k WHERE place <= 2"""


SLOTS = {"g": 2, "f": 2, "c": 1}


def roster_swaps(spark, sf_dir):
    """Players that could stand for one of the best rosters' at two more of cost, with no fewer points."""
    people = _players(spark, sf_dir)
    best = roster.optimal_rosters(people, SLOTS, 40)
    return roster.substitutions(best, people, SLOTS, "cost", 2, not_less="points").select(F.array_join("pids", ",").alias("pids"), "slot", "pid", "other")


_BEST = f"WITH {PLAYERS}, {ROSTERS.format(pool='al')}, b AS (SELECT * FROM ro WHERE cost <= 40 ORDER BY points DESC, cost, pids LIMIT 5)"
SQL_SWAPS = f"""{_BEST}, u AS (SELECT pids, unnest(pids) AS pid, CAST(unnest(range(len(pids))) AS INT) AS slot FROM b)
SELECT array_to_string(pids, ',') AS pids, slot, u.pid, o.pid AS other FROM u JOIN al p ON p.pid = u.pid JOIN al o ON o.position = p.position AND o.cost = p.cost + 2 AND o.points >= p.points WHERE NOT list_contains(pids, o.pid)"""


def roster_fills(spark, sf_dir):
    """The best rosters without their guards and their last player: who fills a slot with 20 points, or has 20 more than the one who holds it."""
    people = _players(spark, sf_dir)
    best = roster.optimal_rosters(people, SLOTS, 40).withColumn("pids", F.transform("pids", lambda p, k: F.when((k == 2) | (k == 3), p)))
    return roster.substitutions(best, people, SLOTS, "points", 20, once=True).select(F.array_join("pids", ",", "-").alias("pids"), "slot", F.col("pid").cast("double").alias("pid"), "other")


SQL_FILLS = f"""{_BEST}, c AS (SELECT [NULL, NULL, pids[3], pids[4], NULL] AS pids, points, cost FROM b), u AS (SELECT pids, points, cost, unnest(pids) AS pid, CAST(unnest(range(len(pids))) AS INT) AS slot FROM c),
v AS (SELECT u.*, ['g', 'g', 'f', 'f', 'c'][slot + 1] AS position, coalesce(p.points, 0) + 20 AS wanted FROM u LEFT JOIN al p ON p.pid = u.pid)
SELECT array_to_string(list_transform(v.pids, lambda x: coalesce(x::VARCHAR, '-')), ',') AS pids, slot, CAST(v.pid AS DOUBLE) AS pid, o.pid AS other FROM v JOIN al o ON o.position = v.position AND o.points = wanted
WHERE NOT coalesce(list_contains(list_filter(v.pids, lambda x: x IS NOT NULL), o.pid), false) QUALIFY v.pid IS NOT NULL OR row_number() OVER (PARTITION BY v.pids, v.points, v.cost, o.pid, v.pid IS NULL ORDER BY slot) = 1"""


def roster_checks(spark, sf_dir):
    """An order's suppliers as a roster of teams (keys modulo 6): whether it is valid, and the first order of each set of suppliers."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(F.collect_list("l_suppkey").alias("pids"))
    keyed = li.select("game", roster.valid_roster(F.transform("pids", lambda p: p % 6), 9).alias("valid"), roster.roster_key(F.transform("pids", lambda p: F.concat(F.lit("S"), p.cast("string")))).alias("key"))
    return merge.first_wins(keyed, ["key"], ["game"])


_TEAMS = "list_transform(pids, lambda p: p % 6)"
SQL_CHECKS = f"""WITH g AS (SELECT l_orderkey AS game, list(l_suppkey) AS pids FROM lineitem GROUP BY 1), c AS (
  SELECT game, array_to_string(list_sort(list_transform(pids, lambda p: 's' || p)), '|') AS key,
    list_max(list_transform(list_distinct({_TEAMS}), lambda t: len(list_filter({_TEAMS}, lambda x: x = t)))) AS most, len(list_distinct({_TEAMS})) AS teams, len(pids) AS n FROM g)
SELECT game, (n < 9 OR teams >= 3) AND most <= 4 AS valid, key FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY game) = 1"""


def ndcg(spark, sf_dir):
    """How well prices order an order's items by quantity."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), "l_quantity", "l_extendedprice", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("tie"), "l_shipdate")
    once = merge.first_wins(li, ["game", "tie"], ["l_quantity", "l_extendedprice"])
    return ml.ndcg(once, ["game"], "l_quantity", "l_extendedprice", "tie").select("game", r4("ndcg"))


SQL_NDCG = """WITH o AS (SELECT l_orderkey AS game, l_quantity AS q, l_extendedprice AS p, l_partkey * 10 + l_linenumber AS tie FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey * 10 + l_linenumber ORDER BY l_quantity, l_extendedprice) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY p DESC, tie) AS a, row_number() OVER (PARTITION BY game ORDER BY q DESC, tie) AS b FROM o)
SELECT game, round(sum(CASE WHEN a = 1 THEN q ELSE q / log2(a) END) / nullif(sum(CASE WHEN b = 1 THEN q ELSE q / log2(b) END), 0), 4) AS ndcg FROM r GROUP BY 1"""


def upsample(spark, sf_dir):
    """Recent events and large ones once more each, counted by nation."""
    g = games(spark, sf_dir)
    out = ml.upsample(g, F.col("season") >= 1997, F.coalesce(F.col("qty") > 200, F.lit(False)))
    return out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


SQL_UPSAMPLE = f"WITH {GAMES}, u AS (SELECT grp, qty FROM games UNION ALL SELECT grp, qty FROM games WHERE season >= 1997 UNION ALL SELECT grp, qty FROM games WHERE qty > 200) SELECT grp, count(*) AS n, sum(qty) AS qty FROM u GROUP BY 1"


def text_codes(spark, sf_dir):
    """Positions, names of positions, game codes, weights of ranks, years and pounds from texts made of customers."""
    key = F.col("c_custkey")
    word = F.element_at(F.array(*map(F.lit, ("Guard", "Forward-Center", "center", "none"))), (key % 4 + 1).cast("int"))
    names = F.element_at(F.array(*map(F.lit, ("Point Guard and Shooting Guard", "Center", "Small Forward and Nobody"))), (key % 3 + 1).cast("int"))
    code, own = scalars.matchup_code(F.concat(F.lit("20240105/"), F.substring("c_mktsegment", 1, 3), F.lit("HOM")), F.substring("c_mktsegment", 1, 3))
    weights = scalars.rank_weights(F.sequence(F.lit(1).cast("bigint"), key % 3 + 1))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(scalars.positions(word), "").alias("positions"), F.array_join(scalars.position_names(names), ",").alias("names"), code.alias("code"), own.alias("own"),
        F.round(F.element_at(weights, 1), 6).alias("weight"), scalars.experience(F.when(key % 5 == 0, "Rookie").otherwise(F.concat((key % 20).cast("string"), F.lit(" years")))).alias("years"),
        scalars.pounds(F.concat((key % 300).cast("string"), F.lit(" lb"))).alias("pounds"), scalars.path_id(F.concat(F.lit("https://h.com/players/x/"), key.cast("string"), F.lit(".html?q=1"))).alias("id"),
    )


SQL_CODES = """SELECT c_custkey, ['G', 'FC', 'C', NULL][CAST(c_custkey % 4 + 1 AS INT)] AS positions, ['PG,SG', 'C', 'SF'][CAST(c_custkey % 3 + 1 AS INT)] AS names, substr(c_mktsegment, 1, 3) || '@HOM' AS code,
  '**' || substr(c_mktsegment, 1, 3) || '**@HOM' AS own, round([1.0, 1 / 1.25, 1 / (1 + 1 / 4.0 + 1 / 9.0)][CAST(c_custkey % 3 + 1 AS INT)], 6)::DOUBLE AS weight,
  CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 20 END AS INT) AS years, CAST(c_custkey % 300 AS INT) AS pounds, CAST(c_custkey AS VARCHAR) AS id FROM customer"""


def shot_keys(spark, sf_dir):
    """Events of a user under keys of period, minute and second, once each, counted by period."""
    ts = F.col("ts")
    keyed = table(spark, sf_dir, "events").withColumn("time", resultset.event_time(F.hour(ts), F.minute(ts), F.second(ts)))
    once = merge.first_wins(keyed, ["user_id", "time"], ["event_id"])
    return once.groupBy(F.split_part("time", F.lit("-"), F.lit(1)).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


SQL_SHOTS = """WITH k AS (SELECT user_id, event_id, hour(ts) || '-' || minute(ts) || ':' || second(ts) AS time FROM events QUALIFY row_number() OVER (PARTITION BY user_id, time ORDER BY event_id) = 1)
SELECT split_part(time, '-', 1) AS period, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM k GROUP BY 1"""


def guarded_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.delete(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), gone, ["c_custkey"])


SQL_DELETE = "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


def ranges_as_of(spark, sf_dir):
    """Ranges of quantity by segment as each season left them, as of a day."""
    g = games(spark, sf_dir).select("seg", "qty", "season").where("qty is not null")
    each = g.groupBy("seg", scalars.season_start(F.make_date(F.col("season") + 1, F.lit(10), F.lit(1))).alias("as_of")).agg(F.min("qty").alias("lower"), F.max("qty").alias("upper"))
    return ranges.ranges_as_of(each, "1996-06-01", ["seg"])


SQL_AS_OF = f"""WITH {GAMES}, e AS (SELECT seg, season + 1 AS y, min(qty) AS lower, max(qty) AS upper FROM games WHERE qty IS NOT NULL GROUP BY ALL)
SELECT seg, lower, upper FROM e WHERE make_date(y, 10, 1) <= DATE '1996-06-01' QUALIFY row_number() OVER (PARTITION BY seg ORDER BY y DESC) = 1"""


def playing_days(spark, sf_dir):
    """The days of a span but for July to September, and how many events each has."""
    days = matchups.playing_days("1996-05-15", "1996-11-15", spark)
    n = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


SQL_DAYS = """WITH d AS (SELECT CAST(unnest(generate_series(DATE '1996-05-15', DATE '1996-11-15', INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (day) WHERE month(day) NOT IN (7, 8, 9)"""


def numeric_frame(spark, sf_dir):
    return matchups.numeric_columns(table(spark, sf_dir, "customer"))


SQL_NUMERIC = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"


def per_100(spark, sf_dir):
    """Stats for each 100 possessions, with sums of order items as possessions."""
    g = games(spark, sf_dir).select("game", F.col("qty").alias("PTS"), F.col("price").alias("AST"), F.col("lines").alias("TotPoss"))
    return possessions.per_100(g, ["PTS", "AST"]).select("game", half_up(F.col("PTS_per100poss")).alias("pts"), half_up(F.col("AST_per100poss")).alias("ast"))


SQL_PER_100 = f"WITH {GAMES} SELECT game, {half_sql('qty * 100 / lines')} AS pts, {half_sql('price * 100 / lines')} AS ast FROM games"

def zone_games(spark, sf_dir):
    """Days of users (games) beside their charts by type: attempts are 0 where there are none, shares stay null."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    days = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    kinds = ["error", "purchase"]
    chart = events.where(F.col("event_type").isin(*kinds)).groupBy("user_id", "day").pivot("event_type", kinds).agg(F.count(F.lit(1)).alias("att"), F.count_if(F.col("value") > 100).alias("made"))
    both = days.join(chart, ["user_id", "day"], "left")
    att = lambda k: F.coalesce(f"{k}_att", F.lit(0)).alias(f"{k}_att")
    return both.select("user_id", "day", "n", *[c for k in kinds for c in (att(k), F.round(F.try_divide(f"{k}_made", f"{k}_att"), 4).alias(f"{k}_pct"))])


SQL_ZONE_GAMES = "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (event_type = '{k}') AS {k}_att, round(count(*) FILTER (event_type = '{k}' AND value > 100) / nullif(count(*) FILTER (event_type = '{k}'), 0), 4) AS {k}_pct" for k in ("error", "purchase")
) + " FROM events GROUP BY ALL"


def repeated_projections(spark, sf_dir):
    """A segment's runs of a season, averaged: mean of means, variance of their mean, mean of trends."""
    g = games(spark, sf_dir).where("qty is not null").groupBy("seg", "season", "grp").agg(F.avg("qty").alias("mean"), F.var_pop("qty").alias("var"), (F.max("qty") - F.min("qty")).alias("trend"))
    out = g.groupBy("seg", "season").agg(F.avg("mean").alias("mean"), (F.sum("var") / F.pow(F.count("var"), F.lit(2))).alias("var"), F.avg("trend").alias("trend"), F.count(F.lit(1)).alias("runs"))
    return out.select("seg", "season", r4("mean"), r4("var"), r4("trend"), "runs")


SQL_REPEATED = f"""WITH {GAMES}, p AS (SELECT seg, season, grp, avg(qty) AS mean, var_pop(qty) AS var, max(qty) - min(qty) AS trend FROM games WHERE qty IS NOT NULL GROUP BY ALL)
SELECT seg, season, round(avg(mean), 4) AS mean, round(sum(var) / pow(count(var), 2), 4) AS var, round(avg(trend), 4) AS trend, count(*) AS runs FROM p GROUP BY ALL"""


def null_filling_union(spark, sf_dir):
    """Customers and suppliers one after another; columns that a side lacks are null."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    others = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return people.unionByName(others, allowMissingColumns=True)


SQL_UNION = "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier"


def exact_sets(spark, sf_dir):
    """Orders with just the same suppliers as another order, in any order."""
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))
    same = sides.groupBy("suppliers").agg(F.count(F.lit(1)).alias("orders"), F.min("l_orderkey").alias("first")).where("orders > 1")
    return same.select(F.array_join("suppliers", ",").alias("suppliers"), "orders", "first")


SQL_EXACT_SETS = """WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS x FROM lineitem GROUP BY 1)
SELECT array_to_string(x, ',') AS suppliers, count(*) AS orders, min(l_orderkey) AS first FROM s GROUP BY x HAVING count(*) > 1"""

PLANS = {
    "zone_games": shown(zone_games, SQL_ZONE_GAMES, ("day",)), "repeated_projections": (repeated_projections, SQL_REPEATED), "null_filling_union": (null_filling_union, SQL_UNION), "exact_sets": (exact_sets, SQL_EXACT_SETS),
    "spine_window": (spine_window, SQL_SPINE), "opponent_splits": (opponent_splits, SQL_PLACES), "team_running": (team_running, SQL_FORM), "team_reflection": (team_reflection, SQL_TEAM_REFLECTION),
    "shooting_ratios": (shooting_ratios, SQL_SHOOTING), "position_given": (position_given, SQL_GIVEN), "position_blend": (position_blend, SQL_BLEND), "position_mean": (position_mean, SQL_POSITION_MEAN),
    "meta": (meta, SQL_META), "alias_join": (alias_join, SQL_ALIAS), "abbreviation_join": (abbreviation_join, SQL_ABBREVIATION), "contest_players": (contest_players, SQL_CONTEST),
    "stub_rows": (stub_rows, SQL_STUBS), "box_assembly": (box_assembly, SQL_ASSEMBLY), "roster_by_points": (roster_by_points, SQL_BY_POINTS), "roster_swaps": (roster_swaps, SQL_SWAPS), "roster_fills": (roster_fills, SQL_FILLS),
    "roster_checks": (roster_checks, SQL_CHECKS), "ndcg": (ndcg, SQL_NDCG), "upsample": (upsample, SQL_UPSAMPLE), "text_codes": (text_codes, SQL_CODES), "shot_keys": (shot_keys, SQL_SHOTS),
    "guarded_delete": (guarded_delete, SQL_DELETE), "ranges_as_of": (ranges_as_of, SQL_AS_OF), "playing_days": shown(playing_days, SQL_DAYS, ("day",)), "numeric_frame": (numeric_frame, SQL_NUMERIC), "per_100": (per_100, SQL_PER_100),
}
