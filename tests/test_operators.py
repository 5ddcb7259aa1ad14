"""Operators on small frames whose results are computed by hand or by pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from boxwise.functions import scalars, stats
from boxwise.operators import features, joins, matchups, merge, ml, possessions, processes, ranges, roster, serve, vectors, windows


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def one(df):
    return df.first()[0]


def test_exponential_statistics_match_pandas(spark):
    values = [3.0, None, 5.0, 1.0, 4.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    rows = df.agg(F.sort_array(F.collect_list(F.struct("k", "x")))["x"].alias("a"), F.count(F.lit(1)).alias("n"))
    rows = rows.select(F.filter("a", lambda x: x.isNotNull()).alias("a"), "n")
    got = rows.select(stats.exponential_mean(F.col("a"), F.col("n")), stats.exponential_var(F.col("a"), F.col("n"))).first()
    want = pd.Series(values).ewm(span=5, adjust=True, ignore_na=True)
    assert got[0] == pytest.approx(want.mean().iloc[-1]) and got[1] == pytest.approx(want.var(bias=False).iloc[-1])


def test_closed_forms_agree_with_resampling(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 3, 60)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    closed = df.groupBy("k").agg(stats.bootstrap_mean(F.col("x")).alias("m"), stats.bootstrap_var(F.col("x")).alias("v")).first()
    drawn = one(stats.resampled(df, ["k"], "x", F.avg, samples=200).select("statistic"))
    varied = one(stats.resampled(df, ["k"], "x", F.var_samp, samples=200).select("statistic"))
    assert closed["m"] == pytest.approx(x.mean()) and drawn == pytest.approx(closed["m"], abs=0.2)
    assert varied == pytest.approx(closed["v"], rel=0.15)


def test_bootstrap_variance_of_one_row_is_null_and_nulls_keep_their_weight(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert one(df.agg(stats.bootstrap_var(F.col("x")))) is None
    two = spark.createDataFrame([(3.0,), (None,)], "x double")
    assert one(two.agg(stats.bayesian_mean(F.col("x")))) == 1.5


@pytest.mark.parametrize(("x", "m", "v", "z"), [(2.0, 2.0, 0.0, 0.0), (3.0, 2.0, 0.0, None), (4.0, 2.0, 4.0, 1.0), (None, 2.0, 1.0, None)])
def test_z_score(spark, x, m, v, z):
    df = spark.createDataFrame([(x, m, v)], "x double, m double, v double")
    assert one(df.select(stats.z_score(F.col("x"), F.col("m"), F.col("v")))) == z


def test_window_never_sees_its_own_row(spark):
    df = spark.createDataFrame([(1, day(k), k, float(k)) for k in range(13)], "entity int, day date, game int, x double")
    got = {r["game"]: r for r in vectors.own_window(df, ["entity"], ["day", "game"], "x", 10).collect()}
    assert got[0]["mean"] is None and got[1]["mean"] == 0.0 and got[12]["mean"] == np.mean(range(2, 12))


def test_last_events_count_the_groups_events_not_the_entitys(spark):
    spine = spark.createDataFrame([(1, 2020, g, day(g)) for g in range(5)], "grp int, season int, event int, day date")
    rows = spark.createDataFrame([(1, 2020, 0, 7, 10.0), (1, 2020, 3, 7, 20.0)], "grp int, season int, event int, entity int, x double")
    out = windows.last_events(windows.spine(spine, "grp", "season", "event", "day"), rows, "grp", "season", "event", "entity", 2)
    got = sorted((r["target"], r["event"]) for r in out.collect())
    assert got == [(1, 0), (2, 0), (4, 3)]


def test_days_rest_is_capped_and_starts_at_the_cap(spark):
    df = spark.createDataFrame([(1, day(0)), (1, day(2)), (1, day(30)), (1, day(2))], "k int, day date")
    assert sorted((r["day"], r["rest"]) for r in windows.days_rest(df, ["k"], "day").collect()) == [(day(0), 10), (day(2), 2), (day(30), 10)]


def test_back_to_back(spark):
    df = spark.createDataFrame([(1, day(k)) for k in (0, 1, 2, 4)], "k int, day date")
    got = {r["day"]: (r["b2b"], r["g2of3"], r["g3of4"], r["g4of5"]) for r in windows.back_to_back(df, ["k"], "day").collect()}
    assert got[day(0)] == (-1, -1, -1, -1) and got[day(1)] == (1, 1, -1, -1) and got[day(2)] == (1, 1, 1, -1) and got[day(4)] == (-1, 1, 1, 1)


def test_splits_are_zero_without_a_subset(spark):
    df = spark.createDataFrame([(1, day(k), k, "home", 5.0) for k in range(3)], "entity int, day date, game int, side string, x double")
    out = vectors.splits(df, ["entity"], ["day", "game"], "x", "side", ["home", "away"]).orderBy("game").collect()
    assert out[2]["split_0"] == 0.0 and out[2]["split_1"] == 0.0 and out[0]["split_1"] is None


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, 1, day(5)), (2, 1, day(0)), (3, 2, day(5))], "id int, k int, d date")
    right = spark.createDataFrame([(1, day(3), 10), (1, day(5), 11), (1, day(6), 12)], "k int, at date, v int")
    got = {r["id"]: r["v"] for r in joins.asof_latest(left, right, ["k"], "d", "at", "v", ["v"]).collect()}
    assert got == {1: 11, 2: None, 3: None}
    near = {r["id"]: (r["v"], r["distance"]) for r in joins.nearest_in_time(left, right, ["k"], "d", "at", "v").collect()}
    assert near == {1: (11, 0), 2: (10, 3)}


def test_frame_merge_keeps_the_first_of_clashing_columns(spark):
    a = spark.createDataFrame([(1, "a")], "g int, x string")
    b = spark.createDataFrame([(1, "b", 2)], "g int, x string, y int")
    assert joins.frame_merge([a, b], ["g"]).first().asDict() == {"g": 1, "x": "a", "y": 2}


def test_reflection(spark):
    df = spark.createDataFrame([(1, "h", 3), (1, "a", 5)], "g int, side string, x int")
    assert {r["side"]: r["opp_x"] for r in joins.reflection(df, ["g"], "side", ["x"]).collect()} == {"h": 5, "a": 3}


def test_ranges_and_colours(spark):
    df = spark.createDataFrame([(["G"], "s", 1.0), (["G", "F"], "s", 3.0), (["F"], "s", None)], "bins array<string>, stat_key string, value double")
    got = {r["bin"]: (r["lower"], r["upper"]) for r in ranges.stat_ranges(df).collect()}
    assert set(got) == {"G", "F", "ALL"} and got["G"][0] == 0.0 and got["F"] == (None, None)
    c = spark.createDataFrame([(0.0, 0.0, 2.0), (1.0, 0.0, 2.0), (9.0, 0.0, 2.0), (1.0, None, None)], "v double, lo double, hi double")
    shown = [r[0] for r in c.select(scalars.colour(F.col("v"), F.col("lo"), F.col("hi"))).collect()]
    assert shown == ["#ff0000", "#ffff00", "#00ff00", "transparent"]


def test_ranges_as_of_takes_the_latest_before(spark):
    df = spark.createDataFrame([(day(0), "G", "s", 1.0, 2.0), (day(5), "G", "s", 3.0, 4.0)], "as_of date, bin string, stat_key string, lower double, upper double")
    assert ranges.ranges_as_of(df, str(day(3)), ["bin", "stat_key"]).first()["lower"] == 1.0


def test_serve_round_trip(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double")
    assert serve.wide(serve.long(df, ["k"], ["a", "b"]), ["k"], ["a", "b"]).first().asDict() == {"k": 1, "a": 2.0, "b": 3.0}


def test_scalars(spark):
    df = spark.createDataFrame([("12:30", "7-3", "Won 4", "6-5", "$1,234", "J. Doe GTD", "+12.5%", "7:30 PM", "Point Guard and Center")], "m string, r string, s string, h string, p string, n string, c string, t string, pos string")
    c = F.col
    got = df.select(
        scalars.minutes(c("m")), scalars.win_rate(c("r")), scalars.streak(c("s")), scalars.inches(c("h")), scalars.money(c("p")), scalars.status(c("n"))[0],
        scalars.status(c("n"))[1], scalars.fraction(c("c")), scalars.clock(c("t")), scalars.position_names(c("pos")), scalars.positions(c("pos")), scalars.minutes(F.lit(None).cast("string")),
        scalars.win_rate(F.lit(None).cast("string")), scalars.clock(F.lit(None).cast("string")), scalars.positions(F.lit("")),
    ).first()
    assert list(got) == [12.5, 0.7, 4, 77, 1234.0, "J. Doe", "GTD", 0.125, 1170, ["PG", "C"], ["C", "G"], 0.0, 1.0, 1140, None]


def test_digitize_matches_numpy(spark):
    x = [-9.0, -3.0, -0.1, 0.0, 2.9, 3.0, 8.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in df.select(scalars.digitize(F.col("x"), 3.0, 10)).collect()]
    assert got == np.digitize(np.clip(x, -3, 3), np.linspace(-3, 3, 9)).tolist()


def test_rank_weights_sum_to_one(spark):
    got = one(spark.createDataFrame([(["a", "b", "c"],)], "p array<string>").select(scalars.rank_weights(F.col("p"))))
    assert sum(got) == pytest.approx(1) and got[0] / got[1] == pytest.approx(4)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k int, x string, y int")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", None)]
    assert sorted(r["x"] or "" for r in merge.insert_new(old, new, ["k"]).collect()) == ["a", "b", "c"]
    assert [r["k"] for r in merge.delete(old, new, ["k"]).collect()] == [1]
    with pytest.raises(ValueError):
        merge.delete(old, new, [])


def players(spark):
    rows = [(k, "gfc"[k % 3], float(k * 7 % 11 + 1), k * 5 % 7 + 2) for k in range(1, 16)]
    return rows, spark.createDataFrame(rows, "pid bigint, position string, points double, cost bigint")


def test_optimal_rosters_match_brute_force(spark):
    from itertools import combinations

    rows, df = players(spark)
    pools = {p: [r for r in rows if r[1] == p] for p in "gfc"}
    every = [a + b + c for a in combinations(pools["g"], 2) for b in combinations(pools["f"], 2) for c in combinations(pools["c"], 1)]
    fit = sorted(((-sum(r[2] for r in x), sum(r[3] for r in x), [r[0] for r in x]) for x in every if sum(r[3] for r in x) <= 22))[:5]
    got = [(-r["points"], r["cost"], r["pids"]) for r in roster.optimal_rosters(df, {"g": 2, "f": 2, "c": 1}, 22).collect()]
    assert got == fit
    combos = roster.roster_combinations(df, {"g": 2, "f": 2, "c": 1}, 20, 22)
    assert combos.count() == sum(20 <= sum(r[3] for r in x) <= 22 for x in every)


def test_valid_roster(spark):
    check = lambda teams, n: one(spark.createDataFrame([(teams,)], "t array<string>").select(roster.valid_roster(F.col("t"), n)))
    assert check(["a", "a", "b", "c"], 4) and not check(["a", "a", "b", "b"], 4) and not check(["a"] * 5, 9) and check(["a"], 9)


def test_matchup_rank_promotes_the_nearest_starter_alone(spark):
    rows = [(1, 10, 1.0, False, True), (1, 11, 2.0, True, True), (1, 12, 3.0, True, True)]
    df = spark.createDataFrame(rows, "base int, pid int, d double, starter boolean, starts boolean")
    got = [r["pid"] for r in features.matchup_rank(df, ["base"], "d", "starter", "starts", "pid").orderBy("rank").collect()]
    assert got == [11, 10, 12]


def test_distribution_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, x double")
    got = df.select("g", features.distribution(df, "g", "x").alias("s")).groupBy("g").agg(F.sum("s").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in got)


def test_interval_baseline_can_leave_out_the_future(spark):
    df = spark.createDataFrame([(1, day(k), float(k)) for k in range(5)], "k int, day date, x double")
    safe = features.earned_and_given(df, ["k"], "day", "x", 30, 3, leakage_safe=True).collect()
    assert [(r["x"], r["baseline"]) for r in sorted(safe, key=lambda r: r["x"])] == [(3.0, 1.0), (4.0, 1.5)]


def test_preprocess(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, 5.0), (None, None, 5.0)], "a double, b double, c double")
    got = ml.preprocess(df, ["a", "b", "c"], limit=1.0).toPandas()
    assert "b_z" not in got and got["a"].tolist() == [1, 3, 2] and got["a_01"].tolist() == [0, 1, 0.5]
    assert got["a_z"].tolist() == pytest.approx([-1, 1, 0]) and got["c_z"].tolist() == [0, 0, 0]


def test_ndcg_of_a_perfect_order_is_one(spark):
    df = spark.createDataFrame([(1, k, float(k), float(k)) for k in range(1, 5)], "k int, id int, gain double, score double")
    assert ml.ndcg(df, ["k"], "gain", "score", "id").first()["ndcg"] == pytest.approx(1)


def test_gaussian_process_follows_its_data(spark):
    rows = [("a", k, float(k), float(k * 2)) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, k bigint, x double, y double")
    got = ml.gaussian_process(df, "g", "k", ["x"], "y", noise=0.05).toPandas().sort_values("k")
    assert np.abs(got["mean"] - np.arange(20) * 2).max() < 4


def test_gaussian_process_answers_for_rows_outside_its_sample(spark):
    rows = [(g, k, float(k % 50), float(k % 50 * 2)) for g, n in (("a", 400), (None, 30), ("one", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k bigint, x double, y double").withColumn("_first", F.xxhash64("k"))
    got = ml.gaussian_process(df.drop("_first"), "g", "k", ["x"], "y", most=20, noise=0.05, block=100).toPandas()
    assert sorted((str(g), k) for g, k in zip(got["g"], got["k"], strict=True)) == sorted((str(r[0]), r[1]) for r in rows)
    known = df.where("g = 'a'").toPandas().sort_values(["_first", "k"]).head(20)
    x, y, asked = known["x"].to_numpy(), known["y"].to_numpy(), got[got["g"] == "a"]
    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) / x.std()) ** 2)
    inverse, k = np.linalg.inv(kernel(x, x) + 0.05 * np.eye(20)), kernel(asked["k"].to_numpy() % 50.0, x)
    assert np.allclose(asked["mean"], y.mean() + k @ inverse @ (y - y.mean()))
    assert np.allclose(asked["variance"], y.var() * (1 - np.einsum("ij,jk,ik->i", k, inverse, k)))


def test_possessions_are_null_not_infinite(spark):
    stat = {s: 0.0 for s in possessions.BOX} | {"MP": 10.0}
    box = spark.createDataFrame([{"g": 1, "team": t, "p": p, **stat} for t in (0, 1) for p in (0, 1)])
    got = possessions.possession_columns(possessions.with_totals(box, "g", "team")).toPandas()
    assert got["ORtg"].isna().all() and len(got) == 4


def test_totals_stay_where_the_box_is_dealt(spark):
    box = spark.createDataFrame([{"g": g, "team": t, "p": p, **{s: 1.0 + p for s in possessions.BOX}} for g in range(3) for t in (0, 1) for p in range(2)])
    plan = possessions.with_totals(box.repartition(3, "g"), "g", "team")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("Sort [") == 1


def test_totals_of_odd_teams_and_events(spark):
    stat = lambda x: dict.fromkeys(possessions.BOX, x)
    rows = [(1, "a", 1, 0.1), (1, "a", 2, 0.2), (1, "a", 2, 0.2), (1, "b", 3, 0.7), (1, None, 4, 5.0), (2, "a", 5, 0.3), (2, "a", 6, 0.6), (3, None, 7, 1.0), (None, "a", 8, 1.0), (1, "b", 9, 0.0), (4, "c", 10, 2.0)]
    schema = "p int, g int, " + ", ".join(f"{s} double" for s in possessions.BOX) + ", team string"
    box = spark.createDataFrame([(p, g, *stat(x).values(), t) for g, t, p, x in rows], schema).withColumn("PTS", F.when(F.col("p") != 3, F.col("PTS")))
    df = possessions.with_totals(box, "g", "team")
    assert df.columns == ["g", "team", "p", *possessions.BOX, *[f"t_{s}" for s in possessions.BOX], *[f"o_{s}" for s in possessions.BOX]]
    got = sorted((r["g"], r["team"], r["p"], round(r["t_FGM"], 9), round(r["o_FGM"], 9), r["t_PTS"] and round(r["t_PTS"], 9)) for r in df.collect())
    # the rows without a team count for the others; those without an event, or without minutes, do not; a null is no value
    assert got == [(1, "a", 1, 0.5, 5.7, 0.5), (1, "a", 2, 0.5, 5.7, 0.5), (1, "a", 2, 0.5, 5.7, 0.5), (1, "b", 3, 0.7, 5.5, None), (2, "a", 5, 0.9, 0.0, 0.9), (2, "a", 6, 0.9, 0.0, 0.9), (4, "c", 10, 2.0, 0.0, 2.0)]
    assert {r["o_FGM"] for r in df.where("g in (2, 4)").collect()} == {0.0}  # just 0, not what sums in another order leave


def test_effects_of_missing_partners(spark):
    players = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "one int, side string")
    missing = spark.createDataFrame([(2, "a"), (9, "a"), (9, "b")], "one int, side string")
    effects = spark.createDataFrame([(1, 2, 5.0), (1, 9, 7.0), (1, None, 4.0), (3, 9, 1.0)], "one int, two int, x double")
    got = {r["one"]: (r["pairs"], r["delta"]) for r in features.effect_deltas(players, missing, effects, ["side"], "one", "two", "x").collect()}
    assert got == {1: (2, 2.0), 2: (0, 0.0), 3: (1, 0.0)}


def test_inverse_variance_mix_prefers_the_surer_model(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 9.0), (1, None, 1.0)], "g int, mean double, var double")
    got = features.mixed_projection(df, ["g"]).first()
    assert got["mean"] == pytest.approx(11.0) and got["models"] == 2 and got["var"] == pytest.approx(0.9)


def test_nearest_keeps_repeated_left_rows(spark):
    left = spark.createDataFrame([(1, 1, day(5)), (1, 1, day(5)), (2, 1, None), (3, 1, day(4)), (4, 2, day(1))], "id int, k int, d date")
    right = spark.createDataFrame([(1, day(3), 11), (1, day(3), 10), (1, day(7), 9), (1, day(5), None), (2, None, 1)], "k int, at date, v int")
    got = joins.nearest_in_time(left.where("id <> 4"), right.where("v is not null"), ["k"], "d", "at", "v")
    # day 5 is two from 3 and from 7: the least tie is 9; day 4 is one from 3: 10
    assert sorted((r["id"], r["v"], r["distance"]) for r in got.collect()) == [(1, 9, 2), (1, 9, 2), (3, 10, 1)]
    assert joins.nearest_in_time(left.where("k = 2"), right, ["k"], "d", "at", "v").count() == 0


def test_resampling_of_repeated_rows(spark):
    x = [1.0] * 5 + [3.0] * 5
    df = spark.createDataFrame([("a", v) for v in x], "k string, x double")
    varied = one(stats.resampled(df, ["k"], "x", F.var_pop, samples=400).select("statistic"))
    assert varied == pytest.approx(0.9, abs=0.05)  # var_pop (n - 1) / n


def test_rosters_by_points_and_cost_match_every_roster(spark):
    import itertools
    import random

    rng = random.Random(9)
    people = [(k, "g" if k % 3 else "c", float(rng.randrange(1, 6)), rng.randrange(0, 5)) for k in range(30)]
    df = spark.createDataFrame(people, "pid bigint, position string, points double, cost bigint")
    g, c = ([p for p in people if p[1] == x] for x in "gc")
    every = [([a[0], b[0], d[0]], a[2] + b[2] + d[2], a[3] + b[3] + d[3]) for a, b in itertools.combinations(g, 2) for d in c]
    want = sorted((r for r in every if r[2] <= 7), key=lambda r: (-r[1], r[2], r[0]))[:4]
    got = roster.optimal_rosters(df, {"g": 2, "c": 1}, 7, keep=4)
    assert [(r["pids"], r["points"], r["cost"]) for r in got.orderBy(F.desc("points"), "cost", "pids").collect()] == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    cheap = {}
    for r in sorted(every, key=lambda r: (r[2], r[0])):
        cheap.setdefault(r[1], []).append(r)
    found = {}
    for r in roster.best_by_points(df, {"g": 2, "c": 1}, 12, keep=2).orderBy("place").collect():
        found.setdefault(float(r["points"]), []).append((r["pids"], float(r["points"]), int(r["cost"])))
    assert found == {k: v[:2] for k, v in cheap.items() if k <= 12}


def test_a_missed_event_shrinks_the_window(spark):
    from boxwise.operators import matchups, windows

    rows = [("t", 2000, e, "a", float(e)) for e in (1, 2, 4, 6)] + [("t", 2000, e, "b", 1.0) for e in range(1, 7)]
    df = spark.createDataFrame(rows, "team string, season int, event int, who string, x double")
    spine = windows.spine(df.withColumn("date", F.col("event")), "team", "season", "event", "date")
    got = {r["event"]: (r["n"], r["mean"]) for r in matchups.own_on_spine(df, spine, "team", "season", "event", "who", "x", 3).where("who = 'a'").collect()}
    assert got == {1: (0, None), 2: (1, 1.0), 4: (2, 1.5), 6: (1, 4.0)}


def test_models_are_saved_with_their_preprocessing(spark, tmp_path):
    df = spark.createDataFrame([(float(k), None if k % 7 == 0 else float(k % 5), 2.0 * k) for k in range(60)], "a double, b double, label double")
    model = ml.fitted_pipeline(df, ["a", "b"])
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.load_model(str(tmp_path / "m"))
    shown = lambda m: [r["prediction"] for r in m.transform(df).orderBy("a").collect()]
    assert shown(model) == shown(again) and shown(model)[30] == pytest.approx(60, abs=1)


def test_repeated_splits_differ_and_cover(spark):
    df = spark.range(300)
    seen = [[{r["id"] for r in part.collect()} for part in parts] for parts in ml.repeated_splits(df, "id", 2)]
    assert all(set().union(*parts) == set(range(300)) for parts in seen) and seen[0] != seen[1]


def test_gaussian_process_by_splits_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 3))
    y = x[:, 0] + np.sin(x[:, 1])
    df = spark.createDataFrame([("g", k, float(y[k]), *map(float, x[k])) for k in range(25)], "g string, k int, y double, a double, b double, c double")
    got = {r["k"]: (r["mean"], r["variance"]) for r in ml.gaussian_process(df, "g", "k", ["a", "b", "c"], "y", splits=[["a", "b"], ["c"]]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    far = lambda p: ((z[:, None, p] - z[None, :, p]) ** 2).sum(-1)
    k = (np.exp(-0.5 * far([0, 1]) / 2) + np.exp(-0.5 * far([2]))) / 2
    inverse = np.linalg.inv(k + 0.5 * np.eye(25))
    mean, variance = y.mean() + k @ inverse @ (y - y.mean()), y.var() * (1 - np.diag(k @ inverse @ k))
    assert [got[j][0] for j in range(25)] == pytest.approx(mean) and [got[j][1] for j in range(25)] == pytest.approx(variance)


def test_linear_fit_is_the_normal_equations(spark):
    """The grid's cell without a penalty, and classes by logistic regression, against numpy."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = 3 * x[:, 0] - x[:, 1] + 1 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(k, float(y[k]), *map(float, x[k])) for k in range(200)], "game int, label double, a double, b double")
    got = {(r["penalty"], r["mix"]): r["rmse"] for r in ml.grid(df, ["a", "b"]).collect()}
    design = np.c_[x, np.ones(200)]
    left = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert got[0.0, 0.0] == pytest.approx(np.sqrt((left**2).mean()), rel=0.05) and got[1.0, 0.0] > got[0.0, 0.0]
    train, _, test = ml.split(df, "game")
    a = train.toPandas()
    coefficients = np.linalg.lstsq(np.c_[a[["a", "b"]], np.ones(len(a))], a["label"], rcond=None)[0]
    b = test.toPandas()
    mse = ((b["label"] - np.c_[b[["a", "b"]], np.ones(len(b))] @ coefficients) ** 2).mean()
    shown = ml.evaluate_regressor(df, ["a", "b"], kind="linear").first()
    assert (shown["train"], shown["test"]) == (len(a), len(b)) and shown["mse"] == pytest.approx(mse, rel=0.2)
    classes = df.withColumn("label", (F.col("label") > 1).cast("int"))
    assert ml.evaluate_classifier(classes, ["a", "b"]).first()["accuracy"] > 0.95
    assert ml.evaluate_regressor(df, ["a", "b"], kind="forest").first()["r2"] > 0.5 and ml.evaluate_regressor(df, ["a", "b"]).first()["r2"] > 0.7


def test_cityblock_nearest_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, [float(x) for x in rng.integers(-60, 60, 4)]) for i in range(120)]
    rows += [("a", 200 + i, [float(x) for x in rng.normal(0, 1e6, 4)]) for i in range(8)]  # wider than the widest cell
    rows += [("a", 300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]  # one vector for many
    rows += [("b", 400, [0.0] * 4), ("b", 401, [0.25, 0.5, 0.0, 0.0]), ("c", 402, [5.0] * 4)]  # fewer than k, and none
    df = spark.createDataFrame(rows, "k string, id int, v array<double>")
    left, right = df.select("k", F.col("id").alias("l"), F.col("v").alias("a")), df.select("k", F.col("id").alias("r"), F.col("v").alias("b"))
    got = joins.cityblock_nearest(left, right, ["k"], "a", "b", "l", "r", 3, levels=6)
    assert got.columns == ["k", "l", "a", "r", "b", "distance", "place"]
    want = set()
    for k, i, v in rows:
        far = sorted((sum(abs(x - y) for x, y in zip(v, w, strict=True)), j) for g, j, w in rows if g == k and j != i)[:3]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(far)}
    found = [(r.l, r.r, r.place) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    for direct in (0, 2):  # all by cells; a by cells, b and c by pairs
        assert sorted((r.l, r.r, r.place) for r in joins.cityblock_nearest(left, right, ["k"], "a", "b", "l", "r", 3, levels=6, direct=direct).collect()) == sorted(want)
    assert joins.cityblock_nearest(left.limit(0), right, ["k"], "a", "b", "l", "r").count() == 0
    holes = spark.createDataFrame([("a", None, [1.0]), ("a", 1, None)], "k string, l int, a array<double>")
    assert joins.cityblock_nearest(holes, right, ["k"], "a", "b", "l", "r").count() == 0


def test_cityblock_copies_are_met_once(spark, monkeypatch):
    """Three vectors of many rows are within ``direct`` right rows, so they need no cells."""
    within = joins._within
    monkeypatch.setattr(joins, "_within", lambda *a: within(*a).limit(0))
    df = spark.range(600).select(F.lit(1).alias("k"), "id", F.array((F.col("id") % 3).cast("double"), F.lit(0.0)).alias("v"))
    left, right = df.select("k", F.col("id").alias("l"), F.col("v").alias("a")), df.select("k", F.col("id").alias("r"), F.col("v").alias("b"))
    found = {(r.l, r.place): (r.r, r.distance) for r in joins.cityblock_nearest(left, right, ["k"], "a", "b", "l", "r", 2, direct=16).collect()}
    assert len(found) == 1200
    assert all((found[i, 1], found[i, 2]) == tuple((j, 0.0) for j in range(i % 3, 12, 3) if j != i)[:2] for i in range(600))


def learned_frame(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 3))
    y = np.sin(3 * x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.1, n)
    return x, y


def test_evidence_gradient_agrees_with_finite_differences():
    x, y = learned_frame(30)
    parts = [[0], [1, 2]]
    theta = processes.start(parts) + np.linspace(-0.3, 0.4, 6)
    got = processes.evidence(theta, parts, x, y)[1]
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        want = (processes.evidence(theta + step, parts, x, y)[0] - processes.evidence(theta - step, parts, x, y)[0]) / 2e-5
        assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_posterior_of_all_points_is_the_exact_one():
    x, y = learned_frame(25)
    parts, at = [[0], [1, 2]], learned_frame(10, 9)[0]
    theta = processes.start(parts)
    k, near, noise = sum(processes.kernel(theta, parts, x, x)), sum(processes.kernel(theta, parts, x, at)), np.exp(theta[0])
    inverse = np.linalg.inv(k + noise * np.eye(25))
    mean, variance = processes.posterior(theta, parts, x, k @ k.T, k @ y, at)
    np.testing.assert_allclose(mean, near.T @ inverse @ y, atol=1e-3)
    np.testing.assert_allclose(variance, 1 - np.einsum("ij,ik,kj->j", near, inverse, near), atol=1e-3)


def test_learned_process(spark):
    x, y = learned_frame()
    rows = [("g", k, *map(float, a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [(None, 1000 + k, *r[2:]) for k, r in enumerate(rows[:40])] + [("none", 2000, 0.0, None, 1.0, None), ("one", 3000, 0.0, 1.0, 1.0, 5.0), ("g", 5000, 0.5, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "grp string, game bigint, a double, b double, c double, y double")
    seen = {}
    for block in (4096, 50):
        predictions, kernels = processes.learned_process(df, "grp", "game", ["a", "b", "c"], "y", [["a"], ["b", "c"]], most=100, block=block)
        got = {r["game"]: (r["mean"], r["variance"]) for r in predictions.collect()}
        assert len(got) == len(rows) and got[2000] == (None, None) and got[3000][0] == pytest.approx(5.0)
        mine = np.array([got[k][0] for k in range(240)])
        assert np.mean((mine - y) ** 2) < 0.05 < np.var(y) and got[5000][0] == pytest.approx(np.sin(1.5), abs=0.3)
        seen[block] = mine
    np.testing.assert_allclose(seen[50], seen[4096], rtol=1e-5, atol=1e-6)  # dealt to many tasks or one
    held = {r["grp"]: r for r in kernels.collect()}
    assert held["g"]["rows"] == 241 and held["g"]["sampled"] == 100 and held["g"]["evidence"] > held["g"]["evidence_at_start"] + 5 and held["g"]["noise"] < 0.1
    lengths = [p["lengths"] for p in held["g"]["parts"]]
    assert lengths[0][0] < lengths[1][1] and "none" not in held  # the wave is short, c matters to nothing
    assert processes.learned_process(df.limit(0), "grp", "game", ["a"], "y")[0].count() == 0


def test_boosting_stops_by_its_validation_part(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    signal = spark.createDataFrame([(k, float(a), float(b), float(a * a + b), float(rng.normal())) for k, (a, b) in enumerate(x)], "game bigint, a double, b double, label double, noise double")
    _, noise = ml.boosted(signal, ["a", "b"], label="noise", most=15)
    model, rounds = ml.boosted(signal, ["a", "b"], most=15, rate=0.3)
    noise, rounds = noise.orderBy("round").collect(), rounds.orderBy("round").collect()
    assert len(noise) < 15 and [r["chosen"] for r in noise] == [k == len(noise) - 1 for k in range(len(noise))]
    full = ml.boosted(signal, ["a", "b"], label="noise", most=15, tolerance=0.0)[1].orderBy("round").collect()
    assert noise[-1]["test_error"] <= full[-1]["test_error"] * 1.05
    assert len(rounds) > len(noise) and rounds[-1]["test_error"] < 0.5 * rounds[0]["test_error"] and rounds[-1]["valid_error"] <= min(r["valid_error"] for r in rounds) + 1e-9
    assert model.getNumTrees == len(rounds)


def test_dirichlet_weights_tend_to_the_closed_forms(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in rng.normal(5, 2, 300)] + [("a", None)] * 60 + [("b", 1.0), ("b", 1.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    closed = {r["k"]: r for r in df.groupBy("k").agg(stats.bayesian_mean(F.col("x")).alias("mean"), stats.bayesian_var(F.col("x")).alias("var")).collect()}
    drawn = {r["k"]: r for r in stats.dirichlet_resampled(df, ["k"], "x", samples=200).collect()}
    assert drawn["a"]["mean"] == pytest.approx(closed["a"]["mean"], rel=0.01) and drawn["a"]["var"] == pytest.approx(closed["a"]["var"], rel=0.03)
    assert drawn["b"]["mean"] == pytest.approx(2 / 3, abs=0.05) and drawn["b"]["var"] == pytest.approx(0, abs=1e-9)
    assert drawn["c"]["mean"] is None and drawn["c"]["var"] is None
    again = {r["k"]: r for r in stats.dirichlet_resampled(df.repartition(3), ["k"], "x", samples=200).collect()}
    assert again["a"]["mean"] == pytest.approx(drawn["a"]["mean"], rel=1e-12)


def test_a_python_function_as_a_statistic(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8, 16)] + [("a", None), ("b", None)], "k string, x double")
    range_ = stats.of_values(lambda x: x.max() - x.min() if len(x) else None)
    assert {r["k"]: r["v"] for r in df.groupBy("k").agg(range_(F.col("x")).alias("v")).collect()} == {"a": 15.0, "b": None}
    middle = stats.of_values(lambda x: float(np.median(x)) if len(x) else None)
    python = stats.resampled(df, ["k"], "x", middle, samples=20).where("k = 'a'").first()["statistic"]
    assert python == pytest.approx(stats.resampled(df, ["k"], "x", F.median, samples=20).where("k = 'a'").first()["statistic"])


def test_a_statistic_gets_the_values_as_one_array_without_pandas(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", float("nan")), ("a", None), ("a", 1.0), ("b", None), ("b", float("nan")), (None, 3.0), (None, 3.0), ("c", float("inf"))], "k string, x double")

    def seen(x):
        x += 0.0  # it may be written to
        return float(f"{len(x)}{int(x.sum())}") if np.isfinite(x).all() and x.dtype == float else float("nan")

    out = df.groupBy("k").agg(stats.of_values(seen)(F.col("x")).alias("v"))
    assert {r["k"]: r["v"] for r in out.collect()} == {"a": 23.0, "b": 0.0, None: 26.0, "c": None}
    whole = df.where("k = 'none'").agg(stats.of_values(lambda x: len(x))(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in whole] in ([], [0.0], [None])
    line = next(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowAggregatePython" in x)
    assert line.endswith(f", {PythonEvalType.SQL_GROUPED_AGG_ARROW_UDF}")


def test_substitutions_match_brute_force(spark):
    import random

    rng = random.Random(1)
    slots = {"g": 2, "f": 1}
    people = [(k, rng.choice("gf"), rng.randrange(1, 5), rng.randrange(1, 4)) for k in range(40)]
    by = {p[0]: p for p in people}
    rosters = []
    for name in range(12):
        guards, forwards = [p[0] for p in people if p[1] == "g"], [p[0] for p in people if p[1] == "f"]
        rosters.append((name, [*(x if rng.random() < 0.7 else None for x in rng.sample(guards, 2)), rng.choice(forwards) if rng.random() < 0.7 else None]))
    players = spark.createDataFrame(people, "pid bigint, position string, cost bigint, points bigint")
    frame = spark.createDataFrame(rosters, "roster int, pids array<bigint>")

    def truth(value, margin, not_less, once):
        out = set()
        for name, pids in rosters:
            used = set()
            for slot, (pid, spot) in enumerate(zip(pids, "ggf", strict=True)):
                for other, position, cost, points in people:
                    had = by[pid][value] if pid is not None else 0
                    if position != spot or other in pids or (cost, points)[value - 2] != had + margin or not_less and pid is not None and points < by[pid][3]:
                        continue
                    if pid is None and once and other in used:
                        continue
                    used |= {other} if pid is None else set()
                    out.add((name, slot, pid, other))
        return out

    for column, value, margin, not_less, once in (("cost", 2, 1, "points", False), ("points", 3, 1, None, True), ("cost", 2, 3, None, False), ("points", 3, 0, None, True)):
        got = roster.substitutions(frame, players, slots, column, margin, not_less, once).collect()
        found = {(r["roster"], r["slot"], r["pid"], r["other"]) for r in got}
        assert len(got) == len(found) and found == truth(value, margin, not_less, once) and found


def test_fuzzy_dates_make_each_pair_once_in_many_partitions(spark):
    """All pairs decide; one nation's rows are dealt by date to more than one task."""
    day = lambda k: dt.date(1990, 1, 1) + dt.timedelta(days=k * 37 % 3000)
    rows = [[(k, k % 2, day(k)) for k in range(n)] + [(-1, 0, None), (3, 1, day(3))] for n in (60, 90)]
    a, b = (spark.createDataFrame(r, f"{n} bigint, grp bigint, {n}_day date") for r, n in zip(rows, "ab", strict=True))

    def agree(x, y):
        return abs((x - y).days) <= 120 or (x.month, x.day) == (y.month, y.day) or (y.day <= 12 and (x.year, x.month, x.day) == (y.year, y.day, y.month))

    want = sorted((i, j) for i, g, x in rows[0] for j, h, y in rows[1] if g == h and x and y and agree(x, y))
    found = joins.fuzzy_dates(a, b, ["grp"], "a_day", "b_day").select("a", "b")
    assert sorted(map(tuple, found.collect())) == want
    one = joins.fuzzy_dates(a.where("grp = 1"), b.where("grp = 1"), ["grp"], "a_day", "b_day")
    assert one.select(F.spark_partition_id()).distinct().count() > 10


def test_stub_rows_of_one_team_are_dealt_to_many_tasks(spark):
    games = spark.range(200).select(F.col("id").alias("game"), F.lit(1).alias("grp"))
    roster = spark.range(5).select((F.col("id") + 10).alias("player"), F.lit(1).alias("grp"))
    actual = spark.createDataFrame([(3, 99, 1.5)], "game bigint, player bigint, qty double")
    found = matchups.stub_rows(games, roster, actual, "game", "grp").select("game", "player", "qty")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(3, 99, 1.5), *((g, p, None) for g in range(200) if g != 3 for p in range(10, 15))], key=str)
    assert found.where("qty is null").select(F.spark_partition_id()).distinct().count() > 10
