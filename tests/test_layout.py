"""Layouts: plans without exchanges, pruned scans, partitions that a write leaves alone; assembled games and tables of team stats."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from boxwise.operators import features, matchups, merge, ml, serve, windows
from boxwise.sources import assembly, layout, resultset


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_and_aggregate_without_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), (F.col("id") % 3).alias("p"))
        b = spark.range(0, 1000, 2).select(F.col("id").alias("k"), F.lit("y").alias("y"))
        for name in ("own_games", "own_stats"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        games = layout.save_bucketed(a, "own_games", ["k"], 4, ["p"])
        stats = layout.save_bucketed(b, "own_stats", ["k"], 4)
        joined = games.join(stats, "k")
        assert joined.count() == 500 and "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert "Exchange" in plan(a.join(b, "k"))  # what it is without the layout
        summed = games.groupBy("k").agg(F.sum("x"))
        assert "Exchange" not in plan(summed)
        pruned = games.where("p = 1 and x > 10")
        shown = plan(pruned)
        assert "PartitionFilters: [isnotnull(p" in shown and "PushedFilters: [IsNotNull(x), GreaterThan(x,10)" in shown
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        one = games.where("k = 17")
        assert one.count() == 1 and "SelectedBucketsCount: 1 out of 4" in plan(one)
        again = layout.save_bucketed(b, "own_stats", ["k"], 4)
        assert again.count() == 500
    finally:
        for name in ("own_games", "own_stats"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def files(path):
    return {p.removeprefix(path): os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/_part=*/*.parquet")}


def test_a_write_leaves_the_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    table = layout.BucketedTable(spark, path, ["k"], 8)
    assert table.read() is None and table.find(spark.createDataFrame([(1,)], "k bigint")) is None
    table.delete(spark.createDataFrame([(1,)], "k bigint"))
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("x"), F.lit(1).alias("y")))
    before = files(path)
    assert len({p.split("/")[1] for p in before}) == 8
    row = spark.createDataFrame([(17, None, 5)], "k bigint, x string, y int")
    table.upsert(row)
    after = files(path)
    changed = {p.split("/")[1] for p, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 1 and all(after[p] == t for p, t in before.items() if p.split("/")[1] not in changed)
    assert table.read().count() == 200 and table.read().where("k = 17").first().asDict() == {"k": 17, "x": "a", "y": 5}
    found = table.find(row)
    assert found.count() == 1 and "_part" in plan(found).split("PartitionFilters: ")[1].split("]")[0]


def test_keyed_writes(spark, tmp_path):
    table = layout.BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, x string, y int")
    table.insert_new(rows(("a", "one", 1), ("b", "two", 2), (None, "none", 0)))
    table.insert_new(rows(("a", "other", 9), ("c", "three", 3), ("c", "three", 3)))
    shown = lambda: sorted((str(r["k"]), r["x"], r["y"]) for r in table.read().collect())
    assert [r for r in shown() if r[0] != "None"] == [("a", "one", 1), ("b", "two", 2), ("c", "three", 3)]
    table.save_or_update(rows(("b", "changed", 20), ("d", "four", 4)), ["y"])
    assert ("b", "two", 20) in shown() and ("d", "four", 4) in shown()
    for k in ("a", "b", "c", "d"):
        table.delete(rows((k, None, None)))
    assert all(r[0] == "None" for r in shown())
    table.upsert(rows(("a", "back", None)))
    assert ("a", "back", None) in shown()
    with pytest.raises(ValueError):
        layout.BucketedTable(spark, "x", [])


def test_save_or_update_takes_nulls_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "b", None), (None, "m", 3), (4, "d", 4)], "k int, x string, y int")
    got = {r["k"]: (r["x"], r["y"]) for r in merge.save_or_update(old, new, ["k"], ["y"]).collect()}
    assert got == {1: ("a", None), None: ("n", 3), 4: ("d", 4)}


def doc(*sets):
    return json.dumps({"resultSets": [{"name": n, "headers": h, "rowSet": r} for n, h, r in sets]})


def test_assembly_reads_and_shuffles_the_rows_once(spark):
    cells = lambda **c: {k: str(v) for k, v in c.items()}
    rows = [(1, "P", 0, cells(PLAYER_ID=7, TEAM_ID=1, A=2)), (1, "P", 1, cells(PLAYER_ID=8, TEAM_ID=2, A=3)), (1, "Q", 0, cells(PLAYER_ID=7, B=4)), (1, "Q", 1, cells(PLAYER_ID=7, B=5)), (1, "R", 0, cells(TEAM_ID=1, C=6))]
    rows += [(1, "TeamStats", k, cells(TEAM_ID=k + 1, W=k)) for k in range(2)]
    df = spark.createDataFrame(rows, "game bigint, name string, place int, cells map<string,string>")
    big = lambda *names: dict.fromkeys(names, "bigint")
    frames = {"R": big("TEAM_ID", "C"), "P": big("PLAYER_ID", "TEAM_ID", "A"), "Q": big("PLAYER_ID", "B")}
    whole = assembly.assembled_whole(df, "game", frames, {"TeamStats": big("TEAM_ID", "W")})
    assert sorted(map(tuple, whole.select("PLAYER_ID", "TEAM_ID", "A", "B", "C", "W").collect())) == [(7, 1, 2, 4, 6, 0), (7, 1, 2, 5, 6, 0)]
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_assembly_drops_games_that_are_not_whole(spark):
    players = ("PlayerStats", ["PLAYER_ID", "TEAM_ID", "PTS"], [["7", "1", "10"], ["8", "2", "12"]])
    more = ("PlayerTrack", ["PLAYER_ID", "DIST", "PTS"], [["7", "2.5", "99"], ["8", "x", "99"]])
    by_team = ("Misc", ["TEAM_ID", "PACE"], [["1", "90"], ["2", "95"]])
    teams = ("TeamStats", ["TEAM_ID", "W"], [["1", "1"], ["2", "0"]])
    docs = [
        (1, doc(by_team, players, more, teams)), (2, doc(players, more, by_team)), (3, doc(players, more, by_team, ("TeamStats", ["TEAM_ID", "W"], [["1", "1"]]))),
        (4, doc(("PlayerStats", ["PLAYER_ID", "TEAM_ID"], [["7", "1"]]), more, by_team, teams)), (5, doc(players, by_team, teams)), (6, "no json"), (7, None),
    ]
    rows = resultset.result_rows(spark.createDataFrame(docs, "game int, doc string"), "doc", ["game"])
    kinds = {"Misc": {"TEAM_ID": "bigint", "PACE": "double"}, "PlayerStats": {"PLAYER_ID": "bigint", "TEAM_ID": "bigint", "PTS": "double"}, "PlayerTrack": {"PLAYER_ID": "bigint", "DIST": "double", "PTS": "double"}}
    own, team = assembly.assembled(rows, "game", kinds, {"TeamStats": {"TEAM_ID": "bigint", "W": "int"}}, {"PlayerStats": ["PTS"]})
    got = sorted((r["game"], r["PLAYER_ID"], r["TEAM_ID"], r["PTS"], r["DIST"], r["PACE"]) for r in own.collect())
    assert got == [(1, 7, 1, 10.0, 2.5, 90.0), (1, 8, 2, 12.0, None, 95.0)]  # clashing points are those of the first frame
    assert sorted((r["game"], r["TEAM_ID"], r["W"]) for r in team.collect()) == [(1, 1, 1), (1, 2, 0)]


def _rows_of_cells(spark, rows):
    return spark.createDataFrame(rows, "game bigint, name string, place int, cells map<string,string>")


def test_assembly_groups_typed_rows_of_what_is_read(spark):
    df = _rows_of_cells(spark, [(1, "P", 0, {"PLAYER_ID": "7", "TEAM_ID": "1", "A": "2"})])
    ids = {"PLAYER_ID": "bigint", "TEAM_ID": "bigint"}
    whole = assembly.assembled_whole(df, "game", {"P": ids | {"A": "double"}, "Q": ids | {"A": "double", "B": "double"}}, {"TeamStats": {"TEAM_ID": "bigint", "W": "int"}}, {"P": ["A"]})
    node = whole._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Aggregate":
        node = node.children().head()
    grouped = {f["name"]: f["type"] for f in json.loads(node.child().schema().json())["fields"]}
    columns = {k: [c["name"] for c in v["fields"]] for k, v in grouped.items() if isinstance(v, dict) and v["type"] == "struct"}
    assert columns == {"_P": ["PLAYER_ID", "TEAM_ID", "A"], "_Q": ["PLAYER_ID", "B"], "_TeamStats": ["TEAM_ID", "W"]}
    assert sorted(k for k in grouped if k not in columns) == ["_lacking", "game"]  # neither names nor maps of texts


def test_assembly_of_odd_rows(spark):
    teams = [("TeamStats", 0, {"TEAM_ID": "1", "W": "3"}), ("TeamStats", 1, {"TEAM_ID": "2", "W": "x"})]
    one = [*teams, ("P", 0, {"PLAYER_ID": "7", "TEAM_ID": "1", "A": "2"}), ("P", 1, {"PLAYER_ID": None, "TEAM_ID": "1", "A": "4"}), ("P", 2, None), ("Q", 0, {"PLAYER_ID": "7", "A": "9", "B": "5"})]
    odd = [("Q", 1, {"PLAYER_ID": "7", "B": "5"}), ("Q", 2, {"B": "6"}), ("Q", 3, None), ("T", 0, {"A": "1"}), ("T", 1, {"A": "1"}), (None, 0, {"A": "1"}), ("Other", 0, {})]
    games = {1: [*one, *odd], 2: one, 3: [*one[1:], *odd], 4: [*one, *odd, ("P", 3, {"PLAYER_ID": "8", "TEAM_ID": "1"})], None: [*one, *odd]}
    df = _rows_of_cells(spark, [(g, *r) for g, rows in games.items() for r in rows])
    ids = {"PLAYER_ID": "bigint", "TEAM_ID": "bigint"}
    # T has no key and brings no column: each of its rows gives every row again, as a join does
    players, both = {"P": ids | {"A": "int"}, "Q": {"PLAYER_ID": "bigint", "A": "int", "B": "int"}, "T": {"A": "int"}}, {"TeamStats": {"TEAM_ID": "bigint", "W": "int"}}
    of = lambda required, teams="TeamStats": assembly.assembled_whole(df, "game", players, both, required, teams)
    row = (1, 7, 1, 2, 5, 3)
    assert sorted(map(tuple, of({"P": ["A"]}).select("game", "PLAYER_ID", "TEAM_ID", "A", "B", "W").collect())) == [row] * 4
    assert sorted(r["game"] for r in of({}).collect()) == [1] * 4 + [4] * 4
    assert of({}, "Nowhere").count() == 0
    own, team = assembly.assembled(df, "game", players, both, {"P": ["A"]})
    assert sorted(map(tuple, own.select("game", "PLAYER_ID", "TEAM_ID", "A", "B").collect())) == [row[:5]] * 4
    assert sorted(map(tuple, team.select("game", "TEAM_ID", "W").collect()), key=str) == [(1, 1, 3), (1, 2, None)]


def test_team_stats_tables(spark):
    row = lambda **c: {k: v if k == "url" else {"text": v} for k, v in c.items()}
    table = [row(a="RK", url="u"), row(a="TEAM", b="PTS", c="NOTE", url="u"), row(a="Lions", b="101.5", c="ok", url="s/year/2014"), row(a="Bears", b="-", c="bad", url="s/year/2014"), row(a="Owls", b="7", c="3", url="s")]
    df = spark.createDataFrame([(1, json.dumps({"results": {"collection1": table}})), (2, "x"), (3, None), (4, json.dumps({"results": {}}))], "id int, doc string")
    got = assembly.team_stats(df, "doc", keep=["id"])
    dated = got.withColumn("day", assembly.season_of_page(F.col("url"), F.lit(dt.date(2015, 3, 4))))
    assert sorted((r["id"], r["team"], r["stat"], r["value"], str(r["day"])) for r in dated.collect()) == [(1, "Lions", "PTS", 101.5, "2014-07-01"), (1, "Owls", "NOTE", 3.0, "2015-03-04"), (1, "Owls", "PTS", 7.0, "2015-03-04")]


def test_cleaned_at_every_depth(spark):
    df = spark.createDataFrame([({"a": 1.005, "b": [float("nan"), 2.345, None]}, {"k": {"x": "NaN"}}, 3), (None, None, None)], "s struct<a double, b array<double>>, m map<string, struct<x string>>, n int")
    got = serve.cleaned(df)
    first, second = got.collect()
    assert got.schema == df.schema or got.dtypes == df.dtypes
    assert first["s"]["b"] == [None, 2.35, None] and first["m"]["k"]["x"] is None and first["n"] == 3 and second["s"] is None and second["m"] is None


def test_upsampled_rows(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([5, -9, 1, 9, 2, 3, 4, 6, 7, 8])] + [("a", 10, None), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r["k"], r["t"]): r["n"] for r in ml.upsample_samples(df, ["k"], ["t"], "v", recent=3).groupBy("k", "t").agg(F.max("copy").alias("n")).collect()}
    # of nine sizes a fifth is one: 9, which two rows have
    assert got == {("a", t): 1 + (t >= 8) + (t in (1, 3)) for t in range(11)} | {("b", 0): 2}


def test_play_distribution_and_recent_by_position(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = spark.createDataFrame([("g", 2020, n, day(n), e, v) for n, e, v in [(0, "x", 100.0), (70, "x", 6.0), (71, "y", 4.0), (71, "x", 2.0)]], "grp string, season int, event int, day date, entity string, v double")
    shares = spark.createDataFrame([("x", "G", 0.75), ("x", "F", 0.25), ("y", "F", 1.0)], "entity string, pos string, weight double")
    plays = {(r["entity"], r["pos"]): (r["value"], r["share"]) for r in matchups.play_distribution(rows, shares, "grp", "event", "day", "entity", "pos", "v").collect()}
    assert plays == {("x", "G"): (3.0, 0.5), ("x", "F"): (1.0, pytest.approx(1 / 6)), ("y", "F"): (2.0, pytest.approx(1 / 3))}
    spine = windows.spine(rows, "grp", "season", "event", "day")
    given = {(r["event"], r["pos"]): r["given"] for r in matchups.recent_by_position(rows, shares, spine, "grp", "season", "event", "entity", "pos", "v", 1).collect()}
    assert given == {(70, "G"): 100.0, (70, "F"): 100.0, (71, "G"): 6.0, (71, "F"): 6.0}
    error = features.mean_regression_error(rows, ["entity"], ["day"], "v", [1, 2]).collect()
    assert {r["size"]: r["n"] for r in error} == {1: 2, 2: 2} and all(0 <= r["error"] <= 1 for r in error)
