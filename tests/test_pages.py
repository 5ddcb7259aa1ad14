"""Named tables of pages, people of two lists, and streams against their batch forms."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxwise.operators import people
from boxwise.sources import pages
from boxwise.streaming import jobs

PAGE = """<html><table><tr><td data-stat='player'>no id</td></tr></table>
<table id='box_GSW_basic'><thead><tr class='thead'><th data-stat='player'>Player</th></tr></thead><tbody>
<tr><th data-stat='player' csk='Curry'><a href='/players/c/curryst01.html'>S. Curry</a></th><td data-stat='mp'>35:30</td><td data-stat='pts'>31</td><td data-stat='fg'>x</td></tr>
<tr><th data-stat='player'><a href='/players/b/barnema01.html'>Barnes</a></th><td data-stat='reason'>Did Not Play</td></tr></tbody></table>
<!-- <table id='on_off'><tr><th data-stat='split_id'>On - Off</th><td data-stat='team_id'><a href='/teams/GSW/2015.html'>GSW</a></td><td data-stat='mp'>1200</td><td data-stat='diff_efg_pct'>+4.5%</td><td data-stat='diff_pts'>+7.1</td></tr></table> -->
<table id='box_CLE_basic'><tr><th data-stat='player'>James</th><td data-stat='mp'>40:00</td><td data-stat='pts'>25"""


def test_named_tables_inside_comments_and_cut_off(spark):
    df = spark.createDataFrame([("g", PAGE), ("n", None), ("e", ""), ("x", "<td data-stat='player'>stray</td><!-- plain -->")], "id string, html string")
    cells = pages.named_cells(df, "id", "html")
    box = pages.typed_table(cells, "id", "box_[A-Z]{3}_basic", pages.BASIC, ["player"]).withColumn("pid", pages.id_in_link(F.col("player_link")))
    got = {r["player"]: (r["table"], r["mp"], r["pts"], r["fg"], r["pid"]) for r in box.collect()}
    assert got == {"S. Curry": ("box_GSW_basic", 35.5, 31.0, None, "curryst01"), "Barnes": ("box_GSW_basic", 0.0, None, None, "barnema01"), "James": ("box_CLE_basic", 40.0, 25.0, None, None)}
    row = pages.typed_table(cells, "id", "on_off", pages.ON_OFF, ["team_id"]).withColumn("tid", pages.id_in_link(F.col("team_id_link"))).first()
    assert (row["mp"], row["diff_efg_pct"], row["diff_pts"], row["tid"], row["diff_off_rtg"]) == (1200.0, pytest.approx(0.045), 7.1, "GSW", None)
    assert pages.typed_table(cells, "id", "lineups_2_man", pages.TWO_MAN).count() == pages.typed_table(cells, "id", "advanced", pages.ADVANCED).count() == 0
    assert pages.named_cells(df.limit(0), "id", "html").count() == 0
    with pytest.raises(ValueError):
        pages.read_as("other", F.lit("x"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_similar_names_are_those_of_all_pairs(spark, most):
    rng = random.Random(most)
    name = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 8))).strip()
    tidy = lambda x: " ".join(x.lower().split())
    left, right = [(k, name()) for k in range(60)] + [(99, None)], [(k, name()) for k in range(60)] + [(98, "J.R. Smith"), (97, "jr smith")]
    a, b = spark.createDataFrame(left, "p int, name string"), spark.createDataFrame(right, "q int, other string")
    got = people.similar_names(a, b, "p", "name", "q", "other", most).collect()
    want = {(p, q, d) for p, x in left if x is not None for q, y in right if (d := distance(tidy(x), tidy(y.replace(".", "")))) <= most}
    assert len(got) == len(want) and {(r["p"], r["q"], r["distance"]) for r in got} == want


def test_people_match_by_birthday_or_alone(spark):
    d = dt.date
    who = spark.createDataFrame([(1, "Stephen Curry", d(1988, 3, 14)), (2, "Al Horford", d(1986, 3, 6)), (3, "Jon Doe", d(1900, 1, 1)), (4, "Two Same", d(1900, 1, 1)), (5, "No Date", None), (6, "Far Off", d(1980, 1, 1))], "p int, name string, born date")
    listed = spark.createDataFrame([(10, "Stephen Curry", d(1988, 6, 1)), (20, "Al Horfort", d(1986, 6, 3)), (30, "Jon Doe", d(1991, 1, 5)), (40, "Two Same", d(1990, 5, 5)), (41, "Two Same", d(1991, 5, 5)), (50, "No Date", d(1990, 1, 1)), (60, "Far Off", d(1985, 7, 7)), (61, "Far Off", d(1999, 1, 1))], "q int, name string, day date")
    got = {(r["p"], r["q"]): (r["distance"], r["how"]) for r in people.matched_people(who, listed, "p", "name", "born", "q", "name", "day").collect()}
    assert got == {(1, 10): (0, "birthday"), (2, 20): (1, "birthday"), (3, 30): (0, "only"), (6, 61): (0, "birthday")}


def ran(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    q.processAllAvailable()
    q.stop()


def test_games_meet_their_frames_by_watermark(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    games = [(1, t(0), "g1"), (2, t(10), "g2"), (3, t(20), "g3")]
    frames = [(1, t(5), "f1"), (1, t(6), "f2"), (2, t(9), "too early"), (3, t(90), "too late"), (3, t(45), "f3"), (9, t(20), "no game")]
    spark.createDataFrame(games, "game int, at timestamp, name string").write.parquet(str(tmp_path / "g"))
    spark.createDataFrame(frames, "game int, seen timestamp, frame string").write.parquet(str(tmp_path / "f"))
    a = spark.readStream.schema("game int, at timestamp, name string").parquet(str(tmp_path / "g"))
    b = spark.readStream.schema("game int, seen timestamp, frame string").parquet(str(tmp_path / "f"))
    ran(jobs.games_with_frames(a, b, "game", "at", "seen", "1 hour", "30 minutes"), tmp_path, "met")
    assert sorted((r["name"], r["frame"]) for r in spark.table("met").collect()) == [("g1", "f1"), ("g1", "f2"), ("g3", "f3")]


def test_trailing_profiles_are_those_of_the_batch(spark, tmp_path):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + dt.timedelta(hours=k), None if k % 7 == 3 else float(rng.randrange(20))) for k in range(40)]
    shuffled = rows[:]
    for k in range(0, 40, 4):  # out of order, but not later than the watermark
        shuffled[k : k + 4] = rng.sample(shuffled[k : k + 4], 4)
    end = [("z", start + dt.timedelta(days=400), 1.0), ("z", start + dt.timedelta(days=800), 1.0)]
    source = tmp_path / "in"
    for n, part in enumerate([shuffled[:16], shuffled[16:], end[:1], end[1:]]):
        spark.createDataFrame(part, "k string, at timestamp, v double").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k string, at timestamp, v double").parquet(str(source))
        out = jobs.trailing_profiles(stream, "k", "at", "v", "6 hours", size=5, idle="60 days")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    got = {(r["k"], r["at"]): (r["mean"], r["var"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).where("k <> 'z'").collect()}
    assert len(got) == 40
    for k in "ab":
        own = pd.DataFrame([r for r in rows if r[0] == k], columns=["k", "at", "v"])
        for i in range(len(own)):
            before = own["v"].iloc[max(0, i - 5) : i].dropna()
            mean, var, n = got[k, own["at"].iloc[i].to_pydatetime()]
            assert n == len(before) and (mean is None or np.isnan(mean) if n == 0 else mean == pytest.approx(before.mean()) and var == pytest.approx(before.var(ddof=0)))
