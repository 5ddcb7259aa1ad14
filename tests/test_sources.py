"""Sources, keyed tables and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from boxwise.sources import features_csv, html, resultset, tables
from boxwise.sources.store import KeyedTable
from boxwise.streaming import jobs


def test_result_sets(spark):
    doc = '{"resultSets": [{"name": "PlayerStats", "headers": ["ID", "PTS"], "rowSet": [["1", "20"], ["2", "x"]]}, {"name": "TeamStats", "headers": ["T"], "rowSet": [["a"], ["b"]]}]}'
    df = spark.createDataFrame([("g", doc), ("bad", "{")], "game string, doc string")
    rows = resultset.result_rows(df, "doc", ["game"])
    frame = resultset.frame(rows, "PlayerStats", {"ID": "bigint", "PTS": "double"}, ["game"])
    assert sorted(map(tuple, frame.collect())) == [("g", 1, 20.0), ("g", 2, None)]
    assert [r["game"] for r in resultset.valid_game(rows, "game").collect()] == ["g"]


def test_html_tables(spark):
    page = '<table><tr><th>Name</th><th>PTS</th></tr><tr><td>A</td><td csk="20">x</td></tr></table><ul><li>one</li></ul>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    got = [(r["table"], r["row"], r["header"], r["text"], r["number"]) for r in html.html_tables(df, "id", "html").collect()]
    assert got == [(0, 1, "Name", "A", None), (0, 1, "PTS", "20", 20.0), (1, 0, None, "one", None)]
    wide = html.wide_rows(html.html_tables(df, "id", "html").where("table = 0"), ["id"], ["Name", "PTS"]).first()
    assert (wide["Name"], wide["PTS"]) == ("A", "20")


def test_feature_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", 1.5, 1), ("p2", None, 0)], "pid string, x double, c int")
    path = str(tmp_path / "m.csv")
    features_csv.write_features(df, path, ["pid"], {0: ["c"]}, ["x"])
    got, roles = features_csv.read_features(spark, path)
    assert roles == {"id": ["pid"], "continuous": ["x"], "0": ["c"]}
    assert sorted(map(tuple, got.select("pid", "x", "c").collect())) == [("p1", 1.5, 1.0), ("p2", None, 0.0)]


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    assert t.read() is None
    now = dt.datetime(2024, 3, 1)
    row = lambda k, v, d: (k, v, now - dt.timedelta(days=d))
    kind = "k int, v string, cached_at timestamp"
    t.upsert(spark.createDataFrame([row(1, "a", 40), row(2, "b", 1)], kind))
    t.upsert(spark.createDataFrame([row(2, None, 0)], kind))
    t.insert_new(spark.createDataFrame([row(1, "z", 0), row(3, "c", 0)], kind))
    assert sorted((r["k"], r["v"]) for r in t.read().collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(r["k"] for r in t.fresh(now).collect()) == [2, 3]
    t.delete(spark.createDataFrame([(3,)], "k int"))
    assert sorted(r["k"] for r in t.read().collect()) == [1, 2]
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", [])


def events(spark, tmp_path):
    rows = [(1, "a", 1.0, dt.datetime(2024, 1, 1, 0, 0)), (1, "b", 2.0, dt.datetime(2024, 1, 1, 0, 1)), (2, "c", 5.0, dt.datetime(2024, 1, 1, 0, 2))]
    spark.createDataFrame(rows, "k int, name string, v double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k int, name string, v double, ts timestamp").parquet(str(tmp_path / "in"))


def ran(writer, tmp_path, name):
    q = writer.option("checkpointLocation", str(tmp_path / f"check-{name}")).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    ran(jobs.upsert_stream(events(spark, tmp_path), t, ["ts"]), tmp_path, "u")
    assert sorted((r["k"], r["name"]) for r in t.read().collect()) == [(1, "b"), (2, "c")]
    stream = spark.readStream.schema("k int, name string, v double, ts timestamp").parquet(str(tmp_path / "in"))
    ran(jobs.first_events(stream, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("firsts"), tmp_path, "f")
    assert spark.table("firsts").count() == 2
    ran(jobs.bounded_ranges(stream, "k", "v", 1).writeStream.format("memory").queryName("ranges").outputMode("update"), tmp_path, "r")
    assert {r["k"]: r["n"] for r in spark.table("ranges").collect()} == {1: 1, 2: 1}
    counted = jobs.windowed_counts(stream, "ts", ["k"], "v", "5 minutes", "5 minutes", "1 minute")
    ran(counted.writeStream.format("memory").queryName("counted").outputMode("complete"), tmp_path, "w")
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 3


def test_a_dead_write_is_not_in_the_way(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    t.upsert(row(1, "a"))
    broken = row(2, "b").select(F.raise_error(F.lit("lost")).cast("int").alias("k"), "v")
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            t.append(broken)
    (tmp_path / "t" / "rows-dead").mkdir()  # what a driver that is lost leaves behind
    assert [r["k"] for r in t.read().collect()] == [1]
    t.append(row(2, "b"))
    with pytest.raises(ValueError):
        t.append(row(1, "again"))
    t.refresh(row(3, "c"), dt.datetime(2024, 1, 1))
    assert sorted(r["k"] for r in t.read().collect()) == [1, 2, 3]


def test_partitions_follow_the_rows(spark):
    """So a task's memory does not grow with the table; equal keys stay together."""
    df = spark.range(5000).withColumn("k", F.col("id") % 50)
    held = tables.dealt(df, "k", 500)
    assert held.rdd.getNumPartitions() == 10 and tables.dealt(df, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert held.select("k", F.spark_partition_id().alias("p")).distinct().count() == 50
