"""The schema binding of the driver's tables: entity, group, event and stats.

An order is an event (game) of a customer (entity, player), whose nation is its
group (team) and whose market segment its position. Grouped line items are the
event's stats; orders without any have null stats. Prices are summed in whole
cents, so that sums do not depend on their order, and shown in thousands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions.scalars import season
from boxwise.sources.tables import table

WINDOW = 10


def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: qty, price (thousands), lines."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return items.agg(F.sum("l_quantity").alias("qty"), (F.sum(cents) / F.lit(1e5)).alias("price"), F.count(F.lit(1)).alias("lines"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, entity, grp, seg, day, season, prio, total (thousands), qty, price, lines."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("prio"), (F.round(F.col("o_totalprice") * 100).cast("bigint") / F.lit(1e5)).alias("total"),
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("seg"))
    joined = orders.join(people, "entity").join(item_stats(spark, sf_dir), "game", "left")
    return joined.withColumn("season", season(F.col("day"))).select("game", "entity", "grp", "seg", "day", "season", "prio", "total", "qty", "price", "lines")


GAMES = """
li AS (
  SELECT l_orderkey AS game, sum(l_quantity) AS qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e5 AS price, count(*) AS lines
  FROM lineitem GROUP BY 1
), games AS (
  SELECT o_orderkey AS game, o_custkey AS entity, c_nationkey AS grp, c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS day,
    CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END AS INT) AS season, o_orderpriority AS prio,
    CAST(round(o_totalprice * 100) AS BIGINT) / 1e5 AS total, qty, price, lines
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON o_orderkey = li.game
)
"""


def r4(column: str, name: str | None = None):
    """A column rounded to four decimals, as the SQL has it."""
    return F.round(F.col(column), 4).alias(name or column)


def ewm_sql(values: str, rows: str) -> tuple[str, str]:
    """(mean, variance) with exponential weights of a list, oldest value first."""
    terms = lambda e: f"coalesce(list_sum(list_transform(list_reverse({values}), lambda x, j: {e})), 0)"
    w = f"pow(1 - 2.0 / ({rows} + 1), j - 1)"
    sw, sw2, sx, sxx = terms(w), terms(f"{w} * {w}"), terms(f"{w} * x"), terms(f"{w} * x * x")
    mean = f"({sx} / nullif({sw}, 0))"
    var = f"CASE WHEN len({values}) > 1 THEN greatest({sxx} / nullif({sw}, 0) - {mean} * {mean}, 0) * {sw} * {sw} / nullif({sw} * {sw} - {sw2}, 0) END"
    return mean, var


def half_up(x, digits: int = 4):
    """Rounded half up in binary arithmetic, step by step as the SQL has it."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def half_sql(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def shown(query, sql: str, dates: tuple[str, ...] = (), doubles: tuple[str, ...] = ()):
    """The query and its SQL with dates as text, and whole numbers that can be null as doubles."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c in dates} | {c: F.col(c).cast("double") for c in doubles})

    casts = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates] + [f"CAST({c} AS DOUBLE) AS {c}" for c in doubles]
    return run, f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})"
