"""JSON result sets: ``{"resultSets": [{"name", "headers", "rowSet"}]}`` as typed rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "resultSets array<struct<name string, headers array<string>, rowSet array<array<string>>>>"


def result_rows(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of a result set: kept columns, name, place, cells (map header -> text).

    A document that is no JSON, or has no result sets, gives no rows.
    """
    keep = keep or []
    sets = df.select(*keep, F.explode(F.from_json(F.col(json_col), SCHEMA)["resultSets"]).alias("s"))
    rows = sets.select(*keep, F.col("s.name").alias("name"), F.col("s.headers").alias("headers"), F.posexplode("s.rowSet").alias("place", "row"))
    whole = F.size("headers") == F.size("row")
    return rows.where(whole).select(*keep, "name", "place", F.map_from_arrays("headers", "row").alias("cells"))


def frame(rows: DataFrame, name: str, columns: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """The rows of one result set with the given columns and types; what cannot be read as its type is null."""
    return rows.where(F.col("name") == name).select(*(keep or []), *typed(columns))


def typed(columns: Mapping[str, str]) -> list[Column]:
    """The cells of a row by header, as their types."""
    return [F.try_element_at("cells", F.lit(c)).try_cast(t).alias(c) for c, t in columns.items()]


def valid_game(rows: DataFrame, game: str, players: str = "PlayerStats", teams: str = "TeamStats") -> DataFrame:
    """Games with some player rows and exactly two team rows."""
    count = lambda n: F.count_if(F.col("name") == n)
    return rows.groupBy(game).agg(count(players).alias("players"), count(teams).alias("teams")).where("players > 0 and teams = 2").select(game)


def event_time(period: Column, minutes: Column, seconds: Column) -> Column:
    """``P-M:S``, the key of an event within a game."""
    return F.concat(period.cast("string"), F.lit("-"), minutes.cast("string"), F.lit(":"), seconds.cast("string"))
