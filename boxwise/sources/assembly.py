"""Games assembled from result sets of many endpoints, and tables of team stats."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.sources.resultset import typed

PLAYER, TEAM = "PLAYER_ID", "TEAM_ID"


def _completeness(frames: list[str], required: Mapping[str, list[str]], teams: str) -> tuple[list[Column], Column]:
    """Counts of a game's rows, and whether these make it whole."""
    of = lambda n: F.col("name") == n
    counts = [F.count_if(of(n)).alias(f"_n{k}") for k, n in enumerate(frames)] + [F.count_if(of(teams)).alias("_teams"), F.count_if(_lacks(required)).alias("_lacking")]
    whole = reduce(lambda a, b: a & b, [F.col(f"_n{k}") > 0 for k in range(len(frames))], F.col("_teams") == 2)
    return counts, whole & (F.col("_lacking") == 0)


def _lacks(required: Mapping[str, list[str]]) -> Column:
    """Whether a row lacks a required column of its frame."""
    lacks = [(F.col("name") == n) & ~F.map_contains_key("cells", c) for n, columns in required.items() for c in columns]
    return reduce(lambda a, b: a | b, lacks, F.lit(False))


def complete_games(rows: DataFrame, game: str, frames: list[str], required: Mapping[str, list[str]], teams: str = "TeamStats") -> DataFrame:
    """Games that have rows of each of ``frames``, just two of ``teams``, and every required column in each row of its frame."""
    counts, whole = _completeness(frames, required, teams)
    return rows.groupBy(game).agg(*counts).where(whole).select(game)


Frames = Mapping[str, Mapping[str, str]]
#: A frame in the order of merging: its name, the key by which it meets the frames before it (if any), and its columns that these lack.
Addition = tuple[str, str | None, list[str]]


def assembled(rows: DataFrame, game: str, player_frames: Frames, team_frames: Frames, required: Mapping[str, list[str]] | None = None, teams: str = "TeamStats") -> tuple[DataFrame, DataFrame]:
    """(players, teams): the frames of complete games side by side, from rows of result sets (``result_rows``).

    ``*_frames``: for each result set its columns and their types. Frames of
    players merge on the game and the player; one whose columns lack the
    player merges on the team instead, and so gives its values to all of the
    team's players. Of columns that clash those of the first frame stay. Rows
    that a frame lacks go, as in an inner join; a game that lacks a frame, has
    other than two team rows, or lacks a required column goes whole. A game's
    rows meet once, as one array for each frame, and merge where they are.
    """
    merges = [_additions(_steps(player_frames, PLAYER)), _additions(_steps(team_frames, TEAM))]
    held = _gathered(rows, game, {**player_frames, **team_frames}, merges, required or {}, teams)
    return tuple(_merged(held, game, additions) for additions in merges)


def assembled_whole(rows: DataFrame, game: str, player_frames: Frames, team_frames: Frames, required: Mapping[str, list[str]] | None = None, teams: str = "TeamStats") -> DataFrame:
    """The players of ``assembled`` beside their teams: the join of both on the game and the team, without a second reading."""
    additions = _additions([*_steps(player_frames, PLAYER), *_steps(team_frames, TEAM)])
    held = _gathered(rows, game, {**player_frames, **team_frames}, [additions], required or {}, teams)
    return _merged(held, game, additions)


def _gathered(rows: DataFrame, game: str, frames: Frames, merges: list[list[Addition]], required: Mapping[str, list[str]], teams: str) -> DataFrame:
    """One row for each complete game with an array of typed rows for each frame, in the frame's name.

    Rows are typed before they are grouped, and have only what ``merges`` read
    of their frame, so that a grouping task holds a few values for each row
    instead of its names and texts.
    """
    read = {(name, c) for additions in merges for name, key, new in additions for c in (key, *new)}
    known = rows.where(F.col("name").isin(list(frames)) & F.col(game).isNotNull())
    cells = []
    for name, columns in frames.items():
        kept = {c: t for c, t in columns.items() if (name, c) in read} or columns  # a row counts even where nothing of it is read
        cells.append(F.when(F.col("name") == name, F.struct(*typed(kept))).alias(f"_{name}"))
    narrow = known.select(game, *cells, F.coalesce(_lacks(required), F.lit(False)).alias("_lacking"))
    held = narrow.groupBy(game).agg(*[F.collect_list(f"_{name}").alias(f"_{name}") for name in frames], F.max("_lacking").alias("_lacking"))
    sizes = [F.size(f"_{name}") > 0 for name in frames] + [F.size(f"_{teams}") == 2 if teams in frames else F.lit(False)]
    return held.where(reduce(lambda a, b: a & b, sizes, ~F.col("_lacking"))).select(game, *[f"_{name}" for name in frames])


def _steps(frames: Frames, key: str) -> list[tuple[str, Mapping[str, str], str]]:
    """(frame, columns, key) in the order of merging: a frame by team comes last, so that the others have brought the team."""
    return [(name, columns, key if key in columns else TEAM) for name, columns in sorted(frames.items(), key=lambda x: key not in x[1])]


def _equal(key: str):
    return lambda s: s[key] == F.col(key)


def _additions(steps: list[tuple[str, Mapping[str, str], str]]) -> list[Addition]:
    """What each step brings to those before it."""
    out, have = [], []
    for name, columns, key in steps:
        new = [c for c in columns if c not in have]
        out.append((name, key if key in have and key in columns else None, new))
        have += new
    return out


def _merged(held: DataFrame, game: str, additions: list[Addition]) -> DataFrame:
    out = held
    for name, key, new in additions:
        met = F.col(f"_{name}")
        if key:
            met = F.filter(met, _equal(key))
        out = out.withColumn("_row", F.explode(met)).withColumns({c: F.col("_row")[c] for c in new})
    return out.select(game, *[c for _, _, new in additions for c in new])


TABLE_SCHEMA = "struct<results struct<collection1 array<map<string,string>>>>"


def team_stats(df: DataFrame, json_col: str, name: str = "TEAM", source: str = "url", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, source, team, stat, value): long rows of scraped tables of team stats.

    ``{"results": {"collection1": [row, ...]}}``, where a row has ``{"text":
    ...}`` by property and the URL of its page. The second row gives the
    properties their names; rows after it count if some value is a number.
    Values that are no number, and rows without a team, give no rows; neither
    does a document that is no such JSON.
    """
    keep = keep or []
    held = df.select(*keep, F.from_json(F.col(json_col), TABLE_SCHEMA)["results"]["collection1"].alias("rows"))
    text = lambda m: F.transform_values(m, lambda k, v: F.when(k == source, v).otherwise(F.get_json_object(v, "$.text")))
    heads = held.select(*keep, text(F.get("rows", F.lit(1))).alias("heads"), F.posexplode("rows").alias("place", "row")).where("place >= 2 and heads is not null")
    cells = heads.select(*keep, "heads", text(F.col("row")).alias("cells"))
    team = F.element_at(F.map_values(F.map_filter("cells", lambda k, v: F.try_element_at(F.col("heads"), k) == name)), 1)
    named = cells.where(F.size(F.map_filter("cells", lambda k, v: F.try_element_at(F.col("heads"), k) == name)) > 0).withColumn("team", team)
    long = named.select(*keep, F.try_element_at("cells", F.lit(source)).alias(source), "team", "heads", F.explode("cells").alias("property", "text"))
    stat = F.try_element_at(F.col("heads"), F.col("property"))
    shown = long.withColumns({"stat": stat, "value": F.col("text").try_cast("double")})
    return shown.where((F.col("property") != source) & F.col("stat").isNotNull() & (F.col("stat") != name) & F.col("value").isNotNull() & F.col("team").isNotNull()).select(*keep, source, "team", "stat", "value")


def season_of_page(url: Column, today: Column) -> Column:
    """The date that a page of stats stands for: 1 July of the year in its address, else today."""
    year = F.regexp_extract(url, r"/year/(\d{4})\b", 1)
    return F.when(year != "", F.make_date(year.try_cast("int"), F.lit(7), F.lit(1))).otherwise(today)
