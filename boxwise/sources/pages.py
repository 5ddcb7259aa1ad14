"""Typed rows of the named tables of statistics pages, those inside comments too."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.functions.scalars import fraction, minutes

# The columns of the tables by their data-stat, and how each is read.
_COUNTS = ["fg", "fga", "fg3", "fg3a", "ft", "fta", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts"]
BASIC = {"player": "text", "mp": "minutes", **dict.fromkeys(_COUNTS, "number")}
FACTORS = {"team_id": "text", "pace": "number", "efg_pct": "number", "tov_pct": "number", "orb_pct": "number", "ft_rate": "number", "off_rtg": "number"}
ON_OFF = {"split_id": "text", "team_id": "text", "mp": "minutes", "diff_pts": "number", "diff_efg_pct": "percent", "diff_trb_pct": "percent", "diff_off_rtg": "number"}
TWO_MAN = {"lineup": "text", "team_id": "text", "mp": "minutes", "diff_pts": "number", "diff_fg": "number"}
ADVANCED = {"season": "text", "team_id": "text", "mp": "number", "per": "number", "usg_pct": "number", **{f"pct_{k}": "percent" for k in range(1, 6)}}


class _Named(HTMLParser):
    """Cells of tables with an id: [table, row, data-stat, text, sort key, link]; comments are read as pages of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.tables: list[str | None] = []  # ids of the tables that are open
        self.rows: dict[str, int] = {}
        self.open = False
        self.body = False

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "table":
            self.tables.append(given.get("id"))
            self.open = False
        elif not self.tables or self.tables[-1] is None:
            return
        elif tag == "tr":
            self.rows[self.tables[-1]] = self.rows.get(self.tables[-1], -1) + 1
            self.body, self.open = "thead" not in (given.get("class") or "").split(), False
        elif tag in ("td", "th"):
            self.open = bool(given.get("data-stat")) and self.body
            if self.open:
                self.cells.append([self.tables[-1], self.rows.setdefault(self.tables[-1], 0), given["data-stat"], "", given.get("csk"), None])
        elif tag == "a" and self.open and given.get("href"):
            self.cells[-1][5] = self.cells[-1][5] or given["href"]

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.open = False
        elif tag == "table" and self.tables:
            self.tables.pop()
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.cells[-1][3] += data

    def handle_comment(self, data):
        if "<table" in data:
            inner = _Named()
            inner.feed(data)
            self.cells += inner.cells


def named_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row per cell of the tables that have an id: id, table, row, stat, text, csk, link.

    A cell counts by its ``data-stat``; rows of class ``thead`` are headings.
    Tables in comments count as those outside; where an id comes twice, the
    rows of both are there. Markup that is cut off gives the cells before the
    cut; a null page gives none.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, html in zip(batch["id"], batch["html"], strict=True):
                parser = _Named()
                parser.feed(html or "")
                out += [(key, t, r, stat, text.strip(), csk, link) for t, r, stat, text, csk, link in parser.cells]
            yield pd.DataFrame(out, columns=["id", "table", "row", "stat", "text", "csk", "link"]).astype(object)

    cells = rows.mapInPandas(parse, f"id {rows.schema['id'].dataType.simpleString()}, table string, row int, stat string, text string, csk string, link string")
    return cells.withColumnRenamed("id", id_col)


def read_as(kind: str, text: Column) -> Column:
    """number, percent (``12.5%`` or ``+3%`` as a fraction), minutes (``MM:SS`` or plain; 0 for who did not play), or text; null where it cannot be read."""
    blank = F.when(text != "", text)
    if kind == "number":
        return F.regexp_replace(blank, r"^\+", "").try_cast("double")
    if kind == "percent":
        return fraction(blank)
    if kind == "minutes":
        return F.when(text.rlike("(?i)did not|dnp|suspended|inactive|not with"), F.lit(0.0)).when(text.rlike(r"^\d+:\d\d$"), minutes(text)).otherwise(blank.try_cast("double"))
    if kind == "text":
        return blank
    raise ValueError(f"no kind {kind}")


def typed_table(cells: DataFrame, id_col: str, table: str, columns: Mapping[str, str], links: list[str] | None = None) -> DataFrame:
    """One row for each row of a table (a pattern of its id): id, table, row, the given columns as their kinds, and ``*_link`` of ``links``.

    A cell that a row lacks, or that cannot be read, is null; a row that has
    none of the columns is left out. A cell that spans (``mp`` of a player who
    did not play) is read as its own kind says.
    """
    own = cells.where(F.col("table").rlike(f"^(?:{table})$") & F.col("stat").isin(list(columns) + ["reason"]))
    value = lambda c, part: F.max(F.when(F.col("stat") == c, F.col(part)))
    rows = own.groupBy(id_col, "table", "row").agg(*[value(c, "text").alias(c) for c in columns], value("reason", "text").alias("_reason"), *[value(c, "link").alias(f"{c}_link") for c in links or []])
    shown = [read_as(k, F.coalesce(F.col(c), F.col("_reason")) if k == "minutes" else F.col(c)).alias(c) for c, k in columns.items()]
    return rows.select(id_col, "table", "row", *shown, *[f"{c}_link" for c in links or []])


def id_in_link(link: Column) -> Column:
    """The id that a link ends in: ``/players/c/curryst01.html`` gives ``curryst01``, ``/teams/GSW/2015.html`` gives ``GSW``."""
    player, team = F.regexp_extract(link, r"/([a-z]+\d\d)\.html", 1), F.regexp_extract(link, r"/teams/([A-Z]{3})\b", 1)
    return F.when(player != "", player).when(team != "", team)
