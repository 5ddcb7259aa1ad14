"""Tables and lists of HTML pages as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Cells(HTMLParser):
    """(table, row, column, is header, text) of every cell; a list is a table of one column."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.table = self.row = self.column = -1
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "ul", "ol"):
            self.table, self.row, self.open = self.table + 1, -1, False
        elif tag in ("tr", "li"):
            self.row, self.column, self.open = self.row + 1, -1, False
        if tag in ("td", "th", "li") and self.table >= 0:
            given = dict(attrs)
            self.column += 1
            self.cells.append([self.table, max(self.row, 0), self.column, tag == "th", "", given.get("data-stat"), given.get("csk")])
            self.open = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "li"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.cells[-1][4] += data


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row per cell: id, table, row, column, header (of its column), text, number (null if it is none).

    The header of a column is the cell's ``data-stat``, else the first row's
    header cell; ``csk``, a sort key, stands for the text where it is given.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, html in zip(batch["id"], batch["html"], strict=True):
                parser = _Cells()
                parser.feed(html or "")
                heads = {(t, c): text.strip() for t, r, c, is_head, text, *_ in parser.cells if is_head and r == 0}
                out += [(key, t, r, c, stat or heads.get((t, c)), (sort or text).strip()) for t, r, c, is_head, text, stat, sort in parser.cells if not (is_head and r == 0)]
            yield pd.DataFrame(out, columns=["id", "table", "row", "column", "header", "text"])

    cells = rows.mapInPandas(parse, f"id {rows.schema['id'].dataType.simpleString()}, table int, row int, column int, header string, text string")
    return cells.withColumnRenamed("id", id_col).withColumn("number", F.col("text").try_cast("double"))


def wide_rows(cells: DataFrame, keys: list[str], headers: list[str]) -> DataFrame:
    """Cells of a known vocabulary of headers as one row for each table row."""
    return cells.groupBy(*keys, "table", "row").pivot("header", headers).agg(F.first("text", ignorenulls=True))
