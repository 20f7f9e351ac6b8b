"""Result pages to odds rows: a walk over a page's tags with a stack of what is open."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.functions.names import split_pair

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get the walk below whole

# fixed values: what a results page looks like, and the tags that hold nothing
FRAME_ID, TABLE_CLASS, NAME_CLASS, ODDS_CLASS = "tournamentTabs-1-data", "result", "t-name", "course"
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
SILENT = ["script", "style"]
FOUND = "array<struct<name:string,odds:array<string>>>"


class ResultRows(HTMLParser):
    """The rows of the first results table inside the results frame, each with its name and its odds as texts.

    An end tag closes the last open tag of its name and all inside it; one that nothing opened is passed over.  A cell's
    text is its pieces, trimmed, in a row; entities are resolved.  A row of a table inside a row is a row too, and its cells
    are the outer row's as well.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, object]] = []  # (tag, what it is)
        self.rows: list[dict] = []
        self.frames = self.bodies = 0
        self.inside = self.done = False

    def handle_starttag(self, tag, attributes):
        given = {k: v or "" for k, v in reversed(attributes)}  # the first of equal attributes counts
        classes, kind = given.get("class", "").split(), None
        if tag == "div" and given.get("id") == FRAME_ID:
            kind = "frame"
            self.frames += 1
        elif tag == "table" and TABLE_CLASS in classes and self.frames and not self.inside and not self.done:
            kind, self.inside = "table", True
        elif tag == "tbody":
            kind = "body"
            self.bodies += 1
        elif self.inside and tag == "tr" and self.bodies:
            kind = {"name": None, "odds": []}
            self.rows.append(kind)
        elif self.inside and tag == "td" and (NAME_CLASS in classes or ODDS_CLASS in classes):
            kind = []
            for row in (x for _, x in self.open if isinstance(x, dict)):
                if NAME_CLASS in classes and row["name"] is None:
                    row["name"] = kind
                if ODDS_CLASS in classes:
                    row["odds"].append(kind)
        if tag not in VOID:
            self.open.append((tag, kind))

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if all(tag != name for name, _ in self.open):
            return
        while True:
            name, kind = self.open.pop()
            if kind == "frame":
                self.frames -= 1
            elif kind == "body":
                self.bodies -= 1
            elif kind == "table":
                self.inside, self.done = False, True
            if name == tag:
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not (self.open and self.open[-1][0] in SILENT):
            for _, kind in self.open:
                if isinstance(kind, list):
                    kind.append(text)


def result_rows(page: str | None) -> list[dict]:
    walk = ResultRows()
    walk.feed(page or "")
    walk.close()
    return [{"name": "".join(row["name"]), "odds": ["".join(o) for o in row["odds"]]} for row in walk.rows if row["name"] is not None]


def _rows_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda page: result_rows(page if isinstance(page, str) else None))


def extract_odds(pages: DataFrame, html: str = "html", sep: str = r"\s*-\s*") -> DataFrame:
    """(page columns, player1, player2, odd1, odd2) per pairing of the first results table.

    Both odds are NULL unless there are exactly two and both are numbers; a row whose name does
    not split in exactly two is dropped.
    """
    others = [c for c in pages.columns if c != html]
    found = pages.select(*others, F.explode(F.pandas_udf(_rows_of, FOUND)(F.col(html))).alias("row"))
    cells = found.select(
        *others, split_pair(F.col("row.name"), sep).alias("pair"),
        F.transform("row.odds", lambda c: F.trim(c).try_cast("double")).alias("odds"))
    both = (F.size("odds") == 2) & F.get("odds", F.lit(0)).isNotNull() & F.get("odds", F.lit(1)).isNotNull()
    return cells.where(F.col("pair").isNotNull()).select(
        *others, F.col("pair")[0].alias("player1"), F.col("pair")[1].alias("player2"),
        F.when(both, F.get("odds", F.lit(0))).alias("odd1"), F.when(both, F.get("odds", F.lit(1))).alias("odd2"))
