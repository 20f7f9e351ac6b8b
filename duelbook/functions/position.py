"""Positions in a total order, found without sorting or shuffling the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.session import scratch_path

PIECES = 4096  # ranges counted per pass; also the most rows a pass hands to the driver per class
SMALL = 200_000  # rows that may be sorted to read off the answer


def md5_rank_key(seed, *columns: str) -> Column:
    """A reproducible shuffle key: the md5 of the row's identity and a seed."""
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def md5_number(key: Column) -> Column:
    """The first 15 hex digits as a whole number: the same order as the text."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def _holding(counts: list[tuple[int, int]], position: int) -> tuple[int, int, int]:
    """The range a position falls in, its position inside, and the rows of that range."""
    for piece, rows in sorted(counts):
        if position < rows:
            return piece, position, rows
        position -= rows
    raise IndexError(position)


def keys_at(df: DataFrame, order: list[str], wanted: dict[int, list[int]], group: str, small: int = SMALL, pieces: int = PIECES) -> dict:
    """The ``order`` values at 0-based positions within each group: ``{(group, position): row}``.

    ``df`` has whole-number columns alone.  Every position is followed by a bracket of rows: a value for the columns that are
    settled and a range of the next one.  A pass narrows all brackets of all groups together, with two aggregates; brackets
    of few rows are sorted together at the end.
    """
    open_ = [{"group": g, "position": p, "at": p, "fixed": {}, "column": 0, "lo": None, "hi": None} for g, ps in wanted.items() for p in ps]
    known: dict = {}

    def rows_of(bracket):
        condition = F.col(group) == F.lit(bracket["group"])
        for column, value in bracket["fixed"].items():
            condition = condition & (F.col(column) == value)
        if bracket["lo"] is not None:
            condition = condition & F.col(order[bracket["column"]]).between(bracket["lo"], bracket["hi"])
        return condition

    while open_:
        # brackets that are the same hold several positions and are counted once
        same: dict = {}
        for bracket in open_:
            same.setdefault((bracket["group"], tuple(bracket["fixed"].items()), bracket["column"], bracket["lo"], bracket["hi"]), []).append(bracket)
        distinct = [held[0] for held in same.values()]
        number = F.array(*[F.when(rows_of(b), F.lit(i)) for i, b in enumerate(distinct)])
        near = df.select(*order, F.explode(F.array_compact(number)).alias("bracket"))
        lead = F.coalesce(*[F.when(F.col("bracket") == i, F.col(order[b["column"]])) for i, b in enumerate(distinct)])
        ends = {r.bracket: r for r in near.groupBy("bracket").agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"), F.count("*").alias("n")).collect()}
        few, many = [], []
        for i, b in enumerate(distinct):
            if b["column"] == len(order) - 1 and ends[i].lo == ends[i].hi:  # equal rows, however many
                for own in list(same.values())[i]:
                    known[own["group"], own["position"]] = b["fixed"] | {order[-1]: ends[i].lo}
            else:
                (few if ends[i].n <= small else many).append(i)
        if few:
            chosen = near.where(F.col("bracket").isin(few))
            place = F.row_number().over(Window.partitionBy("bracket").orderBy(*order)) - 1
            asked = F.lit(False)
            for i in few:
                asked = asked | ((F.col("bracket") == i) & F.col("place").isin([b["at"] for b in list(same.values())[i]]))
            found = {(r.bracket, r.place): r for r in chosen.withColumn("place", place).where(asked).collect()}
            for i in few:
                for b in list(same.values())[i]:
                    known[b["group"], b["position"]] = {c: found[i, b["at"]][c] for c in order}
        flat = [i for i in many if ends[i].lo == ends[i].hi]  # one value: go on with the next column
        wide = [i for i in many if i not in flat]
        counts: dict[int, list[tuple[int, int]]] = {i: [] for i in wide}
        if wide:
            width = {i: -(-(ends[i].hi - ends[i].lo + 1) // pieces) for i in wide}
            piece = F.coalesce(*[F.when(F.col("bracket") == i, F.expr(f"(lead - {ends[i].lo}L) div {width[i]}L")) for i in wide])
            for r in near.where(F.col("bracket").isin(wide)).withColumn("lead", lead).groupBy("bracket", piece.alias("piece")).count().collect():
                counts[r.bracket].append((r.piece, r["count"]))
        open_ = []
        for i, held in enumerate(same.values()):
            for b in held if i in many else []:
                column = order[b["column"]]
                if i in flat:
                    open_.append(b | {"fixed": b["fixed"] | {column: ends[i].lo}, "column": b["column"] + 1, "lo": None, "hi": None})
                else:
                    piece, at, _ = _holding(counts[i], b["at"])
                    first = ends[i].lo + piece * width[i]
                    open_.append(b | {"at": at, "lo": first, "hi": first + width[i] - 1})
    return known


def key_at(df: DataFrame, order: list[str], position: int, small: int = SMALL, pieces: int = PIECES) -> tuple:
    """The ``order`` values of the row at a 0-based position of a whole table."""
    found = keys_at(df.select(F.lit(0).alias("_group"), *order), order, {0: [position]}, "_group", small, pieces)
    return tuple(found[0, position][c] for c in order)


def label_by_cuts(df: DataFrame, order: list[str], cuts, labels: list[str], by: str | None = None, name: str = "set") -> DataFrame:
    """Label rows by position: ``labels[i]`` up to the i-th cut, the last label beyond.

    ``cuts(n)`` gives the cut positions for ``n`` rows, counted per class of ``by``.  The order columns are written once,
    alone, and passed over a few times for all classes and cuts together; every row is then labelled where it is.  Rows
    with a NULL class are one class.
    """
    spark = df.sparkSession
    classes = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    path = scratch_path(spark, "order")
    df.select(classes.alias("_class"), *order).write.parquet(path)
    narrow = spark.read.parquet(path)
    sizes = {r["_class"]: r["count"] for r in narrow.groupBy("_class").count().collect()}
    inside = {c: [p for p in cuts(n) if 0 < p < n] for c, n in sizes.items()}
    at = keys_at(narrow, order, inside, "_class")
    key, label = F.struct(*order), F.lit(labels[-1])
    for c, n in sizes.items():
        own = F.lit(labels[-1])
        for cut, text in reversed(list(zip(cuts(n), labels))):
            if cut >= n:
                own = F.lit(text)
            elif cut > 0:
                own = F.when(key < F.struct(*[F.lit(at[c, cut][x]).cast("long").alias(x) for x in order]), text).otherwise(own)
        label = F.when(classes == c, own).otherwise(label)
    return df.withColumn(name, label)
