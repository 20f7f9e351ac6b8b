"""Train and test splits by exact row position, and samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.position import label_by_cuts, md5_number, md5_rank_key
from duelbook.schema import SURFACES

NO_DATE = 3_000_000  # a day after the last date there is

def split_random(df: DataFrame, identity: list[str], test: float = 0.2, seed: int = 42, by: str | None = None) -> DataFrame:
    """``set`` 'test' for the first ceil(test * n) rows in md5 order, per class with ``by``.

    ``identity`` names whole-number columns that tell rows apart.
    """
    keyed = df.withColumn("_key", md5_number(md5_rank_key(seed, *identity)))
    out = label_by_cuts(keyed, ["_key", *identity], lambda n: [math.ceil(test * n)], ["test", "train"], by)
    return out.drop("_key")


def split_temporal(df: DataFrame, by: str | None = None, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Train, validation and test by position in (date, contest, winner first) order; rows without a date come last.

    Cuts are int(train * n) and int(validation * n), per class with ``by``.
    """
    def cuts(n):
        return [int(train * n), int(train * n) + int(validation * n)]

    day = F.coalesce(F.unix_date("tourney_date").cast("long"), F.lit(NO_DATE).cast("long"))
    keyed = df.withColumns({"_day": day, "_lost": 1 - F.col("target")})
    out = label_by_cuts(keyed, ["_day", "match_num", "_lost"], cuts, ["train", "validation", "test"], by)
    return out.drop("_day", "_lost")


def even_folds(df: DataFrame, identity: list[str], folds: int, seed: int = 42, by: str = "target") -> DataFrame:
    """``fold`` 0 .. folds-1, even in size within each class, in md5 order."""
    keyed = df.withColumn("_key", md5_number(md5_rank_key(seed, *identity)))
    labels = [str(i) for i in range(folds)]
    out = label_by_cuts(keyed, ["_key", *identity], lambda n: [n * i // folds for i in range(1, folds)], labels, by, "fold")
    return out.withColumn("fold", F.col("fold").cast("int")).drop("_key")


def sample_rows(df: DataFrame, identity: list[str], n: int = 8, seed: int = 1) -> DataFrame:
    """``n`` rows in md5 order: a distributed top-n, no full sort."""
    keyed = df.withColumn("_key", md5_rank_key(seed, *identity))
    return keyed.orderBy("_key", *identity).limit(n).drop("_key")


def random_pairs(players: DataFrame, n: int = 3, seed: int = 1) -> DataFrame:
    """``n`` pairings of two different players and a surface.

    The 2n first players in md5 order are taken (a distributed top-n of asked size) and paired by
    position.
    """
    keyed = players.select("player", md5_rank_key(seed, "player").alias("key"))
    chosen = keyed.orderBy("key", "player").limit(2 * n)
    ranked = chosen.withColumn("rn", F.row_number().over(Window.orderBy("key", "player")) - 1)
    pair = F.floor(F.col("rn") / 2).alias("pair")
    pairs = ranked.groupBy(pair).agg(F.min_by("player", "rn").alias("player1"), F.max_by("player", "rn").alias("player2"))
    pairs = pairs.where(F.col("player1") != F.col("player2"))
    # a surface from the first hex digits of the pairing's own md5
    digit = F.conv(F.substring(F.md5(F.concat_ws("-", "player1", "player2", F.lit(str(seed)))), 1, 6), 16, 10).cast("long")
    return pairs.withColumn("surface", F.element_at(F.array(*map(F.lit, SURFACES)), (digit % len(SURFACES) + 1).cast("int")))
