"""Serve and return dominance at the four early rounds of the largest tournaments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.clean import slam_label
from duelbook.operators.perspectives import perspectives
from duelbook.schema import EARLY_ROUNDS

KEEP = ["match_num", "tourney_id", "tourney_name", "tourney_date", "tourney_level", "round"]


def slam_matches(matches: DataFrame) -> DataFrame:
    """Early rounds of level G."""
    return matches.where((F.col("tourney_level") == "G") & F.col("round").isin(EARLY_ROUNDS))


def serve_return(persp: DataFrame) -> DataFrame:
    """Serve and return points from the player's side; NULL if a part is missing."""
    return persp.withColumns({
        "svpt": F.col("player_svpt").cast("double"),
        "spw": (F.col("player_1stWon") + F.col("player_2ndWon")).cast("double"),
        "retpt": F.col("opponent_svpt").cast("double"),
        "rpw": (F.col("opponent_svpt") - F.col("opponent_1stWon") - F.col("opponent_2ndWon")).cast("double"),
    })


def slam_totals(matches: DataFrame, who: str = "name") -> DataFrame:
    """Point totals per player and tournament, with its label, in one shuffle.

    Missing values are skipped, and a sum of nothing is 0.  Label: the tournament's last contest.
    """
    rows = serve_return(perspectives(slam_matches(matches), who, KEEP))
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("svpt", "spw", "retpt", "rpw")]
    last = F.max_by(F.struct("tourney_name", "tourney_date"), F.struct("tourney_date", "match_num")).alias("last")
    table = rows.groupBy("player", "tourney_id").agg(*sums, last, F.count("*").alias("early_matches"))
    return table.select("player", "tourney_id", "svpt", "spw", "retpt", "rpw", "early_matches", "last.*")


def title_flags(matches: DataFrame, who: str = "name") -> DataFrame:
    """1 where the player won exactly one final of the tournament."""
    won = matches.where(F.col("round") == "F").groupBy(F.col(f"winner_{who}").alias("player"), "tourney_id").agg(
        F.count("*").alias("finals"))
    return won.select("player", "tourney_id", (F.col("finals") == 1).cast("long").alias("title"))


def dominance_ratio(matches: DataFrame, who: str = "name") -> DataFrame:
    """(return share won) / (serve share lost) per player and tournament, all players at once."""
    table = slam_totals(matches, who)
    lost = 1 - F.try_divide(F.col("spw"), F.col("svpt"))
    ratio = F.try_divide(F.try_divide(F.col("rpw"), F.col("retpt")), lost)
    table = table.withColumn("dr", ratio).join(title_flags(matches, who), ["player", "tourney_id"], "left")
    return table.withColumn("title", F.coalesce("title", F.lit(0)))


def dominance_series(matches: DataFrame, player: str | None = None, who: str = "name") -> DataFrame:
    """Date-ordered points with label and axis position, for one player or each of them."""
    table = dominance_ratio(matches, who)
    if player is not None:
        table = table.where(F.col("player") == player)
    by_date = Window.partitionBy("player").orderBy("tourney_date", "tourney_id")
    label = slam_label(F.col("tourney_date"), F.col("tourney_name"))
    return table.select(
        "player", "tourney_id", F.col("tourney_name").alias("tourney"), "tourney_date", "dr", "title",
        label.alias("full_name"), F.row_number().over(by_date).cast("long").alias("axis_position"))


def title_layer(series: DataFrame) -> DataFrame:
    return series.where(F.col("title") == 1)
