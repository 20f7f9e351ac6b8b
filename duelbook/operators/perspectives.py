"""Two rows per contest: the winner's view and the loser's view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = ["ace", "svpt", "1stWon", "2ndWon"]
PROFILE = ["rank", "ht", "age"]


def _side(df: DataFrame, who: str, own: str, other: str, target: int, extra: list[str]):
    """One view of the contest as a struct; optional columns are taken when the input has them."""
    fields = [
        F.col(f"{own}_{who}").alias("player"),
        F.col(f"{other}_{who}").alias("opponent"),
        F.lit(target).cast("long").alias("target"),
    ]
    fields += [F.col(c) for c in extra]
    have = set(df.columns)
    for role, side in (("player", own), ("opponent", other)):
        if f"{side}_surface_elo" in have:
            fields.append(F.col(f"{side}_surface_elo").alias(f"{role}_stored_elo"))
        for name in PROFILE:
            if f"{side}_{name}" in have:
                fields.append(F.col(f"{side}_{name}").alias(f"{role}_{name}"))
        for name in STATS:
            if f"{side[0]}_{name}" in have:
                fields.append(F.col(f"{side[0]}_{name}").alias(f"{role}_{name}"))
    return F.struct(*fields)


def perspectives(matches: DataFrame, who: str = "name", keep: list[str] | None = None) -> DataFrame:
    """``target`` 1 for the winner's row and 0 for the loser's, from a single scan.

    ``keep`` names the contest columns to carry over; columns no one reads are pruned from the
    scan all the same.
    """
    own = [f"{side}_{name}" for side in ("winner", "loser") for name in ["id", "name", "surface_elo", *PROFILE]]
    own += [f"{side}_{name}" for side in ("w", "l") for name in STATS]
    extra = keep if keep is not None else [c for c in matches.columns if c not in own]
    views = F.array(
        _side(matches, who, "winner", "loser", 1, extra),
        _side(matches, who, "loser", "winner", 0, extra),
    )
    return matches.select(F.explode(views).alias("view")).select("view.*")
