"""Rating formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelbook.schema import CAREER_K, CAREER_OFFSET, CAREER_SHAPE, FIXED_K


def expected_score(own: Column, other: Column) -> Column:
    """Chance that ``own`` beats ``other`` on the logistic base-10 scale of width 400."""
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


def elo_update(winner: Column, loser: Column, k: float = FIXED_K) -> tuple[Column, Column]:
    """Both ratings after one contest under a fixed K."""
    gain = k * (1 - expected_score(winner, loser))
    return winner + gain, loser - gain


def k_factor(played: Column) -> Column:
    """K that shrinks with the number of contests played before this one."""
    return F.lit(CAREER_K) / F.pow(played + CAREER_OFFSET, F.lit(CAREER_SHAPE))
