"""Typing, cleaning and predicates over contest tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.schema import DEFAULT_RANK, ROUND_ORDER, SLAM_LABELS, START_ELO, SURFACES


def parse_date(raw: Column, coerce: bool = False) -> Column:
    """``YYYYMMDD`` (int or text) to a date; bad input raises, or is NULL with ``coerce``."""
    text = raw.cast("string")
    parsed = F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
    if coerce:
        return parsed
    bad = F.raise_error(F.concat(F.lit("not a YYYYMMDD date: "), text))
    return F.when(text.isNotNull() & parsed.isNull(), bad.cast("date")).otherwise(parsed)


def to_numeric(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Per-value coercion: what does not read as a number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in columns})


def valid_matches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows with a value in every listed column (all columns if none is listed)."""
    return df.dropna(subset=columns)


def with_defaults(df: DataFrame, ratings=(), ranks=()) -> DataFrame:
    """Fill missing ratings and ranks with their start values."""
    filled = {c: F.coalesce(c, F.lit(START_ELO)) for c in ratings}
    filled |= {c: F.coalesce(c, F.lit(DEFAULT_RANK)) for c in ranks}
    return df.withColumns(filled)


def surfaces(df: DataFrame, keep_null: bool = True) -> DataFrame:
    found = df.select("surface").distinct()
    return found if keep_null else found.dropna()


def players(df: DataFrame, who: str = "name") -> DataFrame:
    """Distinct players over both roles, from one scan."""
    both = F.explode(F.array(f"winner_{who}", f"loser_{who}")).alias("player")
    return df.select(both).dropna().distinct()


def drop_like(df: DataFrame, fragment: str) -> DataFrame:
    """Drop every column whose name contains ``fragment``, ignoring case."""
    return df.drop(*[c for c in df.columns if fragment.lower() in c.lower()])


def valid_surface(surface: Column, default: str = "Hard") -> Column:
    return F.when(surface.isin(SURFACES), surface).otherwise(F.lit(default))


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.create_map(*pairs)[key]


def round_order(name: Column) -> Column:
    """Position of a round in its fixed order; unknown rounds are NULL."""
    return _lookup({r: i for i, r in enumerate(ROUND_ORDER)}, name).cast("long")


def slam_label(date: Column, name: Column) -> Column:
    """``2024 Wimb`` style label; NULL for a tournament outside the code table."""
    return F.concat(F.year(date).cast("string"), F.lit(" "), _lookup(SLAM_LABELS, name))


def format_h2h(wins: Column, losses: Column, name: Column) -> Column:
    """``w-l (P% para name)``, or a fixed text when they never met."""
    meetings = wins + losses
    # half-even, the rounding of Python's % format
    share = F.bround(F.try_divide(wins, meetings) * 100, 0).cast("long")
    text = F.format_string("%d-%d (%d%% para %s)", wins, losses, share, name)
    return F.when(meetings == 0, F.lit("Igual (sem confrontos anteriores)")).otherwise(text)
