"""The input contract and the fixed values every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must stay as they are for the results to be right) -------
SURFACES = ["Clay", "Hard", "Grass"]
ALL_SURFACES = ["Clay", "Hard", "Grass", "Carpet"]
ROUND_ORDER = ["RR", "R128", "R64", "R32", "R16", "QF", "SF", "F"]
EARLY_ROUNDS = ["R128", "R64", "R32", "R16"]
SLAM_LABELS = {
    "Wimbledon": "Wimb",
    "US Open": "USO",
    "Us Open": "USO",
    "Australian Open": "AO",
    "Roland Garros": "RG",
}
START_ELO = 1500.0
FIXED_K = 32.0
CAREER_K, CAREER_OFFSET, CAREER_SHAPE = 250.0, 5.0, 0.4
DEFAULT_RANK = 2000
FIRST_YEAR, LAST_YEAR = 1992, 2024
# ---------------------------------------------------------------------------

MATCH_SCHEMA = T.StructType(
    [
        T.StructField("match_num", T.LongType()),
        T.StructField("tour", T.StringType()),
        T.StructField("tourney_id", T.StringType()),
        T.StructField("tourney_name", T.StringType()),
        T.StructField("tourney_level", T.StringType()),
        T.StructField("tourney_date", T.DateType()),
        T.StructField("surface", T.StringType()),
        T.StructField("round", T.StringType()),
        T.StructField("minutes", T.DoubleType()),
        *[
            T.StructField(f"{side}_{name}", kind)
            for side in ("winner", "loser")
            for name, kind in (
                ("id", T.LongType()),
                ("name", T.StringType()),
                ("rank", T.DoubleType()),
                ("ht", T.DoubleType()),
                ("age", T.DoubleType()),
            )
        ],
        *[
            T.StructField(f"{side}_{name}", T.DoubleType())
            for side in ("w", "l")
            for name in ("ace", "svpt", "1stWon", "2ndWon")
        ],
    ]
)

RATING_COLUMNS = ["winner_surface_elo", "loser_surface_elo"]
RATED_SCHEMA = T.StructType(
    MATCH_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in RATING_COLUMNS]
)
RATED_REQUIRED = [
    "winner_name",
    "loser_name",
    "surface",
    "tourney_date",
    "winner_surface_elo",
    "loser_surface_elo",
]


def require_columns(df, columns):
    """Raise before any work starts when a required column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
