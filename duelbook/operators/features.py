"""Feature rows for the win-probability models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelbook.operators.history import (
    add_surface_rates, attach, h2h, history_view, pair_asof, rate_or_half, surface_asof, surface_record,
)
from duelbook.operators.perspectives import perspectives
from duelbook.schema import START_ELO, SURFACES

FEATURES = [
    "player_elo", "opponent_elo", "elo_diff", "h2h_win_rate", "h2h_matches", "player_surface_win_rate",
    "player_surface_matches", "opponent_surface_win_rate", "opponent_surface_matches",
]
KEY = ["match_num", "tourney_date", "surface"]
RATED_NEEDED = ["winner_name", "loser_name", "surface", "winner_surface_elo", "loser_surface_elo"]


def _asof_sides(df: DataFrame, record: DataFrame, pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Join the daily as-of rows of both players and of the pair to rows ``(first, second, surface, date)``."""
    for column, tag in ((first, "a"), (second, "b")):
        side = record.select(
            F.col("player").alias(column), "surface", "tourney_date",
            F.coalesce("elo_before", F.lit(START_ELO)).alias(f"{tag}_elo"),
            F.col("n_before").alias(f"{tag}_n"), F.col("w_before").alias(f"{tag}_w"))
        df = attach(df, side, [column, "surface", "tourney_date"])
    df = df.withColumn("lo", F.least(first, second)).withColumn("hi", F.greatest(first, second))
    df = attach(df, pairs.withColumnsRenamed({"n_before": "met", "w_before": "met_lo"}), ["lo", "hi", "tourney_date"])
    won = F.when(F.col(first) == F.col("lo"), F.col("met_lo")).otherwise(F.col("met") - F.col("met_lo"))
    return df.withColumn("a_met", won)


def _feature_columns(own: str, other: str, wins):
    return [
        F.col(f"{own}_elo").alias("player_elo"), F.col(f"{other}_elo").alias("opponent_elo"),
        (F.col(f"{own}_elo") - F.col(f"{other}_elo")).alias("elo_diff"),
        rate_or_half(wins, F.col("met")).alias("h2h_win_rate"), F.col("met").alias("h2h_matches"),
        rate_or_half(F.col(f"{own}_w"), F.col(f"{own}_n")).alias("player_surface_win_rate"),
        F.col(f"{own}_n").alias("player_surface_matches"),
        rate_or_half(F.col(f"{other}_w"), F.col(f"{other}_n")).alias("opponent_surface_win_rate"),
        F.col(f"{other}_n").alias("opponent_surface_matches"),
    ]


def features(rated: DataFrame, mode: str = "asof", elo: tuple[str, str] = ("winner_surface_elo", "loser_surface_elo")) -> DataFrame:
    """Feature rows, two per contest.

    ``asof`` reads only earlier dates.  ``full`` takes statistics over all contests, the row's own
    included, and the stored rating.
    """
    valid = rated.dropna(subset=RATED_NEEDED)
    if mode == "full":
        return _full_features(valid)
    narrow = valid.select(
        *KEY, "winner_name", "loser_name", F.col(elo[0]).alias("winner_surface_elo"), F.col(elo[1]).alias("loser_surface_elo"))
    record = surface_asof(history_view(narrow), "player_stored_elo")
    # contests are joined once; the two perspectives are laid out only after the joins
    joined = _asof_sides(narrow, record, pair_asof(narrow), "winner_name", "loser_name")
    lost = F.col("met") - F.col("a_met")
    views = F.array(
        F.struct(F.col("winner_name").alias("player"), F.col("loser_name").alias("opponent"),
                 *_feature_columns("a", "b", F.col("a_met")), F.lit(1).cast("long").alias("target")),
        F.struct(F.col("loser_name").alias("player"), F.col("winner_name").alias("opponent"),
                 *_feature_columns("b", "a", lost), F.lit(0).cast("long").alias("target")))
    return joined.select(*KEY, F.explode(views).alias("v")).select(*KEY, "v.*")


def _full_features(valid: DataFrame) -> DataFrame:
    """Statistics over all contests; contests are joined once, the two perspectives are laid out after the joins."""
    record = surface_record(perspectives(valid, "name", KEY), SURFACES)
    rows = valid.select(*KEY, *RATED_NEEDED[:2], *RATED_NEEDED[3:])
    for column, tag in (("winner_name", "a"), ("loser_name", "b")):
        side = record.select(F.col("player").alias(column), "surface", F.col("win_rate").alias(f"{tag}_rate"), F.col("total").alias(f"{tag}_n"))
        rows = rows.join(side, [column, "surface"], "left")
    w, l = F.col("winner_name"), F.col("loser_name")
    # a contest of a player against itself is one won and one lost
    met = valid.groupBy(F.least(w, l).alias("lo"), F.greatest(w, l).alias("hi")).agg(
        F.sum(F.when(w == l, 2).otherwise(1)).alias("met"), F.sum((w <= l).cast("long")).alias("met_lo"))
    rows = rows.withColumns({"lo": F.least(w, l), "hi": F.greatest(w, l)}).join(met, ["lo", "hi"])
    won = F.when(w == F.col("lo"), F.col("met_lo")).otherwise(F.col("met") - F.col("met_lo"))

    def view(own, other, a, b, wins, target):
        elo, against = F.col(f"{own}_surface_elo"), F.col(f"{other}_surface_elo")
        sides = [(f"{role}_surface_{name}", F.coalesce(f"{tag}_{c}", F.lit(missing)))
                 for role, tag in (("player", a), ("opponent", b)) for name, c, missing in (("win_rate", "rate", 0.5), ("matches", "n", 0))]
        return F.struct(
            F.col(f"{own}_name").alias("player"), F.col(f"{other}_name").alias("opponent"), elo.alias("player_elo"), against.alias("opponent_elo"),
            (elo - against).alias("elo_diff"), rate_or_half(wins, F.col("met")).alias("h2h_win_rate"), F.col("met").alias("h2h_matches"),
            *[column.alias(name) for name, column in sides], F.lit(target).cast("long").alias("target"))

    views = F.array(view("winner", "loser", "a", "b", won, 1), view("loser", "winner", "b", "a", F.col("met") - won, 0))
    return rows.select(*KEY, F.explode(views).alias("v")).select(*KEY, "v.*")


def features_asof(queries: DataFrame, rated: DataFrame) -> DataFrame:
    """Features of pairings ``(query_id, player1, player2, surface, tourney_date)`` not in the history.

    The asked dates enter the daily tables as rows that count for nothing, so the same running
    sums answer them.
    """
    valid = rated.dropna(subset=RATED_NEEDED)
    narrow = valid.select(*KEY, "winner_name", "loser_name", *RATED_NEEDED[3:])
    sides = F.explode(F.array("player1", "player2")).alias("player")
    asked = queries.select(sides, "surface", "tourney_date")
    asked_pairs = queries.select(
        F.least("player1", "player2").alias("lo"), F.greatest("player1", "player2").alias("hi"), "tourney_date")
    record = surface_asof(history_view(narrow), "player_stored_elo", asked)
    pairs = pair_asof(narrow, asked=asked_pairs)
    joined = _asof_sides(queries, record, pairs, "player1", "player2")
    return joined.select(
        *queries.columns, *_feature_columns("a", "b", F.col("a_met")),
        F.col("a_met").alias("h2h_wins"), (F.col("met") - F.col("a_met")).alias("h2h_losses"))


def profile(matches: DataFrame) -> DataFrame:
    """Rank, height and age of both sides; rows with any of the six missing are dropped."""
    names = [f"{role}_{n}" for role in ("player", "opponent") for n in ("rank", "ht", "age")]
    persp = perspectives(matches, "name", KEY)
    return persp.select("match_num", "target", *names).dropna()


def add_profile(frame: DataFrame, matches: DataFrame) -> DataFrame:
    """``frame`` with the profile of its contests, told apart by number, date, surface and both players.

    Numbers may repeat between tournaments; a row of ``frame`` without a profile is left out.
    """
    names = [f"{role}_{n}" for role in ("player", "opponent") for n in ("rank", "ht", "age")]
    same = ["match_num", "player", "opponent", "target"]
    own = perspectives(matches, "name", KEY).dropna(subset=names).select(
        *same, F.col("tourney_date").alias("_date"), F.col("surface").alias("_surface"), *names)
    met = frame.join(own, same).where(F.col("tourney_date").eqNullSafe(F.col("_date")) & F.col("surface").eqNullSafe(F.col("_surface")))
    return met.drop("_date", "_surface")


def rank_features(matches: DataFrame) -> DataFrame:
    """Rank, head-to-head and surface-rate rows over the full history."""
    needed = ["surface", "winner_name", "loser_name", "winner_rank", "loser_rank"]
    everyone = history_view(matches)
    rows = perspectives(matches.dropna(subset=needed), "name", ["match_num", "surface"]).select(
        "match_num", "surface", F.col("player").alias("player1"), F.col("opponent").alias("player2"),
        F.col("player_rank").alias("player1_rank"), F.col("opponent_rank").alias("player2_rank"), "target")
    met = h2h(everyone).select(
        F.col("player").alias("player1"), F.col("opponent").alias("player2"),
        F.col("wins").alias("h2h_wins"), F.col("losses").alias("h2h_losses"))
    rows = rows.join(met, ["player1", "player2"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("h2h_wins", "h2h_losses")})
    return encode_surface(add_surface_rates(rows, surface_record(everyone)))


def add_ratings(pairs: DataFrame, table: DataFrame, columns=("elo_Hard", "elo_Clay", "elo_Grass", "elo_overall")) -> DataFrame:
    """Both players' static ratings by name, the start value where unknown."""
    for side in ("player1", "player2"):
        named = {c: f"{side}_{c.lower()}" for c in columns}
        own = table.select(F.col("name").alias(side), *[F.col(c).alias(n) for c, n in named.items()])
        pairs = pairs.join(own, side, "left")
        pairs = pairs.withColumns({n: F.coalesce(n, F.lit(START_ELO)) for n in named.values()})
    return pairs


def match_stats(matches: DataFrame) -> DataFrame:
    """Each player's own aces and the contest's minutes."""
    persp = perspectives(matches, "name", ["match_num", "minutes"])
    return persp.select("match_num", "player", "target", F.col("player_ace").alias("aces"), "minutes")


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """One 0/1 column per listed value; the source column goes."""
    flags = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("long"), F.lit(0)) for v in values}
    return df.withColumns(flags).drop(column)


def encode_surface(df: DataFrame, unknown: str | None = None) -> DataFrame:
    """Fixed three columns; an unknown surface is 0,0,0 or counts as ``unknown``."""
    surface = F.col("surface")
    if unknown is not None:
        surface = F.when(surface.isin(SURFACES), surface).otherwise(F.lit(unknown))
    return df.withColumns({f"surface_{s}": F.when(surface == s, 1).otherwise(0).cast("long") for s in SURFACES})


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the listed columns in order; a missing one is 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in columns])


def standard_parameters(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column: one aggregate, one row to the driver."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, parameters=None) -> DataFrame:
    """(x - mean) / deviation, fitted on ``fit_on`` (the frame itself by default)."""
    fitted = parameters or standard_parameters(fit_on if fit_on is not None else df, columns)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def class_balance(df: DataFrame) -> DataFrame:
    counts = df.groupBy("target").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the class counts, a row per class
    return counts.select("target", "n", (F.col("n") / total).alias("share"))
