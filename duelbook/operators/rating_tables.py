"""Tables derived from rated contests: snapshots, peaks, series, player tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelbook.schema import ALL_SURFACES, START_ELO

ORDER = ["tourney_date", "round_place", "match_num"]


def rating_rows(overall: DataFrame, keys=("tour",)) -> DataFrame:
    """Two rows per contest of ``overall_elo``: player, rating before and after, played before."""
    order = F.struct(*ORDER).alias("seq")
    sides = F.array(*[
        F.struct(
            F.col(f"{s}_id").alias("player"), F.lit(won).alias("win"), F.col(f"{s}_elo_pre").alias("elo_pre"),
            F.col(f"{s}_elo_post").alias("elo_post"), F.col(f"{s}_played").alias("played_before"))
        for s, won in (("winner", 1), ("loser", 0))
    ])
    rows = overall.select(*keys, "tourney_date", order, F.explode(sides).alias("v"))
    return rows.select(*keys, "tourney_date", "seq", "v.*")


def career_counters(rows: DataFrame, keys=("tour",)) -> DataFrame:
    """Contests played and the date of the last one."""
    return rows.groupBy(*keys, "player").agg(
        F.count("*").alias("matches_played"), F.max_by("tourney_date", "seq").alias("last_tourney_date"))


def peaks(rows: DataFrame, keys=("tour",), start: float = START_ELO) -> DataFrame:
    """Highest rating after a win and the first date it was reached, if above the start value."""
    above = (F.col("win") == 1) & (F.col("elo_post") > start)
    # the earliest of equal maxima: take the highest rating, then the smallest order
    best = F.min(F.when(above, F.struct((-F.col("elo_post")).alias("minus"), F.col("seq"), "tourney_date")))
    table = rows.groupBy(*keys, "player").agg(best.alias("best"))
    return table.select(
        *keys, "player", F.coalesce(-F.col("best.minus"), F.lit(start)).alias("peak_elo"),
        F.col("best.tourney_date").alias("peak_elo_date"))


def snapshot(rows: DataFrame, asof=None, keys=("tour",)) -> DataFrame:
    """Each player's last rating at or before a date (all contests if none is given)."""
    if asof is not None:
        rows = rows.where(F.col("tourney_date") <= asof)
    last = F.max_by(F.struct("elo_post", "played_before", "tourney_date"), "seq").alias("last")
    table = rows.groupBy(*keys, "player").agg(last)
    return table.select(
        *keys, "player", F.col("last.elo_post").alias("elo"),
        (F.col("last.played_before") + 1).alias("played"), F.col("last.tourney_date").alias("last_tourney_date"))


def year_end_snapshots(rows: DataFrame, keys=("tour",)) -> DataFrame:
    """The last rating of each player in each year played, one row per (year, player)."""
    last = F.max_by("elo_post", "seq").alias("elo")
    return rows.groupBy(*keys, F.year("tourney_date").cast("long").alias("year"), "player").agg(last)


def player_table(players: DataFrame, rows: DataFrame, start: float = START_ELO) -> DataFrame:
    """The player dimension with current rating, contests played, last date and peak."""
    above = (F.col("win") == 1) & (F.col("elo_post") > start)
    best = F.min(F.when(above, F.struct((-F.col("elo_post")).alias("minus"), F.col("seq"), "tourney_date")))
    state = rows.groupBy("player").agg(
        F.max_by("elo_post", "seq").alias("elo"), F.max_by("tourney_date", "seq").alias("last_tourney_date"),
        F.count("*").alias("n"), best.alias("best"))
    joined = players.join(state, F.col("player_id") == F.col("player"), "left")
    return joined.select(
        *players.columns, F.coalesce("elo", F.lit(start)).alias("current_elo"), "last_tourney_date",
        F.coalesce("n", F.lit(0)).cast("long").alias("matches_played"),
        F.coalesce(-F.col("best.minus"), F.lit(start)).alias("peak_elo"),
        F.col("best.tourney_date").alias("peak_elo_date"))


def active_players(table: DataFrame, start: float = START_ELO) -> DataFrame:
    return table.where(
        (F.col("current_elo") != start) | (F.col("matches_played") > 0) | (F.col("peak_elo") != start))


def top_players(table: DataFrame, n: int = 10) -> DataFrame:
    """Active players by peak, highest first; equal peaks by id."""
    return active_players(table).orderBy(F.desc_nulls_last("peak_elo"), "player_id").limit(n)


def of_players(df: DataFrame, players) -> DataFrame:
    """Rows of the players asked for: a list of ids, a table with ``player``, or None for all."""
    if players is None:
        return df
    if isinstance(players, DataFrame):
        return df.join(players.select("player"), "player", "left_semi")
    return df.where(F.col("player").isin(list(players)))


def rating_series(rows: DataFrame, mode: str = "last", keys=("tour",), players=None) -> DataFrame:
    """Long series (date, player, elo), of ``players`` alone if they are given.

    ``last``: each player's rating after the date's last contest.  ``first``: only the two players
    of the date's very first contest have a value.
    """
    if mode == "last":
        rows = of_players(rows, players)
        return rows.groupBy(*keys, "tourney_date", "player").agg(F.max_by("elo_post", "seq").alias("elo"))
    pair = F.min_by(F.struct("player", "elo_post"), F.struct("seq", F.lit(-1) * F.col("win"))).alias("w")
    other = F.min_by(F.struct("player", "elo_post"), F.struct("seq", "win")).alias("l")
    firsts = rows.groupBy(*keys, "tourney_date").agg(pair, other)
    sides = firsts.select(*keys, "tourney_date", F.explode(F.array("w", "l")).alias("v"))
    return of_players(sides.select(*keys, "tourney_date", F.col("v.player").alias("player"), F.col("v.elo_post").alias("elo")), players)


def wide_series(series: DataFrame, players: list) -> DataFrame:
    """One column per listed player, for the sink."""
    return series.groupBy("tourney_date").pivot("player", players).agg(F.first("elo")).orderBy("tourney_date")


def positions(series: DataFrame, keys=("tour",)) -> DataFrame:
    """``tourney_date, pos, dates``: the place of each date of the series, and how many there are."""
    dates = series.select(*keys, "tourney_date").distinct()
    dates = dates.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("tourney_date")))
    return dates.withColumn("dates", F.count("*").over(Window.partitionBy(*keys)))


def intervals(series: DataFrame, dates: DataFrame, keys=("tour",)) -> DataFrame:
    """``player, first, last, elo, slope``: what is known of each player, one row from value to value.

    Positions ``first`` to ``last`` have ``elo + slope * (pos - first)``.  Before a player's first value there is one row
    without a value; the last one reaches to the end of ``dates``.  There are as many rows as known values and players,
    however many dates lie between.
    """
    known = series.join(dates, [*keys, "tourney_date"])
    of_player = Window.partitionBy(*keys, "player").orderBy("pos")
    steps = known.select(
        *keys, "player", "pos", "elo", "dates", F.lag("pos").over(of_player).alias("previous"),
        F.lead("pos").over(of_player).alias("following"), F.lead("elo").over(of_player).alias("target"))
    slope = F.coalesce((F.col("target") - F.col("elo")) / (F.col("following") - F.col("pos")), F.lit(0.0))
    end = F.coalesce(F.col("following") - 1, F.col("dates").cast("int"))
    nothing = F.lit(None).cast("double")
    own = F.struct(F.col("pos").alias("first"), end.alias("last"), F.col("elo").alias("elo"), slope.alias("slope"))
    ahead = F.struct(F.lit(1).alias("first"), (F.col("pos") - 1).alias("last"), nothing.alias("elo"), nothing.alias("slope"))
    lead_in = F.col("previous").isNull() & (F.col("pos") > 1)
    rows = steps.select(*keys, "player", F.explode(F.when(lead_in, F.array(ahead, own)).otherwise(F.array(own))).alias("v"))
    return rows.select(*keys, "player", "v.*")


def values_at(known: DataFrame, dates: DataFrame, keys=("tour",), width: int = 64) -> DataFrame:
    """The value of each player of ``known`` (``intervals``) at each of ``dates (keys, tourney_date, pos)``.

    A range join by equality: positions lie in buckets of ``width``, an interval is given to the buckets it touches, and
    only dates of a bucket meet its intervals.  Each date meets one interval of a player, so the output is players times
    dates asked, and nothing else is ever made.
    """
    spread = known.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    asked = dates.select(*keys, "tourney_date", "pos", F.floor(F.col("pos") / width).alias("bucket"))
    met = spread.join(asked, [*keys, "bucket"]).where(F.col("pos").between(F.col("first"), F.col("last")))
    return met.select(*keys, "tourney_date", "player", (F.col("elo") + F.col("slope") * (F.col("pos") - F.col("first"))).alias("elo"))


def interpolate(series: DataFrame, keys=("tour",), players=None, dates: DataFrame | None = None) -> DataFrame:
    """A value per player and date of the series, gaps filled linearly by date position.

    Dates before a player's first value stay NULL, dates after the last repeat it.  ``players`` (a list, or a table with
    ``player``) and ``dates`` (a table with ``tourney_date`` and the keys) ask for some players and some of the series'
    dates; positions count all dates all the same.  With neither, each known value writes the positions up to the next
    one, so the grid needs no join of dates and players.
    """
    places = positions(series, keys)
    if players is not None or dates is not None:
        asked = places if dates is None else places.join(dates.select(*keys, "tourney_date"), [*keys, "tourney_date"], "left_semi")
        return values_at(intervals(of_players(series, players), places, keys), asked, keys)
    dates = places
    known = series.join(dates, [*keys, "tourney_date"])
    of_player = Window.partitionBy(*keys, "player").orderBy("pos")
    steps = known.select(
        *keys, "player", "pos", "elo", F.lag("pos").over(of_player).alias("previous"),
        F.lead("pos").over(of_player).alias("following"), F.lead("elo").over(of_player).alias("target"), "dates")
    first = F.when(F.col("previous").isNull(), F.lit(1)).otherwise(F.col("pos"))
    last = F.coalesce(F.col("following") - 1, F.col("dates").cast("int"))
    filled = steps.withColumn("at", F.explode(F.sequence(first, last)))
    line = F.col("elo") + (F.col("target") - F.col("elo")) * (F.col("at") - F.col("pos")) / (F.col("following") - F.col("pos"))
    value = F.when(F.col("at") < F.col("pos"), F.lit(None)).otherwise(F.coalesce(line, "elo"))
    filled = filled.select(*keys, "player", F.col("at").alias("pos"), value.alias("elo"))
    return filled.join(dates.drop("dates"), [*keys, "pos"]).select(*keys, "tourney_date", "player", "elo")


def trim_series(series: DataFrame, table: DataFrame, keys=("tour",)) -> DataFrame:
    """NULL after the player's last contest date."""
    last = table.select(*keys, "player", "last_tourney_date")
    joined = series.join(last, [*keys, "player"], "left")
    kept = F.when(F.col("tourney_date") > F.col("last_tourney_date"), F.lit(None)).otherwise(F.col("elo"))
    return joined.select(*keys, "tourney_date", "player", kept.alias("elo"))


def player_history(rated: DataFrame, player: str | None = None) -> DataFrame:
    """Surface ratings of a player over time, both roles, by id.

    A name stands for the id of its first win; with no name, every winner's history is returned.
    """
    ids = rated.where(F.col("winner_name").isNotNull())
    if player is not None:
        ids = ids.where(F.col("winner_name") == player)
    ids = ids.groupBy(F.col("winner_name").alias("name")).agg(F.min_by("winner_id", "match_num").alias("player"))
    sides = F.array(
        F.struct(F.col("winner_id").alias("player"), F.col("winner_surface_elo").alias("surface_elo")),
        F.struct(F.col("loser_id").alias("player"), F.col("loser_surface_elo").alias("surface_elo")))
    rows = rated.select("match_num", "tourney_date", "surface", F.explode(sides).alias("v"))
    rows = rows.select("match_num", "tourney_date", "surface", "v.*")
    return ids.join(rows, "player").select("name", "tourney_date", "surface", "surface_elo", "match_num")


def surface_table(rated: DataFrame) -> DataFrame:
    """Long table (name, surface, elo, matches): last stored rating and contests on each surface."""
    sides = F.array(
        F.struct(F.col("winner_name").alias("name"), F.col("winner_surface_elo").alias("elo"), F.lit(0).alias("role")),
        F.struct(F.col("loser_name").alias("name"), F.col("loser_surface_elo").alias("elo"), F.lit(1).alias("role")))
    rows = rated.where(F.col("surface").isNotNull()).select(
        "match_num", "surface", (F.col("winner_name") == F.col("loser_name")).alias("alone"), F.explode(sides).alias("v"))
    once = ~(F.coalesce("alone", F.lit(False)) & (F.col("v.role") == 1))
    return rows.groupBy(F.col("v.name").alias("name"), "surface").agg(
        F.max_by("v.elo", F.struct("match_num", "v.role")).alias("elo"), F.count_if(once).alias("matches"))


def latest_ratings(rated: DataFrame) -> DataFrame:
    return surface_table(rated).select("name", "surface", "elo")


def match_counts(rated: DataFrame) -> DataFrame:
    return surface_table(rated).select("name", "surface", "matches")


def weighted_overall(table: DataFrame) -> DataFrame:
    """Contest-weighted mean of the surface ratings; NULL when there is nothing to weigh."""
    counts = F.col("elo").isNotNull() & (F.col("matches") > 0)
    weight = F.sum(F.when(counts, F.col("matches")))
    total = F.sum(F.when(counts, F.col("elo") * F.col("matches")))
    return table.groupBy("name").agg(F.try_divide(total, weight).alias("elo_overall"))


def player_ratings(rated: DataFrame, surfaces=ALL_SURFACES) -> DataFrame:
    """Wide table: ``elo_<S>``, ``matches_<S>`` and ``elo_overall`` per name, in one grouping."""
    table = surface_table(rated)
    counts = F.col("elo").isNotNull() & (F.col("matches") > 0)
    columns = []
    for s in surfaces:
        here = F.col("surface") == s
        columns.append(F.max(F.when(here, F.col("elo"))).alias(f"elo_{s}"))
        columns.append(F.coalesce(F.max(F.when(here, F.col("matches"))), F.lit(0)).alias(f"matches_{s}"))
    overall = F.try_divide(
        F.sum(F.when(counts, F.col("elo") * F.col("matches"))), F.sum(F.when(counts, F.col("matches"))))
    return table.groupBy("name").agg(*columns, overall.alias("elo_overall"))


def top_overall(table: DataFrame, n: int = 5) -> DataFrame:
    return table.orderBy(F.desc_nulls_last("elo_overall"), "name").limit(n)
