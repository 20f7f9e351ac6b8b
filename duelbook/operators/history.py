"""Head-to-head, surface records and as-of values.

As-of values never window over single contests: contests are first counted per player (or pair)
and date, combined before the shuffle, then the small daily rows are summed up in date order, and
each contest reads the row of its own date.  A player with a large share of all contests is
thus one row per date, and contests of the same date never see each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.operators.perspectives import perspectives
from duelbook.schema import DEFAULT_RANK, START_ELO, SURFACES


def rate_or_half(wins: Column, total: Column) -> Column:
    """Share of wins, 0.5 where there is nothing to count."""
    return F.coalesce(F.try_divide(wins, total), F.lit(0.5))


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where NULL meets NULL, so that no row of ``df`` is lost; keys come once."""
    named = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(named, same, "left").drop(*[f"_{k}" for k in keys])


# --- full history -----------------------------------------------------------

def h2h(persp: DataFrame) -> DataFrame:
    """Wins and losses for every ordered pair that met."""
    return persp.groupBy("player", "opponent").agg(
        F.sum("target").alias("wins"), F.sum(1 - F.col("target")).alias("losses"))


def h2h_rates(record: DataFrame) -> DataFrame:
    total = F.col("wins") + F.col("losses")
    return record.withColumn("h2h_matches", total).withColumn("h2h_win_rate", rate_or_half(F.col("wins"), total))


def surface_record(persp: DataFrame, surfaces=None) -> DataFrame:
    """Wins, losses, total and rate per player and surface; optionally only the listed surfaces."""
    if surfaces is not None:
        persp = persp.where(F.col("surface").isin(surfaces))
    record = persp.groupBy("player", "surface").agg(
        F.sum("target").alias("wins"), F.sum(1 - F.col("target")).alias("losses"))
    total = F.col("wins") + F.col("losses")
    return record.withColumn("total", total).withColumn("win_rate", rate_or_half(F.col("wins"), total))


def h2h_lookup(pairs: DataFrame, persp: DataFrame, date: str | None = None) -> DataFrame:
    """Record of each (player1, player2), before the pair's own ``date`` column if one is named.

    Pairs that never met get 0-0.
    """
    if date is None:
        known = h2h(persp).select(
            F.col("player").alias("player1"), F.col("opponent").alias("player2"), "wins", "losses")
        joined = pairs.join(known, ["player1", "player2"], "left")
        return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("wins", "losses")})
    keys = ["player", "opponent"]
    asked = pairs.select(F.col("player1").alias("player"), F.col("player2").alias("opponent"), F.col(date).alias("tourney_date"))
    table = _before(_counted(persp, keys), keys, asked)
    table = table.select(
        F.col("player").alias("player1"), F.col("opponent").alias("player2"), F.col("tourney_date").alias(date),
        F.col("w_before").alias("wins"), (F.col("n_before") - F.col("w_before")).alias("losses"))
    joined = attach(pairs, table, ["player1", "player2", date])
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("wins", "losses")})


# --- strictly before a date ---------------------------------------------------

def _counted(persp: DataFrame, keys: list[str], elo: str | None = None) -> DataFrame:
    rows = [*keys, "tourney_date", F.lit(1).alias("n"), F.col("target").alias("w")]
    return persp.select(*rows, F.col(elo).alias("elo"), "match_num") if elo else persp.select(*rows)


def _before(counted: DataFrame, keys: list[str], asked: DataFrame | None = None) -> DataFrame:
    """Per key and date, what the earlier dates add up to: ``n_before``, ``w_before``, ``elo_before``.

    No date is known to be before a NULL date, nor a NULL date before another: such rows read nothing
    and count for nothing.

    ``asked`` adds dates to answer for: rows that count for nothing, in the same grouping.
    """
    carries = "elo" in counted.columns
    if asked is not None:
        blank = asked.select(*keys, "tourney_date", F.lit(0).alias("n"), F.lit(0).cast("long").alias("w"))
        counted = counted.unionByName(blank, allowMissingColumns=True)
    sums = [F.sum("n").alias("n"), F.sum("w").alias("w")]
    if carries:
        sums.append(F.max_by("elo", "match_num").alias("last_elo"))
    daily = counted.groupBy(*keys, "tourney_date").agg(*sums)
    earlier = Window.partitionBy(*keys).orderBy("tourney_date").rowsBetween(Window.unboundedPreceding, -1)
    dated = F.col("tourney_date").isNotNull()
    columns = [F.coalesce(F.sum(F.when(dated, F.col(c))).over(earlier), F.lit(0)).cast("long").alias(f"{c}_before") for c in ("n", "w")]
    if carries:
        columns.append(F.last(F.when(dated, F.col("last_elo")), ignorenulls=True).over(earlier).alias("elo_before"))
    return daily.select(*keys, "tourney_date", *columns)


def surface_asof(persp: DataFrame, elo: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Per player, surface and date: contests, wins and (optionally) the rating before the date."""
    keys = ["player", "surface"]
    return _before(_counted(persp, keys, elo), keys, asked)


def pair_asof(matches: DataFrame, who: str = "name", asked: DataFrame | None = None) -> DataFrame:
    """Per unordered pair and date: meetings before the date and those the smaller key won."""
    w, l = F.col(f"winner_{who}"), F.col(f"loser_{who}")
    met = matches.select(
        F.least(w, l).alias("lo"), F.greatest(w, l).alias("hi"), "tourney_date", (w <= l).cast("long").alias("target"))
    keys = ["lo", "hi"]
    return _before(_counted(met, keys), keys, asked)


def h2h_before(persp: DataFrame) -> DataFrame:
    """Each row with its player's wins and losses against the opponent before the date."""
    keys = ["player", "opponent"]
    table = _before(_counted(persp, keys), keys)
    joined = attach(persp, table, [*keys, "tourney_date"])
    return joined.withColumn("h2h_wins", F.col("w_before")).withColumn(
        "h2h_losses", F.col("n_before") - F.col("w_before")).drop("w_before", "n_before")


def surface_before(persp: DataFrame) -> DataFrame:
    """Each row with its player's record on the surface before the date."""
    joined = attach(persp, surface_asof(persp), ["player", "surface", "tourney_date"])
    return joined.withColumn("surface_win_rate", rate_or_half(F.col("w_before"), F.col("n_before"))).withColumnRenamed(
        "n_before", "surface_matches").withColumnRenamed("w_before", "surface_wins")


def rating_before(persp: DataFrame, elo: str = "player_stored_elo", start: float = START_ELO) -> DataFrame:
    """Each row with the rating attached to its player's last earlier-date contest on the surface.

    ``elo`` names the attached value: the stored pre-contest rating, or a post-contest one.
    """
    table = surface_asof(persp, elo).select("player", "surface", "tourney_date", "elo_before")
    joined = attach(persp, table, ["player", "surface", "tourney_date"])
    return joined.withColumn("elo_before", F.coalesce("elo_before", F.lit(start)))


def latest_date(pairs: DataFrame, persp: DataFrame) -> DataFrame:
    """For each pair the last date either player is seen, NULL if neither is."""
    last = persp.groupBy("player").agg(F.max("tourney_date").alias("seen"))
    for side in ("player1", "player2"):
        named = last.select(F.col("player").alias(side), F.col("seen").alias(f"{side}_seen"))
        pairs = pairs.join(named, side, "left")
    return pairs.withColumn("latest_date", F.greatest("player1_seen", "player2_seen")).drop("player1_seen", "player2_seen")


def known_pairs(pairs: DataFrame, persp: DataFrame, reject: bool = False) -> DataFrame:
    """Pairs with both players in the history, or the others with ``reject``."""
    seen = persp.select("player").distinct()
    first = seen.withColumnRenamed("player", "player1")
    second = seen.withColumnRenamed("player", "player2")
    if not reject:
        return pairs.join(first, "player1", "left_semi").join(second, "player2", "left_semi")
    marked = pairs.join(first.withColumn("has1", F.lit(True)), "player1", "left")
    marked = marked.join(second.withColumn("has2", F.lit(True)), "player2", "left")
    return marked.where(F.col("has1").isNull() | F.col("has2").isNull()).drop("has1", "has2")


# --- lookups and player reports ----------------------------------------------

def add_surface_rates(df: DataFrame, record: DataFrame, players=("player1", "player2"), names=("p1_surface_wr", "p2_surface_wr")) -> DataFrame:
    """Both players' rate on the row's surface, 0.5 where unknown."""
    for player, name in zip(players, names):
        side = record.select(F.col("player").alias(player), "surface", F.col("win_rate").alias(name))
        df = df.join(side, [player, "surface"], "left").withColumn(name, F.coalesce(name, F.lit(0.5)))
    return df


def rank_of(df: DataFrame, rankings: DataFrame, column: str, name: str, default: int = DEFAULT_RANK) -> DataFrame:
    """The first (best) listed rank of a player, or the default."""
    first = rankings.groupBy(F.col("player_name").alias(column)).agg(F.min("rank").alias(name))
    return df.join(first, column, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def player_card(persp: DataFrame, player: str | None = None, surfaces=SURFACES) -> DataFrame:
    """Games, wins, losses and win % per player for each listed surface, and over all (``Total``).

    A surface without games is listed with 0 %.  One grouping counts every surface; the rows are
    then laid out from its columns.
    """
    if player is not None:
        persp = persp.where(F.col("player") == player)
    counts = []
    for s in surfaces:
        here = F.col("surface") == s
        counts.append(F.count_if(here).alias(f"{s}_n"))
        counts.append(F.count_if(here & (F.col("target") == 1)).alias(f"{s}_w"))
    counts += [F.count("*").alias("Total_n"), F.sum("target").alias("Total_w")]
    one = persp.groupBy("player").agg(*counts)
    lines = F.array(*[
        F.struct(F.lit(s).alias("surface"), F.col(f"{s}_n").alias("games"), F.col(f"{s}_w").alias("wins"))
        for s in [*surfaces, "Total"]])
    rows = one.select("player", F.explode(lines).alias("v")).select("player", "v.*")
    percent = F.bround(F.coalesce(F.try_divide(F.col("wins") * 100, F.col("games")), F.lit(0.0)), 2)
    return rows.withColumn("losses", F.col("games") - F.col("wins")).withColumn("win_percent", percent)


def recent_matches(persp: DataFrame, n: int = 5) -> DataFrame:
    """Each player's last ``n`` contests, latest first."""
    latest = Window.partitionBy("player").orderBy(F.desc("tourney_date"), F.desc("match_num"))
    ranked = persp.withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= n)
    return ranked.withColumn("rn", F.col("rn").cast("long"))


def titles(matches: DataFrame, who: str = "name") -> DataFrame:
    """Finals won, per player and year."""
    won = matches.where(F.col("round") == "F")
    return won.groupBy(F.col(f"winner_{who}").alias("player"), F.year("tourney_date").cast("long").alias("year")).agg(
        F.count("*").alias("titles"))


def surface_profile(persp: DataFrame) -> DataFrame:
    """Per player and played surface: totals, rate and the rating attached to the last contest."""
    table = persp.groupBy("player", "surface").agg(
        F.count("*").alias("total"), F.sum("target").alias("wins"),
        F.max_by("player_stored_elo", F.struct("tourney_date", "match_num")).alias("current_elo"))
    return table.withColumn("win_rate", rate_or_half(F.col("wins"), F.col("total")))


def rating_log(persp: DataFrame) -> DataFrame:
    """Each player's contests with opponent, result, rating read before it and the stored one."""
    log = rating_before(persp)
    result = F.when(F.col("target") == 1, "win").otherwise("loss")
    return log.select(
        "match_num", "player", "tourney_date", "surface", "opponent", F.col("elo_before"),
        F.col("player_stored_elo").alias("elo_after"), result.alias("result"))


def history_view(matches: DataFrame, who: str = "name") -> DataFrame:
    """Perspective rows with only what the history operators read."""
    return perspectives(matches, who, ["match_num", "tourney_date", "surface"])
