"""Ratings and the tables made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelbook.functions.elo import elo_update, expected_score, k_factor
from duelbook.operators import rating_tables as tables
from duelbook.operators.ratings import known_players, overall_elo, rating_state, surface_elo
from duelbook.plans.catalog import big, day, query, r6
from duelbook.plans.source_queries import (
    PLAYER_RATINGS_CTE, PLAYER_TABLE_CTE, PLAYER_TABLE_SQL, RATED_SQL, _show_rated, contests, overall, ranked_players, rated,
    show_player_table,
)
from duelbook.plans.views import table, view
from duelbook.session import scratch_path
from duelbook.sources.files import write_table
from duelbook.streaming.yearly import current_ratings, rate_arrivals

HALFWAY = "2024-01-15"


@query("d1_expected_score", """
select match_num, round(1 / (1 + pow(10, (loser_surface_elo - winner_surface_elo) / 400)), 6) as expected from rated_ev
""", "rated_ev")
def d1(spark, sf):
    expected = expected_score(F.col("winner_surface_elo"), F.col("loser_surface_elo"))
    return rated(spark, sf).select("match_num", r6(expected).alias("expected"))


@query("d2_elo_update", """
select match_num, round(w + 32 * (1 - 1 / (1 + pow(10, (l - w) / 400))), 6) as winner_new,
       round(l - 32 * (1 - 1 / (1 + pow(10, (l - w) / 400))), 6) as loser_new
from (select match_num, winner_surface_elo as w, loser_surface_elo as l from rated_ev)
""", "rated_ev")
def d2(spark, sf):
    winner, loser = elo_update(F.col("winner_surface_elo"), F.col("loser_surface_elo"))
    return rated(spark, sf).select("match_num", r6(winner).alias("winner_new"), r6(loser).alias("loser_new"))


@query("d3_surface_elo", RATED_SQL, "rated_ev")
def d3(spark, sf):
    return _show_rated(rated(spark, sf))


@query("d3_surface_elo_sliced", RATED_SQL, "rated_ev")
def d3_sliced(spark, sf):
    """The way for pools of many players, forced by a small bound."""
    return _show_rated(surface_elo(contests(spark, sf), crowd=10, slice_rows=600))


@query("d3_surface_elo_chains", """
select match_num, surface, round(winner_surface_elo, 6) as winner_surface_elo, round(loser_surface_elo, 6) as loser_surface_elo from rated_na
""", "rated_na")
def d3_chains(spark, sf):
    """One tour of leagues that never meet: each league of a surface is a chain of its own."""
    made = surface_elo(view(spark, sf, "contests_na"), chain_rows=1000)
    return made.select("match_num", "surface", r6("winner_surface_elo").alias("winner_surface_elo"), r6("loser_surface_elo").alias("loser_surface_elo"))


@query("d4_k_factor", """
select match_num, round(250 / pow(winner_played + 5, 0.4), 6) as winner_k, round(250 / pow(loser_played + 5, 0.4), 6) as loser_k from overall_ev
""", "overall_ev")
def d4(spark, sf):
    return overall(spark, sf).select(
        "match_num", r6(k_factor(F.col("winner_played"))).alias("winner_k"), r6(k_factor(F.col("loser_played"))).alias("loser_k"))


OVERALL_SQL = """
select match_num, round(winner_elo_pre, 6) as winner_elo_pre, round(loser_elo_pre, 6) as loser_elo_pre,
       round(winner_elo_post, 6) as winner_elo_post, round(loser_elo_post, 6) as loser_elo_post, winner_played, loser_played from overall_ev
"""


def _show_overall(df):
    elos = ["winner_elo_pre", "loser_elo_pre", "winner_elo_post", "loser_elo_post"]
    return df.select("match_num", *[r6(c).alias(c) for c in elos], "winner_played", "loser_played")


@query("d5_overall_elo", OVERALL_SQL, "overall_ev")
def d5(spark, sf):
    return _show_overall(overall(spark, sf))


@query("d5_overall_elo_sliced", OVERALL_SQL, "overall_ev")
def d5_sliced(spark, sf):
    return _show_overall(overall_elo(contests(spark, sf), view(spark, sf, "players_v"), crowd=10, slice_rows=2000))


@query("d5_overall_elo_chains", OVERALL_SQL.replace("overall_ev", "overall_na"), "overall_na")
def d5_chains(spark, sf):
    """One pool of one tour, folded as its independent chains."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player_id"))
    return _show_overall(overall_elo(view(spark, sf, "contests_na"), suppliers, chain_rows=1000))


@query("d6_known_players", """
select match_num, winner_id, loser_id from contests_ev
where winner_id in (select player_id from players_v) and loser_id in (select player_id from players_v)
""", "contests_ev players_v")
def d6(spark, sf):
    return known_players(contests(spark, sf), view(spark, sf, "players_v")).select("match_num", "winner_id", "loser_id")


@query("d7_career_counters", """
select player, count(*) as matches_played, cast(max_by(tourney_date, seq) as string) as last_tourney_date from rows_ev group by player
""", "overall_ev", PLAYER_TABLE_CTE)
def d7(spark, sf):
    table = tables.career_counters(tables.rating_rows(overall(spark, sf)))
    return table.select("player", "matches_played", day("last_tourney_date").alias("last_tourney_date"))


@query("d8_peaks", """
select s.player, round(coalesce(w.peak, 1500), 6) as peak_elo, cast(w.peak_date as string) as peak_elo_date
from state s left join when_high w on w.player = s.player
""", "overall_ev", PLAYER_TABLE_CTE)
def d8(spark, sf):
    table = tables.peaks(tables.rating_rows(overall(spark, sf)))
    return table.select("player", r6("peak_elo").alias("peak_elo"), day("peak_elo_date").alias("peak_elo_date"))


@query("d9_top_players", PLAYER_TABLE_SQL + """
where current_elo <> 1500 or matches_played > 0 or peak_elo <> 1500 order by player_table.peak_elo desc, player_id limit 10
""", "overall_ev", PLAYER_TABLE_CTE)
def d9(spark, sf):
    return show_player_table(tables.top_players(ranked_players(spark, sf), 10))


@query("d10_snapshot", f"""
select player, round(max_by(elo, seq), 6) as elo, max_by(n, seq) + 1 as played, cast(max_by(tourney_date, seq) as string) as last_tourney_date
from rows_ev where tourney_date <= date '{HALFWAY}' group by player
""", "overall_ev", PLAYER_TABLE_CTE)
def d10(spark, sf):
    table = tables.snapshot(tables.rating_rows(overall(spark, sf)), F.lit(HALFWAY).cast("date"))
    return table.select("player", r6("elo").alias("elo"), "played", day("last_tourney_date").alias("last_tourney_date"))


@query("d11_resume", OVERALL_SQL + f" where tourney_date > date '{HALFWAY}'", "overall_ev")
def d11(spark, sf):
    """The second half rated on the first half's snapshot equals one run over both."""
    matches, players = contests(spark, sf), view(spark, sf, "players_v")
    first = overall_elo(matches.where(F.col("tourney_date") <= HALFWAY), players)
    state = rating_state(tables.snapshot(tables.rating_rows(first)))
    return _show_overall(overall_elo(matches.where(F.col("tourney_date") > HALFWAY), players, state=state))


def _arrive(spark, sf, matches, parts):
    """The contests of ``matches`` that the conditions in ``parts`` name, rated part by part as they arrive."""
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "arrived")
    for part in parts:
        matches.where(part).write.mode("append").parquet(source)
        rate_arrivals(spark, source, matches.schema, view(spark, sf, "players_v"), target)
    return current_ratings(spark, target)


@query("d11_yearly_files", OVERALL_SQL, "overall_ev")
def d11_files(spark, sf):
    """Files rated as they arrive, each on the state the ones before left."""
    day = F.col("tourney_date")
    return _show_overall(_arrive(spark, sf, contests(spark, sf), [day < HALFWAY, day >= HALFWAY]))


@query("d11_late_files", OVERALL_SQL.replace("overall_ev", "overall_tt").replace("match_num,", "match_num, tour,", 1), "overall_tt")
def d11_late(spark, sf):
    """Two tours; a file of one of them comes late and once more, and gives what one run over everything gives."""
    day, late = F.col("tourney_date"), (F.col("tour") == "WTA") & (F.col("match_num") % 5 == 0)
    parts = [(day < HALFWAY) & ~late, (day >= HALFWAY) & ~late, late & (day < HALFWAY), late]
    made = _arrive(spark, sf, view(spark, sf, "contests_tt"), parts)
    return _show_overall(made).join(made.select("match_num", "tour"), "match_num")


SERIES = {
    "last": "select player, tourney_date, max_by(elo, seq) as elo from rows_ev group by 1, 2",
    "first": """select player, tourney_date, elo from rows_ev
                where seq in (select min_by(seq, seq * 2 + 1 - win) from rows_ev group by tourney_date)
                   or seq in (select min_by(seq, seq * 2 + win) from rows_ev group by tourney_date)""",
}
# a contest's two rows share its place in the order
SERIES_CTE = PLAYER_TABLE_CTE.replace("select *, row_number() over", "select *, dense_rank() over")


def _show_series(df):
    return df.select(day("tourney_date").alias("tourney_date"), "player", r6("elo").alias("elo"))


@query("d12_rating_series", f"select cast(tourney_date as string) as tourney_date, player, round(elo, 6) as elo from ({SERIES['last']})",
       "overall_ev", SERIES_CTE)
def d12(spark, sf):
    return _show_series(tables.rating_series(tables.rating_rows(overall(spark, sf))))


@query("d12_rating_series_first", f"select cast(tourney_date as string) as tourney_date, player, round(elo, 6) as elo from ({SERIES['first']})",
       "overall_ev", SERIES_CTE)
def d12_first(spark, sf):
    return _show_series(tables.rating_series(tables.rating_rows(overall(spark, sf)), "first"))


TEN = "(select player_id from players_v order by player_id limit 10)"


def _ten(spark, sf):
    """The ten smallest ids of the player dimension, as a user would list them."""
    return [row.player_id for row in view(spark, sf, "players_v").orderBy("player_id").limit(10).collect()]


@query("d12_rating_series_players", f"""
select cast(tourney_date as string) as tourney_date, player, round(elo, 6) as elo from ({SERIES['last']}) where player in {TEN}
""", "overall_ev", SERIES_CTE)
def d12_players(spark, sf):
    return _show_series(tables.rating_series(tables.rating_rows(overall(spark, sf)), players=_ten(spark, sf)))


GRID_SQL = f"""
known as ({SERIES['last']}),
dates as (select tourney_date, row_number() over (order by tourney_date) as pos from (select distinct tourney_date from known)),
grid as (select p.player, d.tourney_date, d.pos, k.elo
         from (select distinct player from known) p cross join dates d left join known k on k.player = p.player and k.tourney_date = d.tourney_date),
ends as (select *, last_value(case when elo is not null then pos end ignore nulls) over (partition by player order by pos rows between unbounded preceding and current row) as p0,
                last_value(elo ignore nulls) over (partition by player order by pos rows between unbounded preceding and current row) as e0,
                first_value(case when elo is not null then pos end ignore nulls) over (partition by player order by pos rows between current row and unbounded following) as p1,
                first_value(elo ignore nulls) over (partition by player order by pos rows between current row and unbounded following) as e1 from grid),
filled as (select player, tourney_date, case when p0 is null then null when p1 is null or p1 = p0 then e0
                  else e0 + (e1 - e0) * (pos - p0) / (p1 - p0) end as elo from ends)
"""


@query("d13_interpolate", "select cast(tourney_date as string) as tourney_date, player, round(elo, 6) as elo from filled",
       "overall_ev", SERIES_CTE + "," + GRID_SQL)
def d13(spark, sf):
    return _show_series(tables.interpolate(tables.rating_series(tables.rating_rows(overall(spark, sf)))))


@query("d14_trim_series", """
select cast(f.tourney_date as string) as tourney_date, f.player,
       case when f.tourney_date > s.d then null else round(f.elo, 6) end as elo from filled f join state s on s.player = f.player
""", "overall_ev", SERIES_CTE + "," + GRID_SQL)
def d14(spark, sf):
    rows = tables.rating_rows(overall(spark, sf))
    filled = tables.interpolate(tables.rating_series(rows))
    return _show_series(tables.trim_series(filled, tables.career_counters(rows)))


@query("d13_interpolate_players", f"""
select cast(tourney_date as string) as tourney_date, player, round(elo, 6) as elo from filled where player in {TEN}
""", "overall_ev", SERIES_CTE + "," + GRID_SQL)
def d13_players(spark, sf):
    """Ten players at all dates, from intervals: no other player's values are made."""
    return _show_series(tables.interpolate(tables.rating_series(tables.rating_rows(overall(spark, sf))), players=_ten(spark, sf)))


@query("d13_interpolate_dates", """
select cast(tourney_date as string) as tourney_date, player, round(elo, 6) as elo from filled where dayofweek(tourney_date) = 0
""", "overall_ev", SERIES_CTE + "," + GRID_SQL)
def d13_dates(spark, sf):
    """All players on Sundays alone."""
    series = tables.rating_series(tables.rating_rows(overall(spark, sf)))
    sundays = series.where(F.dayofweek("tourney_date") == 1).select("tour", "tourney_date").distinct()
    return _show_series(tables.interpolate(series, dates=sundays))


@query("d14_trim_series_players", f"""
select cast(f.tourney_date as string) as tourney_date, f.player,
       case when f.tourney_date > s.d then null else round(f.elo, 6) end as elo from filled f join state s on s.player = f.player
where f.player in {TEN}
""", "overall_ev", SERIES_CTE + "," + GRID_SQL)
def d14_players(spark, sf):
    rows = tables.rating_rows(overall(spark, sf))
    filled = tables.interpolate(tables.rating_series(rows), players=_ten(spark, sf))
    return _show_series(tables.trim_series(filled, tables.career_counters(rows)))


@query("b4_write_wide_series", "select cast(tourney_date as string) as tourney_date, " + ", ".join(
    f"max(round(elo, 6)) filter (place = {i}) as player_{i}" for i in range(1, 11)) + f"""
from ({SERIES['last']}) k join (select player_id, row_number() over (order by player_id) as place from players_v) p
  on p.player_id = k.player and p.place <= 10 group by tourney_date
""", "overall_ev", SERIES_CTE)
def b4_wide(spark, sf):
    """One column for each of ten players, written and read back."""
    ten = _ten(spark, sf)
    series = tables.rating_series(tables.rating_rows(overall(spark, sf)), players=ten)
    wide = spark.read.parquet(write_table(tables.wide_series(series, ten), scratch_path(spark, "wide")))
    return wide.select(day("tourney_date").alias("tourney_date"), *[r6(str(p)).alias(f"player_{i}") for i, p in enumerate(ten, 1)])


@query("d15_player_history", """
with ids as (select winner_name as name, min_by(winner_id, match_num) as id from rated_ev group by 1),
s as (select match_num, tourney_date, surface, winner_id as id, winner_surface_elo as elo from rated_ev
      union all select match_num, tourney_date, surface, loser_id, loser_surface_elo from rated_ev)
select name, match_num, cast(tourney_date as string) as tourney_date, surface, round(elo, 6) as surface_elo from ids join s on s.id = ids.id
""", "rated_ev")
def d15(spark, sf):
    return tables.player_history(rated(spark, sf)).select(
        "name", "match_num", day("tourney_date").alias("tourney_date"), "surface", r6("surface_elo").alias("surface_elo"))


@query("d16_latest_ratings", "select name, surface, round(elo, 6) as elo from last", "rated_ev", PLAYER_RATINGS_CTE)
def d16(spark, sf):
    return tables.latest_ratings(rated(spark, sf)).select("name", "surface", r6("elo").alias("elo"))


@query("d17_match_counts", "select name, surface, n as matches from last", "rated_ev", PLAYER_RATINGS_CTE)
def d17(spark, sf):
    return tables.match_counts(rated(spark, sf)).select("name", "surface", big("matches").alias("matches"))


@query("d18_weighted_overall", "select name, round(sum(elo * n) / sum(n), 6) as elo_overall from last group by name", "rated_ev", PLAYER_RATINGS_CTE)
def d18(spark, sf):
    return tables.weighted_overall(tables.surface_table(rated(spark, sf))).select("name", r6("elo_overall").alias("elo_overall"))


@query("d19_top_overall", """
select name, round(elo_overall, 6) as elo_overall from player_ratings order by player_ratings.elo_overall desc nulls last, name limit 5
""", "rated_ev", PLAYER_RATINGS_CTE)
def d19(spark, sf):
    table = tables.player_ratings(rated(spark, sf))
    return tables.top_overall(table).select("name", r6("elo_overall").alias("elo_overall"))
