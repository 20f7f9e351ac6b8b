"""Head-to-head, surface and player statistics; dominance."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelbook.operators import dominance, history
from duelbook.operators.features import features_asof
from duelbook.operators.perspectives import perspectives
from duelbook.plans.catalog import big, day, query, r6
from duelbook.plans.source_queries import contests, rated, stored_rated
from duelbook.plans.views import view
from duelbook.schema import SURFACES

PERSP = """
persp as (select match_num, tourney_date, surface, round, winner_name as player, loser_name as opponent, 1 as win, minutes, w_ace as ace from contests_ev
          union all select match_num, tourney_date, surface, round, loser_name, winner_name, 0, minutes, l_ace from contests_ev)
"""
RPERSP = """
rpersp as (select match_num, tourney_date, surface, winner_name as player, loser_name as opponent, 1 as win, winner_surface_elo as elo from rated_ev where surface is not null
           union all select match_num, tourney_date, surface, loser_name, winner_name, 0, loser_surface_elo from rated_ev where surface is not null)
"""
BEFORE = "range between unbounded preceding and interval 1 day preceding"


def persp(spark, sf):
    return history.history_view(contests(spark, sf))


def rated_persp(spark, sf):
    return history.history_view(rated(spark, sf).where(F.col("surface").isNotNull()))


def pairings(spark, sf):
    return view(spark, sf, "pairings_v")


@query("e1_h2h", "select player, opponent, sum(win)::bigint as wins, sum(1 - win)::bigint as losses from persp group by 1, 2", "contests_ev", PERSP)
def e1(spark, sf):
    return history.h2h(persp(spark, sf))


@query("e2_h2h_before", f"""
select match_num, player, opponent, coalesce(sum(win) over w, 0)::bigint as h2h_wins, coalesce(sum(1 - win) over w, 0)::bigint as h2h_losses
from persp window w as (partition by player, opponent order by tourney_date {BEFORE})
""", "contests_ev", PERSP)
def e2(spark, sf):
    df = history.h2h_before(persp(spark, sf))
    return df.select("match_num", "player", "opponent", "h2h_wins", "h2h_losses")


@query("e3_h2h_lookup", """
select q.query_id, count(p.win) filter (p.win = 1) as wins, count(p.win) filter (p.win = 0) as losses
from pairings_v q left join persp p on p.player = q.player1 and p.opponent = q.player2 group by 1
""", "contests_ev pairings_v", PERSP)
def e3(spark, sf):
    return history.h2h_lookup(pairings(spark, sf), persp(spark, sf)).select("query_id", "wins", "losses")


@query("e3_h2h_lookup_dated", """
select q.query_id, count(p.win) filter (p.win = 1) as wins, count(p.win) filter (p.win = 0) as losses
from pairings_v q left join persp p on p.player = q.player1 and p.opponent = q.player2 and p.tourney_date < q.tourney_date group by 1
""", "contests_ev pairings_v", PERSP)
def e3_dated(spark, sf):
    return history.h2h_lookup(pairings(spark, sf), persp(spark, sf), "tourney_date").select("query_id", "wins", "losses")


@query("e4_h2h_rates", """
select player, opponent, count(*) as h2h_matches, round(sum(win) / count(*), 6) as h2h_win_rate from persp group by 1, 2
""", "contests_ev", PERSP)
def e4(spark, sf):
    df = history.h2h_rates(history.h2h(persp(spark, sf)))
    return df.select("player", "opponent", "h2h_matches", r6("h2h_win_rate").alias("h2h_win_rate"))


@query("e5_surface_record", """
select player, surface, sum(win)::bigint as wins, sum(1 - win)::bigint as losses, count(*) as total, round(sum(win) / count(*), 6) as win_rate
from persp where surface in ('Clay', 'Hard', 'Grass') group by 1, 2
""", "contests_ev", PERSP)
def e5(spark, sf):
    df = history.surface_record(persp(spark, sf), SURFACES)
    return df.select("player", "surface", "wins", "losses", "total", r6("win_rate").alias("win_rate"))


@query("e6_surface_before", f"""
select match_num, player, count(*) over w as surface_matches, round(coalesce(sum(win) over w / nullif(count(*) over w, 0), 0.5::double), 6) as surface_win_rate
from rpersp window w as (partition by player, surface order by tourney_date {BEFORE})
""", "rated_ev", RPERSP)
def e6(spark, sf):
    rows = history.history_view(contests(spark, sf).where(F.col("surface").isNotNull()))
    df = history.surface_before(rows)
    return df.select("match_num", "player", "surface_matches", r6("surface_win_rate").alias("surface_win_rate"))


DAILY_ELO = """
daily as (select player, surface, tourney_date, max_by(elo, match_num) as e from rpersp group by 1, 2, 3),
lagged as (select player, surface, tourney_date, lag(e) over (partition by player, surface order by tourney_date) as elo_before from daily)
"""


@query("e7_rating_before", """
select p.match_num, p.player, round(coalesce(l.elo_before, 1500), 6) as elo_before
from rpersp p join lagged l on l.player = p.player and l.surface = p.surface and l.tourney_date = p.tourney_date
""", "rated_ev", RPERSP + "," + DAILY_ELO)
def e7(spark, sf):
    df = history.rating_before(rated_persp(spark, sf))
    return df.select("match_num", "player", r6("elo_before").alias("elo_before"))


ASOF_SQL = """
own as (select q.query_id, q.player1, q.player2, q.surface, q.tourney_date, count(p.win) as n1, coalesce(sum(p.win), 0) as w1,
               max_by(p.elo, struct_pack(d := p.tourney_date, m := p.match_num)) as e1
        from pairings_v q left join rpersp p on p.player = q.player1 and p.surface = q.surface and p.tourney_date < q.tourney_date group by all),
other as (select q.query_id, count(p.win) as n2, coalesce(sum(p.win), 0) as w2,
                 max_by(p.elo, struct_pack(d := p.tourney_date, m := p.match_num)) as e2
          from pairings_v q left join rpersp p on p.player = q.player2 and p.surface = q.surface and p.tourney_date < q.tourney_date group by all),
met as (select q.query_id, count(p.win) as nh, coalesce(sum(p.win), 0) as wh
        from pairings_v q left join rpersp p on p.player = q.player1 and p.opponent = q.player2 and p.tourney_date < q.tourney_date group by all),
asof_features as (
  select query_id, player1, player2, surface, tourney_date, coalesce(e1, 1500) as player_elo, coalesce(e2, 1500) as opponent_elo,
         coalesce(e1, 1500) - coalesce(e2, 1500) as elo_diff, coalesce(wh / nullif(nh, 0), 0.5::double) as h2h_win_rate, nh as h2h_matches,
         coalesce(w1 / nullif(n1, 0), 0.5::double) as player_surface_win_rate, n1 as player_surface_matches,
         coalesce(w2 / nullif(n2, 0), 0.5::double) as opponent_surface_win_rate, n2 as opponent_surface_matches
  from own join other using (query_id) join met using (query_id))
"""
ROUNDED = ["player_elo", "opponent_elo", "elo_diff", "h2h_win_rate", "player_surface_win_rate", "opponent_surface_win_rate"]
COUNTED = ["h2h_matches", "player_surface_matches", "opponent_surface_matches"]
SHOW_FEATURES_SQL = ", ".join(
    [f"round({c}, 6) + 0.0::double as {c}" for c in ROUNDED] + [f"cast({c} as bigint) as {c}" for c in COUNTED])


def show_features(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) for c in ROUNDED], *[big(c).alias(c) for c in COUNTED])


@query("e8_features_asof", f"select query_id, {SHOW_FEATURES_SQL} from asof_features", "rated_ev pairings_v", RPERSP + "," + ASOF_SQL)
def e8(spark, sf):
    return show_features(features_asof(pairings(spark, sf), stored_rated(spark, sf)), "query_id")


@query("e9_latest_date", """
with seen as (select player, max(tourney_date) as d from persp group by 1)
select query_id, cast(greatest(a.d, b.d) as string) as latest_date
from pairings_v q left join seen a on a.player = q.player1 left join seen b on b.player = q.player2
""", "contests_ev pairings_v", PERSP)
def e9(spark, sf):
    df = history.latest_date(pairings(spark, sf), persp(spark, sf))
    return df.select("query_id", day("latest_date").alias("latest_date"))


@query("e10_known_pairs", """
select query_id from pairings_v where player1 in (select player from persp) and player2 in (select player from persp)
""", "contests_ev pairings_v", PERSP)
def e10(spark, sf):
    return history.known_pairs(pairings(spark, sf), persp(spark, sf)).select("query_id")


@query("e10_rejected_pairs", """
select query_id from pairings_v where player1 not in (select player from persp) or player2 not in (select player from persp)
""", "contests_ev pairings_v", PERSP)
def e10_rejected(spark, sf):
    return history.known_pairs(pairings(spark, sf), persp(spark, sf), reject=True).select("query_id")


@query("e11_pair_surface_rates", """
with r as (select player, surface, sum(win) / count(*) as rate from persp group by 1, 2)
select query_id, round(coalesce(a.rate, 0.5::double), 6) as p1_surface_wr, round(coalesce(b.rate, 0.5::double), 6) as p2_surface_wr
from pairings_v q left join r a on a.player = q.player1 and a.surface = q.surface left join r b on b.player = q.player2 and b.surface = q.surface
""", "contests_ev pairings_v", PERSP)
def e11(spark, sf):
    df = history.add_surface_rates(pairings(spark, sf), history.surface_record(persp(spark, sf)))
    return df.select("query_id", r6("p1_surface_wr").alias("p1_surface_wr"), r6("p2_surface_wr").alias("p2_surface_wr"))


@query("e12_player_card", """
with names as (select distinct player from persp), s(surface) as (values ('Clay'), ('Hard'), ('Grass'))
select n.player, s.surface, count(p.win) as games, coalesce(sum(p.win), 0)::bigint as wins, (count(p.win) - coalesce(sum(p.win), 0))::bigint as losses,
       coalesce(round_even(sum(p.win) * 100 / nullif(count(p.win), 0), 2), 0) as win_percent
from names n cross join s left join persp p on p.player = n.player and p.surface = s.surface group by 1, 2
""", "contests_ev", PERSP)
def e12(spark, sf):
    return history.player_card(persp(spark, sf)).where(F.col("surface") != "Total")


@query("e13_player_totals", """
select player, count(*) as games, sum(win)::bigint as wins, sum(1 - win)::bigint as losses, round_even(sum(win) * 100 / count(*), 2) as win_percent from persp group by 1
""", "contests_ev", PERSP)
def e13(spark, sf):
    return history.player_card(persp(spark, sf)).where(F.col("surface") == "Total").drop("surface")


@query("e14_recent_matches", """
select player, rn, cast(tourney_date as string) as tourney_date, opponent, minutes, ace as aces from (
  select *, row_number() over (partition by player order by tourney_date desc, match_num desc) as rn from persp) where rn <= 5
""", "contests_ev", PERSP)
def e14(spark, sf):
    rows = perspectives(contests(spark, sf), "name", ["match_num", "tourney_date", "minutes"])
    return history.recent_matches(rows, 5).select(
        "player", "rn", day("tourney_date").alias("tourney_date"), "opponent", big("minutes").alias("minutes"), big("player_ace").alias("aces"))


@query("e15_titles", """
select player, cast(year(tourney_date) as bigint) as year, count(*) as titles from persp where round = 'F' and win = 1 group by 1, 2
""", "contests_ev", PERSP)
def e15(spark, sf):
    return history.titles(contests(spark, sf))


@query("e16_surface_profile", """
select player, surface, count(*) as total, sum(win)::bigint as wins, round(sum(win) / count(*), 6) as win_rate,
       round(max_by(elo, struct_pack(d := tourney_date, m := match_num)), 6) as current_elo from rpersp group by 1, 2
""", "rated_ev", RPERSP)
def e16(spark, sf):
    df = history.surface_profile(rated_persp(spark, sf))
    return df.select("player", "surface", "total", "wins", r6("win_rate").alias("win_rate"), r6("current_elo").alias("current_elo"))


@query("e17_rating_log", """
select p.match_num, p.player, cast(p.tourney_date as string) as tourney_date, p.surface, p.opponent,
       round(coalesce(l.elo_before, 1500), 6) as elo_before, round(p.elo, 6) as elo_after, case p.win when 1 then 'win' else 'loss' end as result
from rpersp p join lagged l on l.player = p.player and l.surface = p.surface and l.tourney_date = p.tourney_date
""", "rated_ev", RPERSP + "," + DAILY_ELO)
def e17(spark, sf):
    df = history.rating_log(rated_persp(spark, sf))
    return df.select("match_num", "player", day("tourney_date").alias("tourney_date"), "surface", "opponent",
                     r6("elo_before").alias("elo_before"), r6("elo_after").alias("elo_after"), "result")


@query("e18_rank_lookup", """
select query_id, coalesce(a.rank, 2000) as rank1, coalesce(b.rank, 2000) as rank2
from pairings_v q left join rankings_v a on a.player = q.player1 left join rankings_v b on b.player = q.player2
""", "rankings_v pairings_v")
def e18(spark, sf):
    rankings = view(spark, sf, "rankings_v").withColumnRenamed("player", "player_name")
    df = history.rank_of(pairings(spark, sf), rankings, "player1", "rank1")
    df = history.rank_of(df, rankings, "player2", "rank2")
    return df.select("query_id", big("rank1").alias("rank1"), big("rank2").alias("rank2"))


# --- dominance --------------------------------------------------------------------

SLAM = """
early as (select * from contests_ev where tourney_level = 'G' and round in ('R128', 'R64', 'R32', 'R16')),
sr as (select match_num, tourney_id, tourney_name, tourney_date, winner_name as player, w_svpt as svpt, "w_1stWon" + "w_2ndWon" as spw,
              l_svpt as retpt, l_svpt - "l_1stWon" - "l_2ndWon" as rpw from early
       union all select match_num, tourney_id, tourney_name, tourney_date, loser_name, l_svpt, "l_1stWon" + "l_2ndWon",
              w_svpt, w_svpt - "w_1stWon" - "w_2ndWon" from early),
totals as (select player, tourney_id, sum(svpt)::double as svpt, sum(spw)::double as spw, sum(retpt)::double as retpt, sum(rpw)::double as rpw,
                  max_by(tourney_name, match_num) as tourney_name, max_by(tourney_date, match_num) as tourney_date, count(*) as early_matches from sr group by 1, 2),
finals as (select winner_name as player, tourney_id, count(*) as n from contests_ev where round = 'F' group by 1, 2),
dr as (select t.*, (rpw / nullif(retpt, 0)) / nullif(1 - spw / nullif(svpt, 0), 0) as dr, coalesce((f.n = 1)::bigint, 0) as title
       from totals t left join finals f on f.player = t.player and f.tourney_id = t.tourney_id),
series as (select player, tourney_id, tourney_name as tourney, cast(tourney_date as string) as tourney_date, round(dr, 6) as dr, title,
                  case when tourney_name = 'Open' then null else concat(cast(year(tourney_date) as string), ' ', case tourney_name
                    when 'Wimbledon' then 'Wimb' when 'US Open' then 'USO' when 'Australian Open' then 'AO' else 'RG' end) end as full_name,
                  row_number() over (partition by player order by tourney_date, tourney_id) as axis_position from dr)
"""


@query("g1_slam_matches", "select match_num, round, tourney_id from early", "contests_ev", SLAM)
def g1(spark, sf):
    return dominance.slam_matches(contests(spark, sf)).select("match_num", "round", "tourney_id")


@query("g2_serve_return", "select match_num, player, svpt::double as svpt, spw::double as spw, retpt::double as retpt, rpw::double as rpw from sr", "contests_ev", SLAM)
def g2(spark, sf):
    rows = perspectives(dominance.slam_matches(contests(spark, sf)), "name", dominance.KEEP)
    return dominance.serve_return(rows).select("match_num", "player", "svpt", "spw", "retpt", "rpw")


@query("g3_slam_totals", "select player, tourney_id, svpt, spw, retpt, rpw, early_matches from totals", "contests_ev", SLAM)
def g3(spark, sf):
    return dominance.slam_totals(contests(spark, sf)).select("player", "tourney_id", "svpt", "spw", "retpt", "rpw", "early_matches")


@query("g4_dominance_ratio", "select player, tourney_id, round(dr, 6) as dr, title from dr", "contests_ev", SLAM)
def g4(spark, sf):
    return dominance.dominance_ratio(contests(spark, sf)).select("player", "tourney_id", r6("dr").alias("dr"), "title")


@query("g5_title_flags", "select player, tourney_id, (n = 1)::bigint as title from finals", "contests_ev", SLAM)
def g5(spark, sf):
    return dominance.title_flags(contests(spark, sf))


@query("g6_tournament_label", "select player, tourney_id, tourney_name, cast(tourney_date as string) as tourney_date from totals", "contests_ev", SLAM)
def g6(spark, sf):
    return dominance.slam_totals(contests(spark, sf)).select(
        "player", "tourney_id", "tourney_name", day("tourney_date").alias("tourney_date"))


def _series(spark, sf):
    df = dominance.dominance_series(contests(spark, sf))
    return df.withColumn("dr", r6("dr")).withColumn("tourney_date", day("tourney_date"))


@query("g7_dominance_series", "select * from series", "contests_ev", SLAM)
def g7(spark, sf):
    return _series(spark, sf)


@query("g8_title_layer", "select * from series where title = 1", "contests_ev", SLAM)
def g8(spark, sf):
    return dominance.title_layer(_series(spark, sf))
