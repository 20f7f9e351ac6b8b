"""Feature frames, splits and samples."""

from __future__ import annotations

from duelbook.operators import features as feats
from duelbook.operators import splits
from duelbook.operators.perspectives import perspectives
from duelbook.operators.rating_tables import player_ratings
from duelbook.plans.catalog import big, query, r6
from duelbook.plans.history_queries import (
    BEFORE, DAILY_ELO, PERSP, RPERSP, SHOW_FEATURES_SQL, pairings, persp, show_features,
)
from duelbook.plans.source_queries import PLAYER_RATINGS_CTE, contests, rated, stored_rated
from duelbook.plans.views import view
from duelbook.schema import ALL_SURFACES, SURFACES

KEYS = ["match_num", "player", "opponent", "surface", "target"]

ASOF_FEATURES = RPERSP + "," + DAILY_ELO + f""",
counted as (
  select p.*, count(*) over s as sn, coalesce(sum(win) over s, 0) as sw, count(*) over h as hn, coalesce(sum(win) over h, 0) as hw
  from rpersp p window s as (partition by player, surface order by tourney_date {BEFORE}),
                       h as (partition by player, opponent order by tourney_date {BEFORE})),
own as (select c.*, coalesce(l.elo_before, 1500) as e from counted c
        join lagged l on l.player = c.player and l.surface = c.surface and l.tourney_date = c.tourney_date),
features as (
  select a.match_num, a.tourney_date, a.player, a.opponent, a.surface, a.win::bigint as target, a.e as player_elo, b.e as opponent_elo, a.e - b.e as elo_diff,
         coalesce(a.hw / nullif(a.hn, 0), 0.5::double) as h2h_win_rate, a.hn as h2h_matches,
         coalesce(a.sw / nullif(a.sn, 0), 0.5::double) as player_surface_win_rate, a.sn as player_surface_matches,
         coalesce(b.sw / nullif(b.sn, 0), 0.5::double) as opponent_surface_win_rate, b.sn as opponent_surface_matches
  from own a join own b on b.match_num = a.match_num and b.win <> a.win)
"""


@query("f1_perspectives", """
select match_num, winner_name as player, loser_name as opponent, 1::bigint as target, winner_rank as player_rank, surface from contests_ev
union all select match_num, loser_name, winner_name, 0, loser_rank, surface from contests_ev
""", "contests_ev")
def f1(spark, sf):
    df = perspectives(contests(spark, sf), "name", ["match_num", "surface"])
    return df.select("match_num", "player", "opponent", "target", big("player_rank").alias("player_rank"), "surface")


@query("f2_features", f"select match_num, player, opponent, surface, target, {SHOW_FEATURES_SQL} from features", "rated_ev", ASOF_FEATURES)
def f2(spark, sf):
    return show_features(feats.features(stored_rated(spark, sf)), *KEYS)


@query("f3_features_full", f"""
with s as (select player, surface, count(*) as n, sum(win) as w from rpersp where surface in ('Clay', 'Hard', 'Grass') group by 1, 2),
h as (select player, opponent, count(*) as n, sum(win) as w from rpersp group by 1, 2),
f as (select a.match_num, a.player, a.opponent, a.surface, a.win::bigint as target, a.elo as player_elo, b.elo as opponent_elo, a.elo - b.elo as elo_diff,
             h.w / h.n as h2h_win_rate, h.n as h2h_matches,
             coalesce(x.w / x.n, 0.5::double) as player_surface_win_rate, coalesce(x.n, 0) as player_surface_matches,
             coalesce(y.w / y.n, 0.5::double) as opponent_surface_win_rate, coalesce(y.n, 0) as opponent_surface_matches
      from rpersp a join rpersp b on b.match_num = a.match_num and b.win <> a.win
      join h on h.player = a.player and h.opponent = a.opponent
      left join s x on x.player = a.player and x.surface = a.surface left join s y on y.player = a.opponent and y.surface = a.surface)
select match_num, player, opponent, surface, target, {SHOW_FEATURES_SQL} from f
""", "rated_ev", RPERSP)
def f3(spark, sf):
    return show_features(feats.features(stored_rated(spark, sf), "full"), *KEYS)


PROFILE_SQL = """
with v as (select match_num, 1::bigint as target, winner_rank as player_rank, winner_ht as player_ht, winner_age as player_age,
                  loser_rank as opponent_rank, loser_ht as opponent_ht, loser_age as opponent_age from contests_ev
           union all select match_num, 0, loser_rank, loser_ht, loser_age, winner_rank, winner_ht, winner_age from contests_ev)
select * from v where player_rank is not null and opponent_rank is not null
"""


@query("f4_profile", PROFILE_SQL, "contests_ev")
def f4(spark, sf):
    df = feats.profile(contests(spark, sf))
    return df.select(*[c if c.endswith("_age") else big(c).alias(c) for c in df.columns])


@query("f4_features_with_profile", f"""
with v as ({PROFILE_SQL})
select f.match_num, player, f.target, {SHOW_FEATURES_SQL}, player_rank, opponent_rank, player_ht, opponent_ht
from features f join v on v.match_num = f.match_num and v.target = f.target
""", "rated_ev", ASOF_FEATURES)
def f4_joined(spark, sf):
    matches = stored_rated(spark, sf)
    df = feats.add_profile(feats.features(matches), matches)
    extra = ["player_rank", "opponent_rank", "player_ht", "opponent_ht"]
    shown = show_features(df, "match_num", "player", "target", *extra)
    return shown.withColumns({c: big(c) for c in extra})


@query("f5_rank_features", """
with valid as (select * from contests_ev where surface is not null and winner_rank is not null and loser_rank is not null),
v as (select match_num, surface, winner_name as player1, loser_name as player2, winner_rank as player1_rank, loser_rank as player2_rank, 1::bigint as target from valid
      union all select match_num, surface, loser_name, winner_name, loser_rank, winner_rank, 0 from valid),
h as (select player, opponent, sum(win)::bigint as w, sum(1 - win)::bigint as l from persp group by 1, 2),
s as (select player, surface, sum(win) / count(*) as r from persp group by 1, 2)
select match_num, player1, player2, target, player1_rank, player2_rank, coalesce(h.w, 0) as h2h_wins, coalesce(h.l, 0) as h2h_losses,
       round(coalesce(a.r, 0.5::double), 6) as p1_surface_wr, round(coalesce(b.r, 0.5::double), 6) as p2_surface_wr,
       (v.surface = 'Clay')::bigint as "surface_Clay", (v.surface = 'Hard')::bigint as "surface_Hard", (v.surface = 'Grass')::bigint as "surface_Grass"
from v left join h on h.player = player1 and h.opponent = player2
left join s a on a.player = player1 and a.surface = v.surface left join s b on b.player = player2 and b.surface = v.surface
""", "contests_ev", PERSP)
def f5(spark, sf):
    return feats.rank_features(contests(spark, sf)).select(
        "match_num", "player1", "player2", "target", big("player1_rank").alias("player1_rank"), big("player2_rank").alias("player2_rank"),
        "h2h_wins", "h2h_losses", r6("p1_surface_wr").alias("p1_surface_wr"), r6("p2_surface_wr").alias("p2_surface_wr"),
        *[f"surface_{s}" for s in SURFACES])


RATED_PAIRS = ["Hard", "Clay", "Grass"]


@query("f6_static_ratings", "select query_id, " + ", ".join(
    f'round(coalesce({t}."elo_{s}", 1500), 6) as player{i}_elo_{s.lower()}' for i, t in ((1, "a"), (2, "b")) for s in [*RATED_PAIRS, "overall"]
) + """ from pairings_v q left join player_ratings a on a.name = q.player1 left join player_ratings b on b.name = q.player2
""", "rated_ev pairings_v", PLAYER_RATINGS_CTE)
def f6(spark, sf):
    df = feats.add_ratings(pairings(spark, sf), player_ratings(rated(spark, sf)))
    names = [c for c in df.columns if "_elo_" in c]
    return df.select("query_id", *[r6(c).alias(c) for c in names])


@query("f7_match_stats", """
select match_num, winner_name as player, 1::bigint as target, w_ace as aces, minutes from contests_ev
union all select match_num, loser_name, 0, l_ace, minutes from contests_ev
""", "contests_ev")
def f7(spark, sf):
    df = feats.match_stats(contests(spark, sf))
    return df.select("match_num", "player", "target", big("aces").alias("aces"), big("minutes").alias("minutes"))


@query("f8_one_hot", "select match_num, " + ", ".join(
    f"""coalesce((surface = '{s}')::bigint, 0) as "surface_{s}" """ for s in ALL_SURFACES) + " from contests_ev", "contests_ev")
def f8(spark, sf):
    return feats.one_hot(contests(spark, sf).select("match_num", "surface"), "surface", ALL_SURFACES)


@query("f9_encode_surface", """
select match_num, coalesce((surface = 'Clay')::bigint, 0) as "surface_Clay", coalesce((surface = 'Hard')::bigint, 0) as "surface_Hard",
       coalesce((surface = 'Grass')::bigint, 0) as "surface_Grass" from contests_ev
""", "contests_ev")
def f9(spark, sf):
    return feats.encode_surface(contests(spark, sf).select("match_num", "surface")).drop("surface")


@query("f9_encode_surface_grass", """
select match_num, coalesce((surface = 'Clay')::bigint, 0) as "surface_Clay", coalesce((surface = 'Hard')::bigint, 0) as "surface_Hard",
       (surface is null or surface not in ('Clay', 'Hard'))::bigint as "surface_Grass" from contests_ev
""", "contests_ev")
def f9_grass(spark, sf):
    return feats.encode_surface(contests(spark, sf).select("match_num", "surface"), unknown="Grass").drop("surface")


@query("f10_align", """
select match_num, coalesce((surface = 'Clay')::bigint, 0) as "surface_Clay", 0::bigint as "surface_Sand", winner_id from contests_li
""", "contests_li")
def f10(spark, sf):
    df = feats.one_hot(view(spark, sf, "contests_li"), "surface", SURFACES)
    df = feats.align(df, ["match_num", "surface_Clay", "surface_Sand", "winner_id"])
    return df.withColumn("surface_Sand", big("surface_Sand"))


@query("f11_standardise", """
with m as (select avg(player_elo) as me, stddev_pop(player_elo) as se, avg(h2h_matches) as mh, stddev_pop(h2h_matches) as sh,
                  avg(elo_diff) as md, stddev_pop(elo_diff) as sd from features)
select match_num, target, round((player_elo - me) / se, 6) + 0.0::double as player_elo, round((h2h_matches - mh) / sh, 6) + 0.0::double as h2h_matches,
       round((elo_diff - md) / sd, 6) + 0.0::double as elo_diff from features, m
""", "rated_ev", ASOF_FEATURES)
def f11(spark, sf):
    df = feats.features(stored_rated(spark, sf)).select("match_num", "target", "player_elo", "h2h_matches", "elo_diff")
    scaled = feats.standardise(df, ["player_elo", "h2h_matches", "elo_diff"])
    return scaled.select("match_num", "target", *[r6(c).alias(c) for c in ("player_elo", "h2h_matches", "elo_diff")])


@query("f12_class_balance", """
with v as (select 1::bigint as target from rated_ev where surface is not null union all select 0 from rated_ev where surface is not null)
select target, count(*) as n, round(count(*) / (select count(*) from v), 6) as share from v group by target
""", "rated_ev")
def f12(spark, sf):
    df = feats.class_balance(feats.features(stored_rated(spark, sf)))
    return df.select("target", "n", r6("share").alias("share"))


# --- splits -----------------------------------------------------------------------

def _rows(spark, sf):
    return persp(spark, sf).select("match_num", "tourney_date", "player", "target")


@query("h1_split_random", """
with k as (select match_num, win::bigint as target, row_number() over (order by md5(concat_ws('-', match_num::varchar, win::varchar, '42')), match_num, win) - 1 as pos,
                  count(*) over () as n from persp)
select match_num, target, case when pos < ceil(0.2::double * n) then 'test' else 'train' end as "set" from k
""", "contests_ev", PERSP)
def h1(spark, sf):
    return splits.split_random(_rows(spark, sf), ["match_num", "target"]).select("match_num", "target", "set")


@query("h2_split_stratified", """
with k as (select match_num, win::bigint as target, row_number() over (partition by win order by md5(concat_ws('-', match_num::varchar, win::varchar, '42')), match_num) - 1 as pos,
                  count(*) over (partition by win) as n from persp)
select match_num, target, case when pos < ceil(0.2::double * n) then 'test' else 'train' end as "set" from k
""", "contests_ev", PERSP)
def h2(spark, sf):
    return splits.split_random(_rows(spark, sf), ["match_num", "target"], by="target").select("match_num", "target", "set")


@query("h3_split_temporal", """
with k as (select match_num, win::bigint as target, row_number() over (order by tourney_date, match_num, win desc) - 1 as pos, count(*) over () as n from persp)
select match_num, target, case when pos < floor(0.7::double * n) then 'train'
       when pos < floor(0.7::double * n) + floor(0.15::double * n) then 'validation' else 'test' end as "set" from k
""", "contests_ev", PERSP)
def h3(spark, sf):
    return splits.split_temporal(_rows(spark, sf)).select("match_num", "target", "set")


@query("h4_split_temporal_stratified", """
with k as (select match_num, win::bigint as target, row_number() over (partition by win order by tourney_date, match_num) - 1 as pos,
                  count(*) over (partition by win) as n from persp)
select match_num, target, case when pos < floor(0.7::double * n) then 'train'
       when pos < floor(0.7::double * n) + floor(0.15::double * n) then 'validation' else 'test' end as "set" from k
""", "contests_ev", PERSP)
def h4(spark, sf):
    return splits.split_temporal(_rows(spark, sf), by="target").select("match_num", "target", "set")


@query("h5_sample_rows", """
select match_num, target from (
  select match_num, win::bigint as target from persp order by md5(concat_ws('-', match_num::varchar, win::varchar, '1')), match_num, win limit 8)
""", "contests_ev", PERSP)
def h5(spark, sf):
    return splits.sample_rows(_rows(spark, sf), ["match_num", "target"], 8, 1).select("match_num", "target")


@query("h6_random_pairs", """
with k as (select player, row_number() over (order by md5(concat_ws('-', player, '1')), player) - 1 as rn from (select distinct player from persp)),
p as (select a.player as player1, b.player as player2 from k a join k b on b.rn = a.rn + 1 where a.rn % 2 = 0 and a.rn < 6)
select player1, player2, (['Clay', 'Hard', 'Grass'])[(('0x' || substr(md5(concat_ws('-', player1, player2, '1')), 1, 6))::bigint % 3) + 1] as surface from p
""", "contests_ev", PERSP)
def h6(spark, sf):
    players = persp(spark, sf).select("player").distinct()
    return splits.random_pairs(players, 3, 1).select("player1", "player2", "surface")
