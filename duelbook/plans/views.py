"""Contest tables derived from the given Parquet tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: how many of a date's last contests have a round of their own
ROUND_OF_POSITION = """case when rn > 7 and match_num % 50 = 7 then 'BR' when rn = 1 then 'F' when rn <= 3 then 'SF'
            when rn <= 7 then 'QF' when rn <= 15 then 'R16' when rn <= 31 then 'R32'
            when rn <= 63 then 'R64' when rn <= 127 then 'R128' else 'RR' end"""

MATCH_COLUMNS = f"""match_num, 'ATP' as tour, cast(tourney_date as string) as tourney_id,
       case day(tourney_date) % 5 when 0 then 'Wimbledon' when 1 then 'US Open'
            when 2 then 'Australian Open' when 3 then 'Roland Garros' else 'Open' end as tourney_name,
       case when day(tourney_date) % 5 < 4 then 'G' else 'A' end as tourney_level,
       tourney_date, surface,
       {ROUND_OF_POSITION} as round,
       case when match_num % 17 = 0 then null else 60 + (match_num * 11) % 120 end as minutes,
       winner_id, concat('Player#', lpad(cast(winner_id as string), 9, '0')) as winner_name,
       case when winner_id % 23 = 0 then null else winner_id % 200 + 1 end as winner_rank,
       165 + winner_id % 35 as winner_ht, cast(18.5 + (winner_id * 7) % 20 as double) as winner_age,
       loser_id, concat('Player#', lpad(cast(loser_id as string), 9, '0')) as loser_name,
       case when loser_id % 23 = 0 then null else loser_id % 200 + 1 end as loser_rank,
       165 + loser_id % 35 as loser_ht, cast(18.5 + (loser_id * 7) % 20 as double) as loser_age,
       match_num % 15 as w_ace, (match_num * 2) % 13 as l_ace,
       60 + match_num % 40 as w_svpt, 25 + match_num % 11 as `w_1stWon`, 10 + match_num % 7 as `w_2ndWon`,
       60 + (match_num * 3) % 40 as l_svpt, 20 + (match_num * 7) % 13 as `l_1stWon`, 5 + (match_num * 5) % 9 as `l_2ndWon`"""

SURFACE_OF_EVENT = """case {e} when 'view' then 'Hard' when 'click' then 'Clay'
              when 'purchase' then 'Grass' when 'signup' then 'Carpet' end"""

# The two events of a pair meet in one grouping (one scan, one exchange), and only the last 127
# contests of a date are ranked, so that no date is ever sorted whole.
SPARK_CONTESTS_EV = f"""
with pairs as (
  select cast(floor(event_id / 2) as bigint) as match_num,
         min_by(struct(user_id, value, ts, event_type), event_id) as a,
         max_by(struct(user_id, value), event_id) as b
  from events group by 1 having count(*) = 2),
p as (
  select match_num, cast(a.ts as date) as tourney_date, {SURFACE_OF_EVENT.format(e='a.event_type')} as surface,
         case when a.value > b.value or (a.value = b.value and a.user_id < b.user_id)
              then a.user_id else b.user_id end as winner_id,
         case when a.value > b.value or (a.value = b.value and a.user_id < b.user_id)
              then b.user_id else a.user_id end as loser_id
  from pairs where a.user_id <> b.user_id),
late as (
  select match_num as late_num, rn from (
    select match_num, row_number() over (partition by tourney_date order by match_num desc) as rn from p)
  where rn <= 127),
r as (select p.*, coalesce(late.rn, 128) as rn from p left join late on late.late_num = p.match_num)
select {MATCH_COLUMNS} from r
"""

DUCK_CONTESTS_EV = f"""
with p as (
  select cast(a.event_id / 2 as bigint) as match_num, cast(a.ts as date) as tourney_date,
         {SURFACE_OF_EVENT.format(e='a.event_type')} as surface,
         case when a.value > b.value or (a.value = b.value and a.user_id < b.user_id)
              then a.user_id else b.user_id end as winner_id,
         case when a.value > b.value or (a.value = b.value and a.user_id < b.user_id)
              then b.user_id else a.user_id end as loser_id
  from events a join events b on b.event_id = a.event_id + 1
  where a.event_id % 2 = 0 and a.user_id <> b.user_id),
r as (select *, row_number() over (partition by tourney_date order by match_num desc) as rn from p)
select {MATCH_COLUMNS} from r
""".replace("`", '"')

# Larger table: each supplier of an order meets the next one of the same order.
CONTESTS_LI = """
with s as (
  select l_orderkey as k, l_suppkey as p, sum(l_quantity) as q, max(l_extendedprice) as m,
         cast(date_trunc('week', min(l_shipdate)) as date) as d, max(l_returnflag) as f,
         sum(case when l_returnflag = 'N' then l_quantity else 0 end) as q1,
         sum(case when l_returnflag = 'A' then l_quantity else 0 end) as q2
  from lineitem group by l_orderkey, l_suppkey),
t as (
  select *, lead(p) over o as p2, lead(q) over o as qb, lead(m) over o as mb,
         lead(q1) over o as q1b, lead(q2) over o as q2b
  from s window o as (partition by k order by p)),
u as (select *, (q > qb or (q = qb and m >= mb)) as a_wins from t where p2 is not null)
select k * 1000000 + p as match_num, 'SUP' as tour, d as tourney_date, concat(cast(d as string), '-', f) as tourney_id,
       case f when 'A' then 'Wimbledon' when 'N' then 'US Open' else 'Open' end as tourney_name,
       case when k % 50 = 0 then null when f = 'A' then 'Hard' when f = 'N' then 'Clay' else 'Grass' end as surface,
       case when p % 5 = 0 then 'G' else 'A' end as tourney_level,
       case k % 9 when 0 then 'RR' when 1 then 'R128' when 2 then 'R64' when 3 then 'R32' when 4 then 'R16'
            when 5 then 'QF' when 6 then 'SF' when 7 then 'F' else 'BR' end as round,
       case when a_wins then p else p2 end as winner_id, case when a_wins then p2 else p end as loser_id,
       concat('Supplier#', lpad(cast(case when a_wins then p else p2 end as string), 9, '0')) as winner_name,
       concat('Supplier#', lpad(cast(case when a_wins then p2 else p end as string), 9, '0')) as loser_name,
       case when a_wins then q else qb end as w_svpt, case when a_wins then qb else q end as l_svpt,
       case when a_wins then q1 else q1b end as `w_1stWon`, case when a_wins then q1b else q1 end as `l_1stWon`,
       case when a_wins then q2 else q2b end as `w_2ndWon`, case when a_wins then q2b else q2 end as `l_2ndWon`
from u
"""

# One tour of 25 leagues that never meet: suppliers of a nation play by twos, in the order of a day's lines.
CONTESTS_NA = """
with e as (
  select l_orderkey * 8 + l_linenumber as k, min(l_suppkey) as p, min(l_shipdate) as d, max(l_quantity) as q, min(l_returnflag) as f
  from lineitem group by 1),
s as (
  select k, p, s_nationkey as n, d, q, f, row_number() over (partition by s_nationkey, d order by k) as i
  from e join supplier on s_suppkey = p),
t as (
  select n, d, floor((i - 1) / 2) as g, min(k) as k, min_by(p, k) as a, max_by(p, k) as b, min_by(q, k) as qa, max_by(q, k) as qb, min_by(f, k) as f
  from s group by 1, 2, 3 having count(*) = 2)
select k as match_num, 'NAT' as tour, cast(d as date) as tourney_date, n as league,
       case f when 'A' then 'Hard' when 'N' then 'Clay' else 'Grass' end as surface,
       case k % 9 when 0 then 'RR' when 1 then 'R128' when 2 then 'R64' when 3 then 'R32' when 4 then 'R16'
            when 5 then 'QF' when 6 then 'SF' when 7 then 'F' else 'BR' end as round,
       case when qa >= qb then a else b end as winner_id, case when qa >= qb then b else a end as loser_id
from t where a <> b
"""

# Two tours in one table, over the smaller contests.
CONTESTS_TT = """
select match_num, case match_num % 3 when 0 then 'WTA' else 'ATP' end as tour, tourney_id, tourney_date, surface, round, winner_id, loser_id
from contests_ev
"""

# Some ids and names are left out on purpose, to meet unknown players and missing ranks.
PLAYERS_V = """
select user_id as player_id, concat('Player#', lpad(cast(user_id as string), 9, '0')) as player_name
from events where user_id % 11 <> 0 group by user_id
"""

RANKINGS_V = """
select concat('Player#', lpad(cast(user_id as string), 9, '0')) as player,
       1 + count(*) as rank
from events where user_id % 10 <> 0 group by user_id
"""

# Has blanks to trim, identities, 2-cycles and chains; some players are not listed.
ALIASES_V = """
select concat('Player#', lpad(cast(user_id as string), 9, '0')) as old_name,
       concat(case when user_id % 3 = 0 then ' ' else '' end, 'Player#', lpad(cast(
         case user_id % 4 when 0 then user_id when 1 then user_id + 1 when 2 then user_id - 1 else user_id + 2 end
         as string), 9, '0')) as new_name
from events where user_id % 7 <> 0 group by user_id
"""

# Pairings to score: each event with the one before it, the neighbours that did not meet.
PAIRINGS_V = """
select a.event_id as query_id,
       case when a.event_id % 97 = 1 then concat('Unknown#', cast(a.user_id as string))
            else concat('Player#', lpad(cast(a.user_id as string), 9, '0')) end as player1,
       concat('Player#', lpad(cast(b.user_id as string), 9, '0')) as player2,
       case a.event_type when 'click' then 'Clay' when 'purchase' then 'Grass' else 'Hard' end as surface,
       cast(cast(b.ts as date) + interval 2 day as date) as tourney_date
from events a join events b on b.event_id = a.event_id + 1
where a.event_id % 2 = 1 and a.user_id <> b.user_id
"""

ODDS_PAGES_V = """
select match_num as page_id,
  concat('<html><body><div id="tournamentTabs-1-data"><table class="result"><tbody><tr><td class="t-name">',
    winner_name, ' - ', loser_name, '</td><td class="course">1.', lpad(cast(match_num % 100 as string), 2, '0'),
    '</td><td class="course">', case when match_num % 13 = 0 then 'n/a' else concat('2.', cast(match_num % 10 as string)) end,
    '</td></tr><tr><td class="t-name">', loser_name, ' - ', winner_name,
    '</td></tr><tr><td class="t-name">bye</td></tr></tbody></table></div></body></html>') as html
from contests_ev
"""

NAME_QUERIES_V = """
select p_name as true_name, replace(p_name, 'e', '') as query_name from part group by p_name
"""

# Ratings in SQL, for the checks only: one state row per player, stepped contest by contest.
# Player keys are not negative; negative keys hold the output of a contest.
DUCK_FOLD_EV = """
fold_q as materialized (
  select *, row_number() over (partition by surface order by tourney_date, match_num) as i
  from contests_ev where surface is not null),
fold_r(surface, player, i, elo, opp) using key (surface, player) as (
  select distinct surface, p, 0::bigint, 1500.0::double, null::double
  from (select surface, winner_id as p from fold_q union select surface, loser_id from fold_q)
  union
  select q.surface, x.p, q.i,
         case x.k when 1 then w.elo + 32*(1 - 1/(1 + pow(10, (l.elo - w.elo)/400)))
                  when 2 then l.elo - 32*(1 - 1/(1 + pow(10, (l.elo - w.elo)/400)))
                  else w.elo end,
         case when x.k = 3 then l.elo end
  from (select max(i) as k from fold_r) z, fold_q q, recurring.fold_r w, recurring.fold_r l,
       lateral (values (1, q.winner_id), (2, q.loser_id), (3, -1 - q.match_num)) x(k, p)
  where q.i = z.k + 1 and w.surface = q.surface and w.player = q.winner_id
    and l.surface = q.surface and l.player = q.loser_id)
"""

DUCK_RATED_EV = """
select m.*, f.elo as winner_surface_elo, f.opp as loser_surface_elo
from contests_ev m left join fold_r f on f.player = -1 - m.match_num
"""

DUCK_CAREER_EV = """
career_m as materialized (
  select c.* from contests_ev c semi join players_v w on w.player_id = c.winner_id
                                semi join players_v l on l.player_id = c.loser_id),
career_q as materialized (
  select *, row_number() over (order by tourney_date,
    case round when 'RR' then 0 when 'R128' then 1 when 'R64' then 2 when 'R32' then 3 when 'R16' then 4
               when 'QF' then 5 when 'SF' then 6 when 'F' then 7 end nulls last, match_num) as i from career_m),
career_r(player, i, elo, n, opp, opp_n) using key (player) as (
  select player_id, 0::bigint, 1500.0::double, 0::bigint, null::double, null::bigint from players_v
  union
  select x.p, q.i,
    case x.k when 1 then w.elo + 250/pow(w.n+5, 0.4) * (1 - 1/(1 + pow(10, (l.elo-w.elo)/400)))
             when 2 then l.elo + 250/pow(l.n+5, 0.4) * (0 - (1 - 1/(1 + pow(10, (l.elo-w.elo)/400))))
             else w.elo end,
    case x.k when 1 then w.n + 1 when 2 then l.n + 1 else w.n end,
    case when x.k = 3 then l.elo end, case when x.k = 3 then l.n end
  from (select max(i) as k from career_r) z, career_q q, recurring.career_r w, recurring.career_r l,
       lateral (values (1, q.winner_id), (2, q.loser_id), (3, -1 - q.match_num)) x(k, p)
  where q.i = z.k + 1 and w.player = q.winner_id and l.player = q.loser_id)
"""

DUCK_OVERALL_EV = """
select q.*, f.elo as winner_elo_pre, f.opp as loser_elo_pre, f.n as winner_played, f.opp_n as loser_played,
       f.elo + 250/pow(f.n+5, 0.4) * (1 - 1/(1 + pow(10, (f.opp-f.elo)/400))) as winner_elo_post,
       f.opp + 250/pow(f.opp_n+5, 0.4) * (0 - (1 - 1/(1 + pow(10, (f.opp-f.elo)/400)))) as loser_elo_post
from career_q q join career_r f on f.player = -1 - q.match_num
"""

DUCK_FOLD_NA = DUCK_FOLD_EV.replace("contests_ev", "contests_na")
DUCK_RATED_NA = DUCK_RATED_EV.replace("contests_ev", "contests_na")
DUCK_CAREER_NA = DUCK_CAREER_EV.replace("contests_ev", "contests_na").replace("players_v", "suppliers_v")
# a player of two tours is two players to this walk, told apart by the last bit of the id
DUCK_CAREER_TT = DUCK_CAREER_EV.replace("from contests_ev c semi", "from contests_tt2 c semi").replace("players_v", "players_tt")
SIGNED_TT = """
select match_num, tour, tourney_date, round, 2 * winner_id + cast(tour = 'WTA' as int) as winner_id, 2 * loser_id + cast(tour = 'WTA' as int) as loser_id
from contests_tt
"""

DUCK_VIEWS = {
    "contests_na": CONTESTS_NA,
    "contests_tt": CONTESTS_TT,
    "contests_tt2": SIGNED_TT,
    "suppliers_v": "select s_suppkey as player_id from supplier",
    "players_tt": "select 2 * player_id as player_id from players_v union all select 2 * player_id + 1 from players_v",
    "rated_na": DUCK_RATED_NA,
    "overall_na": DUCK_OVERALL_EV,
    "overall_tt": DUCK_OVERALL_EV,
    "contests_ev": DUCK_CONTESTS_EV,
    "contests_li": CONTESTS_LI.replace("`", '"'),
    "players_v": PLAYERS_V,
    "rankings_v": RANKINGS_V,
    "aliases_v": ALIASES_V,
    "pairings_v": PAIRINGS_V,
    "odds_pages_v": ODDS_PAGES_V,
    "name_queries_v": NAME_QUERIES_V,
    "rated_ev": DUCK_RATED_EV,
    "overall_ev": DUCK_OVERALL_EV,
}
DUCK_NEEDS = {
    "odds_pages_v": ["contests_ev"],
    "rated_ev": ["contests_ev"],
    "overall_ev": ["contests_ev", "players_v"],
    "rated_na": ["contests_na"],
    "overall_na": ["contests_na", "suppliers_v"],
    "contests_tt": ["contests_ev"],
    "overall_tt": ["contests_ev", "players_v", "contests_tt", "contests_tt2", "players_tt"],
}
DUCK_WALKS = {
    "rated_ev": DUCK_FOLD_EV, "overall_ev": DUCK_CAREER_EV, "rated_na": DUCK_FOLD_NA, "overall_na": DUCK_CAREER_NA, "overall_tt": DUCK_CAREER_TT,
}


def duck_sql(views: str, sql: str, extra: str = "") -> str:
    """``sql`` with the named views, and what they need, in front as CTEs."""
    names: list[str] = []
    for view in views.split():
        names += [v for v in [*DUCK_NEEDS.get(view, []), view] if v not in names]
    parts = []
    for name in names:
        if name in DUCK_WALKS:
            parts.append(DUCK_WALKS[name])
        parts.append(f"{name} as materialized ({DUCK_VIEWS[name]})")
    if extra:
        parts.append(extra)
    if sql.lstrip().startswith("with "):
        sql = f"select * from ({sql})"
    return f"with recursive {', '.join(parts)}\n{sql}"


SPARK_VIEWS = {
    "contests_ev": (SPARK_CONTESTS_EV, ["events"]),
    "contests_li": (CONTESTS_LI, ["lineitem"]),
    "contests_na": (CONTESTS_NA, ["lineitem", "supplier"]),
    "contests_tt": (CONTESTS_TT, ["contests_ev"]),
    "players_v": (PLAYERS_V, ["events"]),
    "rankings_v": (RANKINGS_V, ["events"]),
    "aliases_v": (ALIASES_V, ["events"]),
    "pairings_v": (PAIRINGS_V, ["events"]),
    "odds_pages_v": (ODDS_PAGES_V, ["contests_ev"]),
    "name_queries_v": (NAME_QUERIES_V, ["part"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived contest table; given tables are passed in by name."""
    text, sources = SPARK_VIEWS[name]
    inputs = {s: view(spark, sf_dir, s) if s in SPARK_VIEWS else table(spark, sf_dir, s) for s in sources}
    for source in inputs:
        for word in ("from", "join"):
            text = text.replace(f"{word} {source}", word + " {" + source + "}")
    return spark.sql(text, **inputs)
