"""Scans, sinks and cleaning: files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelbook.functions import clean, names
from duelbook.operators.history import h2h, history_view
from duelbook.operators.perspectives import perspectives
from duelbook.operators.rating_tables import (
    active_players, player_history, player_ratings, player_table, rating_rows, rating_series, year_end_snapshots,
)
from duelbook.operators.ratings import overall_elo, surface_elo
from duelbook.plans.catalog import big, day, query, r6
from duelbook.plans.views import table, view
from duelbook.session import scratch_path
from duelbook.sources import files
from duelbook.sources.odds import extract_odds

BY_YEAR = {"tour": "{tour}_matches/year={year}"}
BY_TIER = {t: f"tier={t}/year={{year}}" for t in ("tour", "qual_chall", "futures")}
SHOWN = ["match_num", "surface", "round", "winner_id", "loser_id", "winner_name", "loser_name"]


def contests(spark, sf):
    return view(spark, sf, "contests_ev")


def rated(spark, sf):
    return surface_elo(contests(spark, sf))


def stored_rated(spark, sf):
    """Rated contests written and read back, for what reads them more than once."""
    return files.read_rated(spark, files.write_table(rated(spark, sf), scratch_path(spark, "rated")))


def overall(spark, sf):
    return overall_elo(contests(spark, sf), view(spark, sf, "players_v"))


def digits(date):
    return F.date_format(date, "yyyyMMdd").cast("int")


def _write_years(spark, matches, encoding="UTF-8"):
    """One write of all yearly files, dates as YYYYMMDD; returns the folder and the years in it."""
    folder = scratch_path(spark, "years")
    dated = matches.withColumn("year", F.year("tourney_date")).withColumn("tourney_date", digits("tourney_date"))
    files.write_table(dated, f"{folder}/sup_matches", "csv", ["year"], encoding)
    years = [r.year for r in matches.select(F.year("tourney_date").alias("year")).distinct().collect()]
    return folder, sorted(years)


@query("a1_yearly_scan", """
select match_num, cast(tourney_date as string) as tourney_date, surface, round, cast(winner_id as bigint) as winner_id,
       cast(loser_id as bigint) as loser_id, winner_name, loser_name, cast(w_svpt as double) as w_svpt from contests_li
""", "contests_li")
def a1(spark, sf):
    folder, years = _write_years(spark, view(spark, sf, "contests_li"))
    df = files.read_matches(spark, folder, "sup", years, layout=BY_YEAR)
    return df.select(*SHOWN, day("tourney_date").alias("tourney_date"), "w_svpt")


@query("a1_headers_scan", """
select match_num, cast(tourney_date as string) as tourney_date, surface, winner_name, case when year(tourney_date) % 3 = 2 then tourney_level end as venue
from contests_li
""", "contests_li")
def a1_headers(spark, sf):
    """Files of three headers in a folder with a space in its name; one has a column that the contract does not know."""
    matches, folder = view(spark, sf, "contests_li"), scratch_path(spark, "my files")
    dated = matches.withColumns({"year": F.year("tourney_date"), "tourney_date": digits("tourney_date")})
    columns = [c for c in dated.columns if c != "year"]
    for rest, order in enumerate((columns, columns[::-1], [*columns, "venue"])):
        part = dated.where(F.col("year") % 3 == rest).withColumn("venue", F.col("tourney_level")).select(*order, "year")
        part.write.mode("append").option("header", True).partitionBy("year").csv(f"{folder}/sup_matches")
    df = files.read_matches(spark, folder, "sup", None, layout={"tour": "{tour}_matches/year={year}"}, others=True)
    return df.select("match_num", day("tourney_date").alias("tourney_date"), "surface", "winner_name", F.col("others")["venue"].alias("venue"))


@query("a2_tier_scan", """
select match_num, case when round in ('RR', 'BR') then 'qual_chall' else 'tour' end as tier, surface, winner_name from contests_li
""", "contests_li")
def a2(spark, sf):
    matches = view(spark, sf, "contests_li")
    tier = F.when(F.col("round").isin("RR", "BR"), "qual_chall").otherwise("tour")
    folder = scratch_path(spark, "tiers")
    dated = matches.withColumns({"tier": tier, "year": F.year("tourney_date"), "tourney_date": digits("tourney_date")})
    files.write_table(dated, folder, "csv", ["tier", "year"])
    years = [r.year for r in matches.where(tier == "tour").select(F.year("tourney_date").alias("year")).distinct().collect()]
    df = files.read_matches(spark, folder, "sup", years, ("tour", "qual_chall", "futures"), layout=BY_TIER)
    return df.select("match_num", "tier", "surface", "winner_name")


@query("a3_glob_latin1_scan", """
select match_num, concat(winner_name, ' é') as winner_name, cast(tourney_date as string) as tourney_date from contests_li
""", "contests_li")
def a3(spark, sf):
    matches = view(spark, sf, "contests_li").withColumn("winner_name", F.concat("winner_name", F.lit(" é")))
    folder, _ = _write_years(spark, matches, "ISO-8859-1")
    df = files.read_matches(
        spark, folder, "sup", None, encoding="ISO-8859-1", strict_dates=False, layout={"tour": "{tour}_matches/year={year}"})
    return df.select("match_num", "winner_name", day("tourney_date").alias("tourney_date"))


@query("a4_pruned_scan", "select winner_name, loser_name from contests_li", "contests_li")
def a4(spark, sf):
    folder, years = _write_years(spark, view(spark, sf, "contests_li"))
    return files.read_matches(spark, folder, "sup", years, layout=BY_YEAR).select("winner_name", "loser_name")


@query("a5_players_scan", """
select player_id, player_name as name_first, 'P' as name_last, 'POR' as ioc from players_v
""", "players_v")
def a5(spark, sf):
    path = scratch_path(spark, "players")
    players = view(spark, sf, "players_v").select(
        "player_id", F.col("player_name").alias("name_first"), F.lit("P").alias("name_last"),
        F.lit("R").alias("hand"), F.lit("19900101").alias("dob"), F.lit("POR").alias("ioc"))
    return files.read_players(spark, files.write_table(players, path, "csv"))


@query("a6_rankings_scan", "select player as player_name, rank from rankings_v", "rankings_v")
def a6(spark, sf):
    path = files.write_table(view(spark, sf, "rankings_v"), scratch_path(spark, "rankings"), "csv")
    return files.read_rankings(spark, path)


RATED_SQL = """
select match_num, cast(tourney_date as string) as tourney_date, surface, winner_name, loser_name,
       round(winner_surface_elo, 6) as winner_surface_elo, round(loser_surface_elo, 6) as loser_surface_elo from rated_ev
"""


def _show_rated(df):
    return df.select("match_num", day("tourney_date").alias("tourney_date"), "surface", "winner_name", "loser_name",
                     r6("winner_surface_elo").alias("winner_surface_elo"), r6("loser_surface_elo").alias("loser_surface_elo"))


@query("a7_rated_scan", RATED_SQL, "rated_ev")
def a7(spark, sf):
    path = files.write_table(rated(spark, sf), scratch_path(spark, "rated"), "csv")
    return _show_rated(files.read_rated(spark, path, "csv"))


PLAYER_RATINGS_CTE = """
sides as (select match_num, surface, winner_name as name, winner_surface_elo as elo, 0 as role from rated_ev where surface is not null
          union all select match_num, surface, loser_name, loser_surface_elo, 1 from rated_ev where surface is not null),
last as (select name, surface, max_by(elo, match_num * 2 + role) as elo, count(*) as n from sides group by name, surface),
player_ratings as (
  select name, max(elo) filter (surface = 'Clay') as "elo_Clay", coalesce(max(n) filter (surface = 'Clay'), 0) as "matches_Clay",
         max(elo) filter (surface = 'Hard') as "elo_Hard", coalesce(max(n) filter (surface = 'Hard'), 0) as "matches_Hard",
         max(elo) filter (surface = 'Grass') as "elo_Grass", coalesce(max(n) filter (surface = 'Grass'), 0) as "matches_Grass",
         max(elo) filter (surface = 'Carpet') as "elo_Carpet", coalesce(max(n) filter (surface = 'Carpet'), 0) as "matches_Carpet",
         sum(elo * n) / sum(n) as elo_overall
  from last group by name)
"""


def _player_ratings_sql(surfaces):
    columns = ", ".join(f'round("elo_{s}", 6) as "elo_{s}", "matches_{s}"' for s in surfaces)
    return f"select name, {columns}, round(elo_overall, 6) as elo_overall from player_ratings"


def _show_ratings(df):
    return df.select(*[c if c == "name" or c.startswith("matches") else r6(c).alias(c) for c in df.columns])


ALL = ["Clay", "Hard", "Grass", "Carpet"]


@query("a8_player_ratings_scan", _player_ratings_sql(ALL), "rated_ev", PLAYER_RATINGS_CTE)
def a8(spark, sf):
    path = files.write_table(player_ratings(rated(spark, sf)), scratch_path(spark, "ratings"), "csv")
    return _show_ratings(files.read_player_ratings(spark, path, "csv"))


@query("a9_aliases_scan", "select trim(old_name) as old_name, trim(new_name) as new_name from aliases_v", "aliases_v")
def a9(spark, sf):
    path = files.write_table(view(spark, sf, "aliases_v"), scratch_path(spark, "aliases"), "csv")
    return files.read_aliases(spark, path)


@query("a10_extract_odds", r"""
with t as (select page_id, unnest(regexp_extract_all(html, '<tr>(.*?)</tr>', 1)) as row from odds_pages_v),
c as (select page_id, regexp_split_to_array(regexp_extract(row, 't-name">(.*?)</td>', 1), '\s*-\s*') as pair,
             list_transform(regexp_extract_all(row, 'course">(.*?)</td>', 1), lambda x: try_cast(x as double)) as odds from t)
select page_id, pair[1] as player1, pair[2] as player2,
       case when len(odds) = 2 and odds[1] is not null and odds[2] is not null then odds[1] end as odd1,
       case when len(odds) = 2 and odds[1] is not null and odds[2] is not null then odds[2] end as odd2
from c where len(pair) = 2
""", "odds_pages_v")
def a10(spark, sf):
    return extract_odds(view(spark, sf, "odds_pages_v"))


@query("a10_nested_pages", """
select match_num as page_id, winner_name as player1, concat(loser_name, ' & Co') as player2, 1.5::double as odd1, 2.25::double as odd2 from contests_ev
union all select match_num, loser_name, winner_name, null, null from contests_ev
""", "contests_ev")
def a10_nested(spark, sf):
    """Single quotes, none at all, a '>' in an attribute, entities, cells left open, a table inside a row, a second results table."""
    before = (
        "<tbody><table class='result'><tbody><tr><td class='t-name'>Not - This</td></tr></tbody></table><div class=x id='tournamentTabs-1-data'><p>a &lt; b<br>"
        "<table class='big result'><thead><tr><td class='t-name'>Nor that<td class=\"t-name\">Nor</td></tr></thead><!-- <tr><td class='t-name'>C - D --><tbody>"
        "<tr title='a > b'><td class='first t-name'><a href=\"#\">")
    after = "</tr></tbody></table></td></tr></tbody></table><table class='result'><tbody><tr><td class='t-name'>E - F</td></tr></tbody></table></div>"
    html = F.concat(
        F.lit(before), "winner_name", F.lit("</a> &#45; <b>"), "loser_name",
        F.lit(" &amp; Co</b></td><td class=course>1.5</td><td><table><tbody><tr><td class='t-name'>"), "loser_name", F.lit(" - "), "winner_name",
        F.lit("</td><td class='course'> 2.25 </td>"), F.lit(after))
    return extract_odds(contests(spark, sf).select(F.col("match_num").alias("page_id"), html.alias("html")))


# --- sinks ----------------------------------------------------------------------

@query("b1_write_rated", RATED_SQL, "rated_ev")
def b1(spark, sf):
    path = files.write_table(rated(spark, sf), scratch_path(spark, "rated"), partition_by=["surface"])
    return _show_rated(files.read_rated(spark, path))


@query("b2_write_player_ratings", _player_ratings_sql(ALL[:3]), "rated_ev", PLAYER_RATINGS_CTE)
def b2(spark, sf):
    full = files.write_table(player_ratings(rated(spark, sf)), scratch_path(spark, "ratings"), "csv")
    filtered = clean.drop_like(files.read_player_ratings(spark, full, "csv"), "carpet")
    path = files.write_table(filtered, scratch_path(spark, "ratings"), "csv")
    return _show_ratings(files.read_player_ratings(spark, path, "csv"))


PLAYER_TABLE_CTE = """
rows_ov as (select match_num, tourney_date, round, winner_id as player, 1 as win, winner_elo_post as elo, winner_played as n from overall_ev
            union all select match_num, tourney_date, round, loser_id, 0, loser_elo_post, loser_played from overall_ev),
rows_ev as (select *, row_number() over (order by tourney_date,
    case round when 'RR' then 0 when 'R128' then 1 when 'R64' then 2 when 'R32' then 3 when 'R16' then 4
               when 'QF' then 5 when 'SF' then 6 when 'F' then 7 end nulls last, match_num) as seq from rows_ov),
state as (select player, max_by(elo, seq) as elo, max_by(tourney_date, seq) as d, count(*) as n from rows_ev group by player),
high as (select player, max(elo) as peak from rows_ev where win = 1 and elo > 1500 group by player),
when_high as (select h.player, h.peak, min_by(r.tourney_date, r.seq) as peak_date
              from high h join rows_ev r on r.player = h.player and r.elo = h.peak and r.win = 1 group by h.player, h.peak),
player_table as (
  select p.player_id, coalesce(s.elo, 1500) as current_elo, s.d as last_tourney_date, coalesce(s.n, 0) as matches_played,
         coalesce(w.peak, 1500) as peak_elo, w.peak_date as peak_elo_date
  from players_v p left join state s on s.player = p.player_id left join when_high w on w.player = p.player_id)
"""
PLAYER_TABLE_SQL = """
select player_id, round(current_elo, 6) as current_elo, cast(last_tourney_date as string) as last_tourney_date, matches_played,
       round(peak_elo, 6) as peak_elo, cast(peak_elo_date as string) as peak_elo_date from player_table
"""


def show_player_table(df):
    return df.select("player_id", r6("current_elo").alias("current_elo"), day("last_tourney_date").alias("last_tourney_date"),
                     "matches_played", r6("peak_elo").alias("peak_elo"), day("peak_elo_date").alias("peak_elo_date"))


def ranked_players(spark, sf):
    return player_table(view(spark, sf, "players_v"), rating_rows(overall(spark, sf)))


@query("b3_write_snapshot", PLAYER_TABLE_SQL, "overall_ev", PLAYER_TABLE_CTE)
def b3(spark, sf):
    path = files.write_table(ranked_players(spark, sf), scratch_path(spark, "snapshot"))
    return show_player_table(spark.read.parquet(path))


@query("b3_write_active_snapshot", PLAYER_TABLE_SQL + " where matches_played > 0", "overall_ev", PLAYER_TABLE_CTE)
def b3_active(spark, sf):
    path = files.write_table(active_players(ranked_players(spark, sf)), scratch_path(spark, "active"))
    return show_player_table(spark.read.parquet(path))


@query("b3_write_year_end", """
select cast(year(tourney_date) as bigint) as year, player, round(max_by(elo, seq), 6) as elo from rows_ev group by 1, 2
""", "overall_ev", PLAYER_TABLE_CTE)
def b3_years(spark, sf):
    path = scratch_path(spark, "year-end")
    files.write_table(year_end_snapshots(rating_rows(overall(spark, sf))), path, partition_by=["year"])
    return spark.read.parquet(path).select(big("year").alias("year"), "player", r6("elo").alias("elo"))


@query("b4_write_series", """
select cast(tourney_date as string) as tourney_date, player, round(max_by(elo, seq), 6) as elo from rows_ev group by 1, 2
""", "overall_ev", PLAYER_TABLE_CTE)
def b4(spark, sf):
    path = files.write_table(rating_series(rating_rows(overall(spark, sf))), scratch_path(spark, "series"))
    return spark.read.parquet(path).select(day("tourney_date").alias("tourney_date"), "player", r6("elo").alias("elo"))


@query("b6_rating_chart", """
with ids as (select winner_name as name, min_by(winner_id, match_num) as id from rated_ev group by 1),
s as (select match_num, tourney_date, surface, winner_id as id, winner_surface_elo as elo from rated_ev where surface is not null
      union all select match_num, tourney_date, surface, loser_id, loser_surface_elo from rated_ev where surface is not null)
select name, surface, cast(tourney_date as string) as tourney_date, match_num, round(elo, 6) as surface_elo
from ids join s on s.id = ids.id
""", "rated_ev")
def b6(spark, sf):
    rows = player_history(rated(spark, sf)).where(F.col("surface").isNotNull())
    ordered = rows.orderBy("name", "surface", "tourney_date", "match_num")
    return ordered.select("name", "surface", day("tourney_date").alias("tourney_date"), "match_num", r6("surface_elo").alias("surface_elo"))


# --- cleaning -------------------------------------------------------------------

@query("c1_parse_date", "select match_num, cast(tourney_date as string) as parsed from contests_li", "contests_li")
def c1(spark, sf):
    raw = view(spark, sf, "contests_li").select("match_num", digits("tourney_date").alias("raw"))
    return raw.select("match_num", day(clean.parse_date(F.col("raw"))).alias("parsed"))


@query("c2_parse_date_tolerant", """
select match_num, cast(cast(try_strptime(case when round = 'BR' then concat(cast(year(tourney_date) as string), '1399')
         when round = 'RR' then 'unknown' else strftime(tourney_date, '%Y%m%d') end, '%Y%m%d') as date) as string) as parsed from contests_li
""", "contests_li")
def c2(spark, sf):
    raw = F.when(F.col("round") == "BR", F.concat(F.year("tourney_date").cast("string"), F.lit("1399"))).when(
        F.col("round") == "RR", "unknown").otherwise(F.date_format("tourney_date", "yyyyMMdd"))
    return view(spark, sf, "contests_li").select("match_num", day(clean.parse_date(raw, coerce=True)).alias("parsed"))


@query("c3_to_numeric", "select match_num, cast(minutes as double) as minutes from contests_ev", "contests_ev")
def c3(spark, sf):
    text = F.coalesce(F.col("minutes").cast("string"), F.lit("RET"))
    return clean.to_numeric(contests(spark, sf).select("match_num", text.alias("minutes")), ["minutes"])


@query("c4_valid_matches", """
select match_num, surface, winner_rank, loser_rank from contests_ev
where surface is not null and winner_rank is not null and loser_rank is not null
""", "contests_ev")
def c4(spark, sf):
    df = clean.valid_matches(contests(spark, sf), ["surface", "winner_rank", "loser_rank"])
    return df.select("match_num", "surface", big("winner_rank").alias("winner_rank"), big("loser_rank").alias("loser_rank"))


@query("c5_drop_incomplete", """
select match_num, surface, target, minutes, rank from (
  select match_num, surface, 1::bigint as target, minutes, winner_rank as rank from contests_ev
  union all select match_num, surface, 0::bigint, minutes, loser_rank from contests_ev)
where surface is not null and minutes is not null and rank is not null
""", "contests_ev")
def c5(spark, sf):
    rows = perspectives(contests(spark, sf), "name", ["match_num", "surface", "minutes"])
    return clean.valid_matches(rows.select(
        "match_num", "surface", "target", big("minutes").alias("minutes"), big("player_rank").alias("rank")))


@query("c6_defaults", """
select match_num, round(coalesce(winner_surface_elo, 1500), 6) as winner_surface_elo,
       round(coalesce(loser_surface_elo, 1500), 6) as loser_surface_elo, coalesce(winner_rank, 2000) as winner_rank from rated_ev
""", "rated_ev")
def c6(spark, sf):
    df = clean.with_defaults(rated(spark, sf), ["winner_surface_elo", "loser_surface_elo"], ["winner_rank"])
    return df.select("match_num", r6("winner_surface_elo").alias("winner_surface_elo"),
                     r6("loser_surface_elo").alias("loser_surface_elo"), big("winner_rank").alias("winner_rank"))


@query("c7_surfaces", "select distinct surface from contests_li", "contests_li")
def c7(spark, sf):
    return clean.surfaces(view(spark, sf, "contests_li"))


@query("c8_players", "select winner_name as player from contests_li union select loser_name from contests_li", "contests_li")
def c8(spark, sf):
    return clean.players(view(spark, sf, "contests_li"))


@query("c9_normalise", """
select p_partkey, trim(concat('  ', p_name, ' ')) as name, concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) as surface from part
""")
def c9(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", names.normalise_name(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("name"),
        names.capitalise(F.col("p_type")).alias("surface"))


@query("c10_aliases", """
select c.match_num, coalesce(trim(a.new_name), c.winner_name) as winner_name
from contests_ev c left join aliases_v a on trim(a.old_name) = c.winner_name
""", "contests_ev aliases_v")
def c10(spark, sf):
    matches = contests(spark, sf).select("match_num", "winner_name")
    return names.resolve_aliases(matches, "winner_name", view(spark, sf, "aliases_v"))


def _name_tables(spark, sf):
    asked = view(spark, sf, "name_queries_v").select(F.col("query_name").alias("query"))
    return asked, table(spark, sf, "part").select(F.col("p_name").alias("name"))


@query("c11_closest_levenshtein", """
with n as (select distinct p_name as name from part),
s as (select query_name as query, name, 1 - levenshtein(query_name, name) / greatest(length(query_name), length(name)) as score
      from name_queries_v, n),
r as (select *, row_number() over (partition by query order by score desc, name desc) as rn from s where score >= cast(0.6 as double))
select query, name, round(score, 6) as score from r where rn = 1
""", "name_queries_v")
def c11_levenshtein(spark, sf):
    asked, known = _name_tables(spark, sf)
    return names.closest_name(asked, known, 0.6, "levenshtein").select("query", "name", r6("score").alias("score"))


@query("c11_closest_name")
def c11(spark, sf):
    asked, known = _name_tables(spark, sf)
    return names.closest_name(asked, known, 0.7)


@query("c12_split_pair", r"""
select match_num, p[1] as player1, p[2] as player2 from (
  select match_num, regexp_split_to_array(concat(winner_name, ' - ', loser_name, case when round = 'BR' then '-x' else '' end), '\s*-\s*') as p from contests_ev)
where len(p) = 2
""", "contests_ev")
def c12(spark, sf):
    tail = F.when(F.col("round") == "BR", "-x").otherwise("")
    text = F.concat("winner_name", F.lit(" - "), "loser_name", tail)
    pairs = contests(spark, sf).select("match_num", names.split_pair(text).alias("p")).where(F.col("p").isNotNull())
    return pairs.select("match_num", F.col("p")[0].alias("player1"), F.col("p")[1].alias("player2"))


@query("c13_drop_like", 'select name, "matches_Clay", "matches_Hard", "matches_Grass" from player_ratings', "rated_ev", PLAYER_RATINGS_CTE)
def c13(spark, sf):
    return clean.drop_like(clean.drop_like(player_ratings(rated(spark, sf)), "CARPET"), "elo")


@query("c14_valid_surface", """
select match_num, case when surface in ('Clay', 'Hard', 'Grass') then surface else 'Hard' end as surface from contests_ev
""", "contests_ev")
def c14(spark, sf):
    return contests(spark, sf).select("match_num", clean.valid_surface(F.col("surface")).alias("surface"))


@query("c15_round_order", """
select match_num, case round when 'RR' then 0 when 'R128' then 1 when 'R64' then 2 when 'R32' then 3 when 'R16' then 4
       when 'QF' then 5 when 'SF' then 6 when 'F' then 7 end::bigint as round_order from contests_li
""", "contests_li")
def c15(spark, sf):
    return view(spark, sf, "contests_li").select("match_num", clean.round_order(F.col("round")).alias("round_order"))


@query("c16_slam_label", """
select match_num, case when tourney_name = 'Open' then null else concat(cast(year(tourney_date) as string), ' ',
         case tourney_name when 'Wimbledon' then 'Wimb' when 'US Open' then 'USO' when 'Australian Open' then 'AO'
         when 'Roland Garros' then 'RG' end) end as label from contests_ev
""", "contests_ev")
def c16(spark, sf):
    return contests(spark, sf).select("match_num", clean.slam_label(F.col("tourney_date"), F.col("tourney_name")).alias("label"))


@query("c17_year", "select match_num, cast(year(tourney_date) as bigint) as year from contests_li", "contests_li")
def c17(spark, sf):
    return view(spark, sf, "contests_li").select("match_num", big(F.year("tourney_date")).alias("year"))


@query("c18_select_rename", """
select match_num, winner_name as player1, loser_name as player2, surface from contests_li
""", "contests_li")
def c18(spark, sf):
    df = view(spark, sf, "contests_li").select("match_num", "winner_name", "loser_name", "surface", "round")
    return df.withColumnsRenamed({"winner_name": "player1", "loser_name": "player2"}).drop("round")


@query("c19_predicates", """
select match_num, round, surface from contests_li
where (round = 'F' or round in ('SF', 'QF')) and surface <> 'Grass'
""", "contests_li")
def c19(spark, sf):
    kept = ((F.col("round") == "F") | F.col("round").isin("SF", "QF")) & (F.col("surface") != "Grass")
    return view(spark, sf, "contests_li").where(kept).select("match_num", "round", "surface")


@query("c20_format_h2h", """
with s as (select winner_name as a, loser_name as b, 1 as w from contests_li union all select loser_name, winner_name, 0 from contests_li),
h as (select a, b, sum(w) as w, sum(1 - w) as l from s group by a, b)
select a as player, b as opponent, concat(cast(w as bigint), '-', cast(l as bigint), ' (', cast(round_even(w * 100.0::double / (w + l), 0) as bigint), '% para ', a, ')') as h2h from h
""", "contests_li")
def c20(spark, sf):
    record = h2h(history_view(view(spark, sf, "contests_li")))
    return record.select("player", "opponent", clean.format_h2h(F.col("wins"), F.col("losses"), F.col("player")).alias("h2h"))
