"""As-of values against brute force, with a player in a third of all contests."""

import datetime

from pyspark.sql import functions as F

from duelbook.operators import history
from duelbook.operators.features import features, features_asof
from duelbook.operators.ratings import surface_elo


def brute(rows, r, player, opponent):
    earlier = [x for x in rows if x.tourney_date < r[0]]
    met = [x for x in earlier if {x.winner_name, x.loser_name} == {player, opponent}]
    mine = [x for x in earlier if x.surface == r[1] and player in (x.winner_name, x.loser_name)]
    elo = 1500.0
    if mine:
        last = max(mine, key=lambda x: (x.tourney_date, x.match_num))
        elo = last.winner_surface_elo if last.winner_name == player else last.loser_surface_elo
    return len(met), sum(x.winner_name == player for x in met), len(mine), sum(x.winner_name == player for x in mine), elo


def check(row, rows, date, player, opponent):
    met, won, n, wins, elo = brute(rows, (date, row.surface), player, opponent)
    _, _, on, owins, oelo = brute(rows, (date, row.surface), opponent, player)
    assert row.h2h_matches == met and row.player_surface_matches == n and row.opponent_surface_matches == on
    assert row.h2h_win_rate == (won / met if met else 0.5)
    assert row.player_surface_win_rate == (wins / n if n else 0.5)
    assert row.opponent_surface_win_rate == (owins / on if on else 0.5)
    assert (row.player_elo, row.opponent_elo, row.elo_diff) == (elo, oelo, elo - oelo)


def test_features_read_only_earlier_dates(random_matches):
    rated = surface_elo(random_matches)
    rows = [r for r in rated.collect() if r.surface]
    out = features(rated).collect()
    assert len(out) == 2 * len(rows)
    for row in out[::7]:
        check(row, rows, row.tourney_date, row.player, row.opponent)


def test_queries_answer_at_any_date_and_do_not_count(spark, random_matches):
    rated = surface_elo(random_matches)
    rows = [r for r in rated.collect() if r.surface]
    dates = [datetime.date(2019, 1, 1), datetime.date(2020, 1, 11), datetime.date(2021, 1, 1)]
    asked = [(i, f"P{i % 5}", f"P{i % 7 + 6}", s, d)
             for i, (s, d) in enumerate((s, d) for s in ("Clay", "Hard") for d in dates for _ in range(6))]
    asked.append((99, "nobody", "P1", "Clay", dates[2]))
    queries = spark.createDataFrame(asked, "query_id long, player1 string, player2 string, surface string, tourney_date date")
    out = features_asof(queries, rated).collect()
    assert len(out) == len(asked)
    for row in out:
        check(row, rows, row.tourney_date, row.player1, row.player2)


def test_h2h_is_symmetric(random_matches):
    record = {(r.player, r.opponent): (r.wins, r.losses) for r in history.h2h(history.history_view(random_matches)).collect()}
    for (a, b), (wins, losses) in record.items():
        assert record[b, a] == (losses, wins)


def test_post_ratings_as_alternative(random_matches):
    rated = surface_elo(random_matches, post=True)
    pre = features(rated).agg(F.sum("player_elo")).first()[0]
    post = features(rated, elo=("winner_elo_post", "loser_elo_post")).agg(F.sum("player_elo")).first()[0]
    assert pre != post


def test_card_lists_empty_surfaces_with_zero(spark):
    persp = spark.createDataFrame([("A", 1, "Clay"), ("A", 0, None)], "player string, target long, surface string")
    card = {r.surface: (r.games, r.wins, r.losses, r.win_percent) for r in history.player_card(persp).collect()}
    assert card == {"Clay": (1, 1, 0, 100.0), "Hard": (0, 0, 0, 0.0), "Grass": (0, 0, 0, 0.0), "Total": (2, 1, 1, 50.0)}


def test_lookup_of_strangers_is_zero(spark, random_matches):
    pairs = spark.createDataFrame([("P1", "nobody", datetime.date(2021, 1, 1))], "player1 string, player2 string, day date")
    persp = history.history_view(random_matches)
    for day in (None, "day"):
        row = history.h2h_lookup(pairs, persp, day).first()
        assert (row.wins, row.losses) == (0, 0)
