import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from duelbook.session import local_session

    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def random_matches(spark):
    """1,200 contests of 40 players; player 0 is in a third of them, one date holds a third."""
    import datetime
    import random

    rng = random.Random(7)
    rows = []
    for m in range(1200):
        a = 0 if m % 3 == 0 else rng.randrange(1, 40)
        b = rng.choice([p for p in range(40) if p != a])
        w, l = (a, b) if rng.random() < 0.5 + (b - a) / 100 else (b, a)
        day = 10 if m % 3 == 1 else rng.randrange(0, 25)
        surface = rng.choice(["Clay", "Clay", "Hard", "Grass", None])
        rnd = rng.choice(["RR", "R32", "QF", "F", "BR", None])
        rows.append((m, "ATP", datetime.date(2020, 1, 1) + datetime.timedelta(day), surface, rnd, w, l, f"P{w}", f"P{l}"))
    return spark.createDataFrame(
        rows, "match_num long, tour string, tourney_date date, surface string, round string, winner_id long, loser_id long,"
        " winner_name string, loser_name string")
