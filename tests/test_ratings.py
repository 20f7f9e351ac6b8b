"""Ratings against a plain walk, and the quirks that are kept."""

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from duelbook.operators import rating_tables as tables
from duelbook.operators.ratings import overall_elo, rating_state, surface_elo

ROUNDS = ["RR", "R128", "R64", "R32", "R16", "QF", "SF", "F"]


def walk(rows, career):
    """One-by-one walk: {match: (winner before, loser before, winner after, loser after)}."""
    elo, n, out = {}, {}, {}
    for r in rows:
        pool = r.tour if career else (r.tour, r.surface)
        w, l = (pool, r.winner_id), (pool, r.loser_id)
        a, b = elo.get(w, 1500.0), elo.get(l, 1500.0)
        e = 1 / (1 + 10 ** ((b - a) / 400))
        kw = 250 / (n.get(w, 0) + 5) ** 0.4 if career else 32
        kl = 250 / (n.get(l, 0) + 5) ** 0.4 if career else 32
        elo[w], elo[l] = a + kw * (1 - e), b + kl * (0 - (1 - e))
        n[w], n[l] = n.get(w, 0) + 1, n.get(l, 0) + 1
        out[r.match_num] = (a, b, elo[w], elo[l])
    return out


def by_surface(matches):
    rows = [r for r in matches.collect() if r.surface]
    return sorted(rows, key=lambda r: (r.tourney_date, r.match_num))


def by_round(matches):
    return sorted(matches.collect(), key=lambda r: (
        r.tourney_date, ROUNDS.index(r.round) if r.round in ROUNDS else 8, r.match_num))


def test_surface_elo_is_the_plain_walk(random_matches):
    expected = walk(by_surface(random_matches), career=False)
    rows = surface_elo(random_matches, post=True).collect()
    assert len(rows) == 1200
    for r in rows:
        if r.surface is None:
            assert r.winner_surface_elo is None and r.loser_surface_elo is None
        else:
            assert (r.winner_surface_elo, r.loser_surface_elo, r.winner_elo_post, r.loser_elo_post) == expected[r.match_num]


def test_sliced_pools_give_the_same_bits(random_matches):
    expected = walk(by_surface(random_matches), career=False)
    rows = surface_elo(random_matches, crowd=5, slice_rows=250, post=True).where("surface is not null").collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert (r.winner_surface_elo, r.loser_surface_elo, r.winner_elo_post, r.loser_elo_post) == expected[r.match_num]


def test_overall_elo_both_ways(random_matches):
    expected = walk(by_round(random_matches), career=True)
    for sizes in ({}, {"crowd": 5, "slice_rows": 500}):
        rows = overall_elo(random_matches, **sizes).collect()
        assert len(rows) == 1200
        for r in rows:
            got = (r.winner_elo_pre, r.loser_elo_pre, r.winner_elo_post, r.loser_elo_post)
            assert all(abs(x - y) < 1e-9 for x, y in zip(got, expected[r.match_num]))


def test_fixed_k_keeps_the_pool_sum(random_matches):
    rated = surface_elo(random_matches, post=True).where("surface is not null")
    gained = rated.select((F.col("winner_elo_post") - F.col("winner_surface_elo")
                           + F.col("loser_elo_post") - F.col("loser_surface_elo")).alias("g"))
    assert abs(gained.agg(F.sum("g")).first()[0]) < 1e-6


def test_resume_equals_one_run(random_matches):
    cut = datetime.date(2020, 1, 12)
    full = {r.match_num: r.winner_elo_post for r in overall_elo(random_matches).collect()}
    first = overall_elo(random_matches.where(F.col("tourney_date") <= cut))
    state = rating_state(tables.snapshot(tables.rating_rows(first)))
    rest = random_matches.where(F.col("tourney_date") > cut)
    for sizes in ({}, {"crowd": 5, "slice_rows": 200}):
        for r in overall_elo(rest, state=state, **sizes).collect():
            assert abs(r.winner_elo_post - full[r.match_num]) < 1e-9


def test_unknown_players_are_left_out(spark, random_matches):
    players = spark.range(1, 40).withColumnRenamed("id", "player_id")
    rows = overall_elo(random_matches, players).collect()
    assert rows and all(0 not in (r.winner_id, r.loser_id) for r in rows)


def test_peak_is_strict_first_and_from_wins(spark):
    seq = lambda i: (datetime.date(2020, 1, i), 0, i)
    rows = spark.createDataFrame(
        [("T", seq(1)[0], seq(1), 1, 1, 1500.0, 1550.0, 0), ("T", seq(2)[0], seq(2), 1, 0, 1550.0, 1600.0, 1),
         ("T", seq(3)[0], seq(3), 1, 1, 1500.0, 1550.0, 2), ("T", seq(1)[0], seq(1), 2, 1, 1400.0, 1500.0, 0)],
        "tour string, tourney_date date, seq struct<tourney_date:date,round_place:long,match_num:long>, player long, win int,"
        " elo_pre double, elo_post double, played_before long")
    peaks = {r.player: (r.peak_elo, r.peak_elo_date) for r in tables.peaks(rows).collect()}
    assert peaks[1] == (1550.0, datetime.date(2020, 1, 1))
    assert peaks[2] == (1500.0, None)


def test_interpolation_by_position(spark):
    d = [datetime.date(2020, 1, i) for i in (1, 2, 9, 10)]
    series = spark.createDataFrame(
        [("T", d[0], 1, 10.0), ("T", d[3], 1, 40.0), ("T", d[1], 2, 5.0), ("T", d[2], 3, 7.0)],
        "tour string, tourney_date date, player long, elo double")
    out = {(r.player, r.tourney_date): r.elo for r in tables.interpolate(series).collect()}
    assert [out[1, x] for x in d] == [10.0, 20.0, 30.0, 40.0]
    assert [out[2, x] for x in d] == [None, 5.0, 5.0, 5.0]
    assert len(out) == 12


def test_wide_series(spark):
    series = spark.createDataFrame(
        [("T", datetime.date(2020, 1, 1), 1, 10.0), ("T", datetime.date(2020, 1, 2), 2, 20.0)],
        "tour string, tourney_date date, player long, elo double")
    rows = tables.wide_series(series, [1, 2]).collect()
    assert [(r["1"], r["2"]) for r in rows] == [(10.0, None), (None, 20.0)]


def test_player_against_self_counts_once(spark):
    rated = spark.createDataFrame(
        [(1, "Clay", "A", "A", 1500.0, 1500.0), (2, "Clay", "A", "B", 1510.0, 1490.0)],
        "match_num long, surface string, winner_name string, loser_name string, winner_surface_elo double, loser_surface_elo double")
    table = {r.name: (r.elo, r.matches) for r in tables.surface_table(rated).collect()}
    assert table == {"A": (1510.0, 2), "B": (1490.0, 1)}


def columns_of(df):
    return sorted(tuple(r) for r in df.select("tour", "match_num", "winner_elo_pre", "loser_elo_pre", "winner_elo_post", "loser_elo_post", "winner_played").collect())


def test_arrivals_in_any_order_equal_one_run(spark, random_matches, tmp_path):
    """Two tours; files in order, a late one of one tour, one that overlaps, one with rows that cannot be rated."""
    from duelbook.streaming.yearly import current_ratings, rate_arrivals

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    players = spark.range(0, 39).withColumnRenamed("id", "player_id")
    day = F.expr("date_add(date'2020-01-20', datediff(tourney_date, date'2020-01-01') * 3)")
    matches = random_matches.withColumn("tour", F.when(F.col("match_num") % 3 == 0, "B").otherwise("A")).withColumn("tourney_date", day)
    late = (F.col("tour") == "B") & (F.col("match_num") % 7 == 0)
    bad = matches.limit(3).withColumn("tourney_date", F.lit(None).cast("date")).unionByName(matches.limit(2).withColumn("loser_id", F.col("winner_id")))
    files = [
        matches.where((F.col("tourney_date") < "2020-02-10") & ~late), matches.where((F.col("tourney_date") >= "2020-02-10") & ~late),
        matches.where(late & (F.col("tourney_date") < "2020-03-01")), matches.where(late).unionByName(bad), matches.where(late)]
    for i, part in enumerate(files):
        part.write.mode("append").parquet(source)
        rate_arrivals(spark, source, matches.schema, players, target)
        if i not in (2, 4):
            continue
        seen = files[0]
        for more in files[1 : i + 1]:
            seen = seen.unionByName(more)
        good = seen.where("tourney_date is not null").dropDuplicates(["tour", "match_num", "winner_id", "loser_id"]).where("winner_id <> loser_id")
        assert columns_of(current_ratings(spark, target)) == columns_of(overall_elo(good, players))
    cuts = {(r.batch, r.tour): str(r.month) for r in spark.read.parquet(f"{target}/cuts").collect()}
    assert (2, "A") not in cuts and cuts[2, "B"] == "2020-01-01"
    aside = Counter((r.batch, r.reason) for r in spark.read.parquet(f"{target}/aside").collect())
    assert aside[3, "null"] == 3 and aside[3, "self"] == 2 and aside[3, "repeated"] == files[2].join(
        players.withColumnRenamed("player_id", "winner_id"), "winner_id").join(players.withColumnRenamed("player_id", "loser_id"), "loser_id").count()
    assert aside[0, "unknown player"] and aside[4, "repeated"]


def test_components(spark):
    from duelbook.operators.graph import components

    rng, edges = random.Random(4), []
    for key in ("x", "y"):
        edges += [(key, rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    edges += [("z", i, i + 1) for i in range(60)] + [("z", 500, 500), ("x", 7, 7)]
    expected = {}
    for key in "xyz":
        head = {v: v for k, a, b in edges if k == key for v in (a, b)}
        for _ in range(300):
            for k, a, b in edges:
                if k == key:
                    head[a] = head[b] = min(head[a], head[b])
        expected |= {(key, v): h for v, h in head.items()}
    links = spark.createDataFrame(edges, "pool string, a long, b long")
    assert {(r.pool, r.node): r.component for r in components(links, ["pool"]).collect()} == expected
    assert components(links.where("false"), ["pool"]).count() == 0


def test_chains_give_the_same_bits(spark, random_matches):
    """One tour of leagues, and one that hangs together: independent chains, halved slices and the plain walk agree."""
    leagues = random_matches.withColumns({
        "winner_id": F.col("winner_id") * 10 + F.col("match_num") % 5, "loser_id": F.col("loser_id") * 10 + F.col("match_num") % 5})
    for matches, sizes in ((leagues, {"chain_rows": 100}), (random_matches, {"chain_rows": 500, "chunk_rows": 400})):
        expected = walk(by_round(matches), career=True)
        rows = overall_elo(matches, **sizes).collect()
        assert len(rows) == 1200
        for r in rows:
            assert (r.winner_elo_pre, r.loser_elo_pre, r.winner_elo_post, r.loser_elo_post) == expected[r.match_num]


def test_chains_run_in_several_tasks(spark, random_matches):
    from duelbook.operators import ratings

    leagues = random_matches.select(
        F.col("tour").alias("pool"), F.col("tourney_date").alias("d"), F.lit(0).cast("long").alias("r"), F.col("match_num").alias("m"),
        (F.col("winner_id") * 10 + F.col("match_num") % 5).alias("w"), (F.col("loser_id") * 10 + F.col("match_num") % 5).alias("l"))
    rated = ratings.rate(leagues, None, chain_rows=100)
    used = rated.select(F.input_file_name().alias("f")).distinct().count()
    assert used > 1 and rated.count() == 1200


def test_chains_go_on_from_a_state(random_matches):
    cut = datetime.date(2020, 1, 12)
    full = {r.match_num: r.winner_elo_post for r in overall_elo(random_matches).collect()}
    first = overall_elo(random_matches.where(F.col("tourney_date") <= cut))
    state = rating_state(tables.snapshot(tables.rating_rows(first)))
    rest = random_matches.where(F.col("tourney_date") > cut)
    assert all(r.winner_elo_post == full[r.match_num] for r in overall_elo(rest, state=state, chain_rows=300).collect())


def test_values_of_the_players_and_dates_asked(spark, random_matches):
    series = tables.rating_series(tables.rating_rows(overall_elo(random_matches)))
    order = lambda df: sorted((r.player, r.tourney_date, None if r.elo is None else round(r.elo, 9)) for r in df.collect())
    dense = order(tables.interpolate(series))
    asked = spark.createDataFrame([(p,) for p in (1, 5, 17, 99)], "player long")
    dates = series.where(F.dayofmonth("tourney_date") % 4 == 1).select("tour", "tourney_date").distinct()
    days = {r.tourney_date for r in dates.collect()}
    assert order(tables.interpolate(series, players=[1, 5, 17, 99])) == [x for x in dense if x[0] in (1, 5, 17)]
    assert order(tables.interpolate(series, players=asked, dates=dates)) == [x for x in dense if x[0] in (1, 5, 17) and x[1] in days]
    assert order(tables.interpolate(series, dates=dates)) == [x for x in dense if x[1] in days]
    for width in (1, 3, 64):
        places = tables.positions(series)
        assert order(tables.values_at(tables.intervals(series, places), places, width=width)) == dense
    assert order(tables.rating_series(tables.rating_rows(overall_elo(random_matches)), players=[5])) == [
        x for x in order(series) if x[0] == 5]


def test_chunks_and_contests_against_oneself(spark, random_matches):
    """Chunks of a long pool give the one-by-one bits; a contest against oneself is rated nowhere."""
    more = random_matches.where("match_num < 40").select(
        (F.col("match_num") + 5000).alias("match_num"), "tour", "tourney_date", "surface", "round", "winner_id",
        F.col("winner_id").alias("loser_id"), "winner_name", F.col("winner_name").alias("loser_name"))
    both = random_matches.unionByName(more)
    columns = ["match_num", "winner_surface_elo", "loser_surface_elo"]
    plain = sorted(map(tuple, surface_elo(random_matches).select(*columns).collect()))
    for sizes in ({}, {"chunk_rows": 60}, {"crowd": 5, "slice_rows": 250}):
        rows = sorted(map(tuple, surface_elo(both, **sizes).select(*columns).collect()))
        assert rows[: len(plain)] == plain
        assert all(r[1] is None and r[2] is None for r in rows[len(plain):])


def test_numbers_may_repeat_between_tournaments(spark, random_matches):
    """Two tournaments that both have a contest 1 stay two rows each with its own ratings, by winner and loser inside a number."""
    keys = ["match_num", "tourney_date", "winner_id", "loser_id", "surface"]
    again = random_matches.where("surface is not null").withColumn("match_num", F.col("match_num") % 30).dropDuplicates(keys)
    rows = sorted(again.collect(), key=lambda r: (r.tourney_date, r.match_num, r.winner_id, r.loser_id))
    elo, expected = {}, {}
    for r in rows:
        w, l = (r.surface, r.winner_id), (r.surface, r.loser_id)
        a, b = elo.get(w, 1500.0), elo.get(l, 1500.0)
        e = 1 / (1 + 10 ** ((b - a) / 400))
        elo[w], elo[l] = a + 32 * (1 - e), b + 32 * (0 - (1 - e))
        expected[tuple(r[k] for k in keys)] = (a, b)
    for sizes in ({}, {"crowd": 5, "slice_rows": 250}):
        got = surface_elo(again, **sizes).collect()
        assert {tuple(r[k] for k in keys): (r.winner_surface_elo, r.loser_surface_elo) for r in got} == expected and len(got) == len(rows)


def counted_rounds(monkeypatch, run):
    from duelbook.operators import ratings

    rounds = []
    keep = ratings.Relay.keep
    monkeypatch.setattr(ratings.Relay, "keep", lambda self, df: rounds.append("moved" in df.columns) or keep(self, df))
    rows = run()
    monkeypatch.undo()
    return rows, sum(rounds)


def test_a_slice_that_one_task_can_walk_takes_no_rounds(random_matches, monkeypatch):
    """Contests of two players of one task are rated as they are; only ratings that travel between tasks need rounds."""
    expected = walk(by_surface(random_matches), career=False)
    for sizes, most in (({}, 0), ({"task_views": 60}, None)):
        rows, rounds = counted_rounds(monkeypatch, lambda: surface_elo(random_matches, crowd=5, slice_rows=250, post=True, **sizes).where(
            "surface is not null").collect())
        assert len(rows) == len(expected) and (most is None or rounds <= most)
        for r in rows:
            assert (r.winner_surface_elo, r.loser_surface_elo, r.winner_elo_post, r.loser_elo_post) == expected[r.match_num]


def test_components_start_from_few_links(spark):
    """Many links between few players: a task hands on no more links than players, in any number of flushes."""
    from duelbook.operators import graph

    links = spark.range(20_000, numPartitions=4).select(
        F.lit("x").alias("pool"), (F.col("id") % 50 * 2).alias("a"), (F.col("id") * 7 % 50 * 2).alias("b"))
    links = links.unionByName(links.select("pool", (F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"))).where("a <> b")
    assert graph._forest(links, ["pool"]).count() <= 4 * 2 * 100
    assert {(r.node, r.component) for r in graph.components(links, ["pool"]).where("node > 1").collect()} == {
        (r.node, r.component) for r in graph.components(links.distinct(), ["pool"]).where("node > 1").collect()}
    flushed = graph._forest(links, ["pool"], most=100)
    assert {(r.node, r.component) for r in graph.components(flushed, ["pool"]).collect()} == {
        (r.node, r.component) for r in graph.components(links, ["pool"]).collect()}


def test_no_task_meets_all_contests_of_a_pool(spark, random_matches):
    """The contests of one large pool are not brought together by the number of their slice."""
    from duelbook.operators import ratings

    bouts = random_matches.select(
        F.col("tour").alias("pool"), F.col("tourney_date").alias("d"), F.lit(0).cast("long").alias("r"), F.col("match_num").alias("m"),
        F.col("winner_id").alias("w"), F.col("loser_id").alias("l"))
    sizes = spark.createDataFrame([("ATP", 100)], "pool string, slice_rows int")
    dates = ratings._dates(bouts, sizes)
    plan = ratings._cut(bouts, dates)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    numbers = [r.slice for r in dates.select("slice").distinct().orderBy("slice").collect()]
    assert len(numbers) > 2 and ratings._cut(bouts, dates).count() == 1200
