"""Splits by position, samples, models and metrics."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duelbook.functions.position import key_at, keys_at
from duelbook.operators import features as feats
from duelbook.operators import models, splits
from duelbook.operators.history import history_view
from duelbook.operators.ratings import surface_elo


def test_key_at_every_position(spark):
    values = [(d, m) for d in (5, 5, 5, 5, 9, -3) for m in range(40)]
    values = [(d, m * 10**15 + i) for i, (d, m) in enumerate(values)]
    df = spark.createDataFrame(values, "d long, m long")
    order = sorted(values)
    for position in (0, 1, 39, 40, 77, 123, 239):
        assert tuple(key_at(df, ["d", "m"], position, small=3, pieces=4)) == order[position]


@pytest.mark.parametrize("by", [None, "target"])
def test_temporal_split_positions(random_matches, by):
    rows = history_view(random_matches)
    got = {(r.match_num, r.target): r.set for r in splits.split_temporal(rows, by).collect()}
    data = [(r.tourney_date, r.match_num, -r.target) for r in rows.collect()]
    for group in ([data] if by is None else [[x for x in data if x[2] == t] for t in (0, -1)]):
        n = len(group)
        for i, (_, m, t) in enumerate(sorted(group)):
            want = "train" if i < int(0.7 * n) else "validation" if i < int(0.7 * n) + int(0.15 * n) else "test"
            assert got[m, -t] == want


def test_keys_of_several_groups_and_positions(spark):
    """A group of one value in the first column, brackets that are shared, and sorted ends agree with plain sorting."""
    rows = [("a", 5, m * 10**12) for m in range(300)] + [("b", d % 7 - 3, d) for d in range(200)] + [("c", 1, 1)] * 30 + [("c", 1, 2)] * 3
    df = spark.createDataFrame(rows, "g string, d long, m long").repartition(4)
    wanted = {"a": [0, 1, 150, 299], "b": [7, 99], "c": [0, 29, 30, 32]}
    for small in (0, 3, 1000):
        found = keys_at(df, ["d", "m"], wanted, "g", small=small, pieces=4)
        for g, positions in wanted.items():
            order = sorted(r[1:] for r in rows if r[0] == g)
            assert {p: (found[g, p]["d"], found[g, p]["m"]) for p in positions} == {p: order[p] for p in positions}
    assert keys_at(df, ["d", "m"], {"a": []}, "g") == {}


def test_rows_without_a_date_come_last(random_matches):
    rows = history_view(random_matches).withColumn("tourney_date", F.when(F.col("match_num") % 4 > 0, F.col("tourney_date")))
    for by in (None, "target"):
        got = splits.split_temporal(rows, by).collect()
        sizes = Counter(r.set for r in got)
        assert sizes == {"train": 1680, "validation": 360, "test": 360}
        assert all(r.set != "train" for r in got if r.tourney_date is None)
        assert {r.set for r in got if r.tourney_date is None} == {"validation", "test"}


def test_random_split_sizes(random_matches):
    rows = history_view(random_matches).select("match_num", "target")
    sizes = Counter(r.set for r in splits.split_random(rows, ["match_num", "target"]).collect())
    assert sizes["test"] == math.ceil(0.2 * 2400) and sizes["train"] == 2400 - sizes["test"]
    per_class = Counter((r.set, r.target) for r in splits.split_random(rows, ["match_num", "target"], by="target").collect())
    assert per_class["test", 0] == per_class["test", 1] == 240
    folds = Counter((r.fold, r.target) for r in splits.even_folds(rows, ["match_num", "target"], 3).collect())
    assert set(folds.values()) == {400}


def test_pairs_are_of_different_players(random_matches):
    players = history_view(random_matches).select("player").distinct()
    pairs = splits.random_pairs(players, 5, 3).collect()
    assert len(pairs) == 5 and all(p.player1 != p.player2 for p in pairs)
    assert [tuple(p) for p in splits.random_pairs(players, 5, 3).collect()] == [tuple(p) for p in pairs]


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in feats.standardise(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_report(spark):
    rows = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 3
    pred = spark.createDataFrame(rows, "target long, prediction long")
    report = {r.name: r for r in models.classification_report(pred).collect()}
    assert report["1"].precision == 6 / 7 and report["1"].recall == 6 / 8 and report["1"].support == 8
    assert report["0"].precision == 3 / 5 and report["0"].recall == 3 / 4
    assert report["accuracy"].precision == 9 / 12 and report["accuracy"].support == 12
    assert abs(report["weighted avg"].recall - 0.75) < 1e-12
    assert models.accuracy(pred).first()[0] == 0.75
    assert models.f1(pred).first()[0] == 12 / 15


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,)], "target long")
    got = {r.target: r.weight for r in models.with_class_weights(df).collect()}
    assert got == {1: 4 / 6, 0: 4 / 2}


def test_forest_learns_reloads_and_calibrates(spark, tmp_path):
    """On contests the ratings decide, a forest must be near the rating-only baseline."""
    rows = spark.range(3000).select(
        F.col("id").alias("match_num"), (1400 + F.rand(1) * 200).alias("player_elo"), (1400 + F.rand(2) * 200).alias("opponent_elo"),
        F.rand(3).alias("u"), F.element_at(F.array(F.lit("Clay"), F.lit("Hard"), F.lit("Grass")), (F.col("id") % 3 + 1).cast("int")).alias("surface"))
    rows = rows.withColumn("elo_diff", F.col("player_elo") - F.col("opponent_elo"))
    rows = rows.withColumn("target", (F.col("u") < 1 / (1 + F.exp(-F.col("elo_diff") / 30))).cast("long"))
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    rows = splits.split_random(spark.read.parquet(path), ["match_num"])
    train, test = rows.where("set = 'train'"), rows.where("set = 'test'")
    base = models.accuracy(models.predictions(models.predict_elo(test))).first()[0]
    made = models.load_or_train(spark, str(tmp_path / "bundle"), lambda: models.train_forest(train, balanced=True))
    again = models.load_or_train(spark, str(tmp_path / "bundle"), None)
    one = {r.match_num: r.p for r in made.score(test).collect()}
    assert one == {r.match_num: r.p for r in again.score(test).collect()}
    assert models.accuracy(models.predictions(made.score(test))).first()[0] > base - 0.05
    top = made.importances(3).collect()
    assert top[0].feature in ("elo_diff", "player_elo", "opponent_elo") and len(top) == 3
    calibrated = models.calibrate(train, ["match_num"], preset="small")
    scored = calibrated.score(test)
    assert scored.where("p < 0 or p > 1 or p is null").count() == 0
    assert models.accuracy(models.predictions(scored)).first()[0] > base - 0.05


def test_predict_gives_winner_and_details(spark, random_matches):
    rated = surface_elo(random_matches)
    rows = splits.split_temporal(feats.features(rated), by="target")
    model = models.train_boosted(rows.where("set = 'train'"))
    queries = rated.where("surface is not null").select(
        F.col("match_num").alias("query_id"), F.col("winner_name").alias("player1"), F.col("loser_name").alias("player2"),
        "surface", "tourney_date")
    out = models.predict(queries, rated, model)
    assert out.count() == queries.count()
    assert out.where("confidence < 0.5 or (p > 0.5) <> (winner = player1)").count() == 0
    assert out.where("h2h is null or p is null").count() == 0
