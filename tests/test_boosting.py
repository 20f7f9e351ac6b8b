"""Second-order trees against a plain recomputation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelbook.operators import boosting

COLUMNS = ["player_elo", "h2h_matches", "elo_diff"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), rng.randrange(6), rng.choice([None, float("nan"), rng.random(), rng.random()])
        y = int(rng.random() < 1 / (1 + math.exp(-2 * a - (b > 3) + (1.5 if c is None else 0))))
        out.append((i, a, float(b), c, y))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "match_num long, player_elo double, h2h_matches double, elo_diff double, target long").repartition(5)


def grow(x, y, cuts, rounds, depth, l2=1.0, step=0.3, least=1.0):
    """Each round's splits as {node: (feature, cut, gain)} and the final margins, a row at a time."""
    bins = [[-1 if v is None or math.isnan(v) else sum(p <= v for p in cuts[j]) for j, v in enumerate(r)] for r in x]
    margin, trees = [0.0] * len(x), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        members, splits, values = {0: range(len(x))}, {}, {}
        for node in range(2 ** (depth + 1) - 1):
            if node not in members:
                continue
            own = members[node]
            total_g, total_h = sum(g[i] for i in own), sum(h[i] for i in own)
            values[node] = -step * total_g / (total_h + l2)
            best = None
            for f in range(len(cuts)):
                for b in sorted({bins[i][f] for i in own} - {-1}):
                    for gone in (False, True):
                        left = [i for i in own if (gone if bins[i][f] == -1 else bins[i][f] <= b)]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if lh < least or total_h - lh < least:
                            continue
                        gain = lg**2 / (lh + l2) + (total_g - lg) ** 2 / (total_h - lh + l2) - total_g**2 / (total_h + l2)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, b, gone)
            if node < 2**depth - 1 and best and best[0] > 1e-6:
                _, f, b, gone = best
                splits[node] = (f, b, best[0])
                members[2 * node + 1] = [i for i in own if (gone if bins[i][f] == -1 else bins[i][f] <= b)]
                members[2 * node + 2] = [i for i in own if i not in set(members[2 * node + 1])]
            else:
                for i in own:
                    margin[i] += values[node]
        trees.append(splits)
    return trees, margin


@pytest.mark.parametrize("rounds, depth", [(1, 3), (12, 2)])
def test_trees_are_the_plain_ones(frame, rows, rounds, depth):
    cuts = {"player_elo": [-1.5, -0.5, 0.0, 0.4, 1.1], "h2h_matches": [1.0, 2.0, 3.0, 4.0, 5.0], "elo_diff": [0.2, 0.5, 0.9]}
    model = boosting.train_second_order(frame, columns=COLUMNS, cuts=cuts, rounds=rounds, depth=depth)
    trees, margin = grow([r[1:4] for r in rows], [r[4] for r in rows], [cuts[c] for c in COLUMNS], rounds, depth)
    for tree, splits in zip(model.trees, trees):
        got = {i: (f, tree.cut[i], tree.gain[i]) for i, f in enumerate(tree.feature) if f >= 0}
        assert {i: s[:2] for i, s in got.items()} == {i: s[:2] for i, s in splits.items()}
        assert all(abs(got[i][2] - s[2]) < 1e-5 for i, s in splits.items())
    found = {r.match_num: r.p for r in model.score(frame).collect()}
    assert all(abs(found[i] - 1 / (1 + math.exp(-m))) < 1e-6 for i, m in enumerate(margin))


def test_the_model_does_not_depend_on_partitions(frame):
    first, second = (boosting.train_second_order(f, columns=COLUMNS, rounds=3, depth=3) for f in (frame, frame.repartition(2, "h2h_matches")))
    assert [vars(t) for t in first.trees] == [vars(t) for t in second.trees] and first.cuts == second.cuts


def test_cuts_and_importances(frame, rows):
    found = boosting.find_cuts(frame.select(*[F.col(c).alias(f"x_{c}") for c in COLUMNS]), [f"x_{c}" for c in COLUMNS], bins=16)
    assert found["x_h2h_matches"] == [1.0, 2.0, 3.0, 4.0, 5.0] and 10 <= len(found["x_player_elo"]) <= 15
    model = boosting.train_second_order(frame, columns=COLUMNS, rounds=2, depth=2)
    shares = [tuple(r) for r in model.importances().collect()]
    assert abs(sum(s for _, s in shares) - 1) < 1e-9 and shares[0][0] == "player_elo"
    nodes = model.nodes().collect()
    assert {r.tree for r in nodes} == {0, 1} and all((r.feature is None) == (r.value is not None) for r in nodes)


def test_bins_meet_their_cuts():
    bins = boosting.into_bins(np.array([[0.5, 2.0], [1.0, np.nan], [9.0, 1.9]]), [[1.0, 3.0], [2.0]])
    assert bins.tolist() == [[0, 1], [1, -1], [2, 0]]


def test_one_class_and_no_rows(frame):
    one = boosting.train_second_order(frame.where("target = 1"), columns=COLUMNS, rounds=2, depth=2)
    assert all(r.p > 0.5 for r in one.score(frame).collect())
    none = boosting.train_second_order(frame.where("false"), columns=COLUMNS, rounds=1, depth=2)
    assert {r.p for r in none.score(frame).collect()} == {0.5}
