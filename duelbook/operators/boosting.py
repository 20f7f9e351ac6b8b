"""Second-order boosted trees: gradients and hessians summed by node, feature and bin.

Features are cut into bins once.  A level of a tree is one pass: each task adds up the gradients and hessians of its rows
per (node, feature, bin), the sums are combined by key, and the best split of every node is chosen from running sums over
a feature's bins, so the driver receives one row per node.  Sums are whole numbers of 2**-30, so a model does not depend on
how rows are dealt out or on a task that runs twice.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelbook.operators.models import BOOSTED_PRESETS, COLUMNS, prepared
from duelbook.session import Relay, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get the functions below whole

BINS = 256
ACCURACY = 10_000  # of the quantiles that cut a feature of more values than bins
UNIT = 1 << 30  # gradients are counted in parts of this
KEPT = 10  # rounds after which rows store what the trees so far give them
MISSING = -1  # the bin of NULL and NaN
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes in heap order: the children of ``i`` are ``2i + 1`` (below the cut) and ``2i + 2``."""

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]
    cover: list[float]

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [False] * n, [0.0] * n, [0.0] * n, [0.0] * n)


def place(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node each row has come to."""
    at = np.zeros(len(bins), np.int64)
    feature, cut, missing_left = (np.array(x) for x in (tree.feature, tree.cut, tree.missing_left))
    rows = np.arange(len(bins))
    for _ in range(depth):
        f = feature[at]
        own = bins[rows, np.maximum(f, 0)]
        left = np.where(own == MISSING, missing_left[at], own <= cut[at])
        at = np.where(f >= 0, 2 * at + np.where(left, 1, 2), at)
    return at


def into_bins(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """How many cuts of its feature each value has reached."""
    out = np.empty(values.shape, np.int16)
    for j, points in enumerate(cuts):
        out[:, j] = np.searchsorted(points, values[:, j], side="right")
    out[np.isnan(values)] = MISSING
    return out


def matrix(batch: pa.RecordBatch, first: int, width: int) -> np.ndarray:
    return np.column_stack([batch.column(first + j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)])


def find_cuts(frame: DataFrame, names: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Cut points per column: each value but the least where there are few, else quantiles.

    Two aggregates, whatever the number of columns; the driver gets at most ``bins`` points of each.
    """
    shares = [i / bins for i in range(1, bins)]
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in names}
    row = frame.agg(
        *[F.approx_count_distinct(known[c], 0.02).alias(f"n_{c}") for c in names],
        *[F.percentile_approx(known[c], shares, ACCURACY).alias(f"q_{c}") for c in names]).first()
    few = [c for c in names if row[f"n_{c}"] <= bins]
    sets = frame.agg(*[F.collect_set(known[c]).alias(c) for c in few]).first() if few else {}
    out = {}
    for c in names:
        points = sorted(set(sets[c]))[1:] if c in few else sorted(set(row[f"q_{c}"]))
        out[c] = [float(p) for p in points]
    return out


@dataclass
class SecondOrder:
    """Boosted trees with the cuts of their features."""

    columns: list[str]
    cuts: list[list[float]]
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Adds the probability of class 1."""
        cuts, depth, trees = self.cuts, self.depth, self.trees

        @F.pandas_udf("double")
        def probability(x: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-margins(trees, into_bins(x.to_numpy(dtype=float), cuts), depth))))

        frame = prepared(df, self.columns)
        return frame.select(*df.columns, probability(F.struct(*[f"x_{c}" for c in self.columns])).alias(name))

    def importances(self, n: int = 10) -> DataFrame:
        """Mean gain of the splits on each column, as a share; the ``n`` highest first."""
        gains: dict[str, list[float]] = {}
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    gains.setdefault(self.columns[f], []).append(gain)
        means = {c: sum(g) / len(g) for c, g in gains.items()}
        rows = [(c, means.get(c, 0.0) / (sum(means.values()) or 1.0)) for c in self.columns]
        made = SparkSession.active().createDataFrame(rows, "feature string, importance double")
        return made.orderBy(F.desc("importance"), "feature").limit(n)

    def nodes(self) -> DataFrame:
        """``tree, node, feature, threshold, gain, cover, value``: splits and leaves; a value below the threshold goes left."""
        rows = []
        for t, tree in enumerate(self.trees):
            reached = [0]
            for i in reached:
                f = tree.feature[i]
                split = f >= 0
                rows.append((t, i, self.columns[f] if split else None, self.cuts[f][tree.cut[i]] if split else None,
                             tree.gain[i] if split else None, tree.cover[i], None if split else tree.value[i]))
                reached += [2 * i + 1, 2 * i + 2] * split
        return SparkSession.active().createDataFrame(
            rows, "tree int, node int, feature string, threshold double, gain double, cover double, value double")


def margins(trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros(len(bins))
    for tree in trees:
        out += np.array(tree.value)[place(tree, bins, depth)]
    return out


def unpack(batch: pa.RecordBatch, width: int, trees: list[Tree], depth: int):
    """Labels, bins and margins of stored rows, the margins brought up to the trees made since."""
    bins = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return batch.column(0).to_numpy(zero_copy_only=False), bins, batch.column(2).to_numpy(zero_copy_only=False) + margins(trees, bins, depth)


def level_sums(rows: DataFrame, width: int, trees: list[Tree], tree: Tree, nodes: list[int], depth: int, longest: int) -> DataFrame:
    """``node, feature, bin, g, h`` summed over all rows that have come to ``nodes``."""
    numbers = np.full(2 ** (depth + 1) - 1, -1)
    numbers[nodes] = np.arange(len(nodes))

    def sums(batches):
        cells = longest + 1  # the bins of a feature and the missing one
        g, h = (np.zeros((width, len(nodes) * cells), np.int64) for _ in range(2))
        seen = np.zeros(g.shape, bool)
        for batch in batches:
            y, bins, margin = unpack(batch, width, trees, depth)
            p = 1 / (1 + np.exp(-margin))
            at = numbers[place(tree, bins, depth)]
            keep = at >= 0
            at, bins = at[keep] * cells, bins[keep].astype(np.int64) + 1
            down, bend = (np.rint(x[keep] * UNIT) for x in (p - y, p * (1 - p)))
            for j in range(width):
                place_of = at + bins[:, j]
                # Doubles hold these whole numbers exactly: a batch of 2**23 rows sums to 2**53 at most.
                g[j] += np.bincount(place_of, down, g.shape[1]).astype(np.int64)
                h[j] += np.bincount(place_of, bend, g.shape[1]).astype(np.int64)
                seen[j, place_of] = True
        f, cell = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(nodes)[cell // cells], pa.int32()), pa.array(f, pa.int32()), pa.array(cell % cells - 1, pa.int32()),
             pa.array(g[f, cell]), pa.array(h[f, cell])], names=["node", "feature", "bin", "g", "h"])

    made = rows.mapInArrow(sums, "node int, feature int, bin int, g long, h long")
    return made.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, l2: float, least_cover: float) -> list:
    """One row per node: its totals and its best split, the least feature and bin among equals."""
    of_feature = Window.partitionBy("node", "feature")
    running = of_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.col("bin") == MISSING
    for c in ("g", "h"):
        sums = sums.withColumns({
            f"{c}_all": F.sum(c).over(of_feature) / UNIT, f"{c}_gone": F.coalesce(F.sum(F.when(held, F.col(c))).over(of_feature), F.lit(0)) / UNIT,
            f"{c}_low": F.sum(F.when(held, 0).otherwise(F.col(c))).over(running) / UNIT})

    def side(g, h):
        return g * g / (h + l2)

    def split(missing_left: bool):
        g, h = ((F.col(f"{c}_low") + F.col(f"{c}_gone") if missing_left else F.col(f"{c}_low")) for c in ("g", "h"))
        rest_g, rest_h = F.col("g_all") - g, F.col("h_all") - h
        fits = ~held & (h >= least_cover) & (rest_h >= least_cover)
        gain = side(g, h) + side(rest_g, rest_h) - side(F.col("g_all"), F.col("h_all"))
        return F.struct(F.when(fits, gain).otherwise(float("-inf")).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"),
                        F.lit(missing_left).alias("missing_left"), g.alias("g"), h.alias("h"))

    best = F.max(F.greatest(split(False), split(True))).alias("best")
    return sums.groupBy("node").agg(F.first("g_all").alias("g_all"), F.first("h_all").alias("h_all"), best).collect()


def train_second_order(
    df: DataFrame, preset: str = "full", columns: list[str] = COLUMNS, cuts: dict[str, list[float]] | None = None, rounds: int | None = None,
    depth: int | None = None, l2: float = 1.0, least_cover: float = 1.0, label: str = "target",
) -> SecondOrder:
    """Trees under logistic loss, each fitted to the gradients and hessians that the ones before leave.

    ``preset`` gives rounds, depth and step; ``rounds``, ``depth`` and ``cuts`` replace them and the cut points found.  The
    gain of a split is G_l^2/(H_l+l2) + G_r^2/(H_r+l2) - G^2/(H+l2), a leaf is worth -step G/(H+l2), and no side weighs less
    than ``least_cover`` in hessians.  NULL and NaN go to the side where they gain more.
    """
    settings = BOOSTED_PRESETS[preset]
    rounds, depth, step = rounds or settings["maxIter"], depth or settings["maxDepth"], settings["stepSize"]
    names, spark = [f"x_{c}" for c in columns], df.sparkSession
    path = scratch_path(spark, "frame")
    prepared(df, columns).where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *names).write.parquet(path)
    frame = spark.read.parquet(path)
    found = {c: sorted(points) for c, points in cuts.items()} if cuts else {}
    rest = [c for c in columns if c not in found]
    if rest:
        found |= {c[2:]: points for c, points in find_cuts(frame, [f"x_{c}" for c in rest]).items()}
    points = [found[c] for c in columns]
    width, longest = len(columns), max(map(len, points), default=0) + 1
    relay = Relay(spark, "boosted")
    shape = "y double, bins array<smallint>, margin double"

    def listed(bins):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * width), pa.array(bins.ravel()))

    def start(batches):
        for batch in batches:
            bins = into_bins(matrix(batch, 1, width), points)
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(bins), pa.array(np.zeros(len(bins)))], names=["y", "bins", "margin"])

    rows, model, since = relay.keep(frame.mapInArrow(start, shape)), SecondOrder(columns, points, depth), []
    for _ in range(rounds):
        tree, level = Tree.of_depth(depth), [0]
        for _ in range(depth):
            if not level:
                break
            grown = []
            for row in best_splits(level_sums(rows, width, since, tree, level, depth, longest), l2, least_cover):
                i, best = row["node"], row["best"]
                tree.cover[i], tree.value[i] = row["h_all"], -step * row["g_all"] / (row["h_all"] + l2)
                if best["gain"] > LEAST_GAIN:
                    tree.feature[i], tree.cut[i], tree.missing_left[i], tree.gain[i] = -best["feature"], -best["bin"], best["missing_left"], best["gain"]
                    sides = (best["g"], best["h"]), (row["g_all"] - best["g"], row["h_all"] - best["h"])
                    for child, (g, h) in zip((2 * i + 1, 2 * i + 2), sides):
                        tree.cover[child], tree.value[child] = h, -step * g / (h + l2)
                        grown.append(child)
            level = grown
        model.trees.append(tree)
        since.append(tree)
        if len(since) == KEPT:
            done = list(since)

            def store(batches):
                for batch in batches:
                    margin = unpack(batch, width, done, depth)[2]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin)], names=["y", "bins", "margin"])

            rows, since = relay.keep(rows.mapInArrow(store, shape)), []
    return model
