"""Models, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelbook.operators import models
from duelbook.operators.boosting import train_second_order
from duelbook.operators.features import features, features_asof
from duelbook.operators.splits import even_folds, split_temporal
from duelbook.plans.catalog import query, r6
from duelbook.plans.feature_queries import ASOF_FEATURES
from duelbook.plans.history_queries import ASOF_SQL, PERSP, RPERSP, pairings
from duelbook.plans.source_queries import stored_rated
from duelbook.session import cut_lineage, scratch_path

ELO_PRED = """
placed as (select *, row_number() over (partition by target order by tourney_date, match_num) - 1 as pos, count(*) over (partition by target) as n from features),
pred as (select match_num, target, case when pos < floor(0.7::double * n) then 'train'
                when pos < floor(0.7::double * n) + floor(0.15::double * n) then 'validation' else 'test' end as "set",
                (1 / (1 + pow(10, (opponent_elo - player_elo) / 400)) > 0.5)::bigint as prediction from placed),
cells as (select count(*) filter (target = 1 and prediction = 1)::double as tp, count(*) filter (target = 0 and prediction = 1)::double as fp,
                 count(*) filter (target = 1 and prediction = 0)::double as fn, count(*) filter (target = 0 and prediction = 0)::double as tn from pred)
"""


def split_rows(spark, sf):
    """Feature rows with their set, stored: training passes over them many times."""
    rows = cut_lineage(features(stored_rated(spark, sf)))
    return split_temporal(rows, by="target")


def elo_predictions(spark, sf):
    return models.predictions(models.predict_elo(split_rows(spark, sf)))


def _sets(rows, model):
    return models.evaluate(models.predictions(model.score(rows.where("set <> 'train'"))))


@query("i1_forest")
def i1(spark, sf):
    rows = split_rows(spark, sf)
    return _sets(rows, models.train_forest(rows.where("set = 'train'"), "small", balanced=True))


@query("i2_boosted")
def i2(spark, sf):
    rows = split_rows(spark, sf)
    return _sets(rows, models.train_boosted(rows.where("set = 'train'"), "small"))


# Cuts that no value of the tables falls on: (first, step, how many) per column.
TREE_CUTS = {
    "player_elo": (1300.37, 10.0, 41), "opponent_elo": (1300.37, 10.0, 41), "elo_diff": (-300.37, 15.0, 41), "h2h_win_rate": (0.0137, 0.05, 20),
    "h2h_matches": (0.5, 3.0, 30), "player_surface_win_rate": (0.0137, 0.02, 49), "player_surface_matches": (0.5, 7.0, 60),
    "opponent_surface_win_rate": (0.0137, 0.02, 49), "opponent_surface_matches": (0.5, 7.0, 60),
}
TREE_BINS = " union all ".join(
    f"select match_num, target, {i} as f, case when {c} < {a}::double then 0 else least(floor(({c} - {a}::double) / {step}::double)::int + 1, {n}) end as bin from training"
    for i, (c, (a, step, n)) in enumerate(TREE_CUTS.items()))
TREE_NAMES = "[" + ", ".join(f"'{c}'" for c in TREE_CUTS) + "]"
TREE_FIRST = "[" + ", ".join(f"{a}::double" for a, _, _ in TREE_CUTS.values()) + "]"
TREE_STEP = "[" + ", ".join(f"{step}::double" for _, step, _ in TREE_CUTS.values()) + "]"


def _splits_sql(level: int, rows: str) -> str:
    """The best split of each node of a level; ``rows`` has (match_num, target, node, f, bin)."""
    return f"""
hist{level} as (select node, f, bin, sum(0.5::double - target) as g, sum(0.25::double) as h from {rows} group by 1, 2, 3),
run{level} as (select node, f, bin, sum(g) over r as gl, sum(h) over r as hl, sum(g) over a as ga, sum(h) over a as ha from hist{level}
               window r as (partition by node, f order by bin rows unbounded preceding), a as (partition by node, f)),
best{level} as (select *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) as gain from run{level}
                where hl >= 1 and ha - hl >= 1
                qualify row_number() over (partition by node order by gain desc, f, bin) = 1)"""


TREE_SQL = f"""
training as (select f.* from features f join pred p on p.match_num = f.match_num and p.target = f.target where p."set" = 'train'),
binned as materialized ({TREE_BINS}),
rows0 as (select *, 0 as node from binned),{_splits_sql(0, "rows0")},
side as (select b.match_num, b.target, case when b.bin <= s.bin then 1 else 2 end as node from binned b join best0 s on s.f = b.f),
rows1 as (select b.*, side.node from binned b join side on side.match_num = b.match_num and side.target = b.target),{_splits_sql(1, "rows1")},
splits as (select node, f, bin, gain, gl, hl, ga, ha from best0 where gain > 1e-6::double union all select node, f, bin, gain, gl, hl, ga, ha from best1 where gain > 1e-6::double),
leaves as (select 2 * node + 1 as node, gl as g, hl as h from splits union all select 2 * node + 2, ga - gl, ha - hl from splits)
"""


def first_tree(spark, sf):
    rows = split_rows(spark, sf)
    cuts = {c: [a + step * i for i in range(n)] for c, (a, step, n) in TREE_CUTS.items()}
    return train_second_order(rows.where("set = 'train'"), columns=list(TREE_CUTS), cuts=cuts, rounds=1, depth=2)


@query("i2_second_order_tree", f"""
select node, {TREE_NAMES}[f + 1] as feature, round({TREE_FIRST}[f + 1] + {TREE_STEP}[f + 1] * bin, 6) as threshold, round(gain, 6) as gain,
       round(ha, 6) as cover, cast(null as double) as value from splits
union all select node, null, null, null, round(h, 6), round(-0.3::double * g / (h + 1), 6) from leaves where node not in (select node from splits)
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED + "," + TREE_SQL)
def i2_tree(spark, sf):
    """The first tree: its splits, their gains and the values of its leaves."""
    return first_tree(spark, sf).nodes().select("node", "feature", *[r6(c).alias(c) for c in ("threshold", "gain", "cover", "value")])


@query("i2_second_order", """
select "set", count(*) as n, true as in_range, case when "set" = 'train' then true end as learned from pred group by 1
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def i2_second_order(spark, sf):
    """Five rounds of trees of the published depth: probabilities for every set, and a loss below that of even odds where they learned."""
    rows = split_rows(spark, sf)
    model = train_second_order(rows.where("set = 'train'"), "full", rounds=5)
    loss = -F.avg(F.log(F.when(F.col("target") == 1, F.col("p")).otherwise(1 - F.col("p"))))
    return model.score(rows).groupBy("set").agg(
        F.count("*").alias("n"), F.min(F.col("p").between(0, 1)).alias("in_range"),
        F.when(F.col("set") == "train", loss < F.log(F.lit(2.0))).alias("learned"))


@query("i3_class_weights", """
with c as (select target, count(*) as n from pred where "set" = 'train' group by 1)
select p.match_num, p.target, round((select sum(n) from c) / ((select count(*) from c) * c.n), 6) as weight
from pred p join c on c.target = p.target where p."set" = 'train'
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def i3(spark, sf):
    rows = split_rows(spark, sf).where("set = 'train'")
    return models.with_class_weights(rows).select("match_num", "target", r6("weight").alias("weight"))


@query("i4_calibrated")
def i4(spark, sf):
    rows = split_rows(spark, sf)
    return _sets(rows, models.calibrate(rows.where("set = 'train'"), ["match_num", "target"]))


@query("i5_predict")
def i5(spark, sf):
    rows = split_rows(spark, sf)
    model = models.train_forest(rows.where("set = 'train'"), "small")
    return models.predict(pairings(spark, sf), stored_rated(spark, sf), model).select(
        "query_id", "player1", "player2", "winner", "confidence", "player_elo", "opponent_elo", "elo_diff", "h2h",
        "player_surface_win_rate", "opponent_surface_win_rate")


@query("i6_predict_elo", """
with p as (select *, 1 / (1 + pow(10, (opponent_elo - player_elo) / 400)) as p from asof_features)
select query_id, round(p, 6) as p, case when p > 0.5 then player1 else player2 end as winner, round(greatest(p, 1 - p), 6) as confidence from p
""", "rated_ev pairings_v", RPERSP + "," + ASOF_SQL)
def i6(spark, sf):
    scored = models.decide(models.predict_elo(features_asof(pairings(spark, sf), stored_rated(spark, sf))))
    return scored.select("query_id", r6("p").alias("p"), "winner", r6("confidence").alias("confidence"))


@query("j1_accuracy", "select round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy from cells", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def j1(spark, sf):
    return models.accuracy(elo_predictions(spark, sf)).select(r6("accuracy").alias("accuracy"))


@query("j2_f1", "select round(2 * tp / (2 * tp + fp + fn), 6) as f1 from cells", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def j2(spark, sf):
    return models.f1(elo_predictions(spark, sf)).select(r6("f1").alias("f1"))


@query("j3_report", """
with m as (select tp / (tp + fp) as p1, tp / (tp + fn) as r1, 2 * tp / (2 * tp + fp + fn) as f1, tn / (tn + fn) as p0, tn / (tn + fp) as r0,
                  2 * tn / (2 * tn + fp + fn) as f0, tp + fn as n1, tn + fp as n0, (tp + tn) / (tp + tn + fp + fn) as acc, tp + tn + fp + fn as n from cells),
l as (select '0' as name, p0 as p, r0 as r, f0 as f, n0 as s from m union all select '1', p1, r1, f1, n1 from m
      union all select 'accuracy', acc, acc, acc, n from m union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from m
      union all select 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n from m)
select name, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1_score, s::bigint as support from l
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def j3(spark, sf):
    report = models.classification_report(elo_predictions(spark, sf))
    return report.select("name", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query("j4_importances")
def j4(spark, sf):
    rows = split_rows(spark, sf)
    return models.train_forest(rows.where("set = 'train'"), "small").importances()


@query("j4_gain_importances", f"""
select name as feature, round(coalesce(m / sum(m) over (), 0), 6) as importance
from (select unnest({TREE_NAMES}) as name, unnest(range({len(TREE_CUTS)})) as f) n left join (select f, avg(gain) as m from splits group by f) g on g.f = n.f
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED + "," + TREE_SQL)
def j4_gain(spark, sf):
    """Mean gain per column, as a share of all."""
    return first_tree(spark, sf).importances().select("feature", r6("importance").alias("importance"))


@query("j5_evaluate", """
with c as (select "set", count(*) filter (target = 1 and prediction = 1)::double as tp, count(*) filter (target = 0 and prediction = 1)::double as fp,
                 count(*) filter (target = 1 and prediction = 0)::double as fn, count(*) filter (target = 0 and prediction = 0)::double as tn from pred where "set" <> 'train' group by 1)
select "set", (tp + fp + fn + tn)::bigint as n, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def j5(spark, sf):
    rows = elo_predictions(spark, sf)
    table = models.evaluate(rows.where("set <> 'train'"))
    return table.select("set", "n", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


@query("b5_bundle")
def b5(spark, sf):
    """Scores of a model that was trained, stored and loaded again."""
    rows = split_rows(spark, sf)
    path = scratch_path(spark, "bundle")
    models.load_or_train(spark, path, lambda: models.train_forest(rows.where("set = 'train'"), "small"))
    model = models.load_or_train(spark, path, lambda: None)
    return model.score(rows.where("set = 'test'")).select("match_num", "target", "p")


@query("b5_bundle_reloaded", """select match_num, target, true as same from pred where "set" = 'test'""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def b5_reloaded(spark, sf):
    """A stored model, after a later write that broke off, scores as it did before it was stored."""
    rows = split_rows(spark, sf)
    path = scratch_path(spark, "bundle")
    first = models.train_forest(rows.where("set = 'train'"), "small")
    models.save_bundle(first, path, {"sets": rows.groupBy("set").count()})
    rows.limit(1).write.parquet(f"{path}/versions/broken/columns")
    again = models.load_bundle(spark, path)
    held = rows.where("set = 'test'")
    both = first.score(held).select("match_num", "target", "p").join(
        again.score(held).select("match_num", "target", F.col("p").alias("q")), ["match_num", "target"])
    return both.select("match_num", "target", (F.col("p") == F.col("q")).alias("same"))


# --- facts of the models that SQL can tell: how many rows, what range, what means ------------

@query("i1_forest_facts", """
select "set", count(*) as n, true as in_range, case when "set" = 'train' then true end as learned from pred group by 1
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def i1_facts(spark, sf):
    """A balanced forest gives every row a probability, and a loss below that of even odds where it learned."""
    rows = split_rows(spark, sf)
    loss = -F.avg(F.log(F.greatest(F.when(F.col("target") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-9))))
    return models.train_forest(rows.where("set = 'train'"), "small", balanced=True).score(rows).groupBy("set").agg(
        F.count("*").alias("n"), F.min(F.col("p").between(0, 1)).alias("in_range"),
        F.when(F.col("set") == "train", loss < F.log(F.lit(2.0))).alias("learned"))


@query("i4_calibration_facts", """
with c as (select target, count(*) as n from pred where "set" = 'train' group by 1),
f as (select fold, sum(n * (fold + 1) // 3 - n * fold // 3)::bigint as n, sum(target * (n * (fold + 1) // 3 - n * fold // 3)) as ones
      from c, range(3) t(fold) group by fold)
select fold::int as fold, n, round(ones / n, 6) as mean_target, round(ones / n, 6) as mean_p, true as monotone from f
""", "rated_ev", ASOF_FEATURES + "," + ELO_PRED)
def i4_facts(spark, sf):
    """On the rows it was fitted to, a fold's curve has their mean and does not fall with the raw score."""
    rows = split_rows(spark, sf).where("set = 'train'")
    identity = ["match_num", "target"]
    parts = models.calibrate(rows, identity).parts
    folded = cut_lineage(even_folds(rows, identity, 3, models.SEED))
    out = None
    for fold, (bundle, curve) in enumerate(parts):
        held = bundle.score(folded.where(F.col("fold") == fold), "raw")
        held = curve.setFeaturesCol("raw").setPredictionCol("p").transform(held)
        steps = held.groupBy("fold", "raw").agg(F.first("p").alias("p"), F.count("*").alias("n"), F.sum("target").alias("ones"))
        before = F.lag("p").over(Window.partitionBy("fold").orderBy("raw"))
        facts = steps.withColumn("rises", F.coalesce(F.col("p") >= before, F.lit(True))).groupBy("fold").agg(
            F.sum("n").alias("n"), (F.sum("ones") / F.sum("n")).alias("mean_target"),
            (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_p"), F.min("rises").alias("monotone"))
        out = facts if out is None else out.unionByName(facts)
    return out.select("fold", "n", r6("mean_target").alias("mean_target"), r6("mean_p").alias("mean_p"), "monotone")


@query("i5_predict_facts", """
select query_id, true as agrees, true as in_range from pairings_v
where player1 in (select player from persp) and player2 in (select player from persp)
""", "contests_ev pairings_v", PERSP)
def i5_facts(spark, sf):
    """Every pairing of known players has a winner that goes with its probability."""
    rows = split_rows(spark, sf)
    model = models.train_forest(rows.where("set = 'train'"), "small")
    scored = models.predict(pairings(spark, sf), stored_rated(spark, sf), model)
    first = F.col("p") > 0.5
    return scored.select(
        "query_id", (F.when(first, F.col("player1")).otherwise(F.col("player2")) == F.col("winner")).alias("agrees"),
        (F.col("p").between(0, 1) & F.col("confidence").between(0.5, 1)).alias("in_range"))


@query("j4_importance_facts", "select 12::bigint as columns, 1.0::double as total, true as ordered")
def j4_facts(spark, sf):
    """A forest's importances: one for each model column, shares of one, highest first."""
    rows = split_rows(spark, sf)
    table = models.train_forest(rows.where("set = 'train'"), "small").importances(len(models.COLUMNS))
    before = F.lag("importance").over(Window.orderBy(F.desc("importance"), "feature"))
    return table.withColumn("ordered", F.coalesce(F.col("importance") <= before, F.lit(True))).agg(
        F.count("*").alias("columns"), r6(F.sum("importance")).alias("total"), F.min("ordered").alias("ordered"))
