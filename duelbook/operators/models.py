"""Win-probability models on Spark ML: training, calibration, scoring, evaluation, storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.functions.clean import format_h2h
from duelbook.functions.elo import expected_score
from duelbook.operators.features import FEATURES, encode_surface, features_asof, standard_parameters, standardise
from duelbook.operators.history import history_view, known_pairs
from duelbook.operators.splits import even_folds
from duelbook.schema import SURFACES
from duelbook.session import cut_lineage

# fixed values: settings of the published models.  Spark caps the depth at 30; a minimum of five
# rows to split has no twin, two rows per leaf is the closest.
FOREST_PRESETS = {
    "ranked": {"numTrees": 120, "maxDepth": 20},
    "calibrated": {"numTrees": 200, "maxDepth": 25, "minInstancesPerNode": 2},
    "temporal": {"numTrees": 200, "maxDepth": 30},
    "small": {"numTrees": 20, "maxDepth": 6},
}
BOOSTED_PRESETS = {
    "full": {"maxIter": 200, "maxDepth": 6, "stepSize": 0.3},
    "small": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3},
}
SEED = 42
COLUMNS = FEATURES + [f"surface_{s}" for s in SURFACES]


def with_class_weights(df: DataFrame, label: str = "target", name: str = "weight") -> DataFrame:
    """n / (classes * n_c) per row; one aggregate, one row per class to the driver, no join."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return df.withColumn(name, weight)


def prepared(df: DataFrame, columns: list[str] = COLUMNS, parameters: dict | None = None) -> DataFrame:
    """Adds one ``x_`` column per model column: flags for the surface, 0 for what is missing.

    With parameters the values are standardised; the input columns stay as they are.
    """
    source = encode_surface(df) if "surface" in df.columns else df
    inputs = {f"x_{c}": (F.col(c) if c in source.columns else F.lit(0)).cast("double") for c in columns}
    frame = source.withColumns(inputs).select(*df.columns, *inputs)
    if parameters is None:
        return frame
    return standardise(frame, list(inputs), parameters={f"x_{c}": parameters[c] for c in columns})


def fit_parameters(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    fitted = standard_parameters(prepared(df, columns), [f"x_{c}" for c in columns])
    return {c: fitted[f"x_{c}"] for c in columns}


@dataclass
class Bundle:
    """A fitted model with what scoring needs: column order and standardisation."""

    model: PipelineModel
    columns: list[str]
    parameters: dict[str, tuple[float, float]]

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Adds the probability of class 1."""
        scored = self.model.transform(prepared(df, self.columns, self.parameters))
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))

    def importances(self, n: int = 10) -> DataFrame:
        """The ``n`` most important columns, highest first."""
        values = self.model.stages[-1].featureImportances.toArray().tolist()
        spark = SparkSession.active()
        rows = spark.createDataFrame(list(zip(self.columns, values)), "feature string, importance double")
        return rows.orderBy(F.desc("importance"), "feature").limit(n)


def _fit(df: DataFrame, classifier, columns: list[str], parameters: dict) -> Bundle:
    assembler = VectorAssembler(inputCols=[f"x_{c}" for c in columns], outputCol="features")
    frame = prepared(df, columns, parameters)
    model = classifier.fit(assembler.transform(frame))
    return Bundle(PipelineModel([assembler, model]), columns, parameters)


def train_forest(
    df: DataFrame, preset: str = "small", columns: list[str] = COLUMNS, balanced: bool = False,
    fit_on: DataFrame | None = None,
) -> Bundle:
    """Random forest; ``balanced`` weighs classes evenly."""
    parameters = fit_parameters(fit_on if fit_on is not None else df, columns)
    forest = RandomForestClassifier(labelCol="target", seed=SEED, **FOREST_PRESETS[preset])
    if balanced:
        df = with_class_weights(df)
        forest = forest.setWeightCol("weight")
    return _fit(df, forest, columns, parameters)


def train_boosted(df: DataFrame, preset: str = "small", columns: list[str] = COLUMNS) -> Bundle:
    """Gradient-boosted trees under logistic loss."""
    parameters = fit_parameters(df, columns)
    return _fit(df, GBTClassifier(labelCol="target", seed=SEED, **BOOSTED_PRESETS[preset]), columns, parameters)


@dataclass
class Calibrated:
    """The mean of per-fold models, each with its isotonic curve."""

    parts: list[tuple[Bundle, IsotonicRegressionModel]]

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        kept = df.columns
        for i, (bundle, curve) in enumerate(self.parts):
            df = bundle.score(df, f"_raw{i}")
            df = curve.setFeaturesCol(f"_raw{i}").setPredictionCol(f"_cal{i}").transform(df)
        mean = sum(F.col(f"_cal{i}") for i in range(len(self.parts))) / len(self.parts)
        return df.select(*kept, mean.alias(name))


def calibrate(
    df: DataFrame, identity: list[str], folds: int = 3, preset: str = "small",
    columns: list[str] = COLUMNS, balanced: bool = True,
) -> Calibrated:
    """Per fold: fit on the other folds, isotonic curve on the held-out scores.

    Folds are even within each class, by md5 order.
    """
    folded = cut_lineage(even_folds(df, identity, folds, SEED))
    parts = []
    for fold in range(folds):
        bundle = train_forest(folded.where(F.col("fold") != fold), preset, columns, balanced)
        held = bundle.score(folded.where(F.col("fold") == fold), "score")
        # equal scores become one weighted point before the curve is fitted
        points = held.groupBy("score").agg(F.avg("target").alias("label"), F.count("*").cast("double").alias("weight"))
        curve = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(points)
        parts.append((bundle, curve))
    return Calibrated(parts)


# --- scoring ------------------------------------------------------------------

def decide(scored: DataFrame, p: str = "p") -> DataFrame:
    """Winner and confidence from P(player1 wins)."""
    return scored.withColumn(
        "winner", F.when(F.col(p) > 0.5, F.col("player1")).otherwise(F.col("player2"))
    ).withColumn("confidence", F.greatest(F.col(p), 1 - F.col(p)))


def predict(pairs: DataFrame, rated: DataFrame, model) -> DataFrame:
    """Scores of pairings ``(query_id, player1, player2, surface, tourney_date)`` with details.

    Pairings with a player the history does not know are left out; one without a date is asked for
    the day of the history's last contest.
    """
    persp = history_view(rated)
    last = rated.agg(F.max("tourney_date").alias("_last"))  # one row
    pairs = known_pairs(pairs, persp).crossJoin(F.broadcast(last))
    pairs = pairs.withColumn("tourney_date", F.coalesce("tourney_date", "_last")).drop("_last")
    frame = features_asof(pairs, rated)
    scored = decide(model.score(frame))
    return scored.withColumn("h2h", format_h2h(F.col("h2h_wins"), F.col("h2h_losses"), F.col("player1")))


def predict_elo(frame: DataFrame, p: str = "p") -> DataFrame:
    """The ratings alone as a model."""
    return frame.withColumn(p, expected_score(F.col("player_elo"), F.col("opponent_elo")))


# --- evaluation ---------------------------------------------------------------

def predictions(scored: DataFrame, p: str = "p") -> DataFrame:
    return scored.withColumn("prediction", (F.col(p) > 0.5).cast("long"))


def _confusion(label: str = "target"):
    hit, said = F.col(label) == 1, F.col("prediction") == 1
    return [
        F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"), F.count_if(~hit & ~said).alias("tn")]


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("accuracy"))


def f1(pred: DataFrame) -> DataFrame:
    """F1 of class 1."""
    counts = pred.agg(*_confusion())
    return counts.select(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    One aggregate counts the four cells; the report is laid out from that row.
    """
    c = pred.agg(*_confusion())
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.select(
        (tp + fn).alias("n1"), (tn + fp).alias("n0"), (tp + fp + fn + tn).alias("n"), _ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
        _ratio(tp, tp + fp).alias("p1"), _ratio(tp, tp + fn).alias("r1"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fn).alias("p0"), _ratio(tn, tn + fp).alias("r0"), _ratio(2 * tn, 2 * tn + fp + fn).alias("f0"))

    def line(name, precision, recall, score, support):
        return F.struct(F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
                        score.alias("f1_score"), support.alias("support"))

    def macro(x):
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x):
        return _ratio(F.col(f"{x}0") * F.col("n0") + F.col(f"{x}1") * F.col("n1"), F.col("n"))

    acc, n = F.col("acc"), F.col("n")
    lines = F.array(
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("n0")),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("n1")),
        line("accuracy", acc, acc, acc, n),
        line("macro avg", macro("p"), macro("r"), macro("f"), n),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), n))
    return c.select(F.explode(lines).alias("v")).select("v.*")


def evaluate(pred: DataFrame, by: str = "set") -> DataFrame:
    """Accuracy, F1 and row count per set, from one grouped aggregate."""
    counts = pred.groupBy(by).agg(*_confusion())
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(
        by, n.alias("n"), _ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


# --- storage ------------------------------------------------------------------

MANIFEST = "number long, folder string"


def save_bundle(bundle: Bundle, path: str, tables: dict[str, DataFrame] | None = None) -> str:
    """Model, scoring parameters and prepared tables as a new version under ``path``.

    A version is written whole into a folder of its own; its line in the manifest is written last, by Spark's commit, and
    only that makes it the one that is loaded.  A write that breaks off leaves the version before in place.
    """
    spark = SparkSession.active()
    folder = f"versions/{uuid.uuid4().hex}"
    bundle.model.write().save(f"{path}/{folder}/model")
    rows = [(i, c, *bundle.parameters[c]) for i, c in enumerate(bundle.columns)]
    spark.createDataFrame(rows, "position int, name string, mean double, deviation double").write.parquet(f"{path}/{folder}/columns")
    for name, df in (tables or {}).items():
        df.write.parquet(f"{path}/{folder}/tables/{name}")
    try:
        number = _version(spark, path)["number"] + 1
    except AnalysisException as error:
        if not _missing(error):
            raise
        number = 1
    spark.createDataFrame([(number, folder)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return path


def _version(spark: SparkSession, path: str) -> dict:
    """The last committed version."""
    last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("number"), "folder").first()
    return last.asDict()


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    folder = f"{path}/{_version(spark, path)['folder']}"
    model = PipelineModel.load(f"{folder}/model")
    rows = spark.read.parquet(f"{folder}/columns").orderBy("position").collect()  # one row per feature
    return Bundle(model, [r.name for r in rows], {r.name: (r.mean, r.deviation) for r in rows})


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A prepared table of the last committed version."""
    return spark.read.parquet(f"{path}/{_version(spark, path)['folder']}/tables/{name}")


def load_or_train(spark: SparkSession, path: str, train: Callable[[], Bundle]) -> Bundle:
    """The stored bundle if there is one, else a new one, stored."""
    try:
        return load_bundle(spark, path)
    except Exception as error:
        if not _missing(error):
            raise
    bundle = train()
    save_bundle(bundle, path)
    return bundle


def _missing(error: Exception) -> bool:
    if isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND":
        return True
    return "Input path does not exist" in str(error)
