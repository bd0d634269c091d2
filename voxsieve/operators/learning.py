"""Training, evaluating, saving and applying the binary classifier with Spark MLlib."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..settings import DEFAULTS, Settings
from ..sources.scratch import scratch_dir, stored
from .labels import class_balance
from .metrics import threshold_sweep
from .splits import kfold_assign, stratified_split

MODEL_TYPES = ("random_forest", "gradient_boosting", "logistic")

#: Rows below which a fit is not dealt over one more task.
ROWS_OF_TASK = 2_000


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per row, from the counts of the few classes."""
    weight = F.lit(1.0)
    for r in class_balance(df, label).collect():
        weight = F.when(F.col(label) == r["label"], F.lit(r["weight"])).otherwise(weight)
    return df.withColumn("weight", weight)


def _fit(df: DataFrame, names: list[str], *estimator) -> PipelineModel:
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="raw_vector"),
        StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True),
        *estimator,
    ]).fit(df)


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt over the session's cores: small files would all be read, and fitted on, by one task."""
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / ROWS_OF_TASK))
    return df if tasks <= 1 else df.repartition(tasks)


def _at_once(work: Callable[[int], list[float]], n: int, most: int) -> list[list[float]]:
    with ThreadPoolExecutor(most) as pool:
        return [*pool.map(inheritable_thread_target(SparkSession.active())(work), range(n))]


@dataclass
class Forest:
    """A random forest fitted in parts, each an MLlib model in a folder: the driver holds only the parts at work."""

    prepared: PipelineModel
    path: str
    #: Trees of each part.
    trees: list[int]
    importances: list[float]
    at_once: int = DEFAULTS.fits_at_once

    def part(self, i: int) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(f"{self.path}/part-{i}")

    def with_probability(self, df: DataFrame, out: str) -> DataFrame:
        """Every part votes on its own; a row's votes are added up."""
        rows = stored(df.withColumn("_forest_row", F.monotonically_increasing_id()), "unscored")
        vectors = stored(self.prepared.transform(rows).select("_forest_row", "vector"), "vectors")
        path = scratch_dir(df.sparkSession, "votes")

        def vote(i: int) -> list[float]:
            voted = self.part(i).transform(vectors).select("_forest_row", vector_to_array("rawPrediction")[1].alias("votes"))
            voted.write.parquet(f"{path}/part={i}")
            return []

        _at_once(vote, len(self.trees), self.at_once)
        votes = df.sparkSession.read.schema("_forest_row bigint, votes double").parquet(
            *[f"{path}/part={i}" for i in range(len(self.trees))])
        scores = stored(votes.groupBy("_forest_row").agg((F.sum("votes") / sum(self.trees)).alias(out)), "scores")
        return rows.join(scores, "_forest_row").drop("_forest_row")

    def save(self, path: str) -> None:
        self.prepared.write().overwrite().save(f"{path}/prepared")
        for i in range(len(self.trees)):
            self.part(i).write().overwrite().save(f"{path}/part-{i}")
        SparkSession.active().createDataFrame(
            [(self.trees, self.importances)], "trees array<int>, importances array<double>",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")

    @staticmethod
    def load(path: str) -> "Forest":
        row = SparkSession.active().read.parquet(f"{path}/forest").first()
        return Forest(PipelineModel.load(f"{path}/prepared"), path, list(row["trees"]), list(row["importances"]))


def train_forest(df: DataFrame, names: list[str], label: str = "label", settings: Settings = DEFAULTS) -> PipelineModel | Forest:
    """Random forest with balanced class weights; above `settings.rows_of_fit` rows times trees it is fitted in parts."""
    weighted = with_class_weights(df, label)
    rows = df.count()

    def estimator(trees: int, seed: int, memory: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            featuresCol="vector", labelCol=label, weightCol="weight", numTrees=trees,
            maxDepth=settings.forest_depth, minInstancesPerNode=settings.forest_min_leaf,
            featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=memory)

    size = max(1, settings.rows_of_fit // max(1, rows))
    if size >= settings.forest_trees:
        return _fit(weighted, names, estimator(settings.forest_trees, settings.seed, 512))
    spark = df.sparkSession
    trees = [min(size, settings.forest_trees - at) for at in range(0, settings.forest_trees, size)]
    prepared = _fit(weighted, names)
    vectors = stored(_spread(prepared.transform(weighted).select("vector", label, "weight"), rows), "vectors")
    # a node's histogram is made by every task of a fit: few tasks each, the fits beside each other take all cores
    cores = spark.sparkContext.defaultParallelism
    dealt = vectors.coalesce(max(2, ceil(cores / settings.fits_at_once), ceil(rows / 250_000)))
    path = scratch_dir(spark, "forest")

    def grow(i: int) -> list[float]:
        model = estimator(trees[i], settings.seed + i, 256).fit(dealt)
        model.write().save(f"{path}/part-{i}")
        return model.featureImportances.toArray().tolist()

    found = _at_once(grow, len(trees), settings.fits_at_once)
    weights = [sum(n * part[j] for n, part in zip(trees, found, strict=True)) / sum(trees) for j in range(len(names))]
    return Forest(prepared, path, trees, weights, settings.fits_at_once)


def train_boosted(df: DataFrame, names: list[str], label: str = "label", settings: Settings = DEFAULTS) -> PipelineModel:
    """Gradient-boosted trees under log loss."""
    return _fit(_spread(df, df.count()), names, GBTClassifier(
        featuresCol="vector", labelCol=label, maxIter=settings.boosted_rounds, maxDepth=settings.boosted_depth,
        stepSize=settings.boosted_step, subsamplingRate=settings.boosted_subsample, seed=settings.seed,
        maxMemoryInMB=512))


def train_logistic(df: DataFrame, names: list[str], label: str = "label", settings: Settings = DEFAULTS) -> PipelineModel:
    """L2 logistic regression with balanced class weights."""
    weighted = with_class_weights(df, label)
    total = weighted.agg(F.sum("weight")).first()[0]
    return _fit(weighted, names, LogisticRegression(
        featuresCol="vector", labelCol=label, weightCol="weight", maxIter=settings.logistic_iterations,
        regParam=1.0 / (settings.logistic_c * total), elasticNetParam=0.0, standardization=False))


TRAINERS = {"random_forest": train_forest, "gradient_boosting": train_boosted, "logistic": train_logistic}


def with_probability(model: PipelineModel | Forest, df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class, without the model's intermediate columns."""
    if isinstance(model, Forest):
        return model.with_probability(df, out)
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "raw_vector", "vector", "rawPrediction", "probability", "prediction")


def top_features(model: PipelineModel | Forest, names: list[str], n: int = 15) -> DataFrame:
    """The n most important features of a tree model."""
    spark = SparkSession.active()
    weights = model.importances if isinstance(model, Forest) else model.stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(names, weights)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def small_data_guard(df: DataFrame, label: str = "label") -> bool:
    """True when classes are too few or too small for a hold-out."""
    row = class_balance(df, label).select("too_small").first()
    return True if row is None else row["too_small"]


def cross_validate(df: DataFrame, key: str, names: list[str], label: str, train,
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Out-of-fold scores (key, label, fold, score): each fold scored by a model of the others."""
    folded = stored(kfold_assign(df, key, label, settings).select(key, label, "fold", *names), "folds")
    folds = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for fold in folds:
        model = train(folded.filter(F.col("fold") != fold), names, label, settings)
        held = folded.filter(F.col("fold") == fold)
        parts.append(with_probability(model, held).select(key, F.col(label).alias("label"), "fold", "score"))
    return stored(reduce(lambda a, b: a.unionByName(b), parts), "out-of-fold")


@dataclass
class Bundle:
    """A fitted model with what is needed to apply it."""

    model: PipelineModel | Forest
    names: list[str]
    model_type: str
    threshold: float
    validation: DataFrame | None = field(default=None, compare=False)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds extremist_probability and is_extremist."""
        scored = with_probability(self.model, df, "extremist_probability")
        return scored.withColumn("is_extremist", F.col("extremist_probability") >= F.lit(self.threshold))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        in_parts = isinstance(self.model, Forest)
        if in_parts:
            self.model.save(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame(
            [(self.names, self.model_type, self.threshold, in_parts)],
            "names array<string>, model_type string, threshold double, in_parts boolean",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "Bundle":
        row = SparkSession.active().read.parquet(f"{path}/metadata").first()
        in_parts = "in_parts" in row and row["in_parts"]  # earlier bundles do not say
        model = Forest.load(f"{path}/model") if in_parts else PipelineModel.load(f"{path}/model")
        return Bundle(model, list(row["names"]), row["model_type"], row["threshold"])


def train_classifier(df: DataFrame, key: str, names: list[str], label: str = "label",
                     model_type: str = "random_forest", settings: Settings = DEFAULTS) -> Bundle:
    """Fit, choose the threshold on held-out rows (on all rows when data are too few), and bundle.

    `validation` of the bundle holds (key, label, score, prediction) of the rows the threshold was chosen on.
    """
    train = TRAINERS[model_type]
    if small_data_guard(df, label):
        fit_rows = held = df
    else:
        split = stratified_split(df, key, label, settings.validation_share, settings.seed)
        parts = stored(split.select(key, label, "part", *names), "split")
        fit_rows = parts.filter(F.col("part") == "train")
        held = parts.filter(F.col("part") == "validation")
    model = train(fit_rows, names, label, settings)
    scored = stored(with_probability(model, held).select(key, F.col(label).alias("label"), "score"), "validation")
    threshold = settings.decision_threshold
    if settings.optimize_threshold:
        threshold = threshold_sweep(scored, "score", "label", settings.f_beta).first()["threshold"]
    validation = scored.withColumn("prediction", (F.col("score") >= F.lit(threshold)).cast("int"))
    return Bundle(model, names, model_type, float(threshold), validation)
