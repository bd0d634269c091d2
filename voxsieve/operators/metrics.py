"""Threshold choice, ranking metrics and reports, computed from score counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..settings import DEFAULTS, Settings
from ..sources.scratch import stored
from .ordering import exact_quantiles, running_sums, with_quantile_slices


def grid(spark: SparkSession) -> DataFrame:
    """Candidate thresholds 0.05, 0.10, ... 0.95 tried next to the observed scores."""
    return spark.range(1, 20).select(F.round(F.col("id") * 0.05, 2).alias("score"))


def score_counts(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives per distinct score: all that ranking metrics need."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) != 1, 1)).alias("neg"))


def cumulative_counts(counts: DataFrame, keys: tuple[str, ...] = (), store: bool = True) -> DataFrame:
    """Adds tp and fp: positives and negatives with at least this score.

    The counts are stored first: they are read several times, what they were counted from only once.
    `store` is false for counts that are a stored table already.
    """
    sliced = with_quantile_slices(stored(counts, "score-counts") if store else counts, "score")
    return running_sums(sliced, list(keys), "slice", [F.col("score").desc()],
                        {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)


def grid_counts(counts: DataFrame) -> DataFrame:
    return grid(counts.sparkSession).select("score", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))


def distinct_candidates(df: DataFrame, score: str) -> DataFrame:
    """Observed scores and the fixed grid, each once."""
    return df.select(F.col(score).cast("double").alias("threshold")).union(grid(df.sparkSession)).distinct()


def threshold_curve(df: DataFrame, score: str, label: str, beta: float = DEFAULTS.f_beta) -> DataFrame:
    """F-beta of predicting score >= threshold, for every observed score and grid value."""
    counts = score_counts(df, score, label)
    merged = counts.unionByName(grid_counts(counts)).groupBy("score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts_stored = stored(merged, "score-counts")
    ranked = cumulative_counts(counts_stored, store=False)
    positives = counts_stored.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p")).first()["p"]
    square = beta * beta
    hit = (1 + square) * F.col("tp")
    scale = hit + square * (F.lit(positives) - F.col("tp")) + F.col("fp")
    return ranked.select(
        F.col("score").alias("threshold"), "tp", "fp",
        F.coalesce(F.try_divide(hit, scale), F.lit(0.0)).alias("fbeta"))


def threshold_sweep(df: DataFrame, score: str, label: str, beta: float = DEFAULTS.f_beta) -> DataFrame:
    """One row: the best threshold (the lowest on ties) and its F-beta."""
    best = F.max(F.struct(F.col("fbeta"), (-F.col("threshold")).alias("minus"))).alias("best")
    return threshold_curve(df, score, label, beta).agg(best).select(
        (-F.col("best.minus")).alias("threshold"), F.col("best.fbeta").alias("fbeta"))


def prevalence_threshold(df: DataFrame, score: str, label: str, quantile_over: str = "labelled",
                         match: bool = True, default: float = DEFAULTS.decision_threshold) -> DataFrame:
    """One row (positive_rate, threshold): the cut that flags as large a share as is labelled positive."""
    spark = df.sparkSession
    rate = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rate = 0.5 if rate is None else rate
    schema = "positive_rate double, threshold double"
    fixed = default if not match else 0.99 if rate <= 0 else 0.01 if rate >= 1 else None
    if fixed is not None:
        return spark.createDataFrame([(rate, float(fixed))], schema)
    known = F.col(label).isNotNull()
    rows = df.filter(known if quantile_over == "labelled" else ~known)
    return exact_quantiles(rows, {score: 1.0 - rate}).select(
        F.lit(rate).alias("positive_rate"), F.col("quantile").alias("threshold"))


def roc_auc(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    ranked = cumulative_counts(score_counts(df, score, label, keys), keys)
    won = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*keys).agg(F.try_divide(won, pairs).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean precision over recall steps, from the highest score down."""
    ranked = cumulative_counts(score_counts(df, score, label, keys), keys)
    gained = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return ranked.groupBy(*keys).agg(
        F.try_divide(gained, F.sum("pos").cast("double")).alias("average_precision"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows (actual, predicted_0, predicted_1)."""
    table = df.groupBy(F.col(label).alias("actual")).pivot(prediction, [0, 1]).count()
    return table.select("actual", *[F.coalesce(F.col(str(p)), F.lit(0)).alias(f"predicted_{p}") for p in (0, 1)])


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows (name, precision, recall, f1, support): both classes, accuracy, macro and weighted means."""
    actual, predicted = F.col(label), F.col(prediction)

    def cell(a: int, p: int):
        return F.count(F.when((actual == a) & (predicted == p), 1)).cast("double").alias(f"c{a}{p}")

    counts = df.agg(*[cell(a, p) for a in (0, 1) for p in (0, 1)])

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    def measures(c: int) -> dict:
        o = 1 - c
        hit, wrong, missed = F.col(f"c{c}{c}"), F.col(f"c{o}{c}"), F.col(f"c{c}{o}")
        return {"precision": ratio(hit, hit + wrong), "recall": ratio(hit, hit + missed),
                "f1": ratio(2 * hit, 2 * hit + wrong + missed), "support": hit + missed}

    classes = [measures(c) for c in (0, 1)]
    total = classes[0]["support"] + classes[1]["support"]
    none = F.lit(None).cast("double")
    rows = [("class_0", classes[0]), ("class_1", classes[1]),
            ("accuracy", {"precision": none, "recall": none,
                          "f1": ratio(F.col("c00") + F.col("c11"), total), "support": total})]
    fields = ("precision", "recall", "f1")
    rows.append(("macro avg", {f: (classes[0][f] + classes[1][f]) / 2 for f in fields} | {"support": total}))
    rows.append(("weighted avg", {
        f: ratio(classes[0][f] * classes[0]["support"] + classes[1][f] * classes[1]["support"], total)
        for f in fields} | {"support": total}))
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), *[m[f].alias(f) for f in fields],
                 m["support"].cast("bigint").alias("support")) for name, m in rows])).alias("r")).select("r.*")


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Root mean squared error and R squared, per key or overall."""
    y, p = F.col(actual), F.col(predicted)
    squared = (y - p) * (y - p)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(squared)).alias("rmse"),
        (1 - F.try_divide(F.avg(squared), F.var_pop(y))).alias("r2"))


def _right(settings: Settings):
    return ((F.col("score") >= settings.decision_threshold).cast("int") == F.col("label")).cast("double")


def fold_report(out_of_fold: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per fold: accuracy, area under ROC and average precision of out-of-fold scores."""
    accuracy = out_of_fold.groupBy("fold").agg(F.avg(_right(settings)).alias("accuracy"), F.count("*").alias("n"))
    return (
        accuracy.join(roc_auc(out_of_fold, "score", "label", ("fold",)), "fold")
        .join(average_precision(out_of_fold, "score", "label", ("fold",)), "fold"))


def fold_summary(out_of_fold: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: mean and deviation of the folds' accuracy, area under ROC and average precision of all scores."""
    folds = out_of_fold.groupBy("fold").agg(F.avg(_right(settings)).alias("accuracy")).agg(
        F.count("*").alias("n_folds"), F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"))
    # one row each: single numbers
    auc = roc_auc(out_of_fold, "score", "label").first()["roc_auc"]
    precision = average_precision(out_of_fold, "score", "label").first()["average_precision"]
    return folds.withColumns({
        "roc_auc": F.lit(auc).cast("double"), "average_precision": F.lit(precision).cast("double")})
