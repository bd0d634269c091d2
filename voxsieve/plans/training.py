"""Composed jobs that train from labels and fill missing labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions.scores import fallback_scores, with_classification
from ..functions.speech import with_synthetic_intonation
from ..functions.text import normalize_label, with_text_proxies
from ..operators.features import feature_matrix, feature_names
from ..operators.labels import (
    Imputer, broadcast_predictions, candidate_columns, fill_labels, group_targets, numeric_columns, one_hot, profile_columns)
from ..operators.learning import Bundle, cross_validate, train_classifier, train_logistic, with_class_weights
from ..operators.lexicon import lexicon_polarity
from ..operators.metrics import prevalence_threshold
from ..operators.ridge import fill_report, ridge_out_of_fold
from ..operators.scorer import Scorer, score_texts
from ..settings import DEFAULTS, Settings
from ..sources.scratch import stored
from .recordings import with_segment_features


def measured_texts(df: DataFrame, lexicon: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Texts with text proxies, sentiment and estimated delivery: what every training on them needs, whatever the scorer."""
    polar = lexicon_polarity(with_text_proxies(df), lexicon, settings=settings)
    return with_synthetic_intonation(polar, settings)


def text_features(df: DataFrame, lexicon: DataFrame | None, settings: Settings = DEFAULTS,
                  make_scorer: Callable[[], Scorer] | None = None) -> DataFrame:
    """Labelled texts with sentiment, estimated delivery, classifier columns and a feature map.

    The classification comes from the plug-in scorer, or from the sentiment shares without one; texts that the
    scorer fails on are left out. Without a lexicon, `df` are measured texts.
    """
    heard = df if lexicon is None else measured_texts(df, lexicon, settings)
    if make_scorer is None:
        scored = heard.withColumns(fallback_scores(F.col("neg"), F.col("neu"), F.col("pos")))
    else:
        scored = with_classification(
            score_texts(heard, make_scorer).filter("error is null").drop("error"), settings=settings)
    return with_segment_features(scored)


def train_from_labels(labelled: DataFrame, key: str, lexicon: DataFrame | None, model_type: str = "random_forest",
                      settings: Settings = DEFAULTS, make_scorer: Callable[[], Scorer] | None = None) -> Bundle:
    """Fit the classifier on labelled texts (key, text, label), scored by the plug-in or from the text alone.

    The features are written once, so a model scorer sees each text once. Of several trainings on the same texts each
    would go through all words again: write `measured_texts` once and give them with None for the lexicon.
    """
    engineered = stored(text_features(labelled, lexicon, settings, make_scorer).select(key, "label", "features"), "engineered")
    names = feature_names(engineered)
    return train_classifier(feature_matrix(engineered, names), key, names, "label", model_type, settings)


@dataclass(frozen=True)
class FilledLabels:
    rows: DataFrame
    threshold: float
    numeric: list[str]
    categorical: list[str]
    #: With evaluate=True: per fold and overall, how rows are predicted by models of the other folds.
    report: DataFrame | None = None


def _fit_filler(df: DataFrame, numeric: list[str], categorical: list[str], target: str, model_type: str,
                ridge_alpha: float, settings: Settings) -> PipelineModel:
    stages: list = []
    inputs = []
    if numeric:
        stages += [VectorAssembler(inputCols=numeric, outputCol="_num"),
                   StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)]
        inputs.append("_scaled")
    if categorical:
        indexed = [f"_i_{c}" for c in categorical]
        coded = [f"_h_{c}" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"),
                   OneHotEncoder(inputCols=indexed, outputCols=coded)]
        inputs += coded
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_vector"))
    if model_type == "logistic":
        weighted = with_class_weights(df, target)
        total = weighted.agg(F.sum("weight")).first()[0]
        stages.append(LogisticRegression(
            featuresCol="_vector", labelCol=target, weightCol="weight", maxIter=500,
            regParam=1.0 / (settings.logistic_c * total), elasticNetParam=0.0, standardization=False))
        return Pipeline(stages=stages).fit(weighted)
    rows = df.count()
    stages.append(LinearRegression(
        featuresCol="_vector", labelCol=target, regParam=ridge_alpha / max(1, rows), elasticNetParam=0.0,
        standardization=False, solver="auto"))
    return Pipeline(stages=stages).fit(df)


def _scored(model: PipelineModel, df: DataFrame, model_type: str, kept: list[str]) -> DataFrame:
    out = model.transform(df)
    if model_type == "logistic":
        score = vector_to_array("probability")[1]
    else:
        score = 1.0 / (1.0 + F.exp(-F.col("prediction")))
    return out.select(*kept, score.alias("score"))


def fill_missing_labels(df: DataFrame, label: str, key: str, group: bool = False, model_type: str = "logistic",
                        columns: list[str] | None = None, threshold: float | None = None,
                        match_prevalence: bool = False, ridge_alpha: float = 1.0,
                        settings: Settings = DEFAULTS, evaluate: bool = False) -> FilledLabels:
    """Fit on labelled rows (or id groups), score all, and fill the missing labels.

    Adds score, pred and <label>_filled. Profile, medians, modes and the threshold are the only
    values that reach the driver. `evaluate` adds a report over folds of the labelled rows; their gaps are
    filled with the values of all of them.
    """
    default = settings.decision_threshold if threshold is None else threshold
    names = candidate_columns(df, label, columns, ignore=(key,))
    target = "_target"
    # what the fit takes, written once: profile, gaps, folds and iterations read it again, the source is read for the scores
    narrow = stored(df.select(*dict.fromkeys((key, label, *names))), "candidates")
    if group:
        numeric = [c for c in names if c in set(numeric_columns(df))]
        categorical: list[str] = []
        base = group_targets(narrow, key, numeric, label)
        wanted = "target" if model_type == "logistic" else "label_mean"
        base = stored(base.withColumn(target, F.col(wanted)).select(key, *numeric, target), "groups")
    else:
        roles = {r["column"]: r["role"] for r in profile_columns(narrow, names, exact=False).collect()}
        numeric = [c for c in names if roles[c] == "numeric"]
        categorical = [c for c in names if roles[c] == "categorical"]
        base = narrow.withColumn(target, normalize_label(F.col(label)))
    if not numeric and not categorical:
        raise ValueError("no feature columns; name some")
    known = base.filter(F.col(target).isNotNull())
    rows = base if group else df.withColumn(target, normalize_label(F.col(label)))
    # a column without any labelled value carries no signal: a constant keeps it out of the model
    imputer = Imputer(dict.fromkeys(numeric, 0.0) | Imputer.fit(known, numeric, categorical).values)
    report = _evaluated(imputer.transform(known), key, numeric, categorical, target, model_type, ridge_alpha, settings) if evaluate else None
    model = _fit_filler(imputer.transform(known), numeric, categorical, target, model_type, ridge_alpha, settings)
    kept = [key, target] if group else [*df.columns, target]
    ready = imputer.transform(rows) if group else imputer.transform(
        rows.withColumns({f"_raw_{c}": F.col(c) for c in numeric + categorical}))
    kept = kept if group else [c if c not in numeric + categorical else f"_raw_{c}" for c in kept]
    scored = _scored(model, ready, model_type, kept)
    scored = stored(scored.withColumnsRenamed({f"_raw_{c}": c for c in numeric + categorical}), "filled")
    cut = default
    if model_type == "logistic" or not group:
        # a label that is present but unreadable belongs to neither side
        pool = scored if group else scored.filter(F.col(target).isNotNull() | F.col(label).isNull())
        cut = prevalence_threshold(
            pool, "score", target, "labelled" if group else "unlabelled", match_prevalence, default,
        ).first()["threshold"]
    scored = scored.withColumn("pred", (F.col("score") >= F.lit(cut)).cast("int"))
    rows = broadcast_predictions(df, scored.select(key, "score", "pred"), key) if group else scored.drop(target)
    return FilledLabels(fill_labels(rows, label, "pred"), float(cut), numeric, categorical, report)


def _evaluated(known: DataFrame, key: str, numeric: list[str], categorical: list[str], target: str, model_type: str,
               ridge_alpha: float, settings: Settings) -> DataFrame:
    """fill_report of out-of-fold predictions: ridge from the folds' sums, logistic with a fit per fold."""
    wide, names, coded = known, list(numeric), []
    for c in categorical:
        before = set(wide.columns)
        wide = one_hot(wide, c)
        coded += [n for n in wide.columns if n not in before]
    names += coded
    if model_type == "ridge":
        return fill_report(ridge_out_of_fold(wide, key, names, target, ridge_alpha, frozenset(coded), settings))
    plain = {n: f"f{i}" for i, n in enumerate(names)}  # names as the model takes them
    rows = wide.select(key, F.col(target).cast("int").alias("_label"), *[F.col(f"`{n}`").alias(p) for n, p in plain.items()])
    scores = cross_validate(rows, key, list(plain.values()), "_label", train_logistic, settings)
    return fill_report(scores.select(key, F.col("label").cast("double").alias("target"), "fold", F.col("score").alias("prediction")))
