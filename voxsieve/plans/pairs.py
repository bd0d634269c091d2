"""Training and predicting from recordings stored as pairs of feature files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.features import as_feature_map, intonation_features, with_multimodel_features
from ..operators.features import feature_matrix, feature_names, stack_classes
from ..operators.learning import Bundle, train_classifier, with_probability
from ..operators.rollup import file_prediction_rollup
from ..settings import DEFAULTS, Settings
from ..sources.pairs import acoustic_segments, broken_members, classified_segments, feature_files
from .recordings import ScoredRecordings, aligned_pairs


@dataclass(frozen=True)
class PairedSegments:
    """Aligned segments (file, seg_idx, label, features) and error rows of files that cannot be parsed."""

    rows: DataFrame
    broken: DataFrame


def with_pair_features(pairs: DataFrame) -> DataFrame:
    """Map `features` of all scores of the classified segment and of its acoustic one, which wins equal names."""
    heard = intonation_features()
    scored = with_multimodel_features(pairs, F.col("categories"))
    own = F.array(*[F.lit(n) for n in heard])
    return scored.withColumn("features", F.map_concat(
        F.map_filter("features", lambda k, v: ~F.array_contains(own, k)), as_feature_map(heard)))


def paired_segments(spark: SparkSession, folders: dict[int, str], settings: Settings = DEFAULTS) -> PairedSegments:
    """Segments of the pairs in one folder per class, each classified segment with the acoustic one nearest in time.

    Files without a partner, and segments without one in reach, are left out. `file` is <class>/<base>, where the
    base is a path below the folder, so equal names in two classes stay apart.
    """
    text, heard, broken = {}, {}, {}
    for label, path in folders.items():
        members = feature_files(spark, path)
        # texts are no features: alignment need not carry them
        text[label], heard[label] = classified_segments(members[0]).drop("text"), acoustic_segments(members[1])
        broken[label] = broken_members(*members)
    named = {
        kind: stack_classes(parts).withColumn("file", F.concat_ws("/", "label", "base")).drop("base")
        for kind, parts in (("text", text), ("heard", heard))}
    pairs = aligned_pairs(named["text"], named["heard"].drop("label"), settings)
    errors = stack_classes(broken).withColumn("file", F.concat_ws("/", "label", "file")).drop("label")
    return PairedSegments(with_pair_features(pairs).select("file", "seg_idx", "label", "features"), errors)


def train_from_pairs(rows: DataFrame, model_type: str = "random_forest", settings: Settings = DEFAULTS) -> Bundle:
    """Fit the classifier on the rows of paired_segments; the columns are the union of all their feature names."""
    keyed = rows.withColumn("row", F.concat_ws("#", "file", "seg_idx")).select("row", "label", "features")
    names = feature_names(keyed)
    return train_classifier(feature_matrix(keyed, names), "row", names, "label", model_type, settings)


def predict_pairs(rows: DataFrame, bundle: Bundle, settings: Settings = DEFAULTS) -> ScoredRecordings:
    """Predictions of the rows of paired_segments and their rollup per file; unknown features are ignored."""
    scored = with_probability(bundle.model, feature_matrix(rows, bundle.names), "extremist_probability").select(
        "file", "seg_idx", "extremist_probability").withColumn(
        "is_extremist", F.col("extremist_probability") >= F.lit(bundle.threshold))
    return ScoredRecordings(scored, file_prediction_rollup(scored, settings))
