"""Feature maps for the trained classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MODELS
from ..settings import EMOTIONS
from .scores import empty_scores, prefixed
from .text import is_blank, strip

ACOUSTIC = (
    "emotion_score", "f0_mean", "f0_std", "f0_min", "f0_max", "f0_range",
    "f0_slope", "f0_final", "rms_mean", "rms_max", "duration",
)


def finite(value: Column) -> Column:
    """The value, or 0 when it is null, NaN or infinite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(F.lit(0.0))


def scrub_nonfinite(columns: list[str]) -> dict[str, Column]:
    return {c: finite(F.col(c).cast("double")) for c in columns}


def with_multimodel_features(df: DataFrame, categories: Column | None = None, out: str = "features") -> DataFrame:
    """Map of classifier features from the score columns of a classified text.

    `categories` may carry further scores; those not covered by the model outputs are added.
    """
    outputs = F.col("model_outputs")
    targets = F.coalesce(outputs["target"], empty_scores())
    summary = F.create_map(
        F.lit("overall_toxicity"), F.coalesce(F.col("overall_toxicity"), F.lit(0.0)),
        F.lit("is_toxic"), F.coalesce(F.col("is_toxic").cast("double"), F.lit(0.0)),
        F.lit("hate_target_confidence"), F.coalesce(F.col("hate_target_confidence"), F.lit(0.0)),
        F.lit("target_max_score"), F.coalesce(F.array_max(F.map_values(targets)), F.lit(0.0)),
        F.lit("num_detected_issues"), F.coalesce(F.size("detected_issues").cast("double"), F.lit(0.0)),
    )
    name = F.concat(F.lit("hate_target_is_"), F.replace(F.lower(strip(F.col("hate_target"))), F.lit(" "), F.lit("_")))
    one_hot = F.when(is_blank(F.col("hate_target")), empty_scores()).otherwise(F.create_map(name, F.lit(1.0)))
    df = df.withColumn("_known", F.map_concat(summary, one_hot, *[prefixed(outputs[m], f"{m}_") for m in MODELS]))
    if categories is not None:
        df = df.withColumn("_names", F.map_keys("_known")).withColumn("_known", F.map_concat(
            "_known",
            F.map_filter(F.coalesce(categories, empty_scores()), lambda k, v: ~F.array_contains("_names", k))))
    return df.withColumn(out, F.transform_values("_known", lambda k, v: finite(v))).drop("_known", "_names")


def intonation_features() -> dict[str, Column]:
    """Eleven numeric acoustic features and six emotion indicators."""
    emotion = F.lower(F.coalesce(F.col("emotion"), F.lit("neutral")))
    features = {c: finite(F.col(c).cast("double")) for c in ACOUSTIC}
    features |= {f"emotion_is_{e}": emotion.contains(e).cast("double") for e in EMOTIONS}
    return features


def as_feature_map(columns: dict[str, Column]) -> Column:
    return F.create_map(*[x for name, value in columns.items() for x in (F.lit(name), value)])
