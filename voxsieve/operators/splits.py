"""Seeded stratified splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..settings import DEFAULTS, Settings
from .ordering import row_numbers


def with_class_rank(df: DataFrame, key: str, label: str | None, seed: int) -> DataFrame:
    """Position of each row in its class, in seeded hash order.

    The hash spreads rows evenly, so its leading digits serve as slices of a class however large.
    """
    digest = F.md5(F.concat_ws("_", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = df.withColumn("_hash", digest).withColumn("_slice", F.substring("_hash", 1, 4))
    keys = [label] if label else []
    return row_numbers(hashed, keys, "_slice", [F.col("_hash")], "class_rank", totals=True).drop("_hash", "_slice")


def stratified_split(df: DataFrame, key: str, label: str, share: float = DEFAULTS.validation_share,
                     seed: int = DEFAULTS.seed) -> DataFrame:
    """Adds `part` (train or validation), keeping class shares; rows without a label are a class."""
    take = F.round(F.col("class_rank_total") * share).cast("bigint")
    part = F.when(F.col("class_rank") <= take, "validation").otherwise("train")
    return with_class_rank(df, key, label, seed).withColumn("part", part).drop("class_rank", "class_rank_total")


def kfold_assign(df: DataFrame, key: str, label: str | None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds `fold`: stratified over label, or plain when label is None."""
    folds = F.lit(settings.folds)
    if label:
        smallest = df.groupBy(label).count().agg(F.min("count").alias("n")).scalar()
        folds = F.least(folds, F.greatest(F.lit(2), smallest))
    ranked = with_class_rank(df, key, label, settings.seed)
    return ranked.withColumn("fold", F.pmod(F.col("class_rank") - 1, folds).cast("int")).drop("class_rank", "class_rank_total")
