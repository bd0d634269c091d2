"""Matching text segments with acoustic segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..settings import DEFAULTS, Settings
from ..sources.scratch import stored
from .ordering import index_slices, row_numbers, with_quantile_slices


def midpoint(start: str = "start_s", end: str = "end_s") -> Column:
    return (F.coalesce(F.col(start), F.lit(0.0)) + F.coalesce(F.col(end), F.lit(0.0))) / 2


def align_nearest(left: DataFrame, right: DataFrame, key: str = "file", left_mid: str = "mid",
                  right_mid: str = "right_mid", right_index: str = "right_idx",
                  tolerance: float = DEFAULTS.alignment_tolerance) -> DataFrame:
    """Each left row with its nearest right row of the same key, closer than `tolerance`.

    Ties go to the lower right index; right rows may be reused; left rows without a match are
    dropped. Instead of comparing pairs, both sides are reduced to distinct points on the time axis,
    ordered together, and each point looks at its neighbour before and after. Slices of the axis
    keep a very long recording out of a single task; neighbours in other slices are carried over.
    Both inputs are evaluated once, whatever scoring they come from.
    """
    left, right = stored(left, "left"), stored(right, "right")
    left_points = left.select(F.col(key), F.col(left_mid).alias("mid"), F.lit(None).cast("bigint").alias("idx"))
    right_points = right.select(
        F.col(key), F.col(right_mid).alias("mid"), F.col(right_index).cast("bigint").alias("idx"))
    points = left_points.unionByName(right_points)
    distinct = (
        with_quantile_slices(points, "mid", "slice")
        .groupBy(key, "slice", "mid")
        .agg(F.min("idx").alias("idx"), F.max(F.col("idx").isNull()).alias("wanted"))
    )
    # read by two branches below: written once instead of scanned and shuffled twice
    sliced = stored(distinct, "points").withColumn("hit", F.when(F.col("idx").isNotNull(), F.col("mid")))
    rows = (Window.unboundedPreceding, Window.currentRow)
    forward = Window.partitionBy(key, "slice").orderBy("mid").rowsBetween(*rows)
    backward = Window.partitionBy(key, "slice").orderBy(F.col("mid").desc()).rowsBetween(*rows)
    # per key at most one row per slice
    edges = sliced.groupBy(key, "slice").agg(
        F.max("hit").alias("last_mid"), F.max_by("idx", "hit").alias("last_idx"),
        F.min("hit").alias("first_mid"), F.min_by("idx", "hit").alias("first_idx"))
    before_here = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(*before_here)
    later = Window.partitionBy(key).orderBy(F.col("slice").desc()).rowsBetween(*before_here)
    carried = edges.select(key, "slice", *[
        F.last(f"{edge}_{part}", ignorenulls=True).over(window).alias(f"{side}_carried_{part}")
        for side, edge, window in (("before", "last", earlier), ("after", "first", later)) for part in ("mid", "idx")])
    near = (
        sliced.withColumns({
            f"{side}_{part}": F.last(column, ignorenulls=True).over(window)
            for side, window in (("before", forward), ("after", backward))
            for part, column in (("mid", "hit"), ("idx", "idx"))})
        .filter("wanted")
        .join(carried, [key, "slice"])
        .withColumns({
            f"{side}_{part}": F.coalesce(f"{side}_{part}", f"{side}_carried_{part}")
            for side in ("before", "after") for part in ("mid", "idx")})
        .select(key, F.col("mid").alias("_mid"), F.least(*[
            F.when(F.col(f"{side}_idx").isNotNull(), F.struct(
                F.abs(F.col("mid") - F.col(f"{side}_mid")).alias("distance"), F.col(f"{side}_idx").alias("idx")))
            for side in ("before", "after")]).alias("best"))
        .filter(F.col("best.distance") < tolerance)
        .select(key, "_mid", F.col("best.distance").alias("distance"), F.col("best.idx").alias("_idx"))
    )
    matched = left.join(near.withColumnRenamed("_mid", left_mid), [key, left_mid])
    return matched.withColumnRenamed("_idx", right_index).join(
        right.withColumn(right_index, F.col(right_index).cast("bigint")), [key, right_index])


def align_positional(left: DataFrame, right: DataFrame, key: str = "file", index: str = "seg_idx",
                     settings: Settings = DEFAULTS) -> DataFrame:
    """The i-th left row of a recording with its i-th surviving right row; no match leaves nulls."""
    right = stored(right, "surviving")  # numbered and counted: evaluated once
    sliced = right.withColumn("_slice", index_slices(F.col(index), settings.rows_per_slice))
    placed = (
        row_numbers(sliced, [key], "_slice", [F.col(index)], "_rn")
        .withColumn("_pos", F.col("_rn") - 1)
        .drop("_rn", "_slice", index)
    )
    return (
        left.withColumn("_pos", F.col(index).cast("bigint"))
        .join(placed.withColumn("has_acoustic", F.lit(True)), [key, "_pos"], "left")
        .withColumn("has_acoustic", F.coalesce("has_acoustic", F.lit(False)))
        .drop("_pos")
    )


def compare_versions(original: DataFrame, filled: DataFrame, key: str, label: str, filled_label: str,
                     prediction: str) -> DataFrame:
    """Agreement of filled label and prediction over rows whose original label was missing."""
    missing = original.filter(F.col(label).isNull()).select(key)
    same = F.col(filled_label).eqNullSafe(F.col(prediction)).cast("double")
    return (
        filled.select(key, filled_label, prediction).join(missing, key)
        .agg(F.count("*").alias("n_rows"), F.sum(same).cast("bigint").alias("n_match"),
             F.coalesce(F.avg(same) * 100, F.lit(0.0)).alias("match_percent"))
    )
