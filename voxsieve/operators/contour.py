"""Summaries of ordered measurement series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..settings import DEFAULTS, Settings
from .ordering import index_slices

TAIL = 25


def contour_summary(series: DataFrame, key: str, frame: str, value: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Per key over valid points: mean, deviation, minimum, maximum, range, slope against the point
    number, and the mean of the last 25 points. A key without valid points gives zeros.

    `frame` is an integer unique within its key. Points are numbered inside slices of the frame
    axis and the slices' moments are then combined, so a long series is never sorted in one task.
    """
    v = F.col(value)
    points = series.select(
        F.col(key), F.col(frame).alias("frame"),
        F.when(v.isNotNull() & ~F.isnan(v), v).alias("v"),
        index_slices(F.col(frame), settings.rows_per_slice).alias("slice"))
    inside = Window.partitionBy(key, "slice")
    valid = F.col("v").isNotNull()
    numbered = points.withColumns({
        "x": F.sum(valid.cast("bigint")).over(inside.orderBy("frame")) - 1.0,
        "left": F.sum(valid.cast("bigint")).over(inside.orderBy(F.col("frame").desc())),
    })
    both = F.when(valid, F.col("x"))
    slices = numbered.groupBy(key, "slice").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean_v"), F.avg(both).alias("mean_x"),
        F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("var_v"), F.coalesce(F.var_pop(both), F.lit(0.0)).alias("var_x"),
        F.coalesce(F.covar_pop(both, F.col("v")), F.lit(0.0)).alias("cov"),
        F.min("v").alias("low"), F.max("v").alias("high"),
        F.collect_list(F.when(valid & (F.col("left") <= TAIL), F.struct("left", "v"))).alias("tail"))
    # one row per slice of a key from here on
    across = Window.partitionBy(key)
    earlier = across.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    later = across.orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumns({
        "mean_x": F.col("mean_x") + F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        "after": F.coalesce(F.sum("n").over(later), F.lit(0)),
    })
    n = F.col("n")
    centre_v = F.sum(n * F.col("mean_v")).over(across) / F.sum(n).over(across)
    centre_x = F.sum(n * F.col("mean_x")).over(across) / F.sum(n).over(across)
    recent = F.filter("tail", lambda t: t["left"] + F.col("after") <= TAIL)
    placed = placed.withColumns({
        "dv": F.col("mean_v") - F.when(F.sum(n).over(across) > 0, centre_v),
        "dx": F.col("mean_x") - F.when(F.sum(n).over(across) > 0, centre_x),
        "tail_sum": F.aggregate(recent, F.lit(0.0), lambda a, t: a + t["v"]),
        "tail_n": F.size(recent),
    })

    def pooled(within: str, a: str, b: str):
        return F.sum(n * (F.col(within) + F.col(a) * F.col(b)))

    spread_x = pooled("var_x", "dx", "dx")
    slope = F.when(spread_x > 0, pooled("cov", "dx", "dv") / spread_x)
    return placed.groupBy(key).agg(
        F.sum(n).alias("n_valid"),
        *[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in {
            "f0_mean": F.try_divide(F.sum(n * F.col("mean_v")), F.sum(n)),
            "f0_std": F.sqrt(F.try_divide(pooled("var_v", "dv", "dv"), F.sum(n))),
            "f0_min": F.min("low"),
            "f0_max": F.max("high"),
            "f0_range": F.max("high") - F.min("low"),
            "f0_slope": slope,
            "f0_final": F.try_divide(F.sum("tail_sum"), F.sum("tail_n")),
        }.items()])
