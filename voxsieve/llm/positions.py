"""Positions of rows within their keys, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import stored


def positions(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """All columns, `pos` (0-based along `order` within `key`, which holds no null) and `n`, the key's row count.

    Rows are dealt by ranges of (key, order), so a frequent key lies in many slices and every slice is
    sorted on its own. What is accumulated per key are the row counts of its slices. The dealt rows are a
    written table, so slices stay what they are when executors are lost. Rows that are equal in key and
    order get positions in any order.
    """
    dealt = stored(
        rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
        .withColumn("_at", F.monotonically_increasing_id()), name
    ).withColumn("_slice", F.shiftright("_at", 33))  # the upper bits number the slice, the lower ones its rows
    across = Window.partitionBy("_key").orderBy("_run")
    runs = (
        dealt.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_run"))
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .select("_key", "_run", "_first",
                F.coalesce(F.sum("_rows").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                F.sum("_rows").over(Window.partitionBy("_key")).alias("n"))
    )
    return (
        dealt.join(runs, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_run")))
        .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_key", "_run", "_first", "_before", "_at", "_slice")
    )
