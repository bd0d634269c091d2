"""Running totals, row numbers and quantiles that never order a whole group in one task.

A plain window orders everything under one key inside one task. Here rows are first cut into
slices along the order column; windows run inside (key, slice), and the per-slice totals, a few
rows per key, are accumulated and added back.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..settings import DEFAULTS


def index_slices(index: Column, rows: int = DEFAULTS.rows_per_slice) -> Column:
    """Slice number from an integer that is unique within its key: at most `rows` rows per slice."""
    return F.floor(index / F.lit(rows))


#: Most slices of an axis: the quantile sketches that the driver merges grow with the number of slices.
MOST_SLICES = 1_000


def slice_count(df: DataFrame) -> int:
    """As many slices as the session has shuffle partitions, within the bounds of a driver-side sketch.

    A slice is a unit of work, ordered with spill; the number never changes a result.
    """
    return min(MOST_SLICES, max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_quantile_slices(df: DataFrame, column: str, out: str = "slice", slices: int | None = None) -> DataFrame:
    """Slice number by value range; each slice holds about an equal share of the distinct-valued rows.

    The cut points are fixed numbers on the driver (one per slice), so every later evaluation and
    every retried task assigns the same slice.
    """
    n = slices or slice_count(df)
    cuts = df.approxQuantile(column, [i / n for i in range(1, n)], 1.0 / (4 * n))
    inner = sorted({c for c in cuts if abs(c) != float("inf")})
    if not inner:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *inner, float("inf")]
    placed = Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)
    return placed.withColumn(out, F.col(out).cast("int"))


def running_sums(df: DataFrame, keys: list[str], slice_column: str, order: list[Column],
                 sums: dict[str, Column], descending: bool = False, totals: bool = False) -> DataFrame:
    """Inclusive running sums of each expression along `order` within `keys`; every row is kept.

    Null keys are a group, and rows with a null slice come first (last if descending). With `totals`, also
    <name>_total, the sum over the whole group: it rides on the offsets, so no join on the keys alone is made.
    Rows are dealt out once: window and join share one key, a struct, which is equal also where parts of it are null.
    """
    by_slice = F.col(slice_column).desc() if descending else F.col(slice_column).asc()
    local = Window.partitionBy("_by").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # one row per (key, slice): bounded by the number of slices
    across = Window.partitionBy(*keys).orderBy(by_slice).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, slice_column)
        .agg(*[F.sum(v).alias(f"_off_{name}") for name, v in sums.items()])
        .select(*keys, slice_column, *[
            F.coalesce(F.sum(f"_off_{name}").over(across), F.lit(0)).alias(f"_off_{name}") for name in sums],
            *[F.sum(f"_off_{name}").over(Window.partitionBy(*keys)).alias(f"{name}_total") for name in sums if totals])
    )
    by = F.struct(*keys, slice_column)
    offsets = offsets.withColumn("_of", by).drop(*keys, slice_column)
    running = df.withColumn("_by", by).withColumns({f"_run_{name}": F.sum(v).over(local) for name, v in sums.items()})
    joined = running.join(offsets, F.col("_by") == F.col("_of"))
    return joined.withColumns({
        name: F.col(f"_run_{name}") + F.col(f"_off_{name}") for name in sums
    }).drop(*[f"_run_{n}" for n in sums], *[f"_off_{n}" for n in sums], "_by", "_of")


def row_numbers(df: DataFrame, keys: list[str], slice_column: str, order: list[Column], out: str,
                totals: bool = False) -> DataFrame:
    """1-based position along `order` within `keys`; with `totals`, also <out>_total, the group's row count."""
    return running_sums(df, keys, slice_column, order, {out: F.lit(1).cast("bigint")}, totals=totals)


def global_row_number(df: DataFrame, column: str, out: str = "rn") -> DataFrame:
    """1-based position of each row along a unique numeric column of the whole table; nulls come first."""
    sliced = with_quantile_slices(df, column, "_slice")
    return row_numbers(sliced, [], "_slice", [F.col(column)], out).drop("_slice")


def exact_quantiles(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantile of each numeric column, as rows (column, quantile).

    Rows are counted per slice of each column, all columns at once; of the values only those in the slices
    that hold the ranks asked for are shuffled and ordered. What reaches the driver is the counts.
    """
    spark = df.sparkSession
    columns = list(shares)
    n = slice_count(df)
    cuts = df.approxQuantile(columns, [i / n for i in range(1, n)], 1.0 / (4 * n))
    split_lists = []
    for found in cuts:
        inner = sorted({c for c in found if abs(c) != float("inf")}) or [0.0]
        split_lists.append([float("-inf"), *inner, float("inf")])
    placed = Bucketizer(
        splitsArray=split_lists, inputCols=columns, outputCols=[f"_s{i}" for i in range(len(columns))],
        handleInvalid="keep").transform(df)
    values = (
        placed.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").cast("int").alias("slice"),
                     F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])).alias("r"))
        .select("r.*")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in values.groupBy("column", "slice").agg(F.count("*").alias("n")).orderBy("column", "slice").collect():
        sizes.setdefault(r["column"], []).append((r["slice"], r["n"]))
    places = []  # (column, slice, rank within the slice, weight of the value at that rank)
    for column, counts in sizes.items():
        spot = (sum(c for _, c in counts) - 1) * shares[column]
        low, high = floor(spot), ceil(spot)
        for rank, weight in ((low, 1.0 - (spot - low)), (high, spot - low)):
            before = 0
            for number, count in counts:
                if rank < before + count:
                    places.append((column, number, rank - before, weight, rank == low))
                    break
                before += count
    schema = "column string, slice int, rank bigint, weight double, lower boolean"
    wanted = spark.createDataFrame(places, schema)  # two rows per column
    chosen = F.lit(False)
    for column, number in sorted({p[:2] for p in places}):
        chosen = chosen | ((F.col("column") == column) & (F.col("slice") == number))
    reach = F.sum("n").over(Window.partitionBy("column", "slice").orderBy("value"))
    counted = values.filter(chosen).groupBy("column", "slice", "value").agg(F.count("*").alias("n")).withColumn("reach", reach)
    ends = (
        counted.join(F.broadcast(wanted), ["column", "slice"]).filter(F.col("reach") > F.col("rank"))
        .groupBy("column", "lower", "weight").agg(F.min("value").alias("value"))
    )
    low, high = (F.max(F.when(F.col("lower") == side, F.col("value"))) for side in (True, False))
    share = F.max(F.when(~F.col("lower"), F.col("weight")))
    return ends.groupBy("column").agg(low.alias("low"), high.alias("high"), share.alias("share")).select(
        "column", (F.col("low") + F.coalesce((F.col("high") - F.col("low")) * F.col("share"), F.lit(0.0))).alias("quantile"))
