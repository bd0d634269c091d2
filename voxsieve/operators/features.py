"""Feature tables from feature maps."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F


#: Most columns of a feature matrix; more names are refused, not cut off.
MOST_NAMES = 10_000


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Sorted union of map keys: the columns of the feature matrix."""
    keys = df.select(F.explode_outer(F.map_keys(column)).alias("k")).filter("k is not null").distinct()
    found = [r["k"] for r in keys.limit(MOST_NAMES + 1).collect()]
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} feature names; are they really names?")
    return sorted(found)


def feature_matrix(df: DataFrame, names: list[str], column: str = "features") -> DataFrame:
    """One DOUBLE column per name, 0 where the map lacks it; other keys are ignored."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *[F.coalesce(F.try_element_at(column, F.lit(n)), F.lit(0.0)).alias(n) for n in names])


def assemble(df: DataFrame, names: list[str], out: str = "vector") -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol=out).transform(df)


def stack_classes(parts: dict[int, DataFrame]) -> DataFrame:
    """Bag union of per-class tables with the class as `label`."""
    labelled = [df.withColumn("label", F.lit(c)) for c, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), labelled)
