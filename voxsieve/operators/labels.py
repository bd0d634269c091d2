"""Label curation: annotator averages, column profiles, imputation, scaling, filling, progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import normalize_label
from ..settings import ANNOTATOR_TOKENS, ID_COLUMNS, IGNORED_COLUMNS
from .ordering import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def find_id_column(columns: list[str], explicit: str | None = None) -> str:
    """Explicit name, else a known name, else the first column ending in _id."""
    if explicit and explicit in columns:
        return explicit
    known = [c for c in ID_COLUMNS if c in columns] or [c for c in columns if c.lower().endswith("_id")]
    if not known:
        raise ValueError(f"no id column among {columns}; name one")
    return known[0]


def annotator_rollup(df: DataFrame, key: str, order_key: str) -> DataFrame:
    """Per id: mean of numeric columns, first non-null of the others along `order_key`."""
    numeric = set(numeric_columns(df))
    aggregates = []
    for c in df.columns:
        if c in (key, order_key):
            continue
        if c in numeric:
            aggregates.append(F.avg(c).alias(c))
        else:
            aggregates.append(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_key))).alias(c))
    return df.groupBy(key).agg(*aggregates)


def group_targets(df: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    """Per id: feature means, label mean, whether labelled, and the binary target."""
    mean = F.avg(normalize_label(F.col(label)))
    return df.groupBy(key).agg(
        *[F.avg(c).alias(c) for c in features],
        mean.alias("label_mean"),
        mean.isNotNull().alias("is_labeled"),
        F.when(mean.isNotNull(), (mean >= 0.5).cast("int")).alias("target"),
    )


def broadcast_predictions(df: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Group-level columns on every source row; clashing names get the suffix _by_id."""
    for c in predictions.columns:
        if c != key and c in df.columns:
            predictions = predictions.withColumnRenamed(c, f"{c}_by_id")
    return df.join(predictions, key, "left")


def fill_labels(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Adds <label>_filled: the label where present, else the prediction."""
    return df.withColumn(f"{label}_filled", F.coalesce(F.col(label), F.col(prediction).cast(df.schema[label].dataType)))


def prediction_rates(df: DataFrame, label: str, prediction: str) -> DataFrame:
    known = F.col(label).isNotNull()
    return df.agg(
        F.avg(F.when(known, normalize_label(F.col(label)))).alias("labeled_rate"),
        F.avg(F.when(~known, F.col(prediction))).cast("double").alias("predicted_rate"),
    )


def labeling_progress(log: DataFrame, data: DataFrame) -> DataFrame:
    """Counts of a labelling log; a skipped text counts as labelled."""
    total = data.agg(F.count("*").alias("n")).scalar()
    counts = log.agg(F.count("*").alias("labeled"), *[
        F.count(F.when(F.col("label") == value, 1)).alias(name) for value, name in
        (("extremist", "flagged"), ("not_extremist", "not_flagged"), ("skipped", "skipped"))])
    return counts.withColumn(
        "percent_done", F.when(total > 0, F.col("labeled") / total * 100).otherwise(F.lit(0.0)))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Per class: count, balanced weight n/(k*n_c), and the small-data guard flag."""
    everything = Window.partitionBy()  # runs over one row per class
    classes, rows = F.count("*").over(everything), F.sum("n").over(everything)
    small = (classes < 2) | (F.min("n").over(everything) < 2) | (rows < 6)
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.select(
        "label", "n", rows.alias("n_rows"), (rows / (classes * F.col("n"))).alias("weight"), small.alias("too_small"))


def candidate_columns(df: DataFrame, label: str, explicit: list[str] | None = None,
                      ignore: tuple[str, ...] = ()) -> list[str]:
    names = [c for c in (explicit or df.columns) if c in df.columns and c != label]
    return [
        c for c in names
        if c not in IGNORED_COLUMNS and c not in ignore
        and not any(token in c.lower() for token in ANNOTATOR_TOKENS)]


def profile_columns(df: DataFrame, columns: list[str], max_distinct: int = 1000, max_ratio: float = 0.2,
                    max_length: int = 50, exact: bool = True) -> DataFrame:
    """Rows (column, is_numeric, n_rows, n_distinct, distinct_ratio, mean_length, role, method).

    Distinct values are counted for non-numeric columns only, with one `method` for all of them: `exact` shuffles
    their values, `hll` merges sketches in one pass without a shuffle of values.
    """
    numeric = set(numeric_columns(df))
    texts = [c for c in columns if c not in numeric]
    numbers = [c for c in columns if c in numeric]
    parts = []
    if texts and exact:
        values = (
            df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in texts])).alias("r"))
            .groupBy("r.column", "r.value").agg(F.count("*").alias("n")))
        filled = F.when(F.col("value").isNotNull(), F.col("n"))
        parts.append(values.groupBy("column").agg(
            F.lit(False).alias("is_numeric"), F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"),
            (F.sum(F.length("value") * filled) / F.sum(filled)).alias("mean_length")))
    elif texts:
        measured = [F.struct(
            F.lit(c).alias("column"), F.lit(False).alias("is_numeric"), F.count("*").alias("n_rows"),
            F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(14))), F.lit(0)).cast("bigint").alias("n_distinct"),
            F.avg(F.length(F.col(c).cast("string"))).alias("mean_length")) for c in texts]
        parts.append(df.agg(F.array(*measured).alias("all")).select(F.inline("all")))
    if numbers:
        parts.append(df.agg(F.count("*").alias("n_rows")).select(
            F.explode(F.array(*map(F.lit, numbers))).alias("column"), F.lit(True).alias("is_numeric"), "n_rows",
            F.lit(None).cast("bigint").alias("n_distinct"), F.lit(None).cast("double").alias("mean_length")))
    profile = parts[0]
    for part in parts[1:]:
        profile = profile.unionByName(part)
    ratio = F.col("n_distinct") / F.greatest(F.col("n_rows"), F.lit(1))
    length = F.coalesce("mean_length", F.lit(0.0))
    role = (
        F.when(F.col("is_numeric"), "numeric")
        .when((F.col("n_distinct") <= max_distinct) & (ratio <= max_ratio) & (length <= max_length), "categorical")
        .otherwise("ignored"))
    method = F.when(~F.col("is_numeric"), F.lit("exact" if exact else "hll"))
    return profile.select("column", "is_numeric", "n_rows", "n_distinct", ratio.alias("distinct_ratio"),
                          "mean_length", role.alias("role"), method.alias("method"))


def typed_value(value: str, kind: T.DataType) -> object:
    """A value that was cast to a string, as a value of its type."""
    if isinstance(kind, T.BooleanType):
        return value == "true"
    if isinstance(kind, T.IntegralType):
        return int(value)
    return float(value) if isinstance(kind, T.FractionalType) else value


@dataclass(frozen=True)
class Imputer:
    """Fitted replacement values: medians of numeric columns, most frequent categories."""

    values: dict[str, object]

    @staticmethod
    def fit(df: DataFrame, numeric: list[str], categorical: list[str] = ()) -> "Imputer":
        values: dict[str, object] = {}
        if numeric:
            values |= {r["column"]: r["quantile"] for r in exact_quantiles(df, dict.fromkeys(numeric, 0.5)).collect()}
        if categorical:
            # counted per value, all columns in one pass; the smallest value wins a tie
            kinds = df.select(*categorical).schema
            listed = df.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in categorical])).alias("r"))
            counts = listed.filter("r.value IS NOT NULL").groupBy("r.column", "r.value").agg(F.count("*").alias("n"))
            order = F.coalesce(*[F.when(F.col("column") == c, F.col("value").cast(kinds[c].dataType).cast("double"))
                                 for c in categorical if not isinstance(kinds[c].dataType, T.StringType)], F.lit(0.0))
            best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), order, "value")).alias("value"))
            for r in best.collect():  # one row per column
                values[r["column"]] = typed_value(r["value"], kinds[r["column"]].dataType)
        return Imputer(values)

    def transform(self, df: DataFrame) -> DataFrame:
        """Null and NaN replaced."""
        return df.withColumns({
            c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(v)) if isinstance(v, float) else F.col(c), F.lit(v))
            for c, v in self.values.items()})


@dataclass(frozen=True)
class Standardizer:
    """Fitted means and population deviations; a zero deviation divides by 1."""

    means: dict[str, float]
    deviations: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "Standardizer":
        row = df.agg(*[a for c in columns for a in (
            F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        return Standardizer({c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] or 1.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.deviations[c]) for c, m in self.means.items()})


#: Most levels of a category that becomes columns; more are refused, not cut off.
MOST_LEVELS = 10_000


def category_levels(df: DataFrame, column: str) -> list[str]:
    """The levels that become columns."""
    levels = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels in {column}; is it a category?")
    return sorted(r[0] for r in levels)


def one_hot(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    """Indicator columns <column>_<level>; a level unseen at fit time is all zero."""
    levels = category_levels(df, column) if levels is None else levels
    value: Column = F.col(column)
    return df.withColumns({
        f"{column}_{level}": F.coalesce(value == F.lit(level), F.lit(False)).cast("double") for level in levels})
