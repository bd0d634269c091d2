"""Labelled and annotated tables: reading, exporting, splitting into parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import normalize_label, strip
from ..operators.ordering import global_row_number
from ..settings import LABEL_COLUMNS, TEXT_COLUMNS


def detect_column(columns: list[str], explicit: str | None, candidates: tuple[str, ...], kind: str) -> str:
    if explicit and explicit in columns:
        return explicit
    found = next((c for c in candidates if c in columns), None)
    if found is None:
        raise ValueError(f"no {kind} column found; available columns: {columns}")
    return found


def _csv_reader(spark: SparkSession, sep: str, multi_line: bool):
    return spark.read.options(header=True, sep=sep, multiLine=multi_line, quote='"', escape='"')


def head_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First n rows in the given order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def read_labeled_csv(spark: SparkSession, path: str, text_column: str | None = None,
                     label_column: str | None = None, n_rows: int | None = None, sep: str = ",",
                     multi_line: bool = True) -> DataFrame:
    """Cleaned (text, label) rows of a labelled CSV; n_rows keeps the first rows in file order."""
    raw = _csv_reader(spark, sep, multi_line).csv(path)
    text = detect_column(raw.columns, text_column, TEXT_COLUMNS, "text")
    label = detect_column(raw.columns, label_column, LABEL_COLUMNS, "label")
    picked = raw.select(F.col(text).alias("text"), F.col(label).alias("label"),
                        F.col("_metadata.file_path").alias("_path"),
                        F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_line"))
    if n_rows is not None:
        picked = head_rows(picked, n_rows, [F.col("_path"), F.col("_block"), F.col("_line")])
    return (
        picked.select(strip(F.col("text")).alias("text"), normalize_label(F.col("label"), yes_no_letters=False).alias("label"))
        .filter(F.col("label").isNotNull() & (F.col("text") != ""))
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Per-annotator rows from Parquet."""
    return spark.read.parquet(path)


def export_columns(df: DataFrame, columns: list[str], path: str, sep: str = ",", header: bool = True) -> None:
    """Write chosen columns as CSV, or as TSV with sep=tab."""
    df.select(*columns).write.mode("overwrite").options(
        header=header, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)


def split_parts(df: DataFrame, order: str, max_rows: int) -> DataFrame:
    """Adds `part`, numbered from 1: consecutive runs of at most max_rows rows along `order`."""
    numbered = global_row_number(df, order, "_rn")
    return numbered.withColumn("part", F.floor((F.col("_rn") - 1) / F.lit(max_rows)) + 1).drop("_rn")


def write_parts(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").partitionBy("part").options(
        header=True, sep="\t", quote='"', escape='"').csv(path)
