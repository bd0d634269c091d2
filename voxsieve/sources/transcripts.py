"""Reading transcripts and saved results."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import is_blank, strip
from ..schemas import RESULT, SEGMENT, TRANSCRIPT


def decoded(address: Column) -> Column:
    """A file's address without escapes; a plus sign stands for itself."""
    return F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))


def path_below(path: str) -> Column:
    """Where a file lies below `path`; its whole address where `path` is a pattern."""
    root = quote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/"), safe="/:@!$&'()*+,;=~")
    address = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    found = (
        F.when(address == root, F.substring_index(address, "/", -1))
        .when(address.startswith(f"{root}/"), F.regexp_replace(address, "^" + re.escape(f"{root}/"), "")).otherwise(address)
    )
    return decoded(found)


def parse_transcripts(raw: DataFrame, path: str, one_per_file: bool = True) -> DataFrame:
    """JSON texts (column value) read from files below `path`, as rows of transcript_files."""
    if not one_per_file:
        raw = raw.filter(~is_blank(F.col("value")))
    wide = T.StructType([*TRANSCRIPT.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.select(
        path_below(path).alias("path"),
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("class_name"),
        F.from_json(F.regexp_replace("value", "^\ufeff", ""), wide, {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("_t"))
    broken = F.col("_t").isNull() | F.col("_t._corrupt_record").isNotNull()
    own = F.lit(None).cast("string") if one_per_file else F.col("_t.file")
    return parsed.select(
        F.coalesce(own, F.col("path")).alias("file"), "path", "class_name",
        strip(F.coalesce("_t.text", F.lit(""))).alias("text"),
        F.coalesce("_t.language", F.lit("unknown")).alias("language"),
        F.coalesce("_t.segments", F.array().cast(T.ArrayType(SEGMENT))).alias("segments"),
        F.when(broken, F.lit("Failed to parse JSON file")).alias("error"))


def transcript_files(spark: SparkSession, path: str, one_per_file: bool = True, pattern: str = "*.json",
                     only: list[str] | None = None) -> DataFrame:
    """Every transcript (file, path, class_name, text, language, segments, error) in a directory tree of JSON.

    `file` is the path below `path`, so equal names in two directories stay apart; class_name is the
    directory a file lies in. one_per_file=False reads files of one document per line, which split
    across tasks; there a document's own `file` names it. What cannot be parsed has an error; Spark's
    readers see no files of zero bytes. `only` names the files below `path` that are opened.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(path if only is None else only, wholetext=one_per_file)
    )
    return parse_transcripts(raw, path, one_per_file)


def read_transcripts(spark: SparkSession, path: str, one_per_file: bool = True, with_class: bool = False) -> DataFrame:
    """The readable transcripts of transcript_files; broken_transcripts has the others."""
    folder = ["class_name"] if with_class else []
    files = transcript_files(spark, path, one_per_file).filter("error is null")
    return files.select("file", *folder, "text", "language", "segments")


def broken_transcripts(files: DataFrame) -> DataFrame:
    """Error rows of transcript_files."""
    return files.filter("error is not null").select(
        "file", F.lit("transcript").alias("file_type"), F.current_timestamp().alias("timestamp"),
        F.lit("JSONDecodeError").alias("error_type"), F.col("error").alias("error_message"))


def reload_results(spark: SparkSession, path: str | list[str], one_per_file: bool = True,
                   pattern: str = "*.json") -> DataFrame:
    """Saved results (file, valid, error, document fields); invalid ones keep an error text.

    A recording written in several parts comes back as one row per `part`.
    """
    schema = T.StructType([*RESULT.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = (
        spark.read.schema(schema).option("multiLine", one_per_file)
        .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    )
    name = F.regexp_replace(F.coalesce("filename", F.col("_metadata.file_name")), r"-result\.json$", "")
    valid = F.col("success").isNotNull() & F.col("segments").isNotNull() & F.col("_corrupt_record").isNull()
    # fixed values: the two messages
    error = (
        F.when(F.col("_corrupt_record").isNotNull(), "Failed to parse JSON file")
        .when(~valid, "Invalid JSON format. Expected result format with 'success' and 'segments' fields."))
    return raw.select(
        F.coalesce(F.nullif(name, F.lit("")), F.lit("uploaded")).alias("file"), valid.alias("valid"),
        error.alias("error"), "success", "result", "isExtremist", F.coalesce("part", F.lit(0)).alias("part"),
        "segments", "statistics", "full_text_classification")


def dead_letter(df: DataFrame, column: str, schema: T.StructType, source: Column, kind: Column,
                out: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """Parse a JSON column; returns (good rows with `out`, error rows)."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("_p", F.from_json(
        F.col(column), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("_p._corrupt_record").isNotNull()
    good = parsed.filter(~F.coalesce(broken, F.lit(False))).withColumn(
        out, F.struct(*[F.col(f"_p.{f.name}") for f in schema.fields])).drop("_p")
    bad = parsed.filter(broken).select(
        source.cast("string").alias("file"), kind.alias("file_type"), F.current_timestamp().alias("timestamp"),
        F.lit("JSONDecodeError").alias("error_type"),
        F.concat(F.lit("cannot parse: "), F.col(column)).alias("error_message"))
    return good, bad
