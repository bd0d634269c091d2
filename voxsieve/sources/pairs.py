"""Recordings stored as two files: classified text segments and acoustic segments.

The classified file is an object with `segment_classifications`; the acoustic one a list of segments. Score
names are open, so both are read as VARIANT and nothing is inferred over the files. Files may be packed (<name>.gz).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.features import ACOUSTIC
from ..schemas import MODELS
from .recording_files import PACKED
from .small_files import files_of_folder
from .transcripts import path_below

TEXT_SUFFIX = "_multimodel.json"
ACOUSTIC_SUFFIX = "_intonation.json"
#: The names of the models' outputs in the classified file.
OUTPUTS = dict(zip(MODELS, ("toxic_bert", "hate_detection", "offensive_detection", "sentiment", "target_analysis"), strict=True))


def _member_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """base, value (VARIANT) and error of each file with the suffix below `path`."""
    raw = files_of_folder(spark, path, suffix)
    if raw is None:  # a pattern, a single file, or a file system that only Spark opens
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"{{*{suffix},*{suffix}{PACKED}}}").text(
            path, wholetext=True).select(path_below(path).alias("name"), "value")
    name = F.regexp_replace("name", f"{re.escape(PACKED)}$", "")
    return raw.select(
        F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("base"),
        F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("value"),
    ).withColumn("error", F.when(F.col("value").isNull(), "Failed to parse JSON file"))


def _field(name: str, kind: str, of: str = "segment") -> Column:
    return F.try_variant_get(F.col(of), f"$.{name}", kind)


def _numbers(name: str) -> Column:
    """The numbers of an object of scores; other values are left out."""
    every = F.try_variant_get(F.col("segment"), f"$.{name}", "map<string,variant>")
    read = F.transform_values(every, lambda k, v: F.try_variant_get(v, "$", "double"))
    return F.coalesce(F.map_filter(read, lambda k, v: v.isNotNull()), F.create_map().cast("map<string,double>"))


def _segments(files: DataFrame, of: Column) -> DataFrame:
    """base, seg_idx and segment; files that cannot be read have none.

    Outer, and without a filter on the files: either would have every file parsed again.
    """
    return files.select("base", F.posexplode_outer(of).alias("seg_idx", "segment")).filter("seg_idx is not null")


def classified_segments(files: DataFrame) -> DataFrame:
    """Rows (base, seg_idx, start_s, end_s, text and classification columns) of the readable files."""
    rows = _segments(files, F.try_variant_get("value", "$.segment_classifications", "array<variant>"))
    toxic = F.coalesce(_field("is_toxic", "boolean"), _field("is_toxic", "double") != 0, F.lit(False))
    return rows.select(
        "base", "seg_idx", _field("start", "double").alias("start_s"), _field("end", "double").alias("end_s"),
        _field("text", "string").alias("text"), F.coalesce(_field("overall_toxicity", "double"), F.lit(0.0)).alias("overall_toxicity"),
        toxic.alias("is_toxic"), _field("hate_target", "string").alias("hate_target"),
        F.coalesce(_field("hate_target_confidence", "double"), F.lit(0.0)).alias("hate_target_confidence"),
        F.coalesce(_field("detected_issues", "array<string>"), F.array().cast("array<string>")).alias("detected_issues"),
        F.struct(*[_numbers(f"model_outputs.{name}").alias(m) for m, name in OUTPUTS.items()]).alias("model_outputs"),
        _numbers("categories").alias("categories"))


def acoustic_segments(files: DataFrame) -> DataFrame:
    """Rows (base, seg_idx, start_s, end_s and acoustic columns) of the readable files; what is no list has none."""
    rows = _segments(files, F.try_variant_get("value", "$", "array<variant>"))
    return rows.select(
        "base", "seg_idx", _field("start", "double").alias("start_s"), _field("end", "double").alias("end_s"),
        _field("emotion", "string").alias("emotion"), *[_field(c, "double").alias(c) for c in ACOUSTIC])


def feature_files(spark: SparkSession, path: str, text_suffix: str = TEXT_SUFFIX,
                  acoustic_suffix: str = ACOUSTIC_SUFFIX) -> tuple[DataFrame, DataFrame]:
    """The classified and the acoustic files (base, value, error) below `path`; pairs share their base."""
    return _member_files(spark, path, text_suffix), _member_files(spark, path, acoustic_suffix)


def broken_members(text_files: DataFrame, acoustic_files: DataFrame) -> DataFrame:
    """Error rows of files that cannot be parsed."""
    kinds = {"multimodel": text_files, "intonation": acoustic_files}
    parts = [df.filter("error is not null").select(
        F.col("base").alias("file"), F.lit(kind).alias("file_type"), F.current_timestamp().alias("timestamp"),
        F.lit("JSONDecodeError").alias("error_type"), F.col("error").alias("error_message")) for kind, df in kinds.items()]
    return parts[0].unionByName(parts[1])
