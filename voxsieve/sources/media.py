"""Media manifests, file pairing and incremental selection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import file_stem
from ..settings import AUDIO_SUFFIXES, VIDEO_SUFFIXES
from .transcripts import path_below


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes in a directory; file contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def listed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name): files of a directory tree and where they lie below it; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        .select("path", path_below(path).alias("name"))
    )


def literal_path(path: str) -> str:
    """A path in which the characters of patterns stand for themselves."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", path)


def media_manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with a media suffix, tagged audio or video, sorted by path."""
    suffix = F.lower(F.regexp_extract(F.col(path), r"[^/.]\.([^./]+)$", 1))
    return (
        files.withColumn("file_type", F.when(suffix.isin(*AUDIO_SUFFIXES), "audio")
                         .when(suffix.isin(*VIDEO_SUFFIXES), "video"))
        .filter(F.col("file_type").isNotNull()).orderBy(path)
    )


def pair_feature_files(text_files: DataFrame, acoustic_files: DataFrame, text_suffix: str = "_multimodel.json",
                       acoustic_suffix: str = "_intonation.json") -> DataFrame:
    """Pairs (base, text_file, acoustic_file) that share a base name; inputs have a `name` column."""
    def based(df: DataFrame, suffix: str, name: str) -> DataFrame:
        stem = F.expr(f"substring(name, 1, length(name) - {len(suffix)})")
        kept = df.filter(F.col("name").endswith(suffix)).withColumn("base", stem)
        return kept.withColumnRenamed("name", name)

    return based(text_files, text_suffix, "text_file").join(
        based(acoustic_files.select("name"), acoustic_suffix, "acoustic_file"), "base")


def skip_existing(inputs: DataFrame, results: DataFrame, name: str = "file", by_path: bool = False) -> DataFrame:
    """Inputs whose stem (the name without directory and suffix) has no stored result yet.

    by_path keeps the directory in the stem, for trees in which names repeat.
    """
    whole = F.col(name) if by_path else F.substring_index(F.col(name), "/", -1)
    stem = file_stem(whole)
    done = results.select(stem.alias("_stem")).distinct()
    return inputs.withColumn("_stem", stem).join(done, "_stem", "left_anti").drop("_stem")
