"""Transcript to segment rows, and row filters on segments."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import strip
from ..settings import DEFAULTS, Settings
from .ordering import index_slices, running_sums


def explode_segments(transcripts: DataFrame, keep_blank: bool = False, keep_empty: bool = False) -> DataFrame:
    """One row per segment: file, language, seg_idx, start_s, end_s, trimmed text, and class_name and document if there are such.

    keep_blank keeps blank segments (is_blank marks them); keep_empty also keeps one row with a
    null seg_idx for a transcript without segments, so rollups need no join to find it.
    """
    # always outer: an inner explode repeats the computation of `segments` as a pushed-down filter
    carried = [c for c in ("class_name", "document") if c in transcripts.columns]
    exploded = transcripts.select(
        "file", *carried, "language", F.posexplode_outer("segments").alias("seg_idx", "segment"))
    if not keep_empty:
        exploded = exploded.filter(F.col("seg_idx").isNotNull())
    rows = (
        exploded.select(
            "file", *carried, "language", "seg_idx",
            F.col("segment.start").alias("start_s"), F.col("segment.end").alias("end_s"),
            F.when(F.col("seg_idx").isNotNull(),
                   strip(F.coalesce(F.col("segment.text"), F.lit("")))).alias("text"))
        .withColumn("is_blank", F.coalesce(F.col("text") == "", F.lit(False)))
    )
    return rows if keep_blank else rows.filter(~F.col("is_blank"))


def segment_timeline(segments: DataFrame, keys: tuple[str, ...] = ("file",), index: str = "seg_idx",
                     duration: str = "duration", settings: Settings = DEFAULTS) -> DataFrame:
    """Start and end seconds of consecutive segments from their durations."""
    sliced = segments.withColumn("_slice", index_slices(F.col(index), settings.rows_per_slice))
    timed = running_sums(sliced, list(keys), "_slice", [F.col(index)], {"end_s": F.col(duration)})
    return timed.withColumn("start_s", F.col("end_s") - F.col(duration)).drop("_slice")


def segment_validity(segments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Segments long enough for acoustic analysis, with their duration."""
    length = F.col("end_s") - F.col("start_s")
    return (
        segments.filter((F.col("end_s") > F.col("start_s")) & (length >= settings.min_segment_seconds))
        .withColumn("duration", length)
    )


@F.pandas_udf(T.DoubleType())
def _compression_ratio(text: pd.Series) -> pd.Series:
    raw = text.fillna("").str.encode("utf-8")
    return raw.map(lambda b: len(b) / len(zlib.compress(b)))


def transcript_quality_gate(segments: DataFrame, settings: Settings = DEFAULTS,
                            compression_from_text: bool = False) -> DataFrame:
    """Drop segments a transcriber would reject; measures that are absent are not tested."""
    if compression_from_text and "compression_ratio" not in segments.columns:
        segments = segments.withColumn("compression_ratio", _compression_ratio("text"))
    limits = {
        "compression_ratio": F.col("compression_ratio") <= settings.max_compression_ratio,
        "mean_logprob": F.col("mean_logprob") >= settings.min_mean_logprob,
        "no_speech_prob": F.col("no_speech_prob") <= settings.max_no_speech,
    }
    for name, accepted in limits.items():
        if name in segments.columns:
            segments = segments.filter(F.coalesce(accepted, F.lit(True)))
    return segments
