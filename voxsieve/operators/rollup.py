"""Per-recording statistics, verdict messages and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import percent
from ..settings import DEFAULTS, Settings


def _language() -> Column:
    """One language per file, the last in the alphabet if its segments name several."""
    return F.coalesce(F.max("language"), F.lit("unknown")).alias("language")


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def transcript_stats(segments: DataFrame) -> DataFrame:
    """Per file over non-blank segments: counts, mean and maximum toxicity."""
    spoken = F.col("seg_idx").isNotNull() & ~F.col("is_blank")
    tox = F.when(spoken, F.col("overall_toxicity"))
    return segments.groupBy("file").agg(
        _language(),
        _count(spoken).alias("total_segments"),
        _count(spoken & F.col("is_toxic")).alias("toxic_segments"),
        _or_zero(F.avg(tox)).alias("avg_toxicity"),
        _or_zero(F.max(tox)).alias("max_toxicity"),
    )


def hate_stats(segments: DataFrame) -> DataFrame:
    """Per file over non-blank segments: counts, mean and maximum hate score."""
    spoken = F.col("seg_idx").isNotNull() & ~F.col("is_blank")
    score = F.when(spoken, F.col("hate_score"))
    return segments.groupBy("file").agg(
        _language(),
        _count(spoken).alias("total_segments"),
        _count(spoken & (F.col("hate_label") == "hate")).alias("hate_segments"),
        _or_zero(F.avg(score)).alias("avg_hate_score"),
        _or_zero(F.max(score)).alias("max_hate_score"),
    )


def issue_frequency(segments: DataFrame) -> DataFrame:
    """Rows (file, category, n): segments of the file showing each issue."""
    return (
        # outer, then dropped: an inner explode repeats the scoring below it as a pushed-down filter
        segments.select("file", F.explode_outer("detected_issues.category").alias("category"))
        .filter(F.col("category").isNotNull())
        .groupBy("file", "category").agg(F.count("*").alias("n"))
    )


def issue_frequency_map(frequency: DataFrame) -> DataFrame:
    """The same counts as one map per file; a file has few categories."""
    entries = F.collect_list(F.struct("category", "n"))
    return frequency.groupBy("file").agg(F.map_from_entries(F.array_sort(entries)).alias("issue_frequency"))


def top_issues(frequency: DataFrame, n: int = 10, per_file: bool = True) -> DataFrame:
    """The n most frequent categories, per file or over everything; names break ties."""
    if per_file:
        rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "category"))
        return frequency.withColumn("rank", rank).filter(F.col("rank") <= n)
    total = frequency.groupBy("category").agg(F.sum("n").alias("n"))
    return total.orderBy(F.desc("n"), "category").limit(n)


def recording_rollup(segments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per file over all segments, blank ones included; verdict is null when nothing was decided."""
    present = F.col("seg_idx").isNotNull()
    flagged = present & F.col("is_extremist")
    total = F.greatest(_count(present), F.lit(1))
    probability = F.col("extremist_probability")
    weighted = _or_zero(F.sum(F.when(flagged, probability))) / total
    return segments.groupBy("file").agg(
        _language(),
        _count(present).alias("total_segments"),
        _count(present & F.col("is_toxic")).alias("toxic_segments"),
        (_or_zero(F.sum("overall_toxicity")) / total).alias("avg_toxicity"),
        _or_zero(F.max("overall_toxicity")).alias("max_toxicity"),
        _count(flagged).alias("extremist_segments"),
        _or_zero(F.avg(probability)).alias("avg_extremist_probability"),
        _or_zero(F.max(probability)).alias("max_extremist_probability"),
        (_count(flagged) / total).alias("extremist_ratio"),
        weighted.alias("weighted_extremist_score"),
        F.when(F.count(probability) > 0, weighted > settings.verdict_threshold).alias("is_extremist_content"),
    )


def file_prediction_rollup(pairs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per file over aligned pairs; the verdict is always decided."""
    flagged = F.col("is_extremist")
    total = F.count("*")
    weighted = _or_zero(F.sum(F.when(flagged, F.col("extremist_probability")))) / total
    return pairs.groupBy("file").agg(
        total.alias("total_segments"),
        _count(flagged).alias("extremist_segments"),
        (total - _count(flagged)).alias("non_extremist_segments"),
        (_count(flagged) / total).alias("extremist_ratio"),
        _or_zero(F.avg("extremist_probability")).alias("avg_extremist_probability"),
        weighted.alias("weighted_extremist_score"),
        (weighted > settings.verdict_threshold).alias("is_extremist_content"),
    )


def verdict_message() -> Column:
    """Summary sentence from the columns of recording_rollup."""
    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    flagged, total, toxic = (F.col(c) for c in ("extremist_segments", "total_segments", "toxic_segments"))
    ratio = percent(F.col("extremist_ratio"))
    weighted = percent(F.col("weighted_extremist_score"))
    share = percent(F.when(total > 0, toxic / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0)))
    highest = percent(F.col("max_toxicity"))
    verdict = F.col("is_extremist_content")
    return (
        F.when(verdict, text(
            "EXTREMIST CONTENT DETECTED: ", flagged, "/", total, " segments (", ratio, "). Weighted score: ",
            weighted, ", Avg probability: ", percent(F.col("avg_extremist_probability"))))
        .when(~verdict, text(
            "Non-extremist content. ", flagged, "/", total, " extremist segments detected (", ratio,
            "). Weighted score: ", weighted))
        .when(toxic == 0, F.lit("No toxic content detected."))
        .when(toxic == 1, text("1 toxic segment detected (", share, " of content). Max toxicity: ", highest))
        .otherwise(text(
            toxic, " toxic segments detected (", share, " of content). Average toxicity: ",
            percent(F.col("avg_toxicity")), ", Max: ", highest))
    )


def display_fields() -> list[Column]:
    """Segment fields under the names in which results are displayed and read again."""
    return [
        F.col("start_s").alias("startTime"), F.col("end_s").alias("endTime"), F.col("text"), F.col("extreme"), F.col("emotion"),
        F.col("emotion_score").alias("emotionScore"), F.col("hate_target").alias("hateTarget"),
        F.col("hate_target_confidence").alias("hateTargetConfidence"), F.col("detected_issues").alias("classification"),
        F.col("sarcasm")]


def json_envelope(segments: DataFrame, statistics: DataFrame, segment_fields: list[str | Column],
                  settings: Settings = DEFAULTS, documents: DataFrame | None = None) -> DataFrame:
    """Result documents (file, part, n_segments, document).

    `documents` (file, overall_toxicity, is_toxic) adds the classification of the whole text.

    A recording of up to `segments_per_document` segments is one document; a longer one continues
    in further parts, so no task ever gathers a whole long recording.
    """
    part = F.coalesce(F.floor(F.col("seg_idx") / F.lit(settings.segments_per_document)), F.lit(0)).alias("part")
    segment = F.when(F.col("seg_idx").isNotNull(), F.struct(F.col("seg_idx"), *segment_fields))
    # dealt by file, as the join below needs them, so documents are not dealt out a second time
    grouped = segments.repartition("file").groupBy("file", part).agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    stats = [c for c in statistics.columns if c != "file"]
    described = statistics.select(
        "file", verdict_message().alias("result"), F.col("is_extremist_content").alias("verdict"),
        F.struct(*stats).alias("statistics"))
    whole = []
    if documents is not None:
        described = described.join(documents.select(
            "file", F.struct("overall_toxicity", "is_toxic").alias("full_text_classification")), "file", "left")
        whole = ["full_text_classification"]
    document = F.struct(
        F.lit(True).alias("success"), F.col("result"), F.col("verdict").alias("isExtremist"), F.col("part"),
        F.col("segments"), F.col("statistics"), *whole, F.col("file").alias("filename"))
    return grouped.join(described, "file").select(
        "file", "part", F.size("segments").alias("n_segments"),
        F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def run_summary(records: DataFrame, status: str = "status") -> DataFrame:
    """Counts by outcome, with the time span when started_at/ended_at exist."""
    counts = [F.count("*").alias("total")] + [
        _count(F.col(status) == s).alias(s) for s in ("processed", "skipped", "failed")]
    if {"started_at", "ended_at"} <= set(records.columns):
        first, last = F.min("started_at"), F.max("ended_at")
        seconds = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6
        counts += [first.alias("start_time"), last.alias("end_time"), seconds.alias("duration_seconds")]
    return records.agg(*counts)
