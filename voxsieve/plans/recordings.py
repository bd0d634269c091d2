"""Composed jobs that score recordings and transcripts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.features import as_feature_map, intonation_features, with_multimodel_features
from ..functions.scores import fallback_scores, softmax_scores, with_classification
from ..functions.speech import with_segment_outcome, with_synthetic_intonation
from ..functions.text import is_blank, with_text_proxies
from ..operators.align import align_nearest, align_positional, midpoint
from ..operators.features import feature_matrix
from ..operators.learning import Bundle, with_probability
from ..operators.lexicon import lexicon_polarity
from ..operators.rollup import (
    file_prediction_rollup, hate_stats, recording_rollup, transcript_stats, verdict_message)
from ..operators.scorer import Scorer, score_texts
from ..operators.segments import explode_segments, segment_timeline
from ..settings import DEFAULTS, Settings
from ..sources.scratch import stored


def classified(df: DataFrame, make_scorer: Callable[[], Scorer] | None, settings: Settings = DEFAULTS) -> DataFrame:
    """Classification columns of a text table that carries neg, neu and pos.

    A plug-in scorer supplies the model outputs, and `error` tells which texts it failed on; without
    one they follow from the sentiment shares. Blank and failed texts have no classification.
    """
    answered = ~is_blank(F.col("text"))
    if make_scorer is None:
        scored = df.withColumns(fallback_scores(F.col("neg"), F.col("neu"), F.col("pos")))
    else:
        scored = with_classification(score_texts(df, make_scorer), settings=settings)
        answered = answered & F.col("error").isNull()
    return scored.withColumns({
        "overall_toxicity": F.when(answered, F.col("overall_toxicity")),
        "is_toxic": F.coalesce(answered & F.col("is_toxic"), F.lit(False))})


def scored_segments(transcripts: DataFrame, lexicon: DataFrame, settings: Settings = DEFAULTS,
                    keep_empty: bool = True, make_scorer: Callable[[], Scorer] | None = None) -> DataFrame:
    """Segments with text proxies, sentiment and classifier columns; blank ones are not classified."""
    segments = explode_segments(transcripts, keep_blank=True, keep_empty=keep_empty)
    polar = lexicon_polarity(with_text_proxies(segments), lexicon, settings=settings)
    return classified(polar, make_scorer, settings)


@dataclass(frozen=True)
class ScoredRecordings:
    segments: DataFrame
    statistics: DataFrame


def with_segment_features(df: DataFrame) -> DataFrame:
    """Map `features` of classifier and acoustic features, the same in training and in serving."""
    featured = with_multimodel_features(df)
    return featured.withColumn("features", F.map_concat("features", as_feature_map(intonation_features())))


def with_model_probability(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Adds model_probability from a trained bundle; columns named like features stay untouched."""
    packed = with_segment_features(df).select(F.struct(*df.columns).alias("_row"), "features")
    scored = with_probability(bundle.model, feature_matrix(packed, bundle.names), "model_probability")
    return scored.select("_row.*", "model_probability")


#: What result documents, errors and the rollup need of a decided segment.
DECIDED = frozenset((
    "file", "seg_idx", "language", "start_s", "end_s", "text", "is_blank", "extreme", "emotion", "emotion_score", "hate_target",
    "hate_target_confidence", "detected_issues", "sarcasm", "overall_toxicity", "is_toxic", "is_extremist",
    "extremist_probability", "heuristic_used", "heuristic_confidence", "error"))


def score_recordings(transcripts: DataFrame, lexicon: DataFrame, acoustic: DataFrame | None = None,
                     bundle: Bundle | None = None, settings: Settings = DEFAULTS,
                     make_scorer: Callable[[], Scorer] | None = None, store: bool = False) -> ScoredRecordings:
    """Segment decisions, per-recording statistics and messages.

    With `acoustic` (file, seg_idx and acoustic columns of surviving segments) rows are paired by
    position; without it, delivery is estimated from the text and everything up to the rollup is
    one pass without a shuffle. With `bundle` the trained model decides, otherwise the heuristic.
    `store` writes the segment decisions (columns DECIDED) once, for callers that use them besides the statistics.
    """
    scored = scored_segments(transcripts, lexicon, settings, make_scorer=make_scorer)
    if acoustic is None:
        heard = with_synthetic_intonation(scored, settings).withColumn("has_acoustic", F.lit(True))
    else:
        rows = acoustic.drop("start_s", "end_s", "text")
        heard = align_positional(scored, rows, settings=settings)
    if bundle is None:
        heard = heard.withColumn("model_probability", F.lit(None).cast("double"))
    else:
        heard = with_model_probability(heard, bundle)
    ready = heard.withColumns({
        "model_available": F.lit(bundle is not None),
        "model_threshold": F.lit(bundle.threshold if bundle else settings.decision_threshold)})
    outcomes = with_segment_outcome(ready, settings)
    if store:
        outcomes = stored(outcomes.select(*[c for c in outcomes.columns if c in DECIDED]), "segments", "zstd")
    statistics = recording_rollup(outcomes, settings).withColumn("result", verdict_message())
    return ScoredRecordings(outcomes, statistics)


def aligned_pairs(scored: DataFrame, acoustic: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Classified text segments with the acoustic row nearest in time, as training and prediction use them.

    Both sides carry file, start_s and end_s; acoustic rows are numbered by seg_idx.
    """
    left = scored.withColumn("mid", midpoint())
    right = acoustic.withColumn("right_mid", midpoint()).withColumnRenamed("seg_idx", "right_idx")
    shared = [c for c in right.columns if c in left.columns and c != "file"]
    return align_nearest(left, right.drop(*shared), tolerance=settings.alignment_tolerance)


def predict_files(scored: DataFrame, acoustic: DataFrame, bundle: Bundle,
                  settings: Settings = DEFAULTS) -> ScoredRecordings:
    """Trained predictions of aligned pairs and their per-file rollup."""
    pairs = with_model_probability(aligned_pairs(scored, acoustic, settings), bundle)
    decided = pairs.withColumnRenamed("model_probability", "extremist_probability").withColumn(
        "is_extremist", F.col("extremist_probability") >= F.lit(bundle.threshold))
    return ScoredRecordings(decided, file_prediction_rollup(decided, settings))


def timed_segments(transcripts: DataFrame, lexicon: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Scored segments with estimated delivery and a timeline laid out from it."""
    scored = scored_segments(transcripts, lexicon, settings, keep_empty=False)
    bare = with_synthetic_intonation(scored, settings).drop("start_s", "end_s")
    return segment_timeline(bare, settings=settings)


def document_scores(transcripts: DataFrame, lexicon: DataFrame, settings: Settings = DEFAULTS,
                    make_scorer: Callable[[], Scorer] | None = None) -> DataFrame:
    """One row per file: toxicity of the whole text."""
    polar = lexicon_polarity(transcripts.select("file", "text"), lexicon, settings=settings)
    return classified(polar, make_scorer, settings).select(
        "file", F.coalesce("overall_toxicity", F.lit(0.0)).alias("overall_toxicity"), "is_toxic")


def score_transcripts(transcripts: DataFrame, lexicon: DataFrame, settings: Settings = DEFAULTS,
                      make_scorer: Callable[[], Scorer] | None = None) -> DataFrame:
    """Text-only summary row per file: whole-text score next to its segment statistics."""
    stats = transcript_stats(scored_segments(transcripts, lexicon, settings, make_scorer=make_scorer))
    return document_scores(transcripts, lexicon, settings, make_scorer).join(stats, "file").select(
        "file", "overall_toxicity", "is_toxic",
        F.col("avg_toxicity").alias("avg_segment_toxicity"), F.col("max_toxicity").alias("max_segment_toxicity"),
        "total_segments", "toxic_segments", "language")


def score_hate(transcripts: DataFrame, with_logits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Summary row per file of a two-class hate model.

    `with_logits` adds the column `logits` to a table with `text`, for whole texts and segments alike.
    """
    def scored(df: DataFrame) -> DataFrame:
        return with_logits(df).withColumn("_hate", softmax_scores(F.col("logits"), F.col("text"))).select(
            *df.columns, "_hate.*")

    whole = scored(transcripts.select("file", "text"))
    stats = hate_stats(scored(explode_segments(transcripts, keep_blank=True, keep_empty=True)))
    return whole.join(stats, "file").select(
        "file", F.col("hate_score").alias("full_text_hate_score"), F.col("hate_label").alias("full_text_label"),
        F.col("avg_hate_score").alias("avg_segment_hate_score"), F.col("max_hate_score").alias("max_segment_hate_score"),
        "total_segments", "hate_segments", "language")
