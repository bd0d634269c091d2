"""Thresholds and fixed values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # scoring
    toxicity_threshold: float = 0.5
    verdict_threshold: float = 0.3
    target_floor: float = 0.3
    max_text_length: int = 2000
    issue_skip: tuple[str, ...] = ("nothate", "not-offensive", "neutral", "positive")
    # decision and training
    decision_threshold: float = 0.5
    optimize_threshold: bool = True
    f_beta: float = 2.0
    validation_share: float = 0.2
    folds: int = 5
    seed: int = 42
    forest_trees: int = 200
    forest_depth: int = 20
    forest_min_leaf: int = 2
    boosted_rounds: int = 150
    boosted_depth: int = 10
    boosted_step: float = 0.1
    boosted_subsample: float = 0.8
    logistic_iterations: int = 1000
    logistic_c: float = 1.0
    # alignment and audio
    alignment_tolerance: float = 0.5
    min_segment_seconds: float = 0.1
    sample_rate: int = 16000
    f0_min: float = 75.0
    f0_max: float = 600.0
    # sarcasm is opt-in
    sarcasm_enabled: bool = False
    sarcasm_threshold: float = 0.4
    sarcasm_reduction_min: float = 0.3
    sarcasm_reduction_span: float = 0.5
    # transcription quality gates
    max_compression_ratio: float = 2.4
    min_mean_logprob: float = -1.0
    max_no_speech: float = 0.6
    # scale guards
    rows_per_slice: int = 100_000
    segments_per_document: int = 5_000
    max_inline_lexicon: int = 1_000
    # a forest's fit has at most so many rows times trees, or one tree: MLlib grows its trees on the driver
    rows_of_fit: int = 250_000
    fits_at_once: int = 6


DEFAULTS = Settings()

# Label vocabularies, file suffixes and column-name candidates that
# decide which rows count as what; results depend on them verbatim.
TOXIC_LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
EMOTIONS = ("angry", "fear", "happy", "neutral", "sad", "disgust")
EMOTION_CODES = {
    "hap": "Happy", "ang": "Angry", "neu": "Neutral", "sad": "Sad",
    "dis": "Disgust", "fea": "Fear", "sur": "Surprise",
}
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv", "webm", "flv", "wmv", "m4v", "mpeg", "mpg")
AUDIO_SUFFIXES = ("mp3", "wav", "ogg", "m4a", "flac", "aac", "wma", "opus")
TRUE_LABELS = ("1", "true", "yes", "extremist")
FALSE_LABELS = ("0", "false", "no", "not extremist", "non-extremist", "non extremist")
TEXT_COLUMNS = ("text", "Text", "sentence", "content", "transcript", "message", "tweet")
LABEL_COLUMNS = ("extremism", "extremism_filled", "Extremist", "label", "Label", "is_extremist", "target")
ID_COLUMNS = ("id", "Id", "ID", "video_id", "videoId", "sample_id", "uid", "UUID", "uuid")
IGNORED_COLUMNS = (
    "text", "Text", "message", "Message", "content", "Content", "tweet", "Tweet",
    "transcript", "Transcript", "title", "Title", "body", "Body", "raw_text", "RawText",
    "id", "Id", "ID", "uuid", "UUID", "video_id", "VideoId", "video", "Video",
)
ANNOTATOR_TOKENS = (
    "annotator", "rater", "worker", "labeler", "coder", "judge",
    "grader", "mturk", "turk", "user", "reviewer",
)
