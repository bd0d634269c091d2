"""Acoustic rows of timed segments from samples that arrive in chunks.

A recording is never one array. Its samples are laid out anew in blocks of a fixed length, each with a halo of the
samples that follow it, so every frame lies whole in the block it begins in, whatever the length of the chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import top_emotion
from ..settings import DEFAULTS, Settings
from .contour import contour_summary
from .segments import segment_validity

#: Samples of a block.
BLOCK = 16_384
PITCH = ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_slope", "f0_final")


def sample_blocks(chunks: DataFrame, block: int, halo: int) -> DataFrame:
    """(file, block, samples): samples block * `block` up to the next block and `halo` more, from chunks in any order.

    Chunks (file, offset, samples) of a recording follow each other; a gap or an overlap is an error.
    """
    size = F.size("samples")
    begin, end = F.greatest(F.col("offset"), F.col("block") * block), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block + halo)
    pieces = (
        chunks.select("file", F.col("offset").cast("bigint").alias("offset"), "samples", size.alias("size")).filter("size > 0")
        .withColumn("block", F.explode(F.sequence(
            F.floor(F.greatest(F.col("offset") - halo, F.lit(0)) / block), F.floor((F.col("offset") + F.col("size") - 1) / block))))
        .withColumns({"at": begin, "n": end - begin}).filter("n > 0")
        .select("file", "block", "at", "n", F.slice("samples", (F.col("at") - F.col("offset") + 1).cast("int"), F.col("n").cast("int")).alias("samples"))
    )
    whole = F.col("at") == F.col("block") * block
    follows = F.max(F.col("at") + F.col("n")) - F.min("at") == F.sum("n")
    return pieces.groupBy("file", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "samples"))).alias("pieces"), follows.alias("follows"), F.max(whole).alias("whole"),
    ).select("file", "block", F.when(F.col("follows") & F.col("whole"), F.flatten("pieces.samples")).otherwise(
        F.raise_error(F.concat(F.lit("samples do not follow each other: "), F.col("file").cast("string")))).alias("samples"))


def audible_segments(segments: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Valid segments with at least one sample, and the samples from first (included) to last (not included) they cover."""
    lengths = chunks.groupBy("file").agg(F.max(F.col("offset").cast("bigint") + F.size("samples")).alias("_length"))
    rate = F.lit(settings.sample_rate)
    return (
        segment_validity(segments, settings).join(lengths, "file")
        .withColumns({
            "first": F.greatest(F.lit(0), (F.col("start_s") * rate).cast("bigint")),
            "last": F.least(F.col("_length"), (F.col("end_s") * rate).cast("bigint"))})
        .filter("last > first").drop("_length")
    )


def segment_energy(heard: DataFrame, chunks: DataFrame, frame: int, hop: int, min_samples: int, block: int = BLOCK) -> DataFrame:
    """(file, seg_idx, rms_mean, rms_max) over frames centred every `hop` samples of a segment, zero padded at both ends.

    Segments of fewer than `min_samples` samples are not among the rows.
    """
    half = frame // 2
    block = max(block, frame)
    frames = F.floor((F.col("last") - F.col("first") + 2 * half - frame) / hop)  # the last frame's number
    low = F.when(F.col("block") == F.col("home"), F.lit(0)).otherwise(F.ceil((F.col("block") * block - F.col("first") + half) / hop))
    high = F.least(frames, F.ceil(((F.col("block") + 1) * block - F.col("first") + half) / hop) - 1)
    parts = (
        heard.filter(F.col("last") - F.col("first") >= min_samples).select("file", "seg_idx", "first", "last")
        .withColumn("home", F.floor(F.col("first") / block))
        .withColumn("block", F.explode(F.sequence(F.col("home"), F.floor((F.col("last") - 1) / block))))
        .withColumns({"low": low, "high": high}).filter("high >= low")
    )
    met = parts.join(sample_blocks(chunks, block, frame), ["file", "block"])

    def energy(i: Column) -> Column:
        begin = F.col("first") + i * hop - half
        start = F.greatest(begin, F.col("first"))
        span = F.least(begin + frame, F.col("last")) - start
        own = F.slice("samples", (start - F.col("block") * block + 1).cast("int"), F.greatest(span, F.lit(0)).cast("int"))
        return F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))) / frame)

    levels = met.select("file", "seg_idx", "block", F.transform(F.sequence("low", "high"), energy).alias("levels"))
    # one number per block, added up in the blocks' order: the same to the last bit however tasks finish
    totals = F.aggregate(F.array_sort(F.collect_list(F.struct("block", "total"))), F.lit(0.0), lambda a, x: a + x["total"])
    return levels.select(
        "file", "seg_idx", "block", F.size("levels").alias("n"), F.array_max("levels").alias("most"),
        F.aggregate("levels", F.lit(0.0), lambda a, x: a + x).alias("total"),
    ).groupBy("file", "seg_idx").agg((totals / F.sum("n")).alias("rms_mean"), F.max("most").alias("rms_max"))


def acoustic_rows(segments: DataFrame, chunks: DataFrame, contours: DataFrame | None = None, emotions: DataFrame | None = None,
                  frame_seconds: float = 0.025, hop_seconds: float = 0.01, min_energy_samples: int = 400,
                  min_pitch_samples: int = 2048, settings: Settings = DEFAULTS, block: int = BLOCK) -> DataFrame:
    """Acoustic row of every segment (file, seg_idx, start_s, end_s, text) that is long enough and has samples.

    `chunks` (file, offset, samples) holds the signal, `contours` (file, seg_idx, frame, f0) the pitch per frame, and
    `emotions` (file, seg_idx, scores) label scores. What is too short or absent has zeros and the emotion `unknown`.
    """
    heard = audible_segments(segments, chunks, settings)
    energy = segment_energy(heard, chunks, int(frame_seconds * settings.sample_rate), int(hop_seconds * settings.sample_rate),
                            min_energy_samples, block)
    keys = ["file", "seg_idx"]
    rows = heard.join(energy, keys, "left")
    if contours is None:
        rows = rows.withColumns({c: F.lit(0.0) for c in PITCH})
    else:
        pitch = contour_summary(contours.withColumn("_key", F.struct(*keys)), "_key", "frame", "f0", settings).select(
            "_key.*", *[F.col(c).alias(f"_{c}") for c in PITCH])
        enough = F.col("last") - F.col("first") >= min_pitch_samples
        rows = rows.join(pitch, keys, "left").withColumns(
            {c: F.when(enough, F.coalesce(f"_{c}", F.lit(0.0))).otherwise(F.lit(0.0)) for c in PITCH})
    if emotions is None:
        rows = rows.withColumn("_scores", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.join(emotions.select(*keys, F.col("scores").alias("_scores")), keys, "left")
    return rows.withColumn("_top", top_emotion(F.col("_scores"))).select(
        *keys, "start_s", "end_s", "duration", "text", "_top.emotion", "_top.emotion_score", *PITCH,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rms_mean", "rms_max")])
