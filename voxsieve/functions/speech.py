"""Column functions on acoustic rows: synthetic delivery, sarcasm, heuristic, audio arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import DEFAULTS, Settings
from .text import clamp


def spoken_seconds(num_words: Column) -> Column:
    """Estimated speaking time of a text."""
    return clamp(num_words / 2.5, 0.3, 30.0)


def with_synthetic_intonation(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Acoustic columns estimated from text proxies and sentiment (compound, pos, neg, neu)."""
    c, p, n, u = (F.col(x) for x in ("compound", "pos", "neg", "neu"))
    q, k = F.col("punct_intensity"), F.col("caps_ratio")
    low, high = settings.f0_min, settings.f0_max
    happy = (c >= 0.4) & (p > n)
    hostile = (c <= -0.4) & (n >= F.greatest(p, u))
    sad = (c > -0.4) & (c < 0) & (n > 0.3)
    strength = (
        F.when(happy, p).when(hostile, n).when(sad, F.greatest(n, -c))
        .when(u > 0, u).otherwise(0.5 - F.abs(c) * 0.5))
    emotion = (
        F.when(happy, "happy").when(hostile & (n > 0.6), "angry").when(hostile, "disgust")
        .when(sad, "sad").otherwise("neutral"))
    mean, std, slope, rms = F.col("f0_mean"), F.col("f0_std"), F.col("f0_slope"), F.col("rms_mean")
    return (
        df.withColumns({
            "emotion": emotion,
            "emotion_score": clamp(strength, 0.0, 1.0),
            "duration": spoken_seconds(F.col("num_words")),
            "f0_mean": clamp(170 + 40 * (p - n), low, high),
            "f0_std": clamp(15 + 60 * q + 25 * k + 20 * F.abs(c), 5.0, 80.0),
            "f0_slope": clamp(50 * (p - n) + 120 * q, -100.0, 100.0),
            "rms_mean": clamp(0.03 + 0.08 * k + 0.06 * q + 0.02 * F.abs(c), 0.005, 0.12),
        }).withColumns({
            "f0_min": F.greatest(F.lit(low), mean - 1.2 * std),
            "f0_max": F.least(F.lit(high), mean + 1.2 * std),
            "f0_range": clamp(std * 2.8, 30.0, 300.0),
            "f0_final": clamp(mean + 0.15 * slope, low, high),
            "rms_max": F.greatest(rms, F.least(rms * 1.8, F.lit(0.2))),
        })
    )


def with_sarcasm(df: DataFrame, toxicity: str = "overall_toxicity") -> DataFrame:
    """Adds sarcasm_probability and sarcasm_pattern: the strongest delivery pattern plus part credit
    for the others."""
    tox, spread, std, seconds = F.col(toxicity), F.col("f0_range"), F.col("f0_std"), F.col("duration")
    emotion, certainty = F.lower("emotion"), F.col("emotion_score")
    patterns = [
        ("deadpan", 0.35, (spread > 150) & (std < 20) & (seconds > 2)),
        ("monotone", 0.30, (std < 15) & (seconds > 3)),
        ("emotion_mismatch", 0.40, emotion.isin("happy", "neutral") & (certainty > 0.5) & (tox > 0.6)),
        ("exaggerated", 0.30, (spread > 200) & (std > 40)),
        ("slow_delivery", 0.25, (seconds > 5) & (std < 25)),
        ("happy_toxic", 0.45, (emotion == "happy") & (certainty > 0.6) & (tox > 0.4) & (tox < 0.7)),
    ]
    found = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(weight).alias("weight"), F.lit(name).alias("name")))
        for name, weight, test in patterns]))
    best, total = F.col("_best"), F.col("_total")
    # least skips nulls, so a row without any pattern must be excluded first
    score = F.when(best.isNotNull(), F.least(best["weight"] + 0.3 * (total - best["weight"]), F.lit(0.95)))
    return (
        df.withColumn("_found", found)
        .withColumns({"_best": F.array_max("_found"),
                      "_total": F.aggregate("_found", F.lit(0.0), lambda a, x: a + x["weight"])})
        .withColumns({"sarcasm_probability": F.coalesce(score, F.lit(0.0)),
                      "sarcasm_pattern": F.coalesce(best["name"], F.lit("none"))})
        .drop("_found", "_best", "_total")
    )


def sarcasm_discount(toxicity: Column, probability: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Whether sarcasm is detected, and the lowered score and its confidence."""
    detected = probability > settings.sarcasm_threshold
    cut = settings.sarcasm_reduction_min + settings.sarcasm_reduction_span * probability
    return {
        "detected": detected,
        "score": F.when(detected, toxicity * (1.0 - cut)).otherwise(toxicity),
        "confidence": F.when(detected, probability * 0.8).otherwise(F.lit(0.0)),
    }


def with_intonation_heuristic(df: DataFrame, toxicity: str = "overall_toxicity",
                              has_acoustic: str = "has_acoustic") -> DataFrame:
    """Adds heuristic_score, heuristic_certainty and heuristic_factors: toxicity adjusted by emotion,
    pitch, energy and slope. Without an acoustic row toxicity stays as it is."""
    tox, heard = F.col(toxicity), F.col(has_acoustic)
    emotion, certainty = F.lower("emotion"), F.col("emotion_score")

    def share(value: Column, full: float) -> Column:
        return F.when(value > 0, F.least(value / full, F.lit(1.0))).otherwise(F.lit(0.0))

    variation, energy, steepness = F.col("_variation"), F.col("_energy"), F.col("_steepness")
    shift, count = F.col("_shift"), F.size("_adjustments")
    raw = F.least(0.3 + count * 0.15 + F.abs(shift) / F.greatest(count, F.lit(1)) * 2.0, F.lit(0.85))
    damped = F.when((tox < 0.2) | (tox > 0.8), raw * 0.7).otherwise(raw)
    return (
        df.withColumns({
            "_variation": F.greatest(share(F.col("f0_std"), 50.0), share(F.col("f0_range"), 200.0)),
            "_energy": share(F.col("rms_mean"), 0.1),
            "_steepness": share(F.abs("f0_slope"), 50.0)})
        .withColumn("_adjustments", F.array_compact(F.array(
            F.when(emotion.isin("angry", "fear", "disgust") & (certainty > 0.5), 0.15 * certainty)
            .when(emotion.isin("happy", "neutral") & (certainty > 0.5), -0.05 * certainty),
            F.when(variation > 0.6, 0.10 * variation),
            F.when(energy > 0.6, 0.08 * energy),
            F.when(steepness > 0.5, 0.05 * steepness))))
        .withColumn("_shift", F.aggregate("_adjustments", F.lit(0.0), lambda a, x: a + x))
        .withColumns({
            "heuristic_score": F.when(heard, clamp(tox + shift, 0.0, 1.0)).otherwise(tox),
            "heuristic_certainty": F.when(heard & (count > 0), damped).otherwise(F.lit(0.0)),
            "heuristic_factors": F.when(heard, count).otherwise(F.lit(0))})
        .drop("_variation", "_energy", "_steepness", "_adjustments", "_shift")
    )


def adaptive_decision(score: Column, confidence: Column, settings: Settings = DEFAULTS) -> Column:
    """Flag when the adjusted score passes a threshold that confidence lowers."""
    return score > settings.toxicity_threshold - 0.1 * confidence


def with_segment_outcome(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per-segment decision: trained model, else heuristic, else undecided.

    Reads overall_toxicity (null = no classification), has_acoustic, model_available,
    model_probability, model_threshold and the acoustic columns.
    """
    toxicity, acoustic = F.col("overall_toxicity"), F.col("has_acoustic")
    modelled = toxicity.isNotNull() & acoustic & F.col("model_available")
    heuristic = toxicity.isNotNull() & acoustic & ~F.col("model_available")
    df = with_intonation_heuristic(df)
    score, confidence = F.col("heuristic_score"), F.col("heuristic_certainty")
    detected, probability, pattern = F.lit(False), F.lit(0.0), F.lit("none")
    if settings.sarcasm_enabled:
        df = with_sarcasm(df)
        probability, pattern = F.col("sarcasm_probability"), F.col("sarcasm_pattern")
        cut = sarcasm_discount(toxicity, probability, settings)
        detected = cut["detected"]
        df = df.withColumns({
            "heuristic_score": F.when(detected, cut["score"]).otherwise(score),
            "heuristic_certainty": F.when(detected, cut["confidence"]).otherwise(confidence)})
    model = F.col("model_probability")
    return df.withColumns({
        "extreme": F.when(toxicity.isNull(), F.lit(0.0)).when(heuristic, score).otherwise(toxicity),
        "is_extremist": F.when(modelled, model >= F.col("model_threshold"))
        .when(heuristic, adaptive_decision(score, confidence, settings)),
        "extremist_probability": F.when(modelled, model).when(heuristic, score),
        "heuristic_used": F.coalesce(heuristic, F.lit(False)),
        "heuristic_confidence": F.when(heuristic, confidence),
        "sarcasm": F.when(heuristic, F.struct(
            detected.alias("detected"), probability.alias("probability"), pattern.alias("pattern"))),
    }).drop("heuristic_score", "heuristic_certainty", "heuristic_factors", "sarcasm_probability", "sarcasm_pattern")


def slice_audio(samples: Column, start: Column, end: Column, sample_rate: int = DEFAULTS.sample_rate) -> Column:
    """Samples between two times, clipped to the signal."""
    first = F.greatest(F.lit(0), (start * sample_rate).cast("int"))
    last = F.least(F.size(samples), (end * sample_rate).cast("int"))
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))


def rms_energy(samples: Column, frame: int, hop: int, min_samples: int) -> Column:
    """Struct(rms_mean, rms_max) over frames centred every `hop` samples, zero padded at both ends."""
    squares = F.transform(samples, lambda x: x.cast("double") * x.cast("double"))
    half = frame // 2
    count = F.size(samples)
    frames = F.floor((count + 2 * half - frame) / F.lit(hop)).cast("int")

    def energy(i: Column) -> Column:
        begin = i * hop - half
        first = F.greatest(begin, F.lit(0))
        span = F.least(begin + frame, count) - first
        total = F.aggregate(F.slice(squares, first + 1, F.greatest(span, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
        return F.sqrt(total / frame)

    levels = F.transform(F.sequence(F.lit(0), F.greatest(frames, F.lit(0))), energy)
    mean = F.aggregate(levels, F.lit(0.0), lambda a, x: a + x) / F.size(levels)
    enough = count >= min_samples
    return F.struct(
        F.when(enough, mean).otherwise(F.lit(0.0)).alias("rms_mean"),
        F.when(enough, F.array_max(levels)).otherwise(F.lit(0.0)).alias("rms_max"),
    )
