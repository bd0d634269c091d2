"""Acoustic rows from chunks of samples against numpy, whatever the chunk length."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxsieve.operators.acoustics import acoustic_rows
from voxsieve.settings import DEFAULTS

RATE = 1000
SETTINGS = replace(DEFAULTS, sample_rate=RATE)
RNG = np.random.default_rng(3)
SIGNALS = {"a": RNG.normal(size=5000), "b": RNG.normal(size=301), "c": np.zeros(2000)}
SEGMENTS = [("a", 0.0, 1.0), ("a", 0.9, 3.333), ("a", 4.5, 9.0), ("a", -1.0, 0.5), ("a", 2.0, 2.05), ("a", 3.0, 2.0), ("a", 6.0, 7.0),
            ("b", 0.1, 0.3), ("b", 0.0, 5.0), ("b", 0.15, 0.26), ("c", 0.5, 1.5), ("none", 0.0, 1.0), ("a", None, 1.0)]


def chunked(spark, length):
    rows = [(f, i, x[i:i + length].tolist()) for f, x in SIGNALS.items() for i in range(0, len(x), length)]
    RNG.shuffle(rows)
    return spark.createDataFrame([(f, int(i), v) for f, i, v in rows], "file string, offset long, samples array<double>")


def segments(spark):
    return spark.createDataFrame([(f, k, s, e, "t") for k, (f, s, e) in enumerate(SEGMENTS)],
                                 "file string, seg_idx int, start_s double, end_s double, text string")


def plain(frame=25, hop=10, least=200):
    out = {}
    for k, (f, s, e) in enumerate(SEGMENTS):
        if f not in SIGNALS or s is None or e <= s or e - s < 0.1:
            continue
        y = SIGNALS[f][max(0, int(s * RATE)):min(len(SIGNALS[f]), int(e * RATE))]
        if not len(y):
            continue
        half = frame // 2
        padded = np.pad(y, half)
        levels = [np.sqrt((padded[i:i + frame] ** 2).sum() / frame) for i in range(0, len(padded) - frame + 1, hop)]
        out[k] = (np.mean(levels), np.max(levels)) if len(y) >= least else (0.0, 0.0)
    return out


def test_same_for_any_chunk_length(spark):
    want, seen = plain(), None
    for length, block in ((5000, 16_384), (97, 256), (1, 30), (640, 256)):
        if length == 1:
            block = 256
        got = {r.seg_idx: r for r in acoustic_rows(
            segments(spark), chunked(spark, length), min_energy_samples=200, settings=SETTINGS, block=block).collect()}
        assert set(got) == set(want)
        for k, (mean, most) in want.items():
            assert got[k].rms_mean == pytest.approx(mean, rel=1e-9) and got[k].rms_max == pytest.approx(most, rel=1e-9)
        if block == 256:  # of one block length the result is the same to the last bit
            exact = {k: (r.rms_mean, r.rms_max) for k, r in got.items()}
            assert seen in (None, exact)
            seen = exact
    assert {(r.emotion, r.emotion_score, r.f0_mean, r.f0_slope) for r in got.values()} == {("unknown", 0.0, 0.0, 0.0)}


def test_pitch_and_emotion(spark):
    contours = spark.createDataFrame(
        [(f, k, i, v) for f, k in (("a", 0), ("b", 9)) for i, v in enumerate((100.0, None, 110.0, float("nan"), 120.0))],
        "file string, seg_idx int, frame int, f0 double")
    emotions = spark.createDataFrame([("a", 0, {"sad": 0.2, "angry": 0.7}), ("a", 1, {})], "file string, seg_idx int, scores map<string,double>")
    got = {(r.file, r.seg_idx): r for r in acoustic_rows(
        segments(spark), chunked(spark, 500), contours, emotions, min_pitch_samples=200, settings=SETTINGS).collect()}
    one = got["a", 0]
    assert (one.emotion, one.emotion_score, one.f0_mean, one.f0_range, one.f0_slope) == ("angry", 0.7, 110.0, 20.0, pytest.approx(10.0))
    assert got["b", 9].f0_mean == 0.0 and got["a", 1].emotion == "unknown"  # 110 samples are too few for a pitch


def test_missing_samples_are_an_error(spark):
    holes = chunked(spark, 500).filter(~((F.col("file") == "a") & (F.col("offset") == 1000)))
    with pytest.raises(Exception, match="do not follow each other"):
        acoustic_rows(segments(spark), holes, min_energy_samples=200, settings=SETTINGS).collect()
    assert acoustic_rows(segments(spark), holes.filter("false"), settings=SETTINGS).count() == 0
