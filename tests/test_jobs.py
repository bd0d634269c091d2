"""Composed jobs: acoustic rows, a trained model, aligned prediction."""

import pytest
from pyspark.sql import functions as F

from voxsieve.plans import recordings as rec, training as tr
from voxsieve.registry import fixtures as fx


@pytest.fixture(scope="module")
def bundle(spark, small):
    rows = fx.labeled(spark, small).filter("label is not null").select("row_id", "text", "label")
    return tr.train_from_labels(rows, "row_id", fx.lexicon(spark), "logistic")


@pytest.fixture(scope="module")
def parts(spark, small):
    transcripts = fx.transcripts(spark, small).filter(fx.doc_id() < 20)
    timed = rec.timed_segments(transcripts, fx.lexicon(spark))
    acoustic = timed.filter("num_words >= 4").select(
        "file", "seg_idx", "start_s", "end_s", "duration", "emotion", "emotion_score", "f0_mean", "f0_std", "f0_min",
        "f0_max", "f0_range", "f0_slope", "f0_final", "rms_mean", "rms_max")
    return transcripts, timed, acoustic


def test_missing_acoustic_rows_leave_segments_undecided(spark, parts):
    transcripts, timed, acoustic = parts
    out = rec.score_recordings(transcripts, fx.lexicon(spark), acoustic)
    n = {r.file: r.n for r in acoustic.groupBy("file").agg(F.count("*").alias("n")).collect()}
    decided = {r.file: r.n for r in out.segments.groupBy("file").agg(
        F.count(F.when(F.col("has_acoustic"), 1)).alias("n")).collect()}
    assert decided == {f: n.get(f, 0) for f in decided}
    assert out.segments.filter("not has_acoustic and extremist_probability is not null").count() == 0
    assert out.statistics.count() == 20


def test_trained_model_replaces_the_heuristic(spark, parts, bundle):
    transcripts, timed, _ = parts
    out = rec.score_recordings(transcripts, fx.lexicon(spark), bundle=bundle).segments
    assert out.filter("heuristic_used").count() == 0
    assert out.filter("not is_blank and seg_idx is not null and extremist_probability is null").count() == 0
    assert out.filter("is_extremist <> (extremist_probability >= model_threshold)").count() == 0


def test_prediction_over_aligned_pairs(spark, parts, bundle):
    _, timed, acoustic = parts
    text_side = timed.drop(*[c for c in acoustic.columns if c not in ("file", "seg_idx", "start_s", "end_s")])
    out = rec.predict_files(text_side, acoustic, bundle)
    # a segment with its own acoustic row is matched to it: distance 0
    own = out.segments.filter("right_idx = seg_idx")
    assert own.count() == acoustic.count() and own.filter("distance > 1e-9").count() == 0
    totals = {r.file: r.total_segments for r in out.statistics.collect()}
    assert sum(totals.values()) == out.segments.count()
    assert out.statistics.filter("is_extremist_content is null").count() == 0


def test_plug_in_scorer_drives_the_verdict(spark, parts):
    transcripts = parts[0]

    def make():
        def scorer(texts):
            if any(t == "BAD" for t in texts):
                raise RuntimeError("cannot score")
            return [{"toxic": {"toxic": 1.0, "insult": 1.0}, "target": {"race": 0.9}} for _ in texts]
        return scorer

    extra = spark.createDataFrame([("odd", "BAD", "en", [(0.0, 1.0, "BAD"), (1.0, 2.0, " ")])], transcripts.schema)
    out = rec.score_recordings(transcripts.unionByName(extra), fx.lexicon(spark), make_scorer=make, store=True)
    odd = out.segments.filter("file = 'odd'").orderBy("seg_idx").collect()
    assert odd[0].error.error_message == "cannot score" and odd[0].is_extremist is None
    assert odd[1].error is None and odd[1].extreme == 0.0
    others = out.segments.filter("file <> 'odd' and not is_blank")
    assert others.filter("overall_toxicity < 1 or hate_target <> 'Race'").count() == 0
    stats = {r.file: r.is_extremist_content for r in out.statistics.collect()}
    assert stats.pop("odd") is None and all(stats.values())


def test_hate_summary(spark, parts):
    transcripts = parts[0]

    def with_logits(df):
        return df.withColumn("logits", F.array(F.lit(0.0), F.when(F.length("text") % 2 == 0, 2.0).otherwise(-2.0)))

    got = rec.score_hate(transcripts, with_logits).collect()
    assert len(got) == 20
    for r in got:
        assert r.hate_segments <= r.total_segments and 0 < r.full_text_hate_score < 1
        assert (r.full_text_label == "hate") == (r.full_text_hate_score > 0.5)
