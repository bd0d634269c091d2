"""Hand-computed cases at threshold edges, ties and empty input."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from voxsieve.functions import features as feat, scores as sc, speech as sp, text as tx
from voxsieve.operators import labels as lb, rollup as ru, scorer, segments as sg
from voxsieve.operators.lexicon import lexicon_polarity
from voxsieve.plans import recordings as rec
from voxsieve.registry import fixtures as fx
from voxsieve.schemas import TRANSCRIPT
from voxsieve.settings import DEFAULTS


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_proxies_by_hand(spark):
    df = spark.createDataFrame([(1, "STOP that NOW!! ok?... A1B xyz"), (2, ""), (3, None), (4, "......")], "i int, text string")
    got = {r.i: r for r in tx.with_text_proxies(df).collect()}
    a = got[1]
    assert a.num_words == 6 and abs(a.caps_ratio - 3 / 6) < 1e-12
    assert abs(a.punct_intensity - (2 + 0.6 + 0.8) / 6) < 1e-12
    assert abs(a.avg_word_len - (4 + 4 + 5 + 6 + 3 + 3) / 6) < 1e-12
    for i in (2, 3):
        assert (got[i].num_words, got[i].caps_ratio, got[i].avg_word_len) == (0, 0, 0)
    assert abs(got[4].punct_intensity - 1.6) < 1e-12


def test_label_words(spark):
    for raw, train, fill in (("y", None, 1), ("n", None, 0), (" TRUE ", 1, 1), ("-0.5", 0, 0), ("1e0", 1, 1),
                             ("nan", None, None), ("inf", None, None), ("1.0d", None, None), ("2", 0, 0)):
        r = one(spark, a=tx.normalize_label(F.lit(raw), False), b=tx.normalize_label(F.lit(raw)))
        assert (r.a, r.b) == (train, fill), raw


@pytest.mark.parametrize("url,valid,error", [
    ("https://a.b/c.MP4?x=1", True, ""), ("  http://a.b ", True, ""), ("HTTP://A", True, ""),
    ("ftp://a.b/c.mp4", False, "File URL must use http or https protocol"),
    ("not a url", False, "Invalid URL format"), ("https://", False, "Invalid URL format"),
    (" ", False, "File URL is required"), (None, False, "File URL is required")])
def test_validate_url(spark, url, valid, error):
    r = one(spark, v=tx.validate_url(F.lit(url).cast("string"))).v
    assert (r.valid, r.error) == (valid, error)


def test_media_names(spark):
    for url, name, ext, result in (
            ("https://a.b/c.MP4?x=1", "c.MP4", ".MP4", "c-result.json"),
            ("https://a.b/d/", "video", ".mp4", "video-result.json"),
            ("https://a.b/.hidden", ".hidden", ".mp4", "result-result.json"),
            ("https://a.b/x.tar.gz", "x.tar.gz", ".gz", "x.tar-result.json")):
        r = one(spark, **tx.url_media_name(F.lit(url)))
        assert (r.media_name, r.extension, r.result_name) == (name, ext, result)


def test_timestamps(spark):
    r = one(spark, t=tx.timestamp_parts(F.lit(125.9))).t
    assert (r.minute, r.second, r.text) == (2, 5, "2:05")


def test_overall_uses_top_three_and_ignores_absent(spark):
    m = F.create_map(F.lit("toxic_toxic"), F.lit(0.9), F.lit("hate_HATE"), F.lit(0.6), F.lit("hate_NOT-HATE"), F.lit(1.0))
    assert abs(one(spark, t=sc.overall_toxicity(m)).t - 0.75) < 1e-12
    assert one(spark, t=sc.overall_toxicity(sc.empty_scores())).t == 0.0


def test_target_rules(spark):
    m = F.create_map(F.lit("not_bullying"), F.lit(0.99), F.lit("race_based"), F.lit(0.5), F.lit("age-based"), F.lit(0.5))
    r = one(spark, a=sc.hate_target(m, F.lit(0.51)), b=sc.hate_target(m, F.lit(0.5)))
    assert (r.a.target, r.a.confidence, r.b.target, r.b.confidence) == ("Race Based", 0.5, None, 0.0)


def test_issue_skip_words_keep_the_mismatching_labels(spark):
    m = F.create_map(F.lit("hate_NOT-HATE"), F.lit(0.9), F.lit("sentiment_neutral"), F.lit(0.9), F.lit("offensive_not-offensive"),
                     F.lit(0.9), F.lit("toxic_insult"), F.lit(0.5))
    assert one(spark, i=sc.issue_text(sc.detect_issues(m))).i == ["hate_NOT-HATE:0.900"]


ROW = dict(f0_range=160.0, f0_std=19.0, f0_slope=-20.0, duration=6.0, emotion="Happy", emotion_score=0.7, rms_mean=0.05)


def acoustic(spark, toxicity=0.65, **changes):
    values = {**ROW, **changes, "overall_toxicity": toxicity}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(True).alias("has_acoustic"))


def test_sarcasm_adds_part_credit(spark):
    r = sp.with_sarcasm(acoustic(spark)).first()
    # happy_toxic .45 leads; mismatch .40, deadpan .35 and slow .25 count for a third
    assert r.sarcasm_pattern == "happy_toxic"
    assert abs(r.sarcasm_probability - (0.45 + 0.3 * (0.40 + 0.35 + 0.25))) < 1e-12
    calm = sp.with_sarcasm(acoustic(spark, f0_range=100.0, f0_std=30.0, emotion="sad", duration=2.0)).first()
    assert (calm.sarcasm_probability, calm.sarcasm_pattern) == (0.0, "none")


def test_heuristic_by_hand(spark):
    r = sp.with_intonation_heuristic(acoustic(spark, 0.5, emotion="angry", f0_std=40.0, rms_mean=0.08)).first()
    shift = 0.15 * 0.7 + 0.10 * 0.8 + 0.08 * 0.8
    assert r.heuristic_factors == 3
    assert abs(r.heuristic_score - (0.5 + shift)) < 1e-12
    assert abs(r.heuristic_certainty - min(0.3 + 0.45 + 2 * shift / 3, 0.85)) < 1e-12
    low = sp.with_intonation_heuristic(acoustic(spark, 0.1, emotion="sad", f0_std=10.0, f0_range=10.0, f0_slope=0.0)).first()
    assert (low.heuristic_score, low.heuristic_certainty) == (0.1, 0.0)


def test_outcome_paths(spark):
    base = acoustic(spark, 0.9).withColumns({
        "model_available": F.lit(True), "model_probability": F.lit(0.4), "model_threshold": F.lit(0.4)})
    r = sp.with_segment_outcome(base).first()
    assert (r.is_extremist, r.extremist_probability, r.extreme, r.heuristic_used) == (True, 0.4, 0.9, False)
    failed = sp.with_segment_outcome(base.withColumn("model_probability", F.lit(None).cast("double"))).first()
    assert (failed.is_extremist, failed.extremist_probability, failed.extreme) == (None, None, 0.9)
    blank = sp.with_segment_outcome(base.withColumn("overall_toxicity", F.lit(None).cast("double"))).first()
    assert (blank.extreme, blank.is_extremist, blank.heuristic_used) == (0.0, None, False)
    sly = sp.with_segment_outcome(base.withColumn("model_available", F.lit(False)), replace(DEFAULTS, sarcasm_enabled=True)).first()
    assert sly.sarcasm.detected and sly.extreme < 0.9


def transcript(file, *lines, language="en"):
    return (file, " ".join(lines), language, [(None, None, t) for t in lines])


def test_rollup_of_blank_and_empty_recordings(spark):
    df = spark.createDataFrame([transcript("blank", " ", ""), transcript("empty"), transcript("calm", "good day", " ")], TRANSCRIPT)
    got = {r.file: r for r in rec.score_recordings(df, fx.lexicon(spark)).statistics.collect()}
    assert got["empty"].total_segments == 0 and got["empty"].is_extremist_content is None
    assert got["blank"].total_segments == 2 and got["blank"].result == "No toxic content detected."
    # blank segments count in the denominator
    assert got["calm"].total_segments == 2 and got["calm"].is_extremist_content is False
    stats = {r.file: r for r in rec.score_transcripts(df, fx.lexicon(spark)).collect()}
    assert stats["calm"].total_segments == 1 and stats["empty"].avg_segment_toxicity == 0.0


def test_hostile_recording_is_flagged(spark):
    df = spark.createDataFrame([transcript("bad", "IDIOT SCUM TRASH!!!", "pathetic loser moron!")], TRANSCRIPT)
    r = rec.score_recordings(df, fx.lexicon(spark)).statistics.first()
    assert r.is_extremist_content and r.result.startswith("EXTREMIST CONTENT DETECTED: 2/2 segments (100.0%).")


def test_messages(spark):
    columns = dict(extremist_segments=1, total_segments=3, toxic_segments=2, extremist_ratio=1 / 3, weighted_extremist_score=0.25,
                   avg_extremist_probability=0.5, max_toxicity=0.75, avg_toxicity=0.125)

    def message(verdict, **changes):
        values = {**columns, **changes}
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()],
                                   F.lit(verdict).cast("boolean").alias("is_extremist_content"))
        return df.select(ru.verdict_message().alias("m")).first().m

    assert message(True) == ("EXTREMIST CONTENT DETECTED: 1/3 segments (33.3%). Weighted score: 25.0%, Avg probability: 50.0%")
    assert message(False) == "Non-extremist content. 1/3 extremist segments detected (33.3%). Weighted score: 25.0%"
    assert message(None) == "2 toxic segments detected (66.7% of content). Average toxicity: 12.5%, Max: 75.0%"
    assert message(None, toxic_segments=1) == "1 toxic segment detected (33.3% of content). Max toxicity: 75.0%"
    assert message(None, toxic_segments=0) == "No toxic content detected."


def test_long_recording_continues_in_parts(spark):
    df = spark.createDataFrame([transcript("long", *[f"line {i}" for i in range(7)]), transcript("none")], TRANSCRIPT)
    scored = rec.score_recordings(df, fx.lexicon(spark))
    docs = ru.json_envelope(scored.segments, scored.statistics, ["text"], replace(DEFAULTS, segments_per_document=3)).collect()
    parts = {(r.file, r.part): json.loads(r.document) for r in docs}
    assert sorted(parts) == [("long", 0), ("long", 1), ("long", 2), ("none", 0)]
    texts = [s["text"] for p in range(3) for s in parts["long", p]["segments"]]
    assert texts == [f"line {i}" for i in range(7)]
    assert parts["none", 0]["segments"] == [] and parts["none", 0]["isExtremist"] is None


def test_large_lexicon_gives_the_same_shares(spark, small):
    docs = fx.table(spark, small, "documents").withColumn("text", F.when(F.col("doc_id") % 9 != 0, F.col("text")))
    docs = docs.select("doc_id", "text").union(docs.select(F.lit(None), "text")).union(docs.select(F.lit(1), F.lit("scum for this")))
    args = (fx.lexicon(spark), "text")
    inline = lexicon_polarity(docs, *args)
    joined = lexicon_polarity(docs, *args, settings=replace(DEFAULTS, max_inline_lexicon=3))
    columns = ["doc_id", *[F.round(c, 9).alias(c) for c in ("neg", "neu", "pos", "compound")]]
    assert inline.select(*columns).exceptAll(joined.select(*columns)).count() == 0
    assert inline.count() == joined.count() == 600
    assert joined.select(*columns).exceptAll(inline.select(*columns)).count() == 0


def test_plug_in_scorer_isolates_failures(spark):
    def make():
        def scorer(texts):
            if any("boom" in t for t in texts):
                raise ValueError("bad text")
            return [{"toxic": {"toxic": len(t) / 10}} for t in texts]
        return scorer

    df = spark.createDataFrame([(0, "abcde"), (1, "boom"), (2, " "), (3, None)], "i int, text string").coalesce(1)
    good, bad = scorer.split_errors(scorer.score_texts(df, make))
    got = {r.i: r.model_outputs.toxic for r in good.collect()}
    assert got == {0: {"toxic": 0.5}, 2: {}, 3: {}}
    assert [(r.i, r.error.error_type) for r in bad.collect()] == [(1, "ValueError")]


def test_a_text_is_scored_once_and_other_columns_stay_in_the_jvm(spark, tmp_path):
    def make():
        def count(texts):
            for t in texts:
                with open(f"{tmp_path}/calls", "a") as f:
                    f.write(t + "\n")
            return [{"toxic": {"toxic": 0.9}} for _ in texts]
        return count

    n = 50
    df = spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("text"), F.array("id").alias("error"))
    scored = scorer.score_texts(df, make)
    assert "ArrowEvalPython" in scored._jdf.queryExecution().toString()
    chosen = sc.with_classification(scored).filter("error is null AND overall_toxicity > 0.5")
    assert chosen.select("id", "is_toxic", "model_outputs").where("is_toxic").count() == n
    assert sorted((tmp_path / "calls").read_text().split()) == sorted(f"t{i}" for i in range(n))
    text = spark.createDataFrame([("a", 0, 0.0, 1.0, "one"), ("a", 1, 1.0, 2.0, "two")], "file string, seg_idx int, start_s double, end_s double, text string")
    right = spark.createDataFrame([("a", 0, 0.1, 1.1), ("a", 1, 1.1, 2.1)], "file string, seg_idx int, start_s double, end_s double")
    (tmp_path / "calls").unlink()
    assert rec.aligned_pairs(scorer.score_texts(text, make), right).count() == 2
    assert sorted((tmp_path / "calls").read_text().split()) == ["one", "two"]


def test_quality_gate_from_text(spark):
    df = spark.createDataFrame([("a", "ha " * 200), ("b", "a plain short line")], "file string, text string")
    assert [r.file for r in sg.transcript_quality_gate(df, compression_from_text=True).collect()] == ["b"]


def test_audio_slices_and_energy(spark):
    df = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(10)]).alias("x"))
    assert df.select(sp.slice_audio(F.col("x"), F.lit(-1.0), F.lit(0.35), 10).alias("y")).first().y == [0.0, 1.0, 2.0]
    short = df.select(sp.rms_energy(F.col("x"), 4, 2, 400).alias("e")).first().e
    assert (short.rms_mean, short.rms_max) == (0.0, 0.0)


def test_nonfinite_values_become_zero(spark):
    for v in (None, float("nan"), float("inf"), float("-inf")):
        assert one(spark, x=feat.finite(F.lit(v).cast("double"))).x == 0.0


def test_unknown_level_and_zero_spread(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0), (None, 2.0)], "c string, v double")
    coded = lb.one_hot(df, "c", ["a"]).collect()
    assert [r.c_a for r in coded] == [1.0, 0.0, 0.0]
    assert {r.v for r in lb.Standardizer.fit(df, ["v"]).transform(df).collect()} == {0.0}


def test_sketched_profile_agrees_on_roles(spark, small):
    docs = fx.table(spark, small, "documents")
    columns = lb.candidate_columns(docs, "label")
    assert "text" not in columns
    roles = [{r["column"]: r.role for r in lb.profile_columns(docs, docs.columns, exact=e, max_distinct=30).collect()} for e in (True, False)]
    assert roles[0] == roles[1]


def test_id_column_choice():
    assert lb.find_id_column(["x", "uuid", "a_id"]) == "uuid"
    assert lb.find_id_column(["x", "A_ID"]) == "A_ID"
    with pytest.raises(ValueError):
        lb.find_id_column(["x"])
