"""What jobs write, shuffle and read: texts once, not once per step."""

import re

from pyspark.sql import functions as F

from voxsieve.functions.text import with_text_proxies
from voxsieve.operators import lexicon as lx
from voxsieve.operators.learning import Bundle
from voxsieve.operators.rollup import json_envelope, recording_rollup
from voxsieve.plans import directory as dr, recordings as rec, training as tr
from voxsieve.registry import fixtures as fx, spark_queries
from voxsieve.settings import Settings
from voxsieve.sources.scratch import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_directory_run_writes_its_texts_once(spark, small, tmp_path, monkeypatch):
    whole = []

    def noted(df, name, *more):
        whole.extend([name] if "segments" in df.columns else [])
        return kept(df, name, *more)

    kept = dr.stored
    monkeypatch.setattr(dr, "stored", noted)
    fx.transcripts(spark, small).limit(20).select(F.to_json(F.struct("file", "text", "language", "segments"))).write.text(f"{tmp_path}/in")
    run = dr.process_directory(spark, f"{tmp_path}/in", f"{tmp_path}/out", fx.lexicon(spark), one_per_file=False, pattern="*.txt").first()
    assert (run.total, run.processed) == (20, 20) and whole == ["files"]


def test_documents_are_dealt_out_once(spark, small):
    scored = rec.score_recordings(fx.transcripts(spark, small), fx.lexicon(spark))
    assert "hashpartitioning(file#" in plan(json_envelope(scored.segments, recording_rollup(scored.segments).withColumn("x", F.lit(1)), ["text"]))
    dealt = re.findall(r"hashpartitioning\((file#\d+, [a-z]+#)", plan(json_envelope(scored.segments, scored.statistics, ["text"])))
    assert dealt == []


def test_words_are_looked_up_by_block(spark):
    df = spark.createDataFrame([(1, "good bad good x"), (2, None), (3, ""), (3, "Bad")], "id int, text string")
    words = spark.createDataFrame([("good", 2.0), ("bad", -0.5), ("x", 0.0), ("y", -1.0)], "term string, valence double")
    joined = lx.lexicon_polarity(df, words, settings=Settings(max_inline_lexicon=1))
    assert not re.search(r"hashpartitioning\(_row#\d+L?, term#", plan(joined))
    assert sorted(map(str, joined.collect())) == sorted(map(str, lx.lexicon_polarity(df, words).collect()))


def test_filling_reads_its_source_a_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def source(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 1.5).alias("x"))
    df = rows.mapInPandas(source, rows.schema).withColumn("label", F.when(F.col("id") % 5 > 0, F.col("label")))
    for group in (False, True):
        seen.value = 0
        assert tr.fill_missing_labels(df, "label", "id", group=group, evaluate=not group).rows.filter("label_filled is null").count() == 0
        assert seen.value <= 3 * 60


def test_trainings_on_the_same_texts_measure_them_once(spark, small, monkeypatch):
    measured = []

    def noted(df, *more, **named):
        measured.append(df)
        return kept(df, *more, **named)

    def fitted(df, key, names, *_):
        return Bundle(None, names, "logistic", 0.5, df.select(key, "label", F.lit(0.5).alias("score")))

    kept = tr.lexicon_polarity
    monkeypatch.setattr(tr, "lexicon_polarity", noted)
    monkeypatch.setattr(tr, "train_classifier", fitted)
    modes = spark_queries.QUERIES["train_from_labels"](spark, small).groupBy("mode").count().collect()
    assert {r["mode"] for r in modes} == {"text_only", "model"} and len(measured) == 1


def test_measured_texts_give_the_same_features(spark):
    texts = ["You IDIOT, this is trash!", "good with THIS?", "", None, "\u00a0 \n", "scum scum WORTHLESS...", "x" * 20_001]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate([*texts, texts[0]])], "row_id int, text string, label int")
    df = df.withColumn("row_id", F.when(F.col("row_id") % 3 > 0, 7))  # keys may repeat or be null
    measured = stored(tr.measured_texts(df, fx.lexicon(spark)), "measured", "zstd")
    for make in (None, fx.word_scorer):
        once, anew = (sorted(str(r) for r in rows.select("row_id", "text", "label", "features").collect()) for rows in (
            tr.text_features(measured, None, make_scorer=make), tr.text_features(df, fx.lexicon(spark), make_scorer=make)))
        assert once == anew and len(once) == len(texts) + (make is None)


def test_words_in_capitals(spark):
    texts = ["ABC", " ABC  ABc AB A1C 123 ABC", "X-RAY\tA.B.C.\nAbc", "ÄÖÜ ǅAB ABʰ 日本A 日本語", "𐐀𐐀𐐀 𐐨𐐀𐐀", "ABCABC", "", None]
    got = with_text_proxies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    assert {r.i: round(r.caps_ratio * max(1, r.num_words)) for r in got} == {0: 1, 1: 3, 2: 2, 3: 3, 4: 1, 5: 1, 6: 0, 7: 0}
