"""Fitted models: shape, sanity bounds, determinism of splits, saved bundles."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxsieve.operators import learning as ml, metrics as mt, splits
from voxsieve.plans import training as tr
from voxsieve.registry import fixtures as fx
from voxsieve.settings import DEFAULTS

FAST = replace(DEFAULTS, forest_trees=10, forest_depth=4, boosted_rounds=3, boosted_depth=3)


@pytest.fixture(scope="module")
def vectors(spark, small):
    df, names = fx.feature_vectors(spark, small)
    return df.select("vec_id", "label", *names[:6]), names[:6]


@pytest.mark.parametrize("kind", ml.MODEL_TYPES)
def test_models_rank_well(spark, vectors, kind):
    df, names = vectors
    model = ml.TRAINERS[kind](df, names, "label", FAST)
    assert mt.roc_auc(ml.with_probability(model, df), "score", "label").first().roc_auc > 0.9
    if kind != "logistic":
        assert ml.top_features(model, names, 2).first().feature in ("d00", "d01")


def test_forest_in_parts(spark, vectors, tmp_path):
    df, names = vectors
    df = df.unionByName(df.filter("vec_id < 20"))  # a row that comes twice is scored twice
    few = replace(FAST, rows_of_fit=1600)  # 520 rows: three trees a fit
    model = ml.train_forest(df, names, "label", few)
    assert model.trees == [3, 3, 3, 1]
    parts = [model.part(i) for i in range(4)]
    assert [p.getNumTrees for p in parts] == model.trees and len({p.trees[0].toDebugString.split("\n", 1)[1] for p in parts}) == 4
    scored = ml.with_probability(model, df)
    assert scored.columns == [*df.columns, "score"] and scored.drop("score").exceptAll(df).count() == 0 and scored.count() == 520
    assert mt.roc_auc(scored, "score", "label").first().roc_auc > 0.9
    assert ml.top_features(model, names, 2).first().feature in ("d00", "d01") and sum(model.importances) == pytest.approx(1)
    row = model.prepared.transform(df.filter("vec_id = 7")).first()
    wanted = sum(p.predictRaw(row.vector)[1] for p in parts) / 10  # the mean of all trees
    assert [r.score for r in scored.filter("vec_id = 7").collect()] == [pytest.approx(wanted)] * 2

    bundle = ml.train_classifier(df, "vec_id", names, settings=few)
    assert len(bundle.model.trees) > 1 and bundle.validation.count() == 104
    bundle.save(str(tmp_path / "m"))
    again = ml.Bundle.load(str(tmp_path / "m"))
    assert again.model.path != bundle.model.path and again.threshold == bundle.threshold
    assert bundle.predict(df).exceptAll(again.predict(df)).count() == 0


def test_boosting_takes_more_than_one_task(spark, monkeypatch):
    df = spark.range(0, 9000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    tasks, fit = [], ml._fit
    monkeypatch.setattr(ml, "_fit", lambda rows, *a: tasks.append(rows.rdd.getNumPartitions()) or fit(rows, *a))
    model = ml.train_boosted(df, ["a"], "label", FAST)
    assert 1 < tasks[0] <= 5 and ml.with_probability(model, df).filter("(score > 0.5) <> (label = 1)").count() == 0
    ml.train_boosted(df.filter("id < 100"), ["a"], "label", FAST)
    assert tasks[1] == 1


def test_small_forest_is_one_fit(vectors):
    df, names = vectors
    assert ml.train_forest(df, names, "label", FAST).stages[-1].getNumTrees == 10


def test_bundle_round_trip(spark, vectors, tmp_path):
    df, names = vectors
    bundle = ml.train_classifier(df, "vec_id", names, model_type="logistic")
    bundle.save(str(tmp_path / "m"))
    again = ml.Bundle.load(str(tmp_path / "m"))
    assert (again.names, again.model_type, again.threshold) == (names, "logistic", bundle.threshold)
    assert bundle.predict(df).exceptAll(again.predict(df)).count() == 0
    assert bundle.validation.count() == 100


def test_tiny_data_train_without_a_holdout(spark, vectors):
    df, names = vectors
    tiny = df.orderBy("vec_id").limit(5)
    assert ml.small_data_guard(tiny)
    assert ml.train_classifier(tiny, "vec_id", names, model_type="random_forest", settings=FAST).validation.count() == 5


def test_split_keeps_shares_and_repeats(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    parts = splits.stratified_split(df, "id", "y")
    counts = {(r.y, r.part): r["count"] for r in parts.groupBy("y", "part").count().collect()}
    assert counts == {(0, "train"): 720, (0, "validation"): 180, (1, "train"): 80, (1, "validation"): 20}
    assert parts.exceptAll(splits.stratified_split(df.repartition(3), "id", "y")).count() == 0


def test_ranking_metrics_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12) / 12, int(rng.random() < 0.4)) for _ in range(150)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(mt.roc_auc(df, "s", "y").first().roc_auc - auc) < 1e-12

    def fbeta(t):
        tp, fp, fn = sum(p >= t for p in pos), sum(n >= t for n in neg), sum(p < t for p in pos)
        return 5 * tp / (5 * tp + 4 * fn + fp) if tp + fn + fp else 0.0

    best = max(sorted({s for s, _ in rows} | {round(0.05 * i, 2) for i in range(1, 20)}), key=fbeta)
    got = mt.threshold_sweep(df, "s", "y").first()
    assert abs(got.threshold - best) < 1e-12 and abs(got.fbeta - fbeta(best)) < 1e-12


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(0.3, 1), (0.4, 1)], "s double, y int")
    assert mt.roc_auc(df, "s", "y").first().roc_auc is None
    assert mt.average_precision(df, "s", "y").first().average_precision == 1.0


def test_prevalence_edges(spark):
    df = spark.createDataFrame([(0.3, 1), (0.4, 1)], "s double, y int")
    assert mt.prevalence_threshold(df, "s", "y").first().threshold == 0.01
    assert mt.prevalence_threshold(df.withColumn("y", F.lit(0)), "s", "y").first().threshold == 0.99
    assert mt.prevalence_threshold(df, "s", "y", match=False).first().threshold == 0.5


def test_fill_by_group_with_both_models(spark, small):
    df = fx.annotations(spark, small).select("comment_id", "note_id", "rating", "k", "label")
    for kind in ("logistic", "ridge"):
        filled = tr.fill_missing_labels(df, "label", "comment_id", group=True, model_type=kind, columns=["rating", "k"])
        assert filled.numeric == ["rating", "k"]
        out = filled.rows
        assert out.count() == df.count() and out.filter("label_filled is null").count() == 0
        assert out.filter("label is not null and label <> label_filled").count() == 0


def test_fill_rows_uses_categories(spark, small):
    filled = tr.fill_missing_labels(fx.labeled(spark, small), "label", "row_id", model_type="ridge")
    assert set(filled.categorical) == {"lang", "source"} and "num_words" in filled.numeric
    assert filled.rows.filter("label_filled is null").count() == 0
    assert filled.rows.count() == 200


def test_cross_validation_covers_every_row_once(spark, vectors):
    df, names = vectors
    oof = ml.cross_validate(df, "vec_id", names, "label", ml.train_logistic, replace(DEFAULTS, folds=2))
    assert oof.count() == oof.select("vec_id").distinct().count() == 500
    report = mt.fold_report(oof).collect()
    assert len(report) == 2 and all(r.roc_auc > 0.9 for r in report)


def test_fill_survives_missing_and_unreadable_values(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        y = i % 2
        label = None if i % 5 == 0 else "junk" if i % 31 == 0 else ("yes" if y else "no")
        x = float("nan") if i % 7 == 0 else None if i % 11 == 0 else y + rng.random()
        rows.append((i, label, x, None))
    df = spark.createDataFrame(rows, "row_id int, label string, x double, hollow double")
    filled = tr.fill_missing_labels(df, "label", "row_id", match_prevalence=True)
    out = {r.row_id: r for r in filled.rows.collect()}
    assert len(out) == 120 and out[31].label_filled == "junk"
    assert {out[i].label_filled for i in range(0, 120, 5)} == {"0", "1"}
    right = [out[i].pred == i % 2 for i in range(120) if i % 7 and i % 11]
    assert sum(right) / len(right) > 0.9
    assert out[0].x != out[0].x and out[11].x is None  # source values come back unchanged
