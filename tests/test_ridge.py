"""Ridge over folds against numpy, and the report of label filling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxsieve.operators.ridge import MOST_COLUMNS, Ridge, fill_report, fold_sums, ridge_out_of_fold
from voxsieve.operators.splits import kfold_assign
from voxsieve.plans.training import fill_missing_labels


def plain_fit(x, y, alpha, plain):
    scale = np.array([1.0 if p or not s else s for p, s in zip(plain, x.std(0))])
    z = (x - x.mean(0)) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda v: y.mean() + (v - x.mean(0)) / scale @ w


def test_out_of_fold_equals_fits_without_the_fold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4)) * [1, 50, 0, 1]
    x[:, 3] = rng.integers(0, 2, 120)
    y = 2 * x[:, 0] - 0.01 * x[:, 1] + x[:, 3] + rng.normal(size=120) * 0.3
    names = ["a", "b", "constant", "in.dicator"]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id int, a double, b double, constant double, `in.dicator` double, y double")
    with pytest.raises(Exception):
        ridge_out_of_fold(df, "id", names, "missing")
    df = df.withColumnRenamed("in.dicator", "flag")
    names[3] = "flag"
    out = ridge_out_of_fold(df, "id", names, "y", alpha=2.5, plain=frozenset(["flag"]))
    got = {r.id: r for r in out.collect()}
    fold = {r.id: r.fold for r in kfold_assign(df, "id", None).collect()}
    assert {i: r.fold for i, r in got.items()} == fold and len(set(fold.values())) == 5
    for f in set(fold.values()):
        train = np.array([fold[i] != f for i in range(120)])
        predict = plain_fit(x[train], y[train], 2.5, [False, False, False, True])
        for i in np.flatnonzero(~train):
            assert got[i].prediction == pytest.approx(predict(x[i]), abs=1e-8)
    report = {r.fold: r for r in fill_report(out, 0.5).collect()}
    every = np.array([got[i].prediction for i in range(120)])
    assert set(report) == {0, 1, 2, 3, 4, None} and report[None].n == 120
    assert report[None].rmse == pytest.approx(np.sqrt(((y - every) ** 2).mean()))


def test_sums_do_not_depend_on_the_partitions(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("fold"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("y"))
    a, b = (fold_sums(df.repartition(n), ["v"], "y") for n in (1, 7))
    assert set(a) == set(b) == {0, 1, 2}
    for f in a:
        np.testing.assert_array_equal(a[f], b[f])
    assert a[0][0, 0] == 17 and a[0][1, 1] == sum(i * i for i in range(0, 50, 3))
    fit = Ridge.fit(sum(a.values()), ["v"], 0.0)
    assert fit.weights == [0.0] and fit.intercept == 1.0
    with pytest.raises(ValueError, match="columns"):
        fold_sums(df, [f"c{i}" for i in range(MOST_COLUMNS + 1)], "y")


def test_report_of_grouped_filling(spark):
    rows = [(f"g{i % 40}", float(i % 40) + (i % 3), None if i % 40 in (5, 6) else int(i % 40 > 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, v double, label int")
    for kind in ("ridge", "logistic"):
        filled = fill_missing_labels(df, "label", "id", group=True, model_type=kind, evaluate=True)
        report = {r.fold: r for r in filled.report.collect()}
        assert report[None].n == 38 and report[None].roc_auc > 0.95 and sum(r.n for f, r in report.items() if f is not None) == 38
    assert fill_missing_labels(df, "label", "id", group=True).report is None
