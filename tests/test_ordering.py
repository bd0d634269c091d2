"""Sliced running sums, ranks and quantiles against brute force, with hot keys and tiny slices."""

import random

import numpy as np
from pyspark.sql import functions as F

from voxsieve.operators.contour import contour_summary
from voxsieve.operators.ordering import (
    exact_quantiles, global_row_number, index_slices, row_numbers, running_sums, with_quantile_slices)
from voxsieve.operators.segments import segment_timeline
from voxsieve.settings import Settings

TINY = Settings(rows_per_slice=3)


def hot_rows(n=400):
    """One key holds most rows."""
    rng = random.Random(5)
    rows, used = [], {}
    for _ in range(n):
        k = "hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}"
        used[k] = used.get(k, -1) + 1
        rows.append((k, used[k], float(rng.randrange(50)) / 4))
    return rows


def test_running_sums_across_slices(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, i int, v double")
    for descending in (False, True):
        order = F.col("i").desc() if descending else F.col("i")
        out = running_sums(df.withColumn("s", index_slices(F.col("i"), 7)), ["k"], "s", [order], {"t": F.col("v")}, descending)
        for r in out.collect():
            same = [v for k, i, v in rows if k == r.k and (i >= r.i if descending else i <= r.i)]
            assert abs(r.t - sum(same)) < 1e-9


def test_running_sums_deal_rows_out_once(spark):
    """Also where nothing is broadcast; null keys are a group and null slices come first."""
    rows = [(k, s, i, float(i)) for i, (k, s) in enumerate((k, s) for k in ("a", None) for s in (None, 0, 0, 2))]
    df = spark.createDataFrame(rows, "k string, s int, i int, v double")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = running_sums(df, ["k"], "s", [F.col("i")], {"t": F.col("v")}, totals=True)
        assert out.columns == ["k", "s", "i", "v", "t_total", "t"]
        plan = out._jdf.queryExecution().executedPlan().toString()
        # of the rows one, of the totals of slices three
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning") == 4
        found = {r.i: (r.t, r.t_total) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert found == {i: (sum(range(i // 4 * 4, i + 1)), 6.0 if i < 4 else 22.0) for i in range(8)}


def test_row_numbers_restart_per_key(spark):
    df = spark.createDataFrame(hot_rows(), "k string, i int, v double")
    out = row_numbers(df.withColumn("s", index_slices(F.col("i"), 5)), ["k"], "s", [F.col("i")], "rn")
    assert all(r.rn == r.i + 1 for r in out.collect())


def test_quantile_slices_share_the_rows(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    sizes = [r["count"] for r in with_quantile_slices(df, "x", slices=8).groupBy("slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200


def test_global_row_number_is_dense(spark):
    df = spark.range(0, 5000, 7)
    out = global_row_number(df, "id").orderBy("id").collect()
    assert [r.rn for r in out] == list(range(1, len(out) + 1))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=501), np.round(rng.normal(size=501), 1)
    rows = [(float(x), float(y) if i % 10 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r["column"]: r["quantile"] for r in exact_quantiles(df, {"a": 0.37, "b": 0.5}).collect()}
    assert abs(got["a"] - np.quantile(a, 0.37)) < 1e-12
    assert abs(got["b"] - np.quantile([y for _, y in rows if y is not None], 0.5)) < 1e-12


def test_constant_column_quantile(spark):
    df = spark.range(9).select(F.lit(2.5).alias("x"))
    assert exact_quantiles(df, {"x": 0.5}).first()["quantile"] == 2.5


def test_contour_matches_numpy(spark):
    rng = np.random.default_rng(1)
    series = {"a": list(rng.normal(200, 20, 80)), "b": [150.0], "c": [float("nan")] * 4,
              "d": [float(x) if i % 3 else float("nan") for i, x in enumerate(rng.normal(100, 9, 61))]}
    rows = [(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    for settings in (TINY, Settings()):
        got = {r.k: r for r in contour_summary(df, "k", "i", "v", settings).collect()}
        for k, vs in series.items():
            v = np.array([x for x in vs if not np.isnan(x)])
            want = [0.0] * 7 if len(v) == 0 else [
                v.mean(), v.std(), v.min(), v.max(), v.max() - v.min(),
                np.polyfit(np.arange(len(v)), v, 1)[0] if len(v) > 1 else 0.0, v[-25:].mean()]
            have = [got[k][c] for c in ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_range", "f0_slope", "f0_final")]
            np.testing.assert_allclose(have, want, atol=1e-8)


def test_timeline_is_gapless(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "file string, seg_idx int, duration double")
    out = sorted((r.file, r.seg_idx, r.start_s, r.end_s) for r in segment_timeline(df, settings=TINY).collect())
    for (f1, _, _, end), (f2, _, start, _) in zip(out, out[1:]):
        assert (abs(end - start) < 1e-9) if f1 == f2 else abs(start) < 1e-9
