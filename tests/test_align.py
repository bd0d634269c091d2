import random

from voxsieve.operators.align import align_nearest, align_positional, compare_versions
from voxsieve.settings import Settings


def brute(left, right, tolerance):
    out = set()
    for f, i, m in left:
        best = None
        for g, j, q in sorted(right, key=lambda row: row[1]):
            if g == f and abs(m - q) < tolerance and (best is None or abs(m - q) < best[0]):
                best = (abs(m - q), j)
        if best:
            out.add((f, i, best[1]))
    return out


def check(spark, left, right, tolerance=0.5):
    a = spark.createDataFrame(left, "file string, left_idx int, mid double")
    b = spark.createDataFrame(right, "file string, right_idx int, right_mid double")
    got = {(r.file, r.left_idx, r.right_idx) for r in align_nearest(a, b, tolerance=tolerance).collect()}
    assert got == brute(left, right, tolerance)


def test_nearest_random_with_a_hot_file(spark):
    rng = random.Random(11)
    def rows(n):
        out, used = [], {}
        for _ in range(n):
            f = "hot" if rng.random() < 0.6 else f"f{rng.randrange(6)}"
            used[f] = used.get(f, -1) + 1
            out.append((f, used[f], rng.randrange(400) / 8))
        return out
    check(spark, rows(300), rows(200))


def test_nearest_far_neighbours_in_other_slices(spark):
    left = [("a", i, 100.0 + i) for i in range(60)]
    right = [("a", 0, 0.0), ("a", 1, 130.0), ("a", 2, 500.0)]
    check(spark, left, right, tolerance=1000.0)


def test_nearest_ties_prefer_the_earlier_row(spark):
    left = [("a", 0, 10.0), ("a", 1, 20.0)]
    right = [("a", 5, 10.25), ("a", 2, 9.75), ("a", 7, 20.0), ("a", 3, 20.0)]
    check(spark, left, right)


def test_tolerance_is_strict(spark):
    check(spark, [("a", 0, 1.0), ("b", 0, 1.0)], [("a", 0, 1.5), ("b", 0, 1.375)])


def test_positional_shift(spark):
    left = spark.createDataFrame([("a", i) for i in range(5)], "file string, seg_idx int")
    right = spark.createDataFrame([("a", i, i * 10) for i in (0, 2, 4)], "file string, seg_idx int, payload int")
    got = {r.seg_idx: (r.has_acoustic, r.payload) for r in
           align_positional(left, right, settings=Settings(rows_per_slice=2)).collect()}
    assert got == {0: (True, 0), 1: (True, 20), 2: (True, 40), 3: (False, None), 4: (False, None)}


def test_compare_versions_without_missing_rows(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "id int, label int, filled int, pred int")
    r = compare_versions(df, df, "id", "label", "filled", "pred").first()
    assert (r.n_rows, r.match_percent) == (0, 0.0)
