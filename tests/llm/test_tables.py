"""Exact top-k search, resampling to a target and the Merkle manifest against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxsieve.llm import impacts, manifest, targeting


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- exact top-k search

def plain_top_k(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(fine):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(fine) if b != a)[:k]
        out += [(i, rank + 1, None if unnamed else j, -s) for rank, (s, unnamed, j) in enumerate(scored)]
    return sorted(out, key=repr)


VECTORS = [
    (None, [0.5] * 64), (50, [0.5] * 64), (50, [0.5] * 64), (100, None), (150, [float("nan")] * 64), (200, [None, 1.0]),
    (250, []), (300, [-1.5, 2.0]), (-50, [0.25] * 64), (7, [float("inf")]), (8, [0.0] * 64), (350, [0.0] * 64)]


@pytest.mark.parametrize("block, group", [(8192, 512), (40, 3)])
def test_top_k_equals_brute_force(spark, small, monkeypatch, block, group):
    monkeypatch.setattr(impacts, "BLOCK", block)
    monkeypatch.setattr(impacts, "GROUP", group)
    given = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame(VECTORS, given.schema)
    asks = F.col("vec_id") % 50 == 0
    for df in (given.union(odd), odd, given.limit(0), odd.filter("size(embedding) = 0")):
        # other columns may have the names that are used inside
        named = df.withColumns({"id": F.lit("x"), "number": F.lit(1), "score": F.lit(None), "block": F.lit(0)})
        assert rows_of(impacts.top_k(named, asks)) == plain_top_k([tuple(r) for r in df.collect()])


def test_copies_of_one_vector(spark):
    """Ties go to the smaller ids, however many copies there are."""
    rng = np.random.default_rng(3)
    v, far = rng.normal(size=8).tolist(), (-rng.normal(size=8)).tolist()
    rows = [(i, v) for i in range(1, 90)] + [(100, v), (101, far)]
    got = impacts.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 100)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_search_stops_early_on_proof_and_is_exact():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16)) * 200
    matrix = np.floor(centres[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 16)) * 4).astype(np.int64)
    index = impacts.Index.of(matrix)
    early = 0
    for q in range(0, 3000, 100):
        at, scores = index.search(matrix[q], 6)
        early += len(at) < len(matrix)
        truth = matrix @ matrix[q]
        assert (scores == truth[at]).all()
        won = impacts.best(at, at, scores, 6)
        assert at[won].tolist() == np.lexsort((np.arange(3000), -truth))[:6].tolist()
    assert early > 10


def test_scores_that_would_not_be_exact_are_refused(spark):
    with pytest.raises(ValueError, match="exact"):
        impacts.top_k(spark.createDataFrame([(50, [1e9])], "vec_id long, embedding array<float>"), F.lit(True))


# --- resampling to a target

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain_features(text):
    w = re.findall(targeting.WORD, (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampling(docs, target):
    raw, wanted, kept = [0] * 10000, [0] * 10000, []
    for i, text in docs:
        n, found = plain_features(text)
        kept.append((i, n, [f % 10000 for f in found]))
        for f in kept[-1][2]:
            raw[f] += 1
    for text in target:
        for f in plain_features(text)[1]:
            wanted[f % 10000] += 1
    s, t = sum(raw), sum(wanted)
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for i, n, found in kept:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long_enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for place, r in enumerate(long_enough[:5 * len(long_enough) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


TEXTS = [
    (None, None), (None, ""), (5, "A b éİz x" * 40), (5, "A b éİz x" * 40), (9, "q" * 3000 + " " + "é" * 700),
    (8, "a,b  c\x00d  e " * 30), (7, "... !!"), (6, "one"), (6, "one two"), (None, "no id here " * 30),
    *[(k, "same words here " * 10) for k in range(60)], (70, "word " * 40000), (71, "x" * 60000)]


def test_resampling_equals_plain_version(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{small}/benchmark.parquet").select("text")
    odd = spark.createDataFrame(TEXTS, given.schema)
    for docs, aim in ((given.union(odd), target), (odd, target.limit(0)), (given.limit(0), target)):
        named = docs.withColumns({"id": F.lit("x"), "buckets": F.lit(b"y"), "score": F.lit(1), "pos": F.lit(1)})
        expected = plain_resampling([tuple(r) for r in docs.collect()], [r["text"] for r in aim.collect()])
        assert rows_of(targeting.resample_to_target(named, aim)) == expected


def test_draw_without_documents_that_are_long_enough(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    assert {r["rank"] for r in targeting.resample_to_target(docs, docs).collect()} == {None}


def test_crc_of_windows():
    words = ["a", "é", "word" * 500, "x", "", "tail"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    lengths = np.array([len(w.encode()) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    crc = targeting.crc_of_spans(data, starts, lengths)
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in words]
    assert (targeting.carry(crc[:-1], lengths[1:]) ^ crc[1:]).tolist() == [
        zlib.crc32((a + b).encode()) for a, b in zip(words, words[1:])]


def test_buckets_keep_rows_apart():
    texts = ["a b c d", "", "e", "f G", ".. h"]
    buckets, n, counts = targeting.feature_buckets(pa.array(texts))
    ends = np.cumsum(n)
    assert counts.tolist() == [4, 0, 1, 2, 1] and n.tolist() == [9, 0, 1, 3, 1]
    for text, begin, end in zip(texts, ends - n, ends):
        assert sorted(buckets[begin:end]) == sorted(f % 10000 for f in plain_features(text)[1])


# --- Merkle manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = [plain_tree([plain_leaf(r) for r in groups[s]]) for s in order]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[g], i) + siblings(top, g)
            h = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                h = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                h = sha(left, h, right)
            root = top[-1][0]
            out.append((r[0], plain_leaf(r), trees[g][-1][0], root, sha(*[a + b for a, b in path]), h, h == root))
    return sorted(out, key=repr)


ROWS = [
    (None, None, None, None, None), (None, None, None, None, None), (5, "", "x", 3, "a\nb"), (5, "", "x", 3, "a\nb"),
    (5, None, "x", 3, ""), (7, "é", "x", None, "\n\n"), (8, "é", "x", 1, "long text\n" * 20000)]


def tampered():
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def test_manifest_equals_plain_version(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet").select(*FIELDS)
    odd = spark.createDataFrame(ROWS, given.schema)
    many = spark.range(800).select(  # more than one round of windows, one group with nearly all rows
        F.col("id").alias("doc_id"), F.when(F.col("id") < 790, "hot").otherwise(F.col("id").cast("string")).alias("source"),
        F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("a\nb").alias("text"))
    for docs in (given.union(odd), many, odd.limit(1), given.limit(0)):
        named = docs.withColumns({"key": F.lit(1), "pos": F.lit(2), "n": F.lit(3), "path": F.lit(4), "h": F.lit(5)})
        got = manifest.manifest(named, "source", "doc_id", FIELDS, tampered())
        assert rows_of(got) == plain_manifest([tuple(r) for r in docs.collect()])


def test_untouched_table_verifies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = manifest.manifest(docs, "source", "doc_id", FIELDS)
    assert got.filter("NOT verified").isEmpty() and got.count() == docs.count()
