"""Learnt operators on held-out rows, rules and scans against plain versions, and defined cases."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxsieve.llm import fertility, language, licences, neighbours, resampling, toxicity
from voxsieve.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(2)


def documents(spark, d=MEDIUM):
    return spark.read.parquet(f"{d}/documents.parquet")


# --- language ---

def test_language_on_held_out_rows(spark):
    got = QUERIES["op2_language_id"](spark, MEDIUM).join(documents(spark).select("doc_id", "lang"), "doc_id")
    assert got.count() == documents(spark).count()
    right, n = got.filter("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_defined_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", "de")]
    docs = frame(spark, rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, language.fit(docs)).collect()}
    assert got[1][0] == "en" and got[2][0] == "de"
    assert [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    none = docs.filter("false")
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(none, language.fit(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 9, 30])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert code.shape[0] == n
    if n > 2:
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= 2


def test_a_wrong_bit_is_corrected():
    code = language.codewords(4)
    model = language.CodeModel(list("abcd"), code, np.zeros((1, 7)), np.ones(7), np.zeros(7), np.ones(7))
    for k in range(4):
        for flipped in range(7):
            margins = np.where(code[k], 4.0, -4.0)
            margins[flipped] *= -1
            best, _, close = model.decode(margins[None])
            assert best[0] == k
    assert model.decode(np.zeros((1, 7)))[2][0]  # nothing to tell: ambiguous


# --- toxicity ---

def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, MEDIUM)
    assert got.count() == documents(spark).count()
    joined = got.join(labels, "doc_id").filter("held_out")
    hit, toxic, wrong, clean = joined.agg(
        F.sum((F.col("toxic") * F.col("predicted"))), F.sum("toxic"),
        F.sum((1 - F.col("toxic")) * F.col("predicted")), F.sum(1 - F.col("toxic"))).first()
    assert hit / toxic > 0.5 and wrong / clean < 0.08


def test_toxicity_defined_cases(spark):
    rows = [(1, "you idiot moron scum"), (2, "a quiet day by the lake"), (3, None), (4, "")]
    docs = frame(spark, rows, "id long, text string")
    model = toxicity.train(docs, frame(spark, [], "id long, toxic int"))
    got = {r["id"]: r for r in toxicity.predict(docs.withColumn("predicted", F.lit(9)), model).collect()}
    assert got[1]["score"] > got[2]["score"] and got[3]["score"] == got[4]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.predict(docs.filter("false"), model).count() == 0
    untrained = toxicity.train(docs.filter("false"), frame(spark, [(1, None), (None, 1)], "id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.predict(docs, untrained).collect())


def test_toxicity_of_long_and_repeated_texts(spark):
    """The classifier over votes and words, from labels: repeated rows score alike, the end of a long text counts."""
    calm, rude = "a quiet day by the lake with friends", "you idiot moron scum that nobody wants"
    docs = frame(spark, [(i, f"{rude if i % 3 == 0 else calm} number {i % 7}") for i in range(300)], "id long, text string")
    labels = docs.select("id", (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    assert len(model.on_votes) == 2 * (toxicity.N_SEED + toxicity.VOTERS)
    long = "calm water " * 20_000
    rows = [(1, rude, 5.0), (1, rude, 5.0), (2, calm, 5.0), (3, long, 5.0), (4, f"{long}you idiot moron scum", 5.0)]
    got = toxicity.predict(frame(spark, rows, "id long, text string, score double"), model).collect()
    by = {r["id"]: r["score"] for r in got}
    assert len(got) == 5 and len({r["score"] for r in got if r["id"] == 1}) == 1
    assert by[1] > 0.3 > by[2] and by[4] > by[3]


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    good = [np.where(rng.random(len(y)) < 0.9, y, rng.random(len(y)) < 0.05) for _ in range(3)]
    noise = rng.random(len(y)) < 0.3
    twin = good[0] ^ (rng.random(len(y)) < 0.005)
    votes = np.stack([*good, noise, twin], 1).astype(float)
    model = toxicity.label_model(len(y), votes.sum(0), votes.T @ votes)
    gap = model.on_toxic - model.on_clean
    assert min(gap[:3]) > 0.5 > gap[3]
    assert model.weight[0] < model.weight[1]  # a voter with a twin counts for less
    p = model.posterior(np.where(votes > 0, 1, -1))
    assert ((p > 0.5) == y).mean() > 0.95


# --- quality ---

def test_resampling_of_empty_texts_only(spark):
    docs = frame(spark, [(1, ""), (2, None), (3, " ")], "id long, text string")
    got = resampling.resample(docs, docs.filter("id = 1"), 1.0, key="id").collect()
    assert [r["log_weight"] for r in got] == [0.0] * 3 and all(r["sampled"] for r in got)


def test_resampling_takes_k_and_prefers_good_texts(spark):
    got = QUERIES["op6_quality_classifier"](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    n, taken = got.agg(F.count("*"), F.sum(F.col("sampled").cast("int"))).first()
    assert n == documents(spark).count()
    assert taken == round(labels.agg(F.avg("quality")).first()[0] * n)
    low = got.filter("sampled").agg(F.min("gumbel_key")).first()[0]
    assert got.filter("NOT sampled").agg(F.max("gumbel_key")).first()[0] < low
    mean = {r["quality"]: r["w"] for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg("log_weight").alias("w")).collect()}
    assert mean[1] > mean[0]


def test_resampling_defined_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "good words here"), (3, "good words here")], "id long, text string")
    none = frame(spark, [], "text string")
    got = resampling.resample(docs, none, 0.5, key="id").collect()
    assert {r["log_weight"] for r in got} == {0.0} and len(got) == 4
    assert resampling.resample(docs.filter("false"), none, 0.5, key="id").count() == 0
    assert resampling.marked(docs, frame(spark, [(3, 1), (None, 1), (1, 0)], "id long, good int")).count() == 2


@pytest.mark.parametrize("k", [1, 7, 50, 99, 100])
def test_kth_largest(spark, k):
    values = [float(i % 40) ** 3 - 5 for i in range(100)]
    assert resampling.kth_largest(frame(spark, [(v,) for v in values], "v double"), "v", k) == sorted(values)[-k]


def plain_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(three)
    inside = {k + d for k, x in enumerate(three) if n[x] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_quality_rules_equal_plain_version(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents(spark).limit(200).collect()]
    rows += [(-1, None, None), (-2, "", None), (-3, "a b c a b c é\n\na b c a b c é", "x"), (-4, "слово " * 70, None), (-5, "w " * 9000, "en")]
    df = frame(spark, rows, "doc_id long, text string, lang string").withColumn("band", F.lit(1))
    got = {r["doc_id"]: r for r in fertility.quality_rules(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_rules(t)
        assert not (r["base_failed"] and r["kept"]) and r["band"] == 1
    assert got[-1]["chars_per_token"] is None and got[-4]["script"] == "cyrillic"


def test_quality_rules_reject_noise_and_keep_good_texts(spark):
    got = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.1").filter("NOT base_failed").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    kept = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.99 and kept[0] < kept[1] - 0.2


def test_quality_rules_of_no_rows(spark):
    none = frame(spark, [], "doc_id long, text string, lang string")
    assert fertility.quality_rules(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# --- licences ---

def plain_places(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    found = sorted((k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
    return (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})))


def test_licence_places_equal_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows += [(-1, None), (-2, ""), (-3, "The MIT License. MIT  license; GNU General Public License, CC-BY cc by"), (-4, "gnu general public public license"),
             (-5, licences.TEMPLATES["apache-2.0-notice"]), (-6, ("filler " * 3000) + licences.TEMPLATES["mit-text"] + " end"), (-7, "Apache License " * 500)]
    df = frame(spark, [(i, t, 0) for i, t in rows], "doc_id long, text string, labels int")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_places(t), i
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[-5]["labels"] == "apache,apache-2.0-notice" and got[-5]["score"] == 1.0
    span = next(s for s in got[-6]["spans"] if s["template"] == "mit-text")
    assert span["first"] == 3000 and span["share"] == 1.0
    assert licences.scan(df.filter("false")).count() == 0


def plain_chain(matches):
    """Words of the best chain, looking back at all matches."""
    matches, best = sorted(set(matches)), []
    for i, (at, start, n) in enumerate(matches):
        before = [0]
        for j, (p, q, m) in enumerate(matches[:i]):
            over = max(0, p + m - at, q + m - start)
            if p < at and q < start and over < n and at - p <= 4 * (start - q) + 20:
                before.append(best[j] - over)
        best.append(n + max(before))
    return max(best)


def test_chains_equal_plain_version():
    rng = np.random.default_rng(6)
    for _ in range(50):
        matches = [(int(rng.integers(0, 900)), int(rng.integers(0, 60)), int(rng.integers(4, 12))) for _ in range(80)]
        links = licences.chain(matches)
        words = sum(n for _, _, n in links) - sum(
            max(0, p + m - at, q + m - start) for (p, q, m), (at, start, _) in zip(links, links[1:]))
        assert words == plain_chain(matches)


def test_long_file_of_many_notices(spark):
    text = " filler ".join([licences.TEMPLATES["bsd-text"]] * 3000)
    row = licences.scan(frame(spark, [(1, text), (1, text)], "doc_id long, text string")).collect()
    assert len(row) == 2 and row[0] == row[1]  # repeated rows stay
    assert row[0]["labels"] == "bsd-text" and row[0]["score"] == 1.0


def test_every_place_of_a_run_in_a_template():
    a = licences.automaton()
    t = list(licences.TEMPLATES).index("bsd-text")
    words = licences._tokens(licences.TEMPLATES["bsd-text"])
    run = licences._tokens("this list of conditions and the following disclaimer")
    names = list(dict.fromkeys(w for r in [*licences.TEMPLATES.values(), *licences.PHRASES] for w in licences._tokens(r)))
    *_, (_, state, size) = licences.stream(a, [names.index(w) for w in run])
    assert size == len(run)
    want = [k + size for k in range(len(words)) if words[k:k + size] == run]
    assert a.ends[state][t] == want and len(want) == 2


def test_matching_statistics_equal_plain_version():
    a = licences.automaton()
    runs = [licences._tokens(t) for t in licences.TEMPLATES.values()] + [p.split() for p in licences.PHRASES]
    every = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, min(len(r), i + 30) + 1)}
    rng = np.random.default_rng(5)
    names = list(dict.fromkeys(w for r in runs for w in r))
    text = []
    for _ in range(40):
        r = runs[rng.integers(len(runs))]
        i = rng.integers(len(r))
        text += r[i:i + rng.integers(1, 12)]
    ids = [names.index(w) for w in text]
    for k, _, size in licences.stream(a, ids):
        want = max((n for n in range(1, 31) if tuple(text[max(0, k + 1 - n):k + 1]) in every and n <= k + 1), default=0)
        assert min(size, 30) == want


# --- embeddings ---

def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * 0.08 * (i % 5)).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 3), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, rows[7][1]), (1006, [1e200] + [0.0] * 15)]
    df = frame(spark, [(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(df, cosine=0.95).collect()}
    good = [(i, np.array(v)) for i, v in rows if i not in range(1000, 1005)]
    unit = np.array([v / np.abs(v).max() for _, v in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    want = near.sum(1)
    found = np.array([got[i]["n_links"] for i, _ in good])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(1000, 1005))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert len(got) == len(rows)
    assert neighbours.near_duplicates(df.filter("false")).count() == 0
    assert neighbours.near_duplicates(df.filter("vec_id = 1000")).count() == 1


def test_rows_with_equal_and_null_ids_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 16)).tolist()
    rows = [(5, base[0]), (5, base[1]), (200, base[0]), (201, base[1]), (None, base[1]), (None, base[2])]
    got = sorted(map(tuple, neighbours.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(5, 1, 5, True), (5, 2, 5, True), (200, 1, 5, False), (201, 2, 5, False), (None, 2, 5, False),
                          (None, 0, None, False)], key=repr)


def test_forest():
    pairs = np.array([(3, 4), (4, 5), (0, 7)])
    from voxsieve.llm.jaccard import forest
    assert forest(8, pairs).tolist() == [0, 1, 2, 3, 3, 3, 6, 0]
