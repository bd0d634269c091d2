"""Packing, encoding, line dedup and the Jaccard join against plain versions of themselves."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxsieve.llm import bpe, jaccard, lines, packing
from voxsieve.llm.texts import Table

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a", "it's we'll 'sam ''s !'s", "<|endoftext|>hi<|startoftext|>", "İstanbul ΑΣΣΟΣ é 日本語 😀 12³½",
       "x" * 5000, "word " * 6000, "don't 'tis I'd", "Привет мир’s “q” …", "a\x1cb\x85c\xa0d", "same text", "same text"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_table_keeps_what_was_put():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    t = Table(16)
    for part in np.array_split(keys, 7):
        t.put(part, np.searchsorted(keys, part))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert (t.get(keys + np.uint64(1)) < len(keys)).all()


def test_encoding_equals_the_library(spark, small, library):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    df = frame(spark, [(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, n_tokens int")
    got = {r["doc_id"]: r for r in bpe.encode(df, PATH, decoded=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["token_bytes"], "<u4").tolist() == ids, t
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_a_worker_that_forgets_encodes_alike(monkeypatch, library):
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    coder = bpe.Bpe(PATH)
    for texts in (["alpha beta gamma delta epsilon zeta eta theta 日本語"], ["iota kappa é lambda mu nu xi omicron pi rho alpha"]):
        ids, _ = coder.encode(texts)
        assert ids.tolist() == library.encode(texts[0], add_special_tokens=False).ids


def test_empty_tables(spark):
    none = frame(spark, [], "doc_id long, text string")
    assert bpe.encode(none, PATH).count() == 0
    assert packing.pack(packing.token_pieces(none, PATH)).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0


def test_pieces_are_gapless_and_whole(spark, library):
    df = frame(spark, [(i, t, 3) for i, t in enumerate(ODD)] + [(None, "no id", 3)], "doc_id long, text string, offset int")
    rows = packing.pack(packing.token_pieces(df, PATH)).collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= packing.CAPACITY
    for i, t in enumerate(ODD):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        cut = [ids[k:k + 4096] for k in range(0, len(ids), 4096)]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert own == [(k, 4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)]


def test_packing_in_rounds_keeps_every_piece(spark):
    rng = random.Random(4)
    df = frame(spark, [(i, rng.randint(1, 4096)) for i in range(600)], "doc_id long, length long")
    rows = packing.pack(df, group=50).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096
    assert len(fill) <= 1.1 * sum(fill.values()) / 4096


def test_local_search_saves_a_bin():
    """Two bins of 6 + 3 and 5 + 4 + ... where best fit needs one more than necessary."""
    sizes = np.array([4, 4, 4, 3, 3, 3, 3])
    bins = packing.Bins(sizes, 12)
    bins.best_fit()
    bins.improve()
    used = [b for b in bins.items if b]
    assert sorted(i for b in used for i in b) == list(range(7))
    assert len(used) == 2
    for seed in range(20):
        sizes = np.random.default_rng(seed).integers(1, 60, 80)
        bins = packing.Bins(sizes, 100)
        bins.best_fit()
        before, squares = len(bins.items), sum(f * f for f in bins.fill)
        bins.improve()
        assert sum(f > 0 for f in bins.fill) <= before
        assert sum(f * f for f in bins.fill) >= squares
        for items, f in zip(bins.items, bins.fill, strict=True):
            assert sizes[items].sum() == f <= 100


def fewest_bins(sizes, capacity):
    """By dynamic programming over all subsets: (bins, least fill of the last one)."""
    best = [(1, 0)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for held in range(1, 1 << len(sizes)):
        for i, size in enumerate(sizes):
            if held >> i & 1:
                n, fill = best[held ^ 1 << i]
                best[held] = min(best[held], (n, fill + size) if fill + size <= capacity else (n + 1, size))
    return best[-1][0]


def test_local_search_against_an_exact_packer():
    rng = np.random.default_rng(8)
    plain, searched, exact = 0, 0, 0
    for _ in range(60):
        cuts = [np.sort(rng.choice(np.arange(26, 75), 2, replace=False)) for _ in range(3)]
        sizes = np.concatenate([np.diff([0, *c, 100]) for c in cuts]).astype(np.int64)
        bins = packing.Bins(sizes, 100)
        bins.best_fit()
        plain += len(bins.items)
        searched += len(packing.pack_lengths(sizes, 100))
        exact += fewest_bins(sizes.tolist(), 100)
    assert exact <= searched < plain
    assert plain - searched >= (plain - exact) / 2  # half of what best fit wastes, at least


def test_local_search_on_hard_lengths():
    """Three that fill a sequence exactly, each above a quarter of it: best fit pairs the wrong ones."""
    rng = np.random.default_rng(2)
    first = rng.integers(1100, 1700, 300)
    second = rng.integers(1100, 1400, 300)
    sizes = np.concatenate([first, second, 4096 - first - second]).astype(np.int64)
    bins = packing.Bins(sizes, 4096)
    bins.best_fit()
    before = len(bins.items)
    bins.improve()
    used = [b for b in bins.items if b]
    assert sorted(i for b in used for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 4096 for b in used)
    assert 300 <= len(used) < before
    assert len(packing.pack_lengths(np.full(16_384, 1400), 4096)) == 8192  # nothing helps, and all bins are alike


def plain_line_dedup(rows, least):
    """Runs of whole lines with `least` words or more that occur earlier, by comparing word by word."""
    texts = {i: [tuple(x.encode().split()) for x in t.split("\n")] for i, t in rows if t is not None}
    first, runs = {}, []
    for i, found in texts.items():
        at = [k for k, w in enumerate(found) if w]
        for a in range(len(at)):
            for b in range(a, len(at)):
                run = tuple(found[k] for k in at[a:b + 1])
                if sum(map(len, run)) >= least:
                    place = (i, at[a], at[b])
                    first[run] = min(first.get(run, place), place)
                    runs.append((run, place))
    gone = {i: set() for i in texts}
    for run, place in runs:
        if first[run] != place:
            gone[place[0]].update(range(place[1], place[2] + 1))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_equals_plain_version(spark):
    rng = random.Random(2)
    stock = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 5))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[3][1]), (63, rows[3][1] + "\n" + rows[3][1])]
    df = frame(spark, [(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, print int")
    out = lines.dedup_lines(df, min_words=7)
    assert set(out.columns) == {"doc_id", "text", "print", "n_lines", "n_removed_lines", "n_removed_words"}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == plain_line_dedup(rows, 7)


def test_line_dedup_with_equal_and_missing_ids(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = frame(spark, [(1, passage), (1, "own words " + passage), (None, passage), (2, passage + "\nrest")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in lines.dedup_lines(df).collect())
    assert got == [(False, 1, "own words " + passage), (False, 1, passage), (False, 2, "rest"), (True, None, "")]


def plain_components(rows, size=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < size else zip(*[w[k:] for k in range(size)]))
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x = len(sets[a] & sets[b])
                if a != b and x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return {i: (len(s), top[i]) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [90, 60])
def test_jaccard_equals_plain_version(spark, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)  # groups of near copies go over several blocks
    rng = random.Random(percent)
    rows = [(0, None), (1, ""), (2, "A b"), (3, "a  B"), (4, "a b c"), (5, "one")]
    for base in range(12):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.choice([9, 11, 12, 40, 130]))]
        for _ in range(rng.randint(1, 14)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(own)))
    df = frame(spark, [(i, t, "n", 1) for i, t in rows], "doc_id long, text string, leader string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, percent=percent).collect()}
    assert got == plain_components(rows, percent=percent)


def test_t_occurrence_probes_and_multiplies_alike():
    rng = np.random.default_rng(1)
    for m, pool in ((6, 40), (60, 50), (200, 4000)):
        sets = [np.unique(rng.integers(0, pool, 60).astype(np.uint64)) for _ in range(m)]
        sets += [np.unique(np.append(s[:-2], np.uint64(9999 + k))) for k, s in enumerate(sets)]
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
                if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - x)}
        assert set(map(tuple, jaccard.t_occurrence(sets, 90).tolist())) == want


def test_a_chain_of_links_is_one_component(spark):
    from voxsieve.llm.components import components
    edges = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 90), (90, 90), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}


def test_digests(spark, library):
    text = "Some text, with words."
    ids = library.encode(text, add_special_tokens=False).ids
    from pyspark.sql import functions as F
    row = bpe.encode(frame(spark, [(1, text)], "doc_id long, text string"), PATH).select(F.sha2("token_bytes", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
