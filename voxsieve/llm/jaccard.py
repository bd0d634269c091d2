"""Exact n-gram Jaccard join by T-occurrence search over inverted lists.

Which sets have to meet is decided first. Linked sets differ in few members, at most D for their size
band. A set sorted by hash is cut into D + 1 + SPARE ranges; a pair that differs in at most D members
agrees on SPARE + 1 whole ranges, so linked sets share the signature of a range that is not empty (a
set with more than SPARE empty ranges announces those too). A signature is rarely shared by sets that
are not near copies, however common the members are one by one.

Where sets meet, their members' inverted lists are searched: the merge of the short lists counts
shared members, documents that cannot reach the needed overlap T even with all of their long lists
are skipped, and the rest is probed in the long lists by binary search (DivideSkip).

Equal sets are one node from the start. Groups are cut into blocks of bounded content, so no task
holds a large group; a task returns a spanning forest of its links, never the pairs.

Defined cases: null or empty text has no set and links with nothing; a text of fewer than n words is
one shingle; rows with an equal id are one document; a row without id gets the component of rows
with its very set, or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import stored
from .components import components
from .texts import BLANK, grams, mix, sliced, words

SHINGLE = 3
#: Similarity as a fraction in hundredths.
PERCENT = 90
#: Ranges beyond those that may differ, so that empty ranges need hardly ever count.
SPARE = 2
#: Documents, and set members, of a block.
BLOCK_DOCS = 1024
BLOCK_MEMBERS = 1 << 20


def shingle_rows(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in order (with repeats), and the bounds of each row."""
    found = words(texts, BLANK, lower=True)
    hashes = found.hashes()
    per_row = found.counts()
    every = grams(hashes, size)
    keep = np.zeros(0, bool)
    if len(every):
        keep = found.rows[:len(every)] == found.rows[size - 1:]
    n = np.maximum(per_row - size + 1, 0)
    out = every[keep]
    short = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(short):
        own = []
        for r in short:
            h = hashes[found.bounds[r]:found.bounds[r + 1]]
            own.append(grams(h, len(h))[0] ^ np.uint64(len(h)))
        at = np.cumsum(n) - n
        out = np.insert(out, at[short], np.array(own, np.uint64))
        n[short] = 1
    return out, np.concatenate([[0], np.cumsum(n)])


def bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Borders of the size bands. Sets below the first border link with equal sets only; the borders
    grow by half at least, so the partners of a set are in its own band or a neighbouring one."""
    # sets of sizes a <= b differ in (100 - p) / (100 + p) * (a + b) members at most, and a >= p/100 * b
    first = 1
    while (100 - percent) * (first + 100 * first // percent) < 100 + percent:
        first += 1
    out = [first]
    while out[-1] < top:
        out.append(max(-(-3 * out[-1] // 2), 100 * out[-1] // percent + 2))
    return np.array(out, np.int64)


def range_counts(borders: np.ndarray, percent: int) -> np.ndarray:
    """Into how many ranges sets are cut in the band that ends below each border (0 for the first)."""
    differ = (100 - percent) * 2 * (borders - 1) // (100 + percent)
    out = differ + 1 + SPARE
    out[0] = 0
    return out


def signatures(members: np.ndarray, sums: np.ndarray, a: int, b: int, ranges: int, band: int) -> np.ndarray:
    """One 64-bit value for each range of the sorted members[a:b] that the set announces.

    `sums` are running sums of scrambled members, one entry longer than `members`.
    """
    cuts = (np.arange(1, ranges, dtype=np.float64) * (2.0 ** 64 / ranges)).astype(np.uint64)
    at = a + np.concatenate([[0], np.searchsorted(members[a:b], cuts), [b - a]])
    held = np.diff(at)
    total = sums[at[1:]] - sums[at[:-1]]
    label = np.arange(ranges, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 0x1000193 + 1)
    out = mix(total + mix(label) + held.astype(np.uint64))
    full = held > 0
    return out if (~full).sum() > SPARE else out[full]


def distinct_rows(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and the bounds of each row."""
    shingles, bounds = shingle_rows(texts, size)
    own = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return (np.concatenate(own) if own else shingles), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _profiles(size: int, percent: int) -> Callable:
    borders = bands(percent)
    ranges = range_counts(borders, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                members, bounds = distinct_rows(texts, size)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(members + np.uint64(1)), dtype=np.uint64)])
                sizes, keys, heads = np.diff(bounds), [], []
                band = np.searchsorted(borders, sizes, side="right")
                # a set that may have a partner in the next band is announced there too
                beyond = np.searchsorted(borders, 100 * sizes // percent, side="right")
                for a, b, g, h in zip(bounds[:-1].tolist(), bounds[1:].tolist(), band.tolist(), beyond.tolist(), strict=True):
                    keys.append(hashlib.blake2b(members[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    found = [signatures(members, sums, a, b, int(ranges[k]), k) for k in range(max(g, 1), h + 1)]
                    heads.append(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "n": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.binary()),
                    "head": pa.array(heads, pa.list_(pa.int64()))})
    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                members, bounds = distinct_rows(texts, size)
                raw, at = members.tobytes(), (bounds * 8).tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "tasks": part.column(1),
                    "members": pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})
    return run


def t_occurrence(sets: list[np.ndarray], percent: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Linked pairs (i < j) of sorted, distinct member arrays; only `allowed` pairs where given."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    length = np.diff(np.append(first, len(flat)))
    need = -(-percent * (sizes[:, None] + sizes[None, :]) // (100 + percent))
    open_ = np.triu(np.ones((m, m), bool), 1) & (need <= np.minimum(sizes[:, None], sizes[None, :]))
    if allowed is not None:
        open_ &= allowed
    long_from = max(8, m // 8)
    short = np.flatnonzero((length > 1) & (length <= long_from))
    # merge of the short lists: how many members each pair shares in them
    shared = np.zeros(m * m, np.int32)
    for f in np.unique(length[short]):
        rows = owner[first[short[length[short] == f]][:, None] + np.arange(f)]
        a, b = np.triu_indices(f, 1)
        pair, n = np.unique((rows[:, a] * m + rows[:, b]).ravel(), return_counts=True)
        shared[pair] += n.astype(np.int32)
    shared = shared.reshape(m, m)
    # the long lists, and how many of them each document is in
    long_ = np.flatnonzero(length > long_from)
    in_long = np.zeros(m, np.int32)
    keys = np.zeros(0, np.int64)
    if len(long_):
        number = np.repeat(np.arange(len(long_)), length[long_])
        members = owner[np.repeat(first[long_] - (np.cumsum(length[long_]) - length[long_]), length[long_])
                        + np.arange(len(number))]
        in_long = np.bincount(members, minlength=m).astype(np.int32)
        keys = number * m + members  # ascending
    reach = shared + np.minimum(in_long[:, None], in_long[None, :])
    i, j = np.nonzero(open_ & (reach >= need))
    if not len(keys) or not len(i):
        return np.stack([i, j], 1)
    overlap = shared[i, j]
    if len(i) > 4 * m:
        # most documents are candidates: all long lists are probed for all of them at once
        for low in range(0, len(long_), 4096):
            part = (number >= low) & (number < low + 4096)
            table = np.zeros((m, 4096), np.float32)
            table[members[part], number[part] - low] = 1
            overlap = overlap + (table @ table.T)[i, j].astype(np.int64)
    else:
        by_doc = np.argsort(members, kind="stable")
        starts = np.searchsorted(members[by_doc], np.arange(m + 1))
        for k in range(len(i)):
            mine = number[by_doc[starts[i[k]]:starts[i[k] + 1]]]
            wanted = mine * m + j[k]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            overlap[k] += int((keys[at] == wanted).sum())
    ok = overlap >= need[i, j]
    return np.stack([i[ok], j[ok]], 1)


def forest(m: int, pairs: np.ndarray) -> np.ndarray:
    """For each of m nodes the smallest node that the pairs reach."""
    label = np.arange(m)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _links(percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        raw = table.column("members").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order]
        block = table.column("block").to_numpy()[order]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        allowed = block[:, None] != block[None, :] if lo != hi else None
        label = forest(len(ids), t_occurrence(sets, percent, allowed))
        tied = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": pa.array(ids[label[tied]], pa.int64()), "v": pa.array(ids[tied], pa.int64())})
    return run


def _meetings(heads: DataFrame) -> DataFrame:
    """Which sets have to be compared: (doc_id, tasks), each task of bounded content."""
    announced = heads.select("doc_id", "n", F.explode("head").alias("signature"))
    # a set's ranges are as many as a tenth of its members, so one common range is a small part of all rows
    same = Window.partitionBy("signature")
    members = stored(
        announced.select("doc_id", "n", F.min("doc_id").over(same).alias("leader"), F.max("doc_id").over(same).alias("other"))
        .filter("leader < other").groupBy("leader", "doc_id").agg(F.first("n").alias("n")), "members")
    groups = stored(
        members.groupBy("leader").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
        .select("leader", F.greatest(
            F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("weight") / BLOCK_MEMBERS)).cast("int").alias("blocks")),
        "groups")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    placed = members.join(groups, "leader").withColumn("block", block)
    return placed.groupBy("doc_id").agg(F.collect_list(F.struct("leader", "block", "blocks")).alias("tasks"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                       key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of `docs`: 100 * intersection >= percent * union links."""
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    profiles = stored(docs.mapInArrow(
        _profiles(size, percent), "doc_id long, n long, key binary, head array<long>"), "profiles")
    nodes = stored(
        profiles.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "nodes")
    heads = profiles.filter("n > 0").join(
        nodes.select(F.col("node").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    tasks = stored(_meetings(heads.select("doc_id", "n", "head")), "tasks")
    # the same plan at every size: a small task table is not broadcast
    sets = docs.join(tasks.hint("merge"), "doc_id").select("doc_id", "tasks", "text").mapInArrow(
        _sets(size), "doc_id long, tasks array<struct<leader:long,block:int,blocks:int>>, members binary")
    met = (
        sets.select("doc_id", "members", F.explode("tasks").alias("t"))
        .select("doc_id", "members", "t.leader", "t.block", F.explode(F.sequence(F.lit(0), F.col("t.blocks") - 1)).alias("with"))
        .select("doc_id", "members", "leader", "block",
                F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi")))
    links = met.groupBy("leader", "lo", "hi").applyInArrow(_links(percent), "u long, v long")
    tied = components(links)
    # the component of each distinct set, before the copies are looked up
    per_key = stored(
        nodes.join(tied.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left")
        .filter("copies > 1 OR component IS NOT NULL")
        .select("key", F.coalesce("component", "node").alias("component_id")), "per-key")
    return profiles.select("doc_id", "n", "key").join(per_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
