"""Exact top-k by inner product, score at a time over an impact-ordered index.

Components become integer impacts, floor(scale * x). The index of a block of vectors has, per dimension,
the block's vectors in the order of their impact there, cut into posting segments of one quantised
impact each. A query reads every list from the end that suits the sign of its own component. The
segments of all its lists are processed by descending impact: how much a posting can raise a score above
the least that its list gives. Accumulators start from the sum of those least values, so after each
segment a vector's score lies between its accumulator and that plus what the next segments of all lists
can still add.

Processing stops on proof: once the vectors whose upper bound reaches the k-th best lower bound are so few
that scoring them is less work than the postings left. These possible members are scored exactly, all
others cannot be among the k. Where no early proof is found, every posting is processed, and the
accumulators are exact. Nothing is sampled or cut off.

Vectors are dealt evenly into blocks and queries into groups by row number; a task sees one block and one
group, and hands on k rows per query.

Defined cases: a vector that is null, or holds null or a component that is not finite, takes no part,
neither as query nor as candidate. Missing components of shorter vectors count as 0. Rows are told apart by
row, not by id: of rows with equal id and equal vector each is a candidate of the other. Ties go to the
smaller id, null ids last, then to the earlier row. Sums are exact below 2**53: a table in which a
score could lie beyond is refused. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import stored

#: Vectors of a block; queries of a group. They bound what a task holds.
BLOCK = 8_192
GROUP = 512
#: Distinct impacts that share a posting segment.
STEP = 16
#: Levels of impact in which a query processes the segments.
LEVELS = 16
NO_ID = np.iinfo(np.int64).max


@dataclass
class Index:
    """Posting segments of a block, list by list: s is one of dimension dims[s], holds
    postings[begins[s]:begins[s + 1]], and its impacts reach from lows[s] to highs[s]."""

    matrix: np.ndarray
    postings: np.ndarray
    impacts: np.ndarray
    dims: np.ndarray
    begins: np.ndarray
    lows: np.ndarray
    highs: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray) -> Index:
        m, width = matrix.shape
        order = np.argsort(matrix, axis=0, kind="stable").T  # per dimension, ascending impact
        impacts = np.take_along_axis(matrix.T, order, axis=1)
        level = impacts // STEP
        first = np.ones((width, m), bool)
        first[:, 1:] = level[:, 1:] != level[:, :-1]
        begins = np.flatnonzero(first.ravel())
        impacts = np.ascontiguousarray(impacts).ravel()
        ends = np.append(begins[1:], impacts.size)
        return cls(matrix, np.ascontiguousarray(order).ravel(), impacts.astype(float), begins // m,
                   np.append(begins, impacts.size), impacts[begins], impacts[ends - 1])

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of vectors among which the k best are."""
        m, width = self.matrix.shape
        edges = np.flatnonzero(np.append(True, self.dims[1:] != self.dims[:-1]))  # first segment of each dimension
        component = query[self.dims]
        one, other = component * self.lows, component * self.highs
        base = np.minimum.reduceat(np.minimum(one, other), edges)  # the least contribution of each list
        impact = np.maximum(one, other) - base[self.dims]
        level = np.where(component == 0, -1, impact * LEVELS // (int(impact.max()) + 1))  # -1 adds nothing
        gains = (self.impacts.reshape(width, m) * query.astype(float)[:, None] - base.astype(float)[:, None]).ravel()
        sizes = np.diff(self.begins)
        acc = np.full(m, float(base.sum()))
        for r in range(int(level.max()), -1, -1):
            chosen = np.flatnonzero(level == r)
            if not len(chosen):
                continue
            # neighbours in one list are read in one go
            apart = np.flatnonzero((np.diff(chosen) > 1) | (np.diff(self.dims[chosen]) > 0)) + 1
            runs = list(zip(self.begins[chosen[np.append(0, apart)]].tolist(),
                            self.begins[chosen[np.append(apart - 1, len(chosen) - 1)] + 1].tolist(), strict=True))
            hit = np.concatenate([self.postings[a:b] for a, b in runs])
            acc += np.bincount(hit, np.concatenate([gains[a:b] for a, b in runs]), m)
            later = (level < r) & (level >= 0)
            postings_left = int(sizes[later].sum())
            remaining = int(np.maximum.reduceat(np.where(later, impact, 0), edges).sum())  # what the lists can still add
            if postings_left and m > k and 2 * remaining < acc.max() - acc.min():
                members = np.flatnonzero(acc + remaining >= np.partition(acc, m - k)[m - k])
                if len(members) * width <= postings_left:
                    return members, self.matrix[members] @ query
        return np.arange(m), acc.astype(np.int64)


def best(ids: np.ndarray, numbers: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, then the smaller row number."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((numbers[some], ids[some], -scores[some]))[:k]]


def impacts_of(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """number, id, asks and the impacts (array of long) of all rows whose vector takes part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.col(f"`{vector}`").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(fine).withColumn("impacts", F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


def top_k(rows: DataFrame, asks: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key and score of the k best candidates of every row for which `asks` holds."""
    numbered = stored(impacts_of(rows.select(
        F.monotonically_increasing_id().alias("number"), F.col(f"`{key}`").cast("long").alias("id"),
        F.coalesce(asks, F.lit(False)).alias("asks"), F.col(f"`{vector}`").alias("vector")), "vector", scale)
        .select("number", "id", "asks", "impacts"), "impacts")
    n, queries, width, largest = numbered.agg(
        F.count("*"), F.count_if("asks"), F.max(F.size("impacts")),
        F.max(F.array_max(F.transform("impacts", lambda v: F.abs(v.cast("double")))))).first()
    width, largest = max(1, width or 0), largest or 0.0
    if 4.0 * LEVELS * width * (largest + 1) ** 2 >= 2.0 ** 53:
        raise ValueError(f"components up to {largest / scale:g}: scores would not be exact")
    blocks, groups = max(1, ceil(n / BLOCK)), max(1, ceil(queries / GROUP))
    dealt = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int").alias("block")
    grouped = F.pmod(F.xxhash64("number", F.lit(1)), F.lit(groups)).cast("int").alias("group")
    # every block meets every group of the stated queries
    held = numbered.select("number", "id", "impacts", dealt, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = numbered.filter("asks").select(
        "number", "id", "impacts", grouped, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in ("query", "query_id", "number", "id", "score")}
        if len(candidates) and len(questions):
            ids, numbers = _ids(candidates["id"]), candidates["number"].to_numpy()
            index = Index.of(_matrix(candidates["impacts"], width))
            asking, names = questions["number"].to_numpy(), questions["id"].to_pylist()
            for q, wanted in enumerate(_matrix(questions["impacts"], width)):
                at, scores = index.search(wanted, k + 1)  # one more, for the query's own row
                other = numbers[at] != asking[q]
                at, scores = at[other], scores[other]
                won = best(ids[at], numbers[at], scores, k)
                for name, value in (("query", [asking[q]] * len(won)), ("query_id", [names[q]] * len(won)),
                                    ("number", numbers[at[won]]), ("id", ids[at[won]]), ("score", scores[won])):
                    found[name].extend(value)
        out = {c: pa.array(v, pa.int64()) for c, v in found.items()}
        return pa.table(out)

    met = held.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(
        run, "query long, query_id long, number long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "number"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias(key), "score")
