"""Packing token pieces into sequences: best-fit decreasing, then a swap-based local search.

Pieces are dealt evenly over groups of bounded size by a number given at the first write, so equal
or repeated rows never gather in one task. In each group best fit places pieces from long to short;
then documents are moved or exchanged (one for one, two for one) between underfull bins whenever
that increases the sum of squared fills, which fills some bins and empties others. The search looks at
every item of every underfull bin, and goes on until no exchange helps. Bins that stay
underfull are opened and their pieces go to the next, far smaller round.

Null or empty text is one piece that holds the end id alone. Ties are broken by the dealt number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .bpe import encode

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs at a time, on average.
GROUP = 16_384
#: Bins filled less than this share are packed again with those of other groups.
OPEN_BELOW = 0.97


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, tokens: bool = False,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 (and token_bytes if `tokens`).

    A document is its ids and then the end id; only longer ones are cut, after every `capacity` ids.
    """
    end = F.lit(bytearray(np.array([END_ID], "<u4").tobytes()))
    coded = encode(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), path)
    whole = F.concat("token_bytes", end)
    total = F.col("n_tokens") + 1
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / capacity)))
    cut = coded.select("doc_id", whole.alias("all"), total.alias("total"), pieces.alias("p"))
    raw = F.expr(f"substring(all, cast(p * {4 * capacity} + 1 as int), {4 * capacity})")
    return cut.select(
        "doc_id", F.col("p").cast("int").alias("piece"), (F.col("p") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("p") * capacity).alias("length"),
        F.crc32(raw).alias("ids_crc32"), *([raw.alias("token_bytes")] if tokens else []))


class Bins:
    """Item numbers per bin, and the fill of each bin."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """From long to short, each into the fullest bin that has room."""
        gaps: list[int] = []  # distinct gaps in order, and the bins of each
        at: dict[int, list[int]] = {}
        order = np.argsort(-self.lengths, kind="stable").tolist()
        sizes = self.lengths.tolist()
        for i in order:
            size = sizes[i]
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                b = at[gap].pop()
                if not at[gap]:
                    del at[gap], gaps[k]
                self.items[b].append(i)
            else:
                b, gap = len(self.items), self.capacity
                self.items.append([i])
                self.fill.append(0)
            self.fill[b] += size
            gap -= size
            if gap:
                if gap not in at:
                    at[gap] = []
                    insort(gaps, gap)
                at[gap].append(b)

    def least(self) -> int:
        return -(-int(self.lengths.sum()) // self.capacity)

    def improve(self) -> None:
        """Local search over all underfull bins; ends when no exchange helps or no bin can be saved.

        Every exchange raises the sum of squared fills, so the search ends. Bins of equal contents
        fail alike, so after a failure the others are passed over until something has changed.
        """
        self.bin_of = np.zeros(len(self.lengths), np.int64)
        for b, items in enumerate(self.items):
            self.bin_of[items] = b
        least, helped = self.least(), True
        while helped:
            helped = False
            failed: set[bytes] = set()
            for a in sorted(range(len(self.fill)), key=self.fill.__getitem__):
                while 0 < self.fill[a] < self.capacity:
                    if sum(f > 0 for f in self.fill) <= least:
                        return
                    held = np.sort(self.lengths[self.items[a]]).tobytes()
                    if held in failed or not self._relieve(a):
                        failed.add(held)
                        break
                    failed.clear()
                    helped = True

    def _relieve(self, a: int) -> bool:
        """Makes the exchange of bin `a` with another underfull bin that raises the squared fill most, if any does.

        Where d tokens more leave `a` than come back, the raise is 2 d (other's fill - own fill + d). Among what
        fits a bin, the largest d is best, so for each partner one binary search finds its companion.
        """
        fill, lengths, capacity = np.array(self.fill), self.lengths, self.capacity
        best, found = 0, None  # the partner, what goes, what comes back

        def consider(d: np.ndarray, b: np.ndarray) -> int | None:
            nonlocal best
            if not len(d):
                return None
            gain = np.where((d > 0) & (d <= capacity - fill[b]), d * (fill[b] - fill[a] + d), 0)
            k = int(gain.argmax())
            if gain[k] <= best:
                return None
            best = int(gain[k])
            return k

        open_ = (fill > 0) & (fill < capacity)
        open_[a] = False
        bins = np.flatnonzero(open_)
        others = np.flatnonzero(open_[self.bin_of])
        # by bin, then by length: the companions of an item are a stretch
        width = capacity + 1
        order = np.argsort(self.bin_of[others] * width + lengths[others], kind="stable")
        others = others[order]
        owner, size = self.bin_of[others], lengths[others]
        keys = owner * width + size
        room = capacity - fill[owner]
        mine = np.array(self.items[a])
        sizes, first, count = np.unique(lengths[mine], return_index=True, return_counts=True)
        for x, s in zip(mine[first].tolist(), sizes.tolist(), strict=True):
            if (k := consider(np.full(len(bins), s), bins)) is not None:
                found = int(bins[k]), [x], []
            if (k := consider(s - size, owner)) is not None:
                found = int(owner[k]), [x], [int(others[k])]
            # two of another bin for one of this: the shortest companion that leaves no more than the room
            at = np.searchsorted(keys, owner * width + np.maximum(s - size - room, 0))
            at += at == np.arange(len(keys))
            ok = np.flatnonzero(at < len(keys))
            ok = ok[owner[at[ok]] == owner[ok]]
            if (k := consider(s - size[ok] - size[at[ok]], owner[ok])) is not None:
                found = int(owner[ok[k]]), [x], [int(others[ok[k]]), int(others[at[ok[k]]])]
        # two of this bin for one of another: the longest two that fit
        i, j = np.triu_indices(len(sizes))
        twice = (i != j) | (count[i] > 1)
        i, j = i[twice], j[twice]
        both = sizes[i] + sizes[j]
        rank = np.argsort(both, kind="stable")
        if len(both):
            at = np.searchsorted(both[rank], size + room, side="right") - 1
            ok = np.flatnonzero(at >= 0)
            if (k := consider(both[rank[at[ok]]] - size[ok], owner[ok])) is not None:
                pair = rank[at[ok[k]]]
                x = mine[lengths[mine] == sizes[i[pair]]][0]
                y = mine[lengths[mine] == sizes[j[pair]]][-1]
                found = int(owner[ok[k]]), [int(x), int(y)], [int(others[ok[k]])]
        if found:
            self._exchange(a, *found)
        return found is not None

    def _exchange(self, a: int, b: int, take: list[int], give: list[int]) -> None:
        """`take` goes from bin a to bin b and `give` back."""
        self.items[a] = [i for i in self.items[a] if i not in take] + give
        self.items[b] = [i for i in self.items[b] if i not in give] + take
        self.bin_of[take], self.bin_of[give] = b, a
        delta = int(self.lengths[take].sum()) - int(self.lengths[give].sum() if give else 0)
        self.fill[a] -= delta
        self.fill[b] += delta


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers of each sequence."""
    bins = Bins(np.asarray(lengths, np.int64), capacity)
    bins.best_fit()
    bins.improve()
    return [items for items in bins.items if items]


def _packer(capacity: int, level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        lengths = table.column("c_length").to_numpy()
        g = table.column("g")[0].as_py()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        opened = np.zeros(len(lengths), bool)
        for k, items in enumerate(pack_lengths(lengths, capacity)):
            own = lengths[items]
            sequence[items] = (level << 56) | (g << 20) | k
            offset[items] = np.cumsum(own) - own
            opened[items] = not last and own.sum() < OPEN_BELOW * capacity
        return (table.drop_columns(["g"]).append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset)).append_column("opened", pa.array(opened)))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset (longs) to pieces with a `length` of at most `capacity`; all rows are kept."""
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    left = stored(
        pieces.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in columns])
        .withColumn("slot", F.monotonically_increasing_id()), "pieces")
    full = F.col("c_length") >= capacity
    done = left.filter(full).select(
        "*", (-F.col("slot") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = left.filter(~full)
    out = T.StructType([*left.schema.fields, T.StructField("sequence_id", T.LongType()),
                        T.StructField("offset", T.LongType()), T.StructField("opened", T.BooleanType())])
    level, before = 0, None
    while True:
        n = left.count()
        groups = max(1, -(-n // group))
        dealt = left.withColumn("g", F.pmod(F.xxhash64("slot", F.lit(level)), F.lit(groups)))
        # lengths that fit together badly leave bins open everywhere: a round that halves too little is the last
        last = groups == 1 or (before is not None and 2 * n > before)
        before = n
        packed = dealt.groupBy("g").applyInArrow(_packer(capacity, level, last), out)
        if last:
            done = done.unionByName(packed.drop("opened"))
            break
        packed = stored(packed, "packed")
        done = done.unionByName(packed.filter(~F.col("opened")).drop("opened"))
        left = packed.filter("opened").drop("sequence_id", "offset", "opened")
        level += 1
    return done.select(*[F.col(f"`c_{c}`").alias(c) for c in columns], "sequence_id", "offset")
