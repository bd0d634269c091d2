"""Whole-text scans over Arrow string buffers with numpy: words, their hashes, and rows of a batch.

A batch is cut into slices of a few MB before anything is computed, so memory follows the longest
single text, not the batch. Words are found on the UTF-8 bytes: every delimiter in use is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_rng = np.random.default_rng(20240607)  # fixed, so that every worker hashes alike
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_ROOT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = _rng.integers(1, 1 << 63, size=1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash root and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, root in enumerate((_ROOT, _ROOT_INVERSE)):
            steps = np.full(size, root, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each span; `codes` are integers below 65,536."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_CODES[codes] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_hash(text: str) -> np.uint64:
    """The hash that `words` gives a word with these bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


def byte_table(delimiters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(delimiters)] = True
    return table


BLANK = byte_table(b" \t\n\v\f\r")
#: All ASCII but letters and digits.
NOT_ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a slice in order: byte spans, the row of each, the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray
    n_rows: int

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array without nulls."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0]:at[-1]], at - at[0]


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows with at most `limit` bytes of text (one row at least), and their texts."""
    texts = strings(batch.column(batch.schema.get_field_index(column)))
    at = buffers(texts)[1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin), texts.slice(begin, end - begin)
        begin = end


def words(texts: pa.Array, delimiters: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of bytes that are no delimiters; no run crosses from one row into the next."""
    data, at = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~delimiters[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cut = at[1:-1]
    before[cut[cut < n]] = False
    after[cut[(cut > 0)] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, at)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return Words(data, starts, ends, rows, bounds, len(texts))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes, row borders not regarded."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:m] + np.uint64(n))
    for i in range(1, n):
        out = mix(out * np.uint64(3) + hashes[i:i + m])
    return out


def expand(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start:start + length] of every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Table:
    """64-bit keys to 32-bit values by open addressing, all look-ups vectorised."""

    def __init__(self, capacity: int = 1 << 12):
        self.bits = max(4, int(capacity - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is absent."""
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1).astype(np.int32)
        left = np.flatnonzero((found != keys) & (self.values[slot] >= 0))
        mask = len(self.keys) - 1
        at = slot[left]
        while len(left):
            at = (at + 1) & mask
            found = self.keys[at]
            used = self.values[at] >= 0
            hit = used & (found == keys[left])
            out[left[hit]] = self.values[at[hit]]
            on = used & ~hit
            left, at = left[on], at[on]
        return out.reshape(shape)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and absent."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.values >= 0
            kept, held = self.keys[old], self.values[old]
            self.__init__(4 * (self.size + len(keys)))
            self._insert(kept, held)
        self._insert(keys, values.astype(np.int32))

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.size += len(keys)
        mask = len(self.keys) - 1
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.values[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & mask
