"""Importance resampling towards a target distribution, on hashed runs of one to three words.

The tokenizers library splits the ASCII-lowered text with an untrained pattern and returns the words'
offsets. A feature is a window of one to three neighbouring offset pairs: its words, joined by one space.
The crc32 of a window is put together from the crc32 of its words, so a feature is never built as a
string; modulo BUCKETS it is the feature's bucket. Counts per bucket over all documents and over all
target texts give every bucket a gain, a document's weight is the sum of its features' gains, and a
Gumbel number from its id turns the largest scores into a draw without replacement.

Texts are split once; their buckets are a written table that the histogram and the sums read. What
reaches the driver is BUCKETS counts. Ranks come from slices of the score's order, not from one sort.

Defined cases: null and empty text, and text without a word, have no feature and weight 0. A row without
id draws with an empty id. Rows of equal score are ranked by id, null first, then by their number of
features. Repeated rows count and are drawn each for itself. Without a target text or without documents
the gains follow the same formula with counts of 0. Other columns are not read, whatever their names.
Memory follows the longest single text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from ..sources.scratch import stored
from .positions import positions
from .texts import LOWER, buffers, sliced

BUCKETS = 10_000
#: Longest window, in words.
WINDOW = 3
#: Fixed by the task: what a word is made of, after lowering A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@cache
def splitter() -> Tokenizer:
    """Every word a token; the model knows no word and is not trained."""
    tokenizer = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
    return tokenizer


def _byte_steps() -> np.ndarray:
    """crc32 of one more byte, for each value of the low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


STEP = _byte_steps()
_FULL = np.uint32(0xFFFFFFFF)


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given for each byte of its argument."""
    return (tables[0][c & 255] ^ tables[1][(c >> np.uint32(8)) & 255]
            ^ tables[2][(c >> np.uint32(16)) & 255] ^ tables[3][c >> np.uint32(24)])


@cache
def _behind() -> list[np.ndarray]:
    """The map that 2**k zero bytes behind a text make of its crc32, for each k."""
    places = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    out = [STEP[places & 255] ^ (places >> np.uint32(8))]
    for _ in range(31):
        out.append(_apply(out[-1], _apply(out[-1], places)))
    return out


def carry(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of a text carried over `lengths` bytes that follow: xor the crc32 of those for that of both."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = _apply(_behind()[k], out[at])
    return out


def crc_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span of bytes, all spans byte by byte at once, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.full(len(at), _FULL, np.uint32)
    going = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right") if len(at) else ()
    for j, n in enumerate(going):  # the first n spans are longer than j
        c = crc[:n]
        crc[:n] = STEP[(c ^ data[at[:n] + j]) & 255] ^ (c >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ _FULL
    return out


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of all texts, start and length of each word in them, and the number of words per text."""
    data, at = buffers(texts)
    data = LOWER[data]
    whole = data.tobytes()
    counts = np.zeros(len(texts), np.int64)
    starts, ends = [], []
    for r in range(len(texts)):
        text = whole[at[r]:at[r + 1]].decode()
        found = splitter().encode(text, add_special_tokens=False).offsets
        counts[r] = len(found)
        if not found:
            continue
        spans = np.array(found, np.int64)
        if len(text) < at[r + 1] - at[r]:  # offsets count characters
            place = np.append(np.flatnonzero((data[at[r]:at[r + 1]] & 0xC0) != 0x80), at[r + 1] - at[r])
            spans = place[spans]
        starts.append(spans[:, 0] + at[r])
        ends.append(spans[:, 1] + at[r])
    none = np.zeros(0, np.int64)
    begin, end = (np.concatenate(x) if x else none for x in (starts, ends))
    return data, begin, end - begin, counts


def feature_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features row by row, the number of features and of words of each row."""
    data, starts, lengths, counts = word_spans(texts)
    crc = crc_of_spans(data, starts, lengths)
    total = len(crc)
    last = np.repeat(np.cumsum(counts), counts)  # the end of a word's row
    found = np.zeros((total, WINDOW), np.uint16)
    valid = np.zeros((total, WINDOW), bool)
    run = crc
    for n in range(WINDOW):
        if n:  # a window of n words and a space, carried over the next word
            run = run[:max(total - n, 0)] ^ _FULL
            run = (STEP[(run ^ np.uint32(32)) & 255] ^ (run >> np.uint32(8))) ^ _FULL
            run = carry(run, lengths[n:]) ^ crc[n:]
        m = len(run)
        found[:m, n] = run % BUCKETS
        valid[:m, n] = np.arange(m) + n < last[:m]
    per_word = np.concatenate([[0], np.cumsum(valid.sum(1))])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return found[valid], np.diff(per_word[bounds]), counts


def featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_words and the features' buckets (little-endian unsigned 16-bit) of each row."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                buckets, n, counts = feature_buckets(texts)
                ends = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [
                    None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buckets.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), packed], ["id", "n_words", "buckets"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, buckets binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, "<u2")[offsets[0] // 2:offsets[-1] // 2] if data is not None and len(column) else np.zeros(0, "<u2")
    return flat, np.diff(offsets) // 2


def bucket_counts(features: DataFrame) -> list[int]:
    """How many features of all rows fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = [0] * BUCKETS
    for r in (features.select("buckets").mapInArrow(run, "bucket long, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    all_raw, all_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return np.array([
        math.floor(1000 * math.log(float((t + 1) * all_raw) / float((s + 1) * all_target)))
        for s, t in zip(raw, target, strict=True)], np.int64)


def weigh(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight, the sum of the features' gains."""
    held = features.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _numbers(batch.column(2))
            sums = np.concatenate([[0], np.cumsum(held.value[flat])])
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(sums[ends[1:]] - sums[ends[:-1]])],
                ["id", "n_words", "n_features", "weight"])

    kind = features.schema["id"].dataType.simpleString()
    return features.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number, rounded down, from the first 32 bits of sha256(`seed:key`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample_to_target(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
                       percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """key, n_features, weight, score and rank of every row; rank is null for rows that are not drawn."""
    features = stored(featured(docs, key, text), "features")
    wanted = featured(target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text")
    scored = weigh(features, gains(bucket_counts(features), bucket_counts(wanted))).withColumn(
        "score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = stored(scored, "scored")
    placed = positions(scored.filter(F.col("n_words") >= least_words).withColumn("all", F.lit(0)), "all",
                       [F.col("score").desc(), F.col("id").asc(), F.col("n_features").asc()], "ranked")
    drawn = F.col("pos") < F.floor(F.col("n") * percent / 100)
    columns = [F.col("id").alias(key), "n_features", "weight", "score"]
    return placed.select(*columns, F.when(drawn, F.col("pos") + 1).alias("rank")).unionByName(
        scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
