"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Every text is a bag of hashed words and word pairs. Two generative models give each bucket a
probability: one from the target rows (good texts), one from all rows. A text's log importance
weight is the sum over its bag of log target - log raw; with a Gumbel number added, the k largest
keys are a sample without replacement in proportion to the weights.

The models count all rows, per bucket within each task; what reaches the driver is two tables of
BUCKETS numbers. The k-th key is found by counting keys in ever finer ranges, so nothing is sorted
in one place.

Defined cases: null or empty text has weight 0 in logarithm. Without target rows all weights are 0.
The Gumbel number is a function of the id, so a rerun draws the same sample; ties are drawn together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .texts import NOT_ALNUM, grams, sliced, words

BITS = 16
BUCKETS = 1 << BITS
#: Labels that are broadcast to mark the target rows, at most.
LABELS = 65_536
STEPS = 256


def bag(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and pair of neighbouring words."""
    found = words(texts, NOT_ALNUM, lower=True)
    h = found.hashes()
    two = grams(h, 2)
    same = found.rows[:len(two)] == found.rows[1:1 + len(two)]
    return (np.concatenate([found.rows, found.rows[:len(two)][same]]),
            (np.concatenate([h, two[same]]) >> np.uint64(64 - BITS)).astype(np.int64))


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in sliced(batch, "text"):
                total += np.bincount(bag(texts)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    rows = (docs.select("text").mapInArrow(run, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out


def log_ratio(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw)."""
    good, raw = bucket_counts(target), bucket_counts(docs)
    if not good.sum():
        return np.zeros(BUCKETS)
    model = [np.log((c + 1.0) / (c.sum() + BUCKETS)) for c in (good, raw)]
    return model[0] - model[1]


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text") -> DataFrame:
    """All columns but the text, and log_weight (double)."""
    kept = [f for f in docs.schema.fields if f.name not in ("log_weight", text)]
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, text):
                rows, buckets = bag(texts)
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                out["log_weight"] = pa.array(np.bincount(rows, weights=held.value[buckets], minlength=len(texts)), pa.float64())
                yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("log_weight", T.DoubleType())]))


def kth_largest(keyed: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting values in ever finer ranges."""
    low, high = keyed.agg(F.min(column), F.max(column)).first()
    while True:
        width = (high - low) / STEPS
        if width <= 0 or low + width == low:
            return low
        step = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(STEPS - 1))
        inside = keyed.filter((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        found = sorted(inside.groupBy(step.alias("s")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(),
            key=lambda r: -r["s"])  # STEPS rows at most
        for r in found:
            if r["n"] >= k:
                if r["low"] == r["high"]:
                    return r["low"]
                low, high = r["low"], r["high"]
                break
            k -= r["n"]


def resample(docs: DataFrame, target: DataFrame, share: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, log_weight, gumbel_key and sampled: the round(share x rows) largest keys."""
    ratio = log_ratio(docs.select(F.col(f"`{text}`").alias("text")), target)
    draw = (F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(41)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    weighed = stored(weigh(docs, ratio, text).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(draw))), "weighed")
    k = round(share * weighed.count())
    if k <= 0:
        return weighed.withColumn("sampled", F.lit(False))
    return weighed.withColumn("sampled", F.col("gumbel_key") >= F.lit(kth_largest(weighed, "gumbel_key", k)))


def marked(docs: DataFrame, labels: DataFrame, most: int = LABELS) -> DataFrame:
    """The texts that labels (id, good) mark as good; at most `most` labels, picked by a hash of the id."""
    drawn = labels.filter("good = 1 AND id IS NOT NULL").select("id").orderBy(F.xxhash64("id", F.lit(31)), "id").limit(most)
    return docs.join(F.broadcast(drawn.distinct()), "id", "left_semi").select("text")
