"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicons and patterns. Each votes toxic, clean or not at all on a text:
a short seed lexicon and patterns written down here, and lexicons induced from labelled rows - words,
and word beginnings, whose share of toxic texts lies far above the base rate - dealt over several
voters, so that one wrong word does not decide. The label model estimates each voter's accuracy from
how voters agree with one another (moments over all rows, no labels), and the correlation of voters
that agree more than their accuracies explain shares their weight. Posterior labels train a linear
classifier over the votes and over hashed words and word beginnings; its margin alone is the score, put on
the scale of the given labels on a sample of labelled rows.

The lexicons are induced from at most LABELS labelled rows, counted per hash bucket within each task;
the moments cover all rows and are a table of voters x voters; the classifier is fitted on at most
SAMPLE labelled rows, and the scale on at most as many others.

Defined cases: null or empty text has no features and gets the score of its absent votes. Without
labelled rows the seed voters alone decide. Texts are scored whole, however long; equal texts and
repeated rows get equal scores; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .texts import NOT_ALNUM, mix, sliced, span_hashes, text_hash, words

# A seed lexicon of common English insults.
SEEDS = ("idiot", "moron", "scum", "trash", "loser", "stupid", "pathetic", "worthless", "disgusting", "clown")
#: Patterns: a seed word directly after one of these, or one of these before it.
ADDRESS = ("you", "your", "are", "such", "these", "those")

BUCKETS = 1 << 22
FEATURES = 1 << 18
#: Lengths (bytes) of the word beginnings that count as features besides whole words.
STEMS = (5, 6, 7, 8)
#: Induced lexicon voters.
VOTERS = 12
#: An induced entry is in so many labelled texts at least, with this share of toxic ones at least.
LEAST_TEXTS = 6
LEAST_SHARE = 0.6
#: Labelled rows from which lexicons are induced, at most.
LABELS = 32_768
#: Labelled rows on which the classifier is fitted, at most.
SAMPLE = 6_000
CUT = 0.3
#: Margins are cut at this log-odds before they are put on the labels' scale.
BOUND = 5.0


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit feature) of every lower-cased word and word beginning, with repeats."""
    found = words(texts, NOT_ALNUM, lower=True)
    size = found.ends - found.starts
    rows, keys = [found.rows], [found.hashes()]
    for k in STEMS:
        on = size > k
        rows.append(found.rows[on])
        # never inside a UTF-8 character: its later bytes are taken along
        ends = found.starts[on] + k
        for _ in range(3):
            ends = ends + ((ends < found.ends[on]) & ((found.data[np.minimum(ends, len(found.data) - 1)] & 0xC0) == 0x80))
        keys.append(mix(span_hashes(found.data, found.starts[on], ends) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(keys)


def once_per_row(rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, number) once, by row; numbers are below 2^40."""
    both = np.unique(rows.astype(np.int64) << 40 | numbers)
    return both >> 40, both & ((1 << 40) - 1)


def lexicon_bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(42)).astype(np.int64)


def weight_bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(46)).astype(np.int64)


def seed_votes(texts: pa.Array) -> np.ndarray:
    """Votes of the written voters, one column each: 1 toxic, -1 clean, 0 none."""
    found = words(texts, NOT_ALNUM, lower=True)
    h = found.hashes()
    seeds = np.array(sorted(text_hash(w) for w in SEEDS), np.uint64)
    address = np.array(sorted(text_hash(w) for w in ADDRESS), np.uint64)
    hit = np.isin(h, seeds)
    n = len(texts)
    per = np.bincount(found.rows[hit], minlength=n)
    after = np.zeros(len(h), bool)
    after[1:] = hit[1:] & np.isin(h[:-1], address) & (found.rows[1:] == found.rows[:-1])
    addressed = np.bincount(found.rows[after], minlength=n)
    halves = [np.bincount(found.rows[np.isin(h, seeds[i::2])], minlength=n) for i in (0, 1)]
    return np.stack([
        np.where(per > 0, 1, -1), np.where(per > 1, 1, 0), np.where(addressed > 0, 1, 0),
        np.where(halves[0] > 0, 1, -1), np.where(halves[1] > 0, 1, -1)], 1).astype(np.int8)


N_SEED = 5


@dataclass
class Voters:
    """Induced lexicons: sorted 64-bit bucket keys, the voter of each, and their strength."""

    buckets: np.ndarray
    voter: np.ndarray
    n: int

    def votes(self, texts: pa.Array, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Votes of all voters on texts with these word features."""
        out = np.full((len(texts), self.n), -1, np.int8)
        if len(self.buckets):
            b = lexicon_bucket(keys)
            at = np.minimum(np.searchsorted(self.buckets, b), len(self.buckets) - 1)
            hit = self.buckets[at] == b
            out[rows[hit], self.voter[at[hit]]] = 1
        return np.concatenate([seed_votes(texts), out], 1)


@dataclass
class LabelModel:
    """Class balance, each voter's P(vote toxic | toxic) and P(vote toxic | clean), and its weight."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.on_toxic / self.on_clean)
        no = np.log((1 - self.on_toxic) / (1 - self.on_clean))
        z = np.log(self.prior / (1 - self.prior)) + ((votes > 0) * yes + (votes < 0) * no) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(n: float, first: np.ndarray, second: np.ndarray) -> LabelModel:
    """From how often voters vote toxic (first) and do so together (second), over n rows.

    For three voters that are independent given the label, the covariances fix each one's covariance
    with the label up to sign: c_i^2 = C_ij C_ik / C_jk; the median over pairs of other voters is
    robust. Where two voters agree beyond c_i c_j they are correlated, and share their weight.
    """
    m, n = len(first), max(n, 1)
    rate = np.clip(first / n, 1e-4, 1 - 1e-4)
    cov = second / n - np.outer(rate, rate)
    strength = np.zeros(m)
    for i in range(m):
        found = [cov[i, j] * cov[i, k] / cov[j, k] for j in range(m) for k in range(j + 1, m)
                 if i not in (j, k) and cov[j, k] > 1e-6 and cov[i, j] * cov[i, k] > 0]
        strength[i] = np.sqrt(np.median(found)) if found else 0.0
    # the share of texts on which at least one good voter votes toxic bounds the class balance
    strong = strength > 0
    prior = float(np.clip(np.max(rate[strong]) if strong.any() else 0.05, 0.01, 0.5))
    spread = np.sqrt(prior * (1 - prior))
    gap = np.clip(strength / spread, 0, None)  # c_i = gap_i * sqrt(p (1 - p)), gap = P(1|toxic) - P(1|clean)
    gap = np.minimum(gap, np.minimum((1 - rate) / (1 - prior), rate / prior) * 0.98)
    on_toxic = np.clip(rate + (1 - prior) * gap, 1e-3, 1 - 1e-3)
    on_clean = np.clip(rate - prior * gap, 1e-4, 1 - 1e-3)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    extra = np.clip(cov - np.outer(strength, strength), 0, None) / np.outer(scale, scale)
    np.fill_diagonal(extra, 0)
    weight = np.where(strong, 1 / (1 + extra.sum(1)), 0.0)
    return LabelModel(prior, on_toxic, on_clean, weight)


def vote_features(votes: np.ndarray) -> np.ndarray:
    """One column for each voter's vote toxic, then one for each vote clean."""
    return np.concatenate([votes > 0, votes < 0], 1).astype(np.float64)


@dataclass
class Classifier:
    """Weights over feature buckets and votes, and the line from its margin to a log-odds of the given labels."""

    weights: np.ndarray
    bias: float
    voters: Voters
    labels: LabelModel
    slope: float = 1.0
    shift: float = 0.0
    on_votes: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The linear classifier's margin; the label model's log-odds where there was no row to fit one on."""
        rows, keys = word_features(texts)
        votes = self.voters.votes(texts, rows, keys)
        if not len(self.on_votes):
            p = np.clip(self.labels.posterior(votes), 1e-6, 1 - 1e-6)
            return np.clip(np.log(p / (1 - p)), -BOUND, BOUND)
        b = weight_bucket(keys)
        on = self.weights[b] != 0
        rows, b = once_per_row(rows[on], b[on])
        z = np.bincount(rows, weights=self.weights[b], minlength=len(texts))  # whole numbers where no feature counts
        z = z / np.sqrt(np.maximum(np.bincount(rows, minlength=len(texts)), 1))
        # far margins say no more than near ones about how often voters are wrong
        return np.clip(z + vote_features(votes) @ self.on_votes + self.bias, -BOUND, BOUND)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) * self.slope + self.shift, -30, 30)))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, by label, summed within the task."""
    total = [np.zeros(BUCKETS, np.int32) for _ in range(2)]
    for batch in batches:
        for part, texts in sliced(batch, "text"):
            toxic = np.array(part.column(part.schema.get_field_index("toxic")).to_pylist(), np.int64)
            rows, keys = word_features(texts)
            rows, b = once_per_row(rows, lexicon_bucket(keys))
            for k in (0, 1):
                own, n = np.unique(b[toxic[rows] == k], return_counts=True)
                total[k][own] += n.astype(np.int32)
    at = np.flatnonzero(total[0] + total[1])
    for low in range(0, len(at), 200_000):
        own = at[low:low + 200_000]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int32()), "clean": pa.array(total[0][own], pa.int64()),
                                          "toxic": pa.array(total[1][own], pa.int64())})


def induce(labelled: DataFrame) -> Voters:
    """Lexicon voters from the labelled rows (text, toxic), counted over all of them."""
    counted = labelled.select("text", "toxic").mapInArrow(_count_features, "bucket int, clean long, toxic long")
    told = (
        counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter((F.col("toxic") >= LEAST_TEXTS - 1) & (F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
                & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))))
    buckets = np.sort(np.array([r["bucket"] for r in told.select("bucket").collect()], np.int64))  # BUCKETS at most
    voter = (mix(buckets.astype(np.uint64) + np.uint64(99)) % np.uint64(VOTERS)).astype(np.int64)
    return Voters(buckets, voter, VOTERS)


def vote_moments(docs: DataFrame, voters: Voters) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all rows: their number, how often each voter votes toxic, and how often two do together."""
    held = docs.sparkSession.sparkContext.broadcast(voters)
    m = N_SEED + voters.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, second = 0, np.zeros((m, m))
        for batch in batches:
            for _, texts in sliced(batch, "text"):
                yes = (held.value.votes(texts, *word_features(texts)) > 0).astype(np.float64)
                n += len(yes)
                second += yes.T @ yes
        i, j = np.nonzero(np.ones((m, m)))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                          "both": pa.array(second[i, j]), "n": pa.array(np.full(len(i), float(n)))})

    rows = (docs.select("text").mapInArrow(run, "i int, j int, both double, n double")
            .groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect())  # voters x voters
    second = np.zeros((m, m))
    for r in rows:
        second[r["i"], r["j"]] = r["both"]
    return max((r["n"] for r in rows), default=0.0), np.diag(second).copy(), second


def _logistic(rows: np.ndarray, cols: np.ndarray, votes: np.ndarray, y: np.ndarray, size: int, rounds: int = 60,
              penalty: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sparse rows of length 1 and dense votes with soft labels, by Adagrad over all rows."""
    n, u, u_squares = len(votes), np.zeros(votes.shape[1]), np.full(votes.shape[1], 1e-8)
    value = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))[rows]
    w, b, squares, b_square = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(rows, weights=w[cols] * value, minlength=n) + votes @ u + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(cols, weights=g[rows] * value, minlength=size) / n + penalty * w / n
        squares += grad ** 2
        w -= 0.5 * grad / np.sqrt(squares)
        grad = (votes.T @ g + penalty * u) / n
        u_squares += grad ** 2
        u -= 0.5 * grad / np.sqrt(u_squares)
        b_square += g.mean() ** 2
        b -= 0.5 * g.mean() / np.sqrt(b_square)
    return w, u, b


def with_labels(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows, picked by a hash of the id.

    The labels' bound is the bound of what is broadcast; texts are not shuffled.
    """
    drawn = (labels.filter("toxic IS NOT NULL AND id IS NOT NULL").select("id", (F.col("toxic") > 0).cast("int").alias("toxic"))
             .orderBy(F.xxhash64("id", F.lit(29)), "id", "toxic").limit(most))
    return docs.filter(F.col("text").isNotNull()).select("id", "text").join(F.broadcast(drawn), "id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most_labels: int = LABELS, sample: int = SAMPLE) -> Classifier:
    """docs (id, text): all texts, for the voters' moments; labels (id, toxic): what may be learnt from."""
    # what sets the scale takes no part in the rest
    part = F.pmod(F.xxhash64("id", F.lit(53)), F.lit(10))
    for_fit, for_scale = labels.filter(part < 8), labels.filter(part >= 8)
    voters = induce(with_labels(docs, for_fit, most_labels))
    model = label_model(*vote_moments(docs, voters))
    held = docs.sparkSession.sparkContext.broadcast((voters, model))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = held.value
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                rows, keys = word_features(texts)
                own, b = once_per_row(rows, weight_bucket(keys))
                at = np.searchsorted(own, np.arange(len(texts) + 1)) * 4
                raw, votes = b.astype("<u4").tobytes(), v.votes(texts, rows, keys)
                yield pa.RecordBatch.from_pydict({
                    "toxic": part.column(part.schema.get_field_index("toxic")),
                    "posterior": pa.array(model.posterior(votes)),
                    "votes": pa.array([x.tobytes() for x in votes], pa.binary()),
                    "features": pa.array([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})

    drawn = with_labels(docs, for_fit, sample)
    rows = drawn.mapInArrow(features, "toxic int, posterior double, votes binary, features binary").toArrow()
    n = rows.num_rows
    fitted = Classifier(np.zeros(FEATURES), 0.0, voters, model)
    if not n:
        return fitted
    posterior = rows.column("posterior").to_numpy()
    each = [np.frombuffer(b, "<u4") for b in rows.column("features").to_pylist()]
    row, col = np.repeat(np.arange(n), [len(e) for e in each]), np.concatenate(each).astype(np.int64)
    # features in two texts at least
    often = np.bincount(col, minlength=FEATURES) > 1
    row, col = row[often[col]], col[often[col]]
    votes = np.stack([np.frombuffer(b, np.int8) for b in rows.column("votes").to_pylist()])
    fitted.weights, fitted.on_votes, fitted.bias = _logistic(row, col, vote_features(votes), posterior, FEATURES)
    whole = docs.sparkSession.sparkContext.broadcast(fitted)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                yield pa.RecordBatch.from_pydict({
                    "toxic": part.column(part.schema.get_field_index("toxic")), "z": pa.array(whole.value.margins(texts))})

    told = with_labels(docs, for_scale, sample).mapInArrow(margins, "toxic int, z double").toArrow()
    y = told.column("toxic").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        slope, fitted.shift = _scale(told.column("z").to_numpy()[:, None], y)
        fitted.slope = max(float(slope[0]), 0.1)
    return fitted


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The line that puts margins on the scale of the given labels."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + 1e-2 * w)
    return w[:-1], float(w[-1])


def predict(docs: DataFrame, model: Classifier, text: str = "text", cut: float = CUT) -> DataFrame:
    """All columns, and score (double) and predicted (int)."""
    added = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    kept = [f for f in docs.schema.fields if f.name not in added]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, text):
                score = held.value.scores(texts)
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                out["score"], out["predicted"] = pa.array(score), pa.array((score >= cut).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added.items()]])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
