"""Language identification with error-correcting output codes.

Every language gets a codeword of bits, and every bit a binary classifier over hashed character
1- to 4-grams: the log-odds of the n-gram counts of the languages whose bit is 1 against those
whose bit is 0. A text's mean log-odds per bit is turned into a probability with a scale fitted on
training documents; decoding takes the codeword of least loss, each bit weighted by how well it
separates, and flags texts whose two best codewords lie close together.

Counts cover all training documents; they are summed per language and bucket on the cluster, and
what reaches the driver is one table of languages x BUCKETS. The scales are fitted on a sample of
`calibration` documents per language.

Defined cases: `und`, score 0 and ambiguous for text that is null or has no letter. Rows whose
language is null are not learnt from. Without any training row everything is `und`. Of languages whose
codewords lose equally the first in alphabetical order is taken, and the text is ambiguous. Repeated
rows are counted and predicted each for itself. Columns named lang_pred, score or ambiguous are
replaced, all others kept. Long texts are read whole, PIECE n-grams at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .texts import mix, sliced

BUCKETS = 1 << 15
GRAMS = 4
#: Training documents per language on which the bits' scales are fitted.
CALIBRATION = 500
#: Bytes of text at a time, or one longer text; its letters take some 20 bytes per byte.
SLICE = 1 << 19
#: N-grams at a time, whatever the length of a text.
PIECE = 1 << 18
#: Two codewords whose losses differ by less than this share of the weight are ambiguous.
MARGIN = 0.1
UNDETERMINED = "und"

_seeds = np.random.default_rng(7).integers(1, 1 << 63, GRAMS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n distinct rows of bits: the exhaustive code for up to 6 languages, else a random dense code with
    well separated rows."""
    if n <= 1:
        return np.ones((n, 1), bool)
    if n <= 6:
        # each column is a split of the languages in two, the first language always on the 1 side
        return np.array([[True, *[bool(c >> i & 1) for i in range(n - 1)]] for c in range((1 << (n - 1)) - 1)]).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(64):
        code = rng.random((n, bits)) < 0.5
        code = code[:, (code.any(0)) & (~code.all(0))]
        gap = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)].min()
        if gap > apart:
            best, apart = code, gap
    return best


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with their rows, and whether rows have a letter.

    Everything that is no letter counts as one blank.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.frombuffer(bytearray(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")), np.uint32)
    ascii_ = codes < 128
    other = codes[~ascii_]
    low = codes | 0x20
    letter = ascii_ & (low >= 97) & (low <= 122)
    codes[ascii_] = low[ascii_]
    seen, back = np.unique(other, return_inverse=True)
    chars = [chr(c) for c in seen]
    letter[~ascii_] = np.array([c.isalpha() for c in chars], bool)[back]
    codes[~ascii_] = np.array([ord(c.lower()[0]) for c in chars], np.uint32)[back]
    codes[~letter] = 32
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    # blanks in a row, and the ends of texts, are one blank
    keep = letter | np.concatenate([[True], letter[:-1]])
    has = np.add.reduceat(letter, bounds[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    return codes[keep], rows[keep], has


def gram_buckets(codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every character n-gram, rows ascending within a piece; a piece has PIECE n-grams at most."""
    for begin in range(0, len(codes), PIECE):
        part = codes[begin:begin + PIECE + GRAMS - 1].astype(np.uint64)
        own = rows[begin:begin + PIECE + GRAMS - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, GRAMS + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + part[n - 1:]
            m = min(m, PIECE)  # what begins further right belongs to the next piece
            same = own[:m] == own[n - 1:n - 1 + m]
            yield own[:m][same], (mix(h[:m][same] + _seeds[n]) >> np.uint64(64 - 15)).astype(np.int64)


def _count(languages: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in sliced(batch, "text", SLICE):
                lang = np.array(part.column(part.schema.get_field_index(languages)).to_pylist(), object)
                names, of_row = np.unique(lang, return_inverse=True)
                codes, rows, _ = letters(texts.to_pylist())
                for own, buckets in gram_buckets(codes, rows):
                    of_gram = of_row[own]
                    for k, name in enumerate(names):
                        total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                        total += np.bincount(buckets[of_gram == k], minlength=BUCKETS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()),
                "n": pa.array(total[at], pa.int64())})
    return run


@dataclass
class CodeModel:
    """Languages, their codewords, the bits' log-odds per bucket, and the scale and weight of each bit."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    weight: np.ndarray

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-odds of each bit per text, and whether it has a letter."""
        codes, rows, has = letters(texts)
        sums = np.zeros((self.odds.shape[1], len(texts)))
        n = np.zeros(len(texts), np.int64)
        columns = np.ascontiguousarray(self.odds.T, np.float64)
        for own, buckets in gram_buckets(codes, rows):
            if not len(own):
                continue
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            at = own[first]
            n[at] += np.diff(np.append(first, len(own)))
            for b, odds in enumerate(columns):
                sums[b, at] += np.add.reduceat(odds.take(buckets), first)
        return (sums / np.maximum(n, 1)).T, has

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity flag of each row of margins."""
        z = np.clip(margins * self.scale + self.shift, -30, 30)
        # logistic loss of each bit against each codeword
        sign = np.where(self.code, 1.0, -1.0)
        loss = (np.log1p(np.exp(-z[:, None, :] * sign[None])) * self.weight).sum(2)
        part = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = part.max(1) / part.sum(1)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        close = (ordered[:, 1] - ordered[:, 0] < MARGIN * self.weight.sum()) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, score, close


def fit(docs: DataFrame, language: str = "lang", text: str = "text", key: str = "doc_id",
        calibration: int = CALIBRATION) -> CodeModel | None:
    """A model of the languages of all given rows with a text and a language."""
    rows = docs.select(F.col(language).alias("lang"), F.col(text).alias("text"), F.col(key).alias("id")).filter(
        "lang IS NOT NULL AND text IS NOT NULL")
    counted = (rows.select("lang", "text").mapInArrow(_count("lang"), "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x BUCKETS
    languages = sorted(set(counted["lang"]))
    if not languages:
        return None
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in counted["lang"]], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    odds = np.stack([np.log(share[c].mean(0)) - np.log(share[~c].mean(0)) if (~c).any() else np.zeros(BUCKETS)
                     for c in code.T], 1).astype(np.float32)
    ones = np.ones(code.shape[1])
    model = CodeModel(languages, code, odds, ones, 0 * ones, ones)
    sample = calibration_sample(rows, calibration)
    model.scale, model.shift, model.weight = _scales(sample, model)
    return model


def calibration_sample(rows: DataFrame, per_language: int) -> DataFrame:
    """About `per_language` rows of each language, picked by a hash of the id."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(1_000_003)) / 1_000_003.0
    return rows.filter(draw < share[F.col("lang")])


def _scales(sample: DataFrame, model: CodeModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic scale and shift of each bit from its margins' moments on either side, and its weight."""
    bits = model.code.shape[1]
    held = sample.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS, fixed

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        rows, sums = [], []
        for batch in batches:
            for part, texts in sliced(batch, "text", SLICE):
                margins, has = m.margins(texts.to_pylist())
                lang = part.column(part.schema.get_field_index("lang")).to_pylist()
                rows += [m.languages.index(x) for x, h in zip(lang, has, strict=True) if h]
                sums.append(margins[has])
        if rows:
            every, lang = np.concatenate(sums), np.array(rows)
            for k in np.unique(lang):
                own = every[lang == k]
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array([k], pa.int32()), "n": [len(own)], "s": [own.sum(0).tolist()], "q": [(own ** 2).sum(0).tolist()]})

    schema = "k int, n long, s array<double>, q array<double>"
    parts = sample.select("text", "lang").mapInArrow(moments, schema)
    # one row per language
    merged = parts.select("k", "n", F.posexplode(F.arrays_zip("s", "q")).alias("bit", "x")).groupBy("k", "bit").agg(
        F.sum("n").alias("n"), F.sum("x.s").alias("s"), F.sum("x.q").alias("q")).collect()
    n, s, q = (np.zeros((len(model.languages), bits)) for _ in range(3))
    for r in merged:
        n[r["k"], r["bit"]], s[r["k"], r["bit"]], q[r["k"], r["bit"]] = r["n"], r["s"], r["q"]
    scale, shift, weight = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        on = model.code[:, b]
        if not on.any() or on.all() or not n[on, b].sum() or not n[~on, b].sum():
            continue
        mean = [s[x, b].sum() / n[x, b].sum() for x in (on, ~on)]
        var = [max(q[x, b].sum() / n[x, b].sum() - m * m, 1e-6) for x, m in zip((on, ~on), mean, strict=True)]
        pooled = (var[0] + var[1]) / 2
        scale[b] = max(mean[0] - mean[1], 1e-3) / pooled
        shift[b] = -scale[b] * (mean[0] + mean[1]) / 2
        weight[b] = (mean[0] - mean[1]) ** 2 / pooled
    # short texts spread wider than the mean says: no bit is trusted beyond a bound
    scale, shift = scale / (most := np.maximum(1, np.abs(scale) / 20)), shift / most
    weight = np.sqrt(np.maximum(weight, 1e-6))
    return scale, shift, weight / weight.mean() / max(1, bits / 4)


def predict(docs: DataFrame, model: CodeModel | None, text: str = "text") -> DataFrame:
    """All columns, and lang_pred (string), score (double), ambiguous (boolean)."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "ambiguous": T.BooleanType()}
    kept = [f for f in docs.schema.fields if f.name not in added]
    if model is None:
        return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.lit(UNDETERMINED).alias("lang_pred"),
                           F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part, texts in sliced(batch, text, SLICE):
                margins, has = m.margins(texts.to_pylist())
                best, score, close = m.decode(margins)
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                out["lang_pred"] = pa.array([m.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], pa.string())
                out["score"] = pa.array(np.where(has, score, 0.0), pa.float64())
                out["ambiguous"] = pa.array(close | ~has, pa.bool_())
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added.items()]])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a row without id."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)), F.lit(0))
