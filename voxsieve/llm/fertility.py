"""Quality rules: word rules, and how a public tokeniser copes with the text.

For every text: characters per token, share of byte-fallback tokens, and entropy of its tokens (as a
share of what its length allows). Each language - or script, where no language is given - has bands
for the three, for each length class (a doubling of the token count), since short texts spread wider:
the median of its own texts, SLACK interquartile ranges to either side. A text outside a band is
rejected. Medians and quartiles hardly move while bad texts are a minority.

Whole texts are tokenised, word by word: the vocabulary splits at blanks.

Defined cases: null or empty text has no words, is rejected by the base rule, and has null measures.
A group with fewer than LEAST_GROUP texts takes the bands of all texts of its length class together,
and where those are too few, none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .texts import BLANK, Table, buffers, byte_table, expand, grams, sliced, words

SYMBOLS = byte_table(b"#*$%&|<>")
#: How many interquartile ranges from the median texts are still kept.
SLACK = 3.0
LEAST_GROUP = 50
#: Texts with fewer tokens have no reliable entropy and fertility.
LEAST_TOKENS = 32
#: A worker forgets its words beyond this number.
MAX_WORDS = 400_000

SCRIPTS = ((0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x590, 0x5FF, "hebrew"), (0x600, 0x6FF, "arabic"),
           (0x900, 0x97F, "devanagari"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"))


class Pieces:
    """A SentencePiece vocabulary with the words met so far: tokens per word, and which are byte fallback.

    The vocabulary splits at blanks first, so a text's tokens are its words' tokens.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.known, self.n = Table(1 << 16), 0
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def index(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word."""
        out = self.known.get(keys)
        if (out < 0).any():
            fresh, first = np.unique(keys[out < 0], return_index=True)
            at = np.flatnonzero(out < 0)[first]
            if self.n + len(fresh) > MAX_WORDS:
                self.forget()
                fresh, at = np.unique(keys, return_index=True)
            raw = data.tobytes()
            spelt = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            ids = self.model.encode(spelt, num_threads=1)
            n = np.array([len(i) for i in ids], np.int64)
            flat = np.array([t for i in ids for t in i], np.int32)
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.n + len(n) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.flat[self.used:self.used + len(flat)] = flat
            self.starts[self.n:self.n + len(n)] = self.used + np.cumsum(n) - n
            self.lengths[self.n:self.n + len(n)] = n
            self.known.put(fresh, np.arange(self.n, self.n + len(n)))
            self.used, self.n = self.used + len(flat), self.n + len(n)
            out = self.known.get(keys)
        return out.astype(np.int64)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def script_of(text: str) -> str:
    """The script of most letters, from evenly spread characters of the whole text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    best, most = "latin", int((((cp | 0x20) >= 97) & ((cp | 0x20) <= 122)).sum() + ((cp >= 0xC0) & (cp <= 0x24F)).sum())
    for low, high, name in SCRIPTS:
        n = int(((cp >= low) & (cp <= high)).sum())
        if n > most:
            best, most = name, n
    return best


MEASURES = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
            "n_repeat_words": T.LongType(), "n_tokens": T.LongType(), "chars_per_token": T.DoubleType(),
            "byte_share": T.DoubleType(), "token_entropy": T.DoubleType(), "script": T.StringType()}


def _word_measures(found, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points in words, and words in three-word windows that occur twice or more, of each row."""
    first_byte = (found.data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(first_byte)])
    chars = np.bincount(found.rows, weights=total[found.ends] - total[found.starts], minlength=n).astype(np.int64)
    repeats = np.zeros(n, np.int64)
    three = grams(hashes, 3)
    if len(three):
        same = found.rows[:len(three)] == found.rows[2:]
        at = np.flatnonzero(same)
        key = grams(np.stack([three[at], found.rows[at].astype(np.uint64)], 1).ravel(), 2)[::2]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        twin = np.zeros(len(key), bool)
        equal = ordered[1:] == ordered[:-1]
        twin[order[1:][equal]] = True
        twin[order[:-1][equal]] = True
        inside = np.zeros(len(hashes), bool)
        for k in range(3):
            inside[at[twin] + k] = True
        repeats = np.bincount(found.rows[inside], minlength=n)
    return chars, repeats


def _duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


def measure(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, and MEASURES."""
    kept = [f for f in docs.schema.fields if f.name not in MEASURES and f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for part, texts in sliced(batch, text):
                n = len(texts)
                found = words(texts, BLANK)
                hashes = found.hashes()
                chars, repeats = _word_measures(found, hashes, n)
                data, at = buffers(texts)
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
                index = p.index(hashes, found.data, found.starts, found.ends)
                per_word = p.lengths[index]
                tokens = expand(p.flat, p.starts[index], per_word)
                n_tokens = np.bincount(found.rows, weights=per_word, minlength=n).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(n_tokens)])
                byte = np.concatenate([[0], np.cumsum(p.byte[tokens])])
                entropy = np.zeros(n)
                for r in range(n):
                    own = tokens[bounds[r]:bounds[r + 1]]
                    if len(own) > 1:
                        c = np.bincount(own)
                        share = c[c > 0] / len(own)
                        entropy[r] = -(share * np.log2(share)).sum() / np.log2(len(own))
                spelt = texts.to_pylist()
                some = np.maximum(n_tokens, 1)
                none = n_tokens == 0
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                out |= {
                    "n_words": pa.array(found.counts(), pa.int64()), "word_chars": pa.array(chars),
                    "n_symbols": pa.array(symbols[at[1:]] - symbols[at[:-1]], pa.int64()),
                    "n_dup_lines": pa.array([_duplicate_lines(t) for t in spelt], pa.int64()),
                    "n_repeat_words": pa.array(repeats, pa.int64()), "n_tokens": pa.array(n_tokens),
                    "chars_per_token": pa.array(chars / some, pa.float64(), mask=none),
                    "byte_share": pa.array((byte[bounds[1:]] - byte[bounds[:-1]]) / some, pa.float64(), mask=none),
                    "token_entropy": pa.array(entropy, pa.float64(), mask=none),
                    "script": pa.array([script_of(t) for t in spelt])}
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([*kept, *[T.StructField(k, v) for k, v in MEASURES.items()]])
    return docs.mapInArrow(run, schema)


RULES = ("chars_per_token", "byte_share", "token_entropy")


#: Columns of a run; inputs don't have their names.
BAND, WIDE = "_fertility_band", "_fertility_wide_band"


def bands(measured: DataFrame, slack: float = SLACK) -> DataFrame:
    """band (language or script, or *, and length class), and the lowest and highest accepted value of each measure."""
    long_ = measured.filter(F.col("n_tokens") >= LEAST_TOKENS)
    both = long_.select(F.explode(F.array(BAND, WIDE)).alias("band"), *RULES)
    cuts = both.groupBy("band").agg(
        F.count("*").alias("n"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in RULES])
    limits = []
    for m in RULES:
        width = slack * F.greatest(F.col(m)[2] - F.col(m)[0], F.lit(0.005))
        limits += [(F.col(m)[1] - width).alias(f"{m}_low"), (F.col(m)[1] + width).alias(f"{m}_high")]
    return cuts.filter(F.col("n") >= LEAST_GROUP).select("band", *limits)


def quality_rules(docs: DataFrame, path: str, text: str = "text", language: str | None = "lang", slack: float = SLACK) -> DataFrame:
    """All columns but the text, MEASURES, base_failed, rejected_by (the measure out of its band) and kept."""
    group = F.coalesce(F.col(f"`{language}`"), F.col("script")) if language else F.col("script")
    length = F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("string")
    measured = stored(measure(docs, path, text).withColumns({
        BAND: F.concat_ws("|", group, length), WIDE: F.concat_ws("|", F.lit("*"), length)}), "measured")
    rows = bands(measured, slack).collect()  # languages x length classes
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(None).cast("string")
    for m in RULES if rows else ():
        limits = F.create_map(*[x for r in rows for x in (
            F.lit(r["band"]), F.struct(F.lit(r[f"{m}_low"]).alias("low"), F.lit(r[f"{m}_high"]).alias("high")))])
        mine = F.coalesce(limits[F.col(BAND)], limits[F.col(WIDE)])
        beyond = (F.col("n_tokens") >= LEAST_TOKENS) & ((F.col(m) < mine["low"]) | (F.col(m) > mine["high"]))
        rejected = F.coalesce(rejected, F.when(beyond, F.lit(m)))
    return (measured.withColumn("base_failed", base).withColumn("rejected_by", rejected)
            .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop(BAND, WIDE))
