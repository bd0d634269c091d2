"""Line dedup: later repeats of runs of lines are deleted, found by winnowing over line hashes.

A window is the shortest run of whole lines, from a given line on or up to a given line, that holds
`min_words` words; it depends on its own lines alone. Each window's smallest line hash is selected as
a fingerprint, so every repeated run of `min_words` words or more shares a fingerprint in all its
copies (the winnowing guarantee). Neighbouring windows mostly select the same position, so there are
far fewer fingerprints than windows, and a fingerprint that is selected at one position only belongs to
no repeat: its windows go no further. At the positions of the others the windows around them are joined,
and those that are not the first of their content mark their lines. Windows start at every line and end at
every line, so the marked lines reach as far to both sides as the repeat does. Marked lines are deleted.

Result per row, whatever the order of rows: a line is deleted if and only if it lies in a run of
lines with `min_words` words or more that occurs earlier, by (id, line number). Lines are equal if
their words are; lines without words belong to any run around them and are deleted with it only if
they lie between deleted lines of one window.

Defined cases: null text stays null and has no lines; an empty text is one line without words. Rows
with an equal id are told apart by their content's hash, and equal rows stand at one place: they
keep or lose the same lines. Rows without id come after all others and are kept as they are unless
they repeat another row's lines. Of equal line hashes in a window the first is selected. Texts are read
whole, whatever their length. Columns named like the added ones are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.scratch import stored
from .texts import sliced

MIN_WORDS = 50


def split_lines(text: str) -> tuple[list[str], list[bytes], np.ndarray]:
    """Lines, the words of each joined by one blank, and their number."""
    lines = text.split("\n")
    found = [line.encode().split() for line in lines]
    return lines, [b" ".join(w) for w in found], np.array([len(w) for w in found], np.int64)


def line_digests(lines: list[bytes]) -> list[bytes]:
    return [hashlib.blake2b(x, digest_size=16).digest() for x in lines]


def row_digest(digests: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(digests), digest_size=8).digest()


def windows(counts: np.ndarray, min_words: int) -> np.ndarray:
    """(first, last) line of each window, forward and backward ones once each, in order."""
    total = np.concatenate([[0], np.cumsum(counts)])
    has = np.flatnonzero(counts > 0)
    last = np.searchsorted(total, total[has] + min_words) - 1  # forward: up to the line that completes it
    on = last < len(counts)
    forward = np.stack([has[on], last[on]], 1)
    # backward: from the last line on that still leaves enough words
    first = np.searchsorted(total, total[has + 1] - min_words, side="right") - 1
    back = total[has + 1] >= min_words
    backward = np.stack([first[back], has[back]], 1)
    both = np.concatenate([forward, backward])
    return np.unique(both, axis=0) if len(both) else both.reshape(0, 2)


def _window_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                rows, key, print_, at_, content, first, last = [], [], [], [], [], [], []
                for r, text in enumerate(texts.to_pylist()):
                    _, lines, counts = split_lines(text)
                    spans = windows(counts, min_words)
                    if not len(spans):
                        continue
                    digests = line_digests(lines)
                    worded = [k for k, n in enumerate(counts) if n]
                    at = np.searchsorted(worded, spans)  # lines without words don't count
                    own = [digests[k] for k in worded]
                    whole = row_digest(digests)
                    for (a, b), (i, j) in zip(spans.tolist(), at.tolist(), strict=True):
                        inside = own[i:j + 1]
                        least = min(inside)
                        at_.append(i + inside.index(least))
                        rows.append(r)
                        key.append(whole)
                        print_.append(int.from_bytes(least[:8], "little", signed=True))
                        content.append(hashlib.blake2b(b"".join(inside), digest_size=16).digest())
                        first.append(a)
                        last.append(b)
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0).take(taken), "h": part.column(2).take(taken), "at": pa.array(at_, pa.int32()), "row_key": pa.array(key, pa.binary()), "print": pa.array(print_, pa.int64()),
                    "content": pa.array(content, pa.binary()), "first": pa.array(first, pa.int32()),
                    "last": pa.array(last, pa.int32())})
    return run


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, h, row_key, first, last) of windows whose content occurs earlier; h is a hash of the whole text."""
    found = stored(
        docs.select("id", "text", F.xxhash64("text").alias("h")).filter(F.col("text").isNotNull())
        .mapInArrow(_window_rows(min_words),
                    "id long, h long, at int, row_key binary, print long, content binary, first int, last int"), "windows")
    place = F.struct(F.col("id").isNull().alias("x"), "id", "row_key", "first", "last")
    # a fingerprint that is selected at one position only cannot repeat
    position = F.struct(F.col("id").isNull().alias("x"), "id", "row_key", "at")
    prints = stored(
        found.groupBy("print").agg(F.min(position).alias("a"), F.max(position).alias("b"))
        .filter("a <> b").select("print"), "prints")
    # the same plan at every size: small tables are not broadcast
    shared = found.join(prints.hint("merge"), "print", "left_semi")
    earliest = stored(shared.groupBy("content").agg(F.min(place).alias("at"), F.count("*").alias("n")), "earliest")
    # all but the first of each content; the join key holds the place, so a common run is no hot key
    firsts = earliest.select("content", F.col("at.id").alias("id"), "at.row_key", "at.first", "at.last")
    later = shared.alias("s").join(
        firsts.alias("f").hint("merge"),
        F.col("s.id").eqNullSafe(F.col("f.id")) & (F.col("s.row_key") == F.col("f.row_key"))
        & (F.col("s.first") == F.col("f.first")) & (F.col("s.last") == F.col("f.last"))
        & (F.col("s.content") == F.col("f.content")), "left_anti")
    return later.select("id", "h", "row_key", "first", "last")


OUTPUT = (("n_lines", T.LongType()), ("n_removed_lines", T.LongType()), ("n_removed_words", T.LongType()),
          ("text", T.StringType()))


def _remove(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "_text"):
                nulls = part.column(part.schema.get_field_index("_text")).is_null().to_pylist()
                marks = part.column(part.schema.get_field_index("_marks")).to_pylist()
                n, removed, dropped, out = [], [], [], []
                for text, null, spans in zip(texts.to_pylist(), nulls, marks, strict=True):
                    if null:
                        n.append(0), removed.append(0), dropped.append(0), out.append(None)
                        continue
                    lines = text.split("\n")
                    gone = np.zeros(len(lines), bool)
                    own = row_digest(line_digests(split_lines(text)[1])) if spans else None
                    for mark in spans or []:
                        if mark["row_key"] == own:
                            for span in mark["spans"]:
                                gone[span["first"]:span["last"] + 1] = True
                    n.append(len(lines))
                    removed.append(int(gone.sum()))
                    dropped.append(sum(len(x.encode().split()) for x, g in zip(lines, gone, strict=True) if g) if gone.any() else 0)
                    out.append("\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if gone.any() else text)
                result = {c: part.column(part.schema.get_field_index(c)) for c in kept}
                result |= {"n_lines": pa.array(n, pa.int64()), "n_removed_lines": pa.array(removed, pa.int64()),
                           "n_removed_words": pa.array(dropped, pa.int64()), "text": pa.array(out, pa.string())}
                yield pa.RecordBatch.from_pydict(result)
    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, `text` without the deleted lines, and n_lines, n_removed_lines, n_removed_words."""
    kept = [c for c in docs.columns if c not in {n for n, _ in OUTPUT} | {text}]
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    marks = repeated_windows(plain, min_words).groupBy("id", "h", "row_key").agg(
        F.collect_set(F.struct("first", "last")).alias("_spans"))
    # with the hash, so that rows without id are not one key
    per_row = marks.groupBy("id", "h").agg(F.collect_list(F.struct("row_key", F.col("_spans").alias("spans"))).alias("_marks"))
    joined = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in kept], F.col(f"`{text}`").alias("_text"),
                         F.col(f"`{key}`").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    joined = joined.join(per_row.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    joined = joined.drop("id", "_id", "h", "_h")
    columns = [f"k_{c}" for c in kept]
    fields = [T.StructField(f"k_{c}", docs.schema[c].dataType) for c in kept]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in OUTPUT]])
    out = joined.mapInArrow(_remove(columns), schema)
    return out.select(*[F.col(f"`k_{c}`").alias(c) for c in kept], *[n for n, _ in OUTPUT])
