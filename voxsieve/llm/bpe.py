"""BPE encoding by speculation: greedy longest-match proposes, pair checks verify, failures are merged.

For each word that is new to a worker, the longest vocabulary entries from left to right are proposed.
A sequence of tokens is what the merges give exactly if every adjacent pair of it is, so all adjacent
pairs are tested at once, by undoing merges on both sides of the border. Only words with a failing
pair are merged rank by rank. Words, their hashes and tokens are arrays; no Python object per word.

Null text counts as empty: no tokens. Repeated rows are encoded alike. Columns of the input pass
through; outputs overwrite input columns of the same name.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .texts import Table, expand, mix, powers, sliced, span_hashes

MAX_RANK = np.int64(1) << 40
#: Words longer than this many bytes are merged with a heap instead of in matrices.
LONG_WORD = 48
#: A worker forgets its words beyond this number, so its memory stays bounded.
MAX_WORDS = 300_000

# The split of the published vocabulary, and Unicode white space.
SPACE = r"[\t-\r \x85\xa0  -     　]"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}\t-\r \x85\xa0  -     　]+"

LETTER, NUMBER, BLANK, OTHER, SLOW = range(5)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


@lru_cache
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the code points that need no normalisation; others are SLOW."""
    kind, lower = np.full(0x3000, SLOW, np.uint8), np.arange(0x3000, dtype=np.int32)
    for c in [*range(0x300), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        s = chr(c)
        low = s.lower()
        if len(low) > 1 or unicodedata.normalize("NFC", s) != s:
            continue
        lower[c] = ord(low)
        group = unicodedata.category(low)[0]
        kind[c] = BLANK if re.match(SPACE, s) else {"L": LETTER, "N": NUMBER}.get(group, OTHER)
    return kind, lower


def utf8(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of spans of code points below 65,536, and the byte count of each span."""
    c = expand(codes, starts, sizes)
    n = 1 + (c >= 0x80) + (c >= 0x800)
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    out[at] = np.where(n == 1, c, np.where(n == 2, 0xC0 | c >> 6, 0xE0 | c >> 12))
    two, three = n == 2, n == 3
    out[at[two] + 1] = 0x80 | c[two] & 0x3F
    out[at[three] + 1], out[at[three] + 2] = 0x80 | c[three] >> 6 & 0x3F, 0x80 | c[three] & 0x3F
    per = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(sizes)
    return out, per[ends] - per[ends - sizes]


class Bpe:
    """A word-end BPE vocabulary with ids in merge order, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.n = max(names) + 1
        shown = [(names.get(i, "") + " ").encode() for i in range(self.n)]
        self.shown_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_lengths = np.array([len(s) for s in shown])
        self.shown_starts = np.cumsum(self.shown_lengths) - self.shown_lengths
        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in characters], np.int32)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        if not (np.diff(made) > 0).all():
            raise ValueError("ids must be in merge order")
        self.pairs = Table(4 * len(merges))
        self.pairs.put(mix((left * self.n + right).astype(np.uint64)), made)
        self.split_left, self.split_right = np.arange(self.n), np.arange(self.n)
        self.split_left[made], self.split_right[made] = left, right
        back = {c: b for b, c in enumerate(characters)}
        entries = []
        for name, i in vocab.items():
            end = name.endswith(self.suffix) and name != self.suffix
            raw = bytes(back[c] for c in (name[:-len(self.suffix)] if end else name))
            entries.append((raw, end, i))
        self.longest = max(len(raw) for raw, _, _ in entries)
        flat = np.frombuffer(b"".join(raw for raw, _, _ in entries), np.uint8)
        ends = np.cumsum([len(raw) for raw, _, _ in entries])
        starts = ends - [len(raw) for raw, _, _ in entries]
        keys = span_hashes(flat, starts, ends)
        final = np.array([end for _, end, _ in entries])
        self.entries = Table(4 * len(entries))
        self.entries.put(np.where(final, ~keys, keys), np.array([i for _, _, i in entries]))
        # an entry that its own bytes don't merge to is never proposed alone without a check
        got = self.merge([raw + (b"" if end else b"\0") for raw, end, _ in entries], [end for _, end, _ in entries])
        self.whole = np.zeros(self.n, bool)
        for (_, _, i), tokens in zip(entries, got, strict=True):
            self.whole[i] = len(tokens) == 1 and tokens[0] == i
        self.forget()

    def forget(self) -> None:
        self.known = Table(1 << 16)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.n_known = 0
        # the keys that stand for special tokens
        self._remember(np.arange(1, len(self.special) + 1, dtype=np.uint64),
                       np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    # --- proposing, checking, merging ---

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that a pair merges to, MAX_RANK if none."""
        got = self.pairs.get(mix((left.astype(np.int64) * self.n + right).astype(np.uint64))).astype(np.int64)
        return np.where(got < 0, MAX_RANK, got)

    def propose(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of each padded byte row, and their number."""
        n, width = rows.shape
        up, down = powers(width + 1)
        from .texts import _CODES
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_CODES[rows] * up[:-1], axis=1, out=sums[:, 1:])
        out, count = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        at, active = np.zeros(n, np.int64), np.arange(n)
        while len(active):
            left = active
            for size in range(min(self.longest, int((lengths[active] - at[active]).max())), 0, -1):
                fits = left[lengths[left] - at[left] >= size]
                begin = at[fits]
                key = mix((sums[fits, begin + size] - sums[fits, begin]) * down[begin] + np.uint64(size))
                key = np.where(begin + size == lengths[fits], ~key, key)
                token = self.entries.get(key)
                hit = token >= 0
                found = fits[hit]
                out[found, count[found]] = token[hit]
                count[found] += 1
                at[found] += size
                done = np.zeros(n, bool)
                done[found] = True
                left = left[~done[left]]
                if not len(left):
                    break
            active = active[at[active] < lengths[active]]
        return out, count

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges keep the border between the two tokens of each pair."""
        a, b = left.astype(np.int64), right.astype(np.int64)
        limit = np.full(len(a), MAX_RANK)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            crossed = self.rank(x, y) < most  # a merge across the border comes first
            ok[live[crossed]] = False
            on = ~crossed
            live, x, y = live[on], x[on], y[on]
            # undo the later of the two merges; a single byte cannot be undone
            take = x > y
            half = np.where(take, self.split_right[x], x)
            stuck = take & (half == x)
            other = ~take | stuck
            low = np.where(other, self.split_left[y], y)
            stuck_y = other & (low == y)
            also = stuck_y & ~stuck  # the right one is a byte: undo the left one after all
            half = np.where(also, self.split_right[x], half)
            end = (stuck & stuck_y) | (also & (half == x))
            most = np.where((take & ~stuck) | also, x, y + 1)
            a[live], b[live], limit[live] = half, low, most
            live = live[~end]
        return ok

    def merge_rows(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges each padded row of symbols in rank order; returns the lengths, rows in place."""
        lengths = lengths.copy()
        cols = np.arange(symbols.shape[1])
        active = np.flatnonzero(lengths > 1)
        while len(active):
            part = symbols[active]
            rank = self.rank(part[:, :-1], part[:, 1:])
            rank[cols[:-1] >= lengths[active, None] - 1] = MAX_RANK
            j = rank.argmin(1)
            best = rank[np.arange(len(active)), j]
            on = best < MAX_RANK
            active, part, j, best = active[on], part[on], j[on], best[on]
            moved = np.concatenate([part[:, 1:], part[:, -1:]], 1)
            part = np.where(cols > j[:, None], moved, part)
            part[np.arange(len(active)), j] = best
            symbols[active] = part
            lengths[active] -= 1
            active = active[lengths[active] > 1]
        return lengths

    def merge_long(self, raw: bytes) -> list[int]:
        """The same merges for one long word, with a heap of candidate pairs."""
        ids = [int(self.inner[b]) for b in raw[:-1]] + [int(self.last[raw[-1]])]
        nxt, prev = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:])) if len(ids) > 1 else []
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < MAX_RANK]
        heapq.heapify(heap)
        while heap:
            made, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if j < 0 or ids[i] != x or ids[j] != y:
                continue
            ids[i], ids[j], nxt[i] = made, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0:
                    r = int(self.rank(np.array([ids[p]]), np.array([ids[q]]))[0])
                    if r < MAX_RANK:
                        heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def merge(self, raws: list[bytes], final: list[bool]) -> list[list[int]]:
        """Exact merges of byte strings; where `final` is false the last byte is a stand-in and is not used."""
        lengths = np.array([len(r) if end else len(r) - 1 for r, end in zip(raws, final, strict=True)])
        symbols = np.zeros((len(raws), int(lengths.max()) + 1), np.int64)
        for i, (raw, end) in enumerate(zip(raws, final, strict=True)):
            own = self.inner[np.frombuffer(raw, np.uint8)[:lengths[i]]]
            if end:
                own[-1] = self.last[raw[-1]]
            symbols[i, :lengths[i]] = own
        lengths = self.merge_rows(symbols, lengths)
        return [symbols[i, :k].tolist() for i, k in enumerate(lengths)]

    def learn(self, keys: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> None:
        """Encodes words that are new to this worker, given as UTF-8 bytes one after the other."""
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        begin = 0
        while begin < len(order):
            # words of like lengths together, so that rows are hardly padded
            width = int(sizes[order[begin]])
            width = width if width > LONG_WORD else min(LONG_WORD, -(-width // 4) * 4)
            end = max(begin + 1, int(np.searchsorted(sizes[order], width, side="right")))
            if width > LONG_WORD:
                pick = order[begin:begin + 1]
                tokens = self.merge_long(expand(data, begins[pick], sizes[pick]).tobytes())
                self._remember(keys[pick], np.array(tokens, np.int32), np.array([len(tokens)]))
                begin += 1
                continue
            pick = order[begin:min(end, begin + 50_000)]
            begin += len(pick)
            lengths = sizes[pick]
            rows = np.zeros((len(pick), width), np.uint8)
            inside = np.arange(width) < lengths[:, None]
            rows[inside] = expand(data, begins[pick], lengths)
            tokens, count = self.propose(rows, lengths)
            single = np.flatnonzero(count == 1)
            bad = np.zeros(len(pick), bool)
            bad[single] = ~self.whole[tokens[single, 0]]
            r, c = np.nonzero(np.arange(width - 1) < count[:, None] - 1)
            pair_ok = self.compatible(tokens[r, c], tokens[r, c + 1])
            bad[r[~pair_ok]] = True
            if bad.any():
                redo = np.flatnonzero(bad)
                symbols = self.inner[rows[redo]].astype(np.int64)
                n = lengths[redo]
                symbols[np.arange(len(redo)), n - 1] = self.last[rows[redo, n - 1]]
                count[redo] = self.merge_rows(symbols, n)
                tokens[redo] = symbols
            self._remember(keys[pick], tokens[np.arange(width) < count[:, None]], count)

    def _remember(self, keys: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(tokens) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n_known + len(keys) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        new = slice(self.n_known, self.n_known + len(keys))
        self.flat[self.used:self.used + len(tokens)] = tokens
        self.starts[new], self.lengths[new] = self.used + np.cumsum(lengths) - lengths, lengths
        self.known.put(keys, np.arange(new.start, new.stop))
        self.used += len(tokens)
        self.n_known = new.stop

    # --- texts ---

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text in any script; special tokens as their ids."""
        out: list[str | int] = []
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            plain = re.sub(SPACE + "+", " ", unicodedata.normalize("NFC", part))
            out += regex.findall(SPLIT, "".join(c.lower() for c in plain))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and the number of each text's."""
        kind_of, lower_of = code_points()
        sizes = np.array([len(t) for t in texts])
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        kind = np.where(cp < len(kind_of), kind_of[np.minimum(cp, len(kind_of) - 1)], SLOW).astype(np.uint8)
        row_of_slow = np.searchsorted(ends, np.flatnonzero(kind == SLOW), side="right")
        slow = np.zeros(len(texts), bool)
        slow[row_of_slow] = True
        for i, t in enumerate(texts):
            if "<|" in t and any(s in t for s in self.special):
                slow[i] = True
        codes = lower_of[np.minimum(cp, len(lower_of) - 1)]
        starts, stops, rows = self._fast_words(codes, kind, ends, sizes, slow)
        keys = span_hashes(codes, starts, stops) | np.uint64(1 << 32)
        index = self._index(keys, lambda i: utf8(codes, starts[i], stops[i] - starts[i]))
        if slow.any():
            index, rows = self._slow_words(texts, slow, index, rows)
        per_word = self.lengths[index]
        counts = np.bincount(rows, weights=per_word, minlength=len(texts)).astype(np.int64)
        return expand(self.flat, self.starts[index], per_word), counts

    def _fast_words(self, codes, kind, ends, sizes, slow):
        n = len(codes)
        kind = kind.copy()
        if slow.any():
            kind[np.repeat(slow, sizes)] = BLANK
        border = np.ones(n + 1, bool)
        border[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        border[ends[ends < n]] = True
        at = np.flatnonzero(border[:-1]) if n else np.zeros(0, np.int64)
        stop = np.append(at[1:], n) if n else at
        on = kind[at] != BLANK if n else np.zeros(0, bool)
        starts, stops = at[on], stop[on]
        rows = np.searchsorted(ends, starts, side="right")
        # an apostrophe alone before letters takes s, t, m, d, re, ve or ll with it
        quote = np.flatnonzero((codes[starts] == 39) & (stops - starts == 1)) if n else np.zeros(0, np.int64)
        quote = quote[quote + 1 < len(starts)]
        nxt = quote + 1
        meets = (starts[nxt] == stops[quote]) & (rows[nxt] == rows[quote]) & (kind[starts[nxt]] == LETTER)
        quote, nxt = quote[meets], nxt[meets]
        one = codes[starts[nxt]]
        two = np.where(stops[nxt] - starts[nxt] > 1, codes[np.minimum(starts[nxt] + 1, n - 1)], 0) if n else one
        took = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1,
                        np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
                                 | (one == ord("l")) & (two == ord("l")), 2, 0))
        stops[quote] += took
        starts[nxt] += took
        full = stops > starts
        return starts[full], stops[full], rows[full]

    def _index(self, keys: np.ndarray, raw_of) -> np.ndarray:
        index = self.known.get(keys)
        if (index < 0).any():
            fresh, first = np.unique(keys[index < 0], return_index=True)
            where = np.flatnonzero(index < 0)[first]
            if self.n_known + len(fresh) > MAX_WORDS:
                self.forget()
                fresh, where = np.unique(keys, return_index=True)
            self.learn(fresh, *raw_of(where))
            index = self.known.get(keys)
        return index.astype(np.int64)

    def _slow_words(self, texts, slow, index, rows):
        found, owner = [], []
        for i in np.flatnonzero(slow):
            own = self.pieces(texts[i])
            found += own
            owner += [i] * len(own)
        kinds = {s: k + 1 for k, s in enumerate(self.special.values())}
        joined = "".join(w if isinstance(w, str) else "\0" for w in found)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) if isinstance(w, str) else 1 for w in found], np.int64)
        ends = np.cumsum(sizes)
        # code points above the hash's range are taken in two parts
        halves = np.stack([cps & 0xFFFF, np.where(cps > 0xFFFF, cps >> 16, 0xFFFF)], 1).ravel()
        wide = np.zeros(len(found), bool)
        wide[np.searchsorted(ends, np.flatnonzero(cps > 0xFFFF), side="right")] = True
        keys = np.where(wide, ~span_hashes(halves, 2 * (ends - sizes), 2 * ends),
                        span_hashes(cps & 0xFFFF, ends - sizes, ends)) | np.uint64(1 << 32)
        special = np.array([0 if isinstance(w, str) else kinds[w] for w in found], np.uint64)
        keys = np.where(special > 0, special, keys)
        before = self.n_known
        raw = [w.encode("utf-8", "replace") if isinstance(w, str) else b"" for w in found]
        own = self._index(keys, lambda i: (
            np.frombuffer(b"".join(raw[k] for k in i), np.uint8), np.array([len(raw[k]) for k in i])))
        if self.n_known < before:  # the worker has forgotten its words meanwhile
            return self._slow_only(texts)
        index = np.concatenate([index, own])
        rows = np.concatenate([rows, np.array(owner, np.int64)])
        order = np.argsort(rows, kind="stable")
        return index[order], rows[order]

    def _slow_only(self, texts):
        """All texts of the slice by the general splitter, after the words were forgotten."""
        none = np.zeros(0, np.int64)
        return self._slow_words(texts, np.ones(len(texts), bool), none, none)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The shown tokens of each text, with a blank between them, as UTF-8."""
        lengths = self.shown_lengths[ids]
        every = expand(self.shown_bytes, self.shown_starts[ids], lengths)
        per_id = np.concatenate([[0], np.cumsum(lengths)])
        at = per_id[np.concatenate([[0], np.cumsum(counts)])]
        raw = every.tobytes()
        return [raw[a:max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False, drop_text: bool = True) -> DataFrame:
    """Adds n_tokens (long) and token_bytes (ids as little-endian unsigned 32-bit integers).

    With `decoded`, also the text that the ids decode to. Reads whole texts in slices of a few MB.
    """
    added = [("n_tokens", T.LongType()), ("token_bytes", T.BinaryType())] + [("decoded", T.StringType())] * decoded
    names = {n for n, _ in added} | ({text} if drop_text else set())
    kept = [f for f in df.schema.fields if f.name not in names]
    source = text
    if text not in df.columns:
        raise ValueError(f"no column {text}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part, texts in sliced(batch, source):
                ids, counts = bpe.encode(texts.to_pylist())
                raw = ids.astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(counts)]) * 4
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                out["n_tokens"] = pa.array(counts, pa.int64())
                out["token_bytes"] = pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                if decoded:
                    out["decoded"] = pa.array([d.decode() for d in bpe.decode(ids, counts)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in added]])
    read = df.select(*[F.col(f"`{f.name}`") for f in kept], *([F.col(f"`{text}`")] if drop_text else []))
    return read.mapInArrow(run, schema)
