"""Licence scans with a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template. A text's words are streamed through it,
which gives at each word the longest run ending there that some template contains (matching
statistics). Long matches of one template are chained in template order into covered spans. Fixed
phrases are found by the same walk: a phrase ends where the matched run has it as its end.

Most words of a text stand in no template; the stream is cut to the stretches whose neighbouring
words are neighbours in some template (looked up for all words at once), which changes no match of
two words or more.

Defined cases: null or empty text has no words, no labels and score 0. The score is the largest
share of a template that a chain covers, or 1 / (1 + words of the shortest template) at least where
only a phrase was found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .texts import NOT_ALNUM, Table, grams, mix, sliced, text_hash, words

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licences, as their publishers give them.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mit-notice": "Licensed under the MIT License.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "bsd-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means.""",
    "boost-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom
the Software is furnished to do so, all subject to the following:""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-notice": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a
copy of this license, visit http://creativecommons.org/licenses/by/4.0/""",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights": "All rights reserved. No part of this publication may be reproduced without permission.",
}

#: Words that a match has at least to enter a chain, and the share of a template that a chain covers at least.
LEAST_MATCH = 4
LEAST_SHARE = 0.5


@dataclass
class Automaton:
    """States of the generalised suffix automaton; state 0 is the empty run."""

    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    ends: list[dict[int, list[int]]]
    phrases: list[list[int]]
    word_of: Table
    pairs: Table
    sizes: list[int]
    labels: list[str]
    n_templates: int


def _tokens(text: str) -> list[str]:
    found = words(pa.array([text]), NOT_ALNUM, lower=True)
    return [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)]


@lru_cache
def automaton() -> Automaton:
    """Over all templates, then all phrases."""
    runs = [_tokens(t) for t in TEMPLATES.values()] + [p.split() for p in PHRASES]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for r in runs for w in r))}
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    ends: list[dict[int, list[int]]] = [{}]

    def clone(p: int, q: int, w: int) -> int:
        new = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), ends.append(dict(ends[q]))
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def extend(last: int, w: int) -> int:
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else clone(last, q, w)
        new = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1), ends.append({})
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q, w)
        return new

    for r in runs:
        last = 0
        for w in r:
            last = extend(last, vocabulary[w])
    phrases: list[list[int]] = [[] for _ in nxt]
    for t, r in enumerate(runs):
        state = 0
        for k, w in enumerate(r):
            state = nxt[state][vocabulary[w]]
            s = state
            while s > 0:  # the position, for every run that ends there
                ends[s].setdefault(t, []).append(k + 1)
                s = link[s]
        if t >= len(TEMPLATES):
            phrases[state].append(t - len(TEMPLATES))
    # what ends in a shorter run ends in the longer ones too
    for s in sorted(range(1, len(nxt)), key=length.__getitem__):
        phrases[s] = phrases[s] + [p for p in phrases[link[s]] if p not in phrases[s]]
    hashes = np.array([text_hash(w) for w in vocabulary], np.uint64)
    word_of = Table(4 * len(vocabulary))
    word_of.put(hashes, np.arange(len(vocabulary)))
    both = np.unique(np.concatenate([grams(hashes[[vocabulary[w] for w in r]], 2) for r in runs if len(r) > 1]))
    pairs = Table(4 * len(both))
    pairs.put(both, np.arange(len(both)))
    return Automaton(nxt, link, length, ends, phrases, word_of, pairs, [len(r) for r in runs],
                     [*TEMPLATES, *PHRASES.values()], len(TEMPLATES))


def stream(a: Automaton, ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(word number, state, length of the longest match) at each word."""
    state = size = 0
    for k, w in enumerate(ids):
        while state and w not in a.next[state]:
            state = a.link[state]
            size = a.length[state]
        state = a.next[state].get(w, 0)
        size = size + 1 if state else 0
        yield k, state, size


def chain(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The chain of most words among matches (first word, template start, words) of one template, in the
    order of text and template; overlaps count once.

    Neighbours of a chain are at most four times as far apart in the text as in the template, and 20 words more.
    So only matches within that reach of the whole template are looked back at, however long the text is.
    """
    matches = sorted(set(matches))
    best: list[int] = []
    before: list[int] = []
    reach, low = 4 * max(start for _, start, _ in matches) + 20, 0
    for i, (at, start, n) in enumerate(matches):
        best.append(n), before.append(-1)
        while at - matches[low][0] > reach:
            low += 1
        for j in range(low, i):
            p, q, m = matches[j]
            over = max(0, p + m - at, q + m - start)
            if p < at and q < start and over < n and at - p <= 4 * (start - q) + 20 and best[j] + n - over > best[i]:
                best[i], before[i] = best[j] + n - over, j
    out, i = [], max(range(len(matches)), key=best.__getitem__)
    while i >= 0:
        out.append(matches[i])
        i = before[i]
    return out[::-1]


def scan_words(a: Automaton, stretches: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int, float]]]:
    """Phrase places as (first word, phrase), and per template the covered span (first, last word, share)."""
    places: list[tuple[int, int]] = []
    found: dict[int, list[tuple[int, int, int]]] = {}
    for begin, ids in stretches:
        steps = list(stream(a, ids))
        for k, state, size in steps:
            for p in a.phrases[state]:
                n = a.sizes[a.n_templates + p]
                if n <= size:
                    places.append((begin + k - n + 1, p))
            # a match that the next word does not lengthen
            last = k + 1 == len(steps) or steps[k + 1][2] <= size
            if last and size >= LEAST_MATCH:
                for t, ends in a.ends[state].items():
                    if t < a.n_templates:
                        found.setdefault(t, []).extend((begin + k - size + 1, end - size, size) for end in ends)
    spans = {}
    for t, matches in found.items():
        links = chain(matches)
        covered = np.zeros(a.sizes[t], bool)
        for _, start, n in links:
            covered[start:start + n] = True
        share = float(covered.mean())
        if share >= LEAST_SHARE:
            spans[t] = (links[0][0], links[-1][0] + links[-1][2] - 1, share)
    return places, spans


ADDED = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(),
         "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(),
         "spans": T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("first", T.LongType()),
                                            T.StructField("last", T.LongType()), T.StructField("share", T.DoubleType())]))}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text; the words' number, phrase places, labels, score, and the covered template spans."""
    kept = [f for f in docs.schema.fields if f.name not in ADDED and f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        least = 1 / (1 + min(a.sizes[:a.n_templates]))
        for batch in batches:
            for part, texts in sliced(batch, text):
                found = words(texts, NOT_ALNUM, lower=True)
                h = found.hashes()
                n = len(texts)
                joined = np.zeros(len(h), bool)  # this word and the next stand together in a template
                if len(h) > 1:
                    maybe = np.flatnonzero((a.word_of.get(h) >= 0)[:-1] & (found.rows[1:] == found.rows[:-1]))
                    joined[maybe] = a.pairs.get(mix(mix(h[maybe] + np.uint64(2)) * np.uint64(3) + h[maybe + 1])) >= 0
                starts = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]]))
                stops = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]])) + 2
                per_row: dict[int, list[tuple[int, list[int]]]] = {}
                for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                    r = int(found.rows[s])
                    per_row.setdefault(r, []).append((s - int(found.bounds[r]), a.word_of.get(h[s:e]).tolist()))
                n_base, first, last = [0] * n, [None] * n, [None] * n
                base, labels, score, spans = [""] * n, [""] * n, [0.0] * n, [[]] * n
                for r, stretches in per_row.items():
                    places, covered = scan_words(a, stretches)
                    if places:
                        n_base[r], first[r], last[r] = len(places), min(places)[0], max(places)[0]
                    plain = {a.labels[a.n_templates + p] for _, p in places}
                    base[r] = ",".join(sorted(plain))
                    labels[r] = ",".join(sorted(plain | {a.labels[t] for t in covered}))
                    score[r] = max([c[2] for c in covered.values()] + [least if places else 0.0])
                    spans[r] = [{"template": a.labels[t], "first": c[0], "last": c[1], "share": c[2]}
                                for t, c in sorted(covered.items())]
                out = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                out |= {"n_words": pa.array(found.counts(), pa.int64()), "n_base": pa.array(n_base, pa.int64()),
                        "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
                        "base_labels": pa.array(base), "labels": pa.array(labels), "score": pa.array(score, pa.float64()),
                        "spans": pa.array(spans, pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()),
                                                                     ("last", pa.int64()), ("share", pa.float64())])))}
                yield pa.RecordBatch.from_pydict(out)

    schema = T.StructType([*kept, *[T.StructField(k, v) for k, v in ADDED.items()]])
    return docs.mapInArrow(run, schema)
