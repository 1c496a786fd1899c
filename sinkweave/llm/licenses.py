"""Licence scans with a generalised suffix automaton.

The automaton holds every word sequence of the licence templates. A text is streamed through it
once: at each word it gives, for each template, the longest suffix read so far that stands in it
(matching statistics; the state's suffix links lead to templates that hold less of it). Matches of
MIN_MATCH words and more, each with its places, are chained per template in increasing order of both;
each chain that covers enough of a template is a span, so a text that stands twice has two. Where
spans of different labels overlap, the one that covers more words stays: BY-NC-ND is not BY-NC.
Fixed phrases are counted at every place where their words stand in a row.

Defined results: null and wordless texts have no words and no labels; ties between overlapping spans
go to the larger share, then to the label that sorts first; repeated rows get the same result; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinkweave.llm.common import LOWER, UPPER

PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Whole texts of short licences.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)
#: Opening notices of well-known licences, as their texts ask to write them.
NOTICES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("bsd", "Licensed under the BSD 2-Clause License."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: The conditions of Creative Commons licences, short and long.
CONDITIONS = (
    ("by", "Attribution"),
    ("by-sa", "Attribution-ShareAlike"),
    ("by-nc", "Attribution-NonCommercial"),
    ("by-nd", "Attribution-NoDerivatives"),
    ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)
COMMONS = (
    *((f"cc-{short}", f"Licensed under CC {short} 4.0.") for short, _ in CONDITIONS if short != "by"),
    *((f"cc-{short}", f"This work is licensed under a Creative Commons {long} 4.0 International License.") for short, long in CONDITIONS),
)
TEMPLATES = (*NOTICES, *COMMONS, *TEXTS)
#: Shorter matches don't enter a chain.
MIN_MATCH = 3
#: Words that may lie between two matches of a chain.
MAX_GAP = 12
#: Share of a template that a chain must cover to name its label.
COVER = 0.6
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


class SuffixAutomaton:
    """Of several sequences of small integers; states know all their end places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (sequence, place after the last symbol)
        for which, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence, 1):
                last = self._extend(last, symbol)
                self.places[last].append((which, at))
        # a state's places are also those of the states that its link leads to
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.places[self.link[s]] += self.places[s]
        self._nearest: dict[int, dict[int, int]] = {}

    def nearest(self, state: int) -> dict[int, int]:
        """Per sequence, the first state along the links whose strings stand in it; kept once asked for."""
        if state not in self._nearest:
            above = self.nearest(self.link[state]) if self.link[state] > 0 else {}
            self._nearest[state] = above | {which: state for which, _ in self.places[state]}
        return self._nearest[state]

    def _add(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A copy of q for the shorter strings that p's arc reaches."""
        copy = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            q = self.next[last][symbol]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        new, p = self._add(self.length[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def maximal_matches(self, symbols: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(place after the match, length, sequence, state): of each sequence, its longest match that ends
        at a place, if the next symbol doesn't extend it there."""
        state, length, before = 0, 0, {}
        for at, symbol in enumerate([*symbols, -1]):
            while state > 0 and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            else:
                state, length = 0, 0
            now = {}
            if length >= least:
                for which, at_state in self.nearest(state).items():
                    n = length if at_state == state else self.length[at_state]
                    if n >= least:
                        now[which] = n, at_state
            for which, (n, at_state) in before.items():
                if which not in now or now[which][0] != n + 1:
                    yield at, n, which, at_state
            before = now


def _apart(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The largest chains (covered, start, end), but for those that meet a larger one."""
    kept: list[tuple[int, int, int]] = []  # (start, end, covered), in order: disjoint, so neighbours tell
    for covered, start, end in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
        k = bisect(kept, (start, end, covered))
        if (k == 0 or kept[k - 1][1] <= start) and (k == len(kept) or end <= kept[k][0]):
            kept.insert(k, (start, end, covered))
    return [(covered, start, end) for start, end, covered in kept]


def _largest(spans: list[tuple]) -> list[tuple]:
    """Of spans (covered, share, label, start, end), those that no larger one of another label overlaps."""
    kept: list[tuple] = []
    for c in sorted(spans, key=lambda c: (-c[0], -c[1], c[2:])):
        meets = (k for k in kept if 2 * (min(c[4], k[4]) - max(c[3], k[3])) > min(c[4] - c[3], k[4] - k[3]))
        if all(k[2] == c[2] for k in meets):
            kept.append(c)
    return kept


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        split = [words_of(t) for _, t in templates]
        vocabulary = sorted({w for ws in split for w in ws} | {w for p, _ in phrases for w in words_of(p)})
        self.ids = {w: k for k, w in enumerate(vocabulary, 1)}
        self.labels = [label for label, _ in templates]
        self.sizes = [len(ws) for ws in split]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in ws] for ws in split])
        self.phrases = [([self.ids[w] for w in words_of(p)], label) for p, label in phrases]

    def chains(self, codes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Per template, (covered words, first word, the one after the last) of its chains of matches: the
        largest first, and none that meets a larger one."""
        inside = np.r_[False, codes > 0, False]
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for lo, hi in zip(starts, ends):
            if hi - lo >= MIN_MATCH:
                for at, length, which, state in self.automaton.maximal_matches(codes[lo:hi].tolist(), MIN_MATCH):
                    found[which] += [(int(lo) + at - length, end - length, length) for owner, end in self.automaton.places[state] if owner == which]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for which, matches in found.items():
            # open chains: (end in text, end in template, covered, start); gaps and sizes bound how many stay open
            out[which], chains, closed = [], [], []
            for text_at, place, length in sorted(matches):
                chains = [c for c in chains if c[0] + MAX_GAP >= text_at]
                if not chains:
                    out[which] += _apart(closed)
                    closed = []
                covered, start = max(((c[2], c[3]) for c in chains if c[1] <= place and c[0] <= text_at), key=lambda b: (b[0], -b[1]), default=(0, text_at))
                chains.append((text_at + length, place + length, covered + length, start))
                closed.append((covered + length, start, text_at + length))
            out[which] += _apart(closed)
        return out

    def spans(self, chains: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, str, float]]:
        """(first word, the one after the last, label, share) of chains that cover enough; of those that
        overlap by half of the shorter, the one that covers more, unless they say the same."""
        all_ = [(covered, min(1.0, covered / self.sizes[k]), self.labels[k], a, b) for k, cs in chains.items() for covered, a, b in cs if covered >= COVER * self.sizes[k]]
        out, cluster, reach = [], [], 0
        for c in sorted(all_, key=lambda c: c[3:]):
            if c[3] >= reach:
                out += _largest(cluster)
                cluster = []
            cluster.append(c)
            reach = max(reach, c[4])
        return sorted({(a, b, label, share) for _, share, label, a, b in out + _largest(cluster)})

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        codes = np.fromiter(map(self.ids.get, words, [0] * len(words)), dtype=np.int32, count=len(words))
        places: list[np.ndarray] = []
        base = set()
        if codes.any():
            for phrase, label in self.phrases:
                n = len(codes) - len(phrase) + 1
                if n > 0:
                    at = np.flatnonzero(np.logical_and.reduce([codes[k : k + n] == w for k, w in enumerate(phrase)]))
                    if len(at):
                        places.append(at)
                        base.add(label)
        chains = self.chains(codes) if codes.any() else {}
        spans = self.spans(chains)
        own = {label for _, _, label, _ in spans}
        n_base = sum(map(len, places))
        score = max((min(1.0, covered / self.sizes[k]) for k, cs in chains.items() for covered, _, _ in cs), default=0.0)
        return (
            len(words), n_base,
            int(min(p[0] for p in places)) if n_base else None, int(max(p[-1] for p in places)) if n_base else None,
            ",".join(sorted(base)), ",".join(sorted(base | own)), max(score, 0.5) if n_base else score,
            [{"label": label, "first": a, "last": b - 1, "share": c} for a, b, label, c in spans],
        )


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest covered share of a template, and at least 0.5 where a phrase stands;
    ``spans`` are the first and last words of all chains that cover enough of a template."""
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases)
        for texts in batches:
            yield pd.DataFrame([scanner.scan(t) for t in texts], columns=names, dtype=object)

    return docs.select("doc_id", F.pandas_udf(run, schema)("text").alias("r")).select("doc_id", "r.*")
