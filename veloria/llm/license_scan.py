"""Licence scans with a generalised suffix automaton of licence tokens.

The templates' words build one suffix automaton.  Each text is streamed
through it: at every word the automaton gives the longest suffix that occurs
in some template, and its suffix links give the longest one of every other
template (the matching statistics of each template).  A match is maximal if
the next word does not lengthen it in the same template, so a template that
lies inside another loses nothing to it.  Maximal matches of at least
``min_match`` words are chained, at any of the places that they have in the
template, in rising template order and with bounded gaps, into covered spans;
a template covered by at least ``min_cover`` of its words gives its label and
the spans, unless a span of another template that is covered to a greater share
holds half of the span's words or more (of two versions of a notice that differ
in a number, the one that is there counts).  Beside that, plain phrases are found wherever their words stand in
a row.

Words that no template holds end every match, so only runs of template words
go through the automaton; the rest of a text is dealt with in numpy.  Words
are found by their hashes and compared as bytes.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows are scanned one by one; of chains with equal cover the earliest
is taken, and all labels that pass are returned, sorted; an empty table gives
an empty table; other columns are carried along, and one that is called like a
made column is replaced.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veloria.llm import arrowmap
from veloria.llm.textbytes import LOWER, NON_ALNUM, Slice, hash_spans, same_bytes, slices

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Well-known public licence texts and notices, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "cc-by-4.0": ["licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version.""",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "mit-text": [
        "Released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ],
    "all-rights-reserved": ["All rights reserved. No part of this work may be reproduced without permission"],
}


def words_of(text: str) -> list[str]:
    """A text's words as ``scan`` takes them."""
    buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = Slice(0, buf, np.array([0, len(buf)])).words(NON_ALNUM)
    return [buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]


class SuffixAutomaton:
    """A generalised suffix automaton; ``places[state]`` maps a template to all end places of the state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)
        self.places: list[dict[int, list[int]]] = [{} for _ in self.next]
        for k, sequence in enumerate(sequences):
            state = 0
            for at, token in enumerate(sequence):
                state = up = self.next[state][token]
                while up > 0:
                    self.places[up].setdefault(k, []).append(at)
                    up = self.link[up]
        self._wider: dict[int, list[tuple[int, int, int]]] = {}

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, token: int, child: int) -> int:
        copy = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(token) == child:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (child := self.next[last].get(token)) is not None:
            return child if self.length[child] == self.length[last] + 1 else self._split(last, token, child)
        new, parent = self._state(self.length[last] + 1, {}, 0), last
        while parent >= 0 and token not in self.next[parent]:
            self.next[parent][token] = new
            parent = self.link[parent]
        if parent >= 0:
            child = self.next[parent][token]
            self.link[new] = child if self.length[child] == self.length[parent] + 1 else self._split(parent, token, child)
        return new

    def _others(self, state: int) -> list[tuple[int, int, int]]:
        """(template, length, state) of the templates that only shorter suffixes of a state's strings occur in."""
        if (own := self._wider.get(state)) is None:
            own, seen, up = [], set(self.places[state]), self.link[state]
            while up > 0:
                own += [(t, self.length[up], up) for t in self.places[up] if t not in seen]
                seen |= self.places[up].keys()
                up = self.link[up]
            self._wider[state] = own
        return own

    def statistics(self, tokens: list[int], least: int):
        """For each place, the longest suffix of at least ``least`` words of every template: {template: (length, state)}."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            found = {}
            if length >= least:
                found = {t: (length, state) for t in self.places[state]}
                found.update((t, (size, up)) for t, size, up in self._others(state) if size >= least)
            yield found

    def matches(self, tokens: list[int], least: int):
        """Yields (end, length, template, places) of each match that the next token does not lengthen in its template."""
        before: dict[int, tuple[int, int]] = {}
        for at, now in enumerate(self.statistics(tokens, least)):
            for t, (length, state) in before.items():
                if now.get(t, (0, 0))[0] <= length:
                    yield at - 1, length, t, self.places[state][t]
            before = now
        for t, (length, state) in before.items():
            yield len(tokens) - 1, length, t, self.places[state][t]


def chained(own: list[tuple[int, int, list[int]]], max_gap: int) -> list[tuple[int, int, int]]:
    """Chains (cover, first word, last word) of matches (end, length, places), the largest first; none overlaps a larger one."""
    nodes: list[tuple[int, int, int, int, int]] = []  # end, place, cover, first, index of what it goes on from
    extended = set()
    for end, length, places in sorted(own):
        earlier = len(nodes)
        while earlier and nodes[earlier - 1][0] >= end - length - max_gap:
            earlier -= 1
        known = nodes[earlier:]
        for place in places:
            best = (length, -(end - length + 1), -1)
            for k, (end_, place_, cover, first, _) in enumerate(known, earlier):
                if (fresh := min(length, end - end_, place - place_)) > 0:
                    best = max(best, (cover + fresh, -first, k))
            nodes.append((end, place, best[0], -best[1], best[2]))
            extended.add(best[2])
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []  # spans, in order
    for minus, first, last in sorted((-cover, first, end) for k, (end, _, cover, first, _) in enumerate(nodes) if k not in extended):
        at = bisect.bisect(taken, (first, last))
        if (not at or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
            taken.insert(at, (first, last))
            out.append((-minus, first, last))
    return out


def outdone(spans: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """The spans (first, last, share, template) of which no better covered one holds half or more."""
    spans = sorted(spans)
    lost, near = set(), []
    for k, (first, last, share, _) in enumerate(spans):
        near = [j for j in near if spans[j][1] >= first]  # disjoint for each template, so few
        for j in near:
            a, b, other, _ = spans[j]
            common = min(last, b) - first + 1
            if other > share and 2 * common >= last - first + 1:
                lost.add(k)
            if share > other and 2 * common >= b - a + 1:
                lost.add(j)
        near.append(k)
    return [x for k, x in enumerate(spans) if k not in lost]


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]], min_match: int, min_cover: float, max_gap: int):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        sequences = [(label, words_of(t)) for label, own in sorted(templates.items()) for t in own]
        words = sorted({w for _, s in sequences for w in s} | {w for p in phrases for w in words_of(p)})
        self.data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = Slice(0, self.data, np.array([0, len(self.data)])).words(NON_ALNUM)
        hashes = hash_spans(self.data, starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.starts, self.ends = hashes[order], starts[order], ends[order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.hashes >> np.uint64(48)] = True
        token = {words[w]: k for k, w in enumerate(order.tolist())}
        self.labels = [label for label, _ in sequences]
        self.sizes = [len(s) for _, s in sequences]
        self.automaton = SuffixAutomaton([[token[w] for w in s] for _, s in sequences])
        self.phrases = [([token[w] for w in words_of(p)], label) for p, label in phrases.items()]

    def tokens(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The template word of each text word, or -1."""
        hashes = hash_spans(buf, starts, ends)
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.hashes):
            return out
        maybe = np.flatnonzero(self.sieve[hashes >> np.uint64(48)])
        slot = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        true = self.hashes[slot] == hashes[maybe]
        maybe, slot = maybe[true], slot[true]
        known = len(self.hashes)  # the words of the templates go before those of the text
        both = np.concatenate([self.data, buf])
        same = same_bytes(both, np.concatenate([self.starts, starts[maybe] + len(self.data)]), np.concatenate([self.ends, ends[maybe] + len(self.data)]), np.concatenate([np.arange(known), slot]))[known:]
        out[maybe[same]] = slot[same]
        return out

    def phrase_places(self, tokens: np.ndarray, doc: np.ndarray):
        for phrase, label in self.phrases:
            m = len(tokens) - len(phrase) + 1
            if m > 0:
                hit = doc[:m] == doc[len(phrase) - 1 :]
                for j, t in enumerate(phrase):
                    hit = hit & (tokens[j : j + m] == t)
                yield np.flatnonzero(hit), label

    def chains(self, tokens: np.ndarray, doc: np.ndarray):
        """Yields (document, template, first word, last word, covered share)."""
        inside = tokens >= 0
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & inside[1:] & inside[:-1]])
        begins = np.flatnonzero(inside & ~same)
        ends = np.flatnonzero(inside & ~np.concatenate([same[1:], [False]])) + 1
        long = np.flatnonzero(ends - begins >= self.min_match)
        found: dict[tuple[int, int], list[tuple[int, int, list[int]]]] = {}
        for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            for end, length, template, places in self.automaton.matches(tokens[b:e].tolist(), self.min_match):
                found.setdefault((int(doc[b]), template), []).append((b + end, length, places))
        for (k, template), own in found.items():
            for cover, first, last in chained(own, self.max_gap):
                yield k, template, first, last, cover / self.sizes[template]


SCHEMA = arrowmap.schema("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>")


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, min_match: int = 3, min_cover: float = 0.7, max_gap: int = 3) -> DataFrame:
    """docs with phrase places, labels and covered template spans ("label:first-last")."""
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, min_match, min_cover, max_gap)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # bounded: built from the templates given

    def make(cols: dict[str, pa.Array]) -> dict[str, pa.Array]:
        s, rows = shared.value, []
        for piece in slices(cols[text]):
            buf = LOWER[piece.buf]
            starts, ends, doc = Slice(0, buf, piece.offsets).words(NON_ALNUM)
            per = np.bincount(doc, minlength=len(piece))
            begin = np.cumsum(per) - per
            tokens = s.tokens(buf, starts, ends)
            places: list[list[int]] = [[] for _ in range(len(piece))]
            base: list[set[str]] = [set() for _ in range(len(piece))]
            more: list[set[str]] = [set() for _ in range(len(piece))]
            spans: list[list[str]] = [[] for _ in range(len(piece))]
            score = [0.0] * len(piece)
            for at, label in s.phrase_places(tokens, doc):
                for w in at.tolist():
                    places[doc[w]].append(w - int(begin[doc[w]]))
                    base[doc[w]].add(label)
            passed: dict[int, list[tuple[int, int, float, int]]] = {}
            for k, template, first, last, share in s.chains(tokens, doc):
                score[k] = max(score[k], share)
                if share >= s.min_cover:
                    passed.setdefault(k, []).append((first - int(begin[k]), last - int(begin[k]), share, template))
            for k, own in passed.items():
                for first, last, _, template in outdone(own):
                    more[k].add(s.labels[template])
                    spans[k].append(f"{s.labels[template]}:{first}-{last}")
            for k in range(len(piece)):
                rows.append((int(per[k]), len(places[k]), min(places[k], default=None), max(places[k], default=None), ",".join(sorted(base[k])), ",".join(sorted(base[k] | more[k])), score[k], sorted(spans[k])))
        return {f.name: pa.array([r[i] for r in rows]) if rows and f.name != "spans" else pa.array([r[i] for r in rows], pa.list_(pa.string())) for i, f in enumerate(SCHEMA)}

    return arrowmap.append(docs, [text], [c for c in (keep if keep is not None else docs.columns)], SCHEMA, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: phrase places and labels of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"]).drop("spans")
