"""Licence scan: a generalised suffix automaton of licence tokens and chains of long matches.

The automaton is built once from the notices and the base phrases (fixed; about 2,700 tokens) and travels in the task closure. Each
text is streamed through it token by token, which yields its matching statistics: for every position, the length of the longest
template substring that ends there. Base phrases are read off the states on the way. Matches that cannot be extended and are long
enough are chained by dynamic programming, in increasing text and template order with bounded gaps, into covered template spans;
a span inside another that covers more goes.

Defined cases: a null or empty text has no words, n_base 0, null first and last word, empty label strings and score 0.
Repeated rows give repeated results. Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlake.llm.common import utf8, words

# Phrases that must be found wherever their words stand consecutively, and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

# Well-known notices of public licences, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.""",
    "epl": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0""",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
}

# Names that a licence goes by in one line, by label.
NAMES = {
    "mit": ("the MIT License", "MIT"), "apache": ("the Apache License Version 2.0", "Apache-2.0"), "gpl": ("the GNU General Public License", "the GPL", "GPL-3.0", "GPL-2.0"),
    "lgpl": ("the GNU Lesser General Public License", "the LGPL", "LGPL-2.1", "LGPL-3.0"), "agpl": ("the GNU Affero General Public License", "AGPL-3.0"), "bsd": ("the BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "isc": ("the ISC License", "ISC"), "mpl": ("the Mozilla Public License", "MPL-2.0"), "zlib": ("the zlib License", "Zlib"), "boost": ("the Boost Software License", "BSL-1.0"), "epl": ("the Eclipse Public License", "EPL-2.0"), "unlicense": ("the Unlicense", "Unlicense"), "cc0": ("CC0", "CC0 1.0"),
    "cc-by": ("CC BY", "a Creative Commons Attribution License", "a Creative Commons Attribution 4.0 International License"), "cc-by-sa": ("CC BY-SA", "a Creative Commons Attribution-ShareAlike 4.0 International License"), "cc-by-nd": ("CC BY-ND", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc": ("CC BY-NC", "a Creative Commons Attribution-NonCommercial 4.0 International License"), "cc-by-nc-sa": ("CC BY-NC-SA", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), "cc-by-nc-nd": ("CC BY-NC-ND", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}

# What stands before a name in such a line.
LEADS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "SPDX-License-Identifier")


def notices() -> list[tuple[str, str]]:
    """(label, text) of all templates: the notices and one line for each lead and name."""
    return [*TEMPLATES.items(), *((label, f"{lead} {name}") for label, names in NAMES.items() for name in names for lead in LEADS)]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


class SuffixAutomaton:
    """Generalised suffix automaton over several token sequences.

    States hold the longest length of their class, a suffix link, transitions, and the (sequence, end) places where the class
    occurs. Sequences are added one after another from the root, reusing existing transitions. Phrases are sequences too; a state
    also lists those that end wherever it is reached, with the match length they need.
    """

    def __init__(self, sequences: list[list[bytes]], phrases: list[list[bytes]] = ()):
        self.sizes = [len(x) for x in sequences]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate([*sequences, *phrases]):
            last = 0
            for end, token in enumerate(sequence, 1):
                last = self._extend(last, token)
                while len(places) < len(self.next):
                    places.append([])
                if t < len(sequences):
                    places[last].append((t, end))
        upward = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        # A class occurs where any class below it in the suffix-link tree does.
        for state in upward:
            if self.link[state] > 0:
                places[self.link[state]] += places[state]
        self.places = [sorted(set(p)) for p in places]
        # A phrase ends in a match if its own state is that match's or above it, and the match is long enough.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, phrase in enumerate(phrases):
            state = 0
            for token in phrase:
                state = self.next[state][token]
            self.phrases[state].append((k, len(phrase)))
        for state in reversed(upward):
            self.phrases[state] = self.phrases[state] + self.phrases[self.link[state]]

    def _new(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, token: bytes) -> int:
        """The state that `parent` reaches by token, as long as that step; an overlong one is cloned."""
        target = self.next[parent][token]
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self._new(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(token) == target:
            self.next[parent][token] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, token: bytes) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = state
            last = self.link[last]
        self.link[state] = self._split(last, token) if last >= 0 else 0
        return state

    def statistics(self, tokens: list[bytes], ended: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each match of the text that the next token does not extend. (start, phrase) of every phrase in
        the text is added to `ended` on the way."""
        step, link, length, phrases = self.next, self.link, self.length, self.phrases
        known = step[0]
        state = matched = 0
        for i, token in enumerate(tokens):
            if token not in known:
                if matched:
                    yield i, matched, state
                    state = matched = 0
                continue
            to = step[state].get(token)
            if to is not None:
                state, matched = to, matched + 1
            else:
                yield i, matched, state
                while state and token not in step[state]:
                    state = link[state]
                matched = length[state] + 1
                state = step[state][token]
            if phrases[state] and ended is not None:
                ended += [(i + 1 - n, k) for k, n in phrases[state] if n <= matched]
        if matched:
            yield len(tokens), matched, state


class Notices:
    """The automaton of all notices and base phrases, with their labels."""

    def __init__(self, templates: list[tuple[str, str]] | None = None):
        found = notices() if templates is None else templates
        self.labels = [label for label, _ in found]
        self.automaton = SuffixAutomaton([words(x.encode()) for _, x in found], [[x.encode() for x in p] for p in PHRASES])
        self.phrase_labels = list(PHRASES.values())


def chains(automaton: SuffixAutomaton, matches: Iterator[tuple[int, int, int]], min_match: int, max_gap: int) -> list[tuple[int, int, int, int]]:
    """(sequence, start, end, covered tokens) of the best chains of long matches.

    Dynamic programming over the matches in text order: both positions of a link grow, no gap exceeds max_gap or a quarter of the
    sequence, and an overlap counts once; each match extends the chain before it that covers the most. Of all chains that begin
    in the same match the best one counts. Matches out of reach are forgotten, so those kept are bounded by the gap and the
    places in the sequences, not by the text."""
    best: dict[tuple[int, int, int], tuple[int, int, int, int]] = {}  # by first match: sequence, start, end, covered
    near: dict[int, list[tuple[int, int, int, tuple[int, int, int]]]] = {}  # by sequence: end, place, covered, first match
    for end, size, state in matches:
        if size < min_match:
            continue
        for t, at in automaton.places[state]:
            gap = min(max_gap, automaton.sizes[t] // 4 + 1)
            kept = [c for c in near.get(t, ()) if end - size - c[0] <= gap]
            covered, first = size, (t, end - size, at - size)
            for c in kept:
                if c[0] < end and c[1] < at and at - size - c[1] <= gap:
                    total = c[2] + min(size, end - c[0], at - c[1])
                    if total > covered:
                        covered, first = total, c[3]
            kept.append((end, at, covered, first))
            near[t] = kept
            if first not in best or covered > best[first][3]:
                best[first] = (t, first[1], end, covered)
    return list(best.values())


def outermost(spans: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """The (start, end, covered, ...) spans that lie in no other which covers more (of equal ones, the first by label)."""
    out: list[tuple[int, int, int, str, float]] = []
    group: list[tuple[int, int, int, str, float]] = []
    reach = -1
    for x in [*sorted(spans), None]:
        if x is None or x[0] >= reach:  # a run of overlapping spans is complete
            own: list[tuple[int, int, int, str, float]] = []
            for y in sorted(group, key=lambda y: (-y[2], y[0], y[1], y[3])):
                if not any(z[0] <= y[0] and y[1] <= z[1] for z in own):
                    own.append(y)
            out += sorted(own)
            group, reach = [], -1
        if x is not None:
            group.append(x)
            reach = max(reach, x[1])
    return out


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, min_match: int = 3, max_gap: int = 24, min_covered: int = 24, short: int = 20) -> DataFrame:
    """One row per row of docs (doc_id, text). A chain names its notice if it covers half of it or `min_covered` tokens; a notice
    under `short` tokens must be covered to nine tenths. score is the best share covered, and at least one half where a base
    phrase stands. spans lists label:first word:end word."""
    own = Notices(templates)
    automaton = own.automaton
    needed = [-(-9 * n // 10) if n < short else min(min_covered, -(-n // 2)) for n in automaton.sizes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch, "text"):
                tokens = words(text)
                base: list[tuple[int, int]] = []
                found = chains(automaton, automaton.statistics(tokens, base), min_match, max_gap)
                base.sort()
                named = {own.phrase_labels[k] for _, k in base}
                spans = outermost([(a, b, n, own.labels[t], min(1.0, n / automaton.sizes[t])) for t, a, b, n in found if n >= needed[t]])
                score = max([0.5 if base else 0.0, *(x[4] for x in spans)])
                labels = named.union(x[3] for x in spans)
                rows.append((len(tokens), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(named)), ",".join(sorted(labels)), score, ",".join(f"{x[3]}:{x[0]}:{x[1]}" for x in spans)))
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(scan, SCHEMA)
