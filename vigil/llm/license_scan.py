"""License scan by patience alignment.

For each template whose words a document could cover at all, the places where enough of its
words stand close together are aligned with it: words unique to both sides are anchors, the
longest increasing subsequence of their places is kept, and the gaps between anchors are
aligned the same way, recursively. Coverage is the share of the template's words aligned; a
license is found where coverage is ``threshold`` or more.

The bound that sends a template past a document is exact: the words of the template that
the document has at all, with their counts in the template, are fewer than the threshold asks.

Nulls: a null or empty text has no license. Of overlapping finds the one with more aligned
words stays (ties: higher coverage, then the template listed first). Repeated rows give
repeated results. An empty table gives an empty result. Other columns are ignored. A very long
text is scanned whole; its work grows with its words, also where they are all license words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# The wording of public licenses and of the usual notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
    use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
    the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
    WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
    PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
    OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
    OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
    with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
    and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the
    copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
    specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
    use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
    or non-commercial, and by any means."""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
)

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by the first part, in which the second part increases."""
    tails: list[int] = []
    holds: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = holds[at - 1] if at else -1
        tails[at : at + 1], holds[at : at + 1] = [j], [k]
    chain, k = [], holds[-1] if holds else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def patience(a: list, b: list, a0: int = 0, a1: int | None = None, b0: int = 0, b1: int | None = None) -> list[tuple[int, int]]:
    """Aligned places of two word lists, in order."""
    todo, out = [(a0, len(a) if a1 is None else a1, b0, len(b) if b1 is None else b1)], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.names = [n for n, _ in templates]
        self.words = [WORD.findall(t.lower()) for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.masks = [{w: sum(1 << i for i, x in enumerate(t) if x == w) for w in set(t)} for t in self.words]
        self.least = [max(1, int(np.ceil(threshold * len(w) - 1e-9))) for w in self.words]
        self.vocabulary = frozenset().union(*self.counts)

    def candidates(self, present: frozenset | set) -> list[int]:
        known = present & self.vocabulary
        return [k for k, c in enumerate(self.counts) if sum(c[w] for w in known & c.keys()) >= self.least[k]]

    def aligned(self, k: int, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(aligned words, first, last place) of each window that covers enough of template k.

        The longest common subsequence bounds what can be aligned, and grows by one at most for each
        word of the template that enters behind: from a window that is short by g, the next g - 1 such
        words are passed over. Inside a find only windows that could align more words are aligned.
        """
        template, masks, least = self.words[k], self.masks[k], self.least[k]
        m = len(template)
        width = m + m // 4 + 2
        own = [masks[w] for w in words if w in masks]
        member = np.fromiter((w in masks for w in words), bool, len(words))
        total = np.concatenate([[0], np.cumsum(member)])
        starts = np.flatnonzero(member)
        stops = np.minimum(starts + width, len(words))
        enough = total[stops] - total[starts] >= least
        common, seen, best, end = m, 0, 0, -1
        for start, stop, low, high in zip(*(x[enough].tolist() for x in (starts, stops, total[starts], total[stops]))):
            need = max(least, best + 1) if start <= end else least
            if common + high - seen < need:
                continue
            left = (1 << m) - 1  # a bit for each template word that no chain ends on
            for mask in own[low:high]:
                chosen = left & mask
                left = (left + chosen | left - chosen) & (1 << m) - 1
            common, seen = m - left.bit_count(), high
            pairs = patience(template, words[start:stop]) if common >= need else ()
            if len(pairs) >= need:
                best, end = len(pairs), start + pairs[-1][1]
                yield best, start + pairs[0][1], end

    def find(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """(template, coverage, aligned words, start, stop in code points), in text order."""
        low = text.lower()
        if len(low) != len(text):  # some capitals become two characters
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        # the bound needs no places, and most documents go no further
        chosen = self.candidates(self.vocabulary.intersection(WORD.findall(low)))
        if not chosen:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        found = []
        for k in chosen:
            for n, first, last in self.aligned(k, words):
                found.append((k, n / len(self.words[k]), n, spans[first][0], spans[last][1]))
        found.sort(key=lambda f: (-f[2], -f[1], f[0], f[3]))
        kept: list[tuple] = []
        for f in found:
            if all(f[4] <= g[3] or g[4] <= f[3] for g in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[3])


SCHEMA = "doc_id long, license string, coverage double, n_found int, licenses array<string>, spans array<string>"


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its best license and coverage, and all finds with their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            finds = [scanner.find(t.as_py() or "") for t in batch.column(1)]
            best = [max(f, key=lambda x: (x[2], x[1]), default=None) for f in finds]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([scanner.names[b[0]] if b else None for b in best], pa.string()),
                    pa.array([b[1] if b else 0.0 for b in best], pa.float64()),
                    pa.array([len(f) for f in finds], pa.int32()),
                    pa.array([[scanner.names[x[0]] for x in f] for f in finds], pa.list_(pa.string())),
                    pa.array([[f"{x[3]}:{x[4]}" for x in f] for f in finds], pa.list_(pa.string())),
                ],
                ["doc_id", "license", "coverage", "n_found", "licenses", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
