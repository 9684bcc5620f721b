"""License scans: winnowed fingerprints, an inverted index, banded alignment.

Templates are cut in words (runs of letters and digits, A-Z lower case) and hashed in
grams of GRAM words; winnowing keeps the smallest hash of every SPAN grams in a row, so
any run of GRAM + SPAN - 1 words that a text shares with a template holds a kept one. Templates
below SHORT words have all their grams of two words, or their one word, so that a changed word in the middle
doesn't hide them. The inverted index maps fingerprints to templates and places. Templates are a parameter;
their index must be below MOST_BYTES, which is checked before it is sent to the tasks.

All grams of a text are looked up. Each hit says where its template would start; starts up to a
band apart are one candidate, and the next candidate begins half a band on, so a candidate has a stretch of
text of bounded length, however often a text repeats itself. Within the band a longest
common subsequence of words is found, of which the part counts that a text doesn't interrupt by more than BAND words or
a quarter of the template. A match is reported if it covers LEAST of the template's words and
keeps what tells the template from the others: where another template, one with ALIKE of its words in order, has other
words, LEAST of each such run (so a single word, as the name or version of a license, for certain), and where
another one only has more words, nothing like them. Of matches that overlap, that with more words is reported.

Nulls: a null text matches nothing and a null doc_id stays null in its matches. Texts and
templates without words match nothing. Very long texts are scanned whole, in time in proportion to their length. Repeated
rows each give their matches; of equal templates the first name is reported. An empty
table gives no rows. Other columns are not read. Ids are cast to long.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import first_of_runs, lean, member, small_batches
from .words import ALNUM, LOWER, WordHash, cuts, scan, utf8, window_hash

GRAM, SPAN, BAND = 3, 2, 8
SHORT = 12
LEAST = 0.8
ALIKE = 0.75  # a text of a template that shares less with another one doesn't cover LEAST of that
MOST_BYTES = 64 << 20
_HASH = WordHash(5)
MEMO = 4096  # alignments that a task remembers, for texts that repeat themselves
RESULT = "doc_id long, license string, coverage double, matched long, template_words long, start_word long, end_word long, start_byte long, end_byte long, matched_text string, missing string"

#: Public license notices
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache line": "Released under the Apache License.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD line": "Released under the BSD License.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/',
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0 line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "All rights reserved": "All rights reserved.",
}

#: Identifiers of the public SPDX list. A license's other versions are there so that they aren't taken for it
SPDX = (
    "0BSD Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 "
    "AGPL-3.0-only AGPL-3.0-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later ISC MIT MPL-1.1 MPL-2.0 Unlicense Zlib"
).split()
TEMPLATES |= {f"{i} identifier": f"SPDX-License-Identifier: {i}" for i in SPDX}


class Index(NamedTuple):
    names: list[str]
    texts: list[list[str]]  # words of each template
    words: list[np.ndarray]  # and their hashes
    runs: list[list[tuple[int, int]]]  # places at which another template has other words
    gaps: list[list[tuple[int, int]]]  # places before which another template has more words, and how many
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by size: fingerprints, ascending, templates and places


def winnow(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of the smallest hash of each `span` grams in a row, the rightmost of equal ones; all of a shorter list."""
    if len(grams) <= span:
        return np.arange(len(grams)) if len(grams) < span else np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    return np.unique(np.arange(len(views)) + span - 1 - np.argmin(views[:, ::-1], axis=1))


def _words(data: np.ndarray, offs: np.ndarray):
    low = LOWER[data]
    starts, ends, first = scan(low, offs, ALNUM)
    return starts, ends, first, _HASH(low, starts, ends)


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    return window_hash(h, np.arange(len(h) - size + 1), size) if len(h) >= size else np.zeros(0, np.uint64)


def told_apart(words: list[str], others: list[list[str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of a template and the others that have ALIKE of its words in order: runs (start, end) of its words where one of them has
    other words or none, and places before which one of them only has more words, with their number."""
    runs, gaps = set(), set()
    for other in others:
        if other == words or 2 * len(set(words) & set(other)) < len(set(words)):  # can't share enough
            continue
        steps = SequenceMatcher(None, words, other, autojunk=False).get_opcodes()
        if sum(b - a for kind, a, b, _, _ in steps if kind == "equal") < ALIKE * len(words):
            continue
        for kind, a, b, c, d in steps:
            if kind == "insert":
                if 0 < a < len(words):
                    gaps.add((a, d - c))
            elif kind != "equal":
                runs.add((a, b))
    return sorted(runs), sorted(gaps)


def index(templates: dict[str, str]) -> Index:
    """Inverted index of fingerprints, and what tells each template from the others."""
    if sum(len(t) for t in templates.values()) * 8 > MOST_BYTES:
        raise ValueError(f"templates need more than {MOST_BYTES} bytes; scan with parts of them")
    names, texts, words, found = [], [], [], {}
    seen = set()
    for name, text in templates.items():
        data, offs = utf8(pa.array([text]))
        starts, ends, _, h = _words(data, offs)
        if not len(h) or h.tobytes() in seen:
            continue
        seen.add(h.tobytes())
        size = GRAM if len(h) >= SHORT else min(2, len(h))
        g = _grams(h, size)
        at = winnow(g) if size == GRAM else np.arange(len(g))
        found.setdefault(size, []).append((g[at], np.full(len(at), len(names)), at))
        names.append(name)
        words.append(h)
        texts.append([data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(starts, ends, strict=True)])
    told = [told_apart(t, texts) for t in texts]
    grams = {}
    for size, parts in found.items():
        g, template, place = (np.concatenate([f[k] for f in parts]) for k in range(3))
        order = np.lexsort((place, template, g))
        grams[size] = g[order], template[order].astype(np.int64), place[order].astype(np.int64)
    return Index(names, texts, words, [t[0] for t in told], [t[1] for t in told], grams)


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a and b on diagonals (place in b less place in a) from low to high, as pairs of
    places; of the longest ones one that ends first, and begins late for that end."""
    n, m = len(a), len(b)
    rows = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        p, q = max(0, i + low), min(m, i + high + 1)
        now, old = rows[i + 1], rows[i]
        now[:] = old
        if p < q:
            now[p + 1 : q + 1] = np.maximum.accumulate(np.maximum(old[p + 1 : q + 1], old[p:q] + (b[p:q] == a[i])))
            np.maximum(now[q:], now[q], out=now[q:])
    i, j = n, int(np.argmax(rows[n]))
    pairs = []
    while i and j:
        if low <= j - i <= high and a[i - 1] == b[j - 1] and rows[i, j] == rows[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif rows[i - 1, j] == rows[i, j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def together(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The most pairs of an alignment between which a text has at most BAND, or a quarter of the template's n, other words."""
    most = max(BAND, n // 4)
    parts: list[list[tuple[int, int]]] = [[]]
    for p in pairs:
        if parts[-1] and p[1] - parts[-1][-1][1] - 1 > most:
            parts.append([])
        parts[-1].append(p)
    return max(parts, key=len)


class Match(NamedTuple):
    template: int
    start: int  # first word
    end: int  # last word
    places: tuple[int, ...]  # of the template that are matched


def told(ix: Index, t: int, pairs: list[tuple[int, int]], least: float) -> bool:
    """Whether an alignment keeps what tells the template from the others."""
    at = dict(pairs)
    if any(sum(p in at for p in range(a, b)) < math.ceil(least * (b - a)) for a, b in ix.runs[t]):
        return False
    return not any(p - 1 in at and p in at and 2 * (at[p] - at[p - 1] - 1) >= more for p, more in ix.gaps[t])


class _Scan:
    """The matches of one template in a text."""

    def __init__(self, h: np.ndarray, t: int, starts: np.ndarray, ix: Index, least: float, memo: dict):
        self.h, self.t, self.starts, self.ix, self.least, self.memo = h, t, starts, ix, least, memo
        self.words = ix.words[t]
        self.need = math.ceil(least * len(self.words) - 1e-9)
        self.band = max(2 * BAND, len(self.words) // 2)
        self.found: list[Match] = []

    def best(self, lo: int, hi: int, low: int, high: int) -> tuple[list[tuple[int, int]], bool]:
        """Alignment within the words lo to hi of the text, and whether it is a match."""
        some = self.h[lo:hi]
        key = (self.t, low, high, some.tobytes())
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            pairs: list[tuple[int, int]] = []
            if np.isin(self.words, some).sum() >= self.need:
                pairs = together(align(self.words, some, low, high), len(self.words))
            enough = len(pairs) >= self.need
            self.memo[key] = (pairs if enough else [], enough and told(self.ix, self.t, pairs, self.least))
        return self.memo[key]

    def search(self, floor: int, ceiling: int) -> None:
        """All matches in the words floor to ceiling."""
        n, starts = len(self.words), self.starts
        todo = [(floor, ceiling, floor - n)]  # and the least start that isn't done
        while todo:
            floor, ceiling, least = todo.pop()
            k = int(np.searchsorted(starts, least))
            if k >= len(starts) or starts[k] >= ceiling or ceiling - floor < self.need:
                continue
            d = int(starts[k])
            lo, hi = max(floor, d - BAND), min(ceiling, d + self.band + n + BAND)
            pairs, right = self.best(lo, hi, d - BAND - lo, d + self.band + BAND - lo)
            if pairs:  # a match, or what another template has: there may be more on either side of it
                start, end = lo + pairs[0][1], lo + pairs[-1][1]
                if right:
                    self.found.append(Match(self.t, start, end, tuple(p for p, _ in pairs)))
                todo += [(end + 1, ceiling, max(d, end + 1 - (n - self.need))), (lo, start, d)]
            else:  # the starts of half a band are done; the next candidate has those beyond
                todo.append((floor, ceiling, d + self.band // 2 + 1))


def matches(h: np.ndarray, ix: Index, least: float = LEAST, memo: dict | None = None) -> list[Match]:
    """The matches in a text's word hashes, in order; of those that overlap that with more words."""
    starts, template = [], []
    for size, (grams, of, place) in ix.grams.items():
        own = _grams(h, size)
        low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        hit = np.flatnonzero(high > low)
        n = (high - low)[hit]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hit], n)
        starts.append(np.repeat(hit, n) - place[k])
        template.append(of[k])
    if not starts:
        return []
    start, t = np.concatenate(starts), np.concatenate(template)
    order = np.lexsort((start, t))
    start, t = start[order], t[order]
    found: list[Match] = []
    memo = {} if memo is None else memo
    for a in first_of_runs(t):
        b = int(np.searchsorted(t, t[a], "right"))
        one = _Scan(h, int(t[a]), np.unique(start[a:b]), ix, least, memo)
        one.search(0, len(h))
        found += one.found
    free = np.ones(len(h), bool)
    out = []
    for m in sorted(found, key=lambda m: (-len(m.places), m.end - m.start, m.start, m.template)):
        if free[m.start : m.end + 1].all():
            free[m.start : m.end + 1] = False
            out.append(m)
    return sorted(out, key=lambda m: m.start)


@lean
def _scan(batches, shared, least: float):
    ix: Index = shared.value
    names = ["doc_id", "license", "coverage", "matched", "template_words", "start_word", "end_word", "start_byte", "end_byte", "matched_text", "missing"]
    kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 6, pa.string(), pa.string())
    distinct = {size: g[first_of_runs(g)] for size, (g, _, _) in ix.grams.items()}
    memo: dict = {}
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        ids = batch.column("doc_id")
        rows = []
        for lo, hi in cuts(offs, 1 << 20):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            starts, ends, first, h = _words(d, o)
            some = [np.flatnonzero(member(_grams(h, size), g)) for size, g in distinct.items()]
            hit = np.unique(np.searchsorted(first, np.concatenate(some), "right") - 1) if some else ()
            for k in hit:
                a, b = int(first[k]), int(first[k + 1])
                for m in matches(h[a:b], ix, least, memo):
                    x, y = int(starts[a + m.start]), int(ends[a + m.end])
                    words = ix.texts[m.template]
                    n, missing = len(words), set(range(len(words))).difference(m.places)
                    found = d[x:y].tobytes().decode("utf-8", "replace")
                    rows.append((ids[lo + int(k)].as_py(), ix.names[m.template], len(m.places) / n, len(m.places), n, m.start, m.end + 1, x - int(o[k]), y - int(o[k]), found, " ".join(words[p] for p in sorted(missing))))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match: document, license, coverage of the template, the span in words and bytes (ends excluded),
    and the template's words that the text lacks."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index(TEMPLATES if templates is None else templates))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(lambda b: _scan(b, shared, least), RESULT)
