"""License scan by patience alignment.

Text and template are words (letters and digits, lower-cased).  Words that occur once in the text and once in the template
are anchors; the longest increasing subsequence of their places is kept, and the gaps between kept anchors are aligned in
the same way, after equal words beside an anchor.  The share of a template's words that end up aligned is its coverage.

A text may hold several copies of a notice, so that no word is unique to the whole of it: then the text is halved (halves
overlap by a template's length) and each half aligned.  Parts that hold too few of a template's words to reach the coverage
asked for are left out; this loses nothing, because a word is aligned at most as often as part and template both hold it.

A notice of several paragraphs is several templates, and each paragraph found is a row.  Null, empty and blank texts match nothing; repeated rows are scanned one by one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by license, a paragraph each.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ),
    "ISC": ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
}
#: Share of a template's words that must be aligned.
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs`` (sorted by the first) whose seconds increase."""
    tails: list[int] = []
    top: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        back[n] = top[i - 1] if i else -1
        tails[i : i + 1], top[i : i + 1] = [b], [n]
    out, n = [], top[-1] if top else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(text: list[str], template: list[str], slack: int = 4) -> list[tuple[int, int]]:
    """Aligned ``(place in text, place in template)``.

    The open gaps before the first and after the last anchor are aligned within the template's remaining length plus
    ``slack`` words of text.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template), False, False)]  # the last two: whether an anchor stands before and after
    while todo:
        a0, a1, b0, b1, before, after = todo.pop()
        while before and a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while after and a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_text, in_template = Counter(text[a0:a1]), Counter(template[b0:b1])
        places = {w: i for i, w in enumerate(template[b0:b1], b0) if in_template[w] == 1}
        kept = increasing([(i, places[w]) for i, w in enumerate(text[a0:a1], a0) if w in places and in_text[w] == 1])
        if not kept:
            continue
        out += kept
        first, last = kept[0], kept[-1]
        todo.append((a0 if before else max(a0, first[0] - (first[1] - b0) - slack), first[0], b0, first[1], before, True))
        todo.append((last[0] + 1, a1 if after else min(a1, last[0] + 1 + (b1 - last[1] - 1) + slack), last[1] + 1, b1, True, after))
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1], True, True) for p, q in zip(kept, kept[1:], strict=False)]
    return sorted(out)


def _compact(kept: list[tuple[int, int]], place: list[int], size: int) -> list[tuple[int, int]]:
    """The stretch of an alignment with the most words inside twice the template's length of text."""
    best, a = (0, 0, 0), 0
    for b in range(len(kept)):
        while place[kept[b][0]] - place[kept[a][0]] >= 2 * size:
            a += 1
        best = max(best, (b + 1 - a, -a, b + 1))
    return kept[-best[1] : best[2]]


def scan(text: str, templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, start, end)`` of every notice in the text, offsets in code points, in text order."""
    return Scanner(templates, coverage).scan(text)


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], coverage: float):
        self.coverage = coverage
        self.notices = [(name, _WORD.findall(t.lower())) for name in templates for t in templates[name]]
        self.counts = [Counter(t) for _, t in self.notices]
        self.vocabulary = {w for _, t in self.notices for w in t}

    def _may_cover(self, have: Counter, need: Counter, size: int) -> bool:
        """Whether so many words can be aligned at all."""
        small, large = (have, need) if len(have) < len(need) else (need, have)
        return sum(min(n, large[w]) for w, n in small.items() if w in large) >= self.coverage * size

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        words = [(m.start(), m.end(), w, n) for n, m in enumerate(_WORD.finditer(text)) if (w := m[0].lower()) in self.vocabulary]
        out: list[tuple[str, float, int, int]] = []
        have = Counter(x[2] for x in words)
        for (name, template), need in zip(self.notices, self.counts, strict=True):
            if not self._may_cover(have, need, len(template)):
                continue
            own = [x for x in words if x[2] in need]
            todo = [(0, len(own))]
            found: list[tuple[float, int, int]] = []
            size = len(template)
            while todo:
                a, b = todo.pop()
                part = own[a:b]
                if not self._may_cover(Counter(x[2] for x in part), need, size):
                    continue
                kept = _compact(patience([x[2] for x in part], template), [x[3] for x in part], size)
                share = len(kept) / size
                if share >= self.coverage:
                    i, j = a + kept[0][0], a + kept[-1][0]
                    found.append((share, i, j))
                    todo += [(a, i), (j + 1, b)]
                elif b - a > 4 * size:
                    half = (a + b) // 2
                    todo += [(a, half + size), (half - size, b)]
                elif b - a > size:
                    width = size + size // 2 if b - a > size + size // 2 else size
                    step = max(1, (width - size) // 2) if width > size else 1
                    todo += [(k, min(k + width, b)) for k in range(a, b - width + step, step)]
            taken: list[tuple[int, int]] = []
            for share, i, j in sorted(found, key=lambda x: (-x[0], x[1])):
                if all(j < p or i > q for p, q in taken):
                    taken.append((i, j))
                    out.append((name, share, own[i][0], own[j][1]))
        return sorted(out, key=lambda x: (x[2], x[0]))


def matches(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, license, coverage, start, end)``: a row for each notice found in the whole text, no shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage)
        for pdf in parts:
            out = [(k, *hit) for k, t in zip(pdf["k"], pdf["t"], strict=True) if isinstance(t, str) for hit in scanner.scan(t)]
            yield pd.DataFrame(out, columns=["k", "license", "coverage", "start", "end"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {dict(df.dtypes)[key]}, license string, coverage double, start long, end long").withColumnRenamed("k", key)
