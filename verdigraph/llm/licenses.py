"""Operator 4: licence texts and notices by Dice coefficient over word bigrams.

Units of a text are its lines, its paragraphs (runs of lines between blank ones) and the
whole text. A unit's normalised words are lower-case runs of letters and digits; its set of
word bigrams is compared with each template's: Dice = 2 * common / (sizes' sum). Where no
unit is like a template, windows of words are: any run of words of the text, over lines and
paragraphs or within one, of up to SPAN times the template's words. The likest one is
reported (the shortest, then first of these), then the likest of what is left on either side;
not those within a unit or window that is more like another template.

Pruning is exact: with sizes u and t, Dice is at most 2 * min / (u + t), which bounds the
sizes worth comparing, and a unit or window like a template has at least
t * threshold / (2 - threshold) of its bigrams, so a text with fewer has none. That is counted
for all texts of a batch at once, over hashes of words of ASCII letters and digits (any other
byte ends a word, which can only add to a count), and only the few texts and templates that
reach it are compared. A window begins and ends with a bigram of the template (cutting others
off only adds to its Dice).

Defined results: a null or empty text matches nothing; a null doc_id is reported as null;
repeated rows are reported as often as they come; a unit that equals another unit of its text
(a one-line text) is reported once, as the smallest; ties between templates are all reported;
other columns are never read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, map_batches, mix64, slices, words_of

THRESHOLD = 0.8
#: Words of a window against those of the template, at most.
SPAN = 2

# Licence texts and headers as their authors publish them (white space aside), and common wordings of short notices.
TEMPLATES = {
    "Apache-2.0:notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT:notice": "Released under the MIT License.",
    "MIT:text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0:notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0:header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "CC-BY-NC-4.0:notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0:notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0:notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC:text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause:text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense:text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>""",
    "Zlib:text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0:text": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "copyright:notice": "Copyright. All rights reserved.",
    "BSD-3-Clause:text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MPL-2.0:header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

# How short notices name each licence; windows find a name after any verb ("Licensed", "Released", "Distributed").
_NAMED = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "MIT": ("the MIT License", "an MIT-style license"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "a BSD-style license"),
    "ISC": ("the ISC License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the MPL 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "the AGPLv3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
for _id, _names in _NAMED.items():
    TEMPLATES |= {f"{_id}:notice-{k}": f"under {name}." for k, name in enumerate(_names, 1)}
TEMPLATES |= {f"copyright:notice-{k}": w for k, w in enumerate(("All rights reserved.", "Copyright (c). All rights reserved.", "All rights are reserved."), 1)}
# The full texts as published.
TEMPLATES |= {f"{p.name.removesuffix('.txt')}:text": p.read_text("utf-8") for p in sorted((resources.files(__package__) / "licence_texts").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}

#: For bounds that a rounded division meets exactly.
_SLACK = 1e-9
_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)+")


def _lower(text: str) -> str:
    """Lower case, place by place: dotted capital I is the one letter that would become two."""
    return text.replace("\u0130", "i").lower()


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = _WORD.findall(_lower(text))
    return frozenset(zip(words, words[1:], strict=False))


#: What lies between words of ASCII letters and digits.
_BETWEEN = np.array([not chr(c).isalnum() or c > 127 for c in range(256)])
#: Letters beyond ASCII whose lower case is in it.
_FOLDED = "[\u0130\u212a]"


def _pair_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each bigram of ASCII words, and its text's row."""
    words, first, _, _ = words_of(texts, between=_BETWEEN)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    same = row[1:] == row[:-1]
    return (mix64(words[:-1] * np.uint64(3)) + words[1:])[same], row[1:][same]


class Matcher:
    """Templates with their size bounds and the bigrams that texts are searched for."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [(name, bigrams(text)) for name, text in templates.items()]
        self.templates = [(n, b) for n, b in self.templates if b]
        self.bounds = [(n, b, len(b) * threshold / (2 - threshold) - _SLACK, len(b) * (2 - threshold) / threshold + _SLACK) for n, b in self.templates]
        self.least = min((lo for *_, lo, _ in self.bounds), default=0)
        self.spans = {n: SPAN * len(_WORD.findall(_lower(t))) for n, t in templates.items()}
        # which of the templates' bigrams, by hash, are in which template; those of other letters count as met
        pairs = sorted({p for _, b in self.templates for p in b if (p[0] + p[1]).isascii()})
        keys = _pair_keys(pa.array([" ".join(p) for p in pairs], pa.large_string()))[0] if pairs else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.held = np.array([[pairs[k] in b for _, b in self.templates] for k in order], np.int32).reshape(len(pairs), len(self.templates))
        self.needed = np.array([lo - sum(not (p[0] + p[1]).isascii() for p in b) for _, b, lo, _ in self.bounds])

    def candidates(self, texts: pa.Array) -> dict[int, set[str]]:
        """The rows with enough bigrams of some templates, and those templates' names."""
        every = [n for n, *_ in self.bounds]
        found: dict[int, set[str]] = {}
        if not every or not len(texts):
            return found
        if (self.needed <= 0).any():  # a template of other letters may be anywhere
            return {i: set(every) for i in range(len(texts))}
        keys, row = _pair_keys(texts)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            own = np.unique(row[hit] * len(self.keys) + at[hit])
            rows, starts = np.unique(own // len(self.keys), return_index=True)
            for k in range(0, len(rows), 4096):
                stop = starts[k + 4096] if k + 4096 < len(rows) else len(own)
                counts = np.add.reduceat(self.held[own[starts[k] : stop] % len(self.keys)], starts[k : k + 4096] - starts[k])
                for r, t in zip(*np.nonzero(counts >= self.needed), strict=True):
                    found.setdefault(int(rows[k + r]), set()).add(every[t])
        for i in np.flatnonzero(pc.match_substring_regex(texts, _FOLDED).to_numpy(zero_copy_only=False)).tolist():
            found[i] = set(every)
        return found

    def compare(self, text: str, among: set[str] | None = None) -> list[tuple[str, float]]:
        own = bigrams(text)
        found = []
        for name, theirs, low, high in self.bounds:
            if low <= len(own) <= high and (among is None or name in among):
                dice = 2 * len(own & theirs) / (len(own) + len(theirs))
                if dice >= self.threshold:
                    found.append((name, dice))
        return found

    def scan(self, text: str | None, among: set[str] | None = None) -> list[tuple[str, str, int, int, float]]:
        """(template, unit, start, end, dice) of the text's units that are like a template (of those among)."""
        if not text:
            return []
        seen: set[tuple[int, int]] = set()
        found = []
        whole = [("text", 0, len(text))]
        units = [(kind, *m.span()) for kind, p in (("line", _LINE), ("paragraph", _PARAGRAPH)) for m in p.finditer(text)]
        for kind, a, b in units + whole:
            # a bigram takes three characters at least
            if (a, b) in seen or b - a < 3 * self.least:
                continue
            seen.add((a, b))
            found += [(name, kind, a, b, dice) for name, dice in self.compare(text[a:b], among)]
        return found

    def windows(self, text: str | None, units: list[tuple[str, str, int, int, float]], among: set[str] | None = None) -> list[tuple[str, str, int, int, float]]:
        """(template, unit, start, end, dice) of the text's windows like a template (of those among), outside of the units found like it."""
        if not text:
            return []
        words = [(m.group(), *m.span()) for m in _WORD.finditer(_lower(text))]
        pairs = [(v[0], w[0]) for v, w in zip(words, words[1:], strict=False)]
        own = set(pairs)
        found: list[tuple[str, str, int, int, float]] = []
        before = None
        for name, theirs, low, _ in self.bounds:
            if among is not None and name not in among or len(own) < low or len(own & theirs) < low:
                continue
            if before is None:  # where each bigram was last
                last: dict[tuple[str, str], int] = {}
                before = np.empty(len(pairs), np.int64)
                for i, pair in enumerate(pairs):
                    before[i] = last.get(pair, -1)
                    last[pair] = i
            hit = np.fromiter((p in theirs for p in pairs), bool, len(pairs))
            at = np.flatnonzero(hit)
            found += [(name, "window", words[i][1], words[j + 1][2], dice) for i, j, dice in self._likest(before, hit, int(at[0]), int(at[-1]) + 1, low, len(theirs), self.spans[name])]
        # a licence's name with another one's number is a part of what that one's template is likelier to
        every = [*units, *found]
        found = [f for f in found if not any(o[2] <= f[2] and f[3] <= o[3] and o[4] > f[4] for o in every)]
        return [f for f in found if not any(u[0] == f[0] and u[2] < f[3] and f[2] < u[3] for u in units)]

    def _likest(self, before: np.ndarray, hit: np.ndarray, start: int, stop: int, low: float, size: int, span: int) -> list[tuple[int, int, float]]:
        """(first, last bigram, dice) of the likest window within start:stop, and those beside it."""
        at = start + np.flatnonzero(hit[start:stop])
        heap: list[tuple[float, int, int]] = []

        def push(i: int, stop: int) -> None:
            end = min(stop, i + span - 1)
            new = before[i:end] < i
            dice = 2 * np.cumsum(new & hit[i:end]) / (np.cumsum(new) + size)
            j = int(dice.argmax())
            if dice[j] >= self.threshold:
                heapq.heappush(heap, (-float(dice[j]), j, i))

        for i in at[np.searchsorted(at, at + span) - np.arange(len(at)) >= low].tolist():
            push(i, stop)
        taken: list[tuple[int, int, float]] = []
        while heap:
            dice, j, i = heapq.heappop(heap)
            k = bisect.bisect(taken, (i, stop))
            if k and taken[k - 1][1] >= i:
                continue
            if k < len(taken) and taken[k][0] <= i + j:
                push(i, taken[k][0])  # a part of it is taken: what is left from there
            else:
                taken.insert(k, (i, i + j, -dice))
        return taken


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, unit, start, end, dice of every unit and window of docs (doc_id, text) like a template."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            found, texts = [], flat(batch.column(1))
            for a, b in slices(texts):
                for i, among in sorted(matcher.candidates(texts.slice(a, b - a)).items()):
                    t = texts[a + i].as_py()
                    units = matcher.scan(t, among)
                    found += [(a + i, *hit) for hit in units + matcher.windows(t, units, among)]
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            rest = [pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "template", "unit", "start", "end", "dice"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(own, rows, "doc_id long, template string, unit string, start long, end long, dice double")
