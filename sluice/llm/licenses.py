"""License scans by patience alignment.

Template and text are words.  Words that stand once in both are anchors; the longest increasing run of
anchors is kept, and the gaps between them are aligned in the same way.  A gap without anchors is
trimmed of equal ends and, if small, aligned by longest common subsequence.  Coverage is the share of
the template's words that the alignment places.

Several copies in one area leave no word unique, and anchors of one may hide another.  Where patience
finds too little, the stretch with the longest common subsequence is therefore searched for exactly, from
every word at which enough of the template's words follow within its reach.

Templates that are much alike name the words that tell them apart (versions, BY, NC, the license's own
name); a stretch whose alignment lacks one of them is no find, however much of the rest it covers.

Only texts that hold a gate word are aligned.  A template's gate words are such that more than the
share LESS of its places are theirs, so a text without any cannot reach the coverage; the gate loses
nothing.  Alignment looks at the whole text around gate words, as far as a template with half as many
words inserted can reach.

Defined results: null and empty texts, and texts without a license, give no row; a license found at
several places gives a row for each; of overlapping finds that with more matched words stays, then that
with the better coverage, then the first name; repeated rows are reported each; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import need
from sluice.llm.decontamination import plain

COVERAGE = 0.75
#: Share of a template that may be missing.
LESS = 1 - COVERAGE
#: Words that may stand between a template's words, as a share of it.
INSERTED = 0.5
#: Words on either side of a gap that is aligned by longest common subsequence.
SMALL_GAP = 64

#: License texts and notices (fixed values; public texts, copyright lines left out).
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version.""",
    "LGPL-3.0-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
}

#: Words that tell a template from others like it, some with others in their place; a find without each of
#: them is none (fixed values).
REQUIRED = {
    "BSD-3-Clause": "neither|endorse|promote|derived",
    "GPL-3.0-header": "gnu 3",
    "GPL-2.0-header": "gnu 2",
    "LGPL-3.0-header": "lesser 3",
    "AGPL-3.0-header": "affero 3",
    "MPL-2.0-header": "mozilla",
    "Apache-2.0-header": "apache 2 0",
    "MIT-notice": "mit",
    "Apache-2.0-notice": "apache 2 0",
    "GPL-3.0-notice": "gnu 3",
    "GPL-2.0-notice": "gnu 2",
    "CC-BY-NC-4.0-notice": "cc by nc 4",
    "CC-BY-4.0-notice": "cc by 4",
    "CC-BY-SA-4.0-notice": "cc by sa 4",
    "BSD-3-Clause-notice": "bsd 3",
}

#: Words too common to open the gate (fixed values).
_COMMON = frozenset("a all an and any are as at be by code copy do following for form free general if in is it list may must no not of on one or other out public see shall so source that the this to under use version was with without work you 0 1 2 3 4".split())


def words(text: str) -> list[str]:
    return re.sub("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", text.lower()).split()


def gate_words(template: list[str], less: float = LESS) -> set[str]:
    """The fewest of its words, common ones last, that hold more than ``less`` of its places."""
    times, gate, held = Counter(template), set(), 0
    for w in sorted(times, key=lambda w: (w in _COMMON, -times[w], w)):
        if held > less * len(template):
            break
        gate.add(w)
        held += times[w]
    return gate


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` (sorted by the first place) whose second places increase."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = last[k - 1] if k else -1
        tops[k:k + 1] = [b]
        last[k:k + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in ``a``, in ``b``), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        at = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1}
        anchors = _increasing([(k, at[w]) for k, w in enumerate(a[i:m], i) if in_a[w] == 1 and w in at])
        if anchors:
            out += anchors
            for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
                if p + 1 < r and q + 1 < s:
                    todo.append((p + 1, r, q + 1, s))
        elif m - i <= SMALL_GAP and n - j <= SMALL_GAP:
            out += [(i + p, j + q) for p, q in _subsequence(a[i:m], b[j:n])]
    return sorted(out)


def _common(masks: dict[str, int], size: int, own: list[str]) -> tuple[int, int]:
    """Length of the longest common subsequence with a template of ``size`` words, bit-parallel, and the
    first place in ``own`` by which it is complete."""
    full = (1 << size) - 1
    v, length, end = full, 0, 0
    for k, w in enumerate(own, 1):
        mask = masks.get(w)
        if mask is None:
            continue
        u = v & mask
        if u:
            v = ((v + u) | (v - u)) & full
            now = size - v.bit_count()
            if now > length:
                length, end = now, k
    return length, end


def densest(template: list[str], own: list[str], limit: int, least: float) -> tuple[int, int, int]:
    """(matched, begin, end) of the stretch of at most ``limit`` words of ``own`` that has the longest
    common subsequence with the template, or (0, 0, 0) if that is below ``least``."""
    times, held, n = Counter(template), Counter(), 0
    masks: dict[str, int] = {}
    for k, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << k
    best = (0, 0, 0)
    for s in range(len(own) - 1, -1, -1):
        w = own[s]
        if s + limit < len(own):
            gone = own[s + limit]
            held[gone] -= 1
            n -= held[gone] < times[gone]
        n += held[w] < times[w]
        held[w] += 1
        # ``n`` words are common in any order, so no more are in the template's.
        if n >= least and n > best[0] and w in masks:
            length, end = _common(masks, len(template), own[s : s + limit])
            if length >= least and length > best[0]:
                best = (length, s, s + end)
                if length == len(template):
                    break
    return best


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE, required: dict[str, str] | None = None) -> None:
        self.coverage = coverage
        self.required = {k: [set(w.split("|")) for w in t.split()] for k, t in (REQUIRED if required is None else required).items()}
        self.templates = {k: words(t) for k, t in (templates or TEMPLATES).items()}
        self.gates = {k: gate_words(t, 1 - coverage) for k, t in self.templates.items()}
        self.gate = frozenset().union(*self.gates.values())

    def _areas(self, places: list[int], reach: int, n: int) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for p in places:
            a, b = max(0, p - reach), min(n, p + reach + 1)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def _told(self, name: str, template: list[str], own: list[str]) -> bool:
        """Whether a stretch holds, in its place, each word that tells the template from others."""
        wanted = self.required.get(name)
        if not wanted:
            return True
        if any(w.isdisjoint(own) for w in wanted):
            return False
        held = {template[i] for i, _ in _subsequence(template, own)}
        return not any(w.isdisjoint(held) for w in wanted)

    def _find(self, own: list[str], name: str, begin: int, end: int) -> list[tuple[int, int, int]]:
        """(matched, begin, end) of the finds in an area; it goes on to both sides of a find."""
        template = self.templates[name]
        need = self.coverage * len(template)
        if sum((Counter(template) & Counter(own[begin:end])).values()) < need:
            return []
        pairs = patience(template, own[begin:end])
        limit, n = int(len(template) * (1 + INSERTED)) + 1, len(pairs)
        best, i = (0, 0, 0), 0
        for j in range(n):  # the densest run: most matches within the reach
            while pairs[j][1] - pairs[i][1] >= limit:
                i += 1
            if j - i + 1 > best[0]:
                best = (j - i + 1, i, j)
        if best[0] >= need:
            a, b = begin + pairs[best[1]][1], begin + pairs[best[2]][1] + 1
        else:
            best = densest(template, own[begin:end], limit, need)
            if not best[0]:
                return []
            a, b = begin + best[1], begin + best[2]
        least = -(-int(self.coverage * len(template)) // 1)
        found = [(best[0], a, b)] if self._told(name, template, own[a:b]) else []
        if a - begin >= least:
            found += self._find(own, name, begin, a)
        if end - b >= least:
            found += self._find(own, name, b, end)
        return found

    def scan(self, own: list[str]) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last), without overlaps."""
        if self.gate.isdisjoint(own):
            return []
        found = []
        for name, template in self.templates.items():
            gate = self.gates[name]
            places = [k for k, w in enumerate(own) if w in gate]
            reach = int(len(template) * (1 + INSERTED)) + 1
            for a, b in self._areas(places, reach, len(own)):
                # Areas of many copies are cut with an overlap that holds a whole find.
                for s in range(a, b, 4 * reach):
                    found += [(n, n / len(template), name, x, y) for n, x, y in self._find(own, name, s, min(b, s + 6 * reach))]
        taken, out = [], []
        for _, share, name, x, y in sorted(set(found), key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if all(y <= p or x >= q for p, q in taken):
                taken.append((x, y))
                out.append((name, share, x, y))
        return sorted(out, key=lambda f: f[2])


@lru_cache(maxsize=4)
def _scanner(templates: tuple, coverage: float) -> Scanner:
    return Scanner(dict(templates), coverage)


def _scan(templates: tuple, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, coverage)
        for batch in batches:
            row, found = [], []
            for at in range(0, batch.num_rows, 1000):
                for i, text in enumerate(batch.column("_plain").slice(at, 1000).to_pylist(), at):
                    for f in scanner.scan(text.split(" ")):
                        row.append(i), found.append(f)
            own = [c for c in batch.schema.names if c != "_plain"]
            name, share, x, y = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row, pa.int64())) for c in own), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=[*own, "license", "coverage", "word_start", "word_end"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, license, coverage, word_start, word_end``; places count words of the plain form."""
    need(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), plain(F.col(text_col)).alias("_plain"))
    return texts.mapInArrow(_scan(tuple((templates or TEMPLATES).items()), coverage), f"doc_id {dict(texts.dtypes)['doc_id']}, license string, coverage double, word_start long, word_end long")
