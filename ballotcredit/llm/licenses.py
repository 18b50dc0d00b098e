"""License scans by patience alignment of notices with texts.

Words that are unique both in a notice and in a part of the text anchor the alignment; the longest
increasing run of anchors is kept, and the gaps between them are aligned in the same way. The share
of a notice's words that are matched is its coverage. One-line notices, which are too short to
align, are told by patterns of a license name and a version.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import KeysView, Mapping
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, fresh, without

# One-line notices, file headers and opening paragraphs by name.
NOTICES: Mapping[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "BSD line": "Released under the BSD License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License,
        v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone
        is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means.""",
}
_DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
    EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
    ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
    OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""


def _template(name: str) -> str:
    """A whole license as its authors publish it, from the package."""
    text = pkgutil.get_data(__package__, f"license_texts/{name}.txt")
    if not text:
        raise FileNotFoundError(f"no text of the license {name}")
    return text.decode()


_WHOLE = ("Apache-2.0", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "GFDL-1.3",
          "Artistic")
# Whole licenses by name.
TEXTS: Mapping[str, str] = {
    "MIT text": NOTICES["MIT"] + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC text": NOTICES["ISC"] + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause text": NOTICES["BSD-2-Clause"] + " " + _DISCLAIMED,
    "BSD-3-Clause text": NOTICES["BSD-2-Clause"] + """ Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. """ + _DISCLAIMED,
    **{f"{n} text": _template(n) for n in _WHOLE},
}
# License names in one-line notices, with or without a version.
_VERSION = r"(?:[\s,(-]{0,3}(?:version|ver\.?|v\.?)?\s{0,2}(\d(?:\.\d)?)(?![\w])(?:\.0\b)?)"
_NAMES = (
    ("CC-{}", r"(?:CC|Creative\s+Commons)[\s-]+(BY(?:[\s-]+(?:NC|SA|ND))*)" + _VERSION),
    ("CC0", r"CC0(?:[\s-]+1\.0)?"),
    ("CC-{}", r"Creative\s+Commons\s+(Attribution(?:[\s-]+(?:Non[\s-]?Commercial|Share[\s-]?Alike|"
              r"No[\s-]?Deriv(?:ative)?s))*)(?:\s+licen[sc]e)?" + _VERSION + "?"),
    ("AGPL", r"(?:GNU\s+)?(?:AGPL|Affero\s+General\s+Public\s+Licen[sc]e)" + _VERSION + "?"),
    ("LGPL", r"(?:GNU\s+)?(?:LGPL|(?:Lesser|Library)\s+General\s+Public\s+Licen[sc]e)" + _VERSION + "?"),
    ("GPL", r"(?:(?:GNU\s+)?GPL|GNU\s+General\s+Public\s+Licen[sc]e)" + _VERSION + "?"),
    ("Apache", r"Apache(?:\s+Software)?(?:\s+Licen[sc]e" + _VERSION + r"?|[\s-]2\.0\b)"),
    ("MPL", r"(?:MPL|Mozilla\s+Public\s+Licen[sc]e)" + _VERSION),
    ("EPL", r"(?:EPL|Eclipse\s+Public\s+Licen[sc]e)" + _VERSION),
    ("BSL", r"Boost\s+Software\s+Licen[sc]e" + _VERSION + "?"),
    ("BSD", r"(?:(\d)-clause\s+)?BSD(?:[\s-]+(\d)[\s-]+clause(?:\s+licen[sc]e)?|[\s-]+(?:style\s+)?"
            r"licen[sc]e)"),
    ("MIT", r"MIT(?:/X11)?[\s-]+licen[sc]e"),
    ("ISC", r"ISC\s+licen[sc]e"),
    ("Unlicense", r"The\s+Unlicense"),
)
# The parts of a Creative Commons license by their names.
_PARTS = {"attribution": "BY", "noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND",
          "noderivs": "ND"}
_UNDER = (r"(?:(?:licen[sc]ed|released|distributed|published|available|made\s+available|provided|"
          r"offered|shared)\s+under\s+)?(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:an?\s+)?")
_LINES = [(name, re.compile(rf"(?<!\w){_UNDER}{shape}(?!\w)", re.I)) for name, shape in _NAMES]
_SPDX = re.compile(r"SPDX-License-Identifier:\s{0,3}([\w.+-]+(?:[ \t]+(?-i:AND|OR|WITH)"
                   r"[ \t]+[\w.+-]+)*)", re.I)
ANCHORS = (1, 2, 4)  # words of an anchor, the first that finds one
_TOLD = re.compile(rb"licen[sc]|gpl|cc[ -]+by|commons|cc0|\bmpl|\bepl|bsd|apache")
_WORD = re.compile(r"\w+")
_BYTES = re.compile(rb"[a-z0-9_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def lines(text: str) -> list[tuple[int, int, str]]:
    """(first character, character after the last, license) of each one-line notice, by a license
    name and its version."""
    found = [(m.start(), m.end(), f"{m[1].rstrip('.')} line") for m in _SPDX.finditer(text)]
    for name, shape in _LINES:
        for m in shape.finditer(text):
            told = [g.rstrip(".") for g in m.groups() if g]
            if "{}" in name:
                parts = re.sub(r"(?i)(non|share|no)[\s-]+(?=c|a|d)", r"\1", told.pop(0))
                parts = [p.lower() for p in re.split(r"[\s-]+", parts)]
                shown = name.format("-".join(_PARTS.get(p, p.upper()) for p in parts))
            else:
                shown = name
            if name == "BSD" and told:
                told = [f"{told[0]}-Clause"]
            elif told and "." not in told[0]:
                told = [f"{told[0]}.0"]
            found.append((m.start(), m.end(), "-".join([shown, *told]) + " line"))
    return found


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience piles."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def _anchors(notice: list[str], a: int, b: int, text: list[str], c: int, d: int,
             size: int) -> list[tuple[int, int]]:
    """Places of runs of ``size`` words that occur once in notice[a:b] and once in text[c:d], as
    many as rise in both."""
    ours = notice[a:b] if size == 1 else [tuple(notice[i:i + size]) for i in range(a, b - size + 1)]
    theirs = text[c:d] if size == 1 else [tuple(text[i:i + size]) for i in range(c, d - size + 1)]
    once = Counter(ours)
    there = Counter(w for w in theirs if w in once)
    place = {w: j for j, w in enumerate(theirs, c) if there.get(w) == 1}
    pairs = [(i, place[w]) for i, w in enumerate(ours, a) if once[w] == 1 and w in place]
    return [pairs[i] for i in longest_rise([y for _, y in pairs])]


def align(notice: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Matched places (in the notice, in the text) in rising order.

    Where no word is unique on both sides, runs of two and of four words are. Beside an anchor the
    words that continue it match too; at the outer edges nothing does.
    """
    found, gaps = [], [(0, len(notice), 0, len(text), False, False)]
    while gaps:
        a, b, c, d, after, before = gaps.pop()
        while after and a < b and c < d and notice[a] == text[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while before and a < b and c < d and notice[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        chain = []
        for size in ANCHORS:
            chain = chain or _anchors(notice, a, b, text, c, d, size)
        found += chain
        if chain:
            edges = [(a - 1, c - 1), *chain, (b, d)]
            gaps += [(x + 1, u, y + 1, v, k > 0 or after, k < len(chain) or before)
                     for k, ((x, y), (u, v)) in enumerate(zip(edges, edges[1:], strict=False))]
    return sorted(found)


class Notice:
    """A notice's words, and what every match of it holds.

    A match lacks ``may_miss`` of the words at most. So the text has ``need`` words that the notice
    has, each counted as often as both have it (inserted words do no harm); of any ``may_miss`` + 1
    different words it has one; and of ``seeds``, words with more than ``may_miss`` places in the
    notice, one is matched at one of its places, which tells where the match starts.
    """

    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, words(text)
        self.counts = Counter(self.words)
        if not self.words:
            raise ValueError(f"the notice {name} has no words")
        self.need = max(1, -int(-coverage * len(self.words) // 1))
        may_miss = len(self.words) - self.need
        rare = sorted(self.counts, key=lambda w: (self.counts[w], -len(w), w))
        self.hints = frozenset(w.encode() for w in rare[:may_miss + 1]) if (
            len(rare) > may_miss) else None
        self.plain = {w.encode(): n for w, n in self.counts.items()}
        self.seeds: dict[str, list[int]] = {}
        left = may_miss + 1
        for w in rare:
            if left <= 0:
                break
            self.seeds[w] = [k for k, v in enumerate(self.words) if v == w]
            left -= len(self.seeds[w])
        self.slack = len(self.words) // 4 + 2

    def may_be_in(self, there: Counter, seen: KeysView) -> bool:
        """Whether a text of these words can hold a match."""
        if self.hints is not None and self.hints.isdisjoint(seen):
            return False
        return sum(min(n, there[w]) for w, n in self.plain.items() if w in seen) >= self.need

    def find(self, text: list[str], places: dict[str, list[int]]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, matched words) of each match."""
        if sum(min(n, len(places.get(w, ()))) for w, n in self.counts.items()) < self.need:
            return []
        starts = sorted(p - k for w, at in self.seeds.items() for p in places.get(w, ()) for k in at)
        found, i = [], 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= self.slack:
                j += 1
            low = max(0, starts[i] - self.slack)
            high = min(len(text), starts[j] + len(self.words) + self.slack)
            pairs = align(self.words, text[low:high])
            if len(pairs) >= self.need:
                found.append((low + pairs[0][1], low + pairs[-1][1] + 1, len(pairs)))
            i = j + 1
        return found


def scan_licenses(
    docs: DataFrame,
    notices: Mapping[str, str] | None = None,
    coverage: float = 0.9,
    text: str = "text",
) -> DataFrame:
    """``docs`` with licenses: array of (license, start, end, coverage) by start, in code points.

    Every place of a text is reported where at least ``coverage`` of a notice's words align; of
    matches that overlap, the one with most matched words stays, then the earlier one, then the
    first name. Words are compared in lower case without punctuation. Without ``notices`` these are
    ``NOTICES`` and ``TEXTS``, and license names with a version, or SPDX identifiers, are told by
    pattern as well, in whatever sentence (coverage 1). A notice without words raises.

    A missing or empty text has no licenses; rows that repeat are scanned alike; an input column
    named licenses is replaced. An empty table gives none.
    """
    by_pattern = notices is None
    listed = {**NOTICES, **TEXTS} if notices is None else notices
    known = sorted((Notice(k, v, coverage) for k, v in listed.items()), key=lambda n: n.need)
    # ASCII notices are compared with bytes first, which passes most texts over
    plain = all(w.isascii() for n in known for w in n.counts)
    item = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("coverage", pa.float64())])

    @F.arrow_udf("array<struct<license:string,start:bigint,end:bigint,coverage:double>>")
    def spans(texts: pa.Array) -> pa.Array:
        result = []
        for value in texts:
            raw = value.as_buffer()
            low = b"" if raw is None else raw.to_pybytes().lower()
            told = by_pattern and _TOLD.search(low) is not None
            if plain:
                there = Counter(_BYTES.findall(low))
                seen = there.keys()
                near = [n for n in takewhile(lambda n: n.need <= there.total(), known)
                        if n.may_be_in(there, seen)]
            else:
                near = known
            if not near and not told:
                result.append([])
                continue
            found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(value.as_py() or "")]
            text_words = [w for w, _, _ in found]
            places: dict[str, list[int]] = {}
            for i, w in enumerate(text_words):
                places.setdefault(w, []).append(i)
            matches = [(-n, a, notice.name, b, n / len(notice.words))
                       for notice in near for a, b, n in notice.find(text_words, places)]
            if told:
                begins, ends = [a for _, a, _ in found], [b for _, _, b in found]
                for x, y, name in lines(value.as_py()):
                    a, b = bisect_left(begins, x), bisect_left(ends, y) + 1
                    matches.append((a - b, a, name, b, 1.0))
            kept: list[tuple[int, int, str, float]] = []
            for _, a, name, b, share in sorted(matches):
                if all(b <= x or a >= y for x, y, _, _ in kept):
                    kept.append((a, b, name, share))
            result.append([{"license": name, "start": found[a][1], "end": found[b - 1][2],
                            "coverage": share} for a, b, name, share in sorted(kept)])
        return pa.array(result, pa.list_(item))

    new = fresh(docs.columns, "licenses_")
    kept_columns = without(docs, ["licenses"]).columns
    scanned = docs.withColumn(new, spans(column(docs, text)))
    return scanned.select(*[column(scanned, c) for c in kept_columns], F.col(new).alias("licenses"))
