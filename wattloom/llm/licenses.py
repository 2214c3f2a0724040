"""License texts in documents by patience alignment.

A template is aligned with a document by the words that occur once in both: the longest
run of them that rises in both is the anchor chain, gaps between anchors are aligned the
same way, and equal words beside anchors are taken in. Coverage is the share of the
template's words that the alignment matches. Notices differ in a word or two (the license,
its version): these naming words must stand in the text. A document is aligned with a template only
where it holds enough of the template's distinct words, which loses nothing: a coverage
of c needs at least that share of words, so the count is a necessary condition.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import text as tx
from wattloom.session import ship

MIN_COVERAGE = 0.8
#: Words of a template under which it is a notice or header, whose words stand close.
NOTICE = 100

_FILES = "Apache-2.0 Artistic-1.0-Perl CC0-1.0 CC-BY-SA-3.0 CC-BY-SA-4.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0"

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_NO_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
_HEADER = "This {} is free software{} you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation{} {}version {} of the License{}"
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
_AGPL = "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/"
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _known() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Templates, and the phrases of a template that must stand in the text word for word."""
    whole = {name: pkgutil.get_data("wattloom.llm", f"license_texts/{name}.txt").decode() for name in _FILES.split()}
    whole |= {
        "MIT": f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
        "MIT-0": f"{_GRANT}. {_AS_IS}",
        "ISC": f"{_NO_FEE}, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR}",
        "0BSD": f"{_NO_FEE}. {_AUTHOR}",
        "BSD-2-Clause": f"{_BSD[0]} {_BSD[3]}",
        "BSD-3-Clause": f"{_BSD[0]} 3. {_BSD[2]} {_BSD[3]}",
        "BSD-4-Clause": f"{_BSD[0]} 3. {_BSD[1]} 4. {_BSD[2]} {_BSD[3]}",
        "Unlicense": _UNLICENSE,
        "Zlib": _ZLIB,
        "AGPL-3.0-section-13": _AGPL,
    }
    naming: dict[str, tuple[str, ...]] = {
        "GPL-3.0": ("use with the gnu affero general public license",),
        "ISC": ("appear in all copies",),
        "BSD-3-Clause": ("endorse or promote products",),
        "BSD-4-Clause": ("advertising materials mentioning features",),
    }
    short: dict[str, str] = {}

    def add(key: str, text: str, *phrases: str) -> None:
        short[key], naming[key] = text, phrases

    add("Apache-2.0-header", _APACHE, "apache license version 2 0")
    add("MPL-2.0-header", _MPL, "mozilla public license v 2 0")
    for v in ("1.1", "2.0"):
        add(f"Apache-{v}-notice", f"Licensed under the Apache License, Version {v}.", f"apache license version {v}")
    for v in ("1.1", "2.0"):
        add(f"MPL-{v}-notice", f"Licensed under the Mozilla Public License, Version {v}.", f"mozilla public license version {v}")
    for v in ("1.0", "2.0"):
        add(f"EPL-{v}-notice", f"Licensed under the Eclipse Public License, Version {v}.", f"eclipse public license version {v}")
    add("BSL-1.0-notice", "Distributed under the Boost Software License, Version 1.0.", "boost software license version 1 0")
    for name in ("MIT", "BSD", "ISC", "Zlib", "WTFPL"):
        add(f"{name}-notice", f"Released under the {name} License.", name)
    add("Unlicense-notice", "Released under the Unlicense.", "unlicense")
    for n in (2, 3, 4):
        add(f"BSD-{n}-Clause-notice", f"Released under the BSD {n}-Clause License.", f"bsd {n} clause")
    gnu = [("GPL", "GNU General Public License", "1 2 3"), ("LGPL", "GNU Library General Public License", "2"), ("LGPL", "GNU Lesser General Public License", "2 2.1 3"), ("AGPL", "GNU Affero General Public License", "1 3"), ("GFDL", "GNU Free Documentation License", "1.1 1.2 1.3")]
    for short_name, name, versions in gnu:
        for v in versions.split():
            key = f"{short_name}-{v if '.' in v else v + '.0'}"
            form = " library" if "Library" in name else ""
            add(f"{key}-notice{form}", f"This work is licensed under the {name}, version {v}.", f"{name} version {v}")
            if short_name != "GFDL":
                kind = "library" if short_name == "LGPL" and v < "3" else "program"
                add(f"{key}-header or-later{form}", _HEADER.format(kind, ":", name, ",", "either ", v, ", or (at your option) any later version."), name, f"version {v} of")
                add(f"{key}-header only{form}", _HEADER.format(kind, ":", name, ",", "", v, "."), name, f"version {v} of")
    parts = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    cc = [f"{c}-{v}" for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    for c in cc:
        *kinds, v = c.split("-")
        long = "-".join(parts[k] for k in kinds) + f" {v}"
        add(f"CC-{c}-notice", f"Licensed under CC {'-'.join(kinds)} {v}.", f"cc {c}")
        add(f"CC-{c}-notice long", f"This work is licensed under a Creative Commons {long} International License.", f"commons {long}")
    add("CC0-1.0-notice", "Licensed under CC0 1.0.", "cc0 1 0")
    return whole | short, naming


#: Whole license texts, headers, notices and SPDX tags. A key is the name that
#: is put out, and after a blank the form where a name has several.
TEMPLATES, NAMING = _known()


_SPDX = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)")


def _tags() -> dict[str, str]:
    """SPDX ids in lower case, and as they are put out."""
    cc = [f"{c}-{v}" for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    tags = [*_FILES.split(), "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Unlicense", "Zlib", "AGPL-3.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Apache-1.1", "WTFPL", *(f"CC-{c}" for c in cc)]
    gnu = [t for t in tags if re.match("A?L?GPL|GFDL", t)]
    tags += [t + end for t in gnu for end in ("-only", "-or-later", "+")]
    return {t.lower(): t for t in tags}


TAGS = _tags()


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by their first entry, that rises in the second."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        back.append(at[n - 1] if n else -1)
        if n == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[n], at[n] = y, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched (text, template) positions of a patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        where = {w: j for j, w in enumerate(template[c:d], c) if right[w] == 1}
        chain = _rising([(i, where[w]) for i, w in enumerate(text[a:b], a) if left[w] == 1 and w in where])
        if not chain:
            continue
        i, j = a, c
        for x, y in [*chain, (b, d)]:
            todo.append((i, x, j, y))
            if x < b or y < d:
                out.append((x, y))
            i, j = x + 1, y + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        _, _, _, h, first = tx.words(list(templates.values()))
        self.templates = [(name.split(" ")[0], h[a:b].tolist(), self._places(name, h[a:b].tolist())) for name, a, b in zip(templates, first[:-1], first[1:]) if b > a]
        self.known = np.unique(h)
        #: Words by templates: how often a template has a word.
        self.counts = np.zeros((len(self.known), len(self.templates)), np.int32)
        for t, (_, words, _) in enumerate(self.templates):
            np.add.at(self.counts[:, t], np.searchsorted(self.known, np.array(words, np.uint64)), 1)
        self.least = coverage * self.counts.sum(0)

    @staticmethod
    def _places(name: str, words: list[int]) -> list[tuple[int, int]]:
        """Where the naming phrases stand in a template."""
        out = []
        for phrase in NAMING.get(name, ()):
            want = tx.words([phrase])[3].tolist()
            out += [(i, i + len(want)) for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want][:1]
        return out

    def find(self, texts: list[str]) -> list[tuple]:
        """(text, license, coverage, first word, end word) of every license: its best place
        among those that no better template takes."""
        joined, start, end, h, first = tx.words(texts)
        if not len(h) or not len(self.known):
            return []
        tags: dict[int, list[tuple]] = defaultdict(list)
        for m in _SPDX.finditer(joined):
            i = int(np.searchsorted(first, np.searchsorted(start, m.start()), "right")) - 1
            unless = False
            for word in re.finditer(r"[a-z0-9.+-]+", m[1]):
                name, word_at = word[0].rstrip("."), m.start(1) + word.start()
                if name in TAGS and not unless:
                    a, b = np.searchsorted(start, word_at), np.searchsorted(end, word_at + len(name), "right")
                    tags[i].append((int(b - a), 1.0, int(a - first[i]), int(b - first[i]), f"{TAGS[name]}-tag"))
                unless = name == "with"  # an exception comes next
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == h)
        bounds = np.searchsorted(hits, first).tolist()
        out = []
        for i in range(len(texts)):
            places = hits[bounds[i] : bounds[i + 1]]
            if not len(places) and i not in tags:
                continue
            here, n = np.unique(at[places], return_counts=True)
            shared = np.minimum(self.counts[here], n[:, None]).sum(0)
            found = tags.get(i, [])
            for t in np.flatnonzero(shared >= self.least).tolist():
                name, words, naming = self.templates[t]
                for matched, a, b in self._find(h[first[i] : first[i + 1]], places - first[i], words, naming, self.coverage):
                    if matched >= self.coverage * len(words):
                        found.append((2 * matched - len(words), matched / len(words), a, b, name))
            out += [(i, *row) for row in self._best(found, int(first[i + 1] - first[i]))]
        return out

    @staticmethod
    def _best(found: list[tuple], size: int) -> list[tuple]:
        """Of places that share over half of the words, the template with the most matched
        less missed words; of each license the best place that is left."""
        taken = np.zeros(size, bool)
        best: dict[str, tuple] = {}
        for _, share, a, b, name in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3], f[4])):
            if 2 * np.count_nonzero(taken[a:b]) > b - a:
                continue
            taken[a:b] = True
            if name not in best or share > best[name][1]:
                best[name] = (name, round(share, 6), a, b)
        return list(best.values())

    @staticmethod
    def _find(text: np.ndarray, places: np.ndarray, words: list[int], naming: list[tuple[int, int]], coverage: float) -> Iterator[tuple[int, int, int]]:
        """(matched words, first word, end word) of the template's places.

        Notices with naming phrases: around each place of the first one, all of them aligned
        whole. Else first over windows of two templates, which finds copies that stand close. What
        is left beside them is aligned whole, however far its words lie apart; where a text
        repeats the words that would be anchors, it is divided before each repetition."""
        if naming and len(words) < NOTICE:
            i, j = naming[0]
            starts = places[text[places] == words[i]]
            for k in range(1, j - i):
                starts = starts[starts + k < len(text)]
                starts = starts[text[starts + k] == words[i + k]]
            slack = max(2, len(words) // 4)
            for p in starts.tolist():
                lo = max(0, p - i - slack)
                left = align(text[lo:p].tolist(), words[:i])
                right = align(text[p + j - i : p + len(words) - i + slack].tolist(), words[j:])
                pairs = [*((lo + x, y) for x, y in left), *((p + k, i + k) for k in range(j - i)), *((p + j - i + x, j + y) for x, y in right)]
                where = {y: x for x, y in pairs}
                if all(where.get(y, -1) == where.get(a, -1) + y - a >= 0 for a, b in naming for y in range(a, b)):
                    yield len(pairs), pairs[0][0], pairs[-1][0] + 1
            return
        own = np.isin(text[places], np.array(words, np.uint64))
        spots = places[own]  # words outside the template match nothing: only its own are aligned
        known = text[spots].tolist()
        least = coverage * len(words)

        def good(pairs: list[tuple[int, int]], lo: int) -> bool:
            if not pairs or len(pairs) < least:
                return False
            where = {y: int(spots[lo + x]) for x, y in pairs}
            return all(where.get(y, -1) == where.get(a, -1) + y - a >= 0 for a, b in naming for y in range(a, b))

        found: list[tuple[int, int, int]] = []
        for lo in range(0, max(1, len(known) - len(words)), len(words)):
            pairs = align(known[lo : lo + 2 * len(words)], words)
            if good(pairs, lo):
                found.append((len(pairs), lo + pairs[0][0], lo + pairs[-1][0] + 1))
        copies: list[tuple[int, int, int]] = []
        for m, a, b in sorted(found, key=lambda f: (f[2] - f[1] - 2 * f[0], f[1])):
            if all(b <= c or d <= a for _, c, d in copies):
                copies.append((m, a, b))
        edges = [0, *(x for _, a, b in sorted(copies, key=lambda c: c[1]) for x in (a, b)), len(known)]
        todo = [(a, b, True) for a, b in zip(edges[::2], edges[1::2])]
        once = Counter(words)
        while todo:
            a, b, whole = todo.pop()
            if b - a < least:
                continue
            pairs = align(known[a:b], words)
            if good(pairs, a):
                copies.append((len(pairs), a + pairs[0][0], a + pairs[-1][0] + 1))
                todo += [(a, a + pairs[0][0], True), (a + pairs[-1][0] + 1, b, True)]
            elif whole:
                counts = Counter(w for w in known[a:b] if once[w] == 1)
                times = Counter(n for n in counts.values() if n > 1)
                if times:  # anchors that stand n times: a part for each copy
                    n = max(times, key=lambda k: (times[k], k))
                    seen: Counter[int] = Counter()
                    begin: dict[int, int] = {}
                    for i, w in enumerate(known[a:b], a):
                        if counts.get(w) == n:
                            begin.setdefault(seen[w], i)
                            seen[w] += 1
                    parts = [a, *(begin[k] for k in sorted(begin) if k), b]
                    todo += [(x, y, False) for x, y in zip(parts, parts[1:])]
        for m, a, b in copies:
            yield m, int(spots[a]), int(spots[b - 1]) + 1


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word) of every document and license
    with at least that coverage: its best place in the document that no better template
    takes. The naming words of a template (license, version) must stand in the text.

    Words are lower-cased runs of letters and numbers. Null and empty texts give no rows,
    repeated rows repeated ones; extra columns are ignored; no rows give no rows. The
    templates are a fixed list sent with the task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(TEMPLATES if templates is None else templates, coverage)
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        for batch in tx.slices(batches, 1):
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = [(keys[lo + i], *rest) for lo, hi in tx.chunks(texts) for i, *rest in scanner.find(texts[lo:hi])]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "license", "coverage", "first_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, end_word long")
