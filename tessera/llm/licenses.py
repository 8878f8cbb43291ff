"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates' and documents' runs of GRAM words are hashed, and of each WINDOW
successive hashes the smallest is a fingerprint, so a common run of
GRAM + WINDOW - 1 words has a common fingerprint. Fingerprints that a document
shares with a template name a candidate and a diagonal; the document's words
around it are aligned with the template in a band of that diagonal. A template is
reported where at least `coverage` of its words match, with that share and the span. Words are compared in
lower case without the marks around them. A template that holds another (a whole licence and
its first paragraph) is reported beside it: spans may overlap.

Null and empty texts hold nothing; a null doc_id stays null; repeated rows are
scanned each; an empty table gives no rows; extra columns are ignored. The
index is of the fixed templates, or of those given; beyond MAX_TEMPLATE_WORDS words they are scanned in parts.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.align import smith_waterman
from tessera.llm.textgrid import Words, chunks, slices

GRAM = 3
WINDOW = 2
COVERAGE = 0.8
BAND = 8
DRIFT = 10  # a tenth of a template may be left out or put in before a copy leaves the band
MAX_TEMPLATE_WORDS = 200_000

#: Public license notices by SPDX name; fixed texts.
TEMPLATES = {
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_AS_IS = "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, ' + _AS_IS

#: Whole public licences by SPDX name; fixed texts.
TEMPLATES |= {
    "MIT": TEMPLATES["MIT/grant"] + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": f"{TEMPLATES['BSD/grant']} {_BSD_CLAUSES} {_BSD_END}",
    "BSD-3-Clause": f"{TEMPLATES['BSD/grant']} {_BSD_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "ISC": TEMPLATES["ISC/grant"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0/boilerplate": TEMPLATES["Apache-2.0/header"] + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
}

_MARKS = re.compile(r"[\"'(),.:;]+")


def _words(texts: list[str]) -> Words:
    return Words([_MARKS.sub(" ", t) for t in texts], fold=True)


def winnow(h: np.ndarray, text: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of each window of one text, and of texts of fewer hashes."""
    count = np.bincount(text, minlength=1)
    first = np.cumsum(count) - count
    few = [first[t] + count[t] - 1 - np.argmin(h[first[t] : first[t] + count[t]][::-1]) for t in np.flatnonzero((count > 0) & (count < size))]
    if len(h) < size:
        return np.array(few, int)
    view = np.lib.stride_tricks.sliding_window_view(h, size)
    places = np.arange(len(view)) + size - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(np.r_[places[text[: len(view)] == text[size - 1 :]], np.array(few, int)])


def _parts(templates: dict[str, str]):
    part: dict[str, str] = {}
    words = 0
    for name in sorted(templates):
        n = len(templates[name].split())
        if part and words + n > MAX_TEMPLATE_WORDS:
            yield part
            part, words = {}, 0
        part[name] = templates[name]
        words += n
    yield part


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start and end (characters of the text, end exclusive)."""
    return reduce(DataFrame.unionByName, (_scan(docs, part, coverage) for part in _parts(templates)))


def _scan(docs: DataFrame, templates: dict[str, str], coverage: float) -> DataFrame:
    import pyarrow as pa

    names = sorted(templates)
    w = _words([templates[k] for k in names])
    words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(names))]
    index: dict[int, list[tuple[int, int]]] = {}
    at, h = w.windows(GRAM)
    for p in winnow(h, w.text[at]):
        i = int(w.text[at[p]])
        index.setdefault(int(h[p]), []).append((i, int(at[p] - w.first[i])))
    keys = np.array(sorted(index), np.uint64)

    def rows_of(doc_ids, texts):
        w = _words(texts)
        at, h = w.windows(GRAM)
        chosen = winnow(h, w.text[at])
        at, h = at[chosen], h[chosen]
        k = np.clip(np.searchsorted(keys, h), 0, max(0, len(keys) - 1))
        hit = np.flatnonzero(keys[k] == h) if len(keys) else []
        places: dict[tuple[int, int], list[int]] = {}
        for x in hit:
            p = int(at[x])
            for i, q in index[int(h[x])]:
                places.setdefault((int(w.text[p]), i), []).append(p - q)
        out = []
        for (d, i), diagonals in sorted(places.items()):
            t, first, last = words[i], int(w.first[d]), int(w.first[d + 1])
            done = -1
            for g in sorted(set(diagonals)):
                if g <= done:
                    continue
                half = BAND + len(t) // DRIFT
                begin, end = max(first, g - half), min(last, g + len(t) + half)
                _, matched, _, _, s, e = smith_waterman(t, w.hash[begin:end], centre=g - begin, half=half)
                if matched >= coverage * len(t):
                    out.append((d, i, matched / len(t), begin + s - first, begin + e - first))
                    done = begin + e - 1
        if not out:
            return []
        result = []
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, i, c, s, e in out:
            if d not in spans:
                plain = _MARKS.sub(lambda m: " " * len(m[0]), texts[d])
                spans[d] = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", plain)]
            result.append((doc_ids[d], names[i], c, spans[d][s][0], spans[d][e - 1][1]))
        return result

    def run(batches):
        for batch in slices(batches):
            ids, texts, rows = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()], []
            for a, b in chunks(texts):
                rows += rows_of(ids[a:b], texts[a:b])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "license", "coverage", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, start long, end long")
