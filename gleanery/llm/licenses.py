"""License scans by winnowed fingerprints and banded alignment (operator 2).

Words are lower-cased ASCII letters, digits and anything beyond ASCII. Hashes of ``GRAM``-word runs, winnowed to the least of each
``WINNOW`` neighbours, are the fingerprints: any common run of GRAM + WINNOW - 1 words shares one. The
templates' fingerprints form an inverted index from hash to (template, place). A document's fingerprints look up candidates as
(template, diagonal); neighbouring diagonals are one candidate, as wide as they reach, and an alignment of the document's words from ``BAND``
before its first diagonal to ``BAND`` past its last with the whole template gives the matched words. From one matched word to the next the diagonal moves
by 2 * BAND at most. Coverage is the share of the template's words that match, in order. Every occurrence in a candidate counts, each aligned
past the one before; one below ``least`` goes, and of overlapping ones of a document the one with more matched words stays.

Of equal coverage the earlier place and then the name by code point goes first. Null and empty texts have no match. A very long text is scanned whole. Rows without a
doc_id are scanned like others; other columns are ignored. Repeated rows are scanned each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.common import id_and_text, map_texts, record
from gleanery.llm.merge_table import HashTable
from gleanery.llm.words import U, run_hashes, sliding_min

GRAM, WINNOW, BAND = 3, 2, 6
LEAST_COVERAGE = 0.8
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")
#: Opening clauses and notices of public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD-2-Clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def tag(name: str) -> str:
    """The machine-readable notice of a license. It counts only as a whole, as tags of different licenses differ in one word."""
    return f"SPDX-License-Identifier: {name}"


def words_of(text: bytes) -> list[tuple[bytes, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def winnowed(own: np.ndarray, gram: int = GRAM, winnow: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints of a sequence of word hashes."""
    n = len(own) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = run_hashes(own, np.arange(n), np.arange(gram, gram + n))
    if n < winnow:
        at = np.array([int(grams.argmin())])
    else:
        least = sliding_min(grams, winnow)
        at = np.unique(np.concatenate([np.flatnonzero(grams[k : k + len(least)] == least) + k for k in range(winnow)]))
    return at, grams[at]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.names, self.words, self.whole = [], [], []
        places: dict[int, list[tuple[int, int]]] = {}
        for name, variants in templates.items():
            for text in (*variants, tag(name)):
                self.whole.append(text == tag(name))
                words = [w for w, _, _ in words_of(text.encode())]
                at, keys = winnowed(word_hash(words))
                for p, k in zip(at.tolist(), keys.tolist(), strict=True):
                    places.setdefault(k >> 1, []).append((len(self.names), p))
                self.names.append(name)
                self.words.append(words)
        self.places = list(places.values())
        self.table = HashTable()
        self.table.put(np.array(list(places), np.int64), np.arange(len(places), dtype=np.int32))

    def candidates(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first diagonal, last diagonal) of a document's word hashes, one for each run of neighbouring diagonals."""
        at, keys = winnowed(own)
        found = self.table.get((keys >> U(1)).astype(np.int64))
        pairs = sorted({(t, int(at[k]) - p) for k in np.flatnonzero(found >= 0).tolist() for t, p in self.places[found[k]]})
        out: list[tuple[int, int, int]] = []
        for t, d in pairs:
            if out and out[-1][0] == t and d - out[-1][2] <= BAND:
                out[-1] = (t, out[-1][1], d)
            else:
                out.append((t, d, d))
        return out


def occurrences(template: list[bytes], words: list[bytes], first: int, last: int, need: int, band: int = BAND) -> list[tuple[int, int, int]]:
    """(matched words, first place, last place) of each occurrence with ``need`` or more words within ``band`` of the diagonals from first to last.

    The best chain of equal words up to each place has the most words and, of those, starts latest. The earliest chain with enough
    words is carried on as far as it goes; the next occurrence is sought past its end. So each word is read a few times only.
    """
    rows: dict[bytes, list[int]] = {}
    for i, w in enumerate(template):
        rows.setdefault(w, []).append(i)
    points = [(j, i) for j in range(max(0, first - band), min(len(words), last + band + len(template))) for i in rows.get(words[j], ()) if first - band <= j - i <= last + band]
    out, at = [], 0
    while at < len(points):
        chains: list[tuple[int, int]] = []  # (words, start) of the best chain up to each point from ``at`` on
        near, found, stop = at, None, len(words)
        for k in range(at, len(points)):
            j, i = points[k]
            if j > stop:
                break
            while points[near][0] < j - len(template) - 2 * band:
                near += 1
            best = (0, j)
            for m in range(near, k):
                before, row = points[m]
                if row < i and before < j and abs(j - i - before + row) <= 2 * band and chains[m - at] > best:
                    best = chains[m - at]
            chains.append((best[0] + 1, best[1]))
            if chains[-1][0] >= need and (found is None or (chains[-1][1] <= once and chains[-1] > found[:2])):
                if found is None:
                    once, stop = j, j + len(template) + 2 * band
                found = (*chains[-1], j)
        if found is None:
            break
        out.append(found)
        while at < len(points) and points[at][0] <= found[2]:
            at += 1
    return out


def matches(index: Index, text: bytes, least: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first character, past the last, matched words) of each match in one text."""
    words = words_of(text)
    if len(words) < GRAM:
        return []
    plain = [w for w, _, _ in words]
    found = []
    for t, first, last in index.candidates(word_hash(plain)):
        size = len(index.words[t])
        need = size if index.whole[t] else next(n for n in range(1, size + 2) if n / size >= least or n > size)
        found += [(n, n / size, a, b, index.names[t]) for n, a, b in occurrences(index.words[t], plain, first, last, need)]
    found.sort(key=lambda x: (-x[0], -x[1], x[2], x[4]))
    kept: list = []  # by first place
    for x in found:
        k = bisect(kept, x[2], key=lambda y: y[2])
        if (k == 0 or kept[k - 1][3] < x[2]) and (k == len(kept) or x[3] < kept[k][2]):
            kept.insert(k, x)
    out, byte, place = [], 0, 0
    for n, share, a, b, name in kept:
        start = place + len(text[byte : words[a][1]].decode("utf-8", "ignore"))
        byte = words[b][2]
        place = start + len(text[words[a][1] : byte].decode("utf-8", "ignore"))
        out.append((name, share, start, place, n))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (doc_id, license, coverage, first_char, past_char, n_matched), one for each match in each input row."""
    templates = templates or TEMPLATES
    held: dict = {}

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "index" not in held:
            held["index"] = Index(templates)
        index, rows = held["index"], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(doc_id, *m) for m in matches(index, (text or "").encode(), least)]
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return record(**{n: pa.array(c, k) for n, c, k in zip(("doc_id", "license", "coverage", "first_char", "past_char", "n_matched"), columns, kinds, strict=True)})

    return map_texts(id_and_text(docs, id_col, text_col), kernel, "doc_id long, license string, coverage double, first_char long, past_char long, n_matched long")
