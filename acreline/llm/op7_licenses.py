"""Operator 7: license scans by winnowed template fingerprints and banded alignment.

Template words (lower case, letters and digits) are hashed in runs of GRAM; winnowing
keeps the least of every WINDOW and an inverted index maps each to its templates and
places. A document looks up all its own runs, so any stretch of WINDOW + GRAM - 1 words it
shares with a template hits. Hits of one template on near diagonals make a candidate, whose
stretch is aligned to the template within a band of diagonals, each diagonal once; it is reported if enough of
the template's words are matched, with its coverage and its span in words and characters.
Candidates that can't reach that are passed over before: their stretch has too few of the
template's words (counted for all candidates at once), or too few in order (bit-parallel).

Texts are scanned one by one and whole: nothing is shuffled, and the index is as small as
the list of templates. A whole licence and its first sentences are templates of their own, so a
text that has both is reported for both. Null and empty texts have no match and give no row;
repeated rows give repeated rows, an empty table none, and other columns play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acreline.llm.common import arrow_slices, byte_values, minimizers, prefix_sums, range_hash, rolling, texts

GRAM = 3
WINDOW = 3
#: Share of a template's words that a match covers at least.
COVERAGE = 0.8

# Sentences by which public licences are declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "MIT-whole": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-whole": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-whole": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, license string, coverage double, matched int, start_word int, end_word int, start_char int, end_char int"


def words_in(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, first characters, ends) of the words of a text."""
    found = [(m.group().lower().encode(), m.start(), m.end()) for m in _WORD.finditer(text)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw, start, end = zip(*found, strict=True)
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return range_hash(prefix_sums(byte_values(np.frombuffer(b"".join(raw), np.uint8))), at[:-1], at[1:]), np.array(start), np.array(end)


class Index:
    """Winnowed runs of the templates, by hash."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        self.words = [words_in(t)[0] for t in templates.values()]
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.bits: list[dict[int, int]] = [defaultdict(int) for _ in self.words]
        for bits, words in zip(self.bits, self.words, strict=True):
            for i, w in enumerate(words.tolist()):
                bits[w] |= 1 << i
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            grams = rolling(prefix_sums(words), min(GRAM, len(words)))
            for at in minimizers(grams, min(WINDOW, len(grams))).tolist() if len(grams) else []:
                self.places[int(grams[at])].append((t, at))
        self.hashes = np.array(sorted(self.places), np.uint64)


def shared(counts: tuple[np.ndarray, np.ndarray], ordered: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of a template's words each stretch from low to high has, whatever their order; `ordered` are the text's words sorted, `places` where they stand."""
    out = np.zeros(len(low), np.int64)
    for n, a, b in zip(counts[1], np.searchsorted(ordered, counts[0]), np.searchsorted(ordered, counts[0], "right"), strict=True):
        if a < b:
            out += np.minimum(np.searchsorted(places[a:b], high) - np.searchsorted(places[a:b], low), n)
    return out


def in_order(bits: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a template of n words, given as bits of each word's places, and `words`."""
    whole = (1 << n) - 1
    open_ = whole
    for w in words:
        at = open_ & bits.get(w, 0)
        if at:
            open_ = ((open_ + at) | (open_ - at)) & whole
    return n - open_.bit_count()


def align(template: np.ndarray, words: np.ndarray, band: int, diagonal: int = 0) -> tuple[int, int, int]:
    """(words in common, first and end of the matched stretch of `words`) of the best banded alignment.

    Word i of the template may match the words up to `band` places from i + diagonal. The
    first and last match travel with the count; of equal counts the tighter stretch wins.
    """
    m = len(words)
    best = [(0, 0, 0)] * (m + 1)  # common, first matched, -(last matched)
    for i, wanted in enumerate(template.tolist()):
        before, best = best, best[:]
        low, high = max(0, i + diagonal - band), max(0, min(m, i + diagonal + band + 1))
        for j in range(low, high):
            top = max(best[j], before[j + 1])
            if words[j] == wanted:
                c, f, _ = before[j]
                top = max(top, (c + 1, f if c else j, -j))
            best[j + 1] = top
        for j in range(high, m):
            best[j + 1] = max(best[j + 1], best[j])
    c, f, e = best[m]
    return c, f, 1 - e


def scan(text: str, index: Index, least: float = COVERAGE) -> list[tuple[str, float, int, int, int, int, int]]:
    """(license, coverage, matched words, first word, end word, first character, end character), by place."""
    words, start, end = words_in(text)
    grams = rolling(prefix_sums(words), GRAM)
    if not len(grams):
        return []
    at = np.searchsorted(index.hashes, grams)
    hits = np.flatnonzero(index.hashes[np.minimum(at, len(index.hashes) - 1)] == grams)
    by: dict[int, list[int]] = defaultdict(list)
    places = np.argsort(words, kind="stable")
    ordered, plain_words = words[places], words.tolist()
    for h in hits.tolist():
        for t, p in index.places[int(grams[h])]:
            by[t].append(h - p)
    out = []
    for t, diagonals in by.items():
        template = index.words[t]
        band = max(2, len(template) // 5)
        done = 0
        ds = np.unique(diagonals)
        can = shared(index.counts[t], ordered, places, np.maximum(0, ds - band), np.minimum(len(words), ds + len(template) + band))
        for d in ds[can >= least * len(template)].tolist():
            # words of the match before aren't matched again
            low, high = max(done, d - band), min(len(words), d + len(template) + band)
            if high - low < least * len(template) or in_order(index.bits[t], len(template), plain_words[low:high]) < least * len(template):
                continue
            common, first, last = align(template, words[low:high], band, d - low)
            if common >= least * len(template):
                a, b = low + first, low + last
                out.append((index.names[t], common / len(template), common, a, b, int(start[a]), int(end[b - 1])))
                done = b
    return sorted(out, key=lambda x: (x[3], x[4], x[0]))


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """A row for each license declaration in each text, with coverage and span."""
    shared = templates or TEMPLATES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 5]
        for part in arrow_slices(batches):
            rows = [(i, *x) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for x in scan(t, index, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return texts(docs).mapInArrow(work, SCHEMA)
