"""License scan: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into word trigrams; of each window of neighbouring trigrams one is kept (winnowing), and the kept ones form
an inverted index from trigram to template and place. Every trigram of a text is looked up, so a text that repeats as many words of a template as
a trigram and a window span together is a candidate, wherever they stand. Around each chain of hits the template is aligned with the text
within a band of the hits' diagonal; what covers enough of the template is reported with the words matched and the span in
the text.

Words are compared in lower case without the signs around and inside them. The index depends on the templates only; it is a few
kilobytes and goes to every task.

Defined results: null, empty and unrelated texts give no rows; whole texts are read, however long; several occurrences give
a row each; repeated rows give repeated rows; null ids are kept; extra columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import prepare
from .segments import coded_segments

SIGNS = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GRAM, WINDOW = 3, 2

# fixed values: parts of short licenses; each is a template of its own, for texts that hold no more, and the whole licenses are made of them
MIT_OPENING = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_OPENING = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_REST = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."

# fixed values: license notices, headers and, of the short licenses, whole texts and their parts
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": f"{MIT_OPENING} {MIT_REST}", "mit-opening": MIT_OPENING, "mit-rest": MIT_REST,
    "isc": f"{ISC_OPENING} {ISC_REST}", "isc-opening": ISC_OPENING, "isc-rest": ISC_REST,
    "bsd-2-clause": f"{BSD_OPENING} {BSD_BINARY} {BSD_REST}", "bsd-3-clause": f"{BSD_OPENING} {BSD_BINARY} {BSD_NAMES} {BSD_REST}", "bsd-opening": BSD_OPENING, "bsd-rest": BSD_REST,
    "gpl-3.0": GPL, "gpl-2.0": GPL.replace("version 3", "version 2"),
    "lgpl-3.0": GPL.replace("GNU General", "GNU Lesser General"), "lgpl-2.1": GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "agpl-3.0": GPL.replace("GNU General", "GNU Affero General"),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bare(word: str) -> str:
    return SIGNS.sub("", word.lower())


@dataclass(frozen=True)
class Match:
    template: str
    matched: int
    coverage: float
    first: int
    last: int


class TemplateIndex:
    """Winnowed trigrams of the templates as an inverted index, and alignment of candidates."""

    def __init__(self, templates: dict[str, str], band: int = 8):
        self.band = band
        self.names = sorted(templates)
        words = [[b for w in WORD.findall(templates[n]) if (b := bare(w))] for n in self.names]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.base = len(self.vocabulary) + 1
        self.words = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for ws in words]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.words):
            grams = [int(g) for g in self.grams(ids)]
            order = [xxhash.xxh64_intdigest(str(g)) for g in grams]
            kept = {min(range(a, min(a + WINDOW, len(grams))), key=lambda p: (order[p], -p)) for a in range(max(1, len(grams) - WINDOW + 1))} if grams else set()
            for p in sorted(kept):
                self.postings.setdefault(grams[p], []).append((t, p))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - GRAM + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return (ids[:n] * self.base + ids[1 : n + 1]) * self.base + ids[2 : n + 2]

    def scan(self, ids: np.ndarray, hits: np.ndarray, grams: np.ndarray, least: float) -> list[Match]:
        """Matches in one text of word numbers (0: in no template), given where its trigrams hit."""
        chains: dict[int, list[list[int]]] = {}
        for at, gram in zip(hits.tolist(), grams.tolist()):
            for t, p in self.postings.get(gram, ()):
                start = at - p
                own = chains.setdefault(t, [])
                if own and abs(start - own[-1][1]) <= self.band and p > own[-1][2]:
                    own[-1] = [min(own[-1][0], start), max(own[-1][1], start), p]
                else:
                    own.append([start, start, p])
        found = []
        for t, own in chains.items():
            last_end = -1
            for low, high, _ in own:
                match = self._align(t, ids, low, high, last_end + 1)
                if match.coverage >= least:
                    found.append(match)
                    last_end = match.last
        # a notice inside a longer passage of the same words is the passage's
        found.sort(key=lambda m: (-m.matched, -m.coverage, m.first, m.template))
        kept: list[Match] = []
        for m in found:
            if not any(k.first <= m.first and m.last <= k.last for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: (m.first, m.template))

    def _align(self, t: int, ids: np.ndarray, low: int, high: int, start: int) -> Match:
        """Most template words in order within the band of diagonals ``low..high``, from word ``start`` on; fewest extra words among equals."""
        template = self.words[t]
        a, b = low - self.band, high + self.band
        width = b - a + 1
        # state per diagonal: (matched, -skipped, first word of the text, last word)
        none = (0, 0, -1, -1)
        row = [none] * width
        for p, word in enumerate(template.tolist()):
            new = []
            for d in range(width):
                q = a + d + p
                best = row[d]
                if start <= q < len(ids) and ids[q] == word:
                    m = row[d]
                    best = (m[0] + 1, m[1], q if m[2] < 0 else m[2], q)
                if d + 1 < width and (o := row[d + 1]) and (o[0], o[1] - 1) > (best[0], best[1]):
                    best = (o[0], o[1] - 1, o[2], o[3])
                new.append(best)
            for d in range(1, width):  # words of the text that the template lacks
                o = new[d - 1]
                if (o[0], o[1] - 1) > (new[d][0], new[d][1]):
                    new[d] = (o[0], o[1] - 1, o[2], o[3])
            row = new
        matched, _, first, last = max(row, key=lambda s: (s[0], s[1]))
        return Match(self.names[t], matched, matched / max(1, len(template)), first, last)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """License passages: ``id_col, license, coverage, matched_words, span_start, span_end`` (characters, end excluded)."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    index = TemplateIndex(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        keys = np.array(sorted(index.postings), dtype=np.int64)
        for batch in batches:
            texts = pc.replace_substring_regex(pc.fill_null(batch.column(1), ""), r"[\x09-\x0d ]+", " ")
            offsets, codes, words = coded_segments(pc.ascii_trim(texts, " "))
            if len(offsets) < 2:
                continue
            if len(known) > 200_000:
                known = {w: known[w] for w in words if w in known}
            for w in words:
                if w not in known:
                    known[w] = index.vocabulary.get(bare(w), 0)
            ids = np.array([known[w] for w in words], dtype=np.int64)[codes]
            grams = index.grams(ids)
            n = len(grams)
            hit = np.flatnonzero((ids[:n] > 0) & (ids[1 : n + 1] > 0) & (ids[2 : n + 2] > 0) & np.isin(grams, keys)) if n else np.zeros(0, dtype=np.int64)
            rows, out = [], []
            doc, firsts = np.unique(np.searchsorted(offsets, hit, side="right") - 1, return_index=True)
            for k, of_text in zip(doc, np.split(hit, firsts[1:])):
                a, b = int(offsets[k]), int(offsets[k + 1])
                own = of_text[of_text + GRAM <= b]
                matches = index.scan(ids[a:b], own - a, grams[own], least)
                if matches:
                    text = batch.column(1)[int(k)].as_py()
                    spans = [m.span() for m in WORD.finditer(text)]
                    for m in matches:
                        rows.append(int(k))
                        out.append((m.template, m.coverage, m.matched, spans[m.first][0], spans[m.last][1]))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "license", "coverage", "matched_words", "span_start", "span_end"])

    out = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, license string, coverage double, matched_words int, span_start int, span_end int")
    return out.withColumnRenamed("id", id_col)
