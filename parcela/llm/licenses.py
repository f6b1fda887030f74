"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are a small table (name, text), the caller's or TEMPLATES. Their word k-grams form an inverted index:
gram -> (template, place). Of templates of SHORT words or more the winnowed grams of GRAM words are indexed, of which
any stretch of GRAM + WINDOW - 1 words shared with a document gives a hit; of shorter ones every gram of SHORT_GRAM words.

A document's grams are looked up in the index. Of the templates that one place hits on several diagonals, the diagonal
with most hits near it counts. Hits on neighbouring diagonals, with no wider a gap than half the template between them,
are chained: words put in or left out shift the rest of a text to another diagonal. The template is then aligned with
the document in a band that reaches BAND words beyond the chain's diagonals. A candidate counts if at least COVERAGE
of the template's words are matched and, where the template is a short notice, all its TELLING words are.

Words are compared in lower case without marks. A span is given in words (from 0, stop excluded); of overlapping
spans the one with more matched words stays, then the one with the greater coverage, then the first: a notice that
a whole license begins with doesn't hide the license.

A null text has no words and no license; an empty table gives an empty result. The verdict depends on the text alone,
so repeated rows and ties get equal results. Only the text is read; columns of any names are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import WordHashes, documents, gram_hashes

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 6, 0.8
SHORT, SHORT_GRAM = 16, 2
#: A chain has a hit for so many words of the template at least: with a word in five changed there are several times as many.
FEWEST = 40
MARKS = b".,;:!?\"'()[]{}*#|<>`"

# Texts and notices of public licenses, and the words without which a short notice is another one.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)
TELLING: dict[str, str] = {
    "MIT-notice": "MIT", "Apache-2.0-notice": "Apache 2.0", "GPL-3.0-notice": "GNU 3", "GPL-2.0-notice": "GNU 2", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0",
}


def hashes_of(text: str | None, own: WordHashes) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    words = [w.strip(MARKS) or w for w in words]
    return np.fromiter(map(own.__getitem__, words), np.uint64, len(words))


def winnow(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams chosen: the least of each WINDOW of them, the last one of equals."""
    grams = gram_hashes(tokens, min(GRAM, max(len(tokens), 1)))
    if len(grams) <= WINDOW:
        place = np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else [], np.int64)
        return place, grams[place]
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    place = np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1))
    return place, grams[place]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence of the template and the words, on the diagonals (place in words less place in
    template) from low to high: the places matched, in the template and in the words. Of alignments with equally
    many the one that ends first, and then the one that starts last."""
    width = high - low + 1
    best = np.zeros((len(template) + 1, width + 1), np.int32)  # a column more, for the diagonal above the last
    place = np.arange(low, high + 1)
    # padded words: a word outside the document equals nothing
    inside = lambda i: (place + i >= 0) & (place + i < len(words))
    same = np.zeros((len(template), width), bool)
    for i, t in enumerate(template):
        there = inside(i)
        same[i, there] = words[place[there] + i] == t
        # from above: the row before, one diagonal on; along the diagonal with a match; from the left: a running maximum
        row = np.maximum(best[i, 1:], best[i, :-1] + same[i])
        best[i + 1, :-1] = np.maximum.accumulate(row)
    i, d = len(template), int(np.argmax(best[-1, :-1]))
    own, other = [], []
    while i > 0 and best[i, d] > 0:
        if same[i - 1, d] and best[i, d] == best[i - 1, d] + 1:
            own.append(i - 1)
            other.append(low + d + i - 1)
            i -= 1
        elif d > 0 and best[i, d] == best[i, d - 1]:
            d -= 1
        else:
            i, d = i - 1, d + 1
    return np.array(own[::-1], np.int64), np.array(other[::-1], np.int64)


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], telling: Mapping[str, str] | None = None):
        self.words = WordHashes()
        telling = TELLING if telling is None else telling
        self.templates = [(name, hashes_of(text, self.words)) for name, text in templates]
        self.telling = [hashes_of(telling.get(name), self.words) for name, _ in self.templates]
        short = [(t, min(SHORT_GRAM, max(len(x), 1))) for t, (_, x) in enumerate(self.templates) if len(x) < SHORT]
        found = {0: [], **{n: [] for _, n in short}}
        for t, n in short:
            found[n] += [(h, t, p) for p, h in enumerate(gram_hashes(self.templates[t][1], n))]
        found[0] = [(h, t, p) for t, (_, x) in enumerate(self.templates) if len(x) >= SHORT for p, h in zip(*winnow(x), strict=True)]
        # by the number of words in a gram; 0: the winnowed ones
        self.index = {n: (np.array([x[0] for x in sorted(rows)], np.uint64), [(x[1], int(x[2])) for x in sorted(rows)]) for n, rows in found.items()}

    def hits(self, tokens: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Of each template hit: (place in the document, diagonal), in order of place."""
        out: dict[int, list[tuple[int, int]]] = {}
        for n, (known, places) in self.index.items():
            place, grams = winnow(tokens) if n == 0 else (None, gram_hashes(tokens, n))
            lo, hi = np.searchsorted(known, grams, "left"), np.searchsorted(known, grams, "right")
            for i in np.flatnonzero(hi > lo):
                at = int(i if place is None else place[i])
                for t, p in places[lo[i] : hi[i]]:
                    out.setdefault(t, []).append((at, at - p))
        return out

    def chains(self, hits: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
        """The least and greatest diagonal of each chain of hits."""
        near = max(BAND, length // 8)
        places, diagonals = (np.array(x, np.int64) for x in zip(*hits, strict=True))
        order = np.sort(diagonals)
        support = np.searchsorted(order, diagonals + near, "right") - np.searchsorted(order, diagonals - near, "left")
        # of the diagonals that one place hits, the one with most hits near it
        by_place = np.lexsort((diagonals, -support, places))
        first = np.r_[True, places[by_place][1:] != places[by_place][:-1]]
        chosen = np.sort(diagonals[by_place[first]])
        for part in np.split(chosen, np.flatnonzero(np.diff(chosen) > max(1, length // 2)) + 1):
            # a chain wider than twice the template is taken in pieces that overlap by half
            low, high = int(part[0]), int(part[-1])
            for a in range(low, max(low, high - 2 * length) + 1, max(1, length)) if high - low > 2 * length else [low]:
                b = high if high - low <= 2 * length else a + 2 * length
                if np.searchsorted(part, b, "right") - np.searchsorted(part, a) >= max(1, length // FEWEST):
                    yield a, b

    def scan(self, text: str | None) -> list[dict]:
        if len(self.words) > WordHashes.LIMIT:
            self.words.clear()
        tokens = hashes_of(text, self.words)
        spans = set()
        for t, hits in self.hits(tokens).items():
            name, template = self.templates[t]
            # narrower than a short template is long, so that the next match isn't in the band of the last one
            band = min(BAND, max(1, len(template) // 2))
            for low, high in self.chains(hits, len(template)):
                if len(self.telling[t]) and not np.isin(self.telling[t], tokens[max(0, low - band) : high + band + len(template)]).all():
                    continue
                own, other = align(template, tokens, low - band, high + band)
                if len(own) >= COVERAGE * len(template) and np.isin(self.telling[t], template[own]).all():
                    spans.add((-len(own), -round(len(own) / len(template), 4), int(other[0]), int(other[-1]) + 1, name))
        free, out = np.ones(len(tokens), bool), []
        for _, coverage, a, b, name in sorted(spans):
            if free[a:b].all():
                free[a:b] = False
                out.append({"license": name, "coverage": -coverage, "start": a, "stop": b})
        return sorted(out, key=lambda x: x["start"])


MATCHES = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))


def scanned(text: Column, templates: Sequence[tuple[str, str]] = TEMPLATES, telling: Mapping[str, str] | None = None) -> Column:
    """array<struct<license, coverage, start, stop>>, in order of start. telling: words of a short template, by its
    name, that a match must have; TELLING unless given."""

    @F.arrow_udf("array<struct<license: string, coverage: double, start: int, stop: int>>")
    def scan_licenses(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scanner(templates, telling)
        for batch in batches:
            yield pa.array([own.scan(t.as_py()) for t in batch], MATCHES)

    return scan_licenses(text)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, the number of matches and the matches of every document."""
    return documents(spark, sf_dir).select("doc_id", scanned(F.col("text")).alias("licenses")).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), "licenses")
