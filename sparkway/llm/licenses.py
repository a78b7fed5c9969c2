"""Licence scans with a generalised suffix automaton over licence tokens.

All templates (licence passages and the base phrases) go into one suffix automaton.  A file is
streamed through it once; the state and the length reached at every token are its matching
statistics: the longest run that ends there and stands in some template.  Matches that can't
be extended and are long enough become pieces; pieces of one template that follow each
other in the same order, with small gaps, are chained, and a chain that covers enough of its
template is a span with that template's label.  Base phrases are read off the same states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Base phrases and their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Passages of public licence texts, as word sequences, and their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "this work is licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # whole texts of short public licences (BSL without its disclaimer) and of notices
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

#: Bytes that separate words become spaces, A-Z become a-z; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


@dataclass
class Automaton:
    """Generalised suffix automaton of token sequences."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: for each state and template, where the state's words end there
    ends: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])

    def add(self, tokens: list[int]) -> None:
        last = 0
        for token in tokens:
            last = self._extend(last, token)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _extend(self, last: int, token: int) -> int:
        if token in self.step[last]:
            found = self.step[last][token]
            return found if self.length[found] == self.length[last] + 1 else self._split(last, token, found)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and token not in self.step[at]:
            self.step[at][token] = new
            at = self.link[at]
        if at >= 0:
            found = self.step[at][token]
            self.link[new] = found if self.length[found] == self.length[at] + 1 else self._split(at, token, found)
        return new

    def _split(self, at: int, token: int, found: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[found]), self.link[found])
        self.link[found] = copy
        while at >= 0 and self.step[at].get(token) == found:
            self.step[at][token] = copy
            at = self.link[at]
        return copy

    def mark(self, template: int, tokens: list[int]) -> None:
        """Notes where the template's substrings end, once all templates are in."""
        at = 0
        for end, token in enumerate(tokens, 1):
            at = state = self.step[at][token]
            while state > 0:
                self.ends[state].setdefault(template, []).append(end)
                state = self.link[state]

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) after each token."""
        state = length = 0
        step, link, longest = self.step, self.link, self.length
        for token in tokens:
            while token not in step[state] and state:
                state = link[state]
                length = longest[state]
            if token in step[state]:
                state = step[state][token]
                length += 1
            yield state, length


class Scanner:
    """Templates, their automaton and the chaining rules."""

    def __init__(self, templates, phrases, min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
        self.labels = [label for label, _ in templates]
        self.sizes = []
        coded = [number(text) for _, text in templates]
        self.sizes = [len(c) for c in coded]
        phrase_codes = [(number(text), label) for text, label in phrases]
        self.single = {c[0]: label for c, label in phrase_codes if len(c) == 1}  # found without the automaton
        phrase_codes = [(c, label) for c, label in phrase_codes if len(c) > 1]
        self.automaton = Automaton()
        for tokens in [*coded, *(c for c, _ in phrase_codes)]:
            self.automaton.add(tokens)
        for t, tokens in enumerate(coded):
            self.automaton.mark(t, tokens)
        # a phrase ends wherever its own state lies on the chain of suffixes
        own: dict[int, tuple[int, str]] = {}
        for tokens, label in phrase_codes:
            state = 0
            for token in tokens:
                state = self.automaton.step[state][token]
            own[state] = (len(tokens), label)
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.step]
        for state in range(len(self.phrases)):
            at = state
            while at > 0:
                if at in own:
                    self.phrases[state].append(own[at])
                at = self.automaton.link[at]
        size = len(self.vocabulary)
        self.follows = np.zeros((size + 1, size + 1), bool)  # pairs of neighbours in some template
        for tokens in [*coded, *(c for c, _ in phrase_codes)]:
            self.follows[tokens[:-1], tokens[1:]] = True

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Words, places of base phrases (start, label), spans (label, start, end, share of the template covered)."""
        words = words_of(text)
        none = len(self.vocabulary)
        get = self.vocabulary.get
        codes = np.fromiter((get(w, none) for w in words), np.int32, len(words))
        # no match of two tokens or more crosses a pair that no template has: only runs between such pairs are streamed
        linked = np.flatnonzero(self.follows[codes[:-1], codes[1:]])
        alone = np.flatnonzero(np.isin(codes, list(self.single))) if self.single else ()
        places: list[tuple[int, str]] = [(int(at), self.single[int(codes[at])]) for at in alone]
        if not len(linked):
            return len(words), places, []
        cut = np.flatnonzero(np.diff(linked) != 1)
        firsts = linked[np.concatenate(([0], cut + 1))].tolist()
        lasts = (linked[np.concatenate((cut, [len(linked) - 1]))] + 1).tolist()
        pieces: list[tuple[int, list[int], int, int]] = []  # template, ends in the template, end in the text, length
        for a, z in zip(firsts, lasts, strict=True):
            before = (0, 0)
            for at, (state, length) in enumerate(self.automaton.statistics(codes[a : z + 1].tolist()), a):
                for size, label in self.phrases[state]:
                    if size <= length:
                        places.append((at - size + 1, label))
                if length <= before[1]:
                    self._piece(pieces, *before, at)
                before = (state, length)
            self._piece(pieces, *before, z + 1)
        return len(words), sorted(places), self._chain(pieces)

    def _piece(self, pieces: list, state: int, length: int, end: int) -> None:
        if length >= self.min_match:
            pieces += [(t, at, end, length) for t, at in self.automaton.ends[state].items()]

    def _chain(self, pieces: list[tuple[int, list[int], int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of chains: of the places a piece has in its template, a chain goes on at the first one behind what it has."""
        spans = []
        by_template: dict[int, list[tuple[list[int], int, int]]] = {}
        for t, ends, end, length in sorted(pieces, key=lambda p: (p[0], p[2])):
            by_template.setdefault(t, []).append((ends, end, length))
        for t, found in by_template.items():
            start = stop = inside = covered = -1
            for ends, end, length in [*found, ([0], 1 << 60, 0)]:
                begin = end - length
                at = next((e for e in ends if e > inside), 0)
                if start >= 0 and begin - stop <= self.max_gap and at > inside:
                    covered += min(length, at - inside, end - stop)
                    stop, inside = end, at
                    continue
                if start >= 0 and covered >= self.min_cover * self.sizes[t]:
                    spans.append((self.labels[t], start, stop, min(1.0, covered / self.sizes[t])))
                start, stop, inside, covered = begin, end, ends[0], length
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


RESULT = "doc_id long, n_words long, places array<struct<start: long, label: string>>, spans array<struct<label: string, start: long, end: long, cover: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES, phrases=BASE_PHRASES, min_match: int = 3, max_gap: int = 8, min_cover: float = 0.6) -> DataFrame:
    """(doc_id, n_words, places, spans) for each row of ``docs``.

    places: starts (in words from 0) of the base phrases, with their labels.  spans: chained
    template matches (end exclusive) with the share of the template they cover.

    Null and empty texts have no words; repeated rows give repeated results; an empty table gives
    an empty result; a null doc_id stays null; further columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, min_match, max_gap, min_cover)
        place = pa.struct([("start", pa.int64()), ("label", pa.string())])
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            places = [[{"start": a, "label": label} for a, label in p] for _, p, _ in found]
            spans = [[{"label": s[0], "start": s[1], "end": s[2], "cover": s[3]} for s in x] for _, _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span))], ["doc_id", "n_words", "places", "spans"])

    return source.mapInArrow(run, RESULT)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and passages of all documents."""
    found = scan(documents(spark, sf_dir))
    joined = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*columns))), ",")
    base, own = F.col("places.label"), F.col("spans.label")
    none = F.array().cast("array<string>")
    cover = F.coalesce(F.array_max("spans.cover"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(base, none).alias("base_labels"),
        joined(base, own).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(cover).alias("score"),
    )
