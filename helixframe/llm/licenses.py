"""License scans: winnowed fingerprints find candidate templates, banded alignment measures the match.

Templates and texts are reduced to lower-cased letters and digits; hashes of K of these in a row are
winnowed (the least of each W neighbours is a fingerprint), so any stretch of K + W - 1 that a text
shares with a template gives a fingerprint of both. An inverted index from fingerprints to template
places gives candidate templates with their offset in the text. Around that offset, the template's
words are aligned with the text's within a band; a template counts where enough of its words match.
"""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import slices

# Public license notices and texts.
NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
GPL_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", APACHE_NOTICE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_GRANT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + NO_WARRANTY),
    ("MIT-0", MIT_GRANT + ", and to permit persons to whom the Software is furnished to do so. " + NO_WARRANTY),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GPL_3),
    ("GPL-3.0", GPL_3 + " " + GPL_TAIL),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", GPL_2),
    ("GPL-2.0", GPL_2 + " " + GPL_TAIL),
    ("AGPL-3.0", GPL_3.replace("GNU General", "GNU Affero General")),
    ("LGPL-3.0", GPL_3.replace("program", "library").replace("GNU General", "GNU Lesser General")),
    ("LGPL-2.1", GPL_2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")),
    ("BSD", BSD_HEAD),
    ("BSD-2-Clause", " ".join((BSD_HEAD, BSD_TWO, BSD_TAIL))),
    ("BSD-3-Clause", " ".join((BSD_HEAD, BSD_TWO, BSD_THIRD, BSD_TAIL))),
    ("BSD-2-Clause", BSD_HEAD + " " + BSD_TWO),
    ("BSD-3-Clause", " ".join((BSD_HEAD, BSD_TWO, BSD_THIRD))),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_TAIL),
    ("0BSD", ISC_GRANT + ". " + ISC_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

K, W = 12, 6
B = np.uint64(1_000_003)
WORDS = re.compile(r"[^\W_]+")


def fold(code: int) -> int:
    """A lower-cased letter or digit; 0 for what is dropped."""
    c = chr(code)
    low = c.lower()
    return (ord(low) if len(low) == 1 else code) if c.isalnum() else 0


FOLD = np.array([fold(code) for code in range(65_536)], dtype=np.uint32)


def folded(codes: np.ndarray) -> np.ndarray:
    out = FOLD[np.minimum(codes, 0xFFFF)]
    wide = np.flatnonzero(codes > 0xFFFF)
    if len(wide):
        values, at = np.unique(codes[wide], return_inverse=True)
        out[wide] = np.array([fold(int(code)) for code in values], dtype=np.uint32)[at]
    return out


def windows_least(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints with their place among the kept characters, and the kept characters' places in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = folded(codes)
    kept = np.flatnonzero(letters)
    h = letters[kept].astype(np.uint64)
    if len(h) < K:
        return h[:0], kept[:0], kept
    four = (h[:-1] * B + h[1:])[:-2] * (B * B) + (h[:-1] * B + h[1:])[2:]
    power = np.uint64(pow(int(B), 4, 1 << 64))
    h = (four[:-8] * power + four[4:-4]) * power + four[8:]
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    if len(h) < W:
        place = np.array([int(h.argmin())])
        return h[place], place, kept
    seen = np.lib.stride_tricks.sliding_window_view(h, W)
    least = seen.min(axis=1)
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[change], change + seen[change].argmin(axis=1), kept


class Templates:
    """The inverted index, and the templates' words."""

    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        self.words = [[w.lower() for w in WORDS.findall(text)] for _, text in templates]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text) in enumerate(templates):
            values, places, kept = windows_least(text)
            starts = [m.start() for m in WORDS.finditer(text)]
            for value, place in zip(values.tolist(), places.tolist(), strict=True):
                self.index[value].append((number, int(np.searchsorted(starts, kept[place], side="right")) - 1))
        self.known = np.array(sorted(self.index), dtype=np.uint64)
        self.coarse = np.zeros(1 << 16, dtype=bool)
        self.coarse[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, text: str) -> tuple[list[tuple[int, int, list[int]]], list[re.Match]]:
        """(template, offset in words, words of the fingerprints) by decreasing support; the text's words."""
        values, places, kept = windows_least(text)
        near = np.flatnonzero(self.coarse[(values >> np.uint64(48)).astype(np.int64)])
        near = near[np.isin(values[near], self.known)]
        if not len(near):
            return [], []
        words = list(WORDS.finditer(text))
        starts = np.array([m.start() for m in words])
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in near.tolist():
            at = int(np.searchsorted(starts, kept[places[i]], side="right")) - 1
            for template, place in self.index[int(values[i])]:
                found[template, at - place].append(at)
        return [(*key, ats) for key, ats in sorted(found.items(), key=lambda x: (-len(x[1]), x[0]))], words


def align(template: list[str], words: list[str | None], offset: int, band: int) -> tuple[int, int, int]:
    """Most words of the template matched in order within the band about offset, and the text's first and last matched word."""
    m, n = len(template), len(words)
    before: dict[int, tuple[int, int, int]] = {}
    none = (0, n, -1)
    better = lambda a, b: a if (a[0], -(a[2] - a[1])) >= (b[0], -(b[2] - b[1])) else b
    for i in range(m):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + offset - band), min(n, i + offset + band + 1)):
            best = better(row.get(j - 1, none), before.get(j, none))
            if template[i] == words[j]:
                k, first, _ = before.get(j - 1, none)
                best = better(best, (k + 1, min(first, j), j))
            row[j] = best
        before = row
    return max(before.values(), key=lambda x: (x[0], -(x[2] - x[1])), default=none)


def scan_text(text: str, templates: Templates, band: int, least: float) -> list[tuple[str, int, int, int, int]]:
    """(license, start, end, matched words, template's words): spans in characters.

    Licenses of a family share wording. Of overlapping spans the one with most matched words stays, then
    the one that covers most of its template: a long template beats those it contains.
    """
    places, matches = templates.candidates(text)
    if not places:
        return []
    words, found = [m[0].lower() for m in matches], []
    left: dict[int, list[str | None]] = {}  # by template, the words outside its matches
    for number, offset, fingerprints in places:
        template, rest = templates.words[number], left.setdefault(number, list(words))
        near = set(rest[max(0, offset - band) : max(0, offset + len(template) + band)])
        if sum(w in near for w in template) < least * len(template):  # no alignment can match enough
            continue
        while any(rest[at] is not None for at in fingerprints):  # a match may be another one within the band
            matched, first, last = align(template, rest, offset, band)
            if not matched or matched < least * len(template):
                break
            found.append((templates.names[number], matches[first].start(), matches[last].end(), matched, len(template)))
            rest[first : last + 1] = [None] * (last + 1 - first)
    kept: list[tuple[str, int, int, int, int]] = []
    for span in sorted(found, key=lambda s: (-s[3], -s[3] / s[4], s[1], s[0])):
        if all(span[2] <= k[1] or span[1] >= k[2] for k in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: s[1:3])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, band: int = 8, least: float = 0.85) -> DataFrame:
    """One row per match: doc, license, start, end, matched_words, template_words, coverage.

    Spans count characters, end exclusive. coverage is the share of the template's words found in
    order within band words of where a fingerprint puts them, at least `least`. Null and empty texts
    have none; texts are read whole, however long; repeated rows give theirs each; an empty table gives
    an empty one. Other columns of docs are not read. The templates are a fixed table, sent with the task.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("license", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start", "end", "matched_words", "template_words")], T.StructField("coverage", T.DoubleType())])

    def run(batches):
        index = Templates(templates)
        for batch in slices(batches):
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                spans = scan_text(text, index, band, least) if text else []
                at += [i] * len(spans)
                found += spans
            columns = [pa.array([f[k] for f in found], pa.string() if k == 0 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns, pa.array([f[3] / f[4] for f in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
