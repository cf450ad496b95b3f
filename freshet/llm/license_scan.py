"""License scans: where texts hold the notices of known licenses.

Method: each template has the set of its shingles of five words (A-Z lower-cased, ASCII punctuation left out). Windows
of as many shingles as a template has are laid over a text, overlapping (each starts an eighth of its length after
the last); their MinHash bands retrieve templates of that length. A window that lies best over a notice with four
fifths of the template's shingles has a Jaccard similarity J of 0.58 or more with it, and BANDS bands of BAND_ROWS rows
then collide with probability 1 - (1 - J^2)^24 > 0.9999; an unchanged notice with certainty. For each template
retrieved the whole text is then verified by exact containment: every window of the template's length with at least
CONTAINED of its shingles matches, overlapping matches are one, and the best (of equals the first) is given.
Windows without any shingle of a template contain nothing of it, so texts without one are passed by.

Cases: a null or empty text has no match; a template needs five words; equal windows give a match each where they do
not overlap; repeated rows each give their matches; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freshet.llm.common import bounded_broadcast, plain, rows_of, text_column
from freshet.llm.shingles import combined, mixed, shingle_lists, word_hashes

WORDS, CONTAINED, BANDS, BAND_ROWS, STRIDES = 5, 0.8, 24, 2, 8
#: Bytes of templates that are broadcast at most.
TEMPLATE_BOUND = 64_000_000
_PUNCTUATION = string.punctuation.encode()
_SEEDS = np.random.default_rng(11).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)

#: Whole texts of short licenses and notices.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Short forms, opening notices and whole texts of common licenses.
TEMPLATES = {
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": MIT_TEXT,
    "BSD-2-Clause-text": BSD_2_TEXT,
    "BSD-3-Clause-text": BSD_2_TEXT.replace("THIS SOFTWARE IS", f"{BSD_3_CLAUSE} THIS SOFTWARE IS", 1),
    "ISC-text": ISC_TEXT,
    "Zlib-text": ZLIB_TEXT,
    "Unlicense-text": UNLICENSE_TEXT,
    "Apache-2.0-notice": APACHE_NOTICE,
    "GPL-3.0-notice": GPL_NOTICE,
    "MPL-2.0-notice": MPL_NOTICE,
}


def shingles(text: str) -> np.ndarray:
    return combined(word_hashes(text.encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION))[1], WORDS)


def signatures(tokens: np.ndarray, windows: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """For each (starts, size): a row for each band, its hash for each window of ``size`` shingles. The shingles are hashed once
    a seed; the least hashes of 1, 2, 4, ... shingles are shared by all sizes, two of which cover a window."""
    out = [np.zeros((BANDS, len(starts)), np.uint64) for starts, _ in windows]
    levels = max(size for _, size in windows).bit_length() - 1
    for k, seed in enumerate(_SEEDS):
        least = [mixed(tokens ^ seed)]
        for j in range(levels):
            least.append(np.minimum(least[j][: -(1 << j)], least[j][1 << j :]))
        for rows, (starts, size) in zip(out, windows):
            j = size.bit_length() - 1
            least_here = np.minimum(least[j][starts], least[j][starts + size - (1 << j)])
            rows[k // BAND_ROWS] = mixed(rows[k // BAND_ROWS] * np.uint64(0x9E3779B97F4A7C15) + least_here + np.uint64(k))
    return out


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.sets: dict[str, set[int]] = {}
        self.bands: dict[int, list[dict[int, list[str]]]] = {}  # by window size, for each band
        for name, text in templates.items():
            tokens = shingles(text)
            if not len(tokens):
                raise ValueError(f"the template {name} has fewer than {WORDS} words")
            self.sets[name] = set(tokens.tolist())
            tables = self.bands.setdefault(len(tokens), [{} for _ in range(BANDS)])
            for table, h in zip(tables, signatures(tokens, [(np.zeros(1, np.int64), len(tokens))])[0][:, 0].tolist()):
                table.setdefault(h, []).append(name)
        self.sizes = {name: len(shingles(text)) for name, text in templates.items()}
        self.all = np.unique(np.fromiter((t for s in self.sets.values() for t in s), np.uint64))
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(self.all >> np.uint64(48)).astype(np.int64)] = True

    def retrieved(self, tokens: np.ndarray) -> list[str]:
        """The templates that a window of the text retrieves."""
        # texts of fewer words than a shingle have one for all their words; no template has such a shingle
        hint = np.flatnonzero(self.hint[(tokens >> np.uint64(48)).astype(np.int64)])
        if not len(hint) or not np.isin(tokens[hint], self.all).any():
            return []
        windows = []
        for size in self.bands:
            # a text that is shorter than the template is one window
            starts = np.arange(0, max(1, len(tokens) - size + 1), max(1, size // STRIDES))
            if len(tokens) > size and starts[-1] != len(tokens) - size:
                starts = np.append(starts, len(tokens) - size)
            windows.append((starts, min(size, len(tokens))))
        found: dict[str, None] = {}
        for tables, rows in zip(self.bands.values(), signatures(tokens, windows)):
            for table, row in zip(tables, rows):
                for h in np.intersect1d(row, np.fromiter(table, np.uint64)).tolist():
                    found.update(dict.fromkeys(table[h]))
        return list(found)

    def matches(self, tokens: np.ndarray, name: str) -> list[tuple[int, int, int]]:
        """(first shingle, last shingle, shared) of the best window of each run of overlapping matches."""
        of, size = self.sets[name], self.sizes[name]
        values = tokens.tolist()
        hits = [i for i in np.flatnonzero(np.isin(tokens, np.fromiter(of, np.uint64))).tolist()]
        out: list[list[int]] = []  # start, end, shared, first and last hit of the best window
        inside: dict[int, int] = {}
        left = 0
        for right, i in enumerate(hits):  # windows that end with a hit; some best window does
            inside[values[i]] = inside.get(values[i], 0) + 1
            while hits[left] < i - size + 1:
                t = values[hits[left]]
                inside[t] -= 1
                if not inside[t]:
                    del inside[t]
                left += 1
            if len(inside) >= CONTAINED * len(of):
                first = hits[left]
                if out and first <= out[-1][1]:
                    out[-1][1] = i
                    if len(inside) > out[-1][2]:
                        out[-1][2:] = [len(inside), first, i]
                else:
                    out.append([first, i, len(inside), first, i])
        return [(a, b, shared) for _, _, shared, a, b in out]

    def scan(self, text: str, tokens: np.ndarray) -> list[tuple[str, int, int, int, float]]:
        """(license, start, end, shared shingles, containment), by start; places in code points."""
        found = []
        if len(tokens):
            for name in self.retrieved(tokens):
                found.extend((name, *m) for m in self.matches(tokens, name))
        if not found:
            return []
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if m[0].strip(string.punctuation) or m[0].encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION)]
        return sorted(((name, places[a][0], places[b + WORDS - 1][1], shared, shared / len(self.sets[name])) for name, a, b, shared in found), key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(templates))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each match: ``doc_id``, ``license``, ``start``, ``end`` (code points, end exclusive), ``shared`` (shingles of
    the template), ``containment`` (their part)."""
    spark, listed = docs.sparkSession, tuple((TEMPLATES if templates is None else templates).items())
    shared = bounded_broadcast(spark, listed, sum(len(a) + len(b) for a, b in listed), TEMPLATE_BOUND, "the templates")
    prepared(listed)
    rows = plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prepared(shared.value)
        for batch in rows_of(batches, 8_000_000, "text"):
            at, found = [], []
            texts = text_column(batch, "text")
            for i, tokens in enumerate(shingle_lists(texts, WORDS, without=_PUNCTUATION)):
                here = known.scan(texts[i], tokens)
                at += [i] * len(here)
                found += here
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())))], ["doc_id", "license", "start", "end", "shared", "containment"])

    return rows.mapInArrow(find, f"doc_id {kind}, license string, start long, end long, shared long, containment double")
