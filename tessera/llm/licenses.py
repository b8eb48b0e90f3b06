"""License scan: MinHash bands over overlapping text windows, verified by exact shingle containment.

A text's words (runs of letters and digits, in lower case) give its five-word shingles in order. For each class of
template sizes, a window is three neighbouring blocks of S shingles, S being the class's largest size rounded up to a power
of two; windows begin at every block, so any passage of up to 2 S + 1 shingles lies whole in one. A template is
retrieved for a window if one of its bands, here the minimum under one hash function, is that of the window. The
number of bands follows from the least Jaccard similarity that a window with the required share of the template can
have, so that the chance of a miss is at most `MISS`; no window is left out. The retrieved pairs are then checked: the exact share of the
template's shingles that the window holds must reach the threshold.

A null or empty text, or one of fewer words than a shingle that isn't a whole template, has no match. Repeated rows give repeated results. A template that
matches in several windows gives one row with the best share, the first of equals, and the number of windows. An empty table gives an empty
result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, mix, slices, table, text_only, utf8
from .jaccard import all_tokens

WORDS, THRESHOLD, MISS = 5, 0.8, 1e-6

#: Well-known notices and whole texts (-text), by the licenses' usual short names.
TEMPLATES = {
    "MIT-line": "Released under the MIT License",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-line": "Licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
}

#: Bytes that aren't of a word are spaces; bytes of other than ASCII letters are kept.
_PLAIN = np.array([b if chr(b).isalnum() or b >= 128 else 32 for b in range(256)], np.uint8)
TOP, _STEP = np.uint32(0xFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Template:
    name: str
    shingles: np.ndarray  # distinct, sorted

    @property
    def block(self) -> int:
        return 1 << max(0, len(self.shingles) - 1).bit_length()

    def required(self) -> int:
        return math.ceil(THRESHOLD * len(self.shingles) - 1e-9)

    def bands(self) -> int:
        """So many that a window with the required shingles, and none of the template's in common otherwise, is missed with a chance of MISS at most."""
        least = self.required() / (3 * self.block + len(self.shingles) - self.required())
        return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in the order of the words and the text that each is of."""
    tokens, owner = all_tokens(_PLAIN[data], offsets, WORDS)
    order = np.argsort(owner, kind="stable")
    return tokens[order], owner[order]


@cache
def templates(texts: tuple[tuple[str, str], ...]) -> tuple[Template, ...]:
    out = []
    for name, text in texts:
        raw = text.encode()
        tokens, _ = shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if not len(tokens):
            raise ValueError(f"a template without words: {name}")
        out.append(Template(name, np.unique(tokens)))
    return tuple(out)


def hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function: the upper half of a mixed 64-bit number, seeded by k."""
    return (mix(tokens ^ mix(np.array([k + 1], np.uint64) * _STEP)) >> np.uint64(32)).astype(np.uint32)


def retrieve(tokens: np.ndarray, bounds: np.ndarray, known: tuple[Template, ...]) -> Iterator[tuple[int, int, int]]:
    """(template, first shingle, end) of each window that shares a band with a template. bounds: where the texts' shingles begin in tokens, and the end."""
    blocks = sorted({t.block for t in known})
    size = blocks[-1]
    # texts are padded to whole blocks of the largest class, so that smaller blocks are never of two texts
    counts = np.diff(bounds)
    padded = -(-counts // size) * size
    begins = np.concatenate([[0], np.cumsum(padded)])
    if not begins[-1]:
        return
    to = np.arange(len(tokens)) + np.repeat(begins[:-1] - bounds[:-1], counts)
    hits: dict[tuple[int, int], list[np.ndarray]] = {}
    row = np.empty(begins[-1], np.uint32)
    for k in range(max(t.bands() for t in known)):
        row.fill(TOP)
        row[to] = hashes(tokens, k)
        level, width = row, 1
        for block in blocks:
            level = level.reshape(-1, block // width).min(1) if block > width else level
            width = block
            now = [(i, t) for i, t in enumerate(known) if t.block == block and k < t.bands()]
            if not now:
                continue
            window = level.copy()
            np.minimum(window[:-1], level[1:], out=window[:-1])
            np.minimum(window[:-2], level[2:], out=window[:-2])
            for i, t in now:
                same = np.flatnonzero(window == hashes(t.shingles, k).min())
                if len(same):
                    hits.setdefault((i, block), []).append(same)
    for (i, block), found in sorted(hits.items()):
        for w in np.unique(np.concatenate(found)).tolist():
            text = int(np.searchsorted(begins, w * block, "right")) - 1
            start = bounds[text] + w * block - begins[text]
            end = min(start + 3 * block, bounds[text + 1])
            # a window that begins in one text's last blocks may have met the next text's hashes; the check decides
            if start < end:
                yield i, int(start), int(end)


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, containment, first_word, end_word (of the best window), n_windows for each template that a text holds."""
    arrow(docs.sparkSession)
    named = tuple(sorted((texts or TEMPLATES).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates(named)
        every = np.unique(np.concatenate([t.shingles for t in known]))
        for batch in slices(batches):
            tokens, owner = shingles(*utf8(batch.column("text")))
            # only texts with a shingle of some template can have a required share of one
            some = np.zeros(batch.num_rows, bool)
            some[owner[np.isin(tokens, every)]] = True
            tokens, owner = tokens[some[owner]], owner[some[owner]]
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
            for i, start, end in retrieve(tokens, bounds, known):
                share = len(np.intersect1d(tokens[start:end], known[i].shingles)) / len(known[i].shingles)
                if share >= THRESHOLD - 1e-12:
                    text = int(owner[start])
                    before = best.get((text, i), (0.0, 0, 0, 0))
                    first = int(start - bounds[text])
                    here = (share, first, first + end - start + WORDS - 1) if share > before[0] else before[:3]
                    best[text, i] = (*here, before[3] + 1)
            keys = sorted(best)
            ids = batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64()))
            columns = [ids, pa.array([known[k[1]].name for k in keys], pa.string()), *(pa.array([best[k][j] for k in keys], kind) for j, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "template", "containment", "first_word", "end_word", "n_windows"])

    return text_only(docs).mapInArrow(run, "doc_id long, template string, containment double, first_word long, end_word long, n_windows long")


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
