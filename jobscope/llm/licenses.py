"""License scans: normalised lines, paragraphs, runs of paragraphs and texts against licence templates by Dice over word bigrams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm.common import Words, mix64, slices

#: A unit matches its best template from this coefficient on.
LEAST = 0.8
#: Paragraphs of a run at most.
RUN = 8

#: The disclaimers of licences, without the names of holders.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies."
)


def _gnu(kind: str, what: str, version: str) -> str:
    """The notice that a GNU licence asks for; the words differ by what is licensed and by version."""
    free = f"This {what} is free software{':' if version == '3' else ';'} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation"
    later = f"{', ' if version == '3' else '; '}either version {version} of the License, or (at your option) any later version."
    return (
        f"{free}{later} This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
    )


#: Usual notices and licence texts. Full texts have their disclaimers; titles and lines of copyright are left out.
TEMPLATES = {
    "AGPL-3.0-notice": _gnu("Affero General", "program", "3"),
    "BSD-2-Clause-full": f"{_BSD_2} {_AS_IS}",
    "BSD-3-Clause-full": f"{_BSD_2}{_BSD_3} {_AS_IS}",
    "BSD-3-Clause-text": f"{_BSD_2}{_BSD_3}",
    "GPL-2.0-notice": _gnu("General", "program", "2"),
    "GPL-3.0-notice-full": _gnu("General", "program", "3"),
    "ISC-full": (
        f'{_ISC} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1-notice": _gnu("Lesser General", "library", "2.1"),
    "LGPL-3.0-notice": _gnu("Lesser General", "program", "3"),
    "MIT-full": (
        f'{_MIT} THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either "
        "in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _BSD_2,
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": _ISC,
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT,
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "proprietary": "All rights reserved.",
}

#: Bytes of normalised text: A-Z small, other ASCII letters, digits, line ends and what isn't ASCII as they are, the rest blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FIRST = np.uint64(0x9FB21C651E98DF25)


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes[:-1] * _FIRST + hashes[1:])


class Templates:
    """Bigram counts of the templates; all their bigrams sorted; and which sizes of units can reach the coefficient with each."""

    def __init__(self, texts: dict[str, str], least: float) -> None:
        self.names = sorted(texts)
        self.least = least
        self.counts = [Counter(_bigrams(Words([texts[n].replace("\n", " ").encode().translate(_PLAIN)]).hashes).tolist()) for n in self.names]
        self.sizes = np.array([sum(c.values()) for c in self.counts])
        self.all = np.array(sorted(set().union(*self.counts)), dtype=np.uint64)

    def reach(self, hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """units x templates: whether the coefficient can be reached, given a unit's size and how many of its bigrams occur in any template."""
        most = np.minimum(hits[:, None], self.sizes)
        return 2 * most >= self.least * (sizes[:, None] + self.sizes)

    def best(self, bigrams: list[int], candidates: np.ndarray) -> tuple[float, str] | None:
        """Of equal coefficients the first name."""
        own, found = Counter(bigrams), None
        for k in candidates:
            other = self.counts[k]
            dice = 2.0 * sum(min(n, other[b]) for b, n in own.items() if b in other) / float(len(bigrams) + self.sizes[k])
            if dice >= self.least and (found is None or dice > found[0]):
                found = dice, self.names[k]
        return found


def _units(w: Words) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Kind, first and last word of lines, of paragraphs (lines with words, next to each other) of two or more lines, of runs of two to RUN paragraphs that aren't the whole text, and of texts of two or more paragraphs."""
    lines = np.concatenate([[0], np.cumsum(w.buffer == 10)])[w.starts]  # texts are joined by line ends
    row = np.repeat(np.arange(len(w.first) - 1), w.counts())

    def cut(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(new)
        return first, np.append(first[1:], len(new))

    def inner(first: np.ndarray, end: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        several = np.searchsorted(parts, end) - np.searchsorted(parts, first) > 1
        return first[several], end[several]

    fresh = np.diff(row, prepend=-1) != 0
    line = cut(fresh | (np.diff(lines, prepend=-1) != 0))
    paragraph = cut(fresh | (np.diff(lines, prepend=-1) > 1))
    text = cut(fresh)
    yield "line", *line
    yield "paragraph", *inner(*paragraph, line[0])
    several = inner(*text, paragraph[0])
    yield "text", *several
    whole = set(zip(*(x.tolist() for x in several), strict=True))
    for n in range(2, RUN + 1):
        first, end = paragraph[0][: max(0, len(paragraph[0]) - n + 1)], paragraph[1][n - 1 :]
        same = np.flatnonzero(row[first] == row[end - 1]) if len(first) else np.zeros(0, dtype=int)
        same = same[[(a, b) not in whole for a, b in zip(first[same].tolist(), end[same].tolist(), strict=True)]] if len(same) else same
        yield "run", first[same], end[same]


FOUND = "doc_id long, unit string, first_word long, n_words long, license string, dice double"


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row for each line, paragraph of several lines, run of paragraphs, and text of several paragraphs, whose best template has a coefficient of least or more; of runs that start alike the best (then the first name, then the shortest).

    Words are runs of letters and digits after normalising; a paragraph is lines with words next to each other. Bigrams
    are bags, the coefficient is twice the common ones over the sum of both sizes. Since at most the smaller bag is common,
    sizes rule out most templates, and the number of a unit's bigrams that occur in any template most units. A unit of one
    word has no bigrams and matches nothing, nor do null and empty texts. first_word counts from 0 in the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(texts, least)
        for batch in batches:
            for part in slices(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
                piece = batch.slice(part.start, part.stop - part.start)
                w = Words([(x or b"").translate(_PLAIN) for x in piece["text"].to_pylist()])
                if len(w.hashes) < 2:
                    continue
                row = np.repeat(np.arange(len(piece)), w.counts())
                bigrams = _bigrams(w.hashes)
                at = np.minimum(np.searchsorted(t.all, bigrams), len(t.all) - 1)
                hits = np.concatenate([[0], np.cumsum(t.all[at] == bigrams)])
                out: dict[tuple, tuple] = {}
                for kind, first, end in _units(w):
                    reach = t.reach(hits[end - 1] - hits[first], end - 1 - first) & (end - first > 1)[:, None]
                    for k in np.flatnonzero(reach.any(axis=1)):
                        a, b = int(first[k]), int(end[k])
                        if found := t.best(bigrams[a : b - 1].tolist(), np.flatnonzero(reach[k])):
                            new = (int(row[a]), kind, a - int(w.first[row[a]]), b - a, found[1], found[0])
                            old = out.get((kind, a), new)
                            out[kind, a] = min(old, new, key=lambda x: (-x[5], x[4], x[3]))
                if out:
                    columns = list(zip(*out.values(), strict=True))
                    yield pa.RecordBatch.from_arrays([
                        piece["doc_id"].take(pa.array(columns[0])), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4]), pa.array(columns[5], pa.float64()),
                    ], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
OP7_SQL = rf"""
with t as (select n license, [y for y in string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ') if y <> ''] w from (values {_VALUES}) v(n, x)),
tb as (select license, len(w) - 1 t, b, count(*) n from (select license, w, unnest([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) b from t) group by license, t, b),
d as (select doc_id, string_split(text, chr(10)) l from documents where text is not null),
raw as (select doc_id, unnest(l) x, unnest(range(1, len(l) + 1)) i from d),
split as (select doc_id, i, [y for y in regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x09\x0B-/:-@\[-`\x7B-\x7F]+') if y <> ''] w from raw),
line as (
  select *, sum(len(w)) over (partition by doc_id order by i)::bigint - len(w) f,
    sum(case when len(w) = 0 then 1 else 0 end) over (partition by doc_id order by i) g
  from split),
full_line as (select *, dense_rank() over (partition by doc_id order by g) r, min(g) over (partition by doc_id) = max(g) over (partition by doc_id) one from line where len(w) > 0),
edge as (select doc_id, r, max(r) over (partition by doc_id) n from (select distinct doc_id, r from full_line)),
run as (select a.doc_id, a.r low, b.r high from edge a join edge b on a.doc_id = b.doc_id and b.r between a.r + 1 and a.r + {RUN - 1} and (a.r > 1 or b.r < a.n)),
u as (
  select doc_id, 'line' unit, f, w from full_line
  union all
  select doc_id, 'paragraph', min(f), flatten(list(w order by i)) from full_line group by doc_id, g having count(*) > 1
  union all
  select doc_id, 'text', min(f), flatten(list(w order by i)) from full_line group by doc_id having count(distinct g) > 1
  union all
  select l.doc_id, 'run', min(f), flatten(list(w order by i)) from run join full_line l on l.doc_id = run.doc_id and r between low and high group by l.doc_id, low, high),
ub as (select doc_id, unit, f, n_words, b, count(*) n from (
  select doc_id, unit, f, len(w) n_words, unnest([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) b from u) group by all),
m as (select doc_id, unit, f, n_words, license, 2.0::double * sum(least(ub.n, tb.n))::double / (n_words - 1 + t)::double dice from ub join tb using (b) group by doc_id, unit, f, n_words, license, t)
select doc_id, unit, f first_word, n_words, license, dice from m where dice >= 0.8
qualify row_number() over (partition by doc_id, unit, f order by dice desc, license, n_words) = 1
"""
