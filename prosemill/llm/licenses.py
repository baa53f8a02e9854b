"""Licence scans with a positional rare-token index.

Templates (whole short licences, and the notices that longer ones ask for) are
indexed by word and position. The inverse document frequency of every template
word comes from a count over all documents. A scan looks up each file's
highest-IDF licence words: of a template's words that the file has, the rarest
ones, as many as leave no place unseen (a place may miss ``1 - min_share`` of the
words, those that the file lacks are among them, so two more than may still be
missed are enough for two votes). Every occurrence of such a word votes for the
place at which the template would begin (file position minus template position);
places where enough rare words agree are aligned word by word. Each line of a
template is such a part of its own; parts in their order and near each other are
one licence, which is reported when enough of the template's words agree and its
mandatory key phrases stand inside the range. So a changed name or other numbers
of clauses do not hide a long licence.

Base phrases are found beside it: places where a phrase's words stand
consecutively.

Defined results: a null or empty text has no words and no label (empty strings,
score 0, null positions); a null id stays; repeated rows give repeated rows; of
templates with equal scores all labels are reported; other columns are not read.
Whole texts are scanned. Per task only one count per template word is shuffled;
templates are a fixed list, so what is broadcast does not grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Phrase and label of the base scan.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_MIT = _MIT_GRANT + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CONDITIONS = """
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""


def _gnu(thing: str, name: str, version: str) -> str:
    return f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Label, licence or notice, mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", _APACHE, ["apache license version 2 0", "apache org licenses license 2 0"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", _gnu("program", "General Public License", "3"), ["gnu general public license", "either version 3 of the license"]),
    ("gpl-2.0", _gnu("program", "General Public License", "2"), ["gnu general public license", "either version 2 of the license"]),
    ("lgpl-3.0", _gnu("library", "Lesser General Public License", "3"), ["gnu lesser general public license", "either version 3 of the license"]),
    ("lgpl-2.1", _gnu("library", "Lesser General Public License", "2.1"), ["gnu lesser general public license", "version 2 1 of the license"]),
    ("agpl-3.0", _gnu("program", "Affero General Public License", "3"), ["gnu affero general public license", "either version 3 of the license"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("mit", "released under the MIT License", ["mit license"]),
    ("mit", _MIT_GRANT, ["hereby granted free of charge", "without restriction"]),
    ("mit", _MIT, ["hereby granted free of charge", "the software is provided as is"]),
    ("bsd-3-clause", _BSD_OPENING + _BSD_CONDITIONS + _BSD_NAME + _BSD_DISCLAIMER, ["source and binary forms", "neither the name"]),
    ("bsd-2-clause", _BSD_OPENING + _BSD_CONDITIONS + _BSD_DISCLAIMER, ["source and binary forms", "with the distribution this software is provided"]),
    ("isc", _ISC, ["with or without fee", "appear in all copies"]),
    ("zlib", _ZLIB, ["must not be misrepresented", "this notice may not be removed"]),
    ("unlicense", _UNLICENSE, ["released into the public domain"]),
    ("mpl-2.0", _MPL, ["mozilla public license v 2 0"]),
]


@dataclass(frozen=True)
class ScanRules:
    #: Rare words that must agree on a place.
    min_votes: int = 2
    #: Share of the words of a part, and of a template, that must agree.
    min_share: float = 0.7
    #: Words that may stand between two parts of a template.
    max_gap: int = 50


def _hashes(phrase: str) -> np.ndarray:
    t = T.texts(pa.array([phrase]))
    data = T.LOWER[t.data]
    w = T.words(t, T.ALNUM, data)
    return T.SpanHash(data)(w.start, w.end)


class Scanner:
    """Templates as word positions and, after ``weigh``, their words in order of rarity."""

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES, rules: ScanRules | None = None):
        self.rules = rules or ScanRules()
        self.labels = [label for label, _, _ in templates]
        #: Every line of a template is a part, aligned on its own: (template, number) and its words.
        self.parts = [(k, i) for k, (_, text, _) in enumerate(templates) for i in range(text.count("\n") + 1)]
        self.words = [_hashes(line) for _, text, _ in templates for line in text.split("\n")]
        self.total = [len(_hashes(text)) for _, text, _ in templates]
        self.keys = [[_hashes(k) for k in keys] for _, _, keys in templates]
        self.base = [(_hashes(phrase), label) for phrase, label in base]
        self.vocabulary = np.unique(np.concatenate([*self.words, *[h for h, _ in self.base], *[k for own in self.keys for k in own]]))
        self.ids = [np.searchsorted(self.vocabulary, h) for h in self.words]
        #: How often each word stands in each template.
        self.held = np.stack([np.bincount(i, minlength=len(self.vocabulary)) for i in self.ids], 1).astype(np.float32)
        self.least = np.array([math.ceil(self.rules.min_share * len(i) - 1e-9) for i in self.ids])
        self.weigh(np.zeros(len(self.vocabulary), np.int64), 0)

    def weigh(self, df: np.ndarray, total: int) -> None:
        """Order the words of each template by inverse document frequency, from the number of documents with each word."""
        idf = np.log((total + 1) / (df + 1))
        self.rarest = [np.argsort(-idf[i], kind="stable") for i in self.ids]

    def begins(self, rows: int, row: np.ndarray, word: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, template, first word) where the rarest words of the template that the row has agree, from all (row, word, place) of licence words."""
        order = np.lexsort((place, word, row))
        place, key = place[order], row[order] * len(self.vocabulary) + word[order]
        present, first = np.unique(key, return_index=True)
        ends = np.append(first[1:], len(key))
        seen = np.zeros((rows, len(self.vocabulary)), np.float32)
        seen[present // len(self.vocabulary), present % len(self.vocabulary)] = 1
        has = seen @ self.held
        for r, k in np.argwhere(has >= self.least).tolist():
            rarest = self.rarest[k]
            here = rarest[seen[r, self.ids[k][rarest]] > 0][: int(has[r, k]) - self.least[k] + self.rules.min_votes]
            at = np.searchsorted(present, r * len(self.vocabulary) + self.ids[k][here])
            begin = np.concatenate([place[first[i] : ends[i]] - offset for i, offset in zip(at.tolist(), here.tolist(), strict=True)])
            begin, votes = np.unique(begin, return_counts=True)
            for b in begin[votes >= min(self.rules.min_votes, len(here))].tolist():
                yield r, k, b

    def read(self, t: T.Texts) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words, their hashes, and the positions and vocabulary ids of licence words."""
        data = T.LOWER[t.data]
        w = T.words(t, T.ALNUM, data)
        h = T.SpanHash(data)(w.start, w.end)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == h)
        return w, h, hit, at[hit]

    @staticmethod
    def places(phrase: np.ndarray, w: T.Words, h: np.ndarray, hit: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Word positions at which the phrase stands within one row."""
        at = hit[h[hit] == phrase[0]]
        at = at[at + len(phrase) <= w.bounds[rows[at] + 1]] if len(at) else at
        for k in range(1, len(phrase)):
            at = at[h[at + k] == phrase[k]]
        return at

    def scan(self, t: T.Texts) -> list[dict]:
        """For each row: n_words, base places and labels, and accepted matches (label, first word, end, score)."""
        w, h, hit, word = self.read(t)
        rows = w.row()
        out = [{"n_words": n, "n_base": 0, "first_word": None, "last_word": None, "base_labels": set(), "matches": []} for n in np.diff(w.bounds).tolist()]
        for phrase, label in self.base:
            at = self.places(phrase, w, h, hit, rows)
            for p, r in zip((at - w.bounds[rows[at]]).tolist() if len(at) else (), rows[at].tolist() if len(at) else (), strict=True):
                x = out[r]
                x["n_base"] += 1
                x["first_word"] = p if x["first_word"] is None else min(p, x["first_word"])
                x["last_word"] = p if x["last_word"] is None else max(p, x["last_word"])
                x["base_labels"].add(label)
        placed: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for r, part, b in self.begins(len(t), rows[hit], word, hit):
            low, high = int(w.bounds[r]), int(w.bounds[r + 1])
            own = self.words[part]
            a, e = max(b, low), min(b + len(own), high)
            same = int((h[a:e] == own[a - b : e - b]).sum())
            if same >= self.least[part]:
                k, i = self.parts[part]
                placed.setdefault((r, k), []).append((a, e, i, same))
        inside = {}
        for (r, k), found in placed.items():
            for a, e, score in self.chained(found, self.total[k]):
                for i, phrase in enumerate(self.keys[k]):
                    if (k, i) not in inside:
                        inside[k, i] = self.places(phrase, w, h, hit, rows)
                    at = inside[k, i]
                    j = np.searchsorted(at, a)
                    if j >= len(at) or at[j] + len(phrase) > e:
                        break
                else:
                    low = int(w.bounds[r])
                    out[r]["matches"].append((self.labels[k], a - low, e - low, score))
        return out

    def chained(self, placed: list[tuple[int, int, int, int]], total: int) -> Iterator[tuple[int, int, float]]:
        """Range and score of runs of placed parts (first word, end, number, equal words) that have enough of the template's words.

        A part follows the best run of lower parts that ends at most ``max_gap`` words
        before it; a run that another goes on from is not reported itself.
        """
        placed = sorted(placed)
        best, first, used = [], [], [False] * len(placed)
        longest = max(e - a for a, e, _, _ in placed)
        at = 0
        for j, (a, _, number, same) in enumerate(placed):
            while placed[at][0] + longest + self.rules.max_gap < a:
                at += 1
            before = max((i for i in range(at, j) if placed[i][2] < number and 0 <= a - placed[i][1] <= self.rules.max_gap), key=lambda i: best[i], default=None)
            best.append(same + (0 if before is None else best[before]))
            first.append(a if before is None else first[before])
            if before is not None:
                used[before] = True
        least = math.ceil(self.rules.min_share * total - 1e-9)
        for (_, e, _, _), n, a, goes_on in zip(placed, best, first, used, strict=True):
            if n >= least and not goes_on:
                yield a, e, n / total


_MATCH = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label:string,first:bigint,end:bigint,score:double>>"


def _weighed(texts: DataFrame, scanner: Scanner) -> Scanner:
    def count(batches):
        df, total = np.zeros(len(scanner.vocabulary), np.int64), 0
        for b in T.chunks(batches, "__text"):
            w, _, hit, word = scanner.read(T.texts(b.column("__text")))
            total += b.num_rows
            pairs = np.unique(w.row()[hit] * len(df) + word)
            df += np.bincount(pairs % len(df), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate(([total], df)))], names=["word", "n"])

    counted = texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r[0]: r[1] for r in counted.collect()}  # one row per template word
    scanner.weigh(np.array([n.get(k, 0) for k in range(len(scanner.vocabulary))]), n.get(-1, 0))
    return scanner


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE_PHRASES, rules: ScanRules | None = None) -> DataFrame:
    """Per row: id, word and phrase counts, labels, the best score, and all accepted matches with their word ranges."""
    T.prepare(df.sparkSession)
    wanted = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    scanner = _weighed(wanted.select("__text"), Scanner(templates, base, rules))

    def run(batches):
        for b in T.chunks(batches, "__text"):
            found = scanner.scan(T.texts(b.column("__text")))
            longs = [pa.array([x[c] for x in found], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("__id"),
                    *longs,
                    pa.array([",".join(sorted(x["base_labels"])) for x in found], pa.string()),
                    pa.array([",".join(sorted(x["base_labels"] | {m[0] for m in x["matches"]})) for x in found], pa.string()),
                    pa.array([max([0.0, *(m[3] for m in x["matches"])]) for x in found], pa.float64()),
                    pa.array([[dict(zip(("label", "first", "end", "score"), m, strict=True)) for m in sorted(x["matches"], key=lambda m: (m[1], m[0]))] for x in found], pa.list_(_MATCH)),
                ],
                names=["__id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    return wanted.mapInArrow(run, f"__id {wanted.schema['__id'].dataType.simpleString()}, {_SCHEMA}").withColumnRenamed("__id", id_col)
