"""License scanning: sparse TF-IDF cosine to templates, then inheritance along directories.

Words and word pairs are weighted by term frequency times the templates' inverse document frequency (a
term that no template has weighs as one that a single template has) and compared by cosine. A text as a
whole and its header block (the comment it begins with, without comment marks, else its first paragraph)
are compared with whole license texts and standard headers; the best is the document's own license if it
reaches `least_whole`. Else every stretch that speaks of a license, within its line and across the lines
beside it, is compared with one-sentence notices; the best of all is the own license if it reaches `least`.

A license file is one with the name of a license file, or one that as a whole reaches `least_whole` with a
whole license text, whatever its length.

Files without an own license take that of the nearest ancestor directory that has a license file.
Directories are made distinct first, each is exploded into its ancestors and joined with the license
files' directories; only then files are joined with their directory, so a directory with a large share
of all files is one row until the last join, whose sides Spark can split.

Defined cases: null and empty texts have no license; ties between templates go to the first name, ties
between license files of a directory to the more similar, then the lesser name, then the lesser path; a null path has no
directory and inherits nothing; texts of any length are compared whole; rows are independent and repeated rows stay; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import WHOLE
from .store import written
from .textkernel import sub_batches

# Short notices as they stand in files, by SPDX name.
TEMPLATES = {
    "0BSD": ["Licensed under the Zero-Clause BSD License.", "SPDX-License-Identifier: 0BSD"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["Released under the zlib License.", "SPDX-License-Identifier: Zlib"],
}

_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with this {0}."
#: Standard headers of source files.
HEADERS = {
    "AGPL-3.0": [_GNU.format("program", "Affero ", "3")],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "GPL-2.0": [_GNU.format("program", "", "2")],
    "GPL-3.0": [_GNU.format("program", "", "3")],
    "LGPL-2.1": [_GNU.format("library", "Lesser ", "2.1")],
    "LGPL-3.0": [_GNU.format("library", "Lesser ", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
_KEY = re.compile(r"licen[cs]e", re.IGNORECASE)
# Every whole text and header has one of these.
_LEGAL = re.compile(r"licen[cs]e|permi(?:ssion|t)|redistribut|public domain|warrant", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
_MARK = re.compile(r"[ \t]*(?:#+|//+!?|/\*+!?|\*+/?|--+|;+|%+|<!--|dnl\b|rem\b)?[ \t]*", re.IGNORECASE)
_CLOSERS = ("*/", "-->")
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"), ("{-", "-}"), ("(*", "*)"))
_LINES = ("//", "#", "--", ";", "%", "dnl ", "rem ", "REM ", "*")
#: Lines whose verdict is kept, and the longest of them.
KEPT_LINES, KEPT_LINE = 4096, 2000
#: Names of license files; source files with such a name are none.
LICENSE_FILE = r"(?i)(?:^|/)(?!(?:[^/]*)\.(?:py|js|jsx|ts|tsx|go|rs|java|kt|scala|c|cc|cpp|cs|h|hpp|rb|php|swift|sh|json|ya?ml|xml|toml|css)$)(?:[^/]*[-_.])?(?:(?:un)?licen[cs]es?|copying|copyright)(?:[-_.][^/]*)?$"


def _bare(line: str) -> str:
    line = line[_MARK.match(line).end() :]
    end = line.rstrip(" \t\r")
    closer = next((c for c in _CLOSERS if end.endswith(c)), "")
    return end[: -len(closer)].rstrip(" \t") if closer else line


def unmarked(text: str) -> str:
    """A text without the comment marks at the ends of its lines."""
    return "\n".join(map(_bare, text.split("\n")))


def header(text: str) -> str:
    """The comment that a text begins with, blank and `#!` lines before it left out; else its first paragraph."""
    text = re.sub(r"\A(?:[ \t\r]*\n|#![^\n]*\n|#[^\n]*coding[:=][^\n]*\n)+", "", text.lstrip("\ufeff")).lstrip()
    for begin, end in _BLOCKS:
        if text.startswith(begin):
            stop = text.find(end, len(begin))
            return text[len(begin) : stop if stop >= 0 else len(text)]
    mark = next((m for m in _LINES if text.startswith(m)), None)
    if mark is None:
        return re.split(r"\n[ \t\r]*\n", text, maxsplit=1)[0]
    lines = []
    for line in text.split("\n"):
        if line.strip() and not line.lstrip().startswith(mark.strip()):
            break
        lines.append(line)
    return "\n".join(lines)


def terms(line: str) -> Counter:
    words = _WORD.findall(line.lower())
    return Counter(words) + Counter(zip(words, words[1:], strict=False))


class Templates:
    def __init__(self, texts: dict[str, list[str]]) -> None:
        drawn = [(name, terms(t)) for name in sorted(texts) for t in texts[name]]
        seen = Counter(t for _, c in drawn for t in c)
        self.idf = {t: math.log((1 + len(drawn)) / (1 + n)) + 1 for t, n in seen.items()}
        self.rare = math.log((1 + len(drawn)) / 2) + 1
        self.vectors = [(name, len(t.split()), self._unit(terms(t))) for name in sorted(texts) for t in texts[name]]
        self.sizes: dict[int, list[int]] = {}
        for k, (_, size, _) in enumerate(self.vectors):
            self.sizes.setdefault(size, []).append(k)
        self.lines: dict[str, tuple[str | None, float]] = {}
        self.holders: dict = {}
        for k, (_, _, vector) in enumerate(self.vectors):
            for t, w in vector.items():
                self.holders.setdefault(t, []).append((k, w))

    def _unit(self, counts: Counter) -> dict:
        weights = {t: n * self.idf.get(t, self.rare) for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def line(self, line: str) -> tuple[str | None, float]:
        """The best template for a line, over the stretches of the template's length that hold the keyword.

        Of equal ones that of the earliest keyword, then the first template, then the earliest stretch.
        """
        if len(line) > KEPT_LINE:
            return self._line(line)
        if line not in self.lines:
            if len(self.lines) >= KEPT_LINES:
                self.lines.clear()
            self.lines[line] = self._line(line)
        return self.lines[line]

    def _line(self, line: str) -> tuple[str | None, float]:
        tokens = line.split()
        keys = np.array([i for i, w in enumerate(tokens) if _KEY.search(w)], np.int64)
        if not len(keys):
            return None, 0.0
        owner = np.array([i for i, t in enumerate(tokens) for _ in _WORD.findall(t.lower())], np.int64)
        words = _WORD.findall(" ".join(tokens).lower())
        first = np.searchsorted(owner, np.arange(len(tokens) + 1))  # each token's first word
        best: list[tuple] = []
        for size in self.sizes:
            turns = np.zeros(len(tokens) + 1, np.int64)  # where stretches that hold a keyword begin and cease to
            np.add.at(turns, np.maximum(keys - size + 1, 0), 1)
            np.add.at(turns, keys + 1, -1)
            begins = np.flatnonzero(np.cumsum(turns) > 0)
            for part in np.split(begins, np.flatnonzero(np.diff(begins) > 1) + 1):
                a, ends = first[part], first[np.minimum(part + size, len(tokens))]
                for k, scores in self._slide(words, a, ends, size):
                    top = scores.max()
                    if top > 0:
                        held = part[scores == top]
                        key = keys[np.searchsorted(keys, held)]  # the earliest keyword of each stretch
                        j = int(np.lexsort((held, key))[0])
                        best.append((-float(top), int(key[j]), k, int(held[j])))
        return (self.vectors[min(best)[2]][0], -min(best)[0]) if best else (None, 0.0)

    def _slide(self, words: list[str], begins: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
        """(template, rounded similarities) of the word ranges, which move to the right, for the templates of a size.

        Dot products are differences of running sums; the ranges' lengths follow the counts of the words that enter and leave.
        """
        low, high = int(begins[0]), int(ends[-1])
        words = words[low:high]
        terms_ = [words, list(zip(words, words[1:], strict=False))]
        weights = [np.array([self.idf.get(t, self.rare) for t in own]) for own in terms_]
        begins, ends = begins - low, ends - low
        lasts = np.maximum(ends - 1, begins)  # pairs end one word earlier
        squares, norm, at, to = np.zeros(len(begins)), 0.0, [0, 0], [0, 0]
        counts: dict = {}
        for n, (a, e, e2) in enumerate(zip(begins.tolist(), ends.tolist(), lasts.tolist(), strict=True)):
            for kind, end in ((0, e), (1, e2)):
                while to[kind] < end:
                    t, w = terms_[kind][to[kind]], float(weights[kind][to[kind]])
                    c = counts[t] = counts.get(t, 0) + 1
                    norm += (2 * c - 1) * w * w
                    to[kind] += 1
                while at[kind] < min(a, to[kind]):
                    t, w = terms_[kind][at[kind]], float(weights[kind][at[kind]])
                    c = counts[t] = counts[t] - 1
                    norm -= (2 * c + 1) * w * w
                    at[kind] += 1
            squares[n] = norm
        whole = np.sqrt(np.maximum(squares, 1e-9))
        for k in self.sizes[size]:
            vector, dot = self.vectors[k][2], 0.0
            for kind, stop in ((0, ends), (1, lasts)):
                run = np.concatenate([[0.0], np.cumsum(weights[kind] * np.array([vector.get(t, 0.0) for t in terms_[kind]]))])
                dot = dot + run[stop] - run[begins]
            yield k, np.round(np.where(squares > 1e-9, dot / whole, 0.0), 6)

    def best(self, text: str | None) -> tuple[str | None, float]:
        top: tuple[str | None, float] = (None, 0.0)
        lines = (text or "").split("\n") if _KEY.search(text or "") else []
        for k in (k for k, line in enumerate(lines) if _KEY.search(line)):
            found = self.line(lines[k])
            if found[1] < 1 and len(lines) > 1:
                near = self.line(" ".join(x.strip() for x in unmarked("\n".join(lines[max(0, k - 1) : k + 2])).split("\n")))
                found = near if near[1] > found[1] else found
            if found[1] > top[1]:
                top = found
        return top

    def whole(self, text: str) -> tuple[str | None, float]:
        """The best template for a text as a whole."""
        own = self._unit(terms(text))
        scores: dict[int, float] = {}
        for t, w in own.items():
            for k, v in self.holders.get(t, ()):
                scores[k] = scores.get(k, 0.0) + w * v
        found = [(-round(x, 6), self.vectors[k][0]) for k, x in scores.items()]
        return (min(found)[1], -min(found)[0]) if found else (None, 0.0)


class Judge:
    """Own license, its similarity, and the similarity of a text as a whole to a whole license text."""

    def __init__(self, notices: dict[str, list[str]], wholes: dict[str, str], headers: dict[str, list[str]], least: float, least_whole: float) -> None:
        self.notices, self.least, self.least_whole = Templates(notices), least, least_whole
        self.texts = Templates({n: [t] for n, t in wholes.items()})
        self.both = Templates({n: [*([wholes[n]] if n in wholes else []), *headers.get(n, [])] for n in {*wholes, *headers}})

    def __call__(self, text: str | None) -> tuple[str | None, float, float]:
        if not _LEGAL.search(text or ""):
            return None, 0.0, 0.0
        plain = unmarked(text)
        file = self.texts.whole(plain)
        found = [self.both.whole(plain), self.both.whole(unmarked(header(text)))]
        best = max(found, key=lambda x: x[1])
        if best[1] < self.least_whole:
            best = max(best, self.notices.best(text), key=lambda x: x[1])
        return best[0] if best[1] >= self.least else None, best[1], file[1]


def own_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = 0.6, wholes: dict[str, str] = WHOLE, headers: dict[str, list[str]] = HEADERS, least_whole: float = 0.75) -> DataFrame:
    """files (doc_id, path, text) -> doc_id, path, own_license, similarity, is_license_file."""
    shared = files.sparkSession.sparkContext.broadcast((templates, wholes, headers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value, least, least_whole)
        for batch in sub_batches(batches, "text"):
            found = [judge(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64())))], ["doc_id", "path", "own_license", "similarity", "as_text"])

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text")
    found = rows.mapInArrow(run, "doc_id long, path string, own_license string, similarity double, as_text double")
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    return found.select("doc_id", "path", "own_license", "similarity", (named | (F.col("as_text") >= least_whole)).alias("is_license_file"))


def inherit(files: DataFrame) -> DataFrame:
    """files (doc_id, path, own_license, similarity, is_license_file) -> adds license and inherited_from (a directory)."""
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    files = written(files.withColumn("folder", folder), "licenses")  # read three times below
    held = files.where("is_license_file and own_license is not null and path is not null")
    rank = F.struct((-F.col("similarity")).alias("s"), F.col("own_license").alias("l"), F.col("path").alias("p"))
    held = held.groupBy(F.col("folder").alias("of")).agg(F.min(rank)["l"].alias("found"))
    steps = F.split("folder", "/")
    depth = F.sequence(F.lit(0), F.size(steps))
    above = files.where("path is not null").select("folder").distinct().select("folder", F.explode(depth).alias("depth")).withColumn("of", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    near = above.join(held, "of").groupBy("folder").agg(F.max(F.struct("depth", "of", "found")).alias("n"))
    near = near.select(F.col("folder").alias("in"), F.length("folder").alias("size"), F.col("n.of").alias("from"), F.col("n.found").alias("found"))
    # The length is a second key: so Spark shuffles both sides for this join and can split a directory with many files.
    both = files.join(near, (F.col("folder") == F.col("in")) & (F.length("folder") == F.col("size")), "left")
    return both.select("doc_id", "path", "own_license", "similarity", F.coalesce("own_license", "found").alias("license"), F.when(F.col("own_license").isNull(), F.col("from")).alias("inherited_from"))
