"""Licences of files: sparse TF-IDF cosine of their headers and whole texts to templates, then inheritance along paths.

Units of a file are its lines, its paragraphs (lines with words in a row), its comment blocks (lines that start with a comment mark in a row, those
without words between them included) and the whole text. A unit is a sparse vector of word counts times inverse document frequency, where the documents are all lines of
all files; its cosine to every template's vector is computed. A unit speaks for a licence at ``THRESHOLD`` or above, unless a template of another licence comes within
``MARGIN`` of it: words that two licences share name neither. The best unit names the file's own licence.

Three passes read the texts: one counts the lines of each template word; one finds the units that could reach the threshold if all their other words had the
least weight there is; one counts the lines of those other words, which meet the units in a join. Equal units meet it once, however many files have them.

A file without a licence of its own inherits that of the nearest directory above it that holds a licence file (by its name) whose
licence was found. Directories, not files, are joined to their ancestors, so a directory with most files counts once.

Defined results: null or empty texts have no own licence; a null path is the empty one, a file in the root; with several licence files in
a directory the best score counts, then the least name; ties between units of different licences go to the first template;
every input row gives one row, repeated ones too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import find_words, mix, new_folder, text_chunks, written

THRESHOLD = 0.6
MARGIN = 0.005
#: Rows of a table that goes to every task.
BROADCAST_ROWS = 200_000
#: Units laid over the templates at once.
UNITS_AT_ONCE = 2048

# Wordings of licences, of the notices that refer to them, and of the titles of their files.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_REST = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = (
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to <https://unlicense.org>"
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
_APACHE_REST = (
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)


def _gnu(kind: str, version: str, what: str = "program", mark: str = ":") -> str:
    """First paragraph of the notice that a file under a GNU licence carries."""
    return f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_REST),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _AS_IS),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("General Public License", "2", mark=";")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_REST),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library", ";")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_REST),
)
#: Names of licence files, without ending, lower-case.
LICENSE_FILES = ("license", "licence", "copying", "copyright", "unlicense", "notice")
#: A line whose first character other than white space is one of these belongs to a comment.
_MARKS = np.isin(np.arange(256), list(b"#/*;-%!"))

#: A word is joined letters and digits here: other ASCII characters become spaces, so "MIT." is "mit".
_PLAIN = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not (chr(_b).isalnum() or _b == 10):
        _PLAIN[_b] = 32


def _vectors(texts: list[str]) -> list[dict[int, int]]:
    out = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
        words = find_words(_PLAIN[data], offsets)
        for i in range(len(offsets) - 1):
            values, counts = np.unique(words.code[words.doc == i], return_counts=True)
            out.append(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, line of each word, text of each line, text of each word, whether each line is of a comment): lines are numbered through."""
    plain = _PLAIN[data]
    words = find_words(plain, offsets)
    ends = plain == 10
    before = np.concatenate([[0], np.cumsum(ends)])
    line = before[words.start] + words.doc  # a text starts a line too
    count = before[offsets[1:]] - before[offsets[:-1]] + 1
    owners = np.repeat(np.arange(len(count)), count)
    seen = np.flatnonzero(~np.isin(data, [9, 10, 11, 12, 13, 32]))
    of_seen = before[seen] + np.searchsorted(offsets, seen, side="right") - 1
    first = np.flatnonzero(np.diff(of_seen, prepend=-1))
    comment = np.zeros(len(owners), bool)
    comment[of_seen[first]] = _MARKS[data[seen[first]]]
    return words.code, line, owners, words.doc, comment


def _runs(inside: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Number of the run of lines that each line is of; lines outside, and texts, part runs."""
    new = ~inside
    new[1:] |= ~inside[:-1] | (owners[1:] != owners[:-1])
    return np.cumsum(new) - (1 if len(new) and new[0] else 0)


def _counted(code: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, unit, times), by unit and word."""
    order = np.lexsort((code, unit))
    code, unit = code[order], unit[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (unit[1:] != unit[:-1])])) if len(code) else np.zeros(0, np.int64)
    return code[first], unit[first], np.diff(first, append=len(code))


def _frequencies(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, lines): in how many lines each word of the vocabulary stands; word -1 tells of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lines = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(batch.schema.get_field_index("text"))):
                code, line, owners, _, _ = _lines(data, offsets)
                lines += len(owners)
                at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
                hit = vocabulary[at] == code
                pair = np.unique(line[hit].astype(np.int64) * len(vocabulary) + at[hit])
                found += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(np.arange(len(vocabulary)), -1)), "lines": pa.array(np.append(found, lines))})

    return run


def _other_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, lines): in how many lines of some texts each word stands."""
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(batch.schema.get_field_index("text"))):
            code, line, *_ = _lines(data, offsets)
            word, lines = np.unique(_counted(code, line)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "lines": pa.array(lines)})


_UNIT = "struct<u1 long, u2 long, within double, templates array<int>, dots array<double>, words array<long>, times array<int>>"
_UNIT_TYPE = pa.list_(pa.struct([("u1", pa.int64()), ("u2", pa.int64()), ("within", pa.float64()), ("templates", pa.list_(pa.int32())), ("dots", pa.list_(pa.float64())), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]))


def _possible(vocabulary: np.ndarray, idf: np.ndarray, matrix: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each file, with the units that reach the threshold if words that no template has weigh as little as any word can, which is their number.

    u1 and u2 name a unit by its words; within is the square of its length in template words; dots are products with the templates that it may reach.
    """
    most = matrix.max(axis=0)
    least = threshold - 1e-9

    def units(code: np.ndarray, unit: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, dict]]:
        word, of, times = _counted(code, unit)
        if not len(word):
            return
        n = int(of[-1]) + 1
        at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
        hit = vocabulary[at] == word
        weight = np.where(hit, times * idf[at], times)
        within = np.bincount(of[hit], weight[hit] ** 2, n)
        low = np.sqrt(np.bincount(of, weight**2, n))
        likely = np.flatnonzero((low > 0) & (np.bincount(of[hit], weight[hit] * most[at[hit]], n) >= least * low))
        for k in range(0, len(likely), UNITS_AT_ONCE):
            some = likely[k : k + UNITS_AT_ONCE]
            number = np.full(n, -1)
            number[some] = np.arange(len(some))
            mine = hit & (number[of] >= 0)
            dense = np.zeros((len(some), len(vocabulary)))
            dense[number[of[mine]], at[mine]] = weight[mine]
            dots = dense @ matrix.T
            for i in np.flatnonzero((dots >= least * low[some][:, None]).any(axis=1)):
                u = some[i]
                a, b = np.searchsorted(of, [u, u + 1])
                may = np.flatnonzero(dots[i] >= (least - MARGIN) * low[u])
                name = [int(np.sum(mix(word[a:b] ^ np.uint64(salt)) * times[a:b].astype(np.uint64), dtype=np.uint64).astype(np.int64)) for salt in (0x51, 0xA7)]
                others = ~hit[a:b]
                yield int(owner[u]), {"u1": name[0], "u2": name[1], "within": float(within[u]), "templates": may.tolist(), "dots": dots[i][may].tolist(), "words": word[a:b][others].view(np.int64).tolist(), "times": times[a:b][others].tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, to, data, offsets in text_chunks(batch.column(batch.schema.get_field_index("text"))):
                code, line, owners, doc, comment = _lines(data, offsets)
                n = to - at
                there = np.bincount(line, minlength=len(owners)) > 0
                bare = ~there  # a line of a comment mark alone joins a comment block, but not a paragraph
                found: list[dict] = [{} for _ in range(n)]
                everything = [(np.arange(n), doc), (owners, line)]
                for inside in (~bare, comment):
                    run_of = _runs(inside, owners)
                    of_run = np.zeros(int(run_of[-1]) + 1 if len(run_of) else 0, np.int64)
                    of_run[run_of] = owners
                    everything.append((of_run, run_of[line]))
                for owner, unit in everything:
                    for o, u in units(code, unit, owner):
                        found[o][u["u1"], u["u2"]] = u
                columns = {c: batch.column(batch.schema.get_field_index(c)).slice(at, n) for c in ("doc_id", "path")}
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(row, row + n)), **columns, "units": pa.array([list(f.values()) for f in found], _UNIT_TYPE)})
                row += n

    return run


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, own_score) of every file. files: doc_id, path, text."""
    texts = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), "text")
    vectors = _vectors([t for _, t in TEMPLATES])
    vocabulary = np.array(sorted({w for v in vectors for w in v}), dtype=np.uint64)
    counted = {r.word: r.lines for r in texts.select("text").mapInArrow(_frequencies(vocabulary), "word long, lines long").groupBy("word").agg(F.sum("lines").alias("lines")).collect()}  # the templates' words
    lines = counted.get(-1, 0)
    idf = np.log((1 + lines) / (1 + np.array([counted.get(i, 0) for i in range(len(vocabulary))]))) + 1
    matrix = np.zeros((len(vectors), len(vocabulary)))
    for i, v in enumerate(vectors):
        for word, times in v.items():
            k = int(np.searchsorted(vocabulary, np.uint64(word)))
            matrix[i, k] = times * idf[k]
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)

    path = new_folder(files.sparkSession, "licence-units")
    texts.mapInArrow(_possible(vocabulary, idf, matrix, threshold), f"row long, doc_id long, path string, units array<{_UNIT}>").write.parquet(path)
    found = files.sparkSession.read.parquet(path)
    units = written(found.select(F.explode("units").alias("u")).select("u.*").dropDuplicates(["u1", "u2"]), "different-units")

    wanted = written(units.select(F.explode("words").alias("word")).distinct(), "other-words")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rarity = texts.select("text").mapInArrow(_other_words, "word long, lines long").join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("lines").alias("lines"))
    square = F.pow(F.col("times") * (F.log(F.lit(1.0 + lines) / (1 + F.col("lines"))) + 1), 2)
    rest = units.select("u1", "u2", F.explode(F.arrays_zip("words", "times")).alias("w")).select("u1", "u2", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rest = rest.join(rarity, "word").groupBy("u1", "u2").agg(F.sum(square).alias("rest"))

    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    length = F.sqrt(F.col("within") + F.coalesce("rest", F.lit(0.0)))
    each = F.transform(F.arrays_zip("templates", "dots"), lambda x: F.struct(F.round(x["dots"] / length, 9).alias("score"), (-x["templates"]).alias("at"), F.get(names, x["templates"]).alias("license")))
    judged = units.join(rest, ["u1", "u2"], "left").select("u1", "u2", F.array_max(each).alias("best"), each.alias("each"))
    rival = F.exists("each", lambda x: (x["license"] != F.col("best.license")) & (x["score"] > F.col("best.score") - MARGIN))
    judged = written(judged.where((F.col("best.score") >= threshold) & ~rival).select("u1", "u2", "best"), "judged-units")
    judged = F.broadcast(judged) if judged.count() <= BROADCAST_ROWS else judged

    of_files = found.select("row", F.explode("units").alias("u")).select("row", "u.u1", "u.u2").join(judged, ["u1", "u2"]).groupBy("row").agg(F.max("best").alias("best"))
    return found.select("row", "doc_id", "path").join(of_files, "row", "left").select("doc_id", "path", F.col("best.license").alias("own_license"), F.coalesce("best.score", F.lit(0.0)).alias("own_score"))


def license_scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, origin) of every file; origin: own, inherited or none.

    files: doc_id, path (directories parted by slashes), text.
    """
    own = written(own_licenses(files, threshold), "own-licenses")
    directory, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    named = own.withColumns({"directory": directory, "name": name})
    is_license = F.regexp_extract(F.lower("name"), r"^([a-z]+)(?:[.-][^/]*)?$", 1).isin(*LICENSE_FILES)
    best = F.min_by("own_license", F.struct(-F.col("own_score"), F.col("name"), F.col("own_license")))
    of_directory = named.where(is_license & F.col("own_license").isNotNull()).groupBy("directory").agg(best.alias("license"))
    parts = F.split("directory", "/")
    depths = F.sequence(F.lit(0), F.size(parts))
    above = named.select("directory").distinct().select("directory", F.explode(depths).alias("depth")).withColumn("ancestor", F.array_join(F.slice(F.split("directory", "/"), 1, F.col("depth")), "/"))
    above = above.where((F.col("depth") == 0) | (F.col("ancestor") != ""))
    found = above.join(of_directory.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max_by("license", "depth").alias("inherited"))
    out = named.join(found, "directory", "left")
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), origin.alias("origin"))
