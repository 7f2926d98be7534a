"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line and sentence of a file, the file as a whole, and every window of words as long as a template, line
ends or not, is compared with licence statements, names, notices and whole licence texts; words are weighted
by how rare they are over all files. A file that is mostly such places, or is named like one, is a licence file and
speaks for its directory. A file without a licence of its own takes that of its nearest ancestor
directory that has one, by joins on paths.

Defined results: null and empty texts have no licence of their own; a text is read whole, at any length; a
null path has no directories; ties between templates go to the longer one, then, as between a
directory's licence files, to the smaller name;
repeated rows are separate files; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .decontamination import _NOT_WORD, _numbered
from .shingles import hashed_words

#: Licence names with the statements by which files refer to them.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License v3.0"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Simplified BSD License"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "EPL-2.0": ["Made available under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GPL version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 3"],
    "ISC": ["Released under the ISC License."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Sentences of the licences' own texts, and their titles.
TEXTS = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "EPL-2.0": ["THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Short forms, which have to be there word by word: a near one names another licence or none.
EXACT = {n: [f"SPDX-License-Identifier: {n}", f"Released under {n}", f"Licensed under {n}", f"Released under the {n} license", f"Licensed under the {n} license", *([n] if "-" in n else [f"{n} license"])] for n in TEMPLATES}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. You should have received a copy of the GNU {name} General Public License along with this program."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole texts of short licences, and the notices that long ones ask for.
BODIES = {
    "AGPL-3.0": [_GNU.format(name="Affero", version=3)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": [_BSD.format(third="")],
    "BSD-3-Clause": [_BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "GPL-2.0": [_GNU.format(name="", version=2).replace("software: you", "software; you")],
    "GPL-3.0": [_GNU.format(name="", version=3)],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-3.0": [_GNU.format(name="Lesser", version=3)],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."],
}
COSINE, BODY, WORD_BY_WORD, MOSTLY = 0.7, 0.8, 0.999, 0.5
#: Templates of more words are bodies.
LONG = 48
#: Characters of text compared at once; a longer text is compared alone.
GROUP = 1 << 19
LICENCE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
_BRITISH = re.compile(r"(licen)c", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _words(text: str) -> np.ndarray:
    return hashed_words([_spelt(text).lower().encode("utf-8", "surrogatepass")], _NOT_WORD)[0]


def _spelt(text: str) -> str:
    """The American spelling."""
    return _BRITISH.sub(r"\1s", text)


def statements() -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Names, words and least cosines of all templates."""
    kinds = ((TEMPLATES, COSINE), (TEXTS, COSINE), (BODIES, BODY), (EXACT, WORD_BY_WORD))
    rows = sorted({(name, s, least) for table_, least in kinds for name in table_ for s in table_[name]})
    return [n for n, _, _ in rows], [_words(s) for _, s, _ in rows], np.array([x for _, _, x in rows])


class Matcher:
    """Templates of pieces of text by TF-IDF cosine; words of no template weigh as the rarest."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, lines: int):
        self.names, words, self.least = statements()
        self.sizes = np.array([len(w) for w in words])
        idf = np.log((1 + lines) / (1 + np.minimum(counts, lines))) + 1
        self.unknown = float(np.log(1 + lines) + 1)
        self.idf = np.append(idf, 0.0)  # the last, -1, is a word of no template
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []  # of each template its terms and their weights
        for w in words:
            t, n = np.unique(np.searchsorted(terms, w), return_counts=True)
            self.rows.append((t, n * idf[t] / np.linalg.norm(n * idf[t])))
        owner = np.repeat(np.arange(len(words)), [len(t) for t, _ in self.rows])
        flat = np.concatenate([t for t, _ in self.rows])
        order = np.argsort(flat, kind="stable")
        self.first = np.searchsorted(flat[order], np.arange(len(terms) + 1))
        self.of, self.weight = owner[order], np.concatenate([w for _, w in self.rows])[order]

    def weights(self, i: int, numbers: np.ndarray) -> np.ndarray:
        """Weight of each word in template ``i``."""
        t, w = self.rows[i]
        at = np.minimum(np.searchsorted(t, numbers), len(t) - 1)
        return np.where(t[at] == numbers, w[at], 0.0)

    def all_cosines(self, numbers: np.ndarray) -> np.ndarray:
        """Of one stretch with every template: the postings of its words alone are read."""
        t, n = np.unique(numbers[numbers >= 0], return_counts=True)
        v = n * self.idf[t]
        norm = np.sqrt((v**2).sum() + int((numbers < 0).sum()) * self.unknown**2)
        many = self.first[t + 1] - self.first[t]
        at = np.arange(many.sum()) + np.repeat(self.first[t] - np.cumsum(many) + many, many)
        return np.bincount(self.of[at], self.weight[at] * np.repeat(v, many), len(self.rows)) / max(norm, 1e-12)

    def cosines(self, numbers: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of rows of equally many words with the templates ``which``."""
        idf = self.idf[numbers]
        times = (numbers[:, :, None] == numbers[:, None, :]).sum(2)
        norm = np.sqrt((idf**2 * times).sum(1) + self.unknown**2 * (numbers < 0).sum(1))
        dots = np.stack([(self.weights(i, numbers) * idf).sum(1) for i in which.tolist()], 1)
        return dots / np.maximum(norm, 1e-12)[:, None]

    def body_places(self, numbers: np.ndarray, owner: np.ndarray):
        """Windows as long as a body: a bound of the cosine by running sums everywhere, the cosine where it is highest."""
        square = np.concatenate([[0.0], np.cumsum(np.where(numbers < 0, self.unknown**2, self.idf[numbers] ** 2))])
        for i in np.flatnonzero(self.sizes > LONG).tolist():
            size = int(self.sizes[i])
            if len(numbers) < size:
                continue
            dot = np.concatenate([[0.0], np.cumsum(self.weights(i, numbers) * self.idf[numbers])])
            bound = (dot[size:] - dot[:-size]) / np.sqrt(np.maximum(square[size:] - square[:-size], 1e-12))
            a = np.flatnonzero((bound >= self.least[i]) & (owner[: len(bound)] == owner[size - 1 :]))
            for run in np.split(a, np.flatnonzero(np.diff(a) > 1) + 1) if len(a) else []:
                for part in np.array_split(run, -(-len(run) // size)):
                    best = int(part[bound[part].argmax()])
                    cosine = float(self.all_cosines(numbers[best : best + size])[i])
                    if cosine >= self.least[i]:
                        yield best, best + size, cosine, i

    def places(self, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray):
        """``start, end, cosine, template`` of the stretches given, and of all windows as long as a template."""
        weight = np.concatenate([[0.0], np.cumsum(self.idf[numbers])])
        other = np.concatenate([[0], np.cumsum(numbers < 0)])

        def near(a, z):  # what can reach COSINE; the square of a sum is no less than the sum of squares
            known = weight[z] - weight[a]
            return (known > 0) & (known**2 * (1 - COSINE**2) >= (COSINE * self.unknown) ** 2 * (other[z] - other[a]) * (1 - 1e-9))

        some = near(starts, ends)
        for a, z in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            cosine = self.all_cosines(numbers[a:z])
            yield from ((a, z, float(cosine[i]), i) for i in np.flatnonzero(cosine >= self.least).tolist())
        yield from self.body_places(numbers, owner)
        for size in np.unique(self.sizes[self.sizes <= LONG]).tolist():
            which = np.flatnonzero(self.sizes == size)
            a = np.arange(max(0, len(numbers) - size + 1))
            a = a[owner[a] == owner[a + size - 1]] if len(a) else a
            a = a[near(a, a + size)]
            for part in np.array_split(a, -(-len(a) // 4096)) if len(a) else []:
                cosine = self.cosines(numbers[part[:, None] + np.arange(size)], which)
                for r, c in zip(*(x.tolist() for x in np.nonzero(cosine >= self.least[which])), strict=True):
                    yield int(part[r]), int(part[r]) + size, float(cosine[r, c]), int(which[c])


def _groups(texts: list[str]):
    """Texts in runs of about ``GROUP`` characters, with the place of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    yield first, texts[first:]


def own_licences(files: DataFrame) -> DataFrame:
    """``id, path, licence, score, share``: the best place's licence, and the share of words in such places."""
    spark = files.sparkSession
    terms = np.unique(np.concatenate(statements()[1]))
    rows = files.select("id", "path", F.coalesce("text", F.lit("")).alias("text"))
    shared_terms = spark.sparkContext.broadcast(terms)  # the words of the templates

    def count(batches):
        total, lines = np.zeros(len(terms) + 1, np.int64), 0
        for b in batches:
            for numbers, first in _numbered([line for t in b.column("text").to_pylist() for line in _spelt(t).split("\n")], shared_terms.value):
                total[:-1] += np.bincount(numbers[numbers >= 0], minlength=len(terms))
                lines += len(first) - 1
        total[-1] = lines
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.int64())], names=["term", "n"])

    counts = np.zeros(len(terms) + 1, np.int64)
    for t, n in rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[t] = n
    matcher = spark.sparkContext.broadcast(Matcher(terms, counts[:-1], int(counts[-1])))

    def scan(batches):
        own, known = matcher.value, shared_terms.value
        for b in batches:
            texts = b.column("text").to_pylist()
            best: list[tuple] = [(0.0, 0, [], "", 0.0)] * len(texts)
            share = np.zeros(len(texts))
            for at, group in _groups(texts):
                sentences, line_of, owner_of, lines = [], [], [], 0
                for i, t in enumerate(group):
                    for line in _spelt(t).split("\n"):
                        parts = _SENTENCE.split(line)
                        sentences += parts
                        line_of += [lines] * len(parts)
                        owner_of += [i] * len(parts)
                        lines += 1
                chunks = list(_numbered(sentences, known))
                sizes = np.concatenate([np.diff(first) for _, first in chunks]) if chunks else np.zeros(0, np.int64)
                if not sizes.sum():
                    continue
                numbers = np.concatenate([n for n, _ in chunks])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                owner = np.repeat(np.array(owner_of), sizes)
                begins = np.flatnonzero(np.diff(line_of, prepend=-1))  # of each line the first sentence
                whole = (starts[begins], ends[np.append(begins[1:], len(sizes)) - 1])
                several = np.diff(np.append(begins, len(sizes))) > 1
                files = np.flatnonzero(np.diff(np.array(owner_of), prepend=-1))  # of each text the first sentence
                starts, ends = np.concatenate([starts, whole[0][several], starts[files]]), np.concatenate([ends, whole[1][several], ends[np.append(files[1:], len(sizes)) - 1]])
                covered = np.zeros(len(numbers), bool)
                for a, z, cosine, template in own.places(numbers, starts, ends, owner):
                    covered[a:z] = True
                    i, name = at + int(owner[a]), own.names[template]
                    best[i] = max(best[i], (round(cosine, 9), int(own.sizes[template]), [-ord(c) for c in name], name, cosine))
                words = np.bincount(owner, minlength=len(group))
                share[at : at + len(group)] = np.bincount(owner[covered], minlength=len(group)) / np.maximum(words, 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), pa.array([x[3] or None for x in best], pa.string()), pa.array([x[4] for x in best], pa.float64()), pa.array(share)], names=["id", "path", "licence", "score", "share"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(scan, f"id {kinds['id']}, path {kinds['path']}, licence string, score double, share double")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), depth), lambda i: F.array_join(F.slice(parts, 1, depth - i), "/"))


def inherited(own: DataFrame) -> DataFrame:
    """``id, path, licence, score, origin, directory`` of every file."""
    is_file = (F.col("share") >= MOSTLY) | F.col("path").rlike(LICENCE_NAME)
    own = written(own.withColumn("dir", F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")).withColumn("is_file", is_file & F.col("licence").isNotNull()), "licences")
    # of each directory the best licence file; partial sums keep a directory of any size cheap
    said = own.filter("is_file").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("above", F.col("b.licence").alias("given"))
    dirs = own.select("dir").filter("dir IS NOT NULL").distinct()
    up = dirs.select("dir", F.posexplode(F.concat(F.array("dir"), F.filter(ancestors(F.col("dir")), lambda a: a != F.col("dir")))).alias("steps", "above"))
    nearest = up.join(said, "above").groupBy("dir").agg(F.min(F.struct("steps", "above", "given")).alias("b")).select("dir", F.col("b.above").alias("directory"), F.col("b.given").alias("given"))
    out = own.join(written(nearest, "directories"), "dir", "left")
    origin = F.when(F.col("is_file"), "licence_file").when(F.col("licence").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", F.coalesce("licence", "given").alias("licence"), "score", origin.alias("origin"), F.when(origin == "inherited", F.col("directory")).alias("directory"))


def licences(files: DataFrame) -> DataFrame:
    """Licence of every row of ``files(id, path, text)``."""
    return inherited(own_licences(files))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, then blocks of a hundred ids."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences(d.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")
