"""License scans: sparse TF-IDF cosine of headers and licence files to licence texts and usual statements, and inheritance by directory.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridbrook.llm.shared import save

#: Statements by which files name their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Names by which licences are called in titles and statements.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "MIT": ["MIT License"], "ISC": ["ISC License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"], "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International", "CC BY 4.0"], "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"], "CC0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0"],
}
TEMPLATES += [(k, t.format(n)) for k, names in NAMES.items() for n in names for t in ("{}", "Licensed under the {}.", "Released under the {}.", "This work is licensed under a {} License.", "Distributed under the terms of the {}.")]
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
#: Grants and standard headers.
TEMPLATES += [
    ("MIT", _GRANT), ("MIT", f"{_GRANT} {_NOTICE} {_AS_IS}"), ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"), ("BSD-3-Clause", f"{_BSD} {_THIRD} {_BSD_AS_IS}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((k, f"This program {t}".format(*v)) for k, v in {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3")}.items() for t in (_GNU, f"{_GNU} {_GNU_REST}")),
]
#: Whole texts of licence files.
TEMPLATES += sorted((p.stem, p.read_text(encoding="utf-8")) for p in (Path(__file__).parent / "licence_texts").glob("*.txt"))
#: Comment marks at the start of a line, and what ends a paragraph.
MARK = r"(?m)^[^\S\n]*(?:/?\*+/?|//+|#+|;+|--+|!+|%+|<!--|\"{3})?[^\S\n]*"
PARAGRAPHS, SENTENCES = r"\n(?:[^\S\n]*\n)+", r"(?<=[.!?;])\s+(?=\p{Lu})"
WORD = r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)"
SPDX = r"(?i:SPDX-License-Identifier):[^\S\n]*\(?([A-Za-z0-9.+-]+(?:[^\S\n]+(?:AND|OR|WITH)[^\S\n]+[A-Za-z0-9.+-]+)*)"
FILE_NAME = r"(?i)(?:^|/)(?:(?:un)?licen[cs]es?|copying)(?:[._-][^/]*)?$"
LEAST = 0.8
#: Directories with a licence that are broadcast (some 100 bytes each); more are joined by a shuffle.
MOST_DIRS = 100_000
OUT = ["doc_id", "path", "licence", "score", "found_in"]


def _tokens(c):
    return F.filter(F.split(F.lower(c), WORD), lambda x: x != "")


def _pieces(c):
    """The whole text, its leading block of comment lines, its paragraphs, their lines and their sentences, as (whole, text)."""
    plain = F.regexp_replace(c, MARK, "")
    header = F.regexp_replace(F.regexp_extract(c, r"^(?:[^\S\n]*(?:/?\*|//|#|;|--|!|%)[^\n]*(?:\n|$))+", 0), MARK, "")
    parts = F.split(plain, PARAGRAPHS)
    sentences = F.flatten(F.transform(parts, lambda x: F.split(F.regexp_replace(x, r"\n", " "), SENTENCES)))
    every = F.concat(F.array(header), parts, F.split(plain, r"\n"), sentences, F.split(plain, r"\n|" + SENTENCES))
    return F.concat(F.array(F.struct(F.lit(True).alias("whole"), plain.alias("t"))), F.transform(F.array_distinct(every), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t"))))


def _heavy(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Words of which a piece must hold one to have a cosine of ``least`` with any vector.

    A piece that shares words of a part m of a vector's squared length has a cosine of at most sqrt(m); without the
    heaviest words that make up more than 1 - least^2, it stays below ``least``.
    """
    out: set[str] = set()
    for v in vectors:
        part, whole = 0.0, sum(x * x for x in v.values())
        for t, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
            out.add(t)
            part += x * x / whole
            if part > 1 - least * least + 1e-5:
                break
    return sorted(out)


def scan(docs: DataFrame, path, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, path, licence, score (6 decimals) and found_in: header, file, directory or null, for every row.

    ``path`` is a column of slash-separated paths.  The whole text, its leading comment block and every paragraph, line
    and sentence of it are compared with every template: cosine of TF-IDF vectors (1 + ln tf; idf over all documents for
    the templates' words and the largest idf for others).  Only pieces that cannot reach ``least`` are left out before
    scoring.  The best piece of at least ``least`` gives the row's licence, ties to the smaller name; an SPDX tag counts
    as 1 and gives its own expression.  A row is a licence file if its whole text is near a template or its name is
    that of a licence file and a piece is.  Rows without a licence inherit from
    the licence file of the nearest ancestor directory (its best score, then smallest name).  Null and empty texts
    have no piece; null paths inherit nothing; repeated rows are repeated; no rows give no rows; other columns
    are ignored.  The templates' words are put into the plan: their number is bounded by the list.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("text").alias("__text"))
    texts = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "k int, licence string, template string")
    split = [(r.k, r.licence, Counter(r.w)) for r in texts.select("k", "licence", _tokens(F.col("template")).alias("w")).collect()]
    vocab = sorted({t for _, _, c in split for t in c})
    known = F.split(F.lit(" ".join(vocab)), " ")
    seen = own.select(F.array_intersect(_tokens(F.coalesce("__text", F.lit(""))), known).alias("w"))
    # a null stands for the document itself, so one pass counts documents and words
    df = dict(seen.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("w")).groupBy("w").count().collect())
    n = df.get(None, 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocab}
    rare = math.log(1 + n) + 1
    weights = spark.createDataFrame([(t, v) for t, v in idf.items()], "term string, idf double")
    raw = [{t: (1 + math.log(f)) * idf[t] for t, f in c.items()} for _, _, c in split]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in raw]
    vectors = spark.createDataFrame([(k, licence, t, x * idf[t] / norm) for (k, licence, _), v, norm in zip(split, raw, norms) for t, x in v.items()], "k int, licence string, term string, x double")
    heavy = F.split(F.lit(" ".join(_heavy(raw, least))), " ")

    rows = own.withColumn("row", F.monotonically_increasing_id()).where(F.arrays_overlap(_tokens(F.col("__text")), heavy) | F.col("__text").rlike(SPDX))
    rows = rows.select("row", "doc_id", "path", F.nullif(F.regexp_extract("__text", SPDX, 1), F.lit("")).alias("spdx"), F.posexplode(_pieces(F.col("__text"))).alias("at", "p"))
    rows = rows.select("row", "doc_id", "path", "at", "spdx", F.col("p.whole").alias("whole"), _tokens(F.col("p.t")).alias("w"))
    lines = save(rows.where(F.arrays_overlap("w", heavy) | ((F.col("at") == 0) & F.col("spdx").isNotNull())), "pieces")
    one = lines.select("row", "at", F.explode("w").alias("term")).groupBy("row", "at", "term").agg((F.ln(F.count(F.lit(1))) + 1).alias("tf"))
    told = one.join(F.broadcast(weights), "term", "left")
    size = told.groupBy("row", "at").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(rare)), 2))).alias("norm"))
    dots = one.join(F.broadcast(vectors), "term").groupBy("row", "at", "k", "licence").agg(F.sum(F.col("tf") * F.col("x")).alias("dot"))
    near = dots.join(size, ["row", "at"]).select("row", (F.col("at") == 0).alias("whole"), "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    id_of = F.regexp_replace("spdx", r"-(?:only|or-later)\b", "")
    tags = lines.where("spdx is not null and at = 0").select("row", F.lit(False).alias("whole"), id_of.alias("licence"), F.lit(1.0).alias("score"))
    best = near.unionByName(tags).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"), F.max("whole").alias("whole"), F.min(F.when(F.col("whole"), F.struct((-F.col("score")).alias("s"), "licence"))).alias("f"))
    heads = lines.select("row", "doc_id", "path").distinct().join(best, "row").withColumn("b", F.coalesce("f", "b"))
    named_so = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    found = save(heads.select("doc_id", "path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), (F.col("whole") | named_so).alias("file")), "licences")

    up = "regexp_replace(path, '/?[^/]*$', '')"
    files = found.where("file and path is not null").select(F.expr(up).alias("above"), "licence", "score").groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("a"))
    plain = own.select("doc_id", "path")
    named = found.select("doc_id", F.col("path").alias("p"), "licence", "score", "file").groupBy("doc_id", "p").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence", "file")).alias("b"))
    marked = save(plain.join(named, plain["doc_id"].eqNullSafe(named["doc_id"]) & plain["path"].eqNullSafe(named["p"]), "left").select(plain["doc_id"], plain["path"], "b"), "marked")
    # directories, not rows, look for their nearest ancestor
    dirs = marked.where("b is null and path is not null").select(F.expr(up).alias("dir")).distinct()
    levels = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))
    reached = dirs.select("dir", F.explode(F.array_distinct(levels)).alias("above")).join(files, "above")
    given = save(reached.groupBy("dir").agg(F.max_by("a", F.length("above")).alias("a")), "given")
    few = given.limit(MOST_DIRS + 1).count() <= MOST_DIRS
    # only rows that may inherit are joined, so that those with a licence or without a path don't meet in one task
    heirs = marked.where("b is null and path is not null").withColumn("dir", F.expr(up)).join(F.broadcast(given) if few else given, "dir", "left").drop("dir")
    rest = marked.where("b is not null or path is null")
    out = heirs.unionByName(rest.withColumn("a", F.lit(None).cast(heirs.schema["a"].dataType)))
    kind = F.when(F.col("b.file"), "file").when(F.col("b").isNotNull(), "header").when(F.col("a").isNotNull(), "directory")
    return out.select("doc_id", "path", F.coalesce("b.licence", "a.licence").alias("licence"), (-F.coalesce("b.s", "a.s")).alias("score"), kind.alias("found_in"))
