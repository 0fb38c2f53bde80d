"""License scan: TF-IDF cosine of headers and license files to templates, and inheritance from the nearest ancestor directory.

Templates are short notices and whole license texts. The passages of a file that are compared with a template are runs of
as many words as the template has, wherever lines break. A passage lies so that one of its telling words stands where the
template has it; telling terms are those without which no passage can reach the threshold, so a passage that reaches it
holds one, and a copy of the template, wrapped or inside a longer line, is always among the passages. Words that no
template has count as if no file had them.

Before passages are made, files are ruled out by the terms that they hold at all: a cosine is at most the length of the
part of the template's vector that the file's words cover.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import materialize

THRESHOLD = 0.75
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, program: str = "This program") -> str:
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


def _cc(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} International License."


#: Notices by which well-known licenses are given, and whole texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("CC-BY-4.0", _cc("Attribution 4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", _cc("Attribution-NonCommercial 4.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", _cc("Attribution-ShareAlike 4.0")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("LGPL-2.1", _gnu("GNU Lesser General Public License", "2.1", "This library")),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENSE_FILES = r"(?i)^(licen[sc]e|copying|notice)(\.(txt|md|rst))?$"
_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.split(F.lower(text), _SPLIT)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def telling_terms(vector: dict[str, float], threshold: float) -> list[str]:
    """Terms, the heaviest first, such that what remains of the (unit) vector without them is shorter than ``threshold``."""
    out, left = [], 1.0
    for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if math.sqrt(max(left, 0.0)) < threshold - 1e-9:
            break
        out.append(term)
        left -= w * w
    return out


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``files`` (doc_id, path, text): doc_id, path, license, how, score, source_dir, line.

    ``how`` is header (a passage of the file itself), file (the same in a license file), inherited (from the license file
    in the nearest ancestor directory, its own directory included, named in ``source_dir``) or null with a null license.
    A file's own license is the template of its best passage at ``threshold`` or more; ties go to the longer template, then
    to the name first in order, then to the first line. ``line`` is where the passage begins. Of several license files in a
    directory the best score counts, then name and path. Null text is empty; a null path inherits nothing. Repeated rows
    come out as often as they come in; more columns are ignored; an empty table gives an empty result.
    """
    said = [_words(t) for _, t in templates]
    known = sorted(set().union(*said))
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = files.select(F.array_intersect(words(text), F.lit(known)).alias("t"))
    found = seen.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # known terms at most
    total = files.count()
    df = {r["term"]: r["df"] for r in found}
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in known}
    unknown = math.log(1 + total) + 1
    vectors = []
    for terms in said:
        v = {w: n * idf[w] for w, n in Counter(terms).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    telling = [telling_terms(v, threshold) for v in vectors]

    def by_template(rows: list[dict]) -> Column:
        return F.create_map(*[x for i, v in enumerate(rows) for x in (F.lit(i), F.create_map(*[F.lit(y) for kv in v.items() for y in kv]))])

    # Squares of the weights as whole numbers, so that sums don't depend on their order.
    squares = by_template([{t: round(x * x * 1e9) for t, x in v.items()} for v in vectors])
    least = math.floor(threshold * threshold * 1e9) - max(map(len, vectors))

    def covered(own: Column, square: Column) -> Column:
        """Whether the template's terms among ``own`` reach the threshold."""
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, t: s + F.coalesce(square[t], F.lit(0))) >= least

    own = F.array_intersect(words(text), F.lit(known))
    base = files.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "text", own.alias("own"))
    some = F.arrays_overlap("own", F.lit(sorted({w for ts in telling for w in ts})))
    every = F.sequence(F.lit(0), F.lit(len(templates) - 1))
    tries = F.when(some, F.filter(every, lambda i: covered(F.col("own"), squares[i]))).otherwise(F.array().cast("array<int>"))
    base = base.select("row", "doc_id", "path", tries.alias("tries"), "text")
    line = lambda l, i: F.transform(F.filter(words(l), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("line")))
    spread = F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line))
    # Only files that may hold a template keep their words.
    base = materialize(base.select("row", "doc_id", "path", "tries", F.when(F.size("tries") > 0, spread).alias("words")))
    spark = files.sparkSession
    # Templates are a parameter: some hundred rows.
    anchors = by_template([{t: said[i].index(t) for t in ts} for i, ts in enumerate(telling)])
    sizes = F.array(*[F.lit(len(ts)) for ts in said])
    cand = base.where(F.size("tries") > 0).select("row", "words", F.explode("tries").alias("id"))
    cand = cand.withColumn("at", anchors[F.col("id")]).withColumn("size", sizes[F.col("id")])
    starts = F.transform("words", lambda w, k: F.when(F.map_contains_key("at", w["w"]), F.greatest(k - F.col("at")[w["w"]], F.lit(0))))
    cand = cand.withColumn("start", F.explode(F.array_distinct(F.array_compact(starts))))
    window = F.slice("words", F.col("start") + 1, F.col("size"))
    windows = cand.select("row", "id", window.alias("p")).select("row", "id", F.get("p.line", F.lit(0)).alias("line"), F.col("p.w").alias("p"))
    enough = covered(F.array_distinct("p"), squares[F.col("id")])
    windows = materialize(windows.where(enough).distinct().withColumn("window", F.monotonically_increasing_id()))
    weights = F.array(
        *[F.struct(F.lit(i).alias("id"), F.lit(w).alias("term"), F.lit(x).alias("t")) for i, v in enumerate(vectors) for w, x in v.items()]
    )
    table = spark.range(1).select(F.explode(weights).alias("w")).select("w.*")
    idfs = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]))).toDF("term", "idf")
    tf = windows.select("window", "id", F.explode("p").alias("term")).groupBy("window", "id", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(idfs), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    scored = weighed.join(F.broadcast(table), ["id", "term"], "left").groupBy("window").agg(
        (F.sum(F.col("x") * F.coalesce("t", F.lit(0.0))) / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("score")
    )
    scored = materialize(scored.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold))
    names = F.array(*[F.lit(n) for n, _ in templates])
    best = F.min(F.struct((-F.col("score")).alias("s"), (-sizes[F.col("id")]).alias("n"), names[F.col("id")].alias("license"), "line"))
    own = windows.select("window", "row", "id", "line").join(scored, "window").groupBy("row").agg(best.alias("b"))
    own = own.select("row", F.col("b.license").alias("own"), (-F.col("b.s")).alias("score"), F.col("b.line").alias("line"))
    return inherit(materialize(base.select("row", "doc_id", "path").join(own, "row", "left")))


def inherit(files: DataFrame) -> DataFrame:
    """The second half of ``scan``: ``files`` (doc_id, path, own, score, line) with licenses from ancestor directories.

    Directories, not files, look for their ancestors: a directory with very many files is looked up once. A file with a null
    path inherits nothing; repeated rows come out as often as they come in; an empty table gives an empty result.
    """
    name = F.regexp_extract("path", r"[^/]*$", 0)
    at = F.regexp_replace("path", r"/?[^/]*$", "")
    f = files.withColumn("dir", at).withColumn("is_file", F.coalesce(name.rlike(LICENSE_FILES), F.lit(False)))
    given = f.where("is_file and own is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("license"), "path")).alias("g")
    )
    given = materialize(given.select("dir", F.col("g.license").alias("license"), (-F.col("g.s")).alias("dir_score")))
    dirs = f.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    ancestors = ancestors.withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    ancestors = ancestors.where("up <> '' or depth = 0")
    up = ancestors.join(given.withColumnRenamed("dir", "up"), "up")
    nearest = up.groupBy("dir").agg(F.max(F.struct("depth", "up", "license", "dir_score")).alias("n"))
    nearest = materialize(nearest.select("dir", "n.up", "n.license", "n.dir_score"))
    out = f.join(nearest, "dir", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own", "license").alias("license"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("license").isNotNull(), "inherited").alias("how"),
        F.coalesce("score", "dir_score").alias("score"),
        F.when(~has, F.col("up")).alias("source_dir"),
        "line",
    )


def tree_paths(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) as files of a source tree: doc_id, path, text.

    Ids that divide by 1000 are the license file of a project, those that divide by 100 that of a directory in it. doc_id must
    be a whole number; a null one gives a null path, a null source counts as none. Every row comes out as it comes in, with
    its text, null or not; an empty table gives an empty result; more columns are left out.
    """
    i = F.col("doc_id")
    project = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("p"), F.floor(i / 1000).cast("string")))
    sub = F.concat(F.lit("d"), (F.floor(i / 100) % 10).cast("string"))
    path = (
        F.when(i % 1000 == 0, F.concat_ws("/", project, F.lit("LICENSE")))
        .when(i % 100 == 0, F.concat_ws("/", project, sub, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", project, sub, F.concat(F.lit("f"), i.cast("string"), F.lit(".txt"))))
    )
    return docs.select("doc_id", F.when(i.isNotNull(), path).alias("path"), "text")
