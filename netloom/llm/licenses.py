"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

DataFrame expressions only.  A header is a sentence or line with a cue word.  Its vector has a weight for each distinct
token, the token's inverse document frequency over the templates (a token of no template has the largest), so term
frequency is binary.  The template of the largest cosine names the header, from min_header up; at equal cosines the
first by name.  A document's own licence is that of its best header.

A licence file is a document that lies within min_file of a whole licence text (MIT, ISC and BSD so far) by TF-IDF with
term frequencies, which then names its licence, one with a named header whose whole text lies within min_file of a template, or with a named
header and a file name such as LICENSE.  A document without an own licence takes that of the licence file in the
nearest directory at or above its own; of several there, the one of the least path.

Null texts have no header; null paths lie in no directory.  Rows are kept one by one, repeated ones too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep

CUES = "(?i)licen[sc]|copyright|spdx|redistribut|permission is hereby|public domain|all rights reserved"
NAMES = "(?i)(^|/)(licen[sc]e|copying|notice)([.][a-z]+)?$"
TOKEN = "[^a-z0-9.]+|[.](?![0-9])"

# Usual notices of common licences.
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", GNU.format("Affero ", 3)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", GNU.format("", 2)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", GNU.format("", 3)],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", ISC],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", GNU.format("Lesser ", 3)],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", MIT],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}

# Whole texts of short licences.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
FILES = {
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "ISC": ISC + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": MIT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}


def tokens(text: str) -> set[str]:
    return {t for t in re.split(TOKEN, text.lower()) if t}


def weights() -> tuple[dict[str, float], float]:
    """The inverse document frequency of each template token, and that of any other token."""
    vectors = [tokens(t) for texts in TEMPLATES.values() for t in texts]
    df: dict[str, int] = {}
    for v in vectors:
        for t in v:
            df[t] = df.get(t, 0) + 1
    n = len(vectors)
    return {t: math.log((n + 1) / (k + 1)) + 1 for t, k in sorted(df.items())}, math.log(n + 1) + 1


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), TOKEN, -1), lambda t: t != ""))


def _vectors(idf: dict[str, float]) -> list[tuple[str, list[str], float]]:
    return [(name, sorted(v), math.sqrt(sum(idf[t] ** 2 for t in v))) for name in sorted(TEMPLATES) for v in map(tokens, TEMPLATES[name])]


def best_template(text: Column) -> Column:
    """struct(score, name) of the template nearest to text, by cosine."""
    idf, other = weights()
    table = F.create_map(*[F.lit(x) for t, w in idf.items() for x in (t, w * w)])
    templates = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("tokens"), F.lit(norm).alias("norm")) for name, own, norm in _vectors(idf)])

    def squares(of: Column) -> Column:
        return F.aggregate(F.transform(of, lambda t: F.coalesce(table[t], F.lit(other * other))), F.lit(0.0), lambda s, x: s + x)

    def scored(own: Column) -> Column:
        norm = F.sqrt(squares(own))
        found = F.transform(templates, lambda t: F.struct(F.round(squares(F.array_intersect(own, t["tokens"])) / (norm * t["norm"]), 9).alias("score"), t["name"].alias("name")))
        first = lambda a, b: F.when((a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["name"] <= b["name"])), a).otherwise(b)
        return F.aggregate(found, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("name")), first)

    return F.transform(F.array(_tokens(text)), lambda own: F.when(F.size(own) > 0, scored(own)))[0]


def best_file(text: Column) -> Column:
    """struct(score, name) of the whole licence text nearest to text, by cosine of term frequencies times idf."""
    counts = {name: Counter(t for t in re.split(TOKEN, FILES[name].lower()) if t) for name in sorted(FILES)}
    df = Counter(t for c in counts.values() for t in c)
    idf, other = {t: math.log((len(counts) + 1) / (k + 1)) + 1 for t, k in sorted(df.items())}, math.log(len(counts) + 1) + 1
    lookup = lambda values: F.create_map(*[F.lit(x) for t, w in values.items() for x in (t, float(w))])
    squares = lookup({t: w * w for t, w in idf.items()})
    words = F.array_sort(F.filter(F.split(F.lower(text), TOKEN, -1), lambda t: t != ""))

    def longer(s: Column, t: Column) -> Column:  # a term's n-th occurrence adds n^2 - (n - 1)^2 squares
        n = F.when(s["last"] == t, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), n.alias("n"), (s["sum"] + (2 * n - 1) * F.coalesce(squares[t], F.lit(other * other))).alias("sum"))

    def total(own: Column, weight: Column) -> Column:
        return F.aggregate(F.transform(own, lambda t: F.coalesce(weight[t], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def scored(own: Column) -> Column:
        norm = F.sqrt(F.aggregate(own, F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("sum")), longer)["sum"])
        found = []
        for name, c in counts.items():
            length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
            weight = lookup({t: n * idf[t] ** 2 for t, n in sorted(c.items())})
            dot = total(own, weight)
            found.append(F.struct(F.round(dot / (norm * length), 9).alias("score"), F.lit(name).alias("name")))
        return F.aggregate(F.array(*found), F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("name")), lambda a, b: F.when(a["score"] >= b["score"], a).otherwise(b))

    return F.transform(F.array(words), lambda own: F.when(F.size(own) > 0, scored(own)))[0]


def _better(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["name"] < a["name"])), b).otherwise(a)


def scan(docs: DataFrame, min_header: float = 0.6, min_file: float = 0.5) -> DataFrame:
    """doc_id, path, header, header_score, license, origin ("header", "inherited", "none") and inherited_from.

    docs has doc_id, text and path; directories are parted by "/".
    """
    text, path = F.col("text"), F.col("path").cast("string")
    units = F.filter(F.split(text, "\\n|(?<=[.!?])[ \\t]+", -1), lambda s: s.rlike(CUES))
    best = F.when(text.rlike(CUES), F.filter(F.transform(units, best_template), lambda x: x.isNotNull()))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), text.cast("string").alias("text")).withColumn("_best", best)
    none = F.lit(None).cast("struct<score:double,name:string>")
    two = one.withColumn("_best", F.aggregate("_best", none, _better)).withColumn("_file", F.when(text.rlike(CUES), best_file(text)))
    # a whole licence text names its licence, more surely than one of its lines
    two = two.withColumn("_full", F.coalesce(F.col("_file.score") >= min_file, F.lit(False))).withColumn("_best", F.when(F.col("_full"), F.col("_file")).otherwise(F.col("_best")))
    two = two.withColumn("_named", F.col("_full") | F.coalesce(F.col("_best.score") >= min_header, F.lit(False)))
    # the whole text is compared only where a header is named
    whole = F.when(F.col("_named"), best_template(F.col("text")))
    rows = two.withColumn("_whole", whole).select(
        "doc_id",
        "path",
        F.when(F.col("_named"), F.col("_best.name")).alias("header"),
        F.when(F.col("_named"), F.col("_best.score")).alias("header_score"),
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
        F.when(F.col("_named") & (F.col("_full") | (F.col("_whole.score") >= min_file) | F.col("path").rlike(NAMES)), F.col("_best.name")).alias("file_license"),
    )
    rows = keep(rows, "licenses")  # read four times below, and the texts once
    owners = rows.where("file_license is not null and path is not null").groupBy(F.col("dir").alias("above")).agg(F.min(F.struct("path", "file_license")).alias("owner"))
    dirs = rows.where("dir is not null and header is null").select("dir").distinct()
    parts = F.split("dir", "/", -1)
    above = dirs.withColumn("_parts", parts).select("dir", F.explode(F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.size("_parts")))).alias("depth"), "_parts").where("dir <> '' or depth = 0")
    above = above.select("dir", "depth", F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = above.join(owners, "above").groupBy("dir").agg(F.max_by("owner", "depth").alias("owner"))
    out = rows.where("header is null").join(nearest, "dir", "left").select("doc_id", "path", "header", "header_score", F.col("owner.file_license").alias("license"), F.when(F.col("owner").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("owner.path").alias("inherited_from"))
    own = rows.where("header is not null").select("doc_id", "path", "header", "header_score", F.col("header").alias("license"), F.lit("header").alias("origin"), F.lit(None).cast("string").alias("inherited_from"))
    return reduce(DataFrame.unionByName, [own, out])
