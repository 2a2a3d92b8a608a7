"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance from the nearest ancestor directory.

DataFrame functions only. Terms are weighted by tf * (ln((1 + N) / (1 + df)) + 1) with df counted over all documents for the templates'
terms; any other term counts as unseen. A text's segments are its sentences and lines, its blank-line paragraphs and the whole; a
segment's best template, at threshold or more, is what it declares, and of a text's segments the longest that declares something
decides: a whole licence text is told from its relatives as a whole, whatever sentences they share. A segment fits a
template only if it holds the version that the template names, no word of a relative (lesser, affero, nc, nd ..) that the template hasn't and, for
short templates, no `not`. A file that as a whole matches a
template, or is named as a licence and declares one, is a licence file of its directory.

Only segments that can reach the threshold are compared: cos <= sqrt(share of the template's squared weight that the segment's terms
hold). So the commonest terms of a template that together fall short of the threshold are left aside, and a segment needs one of
the others, the template's markers. Markers come from the weights, the templates being a bounded list, and every text is searched
for them in the scan; what follows touches only texts that have one.

Directories are resolved, not files: each directory that occurs meets the licences of its ancestors by an equi-join on the ancestor's
path and takes the longest; then files without a header meet their directory's answer, by keys alone: a directory with more than
HOT files, and more than one in HOT of all, is salted, and there are at most HOT such. Texts cross the network once, by a key of their own.

Cases: null or empty text declares nothing; null paths have no directory and inherit nothing; rows that share an id are judged one by
one; rows equal in id, path and text (128 bits of hashes) declare the same; ties go to the template that sorts first, and among a
directory's licence files to those named as one, then the higher score, then the smaller path. An input column named license_scan is
replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

TERM = r"[a-z0-9]+(?:[.][0-9]+)*"
#: A file name that is a licence's whatever its text.
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"
#: Public notices and licence texts, as (licence, template).
TEXTS = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: Families of licences, as (identifier, name, versions, how notices speak of them).
_FREE = "This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_GNU = ["licensed under the {name}, version {v}", "This work is licensed under the {name}, version {v}", "{name} Version {v}", _FREE, _FREE.replace("program", "library")]
FAMILIES = [
    ("GPL", "GNU General Public License", ["1", "2", "3"], _GNU),
    ("LGPL", "GNU Lesser General Public License", ["2.1", "3"], _GNU),
    ("LGPL", "GNU Library General Public License", ["2"], _GNU),
    ("AGPL", "GNU Affero General Public License", ["3"], _GNU),
    ("Apache", "Apache License", ["1.0", "1.1", "2.0"], ["Licensed under the {name}, Version {v}", "{name} Version {v}"]),
    ("MPL", "Mozilla Public License", ["1.0", "1.1", "2.0"], ["subject to the terms of the {name}, v. {v}", "licensed under the {name}, version {v}", "{name} Version {v}"]),
    ("EPL", "Eclipse Public License", ["1.0", "2.0"], ["This program and the accompanying materials are made available under the terms of the {name} v{v}", "licensed under the {name}, version {v}", "{name} v {v}"]),
]
_CC = ["This work is licensed under a Creative Commons {name} {v} International License", "This work is licensed under a Creative Commons {name} {v} Unported License", "Licensed under CC {code} {v}"]
CREATIVE_COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
#: Words that tell relatives apart: a template that holds one of the first, but not one of the second, doesn't fit a segment that holds that.
RELATIVES = [({"gnu"}, {"lesser", "affero"}), ({"cc", "creative"}, {"nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"})]
#: A template of at most so many terms doesn't fit a segment that denies it.
SHORT = 25
_VERSION = re.compile(r"(?:version|\bv\.?|[Ll]icense,?|CC0|BY[A-Z-]*|Attribution[A-Za-z-]*) ?v?([0-9]+(?:[.][0-9]+)*)\b", re.I)


def _grid() -> list[tuple[str, str]]:
    """Short notices and titles of every version of every family; a version is written with and without `.0`."""
    out = []
    for short, name, versions, ways in FAMILIES:
        for v in versions:
            for written_as in dict.fromkeys([v, v.removesuffix(".0"), v if "." in v else f"{v}.0"]):
                out += [(f"{short}-{v if '.' in v else v + '.0'}", way.format(name=name, v=written_as)) for way in ways]
    return out + [(f"CC-{code}-{v}", way.format(code=code, name=name, v=v)) for code, name in CREATIVE_COMMONS for v in CC_VERSIONS for way in _CC]


TEMPLATES = TEXTS + _grid()
#: Bound of the templates' terms, which are literals of the plan and one side of broadcast joins.
MAX_TERMS = 5000
#: A directory with more files than this, and with more than one in this many of all, is salted.
HOT = 1000


def terms(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def segments(text):
    """array<struct<kind, body>>: sentences and lines, paragraphs, the whole."""
    text = F.coalesce(text, F.lit(""))
    as_kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("body"))
    return F.concat(
        F.transform(F.split(F.regexp_replace(text, r"([.!?])[ \t]+([A-Z])", "$1\n$2"), "\n"), as_kind("header")),
        F.transform(F.split(text, r"\n[ \t]*\n"), as_kind("header")),
        F.array(F.struct(F.lit("file").alias("kind"), text.alias("body"))),
    )


def telling(text: str) -> tuple[set[str], set[str]]:
    """The terms that a segment must hold to fit a template, its version; and those it must not hold: words of its relatives, and a denial."""
    own = set(re.findall(TERM, text.lower()))
    must = {v for v in _VERSION.findall(text) if v in own}
    never = {w for marks, words in RELATIVES if marks & own for w in words - own}
    return must, never | ({"not"} - own if len(own) <= SHORT else set())


def _weights(templates: list[tuple[str, str]], df: dict[str, int], n: int) -> list[tuple[str, int, str, float, float]]:
    """(licence, template's number, term, weight / norm, idf) of each template's terms."""
    rows = []
    for k, (name, text) in enumerate(templates):
        tf = Counter(re.findall(TERM, text.lower()))
        idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in tf}
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        rows += [(name, k, t, c * idf[t] / norm, idf[t]) for t, c in tf.items()]
    return rows


def markers(weights: list[tuple[str, int, str, float, float]], threshold: float) -> list[str]:
    """Terms of which any segment at the threshold holds one: the others, the commonest of each template, fall short of it together."""
    found = set()
    for k in {w[1] for w in weights}:
        light = 0.0
        for _, _, term, w, _ in sorted((x for x in weights if x[1] == k), key=lambda x: (x[4], x[3], x[2])):
            light += w * w
            if light >= threshold * threshold * (1 - 1e-9):
                found.add(term)
    return sorted(found)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = 0.7) -> DataFrame:
    """files plus license_scan: struct<license, score, origin ('header', 'directory' or null), directory>."""
    spark = files.sparkSession
    templates = templates or TEMPLATES
    vocabulary = sorted({t for _, text in templates for t in re.findall(TERM, text.lower())})
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"templates have more than {MAX_TERMS} terms")
    words = F.array(*[F.lit(t) for t in vocabulary])
    kept = [c for c in files.columns if c != "license_scan"]
    text, path = F.col(f"`{text_col}`"), F.col(f"`{path_col}`")
    # a row per template term; array_intersect also makes a text's terms distinct
    counted = files.select(F.explode(F.concat(F.array_intersect(terms(text), words), F.array(F.lit("")))).alias("t")).groupBy("t").count()
    df = {r["t"]: r["count"] for r in counted.collect()}
    n = df.pop("", 0)
    weights = _weights(templates, df, n)
    marks = F.array(*[F.lit(t) for t in markers(weights, threshold)])
    tells = [telling(text) for _, text in templates]
    fits = [(*w, w[2] in tells[w[1]][0], False, len(tells[w[1]][0])) for w in weights]
    fits += [(name, k, term, 0.0, 0.0, False, True, len(tells[k][0])) for k, (name, _) in enumerate(templates) for term in sorted(tells[k][1])]
    table = F.broadcast(spark.createDataFrame(fits, "license string, template int, term string, weight double, idf double, must boolean, never boolean, need int"))
    idf = F.broadcast(spark.createDataFrame(sorted({(w[2], w[4]) for w in weights}), "term string, idf double"))

    # every row gets a key of its own from what it holds; rows equal in all of it declare the same
    held = F.to_json(F.struct(F.col(f"`{id_col}`").alias("id"), path.alias("p"), text.isNull().alias("none")), {"ignoreNullFields": "false"})
    keyed = files.select(*[F.xxhash64(F.lit(k), held, text).alias(f"k{k}") for k in (1, 2)], path.alias("p"), text.alias("t"))
    parts = (
        keyed.where(F.arrays_overlap(terms(F.col("t")), marks))
        .select("k1", "k2", "p", segments(F.col("t")).alias("s"))
        .select("k1", "k2", "p", F.posexplode("s").alias("at", "s"))
        .select("k1", "k2", "p", "at", "s.kind", terms(F.col("s.body")).alias("w"))
        .where(F.arrays_overlap("w", marks))
        .dropDuplicates(["k1", "k2", "at"])
    )
    segment = ["k1", "k2", "p", "at", "kind", "n_terms"]
    tf = parts.select("k1", "k2", "p", "at", "kind", F.size("w").alias("n_terms"), F.explode("w").alias("term")).groupBy(*segment, "term").count()
    unseen = math.log(1 + n) + 1
    weighed = written(tf.join(idf, "term", "left").select(*segment, "term", (F.col("count") * F.coalesce("idf", F.lit(unseen))).alias("w")), "segments")
    norms = weighed.groupBy("k1", "k2", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(table, "term").groupBy(*segment, "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count_if("must").alias("held"), F.max("never").alias("never"), F.first("need").alias("need"))
    scored = dots.where((F.col("held") == F.col("need")) & ~F.col("never")).join(norms, ["k1", "k2", "at"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("n_terms")).alias("long"), (-F.col("score")).alias("down"), "template", "license"))
    declared = scored.groupBy("k1", "k2", "p").agg(best.alias("b"), F.max(F.col("kind") == "file").alias("whole"))
    declared = written(declared.select("k1", "k2", "p", F.col("b.license").alias("hl"), (-F.col("b.down")).alias("hs"), "whole"), "declared")

    directory = lambda p: F.when(p.contains("/"), F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.when(p.isNotNull(), F.lit("")))
    named = F.col("p").rlike(NAMED)
    own = declared.where(F.col("p").isNotNull() & (F.col("whole") | named)).select(directory(F.col("p")).alias("dir"), F.struct((~named).alias("unnamed"), (-F.col("hs")).alias("down"), "p", "hl", "hs").alias("b"))
    licensed = own.groupBy("dir").agg(F.min("b").alias("b")).select("dir", "b.hl", "b.hs")
    # files per directory; those over the limit are at most HOT rows
    dirs = written(files.select(directory(path).alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("files")), "dirs")
    limit = max(HOT, n // HOT)
    shares = dirs.where(F.col("files") > limit).select("d", F.ceil(F.col("files") / limit).cast("int").alias("parts"))
    steps = F.split("d", "/")
    above = dirs.select("d", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))).alias("dir")).distinct()
    nearest = above.join(licensed, "dir").groupBy("d").agg(F.max(F.struct(F.char_length("dir").alias("depth"), "dir", "hl", "hs")).alias("b")).select("d", F.col("b.dir").alias("from"), F.col("b.hl").alias("dl"), F.col("b.hs").alias("ds"))
    salted = nearest.join(F.broadcast(shares), "d", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    slim = keyed.select("k1", "k2", directory(F.col("p")).alias("d")).where("d is not null").join(F.broadcast(shares), "d", "left").withColumn("salt", F.pmod("k1", F.coalesce("parts", F.lit(1))).cast("int"))
    inherited = slim.join(salted, ["d", "salt"]).groupBy("k1", "k2").agg(F.first(F.struct("from", "dl", "ds")).alias("i"))
    answers = declared.select("k1", "k2", "hl", "hs").join(inherited, ["k1", "k2"], "full")

    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *[F.xxhash64(F.lit(k), held, text).alias(f"k{k}") for k in (1, 2)])
    out = rows.join(answers, ["k1", "k2"], "left")
    found = F.struct(
        F.coalesce("hl", "i.dl").alias("license"),
        F.coalesce("hs", "i.ds").alias("score"),
        F.when(F.col("hl").isNotNull(), "header").when(F.col("i.dl").isNotNull(), "directory").alias("origin"),
        F.when(F.col("hl").isNull(), F.col("i.from")).alias("directory"),
    )
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], found.alias("license_scan"))
