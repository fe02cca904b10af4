"""License scans: sparse TF-IDF cosine to licence templates, then inheritance from directories.

DataFrame functions only. A file's units are its lines, its blocks of adjacent lines (lines without a letter or digit part them) and, for licence files, also
the whole text. Terms are weighted by (1 + ln tf) * idf over the templates (a term of no template counts as rarer than all);
a unit has the licence of the template with the largest cosine, if that is at least THRESHOLD, and a file that of its best unit. Lines and blocks that deny a licence
have none. A file without a licence of its own inherits that of the nearest directory above it (its own included) that holds a licensed licence file; of
several in one directory, the one with the largest cosine, then the smallest file number, counts.

A cosine is at most the share of a unit's length that lies on terms of the templates. That share is bounded by the unit's numbers of terms and then summed
within the row, over its sorted terms, so only units that can reach the threshold are taken apart and shuffled. A unit with none of the templates' words but
function words and numbers is no notice.

Null or empty texts have no licence of their own. A null path has no directory. Rows that share a number or a path are separate
files; equal rows give equal results. Extra columns are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.joins import lookup

from .common import staged

THRESHOLD = 0.6
# English function words. They have their weight, but a unit needs another word of a template.
FUNCTION_WORDS = frozenset("a above all an and any are as at be but by can do either even for from has have however if in into is it its may must no nor not of on or other out shall so such than that the their this to under use used was way which whom will with without you your".split())
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What parts blocks: lines without a letter or digit.
BLANK = r"\n(?:[^a-z0-9\n]*\n)+"
LICENSE_NAME = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)(?:[.-][^/]*)?$"

#: A line or block that says what does not hold.
DENIED = r"\b(?:not|never|no longer)\s+(?:been\s+)?(?:licensed|released|distributed|covered|available)\b"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; version {n}."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

# The words of licences, and notices in the words that they recommend or that are in common use.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} {_MIT_REST}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License {_ISC} {_ISC_REST}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_REST}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_REST}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(kind=_GPL, n=3)),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", _GNU.format(kind=_GPL, n=2)),
    ("GPL-2.0", _GNU_ONLY.format(kind=_GPL, n=2)),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-2.1", _GNU.format(kind=_LGPL, n="2.1")),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(kind=_LGPL, n=3)),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(kind=_AGPL, n=3)),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal public domain dedication."),
]
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}") for x in dict.fromkeys(name for name, _ in TEMPLATES)]


def weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[dict[str, float], list[dict[str, float]]]:
    """idf of each term of the templates, and each template's unit-length weights."""
    counts = [Counter(t for t in re.findall(TERM, text.lower())) for _, text in templates]
    frequency = Counter(t for c in counts for t in c)
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + f)) for t, f in frequency.items()}
    out = []
    for c in counts:
        raw = {t: (1 + math.log(k)) * idf[t] for t, k in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({t: v / norm for t, v in raw.items()})
    return idf, out


def naming(idf: dict[str, float]) -> list[str]:
    """The templates' terms that say something about licences: words, but for function words."""
    return sorted(t for t in idf if len(t) > 1 and t[0].isalpha() and t not in FUNCTION_WORDS)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _words(terms) -> Column:
    return F.array(*(F.lit(t) for t in terms))


def _may_reach(terms: Column, idf: dict[str, float], vectors: list[dict[str, float]], rare: float, threshold: float) -> Column:
    """Can a list of terms reach the threshold? From its numbers of distinct terms alone, so cheap; exact for what it refuses.

    The templates' terms are taken in groups of similar idf, function words apart. Of n terms, with u distinct ones of no template and
    m of a group, the group holds at most what the other distinct ones leave; its sum of (1 + ln tf) ** 2 is then largest when all m
    are equally frequent, and m at least. A template has at most a share of its length on function words, so theirs counts by that share.
    """
    share = max(math.sqrt(sum(x * x for t, x in v.items() if t in FUNCTION_WORDS)) for v in vectors)
    groups: list[list[str]] = []
    for names in ([t for t in idf if t not in FUNCTION_WORDS], [t for t in idf if t in FUNCTION_WORDS]):
        names.sort(key=lambda t: (idf[t], t))
        size = -(-len(names) // 4)
        groups += [names[i : i + size] for i in range(0, len(names), size)]

    def enough(found: Column, number: Column, n: Column, u: Column) -> Column:
        low, high = u * F.lit(rare**2), {False: F.lit(0.0), True: F.lit(0.0)}
        for i, g in enumerate(groups):
            most = F.pow(1 + F.log(F.greatest((n - u - number + found[i]) / found[i], F.lit(1.0))), F.lit(2.0))
            kind = g[0] in FUNCTION_WORDS
            high[kind] = high[kind] + F.when(found[i] > 0, found[i] * F.lit(max(idf[t] for t in g) ** 2) * most).otherwise(0.0)
            low = low + found[i] * F.lit(min(idf[t] for t in g) ** 2)
        top = F.sqrt(high[False]) + F.lit(share) * F.sqrt(high[True])
        return (top >= F.lit(threshold * (1 - 1e-9)) * F.sqrt(low)) & (number > 0)

    def counted(distinct: Column, n: Column) -> Column:
        each = F.array(*(F.size(F.array_intersect(distinct, _words(g))).cast("double") for g in groups))
        total = lambda found: sum((found[i] for i in range(len(groups))), F.lit(0.0))
        return _let(each, lambda found: _let(total(found), lambda number: enough(found, number, n, F.size(distinct) - number)))

    return _let(terms, lambda t: _let(F.array_distinct(t), lambda d: counted(d, F.size(t))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lengths(terms: Column, idf: dict[str, float], rare: float) -> Column:
    """(known, all): squared tf-idf lengths of a sorted list of terms, on the templates' terms and on all."""
    by_value: dict[float, list[str]] = {}
    for t, v in idf.items():
        by_value.setdefault(v, []).append(t)

    def square(x: Column, other: float) -> Column:
        out = F.lit(other)
        for v, names in sorted(by_value.items()):
            out = F.when(x.isin(*names), F.lit(v * v)).otherwise(out)
        return F.when(x.isin(*idf), out).otherwise(other)

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1))
        more = F.when(run == 1, F.lit(1.0)).otherwise(F.pow(1 + F.log(run), F.lit(2.0)) - F.pow(1 + F.log(run - 1), F.lit(2.0)))  # what one more of a term adds
        return F.struct(x.alias("last"), run.alias("run"), (a["known"] + more * square(x, 0.0)).alias("known"), (a["other"] + F.when(x.isin(*idf), F.lit(0.0)).otherwise(more)).alias("other"))

    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("known"), F.lit(0.0).alias("other"))
    return F.aggregate(terms, zero, step, lambda a: F.struct(a["known"].alias("known"), (a["known"] + a["other"] * F.lit(rare * rare)).alias("all")))


def _counts(terms: Column) -> Column:
    """The distinct terms of a list and how often it has each."""
    return F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.size(F.filter(terms, lambda x: x == t)).alias("tf")))


def detected(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """_key, license and score of the files (_key, path, text) that have a licence of their own. Rows of one key are equal."""
    spark = files.sparkSession
    idf, vectors = weights(templates)
    rare = math.log(1 + len(templates))
    words = _words(naming(idf))
    near = files.select("_key", "path", F.lower("text").alias("text")).where(F.arrays_overlap(_terms(F.col("text")), words))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("unit"), x.alias("text")))
    blocks = F.transform(F.split("text", BLANK), lambda x, i: F.struct((-2 - i).alias("unit"), x.alias("text")))
    whole = F.when(F.col("path").rlike(LICENSE_NAME), F.array(F.struct(F.lit(-1).alias("unit"), F.col("text"))))
    every = F.concat(lines, F.filter(blocks, lambda x: x["text"].contains("\n")), F.coalesce(whole, F.array().cast("array<struct<unit:int,text:string>>")))
    units = near.select("_key", F.explode(every).alias("u")).select("_key", "u.unit", "u.text")
    units = units.where(F.arrays_overlap(_terms(F.col("text")), words))
    able = units.where(_may_reach(_terms(F.col("text")), idf, vectors, rare, threshold)).where((F.col("unit") == -1) | ~F.col("text").rlike(DENIED))
    sizes = _let(F.sort_array(_terms(F.col("text"))), lambda t: F.struct(t.alias("terms"), _lengths(t, idf, rare).alias("l")))
    measured = able.select("_key", "unit", F.explode(F.array(sizes)).alias("s")).select("_key", "unit", "s.terms", "s.l").where(F.col("l.known") >= threshold**2 * (1 - 1e-9) * F.col("l.all"))
    some = measured.select("_key", "unit", F.col("l.all").alias("square"), _counts(F.filter("terms", lambda t: t.isin(*idf))).alias("terms")).dropDuplicates(["_key", "unit"])
    rows = [(t, k, float(idf[t] * v[t])) for t in sorted(idf) for k, v in enumerate(vectors) if t in v]
    known = spark.createDataFrame(rows, "term string, k int, w double")  # as many rows as the templates have terms
    dots = some.select("_key", "unit", "square", F.explode("terms").alias("t")).select("_key", "unit", "square", "t.term", "t.tf").join(F.broadcast(known), "term")
    scores = dots.groupBy("_key", "unit", "k").agg((F.sum((1 + F.log("tf")) * F.col("w")) / F.sqrt(F.first("square"))).alias("score"))
    best = scores.groupBy("_key").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("k")).alias("first"))).alias("b")).where(F.col("b.score") >= threshold)
    names = F.array(*(F.lit(name) for name, _ in templates))
    return best.select("_key", F.element_at(names, 1 - F.col("b.first")).alias("license"), F.col("b.score").alias("score"))


def directory(path: Column) -> Column:
    """The directory of a path; '' for the top, null for none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(folder: Column) -> Column:
    """The directory itself and those above it, nearest first, down to ''."""
    parts = F.split(folder, "/")
    n = F.size(parts)
    real = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(real, F.array(F.lit(""))))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """_file, path, own_license, own_score, license, origin (own, inherited or none) and license_dir of files (_file, path, text)."""
    files = files.select("_file", "path", "text", F.xxhash64("_file", "path", "text").alias("_key"))
    own = detected(files, templates, threshold)
    named = files.select("_file", "path", "_key").join(own, "_key", "left").drop("_key").withColumn("_dir", directory(F.col("path")))
    named = staged(named, "licences")
    held = named.where(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_NAME))
    held = held.groupBy(F.col("_dir").alias("license_dir")).agg(F.max_by("license", F.struct("score", F.expr("-_file"))).alias("dir_license"))
    # each directory finds its licence once, whatever number of files it has
    folders = named.where("_dir is not null").select("_dir").distinct()
    steps = folders.select("_dir", F.posexplode(ancestors(F.col("_dir"))).alias("step", "license_dir"))
    # a directory above a third of all others, or one that holds as many files, is dealt over several tasks
    nearest = lookup(steps, held, ["license_dir"]).where("dir_license is not null").groupBy("_dir").agg(F.min(F.struct("step", "license_dir", "dir_license")).alias("near"))
    out = lookup(named, nearest, ["_dir"])
    has, gets = F.col("license").isNotNull(), F.col("near").isNotNull()
    return out.select(
        "_file", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.coalesce("license", "near.dir_license").alias("license"),
        F.when(has, "own").when(gets, "inherited").otherwise("none").alias("origin"), F.when(~has & gets, F.col("near.license_dir")).alias("license_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/thousands/dozens/name. The first of each directory's ids names its licence file."""
    i = F.col("doc_id")
    name = F.when(i % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(i / 4096).cast("string"), F.floor(i / 64).cast("string"), name)
    return docs.select(i.alias("_file"), F.when(i.isNotNull(), path).alias("path"), "text")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, license, origin, license_dir of every document."""
    return scan(document_files(docs)).select(F.col("_file").alias("doc_id"), "path", "own_license", "license", "origin", "license_dir")


def oracle() -> str:
    """The same in DuckDB SQL, from the templates' texts, over all units."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = ", ".join(quote(t) for t in naming(weights()[0]))
    values = ", ".join(f"({k}, {quote(a)}, {quote(b)})" for k, (a, b) in enumerate(TEMPLATES))
    return f"""
WITH templates(k, license, text) AS (VALUES {values}),
tterms AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM templates) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))) AS idf FROM tterms GROUP BY 1),
tw AS (SELECT k, term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ^ 2) OVER (PARTITION BY k)) AS w FROM tterms JOIN idf USING (term)),
files AS (
  SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), cast(floor(doc_id / 4096) AS BIGINT), cast(floor(doc_id / 64) AS BIGINT),
    CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path, lower(text) AS text FROM documents),
parts AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS unit, unnest(string_split(text, chr(10))) AS text FROM files
  UNION ALL SELECT doc_id, -1 - generate_subscripts(regexp_split_to_array(text, '{BLANK}'), 1), unnest(regexp_split_to_array(text, '{BLANK}')) FROM files),
units AS (
  SELECT * FROM (SELECT * FROM parts WHERE NOT regexp_matches(text, '{DENIED}') UNION ALL SELECT doc_id, -1, text FROM files WHERE doc_id % 64 = 0)
  WHERE list_has_any(regexp_extract_all(text, '{TERM}'), [{words}])),
terms AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM units) GROUP BY 1, 2, 3),
v AS (SELECT doc_id, unit, t.term, (1 + ln(tf)) * coalesce(idf, ln(1 + (SELECT count(*) FROM templates))) AS v FROM terms t LEFT JOIN idf USING (term)),
norm AS (SELECT doc_id, unit, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1, 2),
dots AS (SELECT v.doc_id, v.unit, tw.k, sum(v.v * tw.w) AS dot FROM v JOIN tw USING (term) GROUP BY 1, 2, 3),
scores AS (SELECT d.doc_id, d.k, max(dot / norm) AS score FROM dots d JOIN norm n ON d.doc_id = n.doc_id AND d.unit = n.unit GROUP BY 1, 2 HAVING round(max(dot / norm), 9) >= {THRESHOLD}),
own AS (SELECT doc_id, arg_max(k, round(score, 9) * 1e6 - k / 1e5) AS k, max(score) AS score FROM scores GROUP BY 1),
named AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') AS dir, t.license, o.score FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN templates t USING (k)),
held AS (SELECT dir, arg_max(license, round(score, 9) * 1e6 - doc_id / 1e9) AS license FROM named WHERE license IS NOT NULL AND doc_id % 64 = 0 GROUP BY 1),
steps AS (
  SELECT doc_id, 0 AS step, dir AS up FROM named UNION ALL SELECT doc_id, 1, regexp_replace(dir, '/[^/]*$', '') FROM named
  UNION ALL SELECT doc_id, 2, split_part(dir, '/', 1) FROM named),
near AS (SELECT doc_id, arg_min(held.license, step) AS license, arg_min(held.dir, step) AS dir FROM steps JOIN held ON up = held.dir GROUP BY 1)
SELECT n.doc_id, n.path, n.license AS own_license, coalesce(n.license, near.license) AS license,
  CASE WHEN n.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN n.license IS NULL THEN near.dir END AS license_dir
FROM named n LEFT JOIN near USING (doc_id)"""
