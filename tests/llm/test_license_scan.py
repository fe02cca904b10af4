import math
import re
from collections import Counter

import pytest
from quillspark.llm import license_scan as L


def brute(files):
    """(file, own, licence, origin, directory) in plain Python, over all lines."""
    idf, vectors = L.weights()
    rare = math.log(1 + len(L.TEMPLATES))
    own = {}
    for f, path, text in files:
        low = (text or "").lower()
        units = [u for u in low.split("\n") + re.split(L.BLANK, low) if not re.search(L.DENIED, u)] + ([low] if path and re.search(L.LICENSE_NAME, path) else [])
        best = None
        for u in units:
            if not set(re.findall(L.TERM, u)) & set(L.naming(idf)):
                continue
            c = Counter(t for t in re.findall(L.TERM, u))
            w = {t: (1 + math.log(n)) * idf.get(t, rare) for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for k, v in enumerate(vectors):
                s = round(sum(w.get(t, 0) * x for t, x in v.items()) / norm, 9) if norm else 0
                if s >= L.THRESHOLD and (best is None or (s, -k) > best[:2]):
                    best = (s, -k, L.TEMPLATES[k][0])
        own[f] = best
    held = {}
    for f, path, _ in files:
        if path and own[f] and re.search(L.LICENSE_NAME, path):
            d = path.rpartition("/")[0]
            held[d] = max(held.get(d, ((-1, 0), "")), ((own[f][0], -f), own[f][2]))
    out = []
    for f, path, _ in files:
        mine, license_, origin, where = own[f] and own[f][2], None, "none", None
        if mine:
            license_, origin = mine, "own"
        elif path is not None:
            d = path.rpartition("/")[0]
            while True:
                if d in held:
                    license_, origin, where = held[d][1], "inherited", d
                    break
                if not d:
                    break
                d = d.rpartition("/")[0]
        out.append((f, mine, license_, origin, where))
    return sorted(out)


FILES = [
    (1, "LICENSE", "Released under the MIT License."),
    (2, "a/b/c/x.py", "# nothing\ncode"),
    (3, "a/b/LICENSE.txt", "Some words\n\n" + L._GNU.format(kind=L._GPL, n=3).replace(" you ", "\nyou ")),
    (4, "a/b/y.py", "// Licensed under the Apache License, Version 2.0.\nint x;"),
    (5, "a/COPYING", "not a licence at all"),
    (6, "a/z.txt", None),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, None, ""),
    (9, "a/b/NOTICE", "LICENSED under the apache license version 2.0"),
    (10, "q/r", "the license of the version under which any software is permitted"),
    (11, "a/b/d/e/f/g.c", "x" * 3000),
]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*f, 1.0) for f in FILES], "_file long, path string, text string, score double")
    got = sorted((r._file, r.own_license, r.license, r.origin, r.license_dir) for r in L.scan(df).collect())
    assert got == brute(FILES)
    by = {g[0]: g for g in got}
    assert by[3][1] == "GPL-3.0" and by[4][1] == "Apache-2.0" and by[2][3:] == ("inherited", "a/b") and by[6][2:] == ("MIT", "inherited", "") and by[7][3] == "own"


def test_bound_refuses_no_unit_that_reaches(spark):
    """Each template, cut and mixed with other words: whatever reaches the threshold passes the bound."""
    import random

    rnd, (idf, vectors), rare, rows = random.Random(1), L.weights(), math.log(1 + len(L.TEMPLATES)), []
    for _, text in L.TEMPLATES:
        terms = re.findall(L.TERM, text.lower())
        for _ in range(6):
            mixed = [t for t in terms if rnd.random() < 0.8] + rnd.choices(["zzz", "the", "of", "qq7", *terms[:3]], k=rnd.randrange(len(terms)))
            c = Counter(mixed)
            w = {t: (1 + math.log(n)) * idf.get(t, rare) for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            best = max(sum(w.get(t, 0) * x for t, x in v.items()) / norm for v in vectors) if norm else 0.0
            rows.append((mixed, best))
    rows += [([f"w{i}" for i in range(n)] + ["license", "the", "the"], 0.0) for n in (9, 40)]
    df = spark.createDataFrame(rows, "terms array<string>, best double")
    got = df.select("best", L._may_reach(df.terms, idf, vectors, rare, L.THRESHOLD).alias("may")).collect()
    assert all(r.may for r in got if r.best >= L.THRESHOLD) and any(r.best >= L.THRESHOLD for r in got) and not all(r.may for r in got)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "_file long, path string, text string")
    assert L.scan(empty).count() == 0
    twice = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "LICENSE", "Licensed under CC BY-NC 4.0."), (3, "k", "")], "_file long, path string, text string")
    assert {r._file: r.license for r in L.scan(twice).collect()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "MIT"}


@pytest.mark.parametrize("path,want", [("a/b/c.txt", ["a/b", "a", ""]), ("c.txt", [""]), ("/r/x", ["/r", "", ""])])
def test_ancestors(spark, path, want):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(L.ancestors(L.directory(df.path)).alias("a")).first().a == want


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame(FILES, "_file long, path string, text string")
    own = L.detected(df.withColumn("_key", df._file))
    for out in (own, L.scan(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
import x"""


def test_notices_in_the_wild(spark):
    gpl2, lgpl = GPL_HEADER.replace("version 3", "version 2"), GPL_HEADER.replace("GNU General", "GNU Lesser General")
    mit = f"MIT License\n\nCopyright (c) 2020 Some One\n\n{L._MIT}\n\n{L._MIT_REST}\n"
    bsd2, bsd3 = f"Copyright 2021, X\n\n{L._BSD}\n\n{L._BSD_REST}", f"Copyright 2021, X\n\n{L._BSD}\n\n{L._BSD_THIRD}\n\n{L._BSD_REST}"
    texts = [
        ("a/x.py", GPL_HEADER, "GPL-3.0"), ("a/y.py", gpl2, "GPL-2.0"), ("a/z.py", lgpl, "LGPL-3.0"), ("b/x", "Not licensed under the MIT License.", None), ("b/y", "// SPDX-License-Identifier: MIT", "MIT"),
        ("b/z", "SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("b/w", "SPDX-License-Identifier: Zlib", None), ("c/LICENSE", mit, "MIT"), ("d/LICENSE", bsd2, "BSD-2-Clause"), ("e/LICENSE", bsd3, "BSD-3-Clause"),
        ("f/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "GPL-3.0"), ("g/q", "you may not use all of it, for the license is not of the kind that lets you", None),
    ]
    files = [(i, p, t) for i, (p, t, _) in enumerate(texts)]
    df = spark.createDataFrame(files, "_file long, path string, text string")
    got = sorted((r._file, r.own_license, r.license, r.origin, r.license_dir) for r in L.scan(df).collect())
    assert [g[1] for g in got] == [want for *_, want in texts]
    assert got == brute(files)


def test_rows_that_share_a_number(spark):
    rows = [(1, "x", "Released under the MIT License."), (1, "y", "Licensed under CC BY-NC 4.0."), (1, "x", "Released under the MIT License."), (2, "z", "word " * 20000 + "license")]
    got = sorted((r._file, r.path, r.own_license) for r in L.scan(spark.createDataFrame(rows, "_file long, path string, text string")).collect())
    assert got == [(1, "x", "MIT"), (1, "x", "MIT"), (1, "y", "CC-BY-NC-4.0"), (2, "z", None)]
