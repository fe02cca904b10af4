"""Hand-made rows with results worked out by hand."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from quillspark.functions import text as T
from quillspark.functions import unicode as U
from quillspark.operators import decide, discover, graph, joins, keys, matching, ranking, reconcile, triage
from quillspark.plans import catalog
from quillspark.sources import files, landed, pages

c, lit = F.col, F.lit


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_identifiers(spark):
    df = spark.createDataFrame([("10.1371/journal.pcbi.1005619",), ("29706581",), ("pmc5640625",), ("Astrocyte waves",), ("https://doi.org/10.1/x",)], "t string")
    got = [(r.k, r.v) for r in df.select(T.identifier_kind(c("t")).alias("k"), T.identifier_value(c("t")).alias("v")).collect()]
    assert got == [("doi", "10.1371/journal.pcbi.1005619"), ("pmid", "29706581"), ("pmcid", "PMC5640625"), ("title", "Astrocyte waves"), ("title", "https://doi.org/10.1/x")]
    lines = spark.createDataFrame([("# c", 0), ("  # c", 1), ("10.1/A", 2), ("", 3), ("10.1/a", 4)], "value string, pos int")
    assert [r.token for r in files.identifier_lines(lines).collect()] == ["10.1/A", "10.1/a"]
    assert sorted((r.pos, r.doi) for r in files.doi_lines(lines).collect()) == [(1, "# c"), (2, "10.1/A")]


def cites(spark):
    rows = [("a", "x"), ("a", "y"), ("a", "z"), ("a", "10.1/b"), ("b", "x"), ("b", "y"), ("b", "z"), ("c", "z"), ("d", "10.1/a"), ("a", "x"), (None, "z"), ("e", None)]
    return spark.createDataFrame(rows, "stem string, cited string")


def test_coupling_and_labels(spark):
    pairs = graph.coupling(cites(spark))
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 3)]
    own = spark.createDataFrame([(s, f"10.1/{s}") for s in "abcd"], "stem string, doi string")
    got = {(r.stem, r.other): (r.shared, r.note) for r in graph.labelled(pairs, cites(spark), own).collect()}
    assert got == {("a", "b"): (3, "cited here"), ("b", "a"): (3, "cites this")}


def test_coupling_properties(spark):
    edges = spark.createDataFrame([(i % 17, (i * i) % 23) for i in range(400)], "stem long, cited long")
    two, three = graph.coupling(edges, 2), graph.coupling(edges, 3)
    assert three.join(two, ["a", "b", "shared"], "left_anti").count() == 0
    assert sorted(map(tuple, graph.coupling(edges.orderBy(F.rand(1)), 2).collect())) == sorted(map(tuple, two.collect()))
    assert sorted(map(tuple, graph.coupling(edges, 2, hot=2).collect())) == sorted(map(tuple, two.collect()))
    cited = {}
    for r in edges.distinct().collect():
        cited.setdefault(r.stem, set()).add(r.cited)
    for least in (1, 2, 3, 5):
        want = sorted((a, b, len(cited[a] & cited[b])) for a in cited for b in cited if a < b and len(cited[a] & cited[b]) >= least)
        for long in (64, 8, 0):  # lists carried along, some papers counted work by work, all of them
            assert sorted(map(tuple, graph.coupling(edges, least, long=long).collect())) == want


def test_coupling_of_hubs(spark):
    """One paper that cites everything, one work that every paper cites."""
    rows = [(0, k) for k in range(300)] + [(s, 0) for s in range(1, 200)] + [(s, s) for s in range(1, 200)] + [(s, s + 1) for s in range(1, 200)]
    edges = spark.createDataFrame(rows, "stem long, cited long")
    got = {(r.a, r.b): r.shared for r in graph.coupling(edges, hot=50).collect()}
    cited = {}
    for a, b in rows:
        cited.setdefault(a, set()).add(b)
    assert got == {(a, b): len(cited[a] & cited[b]) for a in cited for b in cited if a < b and len(cited[a] & cited[b]) >= 2}
    assert graph.coupling(edges.limit(0)).count() == 0


def test_drift(spark):
    t = lambda *s: spark.createDataFrame([(x,) for x in s], "stem string")
    found = reconcile.drift(t("p1", "p2", "p3", "p4"), t("p1", "p5"), t("p2", "p6"), t("p1", "p3", "p7"))
    got = {}
    for r in found.collect():
        got.setdefault(r.category, set()).add(r.stem)
    assert got == {"missing_files": {"p3", "p4"}, "pdf_only": {"p2"}, "missing_nodes": {"p2", "p4"}, "orphan_xml": {"p5"}, "orphan_nodes": {"p7"}}
    assert not reconcile.drift_summary(found).first().is_clean
    clean = reconcile.drift(t("p1"), t("p1"), t("p9"), t("p1"))
    assert clean.count() == 0 and reconcile.drift_summary(clean).first().is_clean


def test_citations(spark):
    body = "[Fujii 2017; Smith 2020] x [Fujii et al. 2017] [0.1–0.3] [Kvašňák 2022] [Jones 1999]"
    tokens = reconcile.bracket_tokens(spark.createDataFrame([(1, body)], "d int, t string"), c("t"))
    n = tokens.select(U.surname_key(c("author")).alias("surname"), "year").groupBy("surname", "year").count().withColumnRenamed("count", "n")
    assert {(r.surname, r.year): r.n for r in n.collect()} == {("fujii", "2017"): 2, ("smith", "2020"): 1, ("kvasnak", "2022"): 1, ("jones", "1999"): 1}
    refs = spark.createDataFrame([("fujii", "2017", "10.1234/F", "", False, 0)], "surname string, year string, doi string, title string, unverified boolean, pos int")
    stems = spark.createDataFrame([("fujii2017", "fujii", "2017", ""), ("smith2020", "smith", "2020", ""), ("smith2020a", "smith", "2020", ""), ("kvak2022", "kvak", "2022", "")], "stem string, surname string, year string, title string")
    dois = spark.createDataFrame([("10.1234/f", "fujii2017")], "doi string, stem string")
    got = {r.surname: (r.status, r.stem, r.method, r.note) for r in reconcile.match_citations(reconcile.merge_citations(n, refs), stems, dois).collect()}
    assert got["fujii"] == ("MATCHED", "fujii2017", "doi", None)
    assert got["smith"][0] == "AMBIGUOUS" and got["smith"][3].endswith("smith2020, smith2020a")
    assert got["kvasnak"][0] == got["jones"][0] == "MISSING"


def test_title_check_and_key_match(spark):
    cit = spark.createDataFrame([("k1", "", "", "", ""), (None, "rey", "2012", "", "waves in tissue"), (None, "wu", "2010", "", "calcium waves")], "key string, surname string, year string, doi string, title string")
    stems = spark.createDataFrame([("k1", "x", "1", ""), ("rey2012", "rey", "2012", "Another subject"), ("wu2010", "wu", "2010", "Calcium!")], "stem string, surname string, year string, title string")
    got = [(r.status, r.stem, r.method, r.note) for r in reconcile.match_citations(cit, stems, spark.createDataFrame([], "doi string, stem string")).orderBy("surname").collect()]
    assert got == [("MATCHED", "k1", "key", None), ("AMBIGUOUS", "rey2012", "author-year", "author+year match but no title-word overlap"), ("MATCHED", "wu2010", "author-year", None)]


def test_keys(spark):
    df = spark.createDataFrame([(i, "Fujii Y, X", "2017") for i in range(3)] + [(9, "", "")], "i int, a string, y string").withColumn("base", T.base_key(c("a"), c("y")))
    assert [r.key for r in keys.assign_keys(df, "base", ["i"]).orderBy("i").collect()] == ["fujii2017", "fujii2017a", "fujii2017b", "anon0000"]


def test_tiers(spark):
    rows = [(2022, [1], False), (2022, [], True), (2023, [2, 6], True), (2023, [1], True), (2010, [1], True), (None, [1], True)]
    df = spark.createDataFrame(rows, "y int, s array<int>, m boolean")
    got = [r.t for r in df.select(triage.tier(c("y"), c("s"), F.array(lit(2), lit(6)), c("m")).alias("t")).collect()]
    assert got == ["unknown", "cut", "cut", "current", "replace", "replace"]


def test_argmax(spark):
    df = spark.createDataFrame([("a mouse and a rat; patient human patient",), ("mouse patient",), ("none",)], "t string")
    assert [r.v for r in df.select(discover.classified(c("t"), discover.CATEGORIES["Species"]).alias("v")).collect()] == ["Human", "Human", "Unknown"]


def test_crosstab(spark):
    df = spark.createDataFrame([("Human", "Memory")] + [("Human", "Detection")] * 3 + [("Unknown", "Memory"), ("In Vitro", "Memory")], "s string, k string")
    got = {(r.s, r.k): (r.n, r.percent) for r in discover.crosstab(df, "s", "k", ["Human", "Rodent"], ["Detection", "Memory", "Other"]).collect()}
    assert got[("Human", "Memory")] == (1, 25.0) and got[("Human", "Detection")] == (3, 75.0) and got[("Human", "Other")] == (0, 0.0)
    assert all(got[("Rodent", k)] == (0, 0.0) for k in ("Detection", "Memory", "Other"))


# ---- names and years in drafts

_FOLD = str.maketrans({**dict.fromkeys("‐‑‒–—―−", "-"), **{k: unicodedata.normalize("NFD", chr(k))[0] for k in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(k))[0].isascii()}})


def brute_sections(text, name, year):
    """Sections that cite a name, found by searching the whole text for it."""
    text = re.sub(r"(?m)^\[image\d+\]:.*$", "", text)
    cut = re.search(r"(?im)^\s*(?:#+\s*|\*\*)?References\b", text)
    text = text[: cut.start()] if cut else text
    heads = [(m.start(), int(m[1])) for m in re.finditer(r"(?m)^(?:#+\s*|\*\*)(\d+)\\?\.\s", text)]
    fold = lambda s: s.translate(_FOLD).lower()
    found = set()
    if name is not None and len(name) >= 2:
        for m in re.finditer(r"\b" + re.escape(fold(name)) + r"\b[^)\]]{0,45}?\b((?:19|20)\d\d)", fold(text)):
            before = [n for at, n in heads if at <= m.start()]
            if before and (year is None or abs(int(m[1]) - year) <= 1):
                found.add(before[-1])
    return sorted(found)


def test_citing_sections(spark):
    texts = [
        "Rey 2012\n# 1. One\n(Rey et al., 2012a) here\n# 2. Two\n(Rey, 2013) (Wu 2010) Reyes 2012\n",
        "**1\\. A** Cronin‐Golomb and Lehéricy (2014), van der Berg [2011] Berg) 2011 [Li] 2011 Li 2011\n[image1]: Rey 2012\n## 2. B\nLi and Li and Li 2012; Li " + "x" * 44 + " 2013\n",
        "# 3. C\nRey 1999 2000 Rey2001 2001Rey 2002 a_Rey 2003 Rey_ 2004 O'Neil-Smith 2005 'Rey' 2006\n# 10. D\nNG 19991 Ng 2012\n**References**\nRey 2012",
        "# 1. A\nLi" + "y " * 21 + "2011 Li" + " y" * 22 + " 2011\n# 2. B\nWu\n# 3. C\n2012 Wu\n4 2013 # 5. no\n",
        "no heading Rey 2012", "", None,
    ]
    names = ["Rey", "rey", "Wu", "Li", "Cronin-Golomb", "Lehericy", "van der Berg", "Berg", "O'Neil-Smith", "O'Neil", "Ng", "a", "", None, "Reyes", "y", "Li y", "'Rey"]
    rng = random.Random(3)
    words = ["Rey", "Wu", "van der Berg", "Berg", "and", "(", ")", "]", "2011", "2012", "1998", "20123", "x2012", "\n# 4. ", "\n# 5. ", "Lehéricy", "—", "é", "_", "'", ".", "42"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)] + ["".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    texts.append("filler words here " * 3000 + "\n# 7. Far\nRey and others (2012) " + "Wu 2010 " * 700)
    drafts = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    refs = [(d, n, y) for d in range(len(texts)) for n in names for y in (None, 2012)] + [(999, "Rey", 2012), (None, "Rey", 2012), (0, "Rey", 2012)]
    got = matching.citing_sections(spark.createDataFrame(refs, "d long, n string, y int"), drafts, "d", "t", "n", "y").collect()
    want = [(d, n, y, brute_sections(texts[d] or "", n, y) if d is not None and d < len(texts) else []) for d, n, y in refs]
    assert sorted(map(str, ((r.d, r.n, r.y, r.sections) for r in got))) == sorted(map(str, want))
    assert sum(bool(w[3]) for w in want) > 200


def test_citing_sections_of_the_table(spark):
    t = catalog.Tables(spark, "/root/testdata/sf0.001")
    drafts = {r.doc_id: r.draft for r in catalog.written_drafts(t).collect()}
    got = catalog.QUERIES["j11_citing_sections"](spark, t.folder).collect()
    assert len(got) == 3 * len(drafts)
    for r in got:
        assert r.sections == ",".join(map(str, brute_sections(drafts[r.doc_id], r.name, r.year)))
    assert sum(r.sections != "" for r in got) > 100


def shuffled(spark):
    """Bytes of shuffle files written so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_citing_sections_shuffle_their_texts_once(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = ["\n# 1. A\n" + " ".join(w for _ in range(300) for w in (*[word() for _ in range(9)], "(2012)")) + "\n# 2. B\nRey 2012" for _ in range(40)]
    drafts = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    refs = spark.createDataFrame([(d, n, 2012) for d in range(40) for n in ("Rey", "Absent")], "d long, n string, y int")
    before, kept = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many references
    try:
        got = matching.citing_sections(refs, drafts, "d", "t", "n", "y").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert all(r.sections == ([2] if r.n == "Rey" else []) for r in got) and len(got) == 80
    assert shuffled(spark) - before < 1.5 * sum(map(len, texts))


def test_sums_of_long_arrays(spark):
    for n in (0, 1, 63, 64, 65, 128, 1000):
        assert spark.range(1).select(matching._sums(F.transform(F.array(*map(lit, range(n))) if n else F.array().cast("array<int>"), lambda x: x))).first()[0] == [i * (i + 1) // 2 for i in range(n)]


def test_titles_in_pages(spark):
    rng = random.Random(1)
    words = [f"w{min(int(rng.expovariate(0.15)), 60)}" for _ in range(5000)]
    titles = [(i, rng.sample(words, rng.randint(0, 9))) for i in range(150)] + [(500, None), (501, ["w1", None, "w1", "zz"]), (502, ["zz"])]
    pages = [(i, rng.sample(words, rng.randint(0, 60))) for i in range(80)] + [(600, None), (601, []), (602, ["w1", "w1"])]
    pages += [(700 + i, pages[3][1][::-1]) for i in range(5)]
    for percent in (60, 100, 1):
        got = matching.contained_titles(spark.createDataFrame(titles, "title long, words array<string>"), spark.createDataFrame(pages, "page long, words array<string>"), percent=percent)
        sets = lambda rows: [(i, {x for x in w or [] if x is not None}) for i, w in rows]
        want = sorted((i, j, len(a & b)) for i, a in sets(titles) for j, b in sets(pages) if a and 100 * len(a & b) >= percent * len(a))
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "Join Cross" not in plan


def test_titles_in_pages_by_blocks(spark):
    rng = random.Random(2)
    titles = [(f"t{i}", [f"w{rng.randint(0, 12)}" for _ in range(rng.randint(0, 7))]) for i in range(120)]
    pages = [(float(i), [f"w{rng.randint(0, 20)}" for _ in range(rng.randint(0, 15))]) for i in range(90)]
    got = matching.contained_titles(spark.createDataFrame(titles, "title string, words array<string>"), spark.createDataFrame(pages, "page double, words array<string>"), most=40)
    want = sorted((i, j, len(set(a) & set(b))) for i, a in titles for j, b in pages if a and 5 * len(set(a) & set(b)) >= 3 * len(set(a)))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 500
    assert matching.contained_titles(spark.createDataFrame([], "title string, words array<string>"), spark.createDataFrame(pages, "page double, words array<string>")).collect() == []


def test_titles_in_pages_shuffles_no_pairs(spark):
    common = ["alpha", "beta", "gamma", "delta"]
    titles = spark.range(400).select(F.col("id").alias("title"), F.array(*map(lit, common), F.concat(lit("t"), "id")).alias("words"))
    pages = spark.range(400).select(F.col("id").alias("page"), F.array(*map(lit, common), F.concat(lit("p"), "id")).alias("words"))
    before = shuffled(spark)
    assert matching.contained_titles(titles, pages).where("shared = 4").count() == 160_000
    assert shuffled(spark) - before < 8 * 160_000


def test_lookup(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(None, -1), ("b", -2), ("none", -3)], "k string, i int").repartition(4)
    table = spark.createDataFrame([("hot", "x"), ("b", "y"), ("c", "z"), (None, "n")], "k string, v string")
    want = sorted((i, {"hot": "x", "b": "y"}.get(k)) for k, i in ((r.k, r.i) for r in rows.collect()))
    for most in (100, 1):  # broadcast, salted
        got = joins.lookup(rows, table, ["k"], most)
        assert sorted((r.i, r.v) for r in got.collect()) == want and got.columns == ["k", "i", "v"]


def test_phrases(spark):
    text = "Calcium wave 2 model. Calcium wave in a tissue; gap junction, gap junction"
    got = discover.top_phrases(spark.createDataFrame([(1, text)], "k int, t string"), "k", c("t")).orderBy("rank").collect()
    assert [(r.phrase, r.n) for r in got] == [("calcium wave", 2), ("gap junction", 2)]
    empty = spark.createDataFrame([(1, ""), (2, None), (3, "one")], "k int, t string")
    assert discover.phrases(empty, "k", c("t")).count() == 0


def test_section_replace(spark):
    text = "a\n\n## Concepts\n- [[old]] $1 \\\n\n## Related\nkept"
    once = one(spark, T.replace_between(lit(text), "## Concepts", "## Related", lit("- [[ATP]]")))
    assert once == "a\n\n## Concepts\n- [[ATP]]\n\n## Related\nkept"
    assert one(spark, T.replace_between(lit(once), "## Concepts", "## Related", lit("- [[ATP]]"))) == once
    assert one(spark, T.replace_to_end(lit(once), "## Related", lit("## Related\nnew\n"))).endswith("[[ATP]]\n\n## Related\nnew\n")


def test_ordered_dedup(spark):
    df = spark.createDataFrame([(1, "10.1/A", 0), (1, " 10.1/a ", 1), (1, "", 2), (1, None, 3), (1, "10.2/b", 4)], "k int, d string, pos int")
    got = keys.ordered_list(keys.first_spellings(df, ["k"], "d", "pos"), ["k"], "d", "pos", "l").first().l
    assert got == ["10.1/A", "10.2/b"]


def test_dois(spark):
    assert one(spark, T.first_doi(lit("see doi:10.1234/abc.5). Next"))) == "10.1234/abc.5"
    assert one(spark, T.doi_without_resolver(lit(" HTTPS://dx.doi.org/10.1/Ab "))) == "10.1/ab"
    assert one(spark, T.doi_without_dots(lit("10.1/Ab."))) == "10.1/ab"
    assert one(spark, T.doi_without_resolver(lit("10.1/Ab."))) == "10.1/ab."
    assert one(spark, T.first_doi(lit("none"))) is None and one(spark, T.doi_without_dots(lit(None).cast("string"))) == ""


def test_containment(spark):
    t = T.word_tokens(lit("Calcium waves in astrocytes"))
    assert one(spark, T.containment(t, T.word_tokens(lit("astrocytes show calcium signals")))) == pytest.approx(2 / 3)
    assert one(spark, T.containment(t, T.word_tokens(lit("calcium only")))) == pytest.approx(1 / 3)
    assert one(spark, T.containment(T.word_tokens(lit("")), t)) == 0


def test_braces(spark):
    yes = [("ATP", ""), ("Ca2+", ""), ("Rett", ""), ("Alzheimer's", ""), ("Ca", "2")]
    no = [("Model", ""), ("Ca", "wave"), ("$x$", ""), ("", ""), ("...", "")]
    df = spark.createDataFrame(yes + no, "t string, n string")
    assert [r.v for r in df.select(T.needs_braces(c("t"), c("n")).alias("v")).collect()] == [True] * 5 + [False] * 5


def test_tex_cites(spark):
    d = spark.createDataFrame([(1, r"\citep[see][]{a2010, b2011} \cite{a2010}")], "d int, t string")
    assert {r.key: r.n for r in reconcile.tex_cites(d, c("t")).collect()} == {"a2010": 2, "b2011": 1}


def test_article_xml(spark):
    inner = """<front><article-title>T</article-title><abstract abstract-type="toc"><p>x</p></abstract><abstract><p>plain</p></abstract>
    <kwd-group><kwd>Ca<sup>2+</sup> wave</kwd><kwd>ATP</kwd></kwd-group></front><ref-list><ref><pub-id pub-id-type="doi">10.1/A</pub-id></ref>
    <ref><pub-id pub-id-type="doi">10.1/a</pub-id><pub-id pub-id-type="pmid">1</pub-id></ref></ref-list>"""
    xml = [f"<article>{inner}</article>", f'<article xmlns="http://x.org">{inner}</article>', f"<!DOCTYPE article><article>{inner}</article>", f"<article>{inner}", None]
    df = spark.createDataFrame([(i, bytearray(x.encode()) if x else None) for i, x in enumerate(xml)], "i int, x binary")
    got = [r.a for r in df.select("i", U.article_xml("x").alias("a")).orderBy("i").collect()]
    for a in got[:3]:
        assert (a.valid, a.abstract, a.keywords, a.cited) == (True, "plain", ["Ca2+ wave", "ATP"], ["10.1/A"])
    assert [a.valid for a in got[3:]] == [False, False]


def test_article_rules(spark):
    meta = "<article-meta><article-title>Own</article-title><abstract><p>own</p></abstract></article-meta>"
    people = '<contrib-group><contrib contrib-type="editor"><surname>Editor</surname></contrib><contrib><surname> </surname></contrib><contrib contrib-type="author"><surname>Author</surname></contrib></contrib-group>'
    xml = [
        f"<article><front><related><article-title>Cited</article-title><abstract><p>cited</p></abstract></related>{people}{meta}</front></article>",
        "<article><front><article-title>Only</article-title></front><contrib><surname>Loose</surname></contrib></article>",
        '<article><article-meta/><article-title>Late</article-title><contrib-group><contrib contrib-type="editor"><surname>E</surname></contrib></contrib-group></article>',
    ]
    df = spark.createDataFrame([(i, bytearray(x.encode())) for i, x in enumerate(xml)], "i int, x binary")
    got = [(r.a.title, r.a.surname, r.a.abstract) for r in df.select("i", U.article_xml("x").alias("a")).orderBy("i").collect()]
    assert got == [("Own", "Author", "own"), ("Only", "", ""), ("Late", "", "")]


def test_decisions(spark):
    rows = spark.createDataFrame([("10.1/a", "", ""), ("10.2/b", "", "")], "doi string, tier string, note string")
    prior = spark.createDataFrame([("10.1/A", "record", "n"), ("10.2/b", "", " ")], "doi string, tier string, note string")
    got = sorted(map(tuple, triage.keep_decisions(rows, prior, "doi", ("tier", "note")).collect()))
    assert got == [("10.1/a", "record", "n"), ("10.2/b", "", "")]
    again = triage.keep_decisions(triage.keep_decisions(rows, prior, "doi", ("tier", "note")), prior, "doi", ("tier", "note"))
    assert sorted(map(tuple, again.collect())) == got
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "doi string")
    assert [r.doi for r in triage.carried_over(t("p", "q", "r"), t("q"), t("r"), "doi").collect()] == ["p"]


def test_ranking(spark):
    df = spark.createDataFrame([("u", ["A"], 1, 5), ("v", ["A", "B"], 2, 0), ("w", ["B"], 0, 99)], "doi string, modes array<string>, seeds int, cites int")
    assert [r.doi for r in discover.ranked(df, 40).collect()] == ["v", "u", "w"]


def test_worklist(spark):
    rows = [("1", "replace", "2001", "B", False), ("2", "record", "", "A", False), ("3", "record", "1999", "A", False), ("4", "cut", "1990", "A", False), ("5", "", "1990", "A", False), ("6", "seminal", "1990", "A", True), ("7", "replace", "1998", "Z", None)]
    got = triage.worklist(spark.createDataFrame(rows, "id string, tier string, year string, author string, have boolean")).orderBy("tier_rank", "number").collect()
    assert [r.id for r in got] == ["2", "3", "7", "1"]


def test_places(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, year int").repartition(5)
    order = lambda r: (r[2] is not None, r[2] or 0, r[0])
    for parts in (1, 4, 37):
        got = ranking.places(df, ["year", "id"], ["g"], size="n", parts=parts).collect()
        want = {}
        for g in (None, "hot", "a", "b"):
            own = sorted((r for r in rows if r[1] == g), key=order)
            want |= {r[0]: (k, len(own)) for k, r in enumerate(own, 1)}
        assert {r.id: (r.place, r.n) for r in got} == want
    falling = ranking.places(df, [("year", True), "id"]).collect()
    assert {r.id: r.place for r in falling} == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-(r[2] or 0), r[0])), 1)}
    assert ranking.places(df.limit(0), ["id"]).collect() == []
    run = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    for name, source in (("o05_worklist_order", "p21_worklist"), ("o04_triage_order", "p08_proposed_tier")):
        n = run(source).count()
        assert n > 50 and sorted(r.place for r in run(name).collect()) == list(range(1, n + 1))


def test_a_hot_group_is_shared_out(spark):
    df = spark.range(4000).select(c("id"), F.when(c("id") % 3 == 0, c("id")).otherwise(0).alias("g"))
    blocks = ranking._blocks(df, [c("g")], ranking._orders(["id"]), {}, 16).groupBy("_block").count().collect()
    assert len(blocks) >= 12 and max(r["count"] for r in blocks) < 3 * 4000 / 16


def test_carried(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 0, 0, 1, 2]), rng.randint(0, 50), rng.choice([None, None, None, i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, user int, ts int, v int").repartition(3)
    want, last = {}, {}
    for i, user, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        last[user] = v if v is not None else last.get(user)
        want[i] = last[user]
    for parts in (1, 7, 40):
        assert {r.id: r.carried for r in ranking.carried(df, c("v"), ["ts", "id"], ["user"], parts=parts).collect()} == want


def test_lookups_keep_one_row(spark):
    records = spark.createDataFrame([(1, "10.1/a", "7"), (2, "", "7"), (3, None, None)], "i int, doi string, pmid string").withColumn("pmcid", lit(""))
    ids = spark.createDataFrame([("10.1/a", "x", 0), ("10.1/a", "b", 1), ("7", "p", 0), ("7", "p", 1), (None, "n", 2), ("", "e", 3)], "id string, stem string, pos int")
    assert sorted((r.i, r.stem) for r in keys.resolve_identifiers(records, ids).collect()) == [(1, "b"), (2, "p"), (3, None)]
    cit = spark.createDataFrame([("s", "2001", "10.1/a", "")], "surname string, year string, doi string, title string")
    none = spark.createDataFrame([], "stem string, surname string, year string, title string")
    dois = spark.createDataFrame([("10.1/a", "z", 0), ("10.1/a", "m", 1)], "doi string, stem string, pos int")
    assert [r.stem for r in reconcile.match_citations(cit, none, dois).collect()] == ["m"]


def test_cascade(spark):
    none = F.array().cast("array<string>")
    assert tuple(one(spark, decide.first_references(jats=none, crossref=F.array(lit("x"))))) == (["x"], "crossref")
    assert tuple(one(spark, decide.first_references(jats=none, crossref=lit(None).cast("array<string>")))) == ([], "none")


def test_reference_sections(spark):
    text = "a\n## References\nold\n\n## References\nnew"
    s = one(spark, T.body_and_references(lit(text)))
    assert s.body.endswith("old\n\n") and s.refs == "\nnew"
    assert one(spark, T.before_bibliography(lit(text))).strip() == "a"
    assert one(spark, T.body_and_references(lit("no list"))).refs == ""


def test_fold_keeps_length(spark):
    for x in ("Cronin‐Golomb", "Lehéricy", "ß İ ﬁ Å", ""):
        assert len(one(spark, U.folded(lit(x)))) == len(x)
    assert one(spark, U.folded(lit("Cronin‐Golomb Lehéricy"))) == "cronin-golomb lehericy"
    assert one(spark, U.surname_key(lit("Kvašňák, J."))) == "kvasnak"


def test_folding_in_the_jvm_and_in_workers(spark):
    """Characters with a rule in the JVM, and those that need a worker, against the Unicode database."""
    marks = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    texts = [chr(k) for k in [*range(1, 0x300), *range(0x1E00, 0x2300), 0x3B1, 0x416, 0x4E2D, 0xFB01, 0x1F600] if not 0xD800 <= k < 0xE000] + ["Kvašňák e\u0301 ΐ ½ plain", "", "a\u0327b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", U.without_diacritics("t").alias("p"), U.folded("t").alias("f"), U.surname_key("t").alias("k")).collect():
        if r.t is None:
            assert r.p is None and r.f is None and r.k == ""
            continue
        assert r.p == marks(r.t) and len(r.f) == len(r.t)
        assert r.f == "".join(U._FOLDING[ord(x)] for x in r.t)
        first = re.search("[A-Za-z\u00c0-\u024f]+", r.t)
        assert r.k == (marks(first[0]).lower() if first else "")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.plain for r in catalog.QUERIES["f05_without_diacritics"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: marks(r.text) for r in docs}


def test_landed_pages(spark, tmp_path):
    rows = spark.createDataFrame([(i, i // 10, f'{{"v":"{i}ü"}}' if i % 7 else '{"v":') for i in range(55)], "id long, page long, body string")
    pages.land(rows, c("page"), c("id"), c("body"), f"file://{tmp_path}/p")
    got = pages.read(spark, f"file://{tmp_path}/p")
    assert got.rdd.getNumPartitions() == 6
    back = got.collect()
    assert {int(r.id): r.payload for r in back if r.id} == {i: f'{{"v": "{i}ü"}}' for i in range(55) if i % 7}
    assert sum(r.error is not None and r.payload is None for r in back) == 8
    for test, among in (("page = 2", {2}), ("page > 3", {4, 5}), ("page <= 1", {0, 1}), ("page in (1, 4)", {1, 4}), ("page >= 9", set())):
        some = got.where(test)
        assert {r.page for r in some.collect()} == among and some.rdd.getNumPartitions() == max(len(among), 1)
    with pytest.raises(Exception, match="path"):
        spark.read.format("landed_pages").load().collect()


def test_written_documents(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files for few rows
    try:
        written_documents(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def written_documents(spark, tmp_path):
    lib = f"file://{tmp_path}"
    n = 3000
    ids = spark.range(n).select(F.concat(lit('1"0/'), c("id").cast("string")).alias("id"), F.concat(lit("s"), c("id").cast("string")).alias("stem"))
    papers = ids.select("stem", F.concat(lit('T {"x"}, \n'), "stem").alias("title"), F.array(lit("p")).alias("projects"))
    files.write_manifest(ids, papers, f"{lib}/m")
    parts = sorted((tmp_path / "m").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 3 and list(whole["by_id"]) == sorted(whole["by_id"]) and len(whole["entries"]) == n
    i, p = files.read_manifest(spark, f"{lib}/m")
    assert {r.id: r.stem for r in i.collect()} == whole["by_id"] and {r.stem: r.title for r in p.collect()} == {k: v["title"] for k, v in whole["entries"].items()}
    (tmp_path / "other.json").write_text(json.dumps(whole, indent=2))
    i, p = files.read_manifest(spark, f"{lib}/other.json")
    assert i.count() == p.count() == n
    files.write_manifest(ids.limit(0), papers.limit(0), f"{lib}/none")
    assert files.read_manifest(spark, f"{lib}/none")[0].count() == 0
    meta = spark.createDataFrame([("10.1/a", (2001, "T")), ("10.1/b", None)], "doi string, meta struct<year:int,title:string>")
    files.write_cache(meta, f"{lib}/c")
    cache = json.loads("".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*"))))
    assert cache == {"10.1/a": {"year": 2001, "title": "T"}, "10.1/b": None}
    (tmp_path / "c.json").write_text(json.dumps(cache, indent=1))
    (tmp_path / "broken.json").write_text('{"10.1/a": {')
    for path, want in (("c", 2), ("c.json", 2), ("broken.json", 0), ("missing", 0)):
        got = {r.doi: r.meta and r.meta.title for r in files.read_cache(spark, f"{lib}/{path}").collect()}
        assert got == ({"10.1/a": "T", "10.1/b": None} if want else {})
    files.bibliography(spark.createDataFrame([("b", "@b{\n}"), ("a", "@a{\n}")], "key string, entry string"), f"{lib}/bib")
    assert "".join(p.read_text() for p in sorted((tmp_path / "bib").glob("part-*"))) == "% 2 entries; do not edit, generate anew\n\n@a{\n}\n\n@b{\n}\n\n"


def test_project_export(spark, tmp_path):
    lib = tmp_path / "lib"
    (lib / "sub").mkdir(parents=True)
    (lib / "a.xml").write_bytes(b"x" * 3_000_000)
    (lib / "sub" / "b.pdf").write_bytes(b"")
    papers = spark.createDataFrame([("p", ["a.xml", "sub/b.pdf", "gone.xml"], ["one"]), ("q", ["a.xml", "../out.txt", "/etc/x"], ["one", "two"]), ("r", [], ["one"]), ("s", ["a.xml"], None), ("t", None, ["one"])], "stem string, files array<string>, projects array<string>")
    out = files.export_project(papers, "one", f"file://{lib}", f"file://{tmp_path}/out")
    got = sorted((r.stem, r.file or "", r.status, r.size) for r in out.collect())
    assert got == [("p", "a.xml", "copied", 3_000_000), ("p", "gone.xml", "missing", None), ("p", "sub/b.pdf", "copied", 0), ("q", "../out.txt", "unsafe", None), ("q", "/etc/x", "unsafe", None), ("q", "a.xml", "copied", 3_000_000), ("r", "", "none listed", None), ("t", "", "none listed", None)]
    assert tuple(files.export_totals(out).first()) == (4, 3, 1)
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.xml", "sub/b.pdf"]
    assert (tmp_path / "out" / "a.xml").read_bytes() == (lib / "a.xml").read_bytes() and len(list(lib.rglob("*"))) == 3


def test_trees_by_folders(spark):
    rng = random.Random(6)
    names = [f"{rng.choice('abc')}/{rng.choice('xy')}/{i}" for i in range(200)] + ["top", "a/one", "deep/er/and/deeper/f"]
    a = {n: f"h{rng.randint(0, 9)}" for n in names}
    b = dict(a) | {n: "changed" for n in names if n.startswith("b/x/") and n.endswith("3")} | {"new/only": "h", "c/y/more": "h"}
    for n in names:
        if n.startswith("a/y/") and n.endswith("7"):
            del b[n]
    make = lambda d: spark.createDataFrame(list(d.items()), "path string, digest string")
    state = lambda n: "new" if n not in b else "extra" if n not in a else "in-sync" if a[n] == b[n] else "updated"
    got = reconcile.tree_sync_by_folders(make(a), make(b))
    assert {r.path: r.state for r in got.collect()} == {n: state(n) for n in {*a, *b}} and got.count() == len({*a, *b})
    assert {r.state for r in reconcile.tree_sync_by_folders(make(a), make(a)).collect()} == {"in-sync"}
    folders = {r.folder: r.n for r in reconcile.folder_digests(make(a)).collect()}
    assert folders[""] == len(a) and folders["deep/er/and"] == 1


def test_file_digests_read_what_changed(spark, tmp_path):
    import hashlib
    import os

    root = tmp_path / "tree"
    for i in range(30):
        (root / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 3}" / f"f{i}").write_text(f"text {i}" * (i + 1))
    first = files.file_digests(spark, f"file://{root}")
    want = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in root.rglob("f*")}
    assert {r.path: r.digest for r in first.collect()} == want and first.where("not read").count() == 0
    (root / "d1" / "f4").write_text("changed")
    (root / "d2" / "f5").unlink()
    (root / "d0" / "new").write_text("n")
    os.utime(root / "d0" / "f0", (1, 1))
    again = files.file_digests(spark, f"file://{root}", first)
    assert {r.path for r in again.where("read").collect()} == {"d1/f4", "d0/new", "d0/f0"} and again.count() == 30
    sync = {r.path: r.state for r in reconcile.tree_sync_by_folders(again, first).where("state <> 'in-sync'").collect()}
    assert sync == {"d1/f4": "updated", "d0/new": "new", "d2/f5": "extra"}


def test_landed_payloads(spark):
    assert one(spark, landed.first_hit(lit('{"resultList":{"result":[]}}'))) is None
    assert one(spark, landed.references(lit('{"message":{"reference":[{"DOI":"10.1/A"},{"DOI":" 10.1/a "},{},{"DOI":"10.2/b"}]}}'))) == ["10.1/A", "10.2/b"]
    assert one(spark, landed.reduced(lit("{}"))) is None and one(spark, landed.reduced(lit("not json"))) is None


def test_files(spark, tmp_path):
    lib = f"file://{tmp_path}"
    ids = spark.createDataFrame([("10.1/b", "b"), ("10.1/a", "a")], "id string, stem string")
    papers = spark.createDataFrame([("b", "T2", ["p"]), ("a", "T1", None)], "stem string, title string, projects array<string>")
    files.write_manifest(ids, papers, f"{lib}/m.json")
    i, p = files.read_manifest(spark, f"{lib}/m.json")
    assert sorted(map(tuple, i.collect())) == [("10.1/a", "a"), ("10.1/b", "b")] and {r.stem: r.title for r in p.collect()} == {"a": "T1", "b": "T2"}
    assert files.read_manifest(spark, f"{lib}/none.json")[0].count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_manifest(spark, f"{lib}/none.json", missing_ok=False)
    rows = spark.createDataFrame([tuple(f"v{k}" for k in range(12)) + ("",)], ", ".join(f"{n} string" for n in files.TRIAGE))
    files.write_triage(rows, f"{lib}/t.tsv")
    assert [tuple(r) for r in files.read_triage(spark, f"{lib}/t.tsv").collect()] == [tuple(r) for r in rows.collect()]
    assert files.read_triage(spark, f"{lib}/none.tsv").count() == 0
    (tmp_path / "lit").mkdir()
    (tmp_path / "lit" / "x.md").write_text('---\ncitekey: k\ndoi: "10.1/X"\nprojects:\n  - p\n  - q\ncited_dois: []\n---\nbody')
    (tmp_path / "lit" / "y.md").write_text("no front")
    (node,) = files.read_nodes(spark, f"{lib}/lit").collect()
    assert tuple(node) == ("k", "10.1/x", ["p", "q"], [])
    assert {r.stem for r in files.stems(spark, f"{lib}/lit", ".md").collect()} == {"x", "y"}
    assert {r.path for r in files.tree(spark, f"{lib}/lit").collect()} == {"x.md", "y.md"}
    log = files.log_rows(*[spark.createDataFrame([(s, "")], "stem string, detail string") for s in "abc"], "p")
    files.append_log(log, f"{lib}/log")
    files.append_log(log, f"{lib}/log")
    assert spark.read.parquet(f"{lib}/log").count() == 6


def test_registry_metadata_reads_properties(spark, tmp_path):
    props = ['{"k": 7}', '{"a": "]\\"\\n", "k": -2}', '{"b": [1, 2]}', "", None, '{"k": null}']
    rows = [(5000 * i + i, 2000 + i, f"name{i}", x) for i, x in enumerate(props)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["s40_registry_metadata"](spark, str(tmp_path))
    want = [(i, y, n, i, k) for (i, y, n, _), k in zip(rows, [7, -2, None, None, None, None], strict=True)]
    assert got.columns == ["event_id", "year", "first_author", "crossref_citations", "k"] and sorted(map(tuple, got.collect())) == want
