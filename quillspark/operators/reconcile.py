"""Drift between a ledger and its artefacts; citations of a draft against the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.joins import lookup


def drift(manifest: DataFrame, xml: DataFrame, pdf: DataFrame, nodes: DataFrame) -> DataFrame:
    """category and stem of every disagreement between four tables with a ``stem``.

    pdf_only is information, not drift; a PDF that nothing else knows is not reported.
    """
    flag = lambda d, name: d.select("stem").distinct().withColumn(name, F.lit(True))
    seen = flag(manifest, "_m").join(flag(xml, "_x"), "stem", "full").join(flag(pdf, "_p"), "stem", "full").join(flag(nodes, "_n"), "stem", "full")
    m, x, p, n = (F.coalesce(c, F.lit(False)) for c in ("_m", "_x", "_p", "_n"))
    found = F.filter(
        F.array(F.when(m & ~x & ~p, "missing_files"), F.when(m & ~x & p, "pdf_only"), F.when(m & ~n, "missing_nodes"), F.when(x & ~m, "orphan_xml"), F.when(n & ~m, "orphan_nodes")),
        lambda c: c.isNotNull(),
    )
    return seen.select(F.explode(found).alias("category"), "stem")


def drift_summary(findings: DataFrame) -> DataFrame:
    """One row: a count per category, and is_clean."""
    names = ("missing_files", "pdf_only", "missing_nodes", "orphan_xml", "orphan_nodes")
    counts = findings.agg(*[F.count_if(F.col("category") == c).alias(c) for c in names])
    return counts.withColumn("is_clean", sum(F.col(c) for c in names if c != "pdf_only") == 0)


def tree_sync(source: DataFrame, target: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path and state (new, updated, in-sync, extra) of source files against target files."""
    a = source.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("_a"))
    b = target.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("_b"))
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "in-sync").otherwise("updated")
    return a.join(b, path, "full").select(path, state.alias("state"))


def folder_digests(files: DataFrame) -> DataFrame:
    """folder, n, h1, h2 of every folder of a tree ('' is its root) from the path and digest of its files.

    A folder's digest stands for the set of all files below it, as a count and two exclusive sums of hashes: files add to the sums of
    all folders above them where they are, so even the root is summed in parts by all tasks.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    h1, h2 = F.xxhash64("path", "digest"), F.xxhash64("digest", F.lit("\n"), "path")
    return files.select(F.explode(above).alias("folder"), h1.alias("h1"), h2.alias("h2")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))


def tree_sync_by_folders(source: DataFrame, target: DataFrame) -> DataFrame:
    """path and state (new, updated, in-sync, extra) of two trees, each given as path and digest of its files.

    Folders whose digests agree are in sync with all they hold; only files of other folders are compared by name. Paths are
    unique on either side.
    """
    a, b = source.select("path", "digest"), target.select("path", "digest")
    same = folder_digests(a).join(folder_digests(b), ["folder", "n", "h1", "h2"]).select("folder", F.lit(True).alias("_same"))
    own = F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)
    mark = lambda d: lookup(d.withColumn("folder", own), same, ["folder"]).drop("folder")
    x, y = mark(a), mark(b)
    rest = x.where("_same is null").select("path", F.col("digest").alias("_a")).join(y.where("_same is null").select("path", F.col("digest").alias("_b")), "path", "full")
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "in-sync").otherwise("updated")
    return x.where("_same").select("path", F.lit("in-sync").alias("state")).unionByName(rest.select("path", state.alias("state")))


def merge_citations(intext: DataFrame, reflist: DataFrame) -> DataFrame:
    """surname, year, intext, in_reflist, doi, title, unverified: the full outer join of mentions and reference list.

    intext: surname, year, n. reflist: surname, year, doi, title, unverified, pos; blocks of one key merge, the first known value wins.
    """
    first = lambda c: F.min_by(T.known(F.col(c)), F.when(T.known(F.col(c)).isNotNull(), F.col("pos"))).alias(c)
    refs = reflist.where((T.or_empty(F.col("surname")) != "") & (T.or_empty(F.col("year")) != "")).groupBy("surname", "year").agg(first("doi"), first("title"), F.bool_or("unverified").alias("unverified"), F.lit(True).alias("in_reflist"))
    said = intext.groupBy("surname", "year").agg(F.sum("n").alias("intext"))
    both = said.join(refs, ["surname", "year"], "full")
    return both.select("surname", "year", F.coalesce("intext", F.lit(0)).cast("bigint").alias("intext"), F.coalesce("in_reflist", F.lit(False)).alias("in_reflist"), "doi", "title", F.coalesce("unverified", F.lit(False)).alias("unverified"))


def match_citations(citations: DataFrame, stems: DataFrame, dois: DataFrame) -> DataFrame:
    """citations with status, stem, method and note.

    citations: surname, year, doi, title and perhaps key. stems: stem, surname, year, title. dois: doi, stem and perhaps pos;
    of several rows of one doi the last counts (without pos: the one with the largest stem).
    A key that is a stem wins, then the DOI, then the only paper of the author and year (unless the titles share no word).
    """
    c = citations if "key" in citations.columns else citations.withColumn("key", F.lit(None).cast("string"))
    by_key = stems.select(F.col("stem").alias("key"), F.col("stem").alias("_k")).distinct()
    last = F.col("pos") if "pos" in dois.columns else F.col("stem")
    by_doi = dois.groupBy(F.col("doi").alias("_doi")).agg(F.max_by("stem", last).alias("_d"))
    by_name = stems.groupBy("surname", "year").agg(F.array_sort(F.collect_set("stem")).alias("_s"), F.max("title").alias("_t"))
    x = c.join(by_key, "key", "left").join(by_doi, T.known(T.doi_without_dots(F.col("doi"))) == F.col("_doi"), "left").join(by_name, ["surname", "year"], "left")
    n = F.coalesce(F.size("_s"), F.lit(0))
    apart = (T.or_empty(F.col("title")) != "") & (T.or_empty(F.col("_t")) != "") & ~F.arrays_overlap(T.title_tokens(F.col("title")), T.title_tokens(F.col("_t")))
    pick = lambda key, doi, one, off, many, none: F.when(F.col("_k").isNotNull(), key).when(F.col("_d").isNotNull(), doi).when((n == 1) & apart, off).when(n == 1, one).when(n > 1, many).otherwise(none)
    nil = F.lit(None).cast("string")
    only = F.get("_s", F.lit(0))
    return x.select(
        *c.columns,
        pick(F.lit("MATCHED"), F.lit("MATCHED"), F.lit("MATCHED"), F.lit("AMBIGUOUS"), F.lit("AMBIGUOUS"), F.lit("MISSING")).alias("status"),
        pick(F.col("_k"), F.col("_d"), only, only, nil, nil).alias("stem"),
        pick(F.lit("key"), F.lit("doi"), F.lit("author-year"), F.lit("author-year"), F.lit("author-year"), nil).alias("method"),
        pick(nil, nil, nil, F.lit("author+year match but no title-word overlap"), F.concat(F.lit("several library papers share this author+year: "), F.array_join("_s", ", ")), nil).alias("note"),
    )


def bracket_tokens(drafts: DataFrame, text: Column) -> DataFrame:
    """draft columns and group, part, author, year of each author-year token in square brackets."""
    groups = drafts.select("*", F.posexplode(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))).alias("group", "_content")).where(T.cites_something(F.col("_content")))
    parts = groups.select(*drafts.columns, "group", F.posexplode(F.split("_content", ";")).alias("part", "_token"))
    return parts.withColumn("_ay", T.author_year(F.trim(F.rtrim("_token", F.lit(" \u26a0"))))).where(F.col("_ay.year") != "").select(*drafts.columns, "group", "part", F.col("_ay.author").alias("author"), F.col("_ay.year").alias("year"))


def tex_cites(drafts: DataFrame, text: Column) -> DataFrame:
    """draft columns, key and n of every cited key."""
    # fixed value: the pattern of a citation command
    keys = drafts.select(*drafts.columns, F.explode(F.regexp_extract_all(text, F.lit(r"\\cite[tp]?\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))).alias("_group"))
    one = keys.select(*drafts.columns, F.explode(F.split("_group", ",")).alias("_k")).select(*drafts.columns, F.trim("_k").alias("key")).where("key <> ''")
    return one.groupBy(*drafts.columns, "key").agg(F.count(F.lit(1)).alias("n"))


def tex_bibitems(drafts: DataFrame, text: Column) -> DataFrame:
    """draft columns, key, author (first, without TeX), year (the last named), doi, title of every \\bibitem; the last of a key counts."""
    # fixed values: the patterns of a bibliography item, of a title and of a year in it
    pattern = r"(?s)\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}(.*?)(?=\\bibitem|\\end\{thebibliography\})"
    keys, blocks = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    items = drafts.select(*drafts.columns, F.posexplode(F.arrays_zip(keys.alias("k"), blocks.alias("b"))).alias("_pos", "_i"))
    b = F.col("_i.b")
    emph = r"(?s)\\emph\{(.*?)\}"
    years = F.regexp_extract_all(b, F.lit(r"\b(1[89]\d{2}|20\d{2})\b"), F.lit(1))
    rows = items.select(
        *drafts.columns, "_pos", F.trim("_i.k").alias("key"),
        T.tex_first_author(F.when(b.rlike(emph), F.regexp_extract(b, r"(?s)^(.*?)\\emph\{", 1)).otherwise(b)).alias("author"),
        T.or_empty(F.get(years, F.size(years) - 1)).alias("year"), T.first_doi_in_brackets(b).alias("doi"), T.without_tex(F.regexp_extract(b, emph, 1)).alias("title"),
    )
    return rows.groupBy(*drafts.columns, "key").agg(F.max_by(F.struct("author", "year", "doi", "title"), "_pos").alias("_r")).select(*drafts.columns, "key", "_r.*")


def reference_blocks(drafts: DataFrame, refs: Column) -> DataFrame:
    """draft columns, pos, head, year, doi, title, unverified of blank-line separated reference entries."""
    blocks = drafts.select(*drafts.columns, F.posexplode(F.split(refs, r"\n\s*\n")).alias("pos", "_b")).where(F.trim(F.regexp_replace("_b", r"\s", "")) != "")
    flagged = F.lower("_b").contains("unable to verify")
    lines = F.filter(F.split(F.regexp_replace("_b", r"^\s+|\s+$", ""), "\n"), lambda x: ~F.lower(x).contains("unable to verify"))
    head = F.trim(F.array_join(lines, " "))
    year = r"\((\d{4})[a-z]?\)"  # fixed value: the pattern of a year in a reference
    rest = F.regexp_replace(F.regexp_extract(head, rf"(?s)^.*?{year}(.*)$", 2), r"^[ .]+", "")
    x = blocks.select(*drafts.columns, "pos", head.alias("head"), F.regexp_extract(head, year, 1).alias("year"), T.first_doi_in_brackets(head).alias("doi"), F.when(head.rlike(year), F.trim(F.split(rest, r"\.")[0])).otherwise("").alias("title"), flagged.alias("unverified"))
    return x.where("head <> ''")


def rewrite_citations(drafts: DataFrame, key: str, text: Column, matched: DataFrame) -> DataFrame:
    """``key``, body, converted, flagged: author-year tokens become @stem where matched(surname, year, stem) has them, else get a warning mark.

    Texts are split at brackets, tokens looked up (a small library is broadcast, a large one joined with hot names salted), and put
    together again in order. Of several stems of one name and year the smallest is taken.
    """
    from quillspark.functions.unicode import surname_key

    pieces = drafts.select(key, F.posexplode(F.split(text, r"(?=\[[^\[\]]+\])|(?<=\])")).alias("_i", "_p"))
    inner = F.regexp_extract("_p", r"^\[([^\[\]]+)\]$", 1)
    pieces = pieces.select(key, "_i", "_p", F.when((inner != "") & T.cites_something(inner), F.split(inner, ";")).alias("_parts"))
    tokens = pieces.where("_parts is not null").select(key, "_i", F.posexplode("_parts").alias("_j", "_t"))
    clean = F.trim(F.rtrim(F.trim("_t"), F.lit(" \u26a0")))
    tokens = tokens.select(key, "_i", "_j", F.trim("_t").alias("_raw"), clean.alias("_clean"), T.author_year(clean).alias("_ay"))
    tokens = tokens.select("*", surname_key(F.col("_ay.author")).alias("surname"), F.col("_ay.year").alias("year"))
    tokens = lookup(tokens, matched.groupBy("surname", "year").agg(F.min("stem").alias("stem")), ["surname", "year"])
    is_token = F.col("_ay.year") != ""
    new = F.when(~is_token, F.col("_raw")).when(F.col("stem").isNotNull(), F.concat(F.lit("@"), "stem")).otherwise(F.concat("_clean", F.lit(" \u26a0")))
    groups = tokens.groupBy(key, "_i").agg(F.array_sort(F.collect_list(F.struct("_j", new.alias("n")))).alias("_l"), F.count_if(is_token & F.col("stem").isNotNull()).alias("_c"), F.count_if(is_token & F.col("stem").isNull()).alias("_f"))
    done = pieces.join(groups, [key, "_i"], "left").select(key, "_i", F.when(F.col("_l").isNull(), F.col("_p")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["n"]), "; "), F.lit("]"))).alias("_p"), "_c", "_f")
    return done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda x: x["_p"]), "").alias("body"), F.coalesce(F.sum("_c"), F.lit(0)).alias("converted"), F.coalesce(F.sum("_f"), F.lit(0)).alias("flagged"))
