"""Candidates, phrases, concepts, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def merge_candidates(hits: DataFrame) -> DataFrame:
    """One row per doi from hits (doi, mode, seed, direction, query, pos, title, author, year, venue, cites).

    Sets of modes and seeds, queries in order of arrival, and the first known value of each detail.
    """
    first = lambda c: F.min_by(T.known(F.col(c).cast("string")), F.when(T.known(F.col(c).cast("string")).isNotNull(), F.col("pos"))).alias(c)
    out = hits.groupBy("doi").agg(
        F.array_sort(F.collect_set("mode")).alias("modes"),
        F.collect_set(F.when(F.col("direction") == "out", F.col("seed"))).alias("ref_by"),
        F.collect_set(F.when(F.col("direction") == "in", F.col("seed"))).alias("cites_seeds"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("query").isNotNull(), F.struct("pos", "query")))), lambda x: x["query"]).alias("queries"),
        first("title"), first("author"), first("year"), first("venue"), F.coalesce(F.max("cites"), F.lit(0)).alias("cites"),
    )
    return out.withColumn("seeds", F.size(F.array_union("ref_by", "cites_seeds")))


def why(c: Column | None = None) -> Column:
    """Why a candidate is shown: up to three parts."""
    some = lambda x: F.size(x) > 0
    quoted = F.array_join(F.transform(F.slice("queries", 1, 3), lambda q: F.concat(F.lit('"'), q, F.lit('"'))), "; ")
    return F.concat_ws(
        "; ",
        F.when(some("ref_by"), F.concat(F.lit("cited by "), F.size("ref_by").cast("string"), F.lit(" of my papers"))),
        F.when(some("cites_seeds"), F.concat(F.lit("cites "), F.size("cites_seeds").cast("string"), F.lit(" of my papers"))),
        F.when(some("queries"), F.concat(F.lit("matched query "), quoted)),
    )


def ranked(candidates: DataFrame, n: int) -> DataFrame:
    """The first n: found in the graph first, then most seeds, most cited, then doi."""
    return candidates.orderBy(F.array_contains("modes", "A").desc(), F.desc("seeds"), F.desc("cites"), "doi").limit(n)


def phrases(docs: DataFrame, key: str, text: Column, least: int = 2, stop: list[str] = T.STOP_WORDS) -> DataFrame:
    """key, phrase, n, first: pairs of adjacent content words that occur at least ``least`` times in a text."""
    toks = T.phrase_tokens(text)
    ok = lambda w: ~w.isin(stop) & (F.length(w) > 2)
    # marked once a word; then pairs of marked words, before anything is exploded
    word = F.transform("_t", lambda w: F.when(ok(w), w))
    x = docs.select(key, toks.alias("_t")).select(key, word.alias("_w"))
    pairs = F.filter(F.transform("_w", lambda w, i: F.struct((i + 1).alias("pos"), w.alias("a"), F.get("_w", i + 1).alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    x = x.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    return x.groupBy(key, F.concat_ws(" ", "a", "b").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where(F.col("n") >= least)


def top_phrases(docs: DataFrame, key: str, text: Column, n: int = 8, least: int = 2) -> DataFrame:
    """The n most frequent phrases of each text; ties in order of first use."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return phrases(docs, key, text, least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def search_queries(docs: DataFrame, key: str, text: Column, n: int = 8) -> DataFrame:
    """key, rank, query: the title line, then frequent phrases of the prose before the references, distinct, longer than 3."""
    title = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), r"\s+", " "))
    prose = F.split(text, "## References")[0]
    rows = docs.select(key, title.alias("query"), F.lit(0).alias("rank")).unionByName(top_phrases(docs, key, prose, n).select(key, F.col("phrase").alias("query"), "rank"))
    rows = rows.where(F.length("query") > 3).groupBy(key, F.lower("query").alias("_q")).agg(F.min(F.struct("rank", "query")).alias("_f")).select(key, "_f.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("rank") <= n)


def concepts(keywords: DataFrame) -> DataFrame:
    """concept (first spelling), papers (distinct, sorted) and n (with repeats) of keywords (stem, keyword, pos)."""
    k = F.trim("keyword")
    rows = keywords.where(T.or_empty(k) != "").select("stem", k.alias("keyword"), "pos")
    out = rows.groupBy(F.lower("keyword").alias("_k")).agg(F.min_by("keyword", "pos").alias("concept"), F.array_sort(F.collect_set("stem")).alias("papers"), F.count(F.lit(1)).alias("n"))
    return out.select("concept", "papers", "n")


# Category, label and pattern of the built-in text classification, in their order.
CATEGORIES = {
    "Species": {"Human": "human|patient|clinical|cohort|participant|men|women|subjects", "Rodent": "mice|mouse|rat|rodent|transgenic", "In Vitro": "in vitro|cell culture|slice|primary culture"},
    "Construct": {
        "Identification": "identification|upsit|sniffin|b-sit|identify",
        "Discrimination": "discrimination|discriminate",
        "Detection": "detection|threshold|sensitivity|buried food",
        "Memory": "memory|recall|habituation",
    },
    "Methodology": {
        "Imaging": "fmri|mri|pet|imaging|scan",
        "Behavior": "behavioral|maze|buried food|habituation|sniffin",
        "Electrophysiology": "eeg|lfp|electrophysiology|patch clamp|recording",
        "Manipulation": "optogenetic|chemogenetic|dreadd|chr2",
    },
}


def classified(text: Column, labels: dict[str, str]) -> Column:
    """The label whose pattern occurs most as whole words; the first declared of equals; Unknown if none occurs."""
    counts = [(F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])")), label) for label, p in labels.items()]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-k).alias("o"), F.lit(label).alias("label")) for k, (n, label) in enumerate(counts)]))
    return F.when(best["n"] > 0, best["label"]).otherwise("Unknown")


def crosstab(rows: DataFrame, row: str, column: str, row_labels: list[str], column_labels: list[str]) -> DataFrame:
    """row, column, n, percent of every cell of the grid; percent of the row's total, 0 in an empty row."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in row_labels for b in column_labels], f"{row} string, {column} string")  # the declared labels
    counts = rows.where(F.col(row).isin(row_labels) & F.col(column).isin(column_labels)).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(counts, [row, column], "left").select(row, column, F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))
    return full.withColumn("percent", F.when(total > 0, 100 * F.col("n") / total).otherwise(F.lit(0.0)))
