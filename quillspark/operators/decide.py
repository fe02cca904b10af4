"""Outcome rules as expressions: cascades and case lists over what is known of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def first_references(**sources: Column) -> Column:
    """struct(refs, source) of the first source with a non-empty list; an empty list counts as a failure."""
    none = F.array().cast("array<string>")
    refs, name = none, F.lit("none")
    for source, c in reversed(sources.items()):
        has = F.coalesce(F.size(c), F.lit(0)) > 0
        refs, name = F.when(has, c).otherwise(refs), F.when(has, F.lit(source)).otherwise(name)
    return F.struct(refs.alias("refs"), name.alias("source"))


def gap_reason(pdf_error: Column, in_epmc: Column, pmcid: Column, doi: Column) -> Column:
    return (
        F.when(T.or_empty(pdf_error) != "", pdf_error)
        .when(in_epmc & (T.or_empty(pmcid) != ""), "no full text at Europe PMC or NCBI efetch, and no OA copy via Unpaywall")
        .when(T.or_empty(doi) != "", "no legal OA copy (paywalled)")
        .otherwise("no DOI and not in Europe PMC")
    )


def fulltext_route(epmc_valid: Column, oa_pdf: Column, efetch_valid: Column) -> Column:
    """The route that gave a valid full text, in order of preference; null if none did."""
    return F.when(epmc_valid, "europepmc-jats").when(oa_pdf, "unpaywall-pdf").when(efetch_valid, "ncbi-efetch-jats")


def identified(explicit: Column, scraped: Column, found: Column, title: Column, page: Column) -> Column:
    """struct(doi, method): given, scraped from the page, found by title (if the page has the title), else manual."""
    confirmed = (T.or_empty(found) != "") & (T.containment(T.word_tokens(title), T.word_tokens(page)) >= 0.6)
    doi = F.coalesce(T.known(explicit), T.known(scraped), F.when(confirmed, found))
    method = F.when(T.or_empty(explicit) != "", "explicit").when(T.or_empty(scraped) != "", "scraped").when(confirmed, "title-search").otherwise("manual")
    return F.struct(doi.alias("doi"), method.alias("method"))


def metadata(first: Column, second: Column) -> Column:
    """The first record if it has a title, else the second if that has one, else null."""
    has = lambda r: r.isNotNull() & (T.or_empty(r["title"]) != "")
    return F.when(has(first), first).when(has(second), second)


def ingest_outcome(doi: Column, title: Column, known_stem: Column, has_file: Column, replace: Column) -> Column:
    return (
        F.when(T.or_empty(doi) == "", "needs-id").when(T.or_empty(title) == "", "unresolved")
        .when(known_stem.isNotNull() & has_file & ~replace, "skip").when(known_stem.isNotNull(), "replaced").otherwise("ingested")
    )


def safe_name(c: Column) -> Column:
    return (T.or_empty(c) != "") & ~c.contains("/") & ~c.contains("..")


def wants_reading(response: Column) -> Column:
    """Verdict of a screening answer."""
    return F.contains(F.upper(T.or_empty(response)), F.lit("INVESTIGATE"))


def citeable(role: Column) -> Column:
    return F.coalesce(role, F.lit("")) != "novelty_screen"


def all_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    """stem, n, present, complete: whether every listed file of papers(stem, files) is among files(name)."""
    listed = papers.select("stem", F.explode_outer("files").alias("name"))
    found = listed.join(files.select("name").distinct().withColumn("_f", F.lit(True)), "name", "left")
    return found.groupBy("stem").agg(F.count("name").alias("n"), F.count_if(F.col("_f")).alias("present")).withColumn("complete", (F.col("n") > 0) & (F.col("n") == F.col("present")))
