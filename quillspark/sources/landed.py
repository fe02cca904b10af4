"""Projections of landed service answers (JSON texts): what a connector has fetched is a table of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

WORK = "struct<id:string,doi:string,title:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,primary_location:struct<source:struct<display_name:string>>,cited_by_count:bigint,abstract:string>"
MESSAGE = "struct<message:struct<title:array<string>,author:array<struct<family:string,given:string>>,`container-title`:array<string>,type:string,`is-referenced-by-count`:bigint,issued:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,created:struct<`date-parts`:array<array<int>>>,institution:array<struct<name:string>>,publisher:string,reference:array<struct<DOI:string>>>>"
HITS = "struct<resultList:struct<result:array<struct<source:string,pmid:string,pmcid:string,doi:string,title:string,authorString:string,pubYear:string,isOpenAccess:string,inEPMC:string>>>>"


def works(payload: Column) -> Column:
    """A work's flat fields, unknown ones ''."""
    w = F.from_json(payload, WORK)
    return F.struct(
        T.doi_without_resolver(w["doi"]).alias("doi"), T.or_empty(w["title"]).alias("title"), T.last_word(F.get(w["authorships"], F.lit(0))["author"]["display_name"]).alias("author"),
        T.or_empty(w["publication_year"].cast("string")).alias("year"), T.or_empty(w["primary_location"]["source"]["display_name"]).alias("venue"), F.coalesce(w["cited_by_count"], F.lit(0)).alias("cites"),
        T.or_empty(w["abstract"]).alias("abstract"),
    )


def screening(rows: DataFrame, payload: str) -> DataFrame:
    """Works of a broad search that have a doi and an abstract, the doi as a URL."""
    w = rows.select(works(F.col(payload)).alias("w")).where("w.doi <> '' and w.abstract <> ''")
    return w.select(T.doi_as_url(F.col("w.doi")).alias("doi"), "w.title", "w.year", "w.abstract")


def first_hit(payload: Column) -> Column:
    """The first search hit as a record of texts and two flags; null if none."""
    h = F.get(F.from_json(payload, HITS)["resultList"]["result"], F.lit(0))
    texts = [T.or_empty(h[a]).alias(b) for a, b in (("source", "source"), ("pmid", "pmid"), ("pmcid", "pmcid"), ("doi", "doi"), ("title", "title"), ("authorString", "authors"), ("pubYear", "year"))]
    return F.when(h.isNotNull(), F.struct(*texts, F.coalesce(h["isOpenAccess"] == "Y", F.lit(False)).alias("is_oa"), F.coalesce(h["inEPMC"] == "Y", F.lit(False)).alias("in_epmc")))


def publication_year(message: Column) -> Column:
    """print, then online, then issued, then created."""
    year = lambda f: F.get(F.get(message[f]["date-parts"], F.lit(0)), F.lit(0))
    return F.coalesce(*[year(f) for f in ("published-print", "published-online", "issued", "created")])


def reduced(payload: Column) -> Column:
    """year, first_author, journal, title, type, crossref_citations of a registry answer; null without a message."""
    m = F.from_json(payload, MESSAGE)["message"]
    at = lambda f: T.or_empty(F.get(m[f], F.lit(0)))
    return F.when(m.isNotNull(), F.struct(F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"), T.or_empty(F.get(m["author"], F.lit(0))["family"]).alias("first_author"), at("container-title").alias("journal"), at("title").alias("title"), T.or_empty(m["type"]).alias("type"), F.coalesce(m["is-referenced-by-count"], F.lit(0)).alias("crossref_citations")))


def references(payload: Column) -> Column:
    """Distinct cited DOIs in order, first spelling."""
    dois = F.filter(F.transform(F.from_json(payload, MESSAGE)["message"]["reference"], lambda r: F.trim(r["DOI"])), lambda d: d != "")
    low = F.transform(dois, lambda d: F.lower(d))
    return F.filter(dois, lambda d, i: F.array_position(low, F.lower(d)) == i + 1)


def preprint_venue(payload: Column) -> Column:
    """The server that hosts a preprint; null for other works."""
    m = F.from_json(payload, MESSAGE)["message"]
    return F.when(m["type"] == "posted-content", T.known(F.trim(F.coalesce(T.known(F.get(m["institution"], F.lit(0))["name"]), m["publisher"]))))


def open_access_url(payload: Column) -> Column:
    """The best location's PDF address, else its address."""
    best = F.from_json(payload, "struct<best_oa_location:struct<url_for_pdf:string,url:string>>")["best_oa_location"]
    return F.coalesce(T.known(best["url_for_pdf"]), T.known(best["url"]))


def title_match(payload: Column) -> Column:
    """doi and first title of a title search's first hit; null without a hit."""
    hit = F.get(F.from_json(payload, "struct<message:struct<items:array<struct<DOI:string,title:array<string>>>>>")["message"]["items"], F.lit(0))
    return F.when(hit.isNotNull(), F.struct(T.or_empty(hit["DOI"]).alias("doi"), T.or_empty(F.get(hit["title"], F.lit(0))).alias("title")))
