"""Triage: sections as of a position, proximity of names and years, tiers, decisions that outlive a rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.ranking import carried, places


def as_of(mentions: DataFrame, headings: DataFrame, by: list[str], order: list[str], value: str, ties: bool = True) -> DataFrame:
    """mentions with the ``value`` of the last heading at or before them (ties=False: strictly before), per ``by`` group.

    One union and one segmented scan: no pair of a mention and a heading is built, and a group of any size is shared out.
    """
    h = headings.select(*by, *order, F.col(value).alias("_v"), F.lit(0 if ties else 1).alias("_side"), F.lit(None).alias("_row"))
    m = mentions.select(*by, *order, F.lit(None).cast(headings.schema[value].dataType).alias("_v"), F.lit(1 if ties else 0).alias("_side"), F.struct(*mentions.columns).alias("_row"))
    both = m.unionByName(h.withColumn("_row", F.lit(None).cast(m.schema["_row"].dataType)))
    return carried(both, F.col("_v"), [*order, "_side"], by, value).where("_row is not null").select("_row.*", value)


def near(references: DataFrame, mentions: DataFrame, name: str, year: str, slack: int = 1) -> DataFrame:
    """references joined to mentions of their name whose year differs by at most ``slack``; an unknown year matches all.

    An equi-join on the name: mentions are extracted once, not searched for each reference.
    """
    m = mentions.withColumnsRenamed({year: "_year", name: "_name"})
    close = F.col(year).isNull() | (F.abs(F.col("_year") - F.col(year)) <= slack)
    return references.where(F.length(name) >= 2).join(m, (F.col(name) == F.col("_name")) & close)


def tier(year: Column, sections: Column, cut: Column, has_meta: Column, current_from: int = 2021) -> Column:
    """Proposed tier of a reference from its year and the sections that cite it."""
    return (
        F.when(~has_meta, "unknown")
        .when(F.coalesce(F.size(sections), F.lit(0)) <= 0, "cut")
        .when(F.size(F.array_except(sections, cut)) == 0, "cut")
        .when(F.coalesce(year, F.lit(0)) >= current_from, "current")
        .otherwise("replace")
    )


def keep_decisions(rows: DataFrame, prior: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """rows with the decision columns of a prior run, all of them together, where any was set there (blanks included)."""
    norm = F.lower(F.trim(key))
    kept = {c: F.trim(T.or_empty(F.col(c))) for c in columns}
    old = prior.select(norm.alias("_key"), *[v.alias(f"_{c}") for c, v in kept.items()]).where(" or ".join(f"_{c} <> ''" for c in columns)).where("_key <> ''").dropDuplicates(["_key"])
    out = rows.join(old, norm == F.col("_key"), "left")
    return out.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def carried_over(approved: DataFrame, fresh: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """Approved rows that fell out of the fresh list and are not in the library."""
    return approved.join(fresh.select(key).distinct(), key, "left_anti").join(library.select(key).distinct(), key, "left_anti")


def worklist(rows: DataFrame) -> DataFrame:
    """Rows with a tier other than cut and no full text, numbered within their tier.

    Years are compared as text, a blank one as 0.
    """
    rank = F.when(F.col("tier") == "record", 0).when(F.col("tier") == "seminal", 1).when(F.col("tier") == "replace", 2).when(F.col("tier") == "current", 3).otherwise(9)
    need = rows.where((T.or_empty(F.col("tier")) != "") & (F.col("tier") != "cut") & ~F.coalesce("have", F.lit(False))).withColumn("tier_rank", rank)
    return places(need, [*worklist_order()], ["tier"], "number")


def worklist_order() -> list[str | Column]:
    """The order within a tier."""
    return [F.coalesce(T.known(F.col("year")), F.lit("0")), "author", "id"]
