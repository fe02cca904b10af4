"""Citation keys, identifier resolution, ordered dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.ranking import places


def suffixed(base: Column, number: Column) -> Column:
    """The first of a base is bare, then a to z, then numbers within the base."""
    return F.when(number == 1, base).when(number <= 27, F.concat(base, F.chr(F.lit(95) + number))).otherwise(F.concat(base, number.cast("string")))


def assign_keys(papers: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Adds ``key``: the base made unique, in the given order. A base of any number of papers is numbered by many tasks."""
    return places(papers, order, [base], "_n").withColumn("key", suffixed(F.col(base), F.col("_n"))).drop("_n")


def resolve_identifiers(records: DataFrame, identifiers: DataFrame, ids: tuple[str, ...] = ("doi", "pmid", "pmcid")) -> DataFrame:
    """Left join to identifiers(id, stem and perhaps pos) by the first of ``ids`` that is known there.

    Of several rows of one id the last counts (without pos: the one with the largest stem), so a record stays one row.
    """
    out, last = records, F.col("pos") if "pos" in identifiers.columns else F.col("stem")
    one = identifiers.where(T.known(F.col("id")).isNotNull()).groupBy("id").agg(F.max_by("stem", last).alias("stem"))
    for k, c in enumerate(ids):
        known = one.select(F.col("id").alias(f"_id{k}"), F.col("stem").alias(f"_s{k}"))
        out = out.join(known, T.known(F.col(c)) == F.col(f"_id{k}"), "left")
    return out.withColumn("stem", F.coalesce(*[f"_s{k}" for k in range(len(ids))])).drop(*[x for k in range(len(ids)) for x in (f"_id{k}", f"_s{k}")])


def id_map(identifiers: DataFrame, entries: DataFrame) -> DataFrame:
    """doi and stem: the last of identifiers(id, stem, pos) wins; entries(doi, stem, pos) only fill gaps."""
    both = identifiers.select(F.lower("id").alias("doi"), "stem", F.lit(0).alias("_rank"), (-F.col("pos")).alias("_pos")).unionByName(entries.select(F.lower("doi").alias("doi"), "stem", F.lit(1).alias("_rank"), F.col("pos").alias("_pos")))
    return both.where("doi <> ''").groupBy("doi").agg(F.min_by("stem", F.struct("_rank", "_pos")).alias("stem"))


def first_spellings(rows: DataFrame, group: list[str], value: str, pos: str) -> DataFrame:
    """One row per group and case-insensitive value: its first spelling and place. Blanks and nulls are dropped."""
    v = F.trim(value)
    clean = rows.where(T.or_empty(v) != "").select(*group, v.alias(value), F.col(pos))
    return clean.groupBy(*group, F.lower(value).alias("_key")).agg(F.min(F.struct(pos, value)).alias("_f")).select(*group, "_f.*")


def ordered_list(rows: DataFrame, group: list[str], value: str, pos: str, name: str) -> DataFrame:
    """The values of each group as an array in order of ``pos``."""
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("_l")).select(*group, F.transform("_l", lambda x: x[value]).alias(name))


def append_once(items: Column, item: Column) -> Column:
    """The array with the item at its end unless it is there."""
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))
