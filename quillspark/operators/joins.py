"""Joins of many rows to a table of one row a key, whatever the sizes and however often one key occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most this many rows is sent to all tasks.
BROADCAST_ROWS = 100_000
#: A key that holds at least this share of the rows is hot, so there are at most HOT_KEYS of them; its rows are dealt over SALTS places.
HOT_KEYS, SALTS = 1_000, 32


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` left-joined to ``table``, which has at most one row a key. Null keys find nothing.

    The table is counted first: up to ``most`` rows are broadcast. A larger one is joined by a shuffle in which the rows of hot keys
    are dealt over SALTS places and their row of the table goes to each.
    """
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), keys, "left")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = max((counts.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS, 2)
    hot = F.broadcast(counts.where(F.col("_n") >= least).select(*keys, F.lit(True).alias("_hot")))
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    dealt = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(dealt, [*keys, "_salt"], "left").drop("_salt")
