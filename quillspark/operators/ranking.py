"""Places in an order, and values carried along it, without a task that holds a whole group.

Rows are range-partitioned on group and order and sorted within their partitions, which are written once. What the
partitions must know of each other is one row for each partition and each group in it; prefix sums over those rows
(at most a row a partition for any one group) replace a window over the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.staging import staged

#: Spans (a row for each partition and group in it) up to this many are sent to all tasks; more are joined by a shuffle.
BROADCAST_SPANS = 100_000

_ROW = 33  # monotonically_increasing_id() holds the partition above this bit and the row's number in it below


def _blocks(rows: DataFrame, by: list[Column], order: list[Column], extra: dict[str, Column], parts: int | None) -> DataFrame:
    """rows with _by (a struct, never null), the extra columns, _block and _at (number in the block), in order within blocks."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.withColumns({"_by": F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("k0")]), **extra})
    x = x.withColumns({f"_o{i}": c for i, c in enumerate(o[0] for o in order)})
    keys = [F.col("_by"), *[F.col(f"_o{i}").desc() if down else F.col(f"_o{i}").asc() for i, (_, down) in enumerate(order)]]
    x = x.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    x = x.select(*rows.columns, "_by", *extra, F.shiftright("_id", _ROW).alias("_block"), F.col("_id").bitwiseAND(F.lit((1 << _ROW) - 1)).alias("_at"))
    return staged(x)


def _orders(order: list) -> list[tuple[Column, bool]]:
    return [(F.col(o[0]) if isinstance(o[0], str) else o[0], o[1]) if isinstance(o, tuple) else (F.col(o) if isinstance(o, str) else o, False) for o in order]


def _joined(rows: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.withColumnsRenamed({"_by": "_sb", "_block": "_sk"})
    side = F.broadcast(spans) if spans.limit(BROADCAST_SPANS + 1).count() <= BROADCAST_SPANS else spans
    return rows.join(side, (F.col("_block") == F.col("_sk")) & F.col("_by").eqNullSafe(F.col("_sb"))).drop("_sb", "_sk")


def places(rows: DataFrame, order: list, by: list[str | Column] = (), name: str = "place", size: str | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` among the rows of their group, and the group's ``size`` if a name is given.

    order: columns, or (column, True) for falling order; nulls come first, or last in falling order. Rows that tie in all of
    it get different places in no particular order. ``by``: the groups' keys (a null is a key like any other); none: all rows are one group.
    """
    groups = [F.col(c) if isinstance(c, str) else c for c in by]
    x = _blocks(rows, groups, _orders(list(order)), {}, parts)
    w = Window.partitionBy("_by")
    spans = staged(x.groupBy("_by", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_by", "_block", (before - F.col("_first") + 1).alias("_shift"), *([F.sum("_n").over(w).alias("_size")] if size else []))
    out = _joined(x, spans)
    return out.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name), *([F.col("_size").alias(size)] if size else []))


def carried(rows: DataFrame, value: Column, order: list, by: list[str | Column] = (), name: str = "carried", parts: int | None = None) -> DataFrame:
    """``rows`` with the last ``value`` that is not null at or before them in ``order`` within their group; null before any.

    A segmented scan: within a block by a window over (group, block), across blocks by one row a span.
    """
    groups = [F.col(c) if isinstance(c, str) else c for c in by]
    x = _blocks(rows, groups, _orders(list(order)), {"_value": value}, parts)
    spans = staged(x.groupBy("_by", "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_last")))
    w = Window.partitionBy("_by").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_by", "_block", F.last("_last", ignorenulls=True).over(w).alias("_before"))
    here = F.last("_value", ignorenulls=True).over(Window.partitionBy("_by", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return _joined(x.withColumn("_here", here), spans).select(*rows.columns, F.coalesce("_here", "_before").alias(name))
