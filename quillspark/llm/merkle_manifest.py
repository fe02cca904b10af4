"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for every row.

A leaf is the SHA-256 of a row's fields (null: ``-``; else byte count, ``:``, value). Nodes of a group stand in order;
while there is more than one, every ``fanout`` consecutive nodes (the last run may be shorter) become the hash of their
hex digests. A level is one window by group and parent index: its ordered, full-frame ``collect_list`` gives every node both
the parent's preimage and its siblings, and one node of each run goes on as the parent. A window holds ``fanout`` rows,
so no group is gathered. Places within groups come from range partitions and prefix sums (:func:`ranking.places`).

Paths are handed down from the root: a node's path is its own run and its parent's path, joined by group and parent index,
so that a level's work is a ``fanout``-th of the one below. Levels are tables in the shared folder.

Nulls: a null group key comes first among the groups; a null order key comes first within its group. Rows that tie in the order
key are ordered by their digest; rows equal in all fields have equal digests and share out their places in no fixed order.
An empty table gives no rows. A group of one row has its leaf as subroot; with one group the root is its subroot.
Other columns of the input take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ranking import places

from .common import staged, tune

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
_HEX = 64


def H(c: Column) -> Column:
    """Lower-case hex SHA-256 of a string."""
    return F.sha2(c.cast("binary"), 256)


def preimage(fields: Sequence[Column]) -> Column:
    """What a leaf hashes: of each field ``-`` if null, else its UTF-8 byte count, ``:``, and the value as text."""
    part = lambda s: F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.concat(*[part(c.cast("string")) for c in fields])


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Tables of all levels, leaves first. nodes: _g, _i (from 0), _n (nodes of the group), digest and more.

    Each level adds ``run``, the digests of a node's run as one string. A group that is down to one node passes it up unhashed.
    """
    out, most = [], nodes.agg(F.max("_n")).first()[0] or 1
    parent = F.expr(f"_i div {fanout}")
    while True:
        w = Window.partitionBy("_g", parent).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = staged(nodes.withColumn("run", F.array_join(F.collect_list("digest").over(w), "")), "merkle")
        out.append(level)
        if most <= 1:
            return out
        first = level.where(f"_i % {fanout} = 0")  # one of each run
        up = F.when(F.col("_n") == 1, F.col("digest")).otherwise(H(F.col("run")))
        nodes = first.select("_g", parent.alias("_i"), F.expr(f"(_n + {fanout - 1}) div {fanout}").alias("_n"), up.alias("digest"))
        most = -(-most // fanout)


def _paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Level 0 with the columns of ``tops`` (a row for each _g, with a ``path``) and its own path, an array of (left, right) from the leaf up."""
    more = [c for c in tops.columns if c not in ("_g", "path")]
    down = levels[-1].join(tops, "_g")
    slot = F.expr(f"cast(_i % {fanout} as int)")
    step = F.struct(F.substring("run", F.lit(1), slot * _HEX).alias("left"), F.substring("run", slot * _HEX + _HEX + 1, F.lit(fanout * _HEX)).alias("right"))
    for level in reversed(levels[:-1]):
        above = down.select("_g", F.col("_i").alias("_p"), F.col("path").alias("_path"), *more)
        path = F.when(F.col("_n") == 1, F.col("_path")).otherwise(F.concat(F.array(step), "_path"))
        down = level.withColumn("_p", F.expr(f"_i div {fanout}")).join(above, ["_g", "_p"]).withColumn("path", path).drop("_p", "_path")
    return down


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = FANOUT, extra: dict[str, Column] | None = None) -> DataFrame:
    """``order``'s column, ``leaf``, ``subroot``, ``root`` and ``path`` of every row, and the ``extra`` columns, which are computed over docs.

    path: from the leaf to the root, the siblings' digests to the left and to the right of the node as two strings.
    """
    tune(docs.sparkSession)
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaf = H(preimage([F.col(f) for f in fields]))
    extra = extra or {}
    rows = staged(docs.select(key.alias("_g"), F.col(order).alias("_order"), leaf.alias("digest"), *[c.alias(f"_x_{k}") for k, c in extra.items()]), "leaves")
    nodes = places(rows, ["_order", "digest"], ["_g"], "_place", "_n").withColumn("_i", F.col("_place") - 1).drop("_place")
    levels = _levels(nodes, fanout)
    tops = levels[-1].select(F.col("_g").alias("_group"), F.col("digest"))
    tops = places(tops.withColumn("_all", F.lit("")), ["_group"], ["_all"], "_place", "_n")
    upper = _levels(tops.select(F.col("_all").alias("_g"), (F.col("_place") - 1).alias("_i"), "_n", "digest", "_group"), fanout)
    root = upper[-1].select("_g", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    roots = _paths([upper[0].withColumn("subroot", F.col("digest")), *upper[1:]], root, fanout)
    down = _paths(levels, roots.select(F.col("_group").alias("_g"), "subroot", "root", "path"), fanout)
    return down.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"_x_{k}").alias(k) for k in extra])


def proof(path: Column) -> Column:
    """All siblings of a path in order, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives along a path."""
    return F.aggregate(path, leaf, lambda node, s: H(F.concat(s["left"], node, s["right"])))


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    """The manifest, its proofs as digests, and their check against rows of which a third have their text's A-Z lower-cased."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    forged = F.when(tampered(F.col("doc_id")), F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    now = H(preimage([forged if f == "text" else F.col(f) for f in FIELDS]))
    out = manifest(docs, extra={"now": now})
    out = out.select("doc_id", "leaf", "subroot", "root", H(proof(F.col("path"))).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """The same rows in DuckDB's SQL: levels and paths by recursion, CRC-32 by its definition."""
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END + z)), 4294967295)"
    field = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    forged = "CASE WHEN bad THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce({crc} % 3 = 0, false) AS bad FROM documents),
l AS (SELECT CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, doc_id, {leaf("text")} AS leaf, {leaf(f"({forged})")} AS now FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
low AS (SELECT g, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL SELECT g, level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, level, i // 8),
sub AS (SELECT g, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS level, i, n, digest FROM sub
  UNION ALL SELECT level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 8),
lowrun AS (SELECT g, level, i // 8 AS p, string_agg(digest, '' ORDER BY i) AS run FROM low WHERE n > 1 GROUP BY 1, 2, 3),
highrun AS (SELECT level, i // 8 AS p, string_agg(digest, '' ORDER BY i) AS run FROM high WHERE n > 1 GROUP BY 1, 2),
a AS (SELECT g, doc_id, leaf, row_number() OVER () AS r, 0 AS level, i, now AS node, '' AS proof FROM leaves
  UNION ALL SELECT a.g, doc_id, leaf, r, a.level + 1, a.i // 8, sha256(substr(run, 1, (a.i % 8) * 64) || node || substr(run, (a.i % 8) * 64 + 65)), proof || substr(run, 1, (a.i % 8) * 64) || substr(run, (a.i % 8) * 64 + 65)
  FROM a JOIN lowrun ON lowrun.g = a.g AND lowrun.level = a.level AND lowrun.p = a.i // 8),
b AS (SELECT s.g, s.digest AS subroot, doc_id, leaf, r, 0 AS level, s.i, node, proof FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS k FROM a) x JOIN sub s ON s.g = x.g WHERE k = 1
  UNION ALL SELECT b.g, subroot, doc_id, leaf, r, b.level + 1, b.i // 8, sha256(substr(run, 1, (b.i % 8) * 64) || node || substr(run, (b.i % 8) * 64 + 65)), proof || substr(run, 1, (b.i % 8) * 64) || substr(run, (b.i % 8) * 64 + 65)
  FROM b JOIN highrun ON highrun.level = b.level AND highrun.p = b.i // 8),
top AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS k FROM b), top WHERE k = 1"""
