"""The citation graph: coupling, direct citations, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ranking import places
from quillspark.staging import staged


#: Papers with more shared works than this don't carry their list of works along; their pairs are counted one work at a time.
LONG = 64


def coupling(cites: DataFrame, least: int = 2, hot: int = 1_000, long: int = LONG) -> DataFrame:
    """a, b and shared for pairs of papers (a < b) that cite at least ``least`` works in common.

    An overlap prefix join. A paper's works are ordered from the least to the most cited; papers with ``least`` works in common
    share one that is not among the last ``least`` - 1 of either. So those last ones seed no pair, and no work that only one paper cites does. A paper
    brings the rest of its list behind each seed, so that a pair is counted exactly where it is met and only
    pairs that hold leave the join: the one met at its first common work has the whole count. Papers of more than ``long`` works
    are joined to all others on single works and counted by a shuffle instead.

    A 64-bit signature of the rest comes first: lists that share no bit share no work.

    Works cited by more than ``hot`` papers are salted: one famous work is joined by many tasks.
    """
    live = _live(cites, least)
    most = live.agg(F.max("_d").alias("d"), F.max("_s").alias("s")).first()
    lists = live.where(F.col("_s") <= long).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("_d", "cited"))).alias("_l"))
    seeds = lists.select("stem", "_l", F.posexplode(F.slice("_l", F.lit(1), F.size("_l") - (least - 1))).alias("_at", "_e"))
    rest = F.transform(F.slice("_l", F.col("_at") + 2, F.size("_l")), lambda e: e["cited"])
    bits = F.aggregate("_r", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    seeds = seeds.select("stem", F.col("_e.cited").alias("cited"), F.col("_e._d").alias("_d"), rest.alias("_r"))
    salted = (most["d"] or 0) > hot
    met = _meet(seeds.withColumn("_sig", bits), None, hot, salted)
    shared = F.size(F.array_intersect("_ra", "_rb")) + 1
    near = F.col("_sa").bitwiseAND(F.col("_sb")) != 0 if least > 1 else F.lit(True)
    found = met.where((F.col("a") < F.col("b")) & near & (shared >= least)).groupBy("a", "b").agg(F.max(shared).cast("bigint").alias("shared"))
    if (most["s"] or 0) <= long:
        return found
    some = lambda rows, r: rows.select("stem", "cited", "_d", r.alias("_r"), F.lit(0).cast("bigint").alias("_sig"))
    one = _meet(some(live.where(F.col("_s") > long), F.lit(True)), some(live, F.col("_s") > long), hot, salted).where("a <> b and (not _rb or a < b)")
    more = one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return found.unionByName(more)


def _live(cites: DataFrame, least: int) -> DataFrame:
    """stem, cited, _d papers that cite the work, _s works of the stem. Works that one paper alone cites are left out, then papers of fewer than ``least`` works."""
    edges = cites.select("stem", "cited").where("stem is not null and cited is not null").distinct()
    degree = edges.groupBy("cited").agg(F.count(F.lit(1)).alias("_d")).where("_d > 1")
    return staged(edges.join(degree, "cited").withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy("stem"))).where(F.col("_s") >= least))


def _meet(left: DataFrame, right: DataFrame | None, hot: int, salted: bool) -> DataFrame:
    """a, _ra, _sa, b, _rb, _sb of the rows (stem, cited, _d, _r, _sig) that share a cited work."""
    right = left if right is None else right
    x = left.select("cited", F.col("stem").alias("a"), F.col("_r").alias("_ra"), F.col("_sig").alias("_sa"), *(["_d"] if salted else []))
    y = right.select(F.col("cited").alias("_c"), F.col("stem").alias("b"), F.col("_r").alias("_rb"), F.col("_sig").alias("_sb"), *(["_d"] if salted else []))
    if not salted:
        return x.join(y, F.col("cited") == F.col("_c"))
    salts = F.ceil(F.col("_d") / hot).cast("int")
    x = x.withColumn("_x", F.pmod(F.xxhash64("a"), salts).cast("int")).drop("_d")
    y = y.withColumn("_y", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_d")
    return x.join(y, (F.col("cited") == F.col("_c")) & (F.col("_x") == F.col("_y")))


def labelled(pairs: DataFrame, cites: DataFrame, own: DataFrame) -> DataFrame:
    """stem, other, shared, note: each pair seen from both ends. own: stem and doi.

    note: "cites this" when the stem cites the other, else "cited here" when the other cites the stem.
    """
    both = pairs.select(F.col("a").alias("stem"), F.col("b").alias("other"), "shared").unionByName(pairs.select(F.col("b").alias("stem"), F.col("a").alias("other"), "shared"))
    direct = cites.select("stem", F.col("cited").alias("doi")).distinct().join(own.where("doi is not null").select("doi", F.col("stem").alias("other")), "doi").select("stem", "other").distinct()
    out = direct.select("stem", "other", F.lit(True).alias("_out"))
    back = direct.select(F.col("other").alias("stem"), F.col("stem").alias("other"), F.lit(True).alias("_in"))
    return both.join(out, ["stem", "other"], "left").join(back, ["stem", "other"], "left").select("stem", "other", "shared", F.when(F.col("_in"), "cites this").when(F.col("_out"), "cited here").otherwise("").alias("note"))


def neighbours(seeds: DataFrame, cites: DataFrame) -> DataFrame:
    """seed, other, direction: works that seeds (stem) cite (out), and papers that cite a seed (in)."""
    out = cites.join(seeds.select(F.col("stem").alias("seed")), F.col("stem") == F.col("seed")).select("seed", F.col("cited").alias("other"), F.lit("out").alias("direction"))
    back = cites.join(seeds.select(F.col("stem").alias("seed")), F.col("cited") == F.col("seed")).select("seed", F.col("stem").alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def ranked(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """Every row with its ``rank`` in its group; no task needs a whole group. order: columns, or (column, True) for falling order."""
    return places(rows, order, group, "rank")


def top(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
