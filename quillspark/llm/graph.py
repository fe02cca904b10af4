"""Connected components by distributed minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (columns a, b).

    Each round links every node and its neighbours to the least label among them, then halves paths;
    rounds grow with the logarithm of a chain's length. Each round is written to the shared folder.
    """
    pairs = edges.select("a", "b").where(F.col("a") != F.col("b"))
    links = staged(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # larger neighbours hang on the least of a node's neighbourhood
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        hung = both.join(low, "a").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        hung = hung.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        # every node keeps its least parent; its other parents hang on that one
        least = hung.groupBy("a").agg(F.min("b").alias("low"))
        new = hung.join(least, "a").where("b <> low").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        new = staged(new.union(least.select("a", F.col("low").alias("b"))).distinct(), "links")
        done = new.count() == links.count() and new.join(links, ["a", "b"], "left_anti").isEmpty()
        unstage(links)
        links = new
        if done:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
