"""Connected components of an edge table by alternating stars; nothing is gathered on the driver or in one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .exchange import stored


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _is_done(now: DataFrame) -> bool:
    """Whether the edges are stars already: every node has one neighbour below it, and that one has none."""
    again = now.join(now.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return not again.union(now.groupBy("u").count().filter("count > 1").select("u")).head(1)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable.

    `edges` has columns a, b of one orderable type; order, repeats and loops don't matter; an edge with a NULL end is
    no edge. Each round links every node to the smallest node near it (large star, then small star); minima are
    partial aggregates and the joins are ones Spark can split, so a hub with very many neighbours is no hot spot.
    """
    cut = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(edges.filter("a is not null and b is not null and a <> b").select(*cut).distinct(), name)
    while True:
        # large star: neighbours above a node move to the smallest node of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minimum(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and the nodes below it move to the smallest of them
        low = _minimum(large)
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), name)
        if _is_done(now):
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
