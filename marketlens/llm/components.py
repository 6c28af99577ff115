"""Connected components by alternating large-star and small-star rounds, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import cut


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of the undirected edge list ``a``, ``b`` (longs, not null).

    Returns ``node``, ``root`` (the smallest node of its component), one row per node that
    has an edge to another node.  Each round groups and joins on a node with a partial
    minimum, so a hub never gathers its neighbours in one task; rounds are written to the
    shared folder.  The driver sees two numbers a round.  No edges: no rows.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        # large star: every larger neighbour of u goes to the smallest node of u's star
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.join(low, edges["b"] == low["u"]).select(F.col("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours and u itself go to the smallest of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = cut(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
