"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges(a, b), as a stored table; a component is named by its smallest node.

    Each round reads the edges written by the one before. Loops and repeated edges are harmless; no edges, no rows.
    """
    e = common.store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # large star: neighbours above a node move to the least of it and its neighbours
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: a node and its neighbours below it move to the least of those
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        last, e = e, common.store(small.select("x.a", "x.b").filter("a <> b").distinct(), "edges")
        common.drop(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = common.store(nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "components")
    common.drop(e)
    return named
