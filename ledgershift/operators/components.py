"""Connected components by alternating large and small stars; no edge, label or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, c) of edges(a, b): c is the smallest vertex of v's component. Vertices that are that smallest one, or stand in no edge, are left out.

    Loops, repeats and either direction are allowed; without edges the result is empty. Each round ties the larger
    neighbours of a vertex, then the smaller ones, to its smallest neighbour; both sums are combined before they are sent.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    last = None
    for _ in range(most):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(least.select("u", "m")).distinct(), "small-star")
        now = _sum(edges)
        if now == last:
            return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c"))
        last = now
    raise RuntimeError("components did not settle")
