"""Connected components by hooking and pointer jumping; no edge, label or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def roots(parents: DataFrame, most: int = 40) -> DataFrame:
    """(v, c) of a forest parents(v, p), p < v: c is the root above v. Two jumps a job; a path of n steps takes log3(n) jobs.

    parents is a written table, so adaptive execution can split the children of one root.
    """
    now = materialize(parents, "cc-parents")
    for _ in range(most):
        one, two = now.select(F.col("v").alias("p"), F.col("p").alias("p1")), now.select(F.col("v").alias("p1"), F.col("p").alias("p2"))
        up = now.join(one, "p", "left").join(two, "p1", "left")
        now = materialize(up.select("v", F.coalesce("p2", "p1", "p").alias("p"), F.col("p2").isNotNull().alias("more")), "cc-parents")
        if now.where("more").isEmpty():
            return now.select("v", F.col("p").alias("c"))
        now = now.drop("more")
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(v, c) of edges(a, b): c is the smallest vertex of v's component; vertices that are their component's smallest are left out.

    A round hooks each vertex to its smallest smaller neighbour, finds the roots, and keeps the edges between different
    roots. Self loops and repeats are allowed; without edges the result is empty.
    """
    label = None
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
    for _ in range(most):
        found = roots(edges.groupBy("v").agg(F.min("w").alias("p")))
        if label is None:
            label = found
        else:
            moved = label.join(found.select(F.col("v").alias("c"), F.col("c").alias("d")), "c", "left")
            label = moved.select("v", F.coalesce("d", "c").alias("c")).union(found)
        left = edges.join(found, "v", "left").select("w", F.coalesce("c", "v").alias("a"))
        left = left.join(found.select(F.col("v").alias("w"), "c"), "w", "left").select("a", F.coalesce("c", "w").alias("b"))
        edges = materialize(left.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct(), "cc-edges")
        if edges.isEmpty():
            return materialize(label, "components")
    raise RuntimeError("components did not settle")
