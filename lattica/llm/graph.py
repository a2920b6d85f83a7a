"""Connected components by contraction; edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is one vertex of its component, the same for all.

    Each round hooks every vertex to its smallest neighbour, jumps one pointer further and contracts the edges;
    rounds grow with the logarithm of a component's size. Minima are combined on the map side, and the joins on
    a hub's many edges are plain sort-merge joins, which adaptive execution splits.
    """
    edges = edges.select("a", "b").where("a <> b")
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("p")))
        jump = hook.join(hook.select(F.col("v").alias("p"), F.col("p").alias("root")), "p").select("v", "root")
        jump = materialise(jump)
        if roots is None:
            roots = jump
        else:
            step = jump.select(F.col("v").alias("root"), F.col("root").alias("_new"))
            roots = materialise(roots.join(step, "root", "left").select("v", F.coalesce("_new", "root").alias("root")))
        to_a, to_b = jump.select(F.col("v").alias("a"), F.col("root").alias("_a")), jump.select(F.col("v").alias("b"), F.col("root").alias("_b"))
        edges = materialise(edges.join(to_a, "a").join(to_b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        if edges.isEmpty():
            return roots
