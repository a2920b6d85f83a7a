"""Leaves of a k-d tree, for rays to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import AXES
from lattica.storage import materialise

#: The upper two bits of a node's second number are its axis, or LEAF; the others its first child or number of primitives.
#: Fixed values.
LEAF, LOWER = 3, (1 << 30) - 1


def tree_leaves(nodes: DataFrame, low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """(idx, first_prim, n_prims, lx..hz) of a tree's leaves, from nodes (idx, split, bits) and the bounds of its root.

    The tree is gone down level by level: each is one join of the nodes it reaches. Planes are signed whole numbers; a
    node's children stand one after the other, the lower side first. An empty table has no leaves.
    """
    signed = F.when(F.col("split") >= 1 << 31, F.col("split") - (1 << 32)).otherwise(F.col("split"))
    own = nodes.select("idx", "split", signed.cast("double").alias("plane"), F.shiftright("bits", 30).cast("int").alias("axis"), F.col("bits").bitwiseAND(F.lit(LOWER)).alias("rest"))
    sides = [f"{s}{a}" for s in "lh" for a in AXES]
    reached = nodes.where("idx = 0").select("idx", *[F.lit(float(v)).alias(n) for n, v in zip(sides, (*low, *high))])
    leaves: DataFrame | None = None
    while True:
        here = materialise(reached.join(own, "idx"))
        done = here.where(F.col("axis") == LEAF).select("idx", F.col("split").alias("first_prim"), F.col("rest").alias("n_prims"), *sides)
        leaves = done if leaves is None else leaves.unionByName(done)
        inner = here.where(F.col("axis") < LEAF)
        if inner.isEmpty():
            return leaves
        both = inner.withColumn("_far", F.explode(F.array(F.lit(0), F.lit(1))))
        cut = {}
        for k, a in enumerate(AXES):
            mine = F.col("axis") == k
            cut[f"l{a}"] = F.when(mine & (F.col("_far") == 1), F.greatest(f"l{a}", "plane")).otherwise(F.col(f"l{a}"))
            cut[f"h{a}"] = F.when(mine & (F.col("_far") == 0), F.least(f"h{a}", "plane")).otherwise(F.col(f"h{a}"))
        reached = both.withColumns(cut).select((F.col("rest") + F.col("_far")).alias("idx"), *sides)
