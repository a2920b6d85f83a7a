"""Clusters of neighbours along a space-filling curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.codes import hilbert, morton, quantised
from lattica.operators.numbering import dense_ids, ordinal
from lattica.storage import materialise

AXES = ("x", "y", "z")


def centroid_bounds(boxes: DataFrame) -> DataFrame:
    """One row (low, high): the least and largest coordinate of box centres over all axes, so that all scale alike."""
    centre = [(F.col(f"l{a}") + F.col(f"h{a}")) / 2 for a in AXES]
    return boxes.agg(F.min(F.least(*centre)).alias("low"), F.max(F.greatest(*centre)).alias("high"))


def with_codes(points: DataFrame, key: str, low: float, high: float, curve: str = "hilbert") -> DataFrame:
    """Points (key, x, y, z[, w]) with their code on the curve; Morton codes take the fourth axis in if there is one."""
    axes = [a for a in ("x", "y", "z", "w") if a in points.columns]
    steps = [quantised(F.col(a), low, high) for a in axes]
    code = morton(steps) if curve == "morton" else hilbert(*steps[:3])
    return points.withColumn("code", code)


def sorted_by_code(points: DataFrame, key: str, partitions: int) -> DataFrame:
    """The physical order for writing: ranges of codes, sorted inside."""
    return points.repartitionByRange(partitions, "code", key).sortWithinPartitions("code", key)


def with_rank(points: DataFrame, key: str) -> DataFrame:
    """Place of each point in code order, ties by key, however the codes are spread."""
    return ordinal(points, ["code", key], "rank")


def merge(ranked: DataFrame, most: int) -> DataFrame:
    """(rank, cluster): neighbours in rank order joined until no pair fits.

    Clusters start as single points. Each round an odd-numbered cluster joins the even one before it if both have most
    points or fewer together; the rest are numbered anew. It ends when a round joins nothing. Clusters, not points,
    go through the rounds, and a cluster is a range of ranks.
    """
    clusters = materialise(ranked.select(F.col("rank").alias("c"), F.col("rank").alias("first"), F.lit(1).cast("long").alias("n")))
    while True:
        pair = F.floor(F.col("c") / 2).cast("long")
        fits = clusters.groupBy(pair.alias("pair")).agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("k"), F.min("first").alias("low"))
        joined = fits.where((F.col("k") == 2) & (F.col("both") <= most))
        if joined.isEmpty():
            break
        apart = clusters.withColumn("pair", pair).join(joined.select("pair"), "pair", "left_anti").select("first", "n")
        clusters = materialise(dense_ids(apart.unionByName(joined.select(F.col("low").alias("first"), F.col("both").alias("n"))), "first", "c"))
    ranges = clusters.select(F.col("c").alias("cluster"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    return ranges.select("rank", "cluster")


def cluster_boxes(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n, lx..hz) over the points (rank, x, y, z) of each cluster."""
    return points.join(clusters.hint("merge"), "rank").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"l{a}") for a in AXES], *[F.max(a).alias(f"h{a}") for a in AXES])
