"""A cost-driven partition of space into boxes with tight majorants, grown by fronts of leaves."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.geometry import AXES
from lattica.functions.transfer import majorant
from lattica.operators import pyramid as P
from lattica.operators.joins import by_key
from lattica.storage import materialise

#: Planes that are tried on each axis are the inner ones of so many bins. A fixed value.
BINS = 8
SIDES = P.SIDES


def size(low: list[Column], high: list[Column]) -> Column:
    """Surface times diagonal: how likely a ray meets a box, and how long it stays."""
    x, y, z = (h - l for l, h in zip(low, high))
    return F.lit(2.0) * (x * y + y * z + z * x) * F.sqrt(x * x + y * y + z * z)


def _halves(leaves: DataFrame) -> DataFrame:
    """leaves with axis, k, at and side for each half that a plane would make: 42 a leaf at most, with its box as a_lx..a_hz."""
    axis = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    step = F.element_at(F.array(*[(F.col(f"h{a}") - F.col(f"l{a}")) / BINS for a in AXES]), F.col("axis") + 1)
    tried = leaves.withColumn("axis", axis).withColumn("_step", step).where("_step > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(BINS - 1))))
    low = F.element_at(F.array(*[f"l{a}" for a in AXES]), F.col("axis") + 1)
    tried = tried.withColumn("at", low + F.col("k") * F.col("_step")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    cut = lambda i, side, c: F.when((F.col("axis") == i) & (F.col("side") == side), F.col("at")).otherwise(F.col(c))
    return tried.select("path", "depth", "axis", "k", "side", *[cut(i, 1, f"l{a}").alias(f"a_l{a}") for i, a in enumerate(AXES)], *[cut(i, 0, f"h{a}").alias(f"a_h{a}") for i, a in enumerate(AXES)])


def _children(leaves: DataFrame, pyramid: P.Pyramid, entries: list, domain: tuple[float, float]) -> DataFrame:
    """Both halves of each leaf at its best plane: that for which sizes times majorants add up to least, then the first by axis and place."""
    halves = materialise(_halves(leaves).withColumn("probe_id", F.struct("path", "axis", "k", "side")))  # probed, and then met by what was found
    valued = P.ranges(pyramid, halves).select("probe_id", majorant(F.col("vmin"), F.col("vmax"), entries, *domain).alias("_m"))
    corner = lambda s: [F.col(f"a_{s}{a}") for a in AXES]
    costed = by_key(halves, valued, "probe_id", "left").withColumn("majorant", F.coalesce("_m", F.lit(0.0))).withColumn("cost", size(corner("l"), corner("h")) * F.col("majorant"))
    half = F.struct("side", *[F.col(f"a_{s}").alias(s) for s in SIDES], "majorant", "cost")
    planes = costed.groupBy("path", "depth", "axis", "k").agg(F.max(F.when(F.col("side") == 0, half)).alias("a"), F.max(F.when(F.col("side") == 1, half)).alias("b"))
    best = planes.groupBy("path", "depth").agg(F.min_by(F.array("a", "b"), F.struct(F.col("a.cost") + F.col("b.cost"), "axis", "k")).alias("parts"))
    each = best.select("path", "depth", F.explode("parts").alias("p"))
    return each.select(F.concat("path", F.col("p.side").cast("string")).alias("path"), (F.col("depth") + 1).alias("depth"), *[F.col(f"p.{s}").alias(s) for s in SIDES], "p.majorant", "p.cost")


def build(spark: SparkSession, boxes: DataFrame, low: tuple[float, ...], high: tuple[float, ...], entries: list, domain: tuple[float, float], leaves: list[int]) -> DataFrame:
    """(leaves, domain_id, lx..hz, majorant): the tree's leaves at each requested number of them.

    boxes (b_lx..b_hz, b_vmin, b_vmax) are the volume. The tree splits the costliest leaf next (ties: the one less deep, then the
    lower side); a leaf's cost is its size times its majorant. A half costs no more than the whole, so the first n - 1 splits are
    those of the n - 1 costliest boxes of the whole tree: each round splits all leaves that are among the n - 1 costliest
    boxes known, in one go, until none is left. Rounds grow with the tree's depth. A box without extent isn't split; where all
    leaves are such, there are fewer leaves than asked for.
    """
    targets = sorted(set(leaves))
    most = targets[-1] - 1
    held = P.build(boxes)
    top = [("", 0, *map(float, low), *map(float, high), 1.0, math.inf)]
    kinds = "path string, depth int, " + ", ".join(f"{s} double" for s in SIDES) + ", majorant double, cost double"
    all_ = spark.createDataFrame(top, kinds).withColumn("split", F.lit(False))
    order = [F.desc("cost"), F.asc("depth"), F.asc("path")]
    extent = " OR ".join(f"h{a} > l{a}" for a in AXES)
    while most > 0:
        costliest = all_.where(extent).orderBy(*order).limit(most)
        front = costliest.where("NOT split").drop("split")
        if not front.take(1):
            break
        # the table has some rows a leaf that was asked for, so it is written anew in each round
        now = all_.join(front.select("path", F.lit(True).alias("_now")), "path", "left").withColumn("split", F.col("split") | F.coalesce("_now", F.lit(False))).drop("_now")
        all_ = materialise(now.unionByName(_children(front, held, entries, domain).withColumn("split", F.lit(False))).coalesce(1))
    out = []
    for n in targets:
        cut = all_.where(extent).orderBy(*order).limit(n - 1).select("path")
        parents = all_.withColumn("_p", F.col("path")).select("_p", "path", *SIDES, "majorant")
        reached = parents.withColumn("_up", F.expr("CASE WHEN path = '' THEN NULL ELSE substring(path, 1, length(path) - 1) END"))
        alive = reached.join(cut.withColumnRenamed("path", "_up"), "_up", "left_semi").unionByName(reached.where("path = ''"))
        out.append(alive.join(cut, "path", "left_anti").select(F.lit(n).alias("leaves"), *SIDES, "majorant"))
    by = Window.partitionBy("leaves").orderBy(*SIDES)
    return reduce(DataFrame.unionByName, out).withColumn("domain_id", F.row_number().over(by).cast("long") - 1).select("leaves", "domain_id", *SIDES, "majorant")
