"""A pyramid of value ranges over boxes: probes take a block's summary where it lies within, and go down where they cut it.

Boxes are dealt to blocks of space by their lower corners, blocks to blocks of twice the edge, up to a few. A block knows the
bounds and the range of the values of its boxes. Where all boxes of a block begin before a probe
ends and end after it begins, on each axis, each of them shares volume with it, so the summary is exact; a block out of reach is dropped;
only blocks that the probe cuts are looked into, and in the lowest ones the boxes themselves are tested.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import AXES
from lattica.operators.joins import by_key
from lattica.storage import materialise

SIDES = ("lx", "ly", "lz", "hx", "hy", "hz")
BLOCK = ("_kx", "_ky", "_kz")
#: Boxes that a lowest block has on average, and blocks of a level that may be broadcast (some 100 bytes each). More would be
#: held by the driver, once for each level of each call.
FILL, BROADCAST = 32, 1_000
#: Levels above the lowest, at most.
LEVELS = 40


@dataclass(frozen=True)
class Pyramid:
    """levels: from the lowest up, blocks with bounds (l*, h*), the largest lower (m*) and smallest upper corners (n*), vmin, vmax and a mask of children."""

    boxes: DataFrame
    levels: list[DataFrame]
    sizes: list[int]


def build(boxes: DataFrame, fill: int = FILL) -> Pyramid:
    """boxes: b_lx..b_hz, b_vmin, b_vmax. Boxes without volume, and null or NaN values, don't count."""
    sound = boxes.where(" AND ".join(f"b_l{a} < b_h{a}" for a in AXES)).where("NOT isnan(coalesce(b_vmin, double('NaN'))) AND NOT isnan(coalesce(b_vmax, double('NaN')))")
    # boxes of the same place are one, with the range of them all
    sound = materialise(sound.groupBy(*[f"b_{s}" for s in SIDES]).agg(F.min("b_vmin").alias("b_vmin"), F.max("b_vmax").alias("b_vmax")))
    whole = sound.agg(F.count(F.lit(1)).alias("n"), *[F.min(f"b_l{a}").alias(f"l{a}") for a in AXES], *[F.max(f"b_l{a}").alias(f"m{a}") for a in AXES]).first()
    if not whole["n"]:
        return Pyramid(sound, [], [])
    span = [max(whole[f"m{a}"] - whole[f"l{a}"], 1e-9) for a in AXES]
    # blocks of equal edge that would hold `fill` boxes each if boxes lay evenly; flat directions don't count
    longest = max(span)
    wide = [x for x in span if x > longest * 1e-6]
    edge = (reduce(lambda x, y: x * y, wide) * fill / whole["n"]) ** (1 / len(wide))
    edge = min(max(edge, longest / 2**20), 2 * longest)
    at = [F.floor((F.col(f"b_l{a}") - F.lit(float(whole[f"l{a}"]))) / F.lit(edge)).cast("long").alias(k) for a, k in zip(AXES, BLOCK)]
    dealt = materialise(sound.select(*[f"b_{s}" for s in SIDES], F.col("b_vmin").cast("double").alias("b_vmin"), F.col("b_vmax").cast("double").alias("b_vmax"), *at))
    lowest = dealt.groupBy(*BLOCK).agg(
        *[F.min(f"b_l{a}").alias(f"l{a}") for a in AXES], *[F.max(f"b_h{a}").alias(f"h{a}") for a in AXES], *[F.max(f"b_l{a}").alias(f"m{a}") for a in AXES], *[F.min(f"b_h{a}").alias(f"n{a}") for a in AXES], F.min("b_vmin").alias("vmin"), F.max("b_vmax").alias("vmax"), F.lit(0).alias("mask")
    )
    levels = [materialise(lowest)]
    sizes = [levels[0].count()]
    while sizes[-1] > 8 and len(levels) < LEVELS:
        bit = reduce(lambda x, y: x + y, [F.pmod(k, F.lit(2)) * (1 << i) for i, k in enumerate(BLOCK)]).cast("int")
        up = levels[-1].withColumn("_bit", F.call_function("shiftleft", F.lit(1), bit)).withColumns({k: F.floor(F.col(k) / 2).cast("long") for k in BLOCK})
        least, most = [F.min(f"{s}{a}").alias(f"{s}{a}") for s in "ln" for a in AXES], [F.max(f"{s}{a}").alias(f"{s}{a}") for s in "hm" for a in AXES]
        levels.append(materialise(up.groupBy(*BLOCK).agg(*least, *most, F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.bit_or("_bit").alias("mask"))))
        sizes.append(levels[-1].count())
    return Pyramid(dealt, levels, sizes)


def ranges(pyramid: Pyramid, probes: DataFrame, key: str = "probe_id") -> DataFrame:
    """(key, vmin, vmax) of the boxes that share volume with each probe (key, a_lx..a_hz); probes that meet none have no row.

    One join a level. Levels of up to BROADCAST blocks are broadcast; below, blocks are many, so their keys spread the pairs.
    """
    corners = [f"a_{s}" for s in SIDES]
    slim = probes.where(" AND ".join(f"a_l{a} < a_h{a}" for a in AXES)).select(key, *[F.col(c).cast("double").alias(c) for c in corners])
    if not pyramid.levels:
        return slim.select(key, F.lit(None).cast("double").alias("vmin"), F.lit(None).cast("double").alias("vmax")).limit(0)
    top = [tuple(r) for r in pyramid.levels[-1].select(*BLOCK).collect()]  # eight at most, or what LEVELS leaves
    first = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for v, k in zip(row, BLOCK)]) for row in top]))
    open_ = slim.withColumn("_b", first).select(key, *corners, *[F.col(f"_b.{k}").alias(k) for k in BLOCK])
    found: list[DataFrame] = []
    for level in range(len(pyramid.levels) - 1, -1, -1):
        blocks = pyramid.levels[level]
        met = open_.join(F.broadcast(blocks), list(BLOCK)) if pyramid.sizes[level] <= BROADCAST else by_key(open_, blocks, list(BLOCK))
        met = met.where(" AND ".join(f"l{a} < a_h{a} AND h{a} > a_l{a}" for a in AXES))
        # every box begins before the probe ends, and ends after it begins
        whole = reduce(lambda x, y: x & y, [(F.col(f"m{a}") < F.col(f"a_h{a}")) & (F.col(f"n{a}") > F.col(f"a_l{a}")) for a in AXES])
        split = materialise(met.select(key, *corners, *BLOCK, whole.alias("_whole"), "vmin", "vmax", "mask"))
        found.append(split.where("_whole").groupBy(key).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax")))
        open_ = split.where("NOT _whole")
        if level:
            some = F.filter(F.array(*[F.lit(c) for c in range(8)]), lambda c: F.call_function("shiftright", F.col("mask"), c).bitwiseAND(F.lit(1)) == 1)
            open_ = open_.withColumn("_c", F.explode(some)).select(key, *corners, *[(F.col(k) * 2 + F.call_function("shiftright", F.col("_c"), F.lit(i)).bitwiseAND(F.lit(1))).cast("long").alias(k) for i, k in enumerate(BLOCK)])
    cut = by_key(open_.select(key, *corners, *BLOCK), pyramid.boxes, list(BLOCK)).where(" AND ".join(f"b_l{a} < a_h{a} AND b_h{a} > a_l{a}" for a in AXES))
    found.append(cut.groupBy(key).agg(F.min("b_vmin").alias("vmin"), F.max("b_vmax").alias("vmax")))
    return reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
