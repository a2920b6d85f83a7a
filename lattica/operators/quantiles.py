"""Range joins where points crowd: space is cut at quantiles of a sample, beside the power-of-two bins.

A bin that holds most of the points would be one task. Planes between sampled quantiles cut space into parts of about as many
points each; points and boxes then meet by part and bin, so a crowded bin is as many tasks as it has parts, while a box goes to
the parts that it touches only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import AXES
from lattica.operators.columns import once, spread
from lattica.operators.joins import by_key
from lattica.operators.range_join import BIN, bin_boxes, bin_points, box_classes

#: Points of the sample, and levels of cuts: 2^LEVELS parts.
SAMPLE, LEVELS = 20_000, 8


def planes(points: DataFrame, xyz: tuple[str, str, str] = ("px", "py", "pz"), levels: int = LEVELS, sample: int = SAMPLE) -> list[tuple[int, float]]:
    """(axis, place) of the cuts of a k-d tree in heap order, from a seeded sample of points (about sample rows).

    A part is cut on its widest axis at the median of its points; one whose points are all in one place isn't cut (its
    plane is beyond all points).
    """
    n = points.count()
    share = min(1.0, sample / max(n, 1))
    taken = points.select(*xyz).dropna().sample(fraction=share, seed=5) if share < 1 else points.select(*xyz).dropna()
    rows = taken.limit(2 * sample).toArrow()
    at = np.stack([rows.column(c).to_numpy().astype(float) for c in xyz], 1) if rows.num_rows else np.zeros((0, 3))
    parts, out = [at[np.isfinite(at).all(1)]], []
    for _ in range(levels):
        below = []
        for p in parts:
            span = np.ptp(p, axis=0) if len(p) else np.zeros(3)
            axis = int(np.argmax(span))
            place = float(np.quantile(p[:, axis], 0.5, method="lower")) if span[axis] > 0 else float("inf")
            if span[axis] > 0 and not (p[:, axis] > place).any():  # the upper half is one place
                place = float(p[:, axis][p[:, axis] < place].max())
            left = p[:, axis] <= place
            below += [p[left], p[~left]]
            out.append((axis, place))
        parts = below
    return out


def _cuts(cuts: list[tuple[int, float]]) -> tuple[Column, Column]:
    return F.array(*[F.lit(a) for a, _ in cuts]), F.array(*[F.lit(v) for _, v in cuts])


def _levels(cuts: list[tuple[int, float]]) -> int:
    return (len(cuts) + 1).bit_length() - 1


def part_of(cuts: list[tuple[int, float]], xyz: tuple[str, str, str] = ("px", "py", "pz")) -> Column:
    """Number of the part that holds a point; a plane belongs to its lower side."""
    axes, places = _cuts(cuts)
    at = F.array(*[F.col(c).cast("double") for c in xyz])
    down = lambda node, _: node * 2 + 1 + (F.get(at, F.get(axes, node)) > F.get(places, node)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(_levels(cuts))), F.lit(0), down) - len(cuts)


def parts_of_box(cuts: list[tuple[int, float]]) -> Column:
    """Numbers of the parts that a box (lx..hz) touches."""
    axes, places = _cuts(cuts)
    low, high = (F.array(*[F.col(f"{e}{a}").cast("double") for a in AXES]) for e in "lh")

    def down(nodes: Column, _: Column) -> Column:
        both = lambda n: F.concat(F.when(F.get(low, F.get(axes, n)) <= F.get(places, n), F.array(n * 2 + 1)).otherwise(F.array().cast("array<int>")), F.when(F.get(high, F.get(axes, n)) > F.get(places, n), F.array(n * 2 + 2)).otherwise(F.array().cast("array<int>")))
        return F.flatten(F.transform(nodes, both))

    reached = F.aggregate(F.sequence(F.lit(1), F.lit(_levels(cuts))), F.array(F.lit(0)), down)
    return F.transform(reached, lambda n: n - len(cuts))


def join_crowded(points: DataFrame, boxes: DataFrame, xyz: tuple[str, str, str] = ("px", "py", "pz"), levels: int = LEVELS) -> DataFrame:
    """Every pair of a point and a box (lx..hz) that holds it, bounds included, as join_points, by part and bin."""
    classes = box_classes(boxes)
    if not classes:
        return points.crossJoin(boxes.limit(0))
    cuts = planes(points, xyz, levels)
    left = bin_points(points.withColumn("_part", part_of(cuts, xyz)), xyz, classes)
    right = bin_boxes(boxes.withColumn("_part", F.explode(parts_of_box(cuts))))
    met = by_key(left, right, ["_part", *BIN])
    inside = " AND ".join(f"{c} >= l{a} AND {c} <= h{a}" for a, c in zip(AXES, xyz))
    return met.where(inside).drop("_part", *BIN)


def holders(points: DataFrame, boxes: DataFrame, key: str, xyz: tuple[str, str, str] = ("px", "py", "pz"), levels: int = LEVELS) -> DataFrame:
    """(pid, n, first, last): how many boxes hold each point, bounds included, and their smallest and largest key; points in none have no row.

    A box that holds all points of a part is counted once for the part, not once for each of its points; only boxes that cut the
    bounds of a part's points meet these one by one.
    """
    classes = box_classes(boxes)
    cuts = planes(points, xyz, levels)
    sound = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in xyz))
    left = once(sound.select("pid", *xyz), _part=part_of(cuts, xyz))
    bounds = left.groupBy("_part").agg(*[f(c).alias(f"_{e}{a}") for a, c in zip(AXES, xyz) for e, f in (("l", F.min), ("h", F.max))])
    touched = once(spread(boxes.select(key, *[f"{e}{a}" for e in "lh" for a in AXES]), key), _parts=parts_of_box(cuts)).withColumn("_part", F.explode("_parts")).drop("_parts")
    reach = by_key(touched, bounds, "_part").where(" AND ".join(f"l{a} <= _h{a} AND h{a} >= _l{a} AND l{a} <= h{a}" for a in AXES))
    whole = F.expr(" AND ".join(f"l{a} <= _l{a} AND h{a} >= _h{a}" for a in AXES))
    counted = [F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")]
    found = by_key(left.select("pid", "_part"), reach.where(whole).groupBy("_part").agg(*counted), "_part").select("pid", "n", "first", "last")
    if classes:
        some = reach.where(~whole).drop(*[f"_{e}{a}" for e in "lh" for a in AXES])
        met = by_key(bin_points(left, xyz, classes), bin_boxes(some), ["_part", *BIN])
        pairs = met.where(" AND ".join(f"{c} >= l{a} AND {c} <= h{a}" for a, c in zip(AXES, xyz)))
        found = found.unionByName(pairs.groupBy("pid").agg(*counted))
    return found.groupBy("pid").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
