"""Range joins by binning: both sides meet on a coarse grid by an equi-join, and an exact test follows.

A point has one bin; a box has a row for each bin it touches. Boxes of very different sizes are binned by size class,
each class on its own grid (edge: the next power of two of the box), so a box touches 8 bins at most and a
point probes one bin a class. Classes are few (their number grows with the logarithm of the size ratio). The join is
a shuffled equi-join on (class, bin): nothing is broadcast, and adaptive execution splits skewed bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import AXES
from lattica.operators.joins import by_key

BIN = ("_class", "_bx", "_by", "_bz")


def _size_class(prefix: str) -> Column:
    """Power of two that is at least the longest edge."""
    longest = F.greatest(*[F.col(f"{prefix}h{a}") - F.col(f"{prefix}l{a}") for a in AXES])
    return F.when(longest > 0, F.ceil(F.log2(longest) - 1e-12)).otherwise(F.lit(0)).cast("int")


def _bin(value: Column, size_class: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), size_class)).cast("long")


def bin_boxes(boxes: DataFrame, prefix: str = "", finer: int = 0) -> DataFrame:
    """Boxes with a row for each bin of their class (finer: of one so much smaller) that they touch; inverted boxes have none."""
    valid = boxes.where(" AND ".join(f"{prefix}l{a} <= {prefix}h{a}" for a in AXES)).withColumn("_class", _size_class(prefix) - finer)
    for a in AXES:
        low, high = _bin(F.col(f"{prefix}l{a}"), F.col("_class")), _bin(F.col(f"{prefix}h{a}"), F.col("_class"))
        valid = valid.withColumn(f"_b{a}", F.explode(F.sequence(low, high)))
    return valid


def box_classes(boxes: DataFrame, prefix: str = "") -> list[int]:
    """Size classes in use; one number each, so there are a few dozen at most."""
    return sorted(r[0] for r in boxes.select(_size_class(prefix)).distinct().collect() if r[0] is not None)


def bin_points(points: DataFrame, xyz: tuple[str, str, str], classes: list[int]) -> DataFrame:
    probes = points.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes])))
    return probes.withColumns({f"_b{a}": _bin(F.col(c), F.col("_class")) for a, c in zip(AXES, xyz)})


def join_points(points: DataFrame, boxes: DataFrame, xyz: tuple[str, str, str] = ("px", "py", "pz"), finer: int = 0) -> DataFrame:
    """Every pair of a point and a box (lx..hz) that holds it, bounds included; columns of both.

    finer halves the bins so many times: boxes have up to 27 rows instead of 8 at 1, and points meet about a third of the boxes that
    don't hold them. That pays where each point is in many boxes.
    """
    classes = [c - finer for c in box_classes(boxes)]
    if not classes:
        return points.crossJoin(boxes.limit(0))
    met = by_key(bin_points(points, xyz, classes), bin_boxes(boxes, finer=finer), list(BIN))
    inside = " AND ".join(f"{c} >= l{a} AND {c} <= h{a}" for a, c in zip(AXES, xyz))
    return met.where(inside).drop(*BIN)


def join_boxes(left: DataFrame, right: DataFrame, left_prefix: str, right_prefix: str) -> DataFrame:
    """Every pair of boxes that have volume in common, once; the two sides' columns have these prefixes.

    Both sides are binned on the grid of the larger of their classes; a pair that shares several bins is kept in the
    one that holds the lower corner of the common box.
    """
    classes = sorted({*box_classes(left, left_prefix), *box_classes(right, right_prefix)})
    if not classes:
        return left.crossJoin(right.limit(0))

    def spread(df: DataFrame, prefix: str, mark: str) -> DataFrame:
        own = df.where(" AND ".join(f"{prefix}l{a} < {prefix}h{a}" for a in AXES)).withColumn(mark, _size_class(prefix))
        larger = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c >= F.col(mark))
        own = own.withColumn("_class", F.explode(larger))
        for a in AXES:
            own = own.withColumn(f"_b{a}", F.explode(F.sequence(_bin(F.col(f"{prefix}l{a}"), F.col("_class")), _bin(F.col(f"{prefix}h{a}"), F.col("_class")))))
        return own

    met = by_key(spread(left, left_prefix, "_lc"), spread(right, right_prefix, "_rc"), list(BIN)).where(F.greatest("_lc", "_rc") == F.col("_class"))
    for a in AXES:
        low, high = F.greatest(F.col(f"{left_prefix}l{a}"), F.col(f"{right_prefix}l{a}")), F.least(F.col(f"{left_prefix}h{a}"), F.col(f"{right_prefix}h{a}"))
        met = met.where(low < high).where(_bin(low, F.col("_class")) == F.col(f"_b{a}"))
    return met.drop(*BIN, "_lc", "_rc")
