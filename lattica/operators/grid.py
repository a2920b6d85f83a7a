"""Macrocell grids: value ranges, majorants, and the cells that a ray crosses.

Grids are sparse: a macrocell that nothing touches has no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.geometry import AXES, cell_box, linear_index, project_on_grid, ray_box
from lattica.functions.transfer import majorant
from lattica.operators.columns import once, spread
from lattica.operators.joins import by_key

Bounds = tuple[float, float]


def value_ranges(boxes: DataFrame, low: Bounds | tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int], vmin: str = "vmin", vmax: str = "vmax") -> DataFrame:
    """(mc_id, vmin, vmax) of every macrocell that a box (lx..hz) with a value range touches; NaN and null don't count.

    Boxes are exploded to the macrocells they touch and reduced with map-side combination, so what is shuffled is
    a row for each macrocell and task.
    """
    return touched(boxes, low, high, dims, vmin, vmax).groupBy("mc_id").agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def touched(boxes: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int], vmin: str = "vmin", vmax: str = "vmax") -> DataFrame:
    """(mc_id, vmin, vmax): a row for each box and macrocell that it touches."""
    found = boxes.where(F.col(vmin).isNotNull() & ~F.isnan(vmin) & F.col(vmax).isNotNull() & ~F.isnan(vmax))
    for a, l, h, d in zip(AXES, low, high, dims):
        found = found.withColumn(f"_m{a}", F.explode(F.sequence(project_on_grid(F.col(f"l{a}"), l, h, d), project_on_grid(F.col(f"h{a}"), l, h, d))))
    mc = linear_index(F.col("_mx"), F.col("_my"), F.col("_mz"), dims[0], dims[1]).cast("long")
    return found.select(mc.alias("mc_id"), F.col(vmin).alias("vmin"), F.col(vmax).alias("vmax"))


def cell_ranges(cells: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    """Ranges from cells (x, y, z, level, value), whose values reach half a cell beyond them."""
    return value_ranges(cells.select(*cell_box(0.5), F.col("value").alias("vmin"), F.col("value").alias("vmax")), low, high, dims)


def brick_cells(bricks: DataFrame) -> DataFrame:
    """Cells (brick_id, i, x, y, z, level, value) of bricks, lower corners in finest coordinates."""
    cells = bricks.select("brick_id", "lx", "ly", "lz", "sx", "sy", "level", F.posexplode("scalars").alias("i", "value"))
    w = F.pow(F.lit(2.0), F.col("level"))
    ix, iy, iz = F.pmod("i", "sx"), F.pmod(F.floor(F.col("i") / F.col("sx")), F.col("sy")), F.floor(F.col("i") / (F.col("sx") * F.col("sy")))
    return cells.select("brick_id", "i", *[(F.col(f"l{a}") + k * w).cast("int").alias(a) for a, k in zip(AXES, (ix, iy, iz))], "level", F.col("value").cast("double").alias("value"))


def brick_ranges(bricks: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    return cell_ranges(brick_cells(bricks), low, high, dims)


def element_ranges(corners: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    """Ranges from elements' corners (elem_id, x, y, z, value): the element's box and range, corners with NaN left out."""
    sound = corners.where("value IS NOT NULL AND NOT isnan(value)")
    boxes = sound.groupBy("elem_id").agg(*[F.min(a).alias(f"l{a}") for a in AXES], *[F.max(a).alias(f"h{a}") for a in AXES], F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    return value_ranges(boxes, low, high, dims)


def gridlet_voxels(gridlets: DataFrame) -> DataFrame:
    """Voxels (gridlet_id, i, lx..hz, vmin, vmax) with the range of their corners; null and NaN corners are left out."""
    v = gridlets.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("dx") * F.col("dy") * F.col("dz") - 1)))
    v = v.withColumns({"_ix": F.pmod("i", "dx"), "_iy": F.pmod(F.floor(F.col("i") / F.col("dx")), F.col("dy")).cast("int"), "_iz": F.floor(F.col("i") / (F.col("dx") * F.col("dy"))).cast("int")})
    at = lambda i, j, k: F.element_at("scalars", (linear_index(F.col("_ix") + i, F.col("_iy") + j, F.col("_iz") + k, F.col("dx") + 1, F.col("dy") + 1) + 1).cast("int"))
    corners = F.array(*[at(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)])
    sound = F.filter(corners, lambda c: c.isNotNull() & ~F.isnan(c))
    w = F.pow(F.lit(2.0), F.col("level"))
    low = [(F.col(f"l{a}") + F.col(f"_i{a}") + 0.5) * w for a in AXES]
    return v.select("gridlet_id", "i", *[x.alias(f"l{a}") for a, x in zip(AXES, low)], *[(x + w).alias(f"h{a}") for a, x in zip(AXES, low)], F.array_min(sound).alias("vmin"), F.array_max(sound).alias("vmax"))


def gridlet_ranges(gridlets: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    return value_ranges(gridlet_voxels(gridlets), low, high, dims)


def gridlet_value_range(gridlets: DataFrame) -> DataFrame:
    """(gridlet_id, vmin, vmax) over scalars that are neither null nor NaN."""
    sound = F.filter("scalars", lambda c: c.isNotNull() & ~F.isnan(c))
    return gridlets.select("gridlet_id", F.array_min(sound).alias("vmin"), F.array_max(sound).alias("vmax"))


def dense(spark: SparkSession, ranges: DataFrame, dims: tuple[int, int, int], empty: Bounds = (1e30, -1e30)) -> DataFrame:
    """All macrocells; those without values have an inverted range."""
    every = spark.range(dims[0] * dims[1] * dims[2]).withColumnRenamed("id", "mc_id")
    return every.join(ranges, "mc_id", "left").select("mc_id", F.coalesce("vmin", F.lit(empty[0])).alias("vmin"), F.coalesce("vmax", F.lit(empty[1])).alias("vmax"))


def with_majorants(ranges: DataFrame, entries: list[tuple[float, float, float, float]], low: float, high: float) -> DataFrame:
    """Ranges and their largest opacity. Ranges don't depend on the transfer function: keep them, redo this."""
    return ranges.withColumn("max_opacity", majorant(F.col("vmin"), F.col("vmax"), entries, low, high))


def _crossed(low: float, edge: float, origin: Column, direction: Column) -> Callable[[Column], Column]:
    return lambda k: (low + k * edge - origin) / direction


def walk(rays: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    """(ray_id, mc_id, t0, t1): the macrocells each ray crosses, with where it enters and leaves.

    A ray is clipped to the grid; the planes it crosses are a sequence on each axis; the sorted crossings
    bound the segments, and a segment's midpoint tells its cell. Everything stays within the ray's row.
    """
    return _segments(rays, low, high, dims).select("ray_id", "mc_id", "t0", "t1")


def walk_with_rays(rays: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    """The rays' own columns, mc_id, and the cell before it along the ray (_wx, _wy, _wz; null in the first cell)."""
    before = [F.when(F.col("_before").isNotNull(), project_on_grid(F.col(f"o{a}") + (F.col("_before") + F.col("t0")) / 2 * F.col(f"d{a}"), l, h, d)).alias(f"_w{a}") for a, l, h, d in zip(AXES, low, high, dims)]
    return _segments(rays, low, high, dims).select(*rays.columns, "mc_id", *before)


def _segments(rays: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    bounds = {f"l{a}": F.lit(float(l)) for a, l in zip(AXES, low)} | {f"h{a}": F.lit(float(h)) for a, h in zip(AXES, high)}
    t0, t1 = ray_box()
    r = once(spread(rays, "ray_id").withColumns(bounds), _t0=t0, _t1=t1).where("_t0 < _t1").drop(*bounds)
    crossings: list[Column] = [F.array("_t0", "_t1")]
    planned: dict[str, Column] = {}
    for a, l, h, d in zip(AXES, low, high, dims):
        edge = (h - l) / d
        o, v = F.col(f"o{a}"), F.col(f"d{a}")
        ends = [(o + F.col(t) * v - l) / edge for t in ("_t0", "_t1")]
        # one plane more on either side, as ends are rounded
        planned[f"_p{a}"], planned[f"_q{a}"] = F.greatest(F.lit(1.0), F.floor(F.least(*ends))).cast("int"), F.least(F.lit(d - 1.0), F.ceil(F.greatest(*ends))).cast("int")
        planes = F.transform(F.sequence(f"_p{a}", f"_q{a}"), _crossed(l, edge, o, v))
        crossings.append(F.when((v != 0) & (F.col(f"_p{a}") <= F.col(f"_q{a}")), planes).otherwise(F.array().cast("array<double>")))
    inside = F.filter(F.concat(*crossings), lambda t: (t >= F.col("_t0")) & (t <= F.col("_t1")))
    # equal ones bound no segment; 0.0 is added as -0.0 is no other place
    r = once(once(r, **planned), _t=F.array_distinct(F.array_sort(F.transform(inside, lambda t: t + F.lit(0.0))))).where(F.size("_t") > 1)
    earlier = F.concat(F.array(F.lit(None).cast("double")), F.slice("_t", F.lit(1), F.size("_t") - 2))
    pairs = F.arrays_zip(F.slice("_t", F.lit(1), F.size("_t") - 1).alias("a"), F.slice("_t", F.lit(2), F.size("_t") - 1).alias("b"), earlier.alias("p"))
    s = r.select(*rays.columns, F.explode(pairs).alias("s")).select(*rays.columns, F.col("s.a").alias("t0"), F.col("s.b").alias("t1"), F.col("s.p").alias("_before")).where("t0 < t1")
    middle = [project_on_grid(F.col(f"o{a}") + (F.col("t0") + F.col("t1")) / 2 * F.col(f"d{a}"), l, h, d) for a, l, h, d in zip(AXES, low, high, dims)]
    return once(s, mc_id=linear_index(*middle, dims[0], dims[1]).cast("long"))


def mirrored_walk(rays: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int], axis: int, plane: float) -> DataFrame:
    """(ray_id, mc_id, t0, t1, mirrored): macrocells along rays through a volume and its reflection in a plane.

    The volume is what lies below the plane on the axis; beyond it a ray sees the reflection. A ray's interval is cut at the
    plane, and the part beyond goes, reflected, through the volume that there is: nothing is doubled. t stays the ray's own, so
    the parts are in order along it.
    """
    a = AXES[axis]
    o, d = F.col(f"o{a}"), F.col(f"d{a}")
    at = F.try_divide(F.lit(float(plane)) - o, d)
    within = F.when(d == 0, F.col("tmax")).otherwise(F.greatest("tmin", F.least("tmax", at)))
    r = rays.withColumn("_at", within)
    below_first = (d > 0) | ((d == 0) & (o < plane))
    near, far = F.struct(F.col("tmin").alias("a"), F.col("_at").alias("b"), (~below_first).alias("mirrored")), F.struct(F.col("_at").alias("a"), F.col("tmax").alias("b"), below_first.alias("mirrored"))
    parts = r.withColumn("_p", F.explode(F.array(near, far))).where("_p.a < _p.b")
    turned = F.col("_p.mirrored")
    parts = parts.withColumns({f"o{a}": F.when(turned, 2 * plane - o).otherwise(o), f"d{a}": F.when(turned, -d).otherwise(d), "tmin": F.col("_p.a"), "tmax": F.col("_p.b")})
    walked = walk(parts.withColumn("ray_id", F.struct("ray_id", turned.alias("mirrored"))).drop("_p", "_at"), low, high, dims)
    return walked.select("ray_id.ray_id", "mc_id", "t0", "t1", "ray_id.mirrored")


def first_active(segments: DataFrame, majorants: DataFrame) -> DataFrame:
    """Segments in cells whose majorant isn't 0, numbered along each ray."""
    active = by_key(segments, majorants.where("max_opacity > 0"), "mc_id")
    return active.withColumn("n", F.row_number().over(Window.partitionBy("ray_id").orderBy("t0", "mc_id")))
