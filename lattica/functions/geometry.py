"""Row-wise geometry as column expressions: boxes of cells, bricks and gridlets, grids, rays, planes, cameras.

Boxes are six columns lx..hz; all computing is in double precision. Axes go by their letters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def width(level: Column | str) -> Column:
    """Edge of a cell: 2 to the level, in units of the finest."""
    return F.pow(F.lit(2.0), col(level))


def named(prefix: str, values: Sequence[Column]) -> list[Column]:
    return [v.alias(prefix + a) for a, v in zip(AXES, values)]


def box(lower: Sequence[Column], upper: Sequence[Column]) -> list[Column]:
    return [v.alias(f"l{a}") for a, v in zip(AXES, lower)] + [v.alias(f"h{a}") for a, v in zip(AXES, upper)]


def cell_box(grow: float = 0.0) -> list[Column]:
    """Bounds of cells (x, y, z, level), grown by a share of the edge to each side."""
    w = width("level")
    return box([F.col(a) - grow * w for a in AXES], [F.col(a) + (1 + grow) * w for a in AXES])


def cell_centre() -> list[Column]:
    return named("c", [F.col(a) + 0.5 * width("level") for a in AXES])


def cell_neighbour(dx: int, dy: int, dz: int) -> list[Column]:
    return named("n", [(F.col(a) + d * width("level")).cast("int") for a, d in zip(AXES, (dx, dy, dz))])


def brick_box() -> list[Column]:
    """Bounds of a brick's cells."""
    return box([F.col(f"l{a}").cast("double") for a in AXES], [F.col(f"l{a}") + F.col(f"s{a}") * width("level") for a in AXES])


def brick_domain() -> list[Column]:
    """Where a brick's basis functions reach: half a cell beyond its bounds."""
    w = width("level")
    return box([F.col(f"l{a}") - 0.5 * w for a in AXES], [F.col(f"l{a}") + (F.col(f"s{a}") + 0.5) * w for a in AXES])


def gridlet_box() -> list[Column]:
    """Bounds of a gridlet's vertices, which are cell centres; lower is in coordinates of the level."""
    w = width("level")
    return box([(F.col(f"l{a}") + 0.5) * w for a in AXES], [(F.col(f"l{a}") + F.col(f"d{a}") + 0.5) * w for a in AXES])


def linear_index(ix: Column, iy: Column, iz: Column, nx: Column | int, ny: Column | int) -> Column:
    """Place of a cell in an array whose first axis runs fastest."""
    return ix + nx * (iy + ny * iz)


def grid_index(i: Column, nx: int, ny: int) -> list[Column]:
    """The reverse of linear_index."""
    return [F.pmod(i, F.lit(nx)).cast("int"), F.pmod(F.floor(i / nx), F.lit(ny)).cast("int"), F.floor(i / (nx * ny)).cast("int")]


def project_on_grid(value: Column, low: float, high: float, dims: int) -> Column:
    """Grid cell of a coordinate, clamped to the grid."""
    return F.greatest(F.lit(0.0), F.least(F.lit(dims - 1.0), F.floor((value - low) / (high - low) * dims))).cast("int")


def snap(value: Column, level: Column) -> Column:
    """Lower corner, on one axis, of the level's cell that holds a coordinate."""
    return F.floor(value / width(level)) * width(level)


def level_index(value: Column, level: Column) -> Column:
    """Number of the level's cell that holds a coordinate: a true floor, also below zero."""
    return F.floor(value / width(level)).cast("int")


def contains(point: Sequence[Column | str], prefix: str = "") -> Column:
    """Point in box, bounds included."""
    found = F.lit(True)
    for a, p in zip(AXES, point):
        found = found & (col(p) >= F.col(f"{prefix}l{a}")) & (col(p) <= F.col(f"{prefix}h{a}"))
    return found


def intersection(a: str, b: str) -> list[Column]:
    """Common box of the boxes whose columns have these prefixes."""
    return box([F.greatest(F.col(f"{a}l{x}"), F.col(f"{b}l{x}")) for x in AXES], [F.least(F.col(f"{a}h{x}"), F.col(f"{b}h{x}")) for x in AXES])


def overlaps(a: str, b: str) -> Column:
    """The boxes have volume in common; boxes that touch don't overlap."""
    found = F.lit(True)
    for x in AXES:
        found = found & (F.greatest(F.col(f"{a}l{x}"), F.col(f"{b}l{x}")) < F.least(F.col(f"{a}h{x}"), F.col(f"{b}h{x}")))
    return found


def ray_box(prefix: str = "", tmin: Column | str = "tmin", tmax: Column | str = "tmax") -> tuple[Column, Column]:
    """Entry and exit of the ray o + t d; a hit has t0 < t1. A ray along an axis is inside the slab always or never."""
    t0, t1 = [col(tmin)], [col(tmax)]
    for a in AXES:
        o, d, lo, hi = F.col(f"o{a}"), F.col(f"d{a}"), F.col(f"{prefix}l{a}"), F.col(f"{prefix}h{a}")
        near, far = F.try_divide(lo - o, d), F.try_divide(hi - o, d)
        within = (o >= lo) & (o <= hi)
        t0.append(F.when(d == 0, F.when(within, F.lit(-1e30)).otherwise(F.lit(1e30))).otherwise(F.least(near, far)))
        t1.append(F.when(d == 0, F.when(within, F.lit(1e30)).otherwise(F.lit(-1e30))).otherwise(F.greatest(near, far)))
    return F.greatest(*t0), F.least(*t1)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def length(v: Sequence[Column]) -> Column:
    return F.sqrt(dot(v, v))


def ray_plane(normal: Sequence[float], offset: float) -> tuple[Column, Column]:
    """t at which a ray meets the plane normal . p = offset (none when parallel: 1e30), and whether from behind."""
    n = [F.lit(float(x)) for x in normal]
    toward = dot(n, [F.col(f"d{a}") for a in AXES])
    t = F.when(toward == 0, F.lit(1e30)).otherwise(F.try_divide(F.lit(float(offset)) - dot(n, [F.col(f"o{a}") for a in AXES]), toward))
    return t, toward > 0


def clip_interval(rays: DataFrame, planes: Sequence[tuple[Sequence[float], float]]) -> DataFrame:
    """Trim tmin and tmax by any number of planes: one met from the front moves the start, one from behind the end."""
    for normal, offset in planes:
        t, behind = ray_plane(normal, offset)
        rays = rays.withColumns({"_t": t, "_b": behind}).withColumns(
            {"tmin": F.when((F.col("_t") < 1e30) & ~F.col("_b"), F.greatest("tmin", "_t")).otherwise(F.col("tmin")), "tmax": F.when((F.col("_t") < 1e30) & F.col("_b"), F.least("tmax", "_t")).otherwise(F.col("tmax"))}
        ).drop("_t", "_b")
    return rays


def between_boxes(from_low: Sequence[float], from_high: Sequence[float], to_low: Sequence[float], to_high: Sequence[float]) -> list[tuple[float, float]]:
    """Scale and shift, axis by axis, that take one box to the other."""
    out = []
    for a, b, c, d in zip(from_low, from_high, to_low, to_high):
        scale = (d - c) / (b - a)
        out.append((scale, c - a * scale))
    return out


def transform_point(p: Sequence[Column], by: Sequence[tuple[float, float]]) -> list[Column]:
    return [x * s + o for x, (s, o) in zip(p, by)]


def transform_rays(rays: DataFrame, by: Sequence[tuple[float, float]]) -> DataFrame:
    """Origins and directions through the map; directions are made unit length and t is scaled to fit."""
    o = transform_point([F.col(f"o{a}") for a in AXES], by)
    d = [F.col(f"d{a}") * s for a, (s, _) in zip(AXES, by)]
    n = length(d)
    return rays.withColumns({f"_d{a}": x for a, x in zip(AXES, d)} | {"_n": n} | {f"o{a}": x for a, x in zip(AXES, o)}).withColumns({f"d{a}": F.col(f"_d{a}") / F.col("_n") for a in AXES} | {"tmin": F.col("tmin") * F.col("_n"), "tmax": F.col("tmax") * F.col("_n")}).drop("_n", "_dx", "_dy", "_dz")


def camera(origin: Sequence[float], toward: Sequence[float], up: Sequence[float], fovy: float, aspect: float, columns: int, rows: int) -> dict[str, tuple[float, ...]]:
    """Origin, the direction of the first pixel and the steps to the next column and row."""
    unit = lambda v: tuple(x / math.sqrt(sum(y * y for y in v)) for x in v)
    side = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    ahead = unit(toward)
    right = unit(side(ahead, up))
    above = unit(side(right, ahead))
    high = 2 * math.tan(fovy / 2)
    du, dv = tuple(x * high * aspect for x in right), tuple(x * high for x in above)
    corner = tuple(a - 0.5 * u - 0.5 * v for a, u, v in zip(ahead, du, dv))
    return {"o": tuple(origin), "corner": corner, "du": tuple(x / columns for x in du), "dv": tuple(x / rows for x in dv)}


def primary_rays(spark, view: dict[str, tuple[float, ...]], columns: int, rows: int, tmax: float = 1e20) -> DataFrame:
    """A ray through each pixel's centre; components of a direction below 1e-5 are raised to it."""
    pixels = spark.range(columns * rows).withColumn("u", F.col("id") % columns + 0.5).withColumn("v", F.floor(F.col("id") / columns) + 0.5)
    d = [F.lit(c) + F.col("u") * du + F.col("v") * dv for c, du, dv in zip(view["corner"], view["du"], view["dv"])]
    pixels = pixels.withColumns({f"_{a}": x for a, x in zip(AXES, d)}).withColumn("_n", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2))
    unit = [F.col(f"_{a}") / F.col("_n") for a in AXES]
    clamped = [F.when(F.abs(x) < 1e-5, F.lit(1e-5)).otherwise(x) for x in unit]
    return pixels.select(F.col("id").alias("ray_id"), *[F.lit(float(x)).alias(f"o{a}") for a, x in zip(AXES, view["o"])], *named("d", clamped), F.lit(0.0).alias("tmin"), F.lit(float(tmax)).alias("tmax"))


def remap_pixel(u: Column, v: Column, window: tuple[float, float, float, float]) -> list[Column]:
    """Screen coordinates 0..1 to a window (u0, v0, u1, v1) of the screen."""
    u0, v0, u1, v1 = window
    return [F.lit(u0) + u * (u1 - u0), F.lit(v0) + v * (v1 - v0)]


def on_border(u: Column, v: Column, window: tuple[float, float, float, float], thick: float) -> Column:
    """Whether a screen point is within thick of the window's edge, inside it."""
    u0, v0, u1, v1 = window
    inside = u.between(u0, u1) & v.between(v0, v1)
    return inside & ((u < u0 + thick) | (u > u1 - thick) | (v < v0 + thick) | (v > v1 - thick))


def planar_face(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column], d: Sequence[Column]) -> Column:
    """Four points share a coordinate, so their quad is planar and along the axes."""
    flat = [(a[k] == b[k]) & (b[k] == c[k]) & (c[k] == d[k]) for k in range(3)]
    return flat[0] | flat[1] | flat[2]


def rescale_power(extent: Column) -> Column:
    """The power of 1000 to divide by until an extent is at most 1000."""
    return F.greatest(F.lit(0.0), F.ceil(F.log10(extent / 1000.0) / 3.0 - 1e-12)).cast("int")


def mirrored(rows: DataFrame, plane: float, columns: Sequence[str]) -> DataFrame:
    """Rows and their reflections in y = plane; columns are y coordinates of points, mirror tells which."""
    flipped = rows.withColumns({c: 2 * plane - F.col(c) for c in columns}).withColumn("mirror", F.lit(True))
    return rows.withColumn("mirror", F.lit(False)).unionByName(flipped)


def plane_box_points(boxes: DataFrame, id_col: str, normal: Sequence[float], offset: float) -> DataFrame:
    """Corners (id, n, px, py, pz) of the polygon in which a plane cuts each box, by their angle around its centre."""
    corner = lambda k: [F.col(f"{'h' if k >> i & 1 else 'l'}{a}") for i, a in enumerate(AXES)]
    edges = [(k, k | 1 << i) for k in range(8) for i in range(3) if not k >> i & 1]
    at = F.array(*[F.struct(*named("a", corner(i)), *named("b", corner(j))) for i, j in edges])
    n = [F.lit(float(x)) for x in normal]
    e = boxes.select(id_col, F.explode(at).alias("e")).select(id_col, "e.*")
    da = dot(n, [F.col(f"a{a}") for a in AXES]) - offset
    db = dot(n, [F.col(f"b{a}") for a in AXES]) - offset
    e = e.withColumns({"da": da, "db": db}).where("da * db < 0 OR (da = 0 AND db <> 0) OR (db = 0 AND da <> 0)")
    t = F.col("da") / (F.col("da") - F.col("db"))
    hits = e.select(id_col, *[F.round(F.col(f"a{a}") + t * (F.col(f"b{a}") - F.col(f"a{a}")), 9).alias(f"p{a}") for a in AXES]).distinct()
    centre = hits.groupBy(id_col).agg(*[F.avg(f"p{a}").alias(f"m{a}") for a in AXES])
    pick_ = min(range(3), key=lambda i: abs(normal[i]))
    across = [float(i == pick_) for i in range(3)]
    u = _cross(normal, across)
    v = _cross(normal, u)
    rel = [F.col(f"p{a}") - F.col(f"m{a}") for a in AXES]
    angle = F.atan2(sum((r * x for r, x in zip(rel[1:], v[1:])), rel[0] * v[0]), sum((r * x for r, x in zip(rel[1:], u[1:])), rel[0] * u[0]))
    points = hits.join(centre, id_col).withColumn("_angle", angle)
    ordered = points.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_angle", "px", "py", "pz"))).alias("p"))
    return ordered.select(id_col, F.posexplode("p").alias("n", "q")).select(id_col, "n", "q.px", "q.py", "q.pz")


def _cross(a: Sequence[float], b: Sequence[float]) -> list[float]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
