"""Space-filling curves, clusters, trees, stochastic transport, files and the volume API: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.api import CellField, Volume
from lattica.functions import codes as K
from lattica.functions import geometry as G
from lattica.functions.transfer import lookup
from lattica.operators import clusters as L
from lattica.operators import grid as M
from lattica.operators import majorant_tree as T
from lattica.operators import tracking as X
from lattica.plans.derived import oracle
from lattica.plans.derived import relation as R
from lattica.plans.geometry_queries import RAMP, rounded
from lattica.plans.volume_queries import _BRICK_CELLS, DIMS, HIGH, LOW, bricks
from lattica.sources import binary
from lattica.storage import materialise, shared_dir


def p27_morton_codes(s, d):
    v = R(s, d, "vectors")
    q = lambda c: K.quantised(F.col(c), -1.0, 1.0, 16)
    return v.select("vec_id", K.morton([q("x"), q("y"), q("z")]).alias("m3"), K.morton([q("x"), q("y"), q("z"), q("w")]).alias("m4"))


def p28_hilbert_codes(s, d):
    return L.with_codes(R(s, d, "vectors"), "vec_id", -1.0, 1.0).select("vec_id", "code")


def o2_code_order(s, d):
    v = L.with_codes(R(s, d, "vectors"), "vec_id", -1.0, 1.0, "morton")
    return L.with_rank(v.withColumn("code", F.shiftright("code", 20)), "vec_id").select("vec_id", "code", "rank")


def a21_centroid_bounds(s, d):
    boxes = R(s, d, "bricks").select("brick_id", *G.brick_box())
    return L.centroid_bounds(boxes)


def _ranked(s, d):
    return materialise(L.with_rank(L.with_codes(R(s, d, "vectors"), "vec_id", -1.0, 1.0), "vec_id").select("rank", "vec_id", "x", "y", "z"))


def a22_merged_clusters(s, d):
    return L.merge(_ranked(s, d), 12).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))


def a23_cluster_boxes(s, d):
    points = _ranked(s, d)
    return rounded(L.cluster_boxes(points, L.merge(points, 12)), "lx", "ly", "lz", "hx", "hy", "hz")


def g6_majorant_tree(s, d):
    """The tree over all cells of bricks, each half a cell wider, at 10 and at 1,000 leaves."""
    cells = M.brick_cells(bricks(s, d))
    boxes = cells.select(*[c.alias(f"b_{n}") for n, c in zip(T.SIDES, G.cell_box(0.5))], F.col("value").alias("b_vmin"), F.col("value").alias("b_vmax"))
    return rounded(T.build(s, boxes, (-4.0,) * 3, (124.0,) * 3, RAMP, (0.0, 1.0), [10, 1000]), "majorant")


def _unit_rays(s, d):
    r = R(s, d, "rays")
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    return r.withColumns({f"_{a}": F.col(f"d{a}") / n for a in "xyz"}).withColumns({f"d{a}": F.col(f"_{a}") for a in "xyz"}).drop("_x", "_y", "_z")


def _alpha(value):
    return lookup(value, RAMP, 0.0, 0.08)["a"]


def _majorants(cells):
    return M.with_majorants(M.cell_ranges(cells, LOW, HIGH, DIMS), RAMP, 0.0, 0.08)


def _collisions(s, d):
    r, cells = _unit_rays(s, d), materialise(R(s, d, "cells"))
    return r, materialise(X.with_extinction(X.tentative(r, materialise(_majorants(cells)), LOW, HIGH, DIMS, 0.05, 3), r, X.Lattice.of(cells), _alpha, 0.05))


def t1_free_paths(s, d):
    return X.free_paths(_collisions(s, d)[1], 3)


def t2_transmittance(s, d):
    return X.transmittance(*_collisions(s, d))


def t5_path_traced(s, d):
    cells = materialise(R(s, d, "cells"))
    return X.trace(_unit_rays(s, d), cells, _majorants(cells), _alpha, LOW, HIGH, DIMS, scale=0.05, light=(32.0, 80.0, 32.0))


def t6_direct_light(s, d):
    cells = materialise(R(s, d, "cells"))
    return X.trace(_unit_rays(s, d), cells, _majorants(cells), _alpha, LOW, HIGH, DIMS, scale=0.05, light=(32.0, 80.0, 32.0), bounces=1)


def s1_cell_files(s, d):
    """Cells and scalars written as binary files and read again."""
    numbered = materialise(R(s, d, "cells").select(F.col("cell_id").alias("key"), "x", "y", "z", "level", "value"))
    at = shared_dir(s)
    order = numbered.orderBy("key")
    binary.write_cells(order.withColumnRenamed("key", "cell_id"), f"{at}/cells")
    binary.write_scalars(order.select(F.col("key").alias("idx"), "value"), f"{at}/scalars")
    return rounded(binary.read_cells(s, f"{at}/cells", f"{at}/scalars").drop("cell_id"), "value")


def s3_brick_files(s, d):
    b = R(s, d, "bricks").withColumn("ids", F.transform(F.sequence(F.lit(0), F.col("sx") * F.col("sy") * F.col("sz") - 1), lambda i: (F.col("brick_id") * 100 + i).cast("int")))
    at = shared_dir(s)
    binary.write_bricks(b, at)
    read = binary.read_bricks(s, at)
    return read.select((F.col("ids")[0] / 100).cast("long").alias("brick_id"), "lx", "ly", "lz", "sx", "sy", "sz", "level", F.size("ids").alias("n"))


def s9_triangle_files(s, d):
    t = R(s, d, "triangles").select(F.lit(0).cast("long").alias("mesh_id"), "tri_id", F.array("ax", "ay", "az").alias("v1"), F.array("bx", "b_y", "bz").alias("v2"), F.array("cx", "cy", "cz").alias("v3"))
    at = shared_dir(s)
    binary.write_triangles(t, at)
    return binary.read_triangles(s, at).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v1")[0]).alias("x1"), F.sum(F.col("v3")[2]).alias("z3"))


def s15_blocks(s, d):
    """The field of two API blocks, sampled along x."""
    v = Volume.from_blocks(s, [((0, 0, 0, 1, 1, 1), 0, [i / 8 for i in range(8)]), ((1, 0, 0, 1, 0, 0), 1, [1.0])], (0.0,) * 3, (4.0, 2.0, 2.0))
    points = s.range(41).select(F.col("id").alias("pid"), (F.col("id") / 10.0).alias("px"), F.lit(1.0).alias("py"), F.lit(1.0).alias("pz"))
    return rounded(v.field.sample(points), "value")


def k8_box_faces(s, d):
    f = binary.box_faces(R(s, d, "bricks").select("brick_id", *G.brick_box()), "brick_id")
    return f.select("brick_id", "face", F.round(F.aggregate("corners", F.lit(0.0), lambda a, c: a + c[0]), 4).alias("x"), F.round(F.aggregate("corners", F.lit(0.0), lambda a, c: a + c[2]), 4).alias("z"))


def c1_rendered_volume(s, d):
    """The whole path: camera, grid, majorants, samples, compositing."""
    v = Volume(CellField(R(s, d, "cells")), LOW, HIGH, DIMS).transfer_function(RAMP, (0.0, 0.0837))
    view = G.camera((32.0, 32.0, -60.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), 0.9, 1.0, 16, 16)
    return rounded(v.render(view, 16, 16, 2.0), "r", "g", "b", "alpha")


_NAMES = "p27_morton_codes p28_hilbert_codes o2_code_order a21_centroid_bounds a22_merged_clusters a23_cluster_boxes g6_majorant_tree t1_free_paths t2_transmittance t5_path_traced t6_direct_light s1_cell_files s3_brick_files s9_triangle_files s15_blocks k8_box_faces c1_rendered_volume".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_Q = lambda c: f"CAST(least(65535, greatest(0, floor(({c} + 1) / 2 * 65536))) AS BIGINT)"
_interleave = lambda axes: " + ".join(f"(({c} >> {k}) & 1) * {1 << (k * len(axes) + i)}::BIGINT" if k * len(axes) + i < 63 else f"CASE WHEN (({c} >> {k}) & 1) = 1 THEN -9223372036854775807 - 1 ELSE 0 END" for i, c in enumerate(axes) for k in range(16))
_CODES = "(SELECT vec_id, " + ", ".join(f"{_Q(c)} AS {c}" for c in "xyzw") + " FROM {vectors})"


def _tree_sql(targets: tuple[int, ...], rounds: int) -> str:
    """The same tree against the cells themselves: rounds of fronts, written out one after the other; those after the last are empty."""
    sides = [f"{e}{a}" for e in "lh" for a in "xyz"]
    columns = ", ".join(sides)
    alphas = "[" + ", ".join(f"{e[3]!r}e0" if "e" not in repr(e[3]) else repr(e[3]) for e in RAMP) + "]"
    last = len(RAMP) - 1
    place = lambda v, more: f"least({last}, greatest(0, CAST(floor({v} * {last}) AS INT) + {more}))"
    extent = "(hx > lx OR hy > ly OR hz > lz)"
    cut = lambda side, edge: ", ".join(f"CASE WHEN axis = {i} AND side = {side} THEN plane ELSE {edge}{a} END AS {edge}{a}" for i, a in enumerate("xyz"))
    steps = [
        f"boxes AS MATERIALIZED (SELECT " + ", ".join(f"{a} - 0.5e0 * w AS b_l{a}, {a} + 1.5e0 * w AS b_h{a}" for a in "xyz") + f", value FROM ({_BRICK_CELLS}))",
        "k0 AS MATERIALIZED (SELECT '' AS path, 0 AS depth, " + ", ".join(f"{-4.0 if c[0] == 'l' else 124.0}e0 AS {c}" for c in sides) + ", 1e0 AS majorant, CAST('infinity' AS DOUBLE) AS cost)",
        "s0 AS (SELECT '' AS path WHERE false)",
    ]
    for r in range(rounds):
        steps += [
            f"f{r} AS MATERIALIZED (SELECT * FROM (SELECT * FROM k{r} WHERE {extent} ORDER BY cost DESC, depth, path LIMIT {max(targets) - 1}) WHERE path NOT IN (SELECT path FROM s{r}))",
            f"p{r} AS (SELECT *, CASE axis WHEN 0 THEN lx + k * ((hx - lx) / 8) WHEN 1 THEN ly + k * ((hy - ly) / 8) ELSE lz + k * ((hz - lz) / 8) END AS plane FROM f{r}, range(3) a(axis), range(1, 8) b(k), range(2) c(side) WHERE CASE axis WHEN 0 THEN hx > lx WHEN 1 THEN hy > ly ELSE hz > lz END)",
            f"h{r} AS MATERIALIZED (SELECT path, depth, axis, k, side, {cut(1, 'l')}, {cut(0, 'h')} FROM p{r})",
            f"v{r} AS (SELECT path, axis, k, side, min(value) AS vmin, max(value) AS vmax FROM h{r} JOIN boxes ON " + " AND ".join(f"b_l{a} < h{a} AND b_h{a} > l{a}" for a in "xyz") + " GROUP BY path, axis, k, side)",
            f"c{r} AS MATERIALIZED (SELECT *, 2e0 * ((hx - lx) * (hy - ly) + (hy - ly) * (hz - lz) + (hz - lz) * (hx - lx)) * sqrt((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly) + (hz - lz) * (hz - lz)) * majorant AS cost FROM (SELECT h.*, coalesce(list_max(list_slice({alphas}, {place('vmin', 0)} + 1, {place('vmax', 1)} + 1)), 0e0) AS majorant FROM h{r} h LEFT JOIN v{r} v USING (path, axis, k, side)))",
            f"b{r} AS (SELECT path, axis, k FROM (SELECT path, axis, k, row_number() OVER (PARTITION BY path ORDER BY sum(CASE WHEN side = 0 THEN cost END) + sum(CASE WHEN side = 1 THEN cost END), axis, k) AS n FROM c{r} GROUP BY path, axis, k) WHERE n = 1)",
            f"k{r + 1} AS MATERIALIZED (SELECT * FROM k{r} UNION ALL SELECT c.path || side, depth + 1, {columns}, majorant, cost FROM c{r} c JOIN b{r} USING (path, axis, k))",
            f"s{r + 1} AS MATERIALIZED (SELECT path FROM s{r} UNION ALL SELECT path FROM f{r})",
        ]
    found = []
    for n in targets:
        first = f"(SELECT path FROM k{rounds} WHERE {extent} ORDER BY cost DESC, depth, path LIMIT {n - 1})"
        found.append(f"SELECT {n} AS leaves, row_number() OVER (ORDER BY {columns}) - 1 AS domain_id, {columns}, round(majorant, 6) AS majorant FROM k{rounds} WHERE path NOT IN {first} AND (path = '' OR substr(path, 1, length(path) - 1) IN {first})")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(found)


ORACLES = {
    k: oracle(v)
    for k, v in {
        "p27_morton_codes": f"SELECT vec_id, {_interleave('xyz')} AS m3, {_interleave('xyzw')} AS m4 FROM {_CODES}",
        "p28_hilbert_codes": f"SELECT vec_id, list_reduce(list_prepend(CAST({K.START} AS BIGINT), list_transform(range(15, -1, -1), lambda k: CAST((x >> k & 1) + 2 * (y >> k & 1) + 4 * (z >> k & 1) AS BIGINT))), lambda a, o: (a // 32 * 8 + {K.BY_OCTANT}[a % 32 * 8 + o + 1] % 8) * 32 + {K.BY_OCTANT}[a % 32 * 8 + o + 1] // 8) // 32 AS code FROM {_CODES}",
        "o2_code_order": f"SELECT vec_id, code, row_number() OVER (ORDER BY code, vec_id) - 1 AS rank FROM (SELECT vec_id, ({_interleave('xyzw')}) >> 20 AS code FROM {_CODES})",
        "a21_centroid_bounds": "SELECT min(least(a, b, c)) AS low, max(greatest(a, b, c)) AS high FROM (SELECT " + ", ".join(f"(l{a} + l{a} + s{a} * power(2e0, level)) / 2 AS {n}" for a, n in zip("xyz", "abc")) + " FROM {bricks})",
        "g6_majorant_tree": _tree_sql((10, 1000), 40),
        "s1_cell_files": "SELECT x, y, z, level, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM {cells}",
        "s3_brick_files": "SELECT brick_id, lx, ly, lz, sx, sy, sz, level, sx * sy * sz AS n FROM {bricks}",
        "s9_triangle_files": "SELECT count(*) AS n, sum(ax) AS x1, sum(cz) AS z3 FROM {triangles}",
        "k8_box_faces": "SELECT brick_id, CAST(f AS INT) AS face, round(CASE f WHEN 4 THEN 4 * x0 WHEN 5 THEN 4 * x1 ELSE 2 * x0 + 2 * x1 END, 4) AS x, round(CASE f WHEN 0 THEN 4 * z0 WHEN 1 THEN 4 * z1 ELSE 2 * z0 + 2 * z1 END, 4) AS z FROM (SELECT brick_id, CAST(lx AS DOUBLE) AS x0, lx + sx * power(2e0, level) AS x1, CAST(lz AS DOUBLE) AS z0, lz + sz * power(2e0, level) AS z1 FROM {bricks}) CROSS JOIN (SELECT range AS f FROM range(6))",
    }.items()
}
