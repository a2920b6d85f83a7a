"""Sampling, grids, lookup, dual meshes, bricks, meshes and rays: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import elements as E
from lattica.functions import geometry as G
from lattica.functions.transfer import lookup, ramp
from lattica.operators import bricks as B
from lattica.operators import cells as C
from lattica.operators import fields as S
from lattica.operators import grid as M
from lattica.operators import mesh as U
from lattica.operators import numbering as N
from lattica.operators import pyramid as P
from lattica.operators import rays as Y
from lattica.operators import wavefront as W
from lattica.operators.range_join import join_points
from lattica.plans.derived import oracle
from lattica.plans.derived import relation as R
from lattica.plans.geometry_queries import rounded
from lattica.storage import materialise

LOW, HIGH, DIMS = (0.0, 0.0, 0.0), (64.0, 64.0, 64.0), (8, 8, 8)
BLOW, BHIGH, BDIMS, RDIMS = (-4.0, -4.0, -4.0), (124.0, 124.0, 124.0), (16, 16, 16), (32, 32, 32)
RAMP = ramp()


def bricks(s, d):
    """Bricks with the scalars that their id and the cell's place give."""
    n = F.col("sx") * F.col("sy") * F.col("sz")
    return R(s, d, "bricks").withColumn("scalars", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.col("brick_id") * 31 + i * 17, F.lit(100)) / 100.0))


def gridlets(s, d):
    """Bricks read as gridlets: their cells' scalars are at vertices, so a brick of n cells an axis has n - 1; none empty."""
    b = R(s, d, "bricks").select(F.col("brick_id").alias("gridlet_id"), "level", "lx", "ly", "lz", F.col("sx").alias("dx"), F.col("sy").alias("dy"), F.col("sz").alias("dz"))
    n = (F.col("dx") + 1) * (F.col("dy") + 1) * (F.col("dz") + 1)
    return b.withColumn("scalars", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.pmod(F.col("gridlet_id") + i, F.lit(11)) > 0, F.pmod(F.col("gridlet_id") * 31 + i * 17, F.lit(100)) / 100.0)))


def elements(s, d):
    """A hex a part (on its eight vertices, in VTK order), with tets, pyramids and wedges on the same vertices of other parts."""
    p = R(s, d, "part").select("p_partkey")
    ids = lambda *c: F.array(*[F.col("p_partkey") * 8 + k for k in c])
    kind = lambda k, *c: p.where(F.col("p_partkey") % 4 == k).select(F.col("p_partkey").alias("elem_id"), ids(*c).alias("vertex_ids"))
    return U.assemble({"hex": kind(0, 0, 1, 3, 2, 4, 5, 7, 6), "tet": kind(1, 0, 1, 2, 4), "pyr": kind(2, 0, 1, 3, 2, 4), "wedge": kind(3, 0, 1, 2, 4, 5, 6)})


def hits(s, d, kind=None):
    """Values of all elements at points, or of one kind only."""
    of_kind = elements(s, d) if kind is None else elements(s, d).where(F.col("kind") == kind)
    packed = U.packed(U.corners(of_kind, R(s, d, "vertices")))
    return S.sample_elements(R(s, d, "brick_points"), packed)


def a1_bounds_and_range(s, d):
    c = R(s, d, "cells")
    return c.select(*G.cell_box(), "value").agg(*[F.min(f"l{a}").alias(f"l{a}") for a in "xyz"], *[F.max(f"h{a}").alias(f"h{a}") for a in "xyz"], F.min("value").alias("vmin"), F.max("value").alias("vmax"))


def a2_dense_macrocells(s, d):
    return M.dense(s, M.cell_ranges(R(s, d, "cells"), LOW, HIGH, DIMS), DIMS)


def a3_element_ranges(s, d):
    return M.element_ranges(U.corners(elements(s, d), R(s, d, "vertices")), BLOW, BHIGH, BDIMS)


def a4_gridlet_ranges(s, d):
    return M.gridlet_ranges(gridlets(s, d), (0.0,) * 3, (256.0,) * 3, (16, 16, 16))


def a5_cell_ranges(s, d):
    return M.cell_ranges(R(s, d, "cells"), LOW, HIGH, DIMS)


def a7_brick_ranges(s, d):
    return M.brick_ranges(bricks(s, d), BLOW, BHIGH, BDIMS)


def a8_largest_gridlet(s, d):
    return gridlets(s, d).agg(*[F.max(f"d{a}").alias(f"d{a}") for a in "xyz"])


def a9_gridlet_value_ranges(s, d):
    return M.gridlet_value_range(gridlets(s, d))


def a10_macrocell_majorants(s, d):
    return rounded(M.with_majorants(M.cell_ranges(R(s, d, "cells"), LOW, HIGH, DIMS), RAMP, 0.0, 0.08), "max_opacity")


def g8_active_macrocells(s, d):
    return M.with_majorants(M.cell_ranges(R(s, d, "cells"), LOW, HIGH, DIMS), RAMP, 0.03, 0.08).where("max_opacity > 0").select("mc_id")


def a11_splatted_ranges(s, d):
    return B.splatted_ranges(bricks(s, d))


def a12_vertex_compaction(s, d):
    vertices, renamed = U.compact(elements(s, d), R(s, d, "vertices"))
    return renamed.select("elem_id", "kind", F.array_join("vertex_ids", ",").alias("ids"))


def a13_elements_by_kind(s, d):
    return elements(s, d).withColumn("by_size", U.kind_of()).groupBy("kind", "by_size").agg(F.count(F.lit(1)).alias("n"))


def a14_memory_statistics(s, d):
    g = gridlets(s, d)
    e = g.agg(F.sum(F.size("scalars")).alias("scalars"), F.sum(F.size(F.filter("scalars", lambda v: v.isNull()))).alias("empty"), F.count(F.lit(1)).alias("n"))
    return e.select("scalars", "empty", (F.col("scalars") * 4 + F.col("n") * 40).alias("bytes"), F.format_number((F.col("scalars") * 4 + F.col("n") * 40) / 1024.0, 1).alias("kib"))


def a24_distinct_vertices(s, d):
    return U.distinct_vertices(R(s, d, "vertices")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))


def a27_accumulated_pixels(s, d):
    f = R(s, d, "frames").groupBy("pixel").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("frames"))
    return rounded(f.select("pixel", "frames", (F.col("total") / F.col("frames")).alias("mean")), "mean")


def a28_frame_times(s, d):
    e = R(s, d, "events").where("event_id BETWEEN 11 AND 510").agg(F.avg("value").alias("mean"))
    return rounded(e.select("mean", (1 / F.col("mean")).alias("fps")), "mean", "fps")


def e1_gridlet_trilinear(s, d):
    return rounded(S.sample_gridlets(R(s, d, "brick_points"), gridlets(s, d)), "value")


def e2_tetrahedra(s, d):
    return rounded(hits(s, d, "tet").select("pid", "elem_id", "value"), "value")


def e5_hexahedra(s, d):
    return rounded(hits(s, d, "hex").select("pid", "elem_id", "value"), "value")


def e6_plane_ratios(s, d):
    packed = join_points(R(s, d, "brick_points"), U.packed(U.corners(elements(s, d), R(s, d, "vertices"))))
    return rounded(E.with_plane_ratio_value(packed.where("kind = 'hex'"), "hex", keep=["pid", "elem_id"]), "value")


def e6_tilted_hexes(s, d):
    """Hexes whose right face leans outwards, by 1.5 over their height."""
    corner = F.col("vertex_id") % 8
    leaning = R(s, d, "vertices").withColumn("x", F.col("x") + F.when((corner % 2 == 1) & (corner >= 4), 1.5).otherwise(0.0))
    packed = U.packed(U.corners(elements(s, d).where("kind = 'hex'"), leaning))
    return rounded(E.with_plane_ratio_value(join_points(R(s, d, "brick_points"), packed), "hex", keep=["pid", "elem_id"]), "value")


def j1_sample_cells(s, d):
    return rounded(S.sample_cells(R(s, d, "points"), R(s, d, "cells")), "value")


def j2_sample_regions(s, d):
    b = bricks(s, d)
    return rounded(S.sample_regions(R(s, d, "brick_points"), B.regions(b), b), "value")


def j3_sample_bricks(s, d):
    return rounded(S.sample_bricks(R(s, d, "brick_points"), bricks(s, d)), "value")


def j9_find_cells(s, d):
    return C.find_cells(R(s, d, "points"), R(s, d, "cells"), ["pid"], keep=["value"])


def j10_dual_cells(s, d):
    return C.dual_cells(R(s, d, "patch")).select("cell_id", "min_level", "max_level", "n_unique", F.array_join(F.col("corners.id"), ",").alias("corners"))


def g3_dual_elements(s, d):
    return C.classify(C.dual_cells(R(s, d, "patch"))).select("cell_id", "kind", "perfect_level", F.array_join("vertex_ids", ",").alias("vertices"))


def a20_element_counts(s, d):
    return C.element_counts(C.classify(C.dual_cells(R(s, d, "patch"))))


def g4_gridlets(s, d):
    cells = materialise(R(s, d, "patch"))
    g = C.gridlet_scalars(materialise(C.cluster_gridlets(C.cubes(C.classify(C.dual_cells(cells)), cells))), cells)
    n = F.size(F.filter("scalars", lambda v: v.isNotNull()))
    total = F.aggregate(F.filter("scalars", lambda v: v.isNotNull()), F.lit(0.0), lambda a, b: a + b)
    return rounded(g.select("level", "mx", "my", "mz", "lx", "ly", "lz", "dx", "dy", "dz", "n_cubes", n.alias("filled"), total.alias("total")), "total")


def a19_gridlet_counts(s, d):
    cells = materialise(R(s, d, "patch"))
    return C.gridlet_counts(C.cluster_gridlets(C.cubes(C.classify(C.dual_cells(cells)), cells)))


def g5_regions(s, d):
    return B.regions(bricks(s, d))


def a15_region_ranges(s, d):
    b = bricks(s, d)
    return B.region_ranges(B.regions(b), b)


def a16_region_statistics(s, d):
    return B.region_statistics(B.regions(bricks(s, d)))


def g9_shared_faces(s, d):
    return C.faces_shared(C.classify(C.dual_cells(R(s, d, "patch"))))


def j11_scalar_lookup(s, d):
    b = M.brick_cells(bricks(s, d))
    return rounded(b.groupBy("brick_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("x").alias("x0"), F.max("z").alias("z1")), "total")


def j12_vertex_lookup(s, d):
    p = U.packed(U.corners(elements(s, d), R(s, d, "vertices")))
    return rounded(p.select("elem_id", "kind", "lx", "ly", "lz", "hx", "hy", "hz", F.array_max("vs").alias("vmax")), "vmax")


def j14_adjacent_bricks(s, d):
    return B.adjacent(R(s, d, "bricks"))


def j15_rays_and_boxes(s, d):
    boxes = R(s, d, "bricks").select("brick_id", *G.brick_box())
    return rounded(Y.box_hits(R(s, d, "rays"), boxes, "brick_id", BLOW, BHIGH, RDIMS), "t0", "t1")


def o6_first_box(s, d):
    boxes = R(s, d, "bricks").select("brick_id", *G.brick_box())
    return rounded(Y.first_box(R(s, d, "rays"), boxes, "brick_id", BLOW, BHIGH, RDIMS), "t0")


def j16_rays_and_triangles(s, d):
    return rounded(Y.triangle_hits(R(s, d, "rays"), R(s, d, "triangles"), (0.0, 0.0, 0.0), (80.0, 80.0, 80.0), (10, 10, 10)), "t", "nx", "ny", "nz")


def j17_box_ranges(s, d):
    probes = R(s, d, "bricks").select(F.col("brick_id").alias("probe_id"), *[c.alias(f"a_{n}") for n, c in zip(B.SIDES, G.brick_domain())])
    boxes = R(s, d, "cells").select(*[c.alias(f"b_{n}") for n, c in zip(B.SIDES, G.cell_box())], F.col("value").alias("b_vmin"), F.col("value").alias("b_vmax"))
    return P.ranges(P.build(boxes), probes)


def w1_grid_walk(s, d):
    return rounded(M.walk(R(s, d, "rays"), LOW, HIGH, DIMS), "t0", "t1")


def samples(s, d):
    """Line items as samples along rays: the order is the ray, the line number the place."""
    l = R(s, d, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("ray_id"), F.col("l_linenumber").alias("t")).agg(F.max(F.col("l_discount") * 9).alias("a"), F.max(F.col("l_quantity") / 50.0).alias("r"))


def w4_composite(s, d):
    return rounded(Y.composite(samples(s, d), ("r",)), "r", "alpha")


def w5_first_step(s, d):
    seg = M.walk(R(s, d, "rays"), LOW, HIGH, DIMS)
    return Y.steps(seg, 1.5).groupBy("ray_id").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


def w6_region_steps(s, d):
    regions = R(s, d, "bricks").select("brick_id", G.width("level").alias("w"), *G.brick_box())
    seg = Y.box_hits(R(s, d, "rays"), regions, "brick_id", BLOW, BHIGH, RDIMS, keep=["w"])
    st = Y.steps(seg, F.col("w") * 0.5).withColumn("a", Y.corrected(F.lit(0.3), F.col("w") * 0.5))
    return rounded(st.groupBy("ray_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a")), "a")


def t7_ray_march(s, d):
    cells = R(s, d, "cells")
    maj = M.with_majorants(M.cell_ranges(cells, LOW, HIGH, DIMS), RAMP, 0.0, 0.0837)
    rays = R(s, d, "rays")
    seg = M.walk(rays, LOW, HIGH, DIMS).join(maj.where("max_opacity > 0").select("mc_id"), "mc_id", "left_semi")
    st = Y.steps(seg, 2.0).select("ray_id", "i", "t").distinct().join(rays, "ray_id")
    pts = st.select(F.struct("ray_id", "i", "t").alias("pid"), *[(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"p{a}") for a in "xyz"])
    c = lookup(F.col("value"), RAMP, 0.0, 0.0837)
    lit = S.sample_cells(pts, cells).select("pid.ray_id", "pid.t", c["r"].alias("r"), c["a"].alias("a"))
    return rounded(Y.composite(lit, ("r",)), "r", "alpha")


def w4_wavefront_march(s, d):
    """The rows of t7_ray_march, in fronts that leave out what opaque rays don't see."""
    cells = materialise(R(s, d, "cells"))
    maj = M.with_majorants(M.cell_ranges(cells, LOW, HIGH, DIMS), RAMP, 0.0, 0.0837)
    rays = R(s, d, "rays")
    seg = M.walk(rays, LOW, HIGH, DIMS).join(maj.where("max_opacity > 0").select("mc_id"), "mc_id", "left_semi")
    lattice = S.Lattice.of(cells)
    shade = lambda v: {c: lookup(v, RAMP, 0.0, 0.0837)[c] for c in "ra"}
    return rounded(W.march(rays, seg, lambda points: S.sample_cells(points, lattice), shade, 2.0, ("r",)), "r", "alpha")


def p30_mirrored_walk(s, d):
    return rounded(M.mirrored_walk(R(s, d, "rays"), LOW, HIGH, DIMS, 1, 64.0), "t0", "t1")


def g9_oriented_faces(s, d):
    elements = C.classify(C.dual_cells(R(s, d, "patch"))).withColumn("elem", F.struct("cell_id", "octant"))
    found = C.conformity(C.oriented_faces(elements))
    return found.groupBy(F.size("face").cast("long").alias("corners"), "state").agg(F.count(F.lit(1)).alias("faces"))


def w7_running_sum(s, d):
    o = R(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("v"))
    return N.running_sum(o, "o_orderkey", "v", "total").select("o_orderkey", "total")


def w8_run_lengths(s, d):
    o = R(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return N.run_lengths(o, "o_orderkey", "status").groupBy("status", "n").agg(F.count(F.lit(1)).alias("runs"))


_NAMES = "a1_bounds_and_range a2_dense_macrocells a3_element_ranges a4_gridlet_ranges a5_cell_ranges a7_brick_ranges a8_largest_gridlet a9_gridlet_value_ranges a10_macrocell_majorants g8_active_macrocells a11_splatted_ranges a12_vertex_compaction a13_elements_by_kind a14_memory_statistics a24_distinct_vertices a27_accumulated_pixels a28_frame_times e1_gridlet_trilinear e2_tetrahedra e5_hexahedra e6_plane_ratios e6_tilted_hexes j1_sample_cells j2_sample_regions j3_sample_bricks j9_find_cells j10_dual_cells g3_dual_elements a20_element_counts g4_gridlets a19_gridlet_counts g5_regions a15_region_ranges a16_region_statistics g9_shared_faces j11_scalar_lookup j12_vertex_lookup j14_adjacent_bricks j15_rays_and_boxes o6_first_box j16_rays_and_triangles j17_box_ranges w1_grid_walk w4_composite w5_first_step w6_region_steps t7_ray_march w4_wavefront_march p30_mirrored_walk g9_oriented_faces w7_running_sum w8_run_lengths".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_ALPHA = "(CASE i " + " ".join(f"WHEN {i} THEN {e[3]!r}e0" for i, e in enumerate(RAMP)) + " ELSE 0e0 END)"
_TF = "(SELECT range AS i, power(range / 15e0, 2) AS a FROM range(16))"
_bin = lambda v, low, high, dims: f"CAST(greatest(0e0, least({dims - 1}e0, floor(({v} - ({low})) / ({high}e0 - ({low})) * {dims}))) AS INT)"


def _ranges(boxes: str, low: float, high: float, dims: int) -> str:
    """Macrocell ranges of a relation with lx..hz, vmin and vmax."""
    m = {a: (_bin(f"l{a}", low, high, dims), _bin(f"h{a}", low, high, dims)) for a in "xyz"}
    spread = f"SELECT *, " + ", ".join(f"unnest(range({m[a][0]}, {m[a][1]} + 1)) AS m{a}" for a in "x") + f" FROM ({boxes}) b WHERE vmin IS NOT NULL"
    spread = f"SELECT *, unnest(range({m['y'][0]}, {m['y'][1]} + 1)) AS my FROM ({spread})"
    spread = f"SELECT *, unnest(range({m['z'][0]}, {m['z'][1]} + 1)) AS mz FROM ({spread})"
    return f"SELECT CAST(mx + {dims} * (my + {dims} * mz) AS BIGINT) AS mc_id, min(vmin) AS vmin, max(vmax) AS vmax FROM ({spread}) GROUP BY 1"


_CELL_BOXES = "SELECT " + ", ".join(f"{a} - 0.5e0 * power(2e0, level) AS l{a}, {a} + 1.5e0 * power(2e0, level) AS h{a}" for a in "xyz") + ", value AS vmin, value AS vmax FROM {cells}"
_CELL_RANGES = _ranges(_CELL_BOXES, 0, 64, 8)
_BRICK_CELLS = "SELECT brick_id, i, level, w, lx + (i % sx) * w AS x, ly + (i // sx % sy) * w AS y, lz + (i // (sx * sy)) * w AS z, (brick_id * 31 + i * 17) % 100 / 100e0 AS value FROM (SELECT *, power(2e0, level) AS w, unnest(range(sx * sy * sz)) AS i FROM {bricks})"
_GRIDLET = "(SELECT brick_id AS gridlet_id, level, lx, ly, lz, sx AS dx, sy AS dy, sz AS dz FROM {bricks})"
_GS = lambda i: f"(CASE WHEN (gridlet_id + {i}) % 11 > 0 THEN (gridlet_id * 31 + {i} * 17) % 100 / 100e0 END)"
_MAJ = f"(SELECT mc_id, vmin, vmax, max(a) AS max_opacity FROM (SELECT * FROM ({_CELL_RANGES})) r JOIN {_TF} t ON i BETWEEN least(15, greatest(0, CAST(floor((vmin - LO) / (HI - LO) * 15) AS INT))) AND least(15, greatest(0, CAST(floor((vmax - LO) / (HI - LO) * 15) AS INT) + 1)) GROUP BY ALL)"
_maj = lambda lo, hi: _MAJ.replace("LO", lo).replace("HI", hi)
_ELEMENTS = """(SELECT p_partkey AS elem_id, CASE p_partkey % 4 WHEN 0 THEN 'hex' WHEN 1 THEN 'tet' WHEN 2 THEN 'pyr' ELSE 'wedge' END AS kind,
  list_transform(CASE p_partkey % 4 WHEN 0 THEN [0, 1, 3, 2, 4, 5, 7, 6] WHEN 1 THEN [0, 1, 2, 4] WHEN 2 THEN [0, 1, 3, 2, 4] ELSE [0, 1, 2, 4, 5, 6] END, lambda c: p_partkey * 8 + c) AS ids FROM part)"""
_CORNERS = f"(SELECT elem_id, kind, x, y, z, value FROM (SELECT elem_id, kind, unnest(ids) AS vertex_id FROM {_ELEMENTS}) JOIN {{vertices}} USING (vertex_id))"
_BOX = "(SELECT p_partkey, CAST(p_partkey * 37 % 97 AS DOUBLE) AS bx, CAST(p_partkey * 53 % 101 AS DOUBLE) AS b_y, CAST(p_partkey * 71 % 103 AS DOUBLE) AS bz, 2e0 + p_size % 5 AS w FROM part)"
_V = lambda c: f"((p_partkey * 13 + {c} * 29) % 100 / 100e0)"
_LOCAL = f"(SELECT pid, p_partkey, w, (px - bx) / w AS r, (py - b_y) / w AS s, (pz - bz) / w AS t FROM {{brick_points}} JOIN {_BOX} ON px BETWEEN bx AND bx + w AND py BETWEEN b_y AND b_y + w AND pz BETWEEN bz AND bz + w)"
_HEXVAL = " + ".join(f"{_V(c)} * {'r' if c & 1 else '(1 - r)'} * {'s' if c & 2 else '(1 - s)'} * {'t' if c & 4 else '(1 - t)'}" for c in range(8))
_TETVAL = f"{_V(0)} * (1 - r - s - t) + {_V(1)} * r + {_V(2)} * s + {_V(4)} * t"
_GVALUE = """SELECT pid, gridlet_id, ix + dx * (iy + dy * iz) AS cell, v[1] * (1 - fx) * (1 - fy) * (1 - fz) + v[2] * fx * (1 - fy) * (1 - fz) + v[3] * (1 - fx) * fy * (1 - fz) + v[4] * fx * fy * (1 - fz)
    + v[5] * (1 - fx) * (1 - fy) * fz + v[6] * fx * (1 - fy) * fz + v[7] * (1 - fx) * fy * fz + v[8] * fx * fy * fz AS value
  FROM (SELECT *, list_transform(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda c: (ix + c % 2) + (dx + 1) * ((iy + c // 2 % 2) + (dy + 1) * (iz + c // 4))), lambda i: CASE WHEN (gridlet_id + i) % 11 > 0 THEN (gridlet_id * 31 + i * 17) % 100 / 100e0 END) AS v
    FROM (SELECT *, qx - ix AS fx, qy - iy AS fy, qz - iz AS fz FROM (SELECT *, """ + ", ".join(f"least(greatest(CAST(floor(q{a}) AS INT), 0), d{a} - 1) AS i{a}" for a in "xyz") + """
      FROM (SELECT pid, g.*, """ + ", ".join(f"p{a} / power(2e0, level) - 0.5e0 - l{a} AS q{a}" for a in "xyz") + f" FROM {{brick_points}} JOIN {_GRIDLET} g ON " + " AND ".join(f"p{a} BETWEEN (l{a} + 0.5e0) * power(2e0, level) AND (l{a} + d{a} + 0.5e0) * power(2e0, level)" for a in "xyz") + ")))) WHERE len(list_filter(v, lambda x: x IS NULL)) = 0"
_SAMPLE = """(SELECT pid, sum(w * value) / sum(w) AS value FROM (
  SELECT p.pid, c.value, """ + " * ".join(f"greatest(0e0, 1 - abs(p.p{a} - (c.{a} + 0.5e0 * p.w)) / p.w)" for a in "xyz") + """ AS w FROM (
    SELECT pid, px, py, pz, level, power(2e0, level) AS w, """ + ", ".join(f"CAST((floor(p{a} / power(2e0, level) - 0.5e0) + (k // {1 << i}) % 2) * power(2e0, level) AS INT) AS {a}" for i, a in enumerate("xyz")) + """
    FROM POINTS CROSS JOIN (SELECT DISTINCT level FROM {cells}) CROSS JOIN (SELECT range AS k FROM range(8))) p
  JOIN {cells} c ON c.level = p.level AND c.x = p.x AND c.y = p.y AND c.z = p.z) GROUP BY pid HAVING sum(w) > 0)"""
_BRICK_VALUE = "SELECT pid, round(sum(wt * value) / sum(wt), 6) AS value FROM (SELECT pid, value, " + " * ".join(f"greatest(0e0, 1 - abs(p{a} - ({a} + 0.5e0 * w)) / w)" for a in "xyz") + f" AS wt FROM ({_BRICK_CELLS}) JOIN {{brick_points}} ON " + " AND ".join(f"p{a} BETWEEN {a} - 0.5e0 * w AND {a} + 1.5e0 * w" for a in "xyz") + ") GROUP BY pid HAVING sum(wt) > 0"
_DOMAIN = ", ".join(f"l{a} - 0.5e0 * power(2e0, level) AS dl{a}, l{a} + (s{a} + 0.5e0) * power(2e0, level) AS dh{a}" for a in "xyz")
_BOUNDS = ", ".join(f"CAST(l{a} AS DOUBLE) AS bl{a}, l{a} + s{a} * power(2e0, level) AS bh{a}" for a in "xyz")
_RAYBOX = "SELECT ray_id, brick_id, w, greatest(tmin, " + ", ".join(f"least((bl{a} - o{a}) / d{a}, (bh{a} - o{a}) / d{a})" for a in "xyz") + ") AS t0, least(tmax, " + ", ".join(f"greatest((bl{a} - o{a}) / d{a}, (bh{a} - o{a}) / d{a})" for a in "xyz") + f") AS t1 FROM {{rays}} CROSS JOIN (SELECT brick_id, power(2e0, level) AS w, {_BOUNDS} FROM {{bricks}})"
_DUAL = """hit AS (
  SELECT n.cell_id, n.l0, i, j, k, arg_min(s.cell_id, s.level) AS f, min(s.level) AS fl FROM (
    SELECT cell_id, level AS l0, i, j, k, x + (i + 0.5e0) * power(2e0, level) AS px, y + (j + 0.5e0) * power(2e0, level) AS py, z + (k + 0.5e0) * power(2e0, level) AS pz
    FROM {patch} CROSS JOIN (SELECT range - 1 AS i FROM range(3)) CROSS JOIN (SELECT range - 1 AS j FROM range(3)) CROSS JOIN (SELECT range - 1 AS k FROM range(3))) n
  CROSS JOIN (SELECT DISTINCT level FROM {patch}) v JOIN {patch} s ON s.level = v.level AND s.x = CAST(floor(px / power(2e0, v.level)) * power(2e0, v.level) AS INT)
    AND s.y = CAST(floor(py / power(2e0, v.level)) * power(2e0, v.level) AS INT) AND s.z = CAST(floor(pz / power(2e0, v.level)) * power(2e0, v.level) AS INT) GROUP BY ALL),
oct AS (SELECT 2 * a - 1 AS dx, 2 * b - 1 AS dy, 2 * c - 1 AS dz FROM (SELECT range AS a FROM range(2)), (SELECT range AS b FROM range(2)), (SELECT range AS c FROM range(2))),
dual AS (SELECT cell_id, dx, dy, dz, min(fl) AS min_level, max(fl) AS max_level, count(DISTINCT f) AS n_unique, count(*) AS n, min(l0) AS l0, min(CASE WHEN fl = l0 THEN f END) AS owner,
    list(f ORDER BY f) AS ids, """ + ", ".join(f"max(CASE WHEN (i = 0) = (dx {'<' if c[0] else '>'} 0) AND (j = 0) = (dy {'<' if c[1] else '>'} 0) AND (k = 0) = (dz {'<' if c[2] else '>'} 0) THEN f END) AS v{n}" for n, c in enumerate(C.CORNERS)) + """
  FROM hit CROSS JOIN oct WHERE i IN (0, dx) AND j IN (0, dy) AND k IN (0, dz) GROUP BY cell_id, dx, dy, dz
  HAVING count(*) = 8 AND min(fl) = min(l0) AND min(CASE WHEN fl = l0 THEN f END) = cell_id)"""
_FACE = {"bottom": (0, 1, 2, 3), "top": (4, 5, 6, 7), "front": (0, 1, 5, 4), "back": (3, 2, 6, 7), "left": (0, 3, 7, 4), "right": (1, 2, 6, 5)}
_eq = lambda *v: " AND ".join(f"v{a} = v{b}" for a, b in zip(v, v[1:]))
_OPPOSITE = {"bottom": "top", "top": "bottom", "front": "back", "back": "front", "left": "right", "right": "left"}
_TET = " ".join(f"WHEN {_eq(*_FACE[f])} THEN " + " OR ".join(f"v{_FACE[o][k]} = v{_FACE[o][(k + 1) % 4]}" for k in range(4)) for f, o in _OPPOSITE.items())
_WEDGE = " OR ".join(f"(v{a} = v{b} AND v{c} = v{e}) OR (v{a} = v{e} AND v{b} = v{c})" for a, b, e, c in ((q[0], q[1], q[3], q[2]) for q in _FACE.values()))
_KIND = f"""kinds AS (SELECT *, CASE WHEN min_level = max_level OR n_unique = 8 THEN 'hex' WHEN n_unique < 4 THEN NULL
    WHEN {' OR '.join('(' + _eq(*f) + ')' for f in _FACE.values())} THEN CASE WHEN n_unique = 5 THEN 'pyr' WHEN n_unique = 4 AND (CASE {_TET} END) THEN 'tet' END
    WHEN {_WEDGE} THEN 'wedge' ELSE 'hex' END AS kind, CASE WHEN min_level = max_level THEN min_level ELSE -1 END AS perfect_level FROM dual)"""
#: Vertices in VTK order. Pyramids: the other side of the collapsed face, then the tip. Tets: that side without the first
#: corner of its first collapsed edge, in turn, then the tip. Wedges: two triangles, each with a collapsed edge as its tip.
_RINGS = {"bottom": (4, 5, 6, 7), "top": (0, 1, 2, 3), "front": (2, 3, 6, 7), "back": (0, 1, 4, 5), "left": (1, 2, 5, 6), "right": (0, 3, 4, 7)}
_joined = lambda ids: "concat_ws(',', " + ", ".join(f"v{i}" for i in ids) + ")"
_PYR_ORDER = " ".join(f"WHEN {_eq(*sorted(_FACE[f]))} THEN {_joined((*r, min(_FACE[f])))}" for f, r in _RINGS.items())
_beside = lambda a, b: (a, b) in {tuple(sorted(e)) for q in _FACE.values() for e in zip(q, q[1:] + q[:1])} or (b, a) in {tuple(sorted(e)) for q in _FACE.values() for e in zip(q, q[1:] + q[:1])}
_TET_ORDER = " ".join(f"WHEN {_eq(*sorted(_FACE[f]))} AND v{r[k]} = v{r[(k + 1) % 4]} THEN {_joined((r[(k + 1) % 4], r[(k + 2) % 4], r[(k + 3) % 4], min(_FACE[f])))}" for f, r in _RINGS.items() for k in range(4) if _beside(r[k], r[(k + 1) % 4]))
_WEDGES = ((0, 1, 4, 5, 3, 2, 7, 6), (0, 4, 1, 5, 3, 7, 2, 6), (3, 2, 7, 6, 0, 1, 4, 5), (3, 7, 2, 6, 0, 4, 1, 5), (4, 5, 7, 6, 0, 1, 3, 2), (4, 7, 5, 6, 0, 3, 1, 2), (0, 1, 3, 2, 4, 5, 7, 6), (0, 3, 1, 2, 4, 7, 5, 6), (0, 3, 4, 7, 1, 2, 5, 6), (0, 4, 3, 7, 1, 5, 2, 6), (1, 2, 5, 6, 0, 3, 4, 7), (1, 5, 2, 6, 0, 4, 3, 7))
#: a = b and c = d are the collapsed edges; a2, b2, c2 and d2 are across the face from them.
_WEDGE_ORDER = " ".join(f"WHEN v{a} = v{b} AND v{c} = v{e} THEN {_joined((a, b2, a2, c, e2, c2))}" for a, b, c, e, a2, b2, c2, e2 in _WEDGES)
_ORDERED = f"CASE kind WHEN 'hex' THEN {_joined(range(8))} WHEN 'pyr' THEN CASE {_PYR_ORDER} END WHEN 'tet' THEN CASE {_TET_ORDER} END ELSE CASE {_WEDGE_ORDER} END END"
_CUBES = "cubes AS (SELECT perfect_level AS level, CAST(floor(c.x / power(2e0, c.level)) AS INT) AS ix, CAST(floor(c.y / power(2e0, c.level)) AS INT) AS iy, CAST(floor(c.z / power(2e0, c.level)) AS INT) AS iz, " + ", ".join(f"v{n}" for n in range(8)) + " FROM kinds JOIN {patch} c ON c.cell_id = v0 WHERE kind = 'hex' AND perfect_level >= 0)"
_VERT = "vert AS (" + " UNION ".join(f"SELECT level, ix // 8 AS mx, iy // 8 AS my, iz // 8 AS mz, ix + {c[0]} AS vx, iy + {c[1]} AS vy, iz + {c[2]} AS vz, v{n} AS id FROM cubes" for n, c in enumerate(C.CORNERS)) + ")"
_BND = "bnd AS (SELECT level, ix // 8 AS mx, iy // 8 AS my, iz // 8 AS mz, " + ", ".join(f"min(i{a}) AS l{a}, max(i{a}) - min(i{a}) + 1 AS d{a}" for a in "xyz") + ", count(*) AS n_cubes FROM cubes GROUP BY ALL)"
_CROSS = "SELECT ray_id, ox, oy, oz, dx, dy, dz, greatest(tmin, " + ", ".join(f"least((0 - o{a}) / d{a}, (64 - o{a}) / d{a})" for a in "xyz") + ") AS e0, least(tmax, " + ", ".join(f"greatest((0 - o{a}) / d{a}, (64 - o{a}) / d{a})" for a in "xyz") + ") AS e1 FROM {rays}"
_WALK = f"""ent AS (SELECT * FROM ({_CROSS}) WHERE e0 < e1),
cut AS (SELECT ray_id, e0 AS t FROM ent UNION SELECT ray_id, e1 FROM ent """ + " ".join(f"UNION SELECT ray_id, (k * 8 - o{a}) / d{a} FROM ent CROSS JOIN (SELECT range + 1 AS k FROM range(7)) WHERE (k * 8 - o{a}) / d{a} BETWEEN e0 AND e1" for a in "xyz") + f"""),
seg AS (SELECT ray_id, t AS t0, lead(t) OVER (PARTITION BY ray_id ORDER BY t) AS t1 FROM cut),
walk AS (SELECT ray_id, CAST(mx + 8 * (my + 8 * mz) AS BIGINT) AS mc_id, t0, t1 FROM (SELECT s.*, """ + ", ".join(f"{_bin(f'(o{a} + (t0 + t1) / 2 * d{a})', 0, 64, 8)} AS m{a}" for a in "xyz") + " FROM seg s JOIN ent USING (ray_id) WHERE t0 < t1))"
_COMPOSITE = "SELECT ray_id, round(sum(c * a * r), 6) AS r, round(sum(c * a), 6) AS alpha FROM (SELECT *, exp(coalesce(sum(CASE WHEN a < 1 THEN ln(1 - a) ELSE -1e3 END) OVER (PARTITION BY ray_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS c FROM smp) WHERE 1 - c < 0.99e0 GROUP BY ray_id"

#: The walk through the volume and its reflection above y = 64, as one grid of twice the cells along y.
_DOUBLED = _WALK.replace("(64 - oy)", "(128 - oy)").replace("UNION SELECT ray_id, (k * 8 - oy) / dy FROM ent CROSS JOIN (SELECT range + 1 AS k FROM range(7))", "UNION SELECT ray_id, (k * 8 - oy) / dy FROM ent CROSS JOIN (SELECT range + 1 AS k FROM range(15))").replace(f"{_bin('(oy + (t0 + t1) / 2 * dy)', 0, 64, 8)} AS my", f"{_bin('(oy + (t0 + t1) / 2 * dy)', 0, 128, 16)} AS my").replace("CAST(mx + 8 * (my + 8 * mz) AS BIGINT) AS mc_id", "CAST(mx + 8 * (CASE WHEN my < 8 THEN my ELSE 15 - my END + 8 * mz) AS BIGINT) AS mc_id, my >= 8 AS mirrored")
_RING = "list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN f[i] <> f[CASE WHEN i = 1 THEN len(f) ELSE i - 1 END] THEN f[i] END), lambda x: x IS NOT NULL)"
_FACES_OF = " UNION ALL ".join(f"SELECT [{', '.join(f'ids[{i + 1}]' for i in f)}] AS f FROM els WHERE kind = '{kind}'" for kind, faces in C.ORIENTED.items() for f in faces)

ORACLES = {
    k: oracle(v)
    for k, v in {
        "a1_bounds_and_range": "SELECT " + ", ".join(f"CAST(min({a}) AS DOUBLE) AS l{a}, max({a} + power(2e0, level)) AS h{a}" for a in "xyz") + ", min(value) AS vmin, max(value) AS vmax FROM {cells}",
        "a2_dense_macrocells": f"SELECT range AS mc_id, coalesce(vmin, 1e30) AS vmin, coalesce(vmax, -1e30) AS vmax FROM range(512) LEFT JOIN ({_CELL_RANGES}) ON range = mc_id",
        "a3_element_ranges": _ranges(f"SELECT elem_id, {', '.join(f'min({a}) AS l{a}, max({a}) AS h{a}' for a in 'xyz')}, min(value) AS vmin, max(value) AS vmax FROM {_CORNERS} GROUP BY elem_id", -4, 124, 16),
        "a4_gridlet_ranges": _ranges("SELECT " + ", ".join(f"(l{a} + i{a} + 0.5e0) * power(2e0, level) AS l{a}, (l{a} + i{a} + 1.5e0) * power(2e0, level) AS h{a}" for a in "xyz") + ", list_min(v) AS vmin, list_max(v) AS vmax FROM (SELECT *, list_filter(list_transform(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda c: (ix + c % 2) + (dx + 1) * ((iy + c // 2 % 2) + (dy + 1) * (iz + c // 4))), lambda i: CASE WHEN (gridlet_id + i) % 11 > 0 THEN (gridlet_id * 31 + i * 17) % 100 / 100e0 END), lambda x: x IS NOT NULL) AS v FROM (SELECT *, i % dx AS ix, i // dx % dy AS iy, i // (dx * dy) AS iz FROM (SELECT *, unnest(range(dx * dy * dz)) AS i FROM " + _GRIDLET + ")))", 0, 256, 16),
        "a5_cell_ranges": _CELL_RANGES,
        "a7_brick_ranges": _ranges("SELECT " + ", ".join(f"{a} - 0.5e0 * w AS l{a}, {a} + 1.5e0 * w AS h{a}" for a in "xyz") + f", value AS vmin, value AS vmax FROM ({_BRICK_CELLS})", -4, 124, 16),
        "a8_largest_gridlet": "SELECT max(sx) AS dx, max(sy) AS dy, max(sz) AS dz FROM {bricks}",
        "a9_gridlet_value_ranges": f"SELECT gridlet_id, min(v) AS vmin, max(v) AS vmax FROM (SELECT gridlet_id, {_GS('i')} AS v FROM (SELECT *, unnest(range((dx + 1) * (dy + 1) * (dz + 1))) AS i FROM {_GRIDLET})) GROUP BY gridlet_id",
        "a10_macrocell_majorants": f"SELECT mc_id, vmin, vmax, round(max_opacity, 6) AS max_opacity FROM {_maj('0e0', '0.08e0')}",
        "g8_active_macrocells": f"SELECT mc_id FROM {_maj('0.03e0', '0.08e0')} WHERE max_opacity > 0",
        "a11_splatted_ranges": f"SELECT brick_id, min(value) AS vmin, max(value) AS vmax FROM (SELECT brick_id, value FROM ({_BRICK_CELLS}) UNION ALL SELECT d.brick_id, c.value FROM ({_BRICK_CELLS}) c JOIN (SELECT brick_id, {_DOMAIN} FROM {{bricks}}) d ON c.brick_id <> d.brick_id AND " + " AND ".join(f"greatest(c.{a} - 0.5e0 * w, dl{a}) < least(c.{a} + 1.5e0 * w, dh{a})" for a in "xyz") + ") GROUP BY brick_id",
        "a12_vertex_compaction": f"WITH u AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id) - 1 AS n FROM (SELECT DISTINCT unnest(ids) AS vertex_id FROM {_ELEMENTS})) SELECT elem_id, kind, string_agg(n, ',' ORDER BY k) AS ids FROM (SELECT elem_id, kind, unnest(ids) AS vertex_id, generate_subscripts(ids, 1) AS k FROM {_ELEMENTS}) JOIN u USING (vertex_id) GROUP BY elem_id, kind",
        "a13_elements_by_kind": f"SELECT kind, kind AS by_size, count(*) AS n FROM {_ELEMENTS} GROUP BY kind",
        "a14_memory_statistics": f"SELECT CAST(sum(s) AS BIGINT) AS scalars, CAST(sum(e) AS BIGINT) AS empty, CAST(4 * sum(s) + 40 * count(*) AS BIGINT) AS bytes, format('{{:,.1f}}', CAST(4 * sum(s) + 40 * count(*) AS DOUBLE) / 1024) AS kib FROM (SELECT (dx + 1) * (dy + 1) * (dz + 1) AS s, len(list_filter(range((dx + 1) * (dy + 1) * (dz + 1)), lambda i: (gridlet_id + i) % 11 = 0)) AS e FROM {_GRIDLET})",
        "a24_distinct_vertices": "SELECT count(*) AS n, round(sum(v), 4) AS v FROM (SELECT min(value) AS v FROM {vertices} GROUP BY x, y, z)",
        "a27_accumulated_pixels": "SELECT pixel, count(*) AS frames, round(avg(value), 6) AS mean FROM {frames} GROUP BY pixel",
        "a28_frame_times": "SELECT round(avg(value), 6) AS mean, round(1 / avg(value), 6) AS fps FROM events WHERE event_id BETWEEN 11 AND 510",
        "e1_gridlet_trilinear": f"SELECT pid, gridlet_id, CAST(cell AS INT) AS cell, round(value, 6) + 0e0 AS value FROM ({_GVALUE})",
        "e2_tetrahedra": f"SELECT pid, p_partkey AS elem_id, round({_TETVAL}, 6) AS value FROM {_LOCAL} WHERE p_partkey % 4 = 1 AND r + s + t <= 1",
        "e5_hexahedra": f"SELECT pid, p_partkey AS elem_id, round({_HEXVAL}, 6) AS value FROM {_LOCAL} WHERE p_partkey % 4 = 0",
        "e6_tilted_hexes": "SELECT pid, elem_id, round(" + " + ".join(f"{'r' if c & 1 else '(1 - r)'} * {'s' if c & 2 else '(1 - s)'} * {'t' if c & 4 else '(1 - t)'} * ((elem_id * 13 + {c * 29}) % 100 / 100e0)" for c in range(8)) + ", 6) AS value FROM (SELECT pid, elem_id, (px - x) / ((px - x) + (x + w + 1.5e0 * (pz - z) / w - px) / sqrt(1 + (1.5e0 / w) * (1.5e0 / w))) AS r, (py - y) / w AS s, (pz - z) / w AS t FROM {brick_points} JOIN (SELECT p_partkey AS elem_id, CAST(p_partkey * 37 % 97 AS DOUBLE) AS x, CAST(p_partkey * 53 % 101 AS DOUBLE) AS y, CAST(p_partkey * 71 % 103 AS DOUBLE) AS z, 2e0 + p_size % 5 AS w FROM part WHERE p_partkey % 4 = 0) ON px >= x AND px <= x + w + 1.5e0 * (pz - z) / w AND py BETWEEN y AND y + w AND pz BETWEEN z AND z + w)",
        "e6_plane_ratios": f"SELECT pid, p_partkey AS elem_id, round({_HEXVAL}, 6) AS value FROM {_LOCAL} WHERE p_partkey % 4 = 0",
        "j1_sample_cells": f"SELECT pid, round(value, 6) AS value FROM {_SAMPLE.replace('POINTS', '{points}')}",
        "j2_sample_regions": _BRICK_VALUE,
        "j3_sample_bricks": _BRICK_VALUE,
        "j9_find_cells": "SELECT pid, arg_min(cell_id, c.level) AS found_id, min(c.level) AS found_level, arg_min(value, c.level) AS value FROM {points} CROSS JOIN (SELECT DISTINCT level FROM {cells}) v JOIN {cells} c ON c.level = v.level AND " + " AND ".join(f"c.{a} = CAST(floor(p{a} / power(2e0, v.level)) * power(2e0, v.level) AS INT)" for a in "xyz") + " GROUP BY pid",
        "j10_dual_cells": f"WITH {_DUAL} SELECT cell_id, min_level, max_level, CAST(n_unique AS INT) AS n_unique, concat_ws(',', {', '.join(f'v{n}' for n in range(8))}) AS corners FROM dual",
        "g3_dual_elements": f"WITH {_DUAL}, {_KIND} SELECT cell_id, kind, perfect_level, {_ORDERED} AS vertices FROM kinds WHERE kind IS NOT NULL",
        "a20_element_counts": f"WITH {_DUAL}, {_KIND} SELECT kind, perfect_level >= 0 AS perfect, count(*) AS n FROM kinds WHERE kind IS NOT NULL GROUP BY ALL",
        "g4_gridlets": f"WITH {_DUAL}, {_KIND}, {_CUBES}, {_VERT}, {_BND} SELECT b.*, f.filled, f.total FROM bnd b JOIN (SELECT v.level, mx, my, mz, CAST(count(*) AS INT) AS filled, round(sum(c.value), 6) AS total FROM vert v JOIN {{patch}} c ON c.cell_id = v.id GROUP BY ALL) f USING (level, mx, my, mz)",
        "a19_gridlet_counts": f"WITH {_DUAL}, {_KIND}, {_CUBES}, {_VERT}, {_BND} SELECT count(*) AS gridlets, CAST(sum(n_cubes) AS BIGINT) AS cubes, CAST(sum((dx + 1) * (dy + 1) * (dz + 1)) AS BIGINT) AS slots, CAST(sum((dx + 1) * (dy + 1) * (dz + 1)) AS BIGINT) - (SELECT count(*) FROM vert) AS empty FROM bnd",
        "g9_shared_faces": f"WITH {_DUAL}, {_KIND}, faces AS (" + " UNION ALL ".join(f"SELECT list_sort([{', '.join(f'v{i}' for i in f)}]) AS face FROM kinds WHERE kind = 'hex'" for f in _FACE.values()) + ") SELECT n, count(*) AS faces FROM (SELECT face, count(*) AS n FROM faces GROUP BY face) GROUP BY n",
        "j11_scalar_lookup": f"SELECT brick_id, count(*) AS n, round(sum(value), 6) AS total, CAST(min(x) AS INT) AS x0, CAST(max(z) AS INT) AS z1 FROM ({_BRICK_CELLS}) GROUP BY brick_id",
        "j12_vertex_lookup": f"SELECT elem_id, kind, {', '.join(f'min({a}) AS l{a}, max({a}) AS h{a}' for a in 'xyz')}, round(max(value), 6) AS vmax FROM {_CORNERS} GROUP BY elem_id, kind",
        "j14_adjacent_bricks": f"WITH dom AS (SELECT brick_id, {_DOMAIN} FROM {{bricks}}) SELECT a.brick_id AS brick_a, b.brick_id AS brick_b FROM dom a JOIN dom b ON a.brick_id <> b.brick_id AND " + " AND ".join(f"greatest(a.dl{x}, b.dl{x}) < least(a.dh{x}, b.dh{x})" for x in "xyz"),
        "j15_rays_and_boxes": f"SELECT ray_id, brick_id, round(t0, 6) AS t0, round(t1, 6) AS t1, CAST(row_number() OVER (PARTITION BY ray_id ORDER BY t0, brick_id) AS INT) AS n FROM ({_RAYBOX}) WHERE t0 < t1",
        "o6_first_box": f"SELECT ray_id, arg_min(brick_id, struct_pack(t0 := t0, b := brick_id)) AS brick_id, round(min(t0), 6) AS t0 FROM ({_RAYBOX}) WHERE t0 < t1 GROUP BY ray_id",
        "j16_rays_and_triangles": """SELECT ray_id, arg_min(tri_id, t) AS tri_id, round(min(t), 6) AS t, round(arg_min(nx, t), 6) AS nx, round(arg_min(ny, t), 6) AS ny, round(arg_min(nz, t), 6) AS nz, 0.8e0 AS albedo FROM (
  SELECT ray_id, tri_id, tmin, tmax, (sx * px + sy * py + sz * pz) / det AS u, (dx * qx + dy * qy + dz * qz) / det AS v, (fx * qx + fy * qy + fz * qz) / det AS t, mx / m AS nx, my / m AS ny, mz / m AS nz FROM (
    SELECT *, sy * ez - sz * ey AS qx, sz * ex - sx * ez AS qy, sx * ey - sy * ex AS qz, ex * px + ey * py + ez * pz AS det, sqrt(mx * mx + my * my + mz * mz) AS m FROM (
      SELECT *, dy * fz - dz * fy AS px, dz * fx - dx * fz AS py, dx * fy - dy * fx AS pz, ey * fz - ez * fy AS mx, ez * fx - ex * fz AS my, ex * fy - ey * fx AS mz FROM (
        SELECT *, bx - ax AS ex, b_y - ay AS ey, bz - az AS ez, cx - ax AS fx, cy - ay AS fy, cz - az AS fz, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM {rays} CROSS JOIN {triangles}))))
  WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > tmin AND t < tmax GROUP BY ray_id""",
        "j17_box_ranges": f"SELECT b.brick_id AS probe_id, min(c.value) AS vmin, max(c.value) AS vmax FROM (SELECT brick_id, {_DOMAIN} FROM {{bricks}}) b JOIN (SELECT *, power(2e0, level) AS w FROM {{cells}}) c ON " + " AND ".join(f"greatest(dl{a}, {a}) < least(dh{a}, {a} + w)" for a in "xyz") + " GROUP BY b.brick_id",
        "w1_grid_walk": f"WITH {_WALK} SELECT ray_id, mc_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM walk",
        "w4_composite": f"WITH smp AS (SELECT l_orderkey AS ray_id, l_linenumber AS t, max(l_discount * 9) AS a, max(l_quantity / 50e0) AS r FROM lineitem GROUP BY ALL) {_COMPOSITE}",
        "w5_first_step": f"WITH {_WALK} SELECT ray_id, count(*) AS n, min(i) AS first, max(i) AS last FROM (SELECT ray_id, unnest(range(CAST(ceil(t0 / 1.5e0) AS BIGINT), CAST(ceil(t1 / 1.5e0) AS BIGINT))) AS i FROM walk) GROUP BY ray_id",
        "w6_region_steps": f"SELECT ray_id, count(*) AS n, round(sum(1 - power(0.7e0, w * 0.5e0)), 6) AS a FROM (SELECT ray_id, w, unnest(range(CAST(ceil(t0 / (w * 0.5e0)) AS BIGINT), CAST(ceil(t1 / (w * 0.5e0)) AS BIGINT))) AS i FROM ({_RAYBOX}) WHERE t0 < t1) GROUP BY ray_id",
        "t7_ray_march": f"WITH {_WALK}, st AS (SELECT DISTINCT ray_id, i FROM (SELECT ray_id, unnest(range(CAST(ceil(t0 / 2e0) AS BIGINT), CAST(ceil(t1 / 2e0) AS BIGINT))) AS i FROM walk WHERE mc_id IN (SELECT mc_id FROM {_maj('0e0', '0.0837e0')} WHERE max_opacity > 0))), pt AS (SELECT ray_id * 10000 + i AS pid, {', '.join(f'o{a} + i * 2e0 * d{a} AS p{a}' for a in 'xyz')} FROM st JOIN {{rays}} USING (ray_id)), smp AS (SELECT pid // 10000 AS ray_id, pid % 10000 AS t, power(i / 15e0, 2) AS a, i / 15e0 AS r FROM (SELECT pid, least(15, CAST(floor(least(1e0, greatest(0e0, value / 0.0837e0)) * 16) AS INT)) AS i FROM {_SAMPLE.replace('POINTS', 'pt')})) {_COMPOSITE}",
        "w4_wavefront_march": f"WITH {_WALK}, st AS (SELECT DISTINCT ray_id, i FROM (SELECT ray_id, unnest(range(CAST(ceil(t0 / 2e0) AS BIGINT), CAST(ceil(t1 / 2e0) AS BIGINT))) AS i FROM walk WHERE mc_id IN (SELECT mc_id FROM {_maj('0e0', '0.0837e0')} WHERE max_opacity > 0))), pt AS (SELECT ray_id * 10000 + i AS pid, {', '.join(f'o{a} + i * 2e0 * d{a} AS p{a}' for a in 'xyz')} FROM st JOIN {{rays}} USING (ray_id)), smp AS (SELECT pid // 10000 AS ray_id, pid % 10000 AS t, power(i / 15e0, 2) AS a, i / 15e0 AS r FROM (SELECT pid, least(15, CAST(floor(least(1e0, greatest(0e0, value / 0.0837e0)) * 16) AS INT)) AS i FROM {_SAMPLE.replace('POINTS', 'pt')})) {_COMPOSITE}",
        "p30_mirrored_walk": f"WITH {_DOUBLED} SELECT ray_id, mc_id, round(t0, 6) AS t0, round(t1, 6) AS t1, mirrored FROM walk",
        "g9_oriented_faces": f"WITH {_DUAL}, {_KIND}, els AS (SELECT kind, list_transform(string_split({_ORDERED}, ','), lambda x: CAST(x AS BIGINT)) AS ids FROM kinds WHERE kind IS NOT NULL), rings AS (SELECT {_RING} AS r FROM ({_FACES_OF})), turned AS (SELECT list_concat(r[list_position(r, list_min(r)):], r[:list_position(r, list_min(r)) - 1]) AS r FROM rings WHERE len(r) >= 3 AND len(list_distinct(r)) = len(r)), signed AS (SELECT CASE WHEN r[2] < r[len(r)] THEN r ELSE list_concat([r[1]], list_reverse(r[2:])) END AS face, CASE WHEN r[2] < r[len(r)] THEN 1 ELSE -1 END AS sign FROM turned) SELECT CAST(len(face) AS BIGINT) AS corners, state, count(*) AS faces FROM (SELECT face, CASE WHEN count(*) = 1 THEN 'boundary' WHEN count(*) > 2 THEN 'multiple' WHEN sum(sign) = 0 THEN 'inner' ELSE 'inverted' END AS state FROM signed GROUP BY face) GROUP BY ALL",
        "w7_running_sum": "SELECT o_orderkey, CAST(sum(o_orderkey % 7) OVER (ORDER BY o_orderkey) AS BIGINT) AS total FROM orders",
        "w8_run_lengths": "SELECT status, n, count(*) AS runs FROM (SELECT status, g, count(*) AS n FROM (SELECT o_orderstatus AS status, row_number() OVER (ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders) GROUP BY status, g) GROUP BY status, n",
    }.items()
}
