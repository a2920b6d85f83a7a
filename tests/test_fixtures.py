"""Hand-checked volumes: two bricks, blocks, uniform cells, trilinear, boxes, compositing, tetrahedra, interfaces."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.api import BrickField, CellField, ElementField, GridletField, RegionField, StitchedField, Volume, bricks_from_blocks
from lattica.functions import codes, elements
from lattica.functions import geometry as G
from lattica.operators import bricks as B
from lattica.operators import cells as C
from lattica.operators import clusters, fields, grid, majorant_tree, mesh, numbering, pyramid, quantiles, rays, tracking, tree, wavefront
from lattica.operators.range_join import join_boxes, join_points
from lattica.schema import BRICKS, CELLS

POINTS = "pid long, px double, py double, pz double"


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(0, 0, 0, 0, 1, 1, 1, 1, [0.5]), (1, 2, 0, 0, 2, 2, 2, 0, [0.0, 1.0] * 4)], BRICKS)


def points(spark, *xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], POINTS)


def values(df, key="pid"):
    return {r[key]: round(r["value"], 6) for r in df.collect()}


PLACES = ((1, 1, 1), (2, 1, 1), (3, 1, 1), (9, 1, 1))


def test_two_bricks(spark, two):
    box = two.select("brick_id", *G.brick_box()).orderBy("brick_id").collect()
    assert [tuple(r)[1:] for r in box] == [(0, 0, 0, 2, 2, 2), (2, 0, 0, 4, 2, 2)]
    domain = two.select("brick_id", *G.brick_domain()).orderBy("brick_id").collect()
    assert [tuple(r)[1:] for r in domain] == [(-1, -1, -1, 3, 3, 3), (1.5, -0.5, -0.5, 4.5, 2.5, 2.5)]
    want = {0: 0.5, 1: 0.25, 2: 0.5}
    assert values(fields.sample_bricks(points(spark, *PLACES), two)) == want
    assert values(fields.sample_regions(points(spark, *PLACES), B.regions(two), two)) == want
    assert values(fields.sample_cells(points(spark, *PLACES), grid.brick_cells(two))) == want
    m = {r.mc_id: (r.vmin, r.vmax) for r in grid.brick_ranges(two, (0, 0, 0), (4, 2, 2), (2, 2, 2)).collect()}
    assert m == {i: ((0.0, 0.5) if i % 2 == 0 else (0.0, 1.0)) for i in range(8)}
    tf = [(0, 0, 0, a) for a in (0.0, 0.1, 0.5, 1.0)]
    top = {r.mc_id: r.max_opacity for r in grid.with_majorants(grid.brick_ranges(two, (0, 0, 0), (4, 2, 2), (2, 2, 2)), tf, 0.0, 1.0).collect()}
    assert {top[i] for i in (0, 2, 4, 6)} == {0.5} and {top[i] for i in (1, 3, 5, 7)} == {1.0}
    assert {(r.brick_a, r.brick_b) for r in B.adjacent(two).collect()} == {(0, 1), (1, 0)}
    assert {r.brick_id: (r.vmin, r.vmax) for r in B.splatted_ranges(two).collect()} == {0: (0.0, 1.0), 1: (0.0, 1.0)}


@pytest.mark.parametrize("local", [4096, 1])
def test_regions_are_disjoint_and_cover(spark, two, local):
    r = B.regions(two, local).collect()
    assert any((x.hx, x.lx, list(x.brick_ids)) == (1.5, -1.0, [0]) for x in r)
    volume = sum((x.hx - x.lx) * (x.hy - x.ly) * (x.hz - x.lz) for x in r)
    assert volume == pytest.approx(64 + 27 - 1.5 * 9)
    both = [x for x in r if len(x.brick_ids) == 2]
    assert sum((x.hx - x.lx) * (x.hy - x.ly) * (x.hz - x.lz) for x in both) == pytest.approx(1.5 * 9)
    for i, a in enumerate(r):
        for b in r[:i]:
            assert not all(max(a[f"l{k}"], b[f"l{k}"]) < min(a[f"h{k}"], b[f"h{k}"]) for k in "xyz")
    s = B.region_statistics(B.regions(two, local)).first()
    assert s.regions == len(r) and s.most == 2
    ranges = {x.region_id: (x.vmin, x.vmax, x.finest_w) for x in B.region_ranges(B.regions(two, local), two).collect()}
    assert {ranges[x.region_id] for x in r if list(x.brick_ids) == [0]} == {(0.5, 0.5, 2.0)}


def test_finest_cell_first(spark, two):
    c = grid.brick_cells(two).withColumn("cell_id", F.col("brick_id") * 8 + F.col("i")).select("cell_id", "x", "y", "z", "level", "value")
    p = points(spark, (0.5, 0.5, 0.5), (2.5, 0.5, 0.5), (3.5, 1.5, 1.5), (9, 0, 0))
    got = {r.pid: (r.value, r.found_level) for r in C.find_cells(p, c, ["pid"], keep=["value"]).collect()}
    assert got == {0: (0.5, 1), 1: (0.0, 0), 2: (1.0, 0)}
    assert C.find_cells(p, c.limit(0), ["pid"]).collect() == []


def test_blocks(spark):
    blocks = [((0, 0, 0, 1, 1, 1), 0, [i / 8 for i in range(8)]), ((1, 0, 0, 1, 0, 0), 1, [1.0]), ((4, 0, 0, 4, 0, 0), 0, [2.0])]
    b = bricks_from_blocks(spark, blocks).orderBy("brick_id").collect()
    assert [(r.lx, r.ly, r.lz, r.sx, r.sy, r.sz, r.level) for r in b] == [(0, 0, 0, 2, 2, 2, 0), (2, 0, 0, 1, 1, 1, 1), (4, 0, 0, 1, 1, 1, 0)]
    assert list(b[2].scalars) == [2.0]
    with pytest.raises(ValueError):
        bricks_from_blocks(spark, [((0, 0, 0, 1, 1, 1), 0, [1.0])])


def uniform(spark, nx, ny, nz):
    return spark.createDataFrame([(x + nx * (y + ny * z), x, y, z, 0, float(x + 2 * y + 4 * z)) for z in range(nz) for y in range(ny) for x in range(nx)], CELLS)


def test_uniform_cells_make_cubes(spark):
    c = uniform(spark, 3, 3, 3)
    e = C.classify(C.dual_cells(c))
    assert [(r.kind, r.perfect, r.n) for r in C.element_counts(e).collect()] == [("hex", True, 8)]
    g = C.cluster_gridlets(C.cubes(e, c))
    r = C.gridlet_scalars(g, c).first()
    assert (r.level, r.lx, r.ly, r.lz, r.dx, r.dy, r.dz, r.n_cubes) == (0, 0, 0, 0, 2, 2, 2, 8)
    assert list(r.scalars) == [float(x + 2 * y + 4 * z) for z in range(3) for y in range(3) for x in range(3)]
    assert {x.n for x in C.faces_shared(e).collect()} == {1, 2}
    assert C.dual_cells(uniform(spark, 5, 4, 3).orderBy(F.rand(1))).count() == 24


def test_coarse_fine_interface(spark):
    rows = [(100 + i, 0, 2 * (i % 2), 2 * (i // 2), 1, 1.0) for i in range(4)]
    rows += [(i, 2 + i % 2, i // 2 % 4, i // 8, 0, 0.0) for i in range(32)]
    c = spark.createDataFrame(rows, CELLS)
    counts = {(r.kind, r.perfect): r.n for r in C.element_counts(C.classify(C.dual_cells(c))).collect()}
    assert counts == {("hex", True): 9, ("pyr", False): 4, ("wedge", False): 4, ("hex", False): 1}


def test_disagreeing_cubes_raise(spark):
    c = spark.createDataFrame([(0, 0, 0, 0, list(range(8))), (0, 1, 0, 0, list(range(50, 58)))], "level int, ix int, iy int, iz int, ids array<long>")
    with pytest.raises(Exception, match="disagree"):
        C.cluster_gridlets(c).collect()


def test_trilinear(spark):
    g = spark.createDataFrame([(0, 0, 0, 0, 0, 1, 1, 1, [float(x + 2 * y + 4 * z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]), (1, 0, 10, 10, 10, 1, 1, 1, [1.0] * 7 + [None])], "gridlet_id long, level int, lx int, ly int, lz int, dx int, dy int, dz int, scalars array<double>")
    got = {r.pid: (r.value, r.cell) for r in fields.sample_gridlets(points(spark, (1, 1, 1), (1.5, 1.5, 1.5), (11, 11, 11), (0.4, 1, 1)), g).collect()}
    assert got == {0: (3.5, 0), 1: (7.0, 0)}
    hit = fields.stitched(fields.sample_gridlets(points(spark, (1, 1, 1)), g), spark.createDataFrame([(0, 5, "hex", 9.0), (7, 3, "tet", 2.0), (7, 1, "hex", 4.0)], "pid long, elem_id long, kind string, value double"))
    assert values(hit) == {0: 3.5, 7: 4.0}


def test_rays_and_boxes(spark):
    boxes = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate([(0, 0, 0, 2, 2, 2), (0, 2, 0, 1, 3, 2), (1, 2, 0, 2, 3, 2)])], "box_id long, lx double, ly double, lz double, hx double, hy double, hz double")
    ray = spark.createDataFrame([(0, -1.0, -1.0, 0.0, 0.5, 1.0, 0.1, 0.0, 1e20)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double")
    got = [(r.box_id, round(r.t0, 9), round(r.t1, 9), r.n) for r in rays.box_hits(ray, boxes, "box_id", (0, 0, 0), (4, 4, 4), (2, 2, 2)).orderBy("n").collect()]
    assert got == [(0, 2, 3, 1), (1, 3, 4, 2)]
    along = spark.createDataFrame([(0, -1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1e20), (1, -1.0, 9.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1e20)], ray.schema)
    assert [(r.ray_id, r.box_id) for r in rays.box_hits(along, boxes, "box_id", (0, 0, 0), (4, 4, 4), (2, 2, 2)).collect()] == [(0, 0)]


def test_grid_walk_tiles_rays(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.uniform(-2, 10, 3)), *map(float, rng.normal(size=3)), 0.0, 1e20) for i in range(50)] + [(99, -1.0, 1.5, 1.5, 1.0, 0.0, 0.0, 0.0, 1e20)]
    r = spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double")
    segs = {}
    for s in grid.walk(r, (0, 0, 0), (8, 8, 8), (4, 4, 4)).orderBy("t0").collect():
        segs.setdefault(s.ray_id, []).append((s.t0, s.t1, s.mc_id))
    by = {x[0]: x for x in rows}
    for i, own in segs.items():
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(own, own[1:]))
        for t0, t1, mc in own:
            at = [by[i][1 + k] + (t0 + t1) / 2 * by[i][4 + k] for k in range(3)]
            assert mc == int(at[0] // 2) + 4 * (int(at[1] // 2) + 4 * int(at[2] // 2))
    assert [m for _, _, m in segs[99]] == [0, 1, 2, 3]


def test_compositing(spark):
    s = "ray_id long, t double, a double, r double, g double, b double"
    got = rays.composite(spark.createDataFrame([(0, 1.0, 0.5, 1.0, 0.0, 0.0), (0, 2.0, 0.5, 0.5, 0.0, 0.0)], s)).first()
    assert (round(got.r, 9), round(got.alpha, 9)) == (0.625, 0.75)
    full = [(0, 1.0, 1.0, 0.3, 0.0, 0.0), (0, 2.0, 0.5, 9.0, 0.0, 0.0), (0, 3.0, 1.0, 9.0, 0.0, 0.0)]
    got = rays.composite(spark.createDataFrame(full, s)).first()
    assert (round(got.r, 9), round(got.alpha, 9)) == (0.3, 1.0)


def packed(spark, kind, corners, vs):
    x, y, z = (list(map(float, c)) for c in zip(*corners))
    box = [float(f(c)) for f in (min, max) for c in (x, y, z)]
    return spark.createDataFrame([(0, kind, *box, x, y, z, list(map(float, vs)))], "elem_id long, kind string, lx double, ly double, lz double, hx double, hy double, hz double, xs array<double>, ys array<double>, zs array<double>, vs array<double>")


HEX = [(0, 0, 0), (2, 0, 0), (2, 3, 0), (0, 3, 0), (0, 0, 1), (2, 0, 1), (2, 3, 1), (0, 3, 1)]
TWISTED = [(0, 0, 0), (2, 0.2, 0), (2.3, 3, 0.1), (0, 3, 0), (0.1, 0, 1), (2, 0, 1.2), (2, 3.1, 1), (0, 3, 1.1)]
WEDGE = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 2), (1, 0, 2), (0, 1, 2)]
PYRAMID = [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0), (1, 1, 2)]
TET = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]


@pytest.mark.parametrize(("kind", "corners", "inside", "outside"), [("tet", TET, (0.25, 0.25, 0.25), (0.9, 0.9, 0.9)), ("tet", [TET[i] for i in (1, 0, 2, 3)], (0.25, 0.25, 0.25), (0.4, 0.4, 0.4)), ("hex", HEX, (0.5, 1.2, 0.7), (1.0, 1.0, 1.5)), ("hex", TWISTED, (1.1, 1.4, 0.5), (2.29, 0.01, 0.01)), ("wedge", WEDGE, (0.2, 0.3, 0.5), (0.8, 0.8, 1.0)), ("pyr", PYRAMID, (1.1, 0.9, 0.8), (0.1, 0.1, 1.9))])
def test_elements_reproduce_linear_fields(spark, kind, corners, inside, outside):
    f = lambda p: 1 + p[0] + 2 * p[1] - 3 * p[2]
    e = packed(spark, kind, corners, [f(c) for c in corners])
    met = join_points(points(spark, inside, outside, corners[0]), e)
    got = {r.pid: r.value for r in elements.element_values(met).collect()}
    assert got[0] == pytest.approx(f(inside), abs=1e-6) and 1 not in got
    assert got[2] == pytest.approx(f(corners[0]), abs=1e-6)
    if kind != "tet" and corners is not TWISTED:
        ratio = {r.pid: r.value for r in elements.with_plane_ratio_value(met, kind).collect()}
        assert ratio[0] == pytest.approx(f(inside), abs=1e-6) and ratio.get(1) is None


def test_compaction_and_lookup(spark):
    v = spark.createDataFrame([(i, float(i), 0.0, 0.0, float(i)) for i in range(6)], "vertex_id long, x double, y double, z double, value double")
    e = spark.createDataFrame([(0, "tet", [1, 3, 4, 5])], "elem_id long, kind string, vertex_ids array<long>")
    kept, renamed = mesh.compact(e, v)
    assert sorted((r.vertex_id, r.x) for r in kept.collect()) == [(0, 1.0), (1, 3.0), (2, 4.0), (3, 5.0)]
    assert list(renamed.first().vertex_ids) == [0, 1, 2, 3]
    tagged = v.withColumn("tag", F.when(F.col("vertex_id") < 2, F.col("vertex_id"))).withColumn("value", F.when(F.col("vertex_id") < 4, F.col("value")))
    scalars = spark.createDataFrame([(0, 7.0)], "idx long, value double")
    assert {r.vertex_id: r.value for r in mesh.vertex_values(tagged, scalars).collect()} == {0: 7.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 0.0, 5: 0.0}


def test_binned_joins_equal_naive_ones(spark):
    rng = np.random.default_rng(3)
    boxes = []
    for i in range(200):
        low, size = rng.uniform(-20, 20, 3), 2.0 ** rng.uniform(-3, 4, 3)
        boxes.append((i, *map(float, low), *map(float, low + size)))
    b = spark.createDataFrame(boxes, "id long, lx double, ly double, lz double, hx double, hy double, hz double")
    pts = [(i, *map(float, rng.uniform(-22, 30, 3))) for i in range(500)]
    got = {(r.pid, r.id) for r in join_points(spark.createDataFrame(pts, POINTS), b).collect()}
    assert got == {(p[0], x[0]) for p in pts for x in boxes if all(x[1 + k] <= p[1 + k] <= x[4 + k] for k in range(3))}
    side = lambda p: b.select(*[F.col(c).alias(p + c) for c in b.columns])
    met = join_boxes(side("a_"), side("b_"), "a_", "b_").select("a_id", "b_id").collect()
    want = {(x[0], y[0]) for x in boxes for y in boxes if all(max(x[1 + k], y[1 + k]) < min(x[4 + k], y[4 + k]) for k in range(3))}
    assert len(met) == len(want) and {tuple(r) for r in met} == want


def test_numbering(spark):
    rng = np.random.default_rng(4)
    keys = sorted(set(rng.integers(0, 5000, 800).tolist()))
    df = spark.createDataFrame([(k, int(k % 3)) for k in keys], "k long, v long")
    got = {r.k: (r.n, r.total) for r in numbering.running_sum(numbering.dense_ids(df, "k", "n", ranges=7), "k", "v", "total", ranges=7).collect()}
    total = 0
    for n, k in enumerate(keys):
        total += k % 3
        assert got[k] == (n, total)
    runs = [(r.v, r.n) for r in numbering.run_lengths(df, "k", "v", ranges=7).orderBy("run").collect()]
    want = []
    for k in keys:
        if want and want[-1][0] == k % 3:
            want[-1][1] += 1
        else:
            want.append([k % 3, 1])
    assert runs == [tuple(x) for x in want]


#: Codes of Moore's coordinates-to-index procedure for 16 bits an axis. Fixed values.
HILBERT = {(0, 0, 0): 0, (1, 0, 0): 1, (0, 1, 0): 3, (0, 0, 1): 7, (65535, 0, 0): 49146424505035, (0, 65535, 0): 111696419329625, (0, 0, 65535): 281474976710655, (65535, 65535, 65535): 189883912860363, (12345, 54321, 33333): 149299103185477}


HEXES = "elem long, kind string, vertex_ids array<long>"


def test_faces_cancel_or_are_found(spark):
    at = lambda x, y, z: x + 3 * y + 6 * z  # noqa: E731  vertices of two cells side by side
    cube = lambda x: [at(x + a, b, c) for c in (0, 1) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    left, right = cube(0), cube(1)
    pyramid = [*left[4:], 100]  # on top of the left one
    whole = [(0, "hex", left), (1, "hex", right), (2, "pyr", pyramid)]
    states = lambda rows: {r.state: r["count"] for r in C.conformity(C.oriented_faces(spark.createDataFrame(rows, HEXES))).groupBy("state").count().collect()}
    assert states(whole) == {"inner": 2, "boundary": 13}
    inside_out = [right[i] for i in (0, 3, 2, 1, 4, 7, 6, 5)]
    assert states([whole[0], (1, "hex", inside_out), whole[2]]) == {"inner": 1, "inverted": 1, "boundary": 13}
    assert states([*whole, (3, "hex", left)]) == {"multiple": 2, "inverted": 4, "boundary": 9}  # one element twice
    # a wedge as a hex with two edges collapsed bounds what a wedge bounds
    wedge = [0, 1, 2, 10, 11, 12]
    collapsed = [0, 1, 2, 2, 10, 11, 12, 12]
    faces = lambda kind, ids: {(tuple(r.face), r.sign) for r in C.oriented_faces(spark.createDataFrame([(0, kind, ids)], HEXES)).collect()}
    assert faces("wedge", wedge) == faces("hex", collapsed) and len(faces("wedge", wedge)) == 5
    assert len(faces("tet", [3, 1, 2, 0])) == 4 and {(f, -g) for f, g in faces("tet", [3, 1, 2, 0])} == faces("tet", [1, 3, 2, 0])
    assert faces("tet", [1, 1, 2, 3]) == {((1, 2, 3), g) for g in (1, -1)}  # flat: its two sides cancel


def test_a_mirrored_walk_is_the_walk_through_both(spark):
    rng = np.random.default_rng(8)
    o, d = rng.uniform((-0.5, -1, -0.5), (4.5, 9, 4.5), (80, 3)), rng.normal(size=(80, 3))
    d[:6, 1] = 0.0
    rows = [(i, *map(float, a), *map(float, b), 0.0, 1e20 if i % 3 else 6.0) for i, (a, b) in enumerate(zip(o, d))]
    r = spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double")
    got = grid.mirrored_walk(r, (0.0,) * 3, (4.0, 4.0, 4.0), (2, 2, 2), 1, 4.0).collect()
    both = grid.walk(r, (0.0,) * 3, (4.0, 8.0, 4.0), (2, 4, 2)).collect()
    unfold = lambda m, far: m % 2 + 2 * ((3 - m // 2 % 2 if far else m // 2 % 2) + 4 * (m // 4))
    key = lambda rows: sorted((r[0], round(r[2], 9), round(r[3], 9), r[1]) for r in rows if r[3] - r[2] > 1e-9)
    assert key([(r.ray_id, unfold(r.mc_id, r.mirrored), r.t0, r.t1) for r in got]) == key(map(tuple, both)) and len(both) > 100


def test_fronts_stop_at_opaque_rays(spark):
    n, length = 40, 64
    r = spark.range(n).select(F.col("id").alias("ray_id"), *[F.lit(v).alias(c) for c, v in zip(("ox", "oy", "oz", "dx", "dy", "dz"), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0))])
    seg = r.select("ray_id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")).select("ray_id", F.col("k").cast("double").alias("t0"), (F.col("k") + 1.0).alias("t1"))
    asked = []

    def sample(points):
        asked.append(points.count())
        return points.select("pid", F.when(F.col("pid.ray_id") % 4 == 0, 0.01).otherwise(0.9).alias("value"))

    shade = lambda v: {"r": v, "a": v}
    got = {x.ray_id: (x.r, x.alpha) for x in wavefront.march(r, seg, sample, shade, 0.5, ("r",)).collect()}
    plain = rays.steps(seg, 0.5).withColumn("r", F.when(F.col("ray_id") % 4 == 0, 0.01).otherwise(0.9)).withColumn("a", F.col("r"))
    want = {x.ray_id: (x.r, x.alpha) for x in rays.composite(plain, ("r",)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    # three in four rays are opaque after two samples, in the first front of four segments; the others go all the way
    assert sum(asked) == n * 8 + n // 4 * (2 * length - 8) and len(asked) == 5


def test_curves(spark):
    bits = 3
    at = [((F.col("id") / 8**i) % 8).cast("long") for i in range(3)]
    all_ = spark.range(8**3).select(*[c.alias(a) for a, c in zip("xyz", at)]).withColumn("code", codes.hilbert(F.col("x"), F.col("y"), F.col("z"), bits))
    rows = all_.withColumn("back", codes.hilbert_point(F.col("code"), bits)).orderBy("code").collect()
    assert [r.code for r in rows] == list(range(512)) and all((r.back.x, r.back.y, r.back.z) == (r.x, r.y, r.z) for r in rows)
    walked = np.array([(r.x, r.y, r.z) for r in rows])
    assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()  # neighbours along the curve are neighbours in space
    known = spark.createDataFrame([(*p, c) for p, c in HILBERT.items()], "x long, y long, z long, want long")
    assert all(r.code == r.want for r in known.withColumn("code", codes.hilbert(F.col("x"), F.col("y"), F.col("z"))).collect())
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([tuple(map(int, x)) for x in rng.integers(0, 65536, (100, 3))], "x long, y long, z long")
    code = codes.hilbert(F.col("x"), F.col("y"), F.col("z"))
    assert all((r.b.x, r.b.y, r.b.z) == (r.x, r.y, r.z) for r in p.withColumn("code", code).withColumn("b", codes.hilbert_point(F.col("code"))).collect())


def test_tilted_hexes_and_tet_pairs(spark):
    hexed = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1.8, 0, 1), (1.8, 1, 1), (0, 1, 1)]
    f = lambda p: 2.0 * p[0] + p[1] + 3.0 * p[2]
    one = lambda corners, points: spark.createDataFrame([(i, 0, *map(float, p), *[[float(c[a]) for c in corners] for a in range(3)], [f(c) for c in corners]) for i, p in enumerate(points)], "pid long, elem_id long, px double, py double, pz double, xs array<double>, ys array<double>, zs array<double>, vs array<double>")
    points = [(1.2, 0.5, 0.8), (0.5, 0.5, 0.5), (1.39, 0.5, 0.5), (1.41, 0.5, 0.5), (1.8, 1.0, 1.0), (0.0, 0.0, 0.0), (-0.01, 0.5, 0.5)]
    got = [r.value for r in elements.with_plane_ratio_value(one(hexed, points), "hex").orderBy("pid").collect()]
    x = 1.2 / (1.2 + 0.44 / math.sqrt(1.64))
    assert got[0] == pytest.approx(0.2 * (2 * x + 0.5) + 0.8 * (3.6 * x + 3.5)) and got[1] == pytest.approx(3.16, abs=0.01)
    assert got[2] is not None and got[3] is None and got[4] == pytest.approx(7.6) and got[5] == pytest.approx(0.0) and got[6] is None
    tip = [(0, 0, 0), (1, 0, 0), (1.2, 1.1, 0), (0, 1, 0.2), (0.4, 0.5, 1)]
    inside = [(0.4, 0.5, 0.5), (0.5, 0.2, 0.05), (0.2, 0.6, 0.25), (0.4, 0.5, 1.0), (0.4, 0.5, 1.1), (2.0, 2.0, 0.1)]
    values = [r.value for r in elements.with_tet_pair_value(one(tip, inside)).orderBy("pid").collect()]
    assert values[:4] == pytest.approx([f(p) for p in inside[:4]]) and values[4:] == [None, None]  # linear fields are met exactly


def test_clusters_merge_to_a_fixpoint(spark):
    got = clusters.merge(spark.range(37).withColumnRenamed("id", "rank"), 8).groupBy("cluster").count().orderBy("cluster").collect()
    assert sum(r["count"] for r in got) == 37 and max(r["count"] for r in got) <= 8
    sizes = [r["count"] for r in got]
    assert all(a + b > 8 for a, b in zip(sizes[::2], sizes[1::2]))


def test_crowded_points_are_spread(spark):
    rng = np.random.default_rng(12)
    crowd = rng.uniform(40.0, 40.5, (18_000, 3))
    at = np.concatenate([crowd, rng.uniform(0, 100, (2000, 3)), [[40.25, 40.25, 40.25]] * 5])
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "pid long, px double, py double, pz double")
    low = np.concatenate([rng.uniform(0, 100, (150, 3)), rng.uniform(39.9, 40.5, (30, 3)), [[0.0] * 3]])
    high = low + np.concatenate([rng.uniform(0.1, 8, (150, 3)), rng.uniform(0.01, 0.2, (30, 3)), [[100.0] * 3]])
    boxes = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(low, high))], "box_id long, lx double, ly double, lz double, hx double, hy double, hz double")
    cuts = quantiles.planes(points)
    sizes = sorted(r["count"] for r in points.groupBy(quantiles.part_of(cuts).alias("part")).count().collect())
    assert len(sizes) == 2**quantiles.LEVELS and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    met = quantiles.join_crowded(points, boxes)
    want = ((at[:, None, :] >= low[None]) & (at[:, None, :] <= high[None])).all(2)
    assert met.select("pid", "box_id").distinct().count() == met.count() == want.sum()
    plain = join_points(points, boxes).groupBy("box_id").agg(F.sum("pid").alias("s"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, met.groupBy("box_id").agg(F.sum("pid"), F.count(F.lit(1))).collect())) == sorted(map(tuple, plain.collect()))
    one_place = points.where("pid >= 20000")
    assert quantiles.join_crowded(one_place, boxes).count() == want[20_000:].sum()
    assert quantiles.join_crowded(points.where("pid < 0"), boxes).count() == 0 == quantiles.join_crowded(points, boxes.where("box_id < 0")).count()


def test_every_field_behind_a_volume(spark):
    v = spark.createDataFrame([(8 + k, 4.0 + x, y, z, 0.5 + 0.1 * x) for k, (x, y, z) in enumerate([(0.0, 0.5, 0.5), (2.0, 0.5, 0.5), (2.0, 2.5, 0.5), (0.0, 2.5, 0.5), (0.0, 0.5, 2.5), (2.0, 0.5, 2.5), (2.0, 2.5, 2.5), (0.0, 2.5, 2.5)])], "vertex_id long, x double, y double, z double, value double")
    e = ElementField(spark.createDataFrame([(3, "hex", list(range(8, 16)))], "elem_id long, kind string, vertex_ids array<long>"), v)
    g = GridletField(spark.createDataFrame([(0, 0, 0, 0, 0, 2, 2, 2, [0.1 * (i % 3) for i in range(27)])], "gridlet_id long, lx int, ly int, lz int, level int, dx int, dy int, dz int, scalars array<double>"))
    points = spark.createDataFrame([(0, 1.0, 1.5, 1.5), (1, 5.0, 1.5, 1.5), (2, 9.0, 9.0, 9.0), (3, 2.0, 1.0, 1.0)], "pid long, px double, py double, pz double")
    sampled = lambda f: {r.pid: round(r.value, 9) for r in f.sample(points).collect()}
    assert sampled(e) == {1: 0.6} and sampled(g) == {0: 0.05, 3: 0.15} and sampled(StitchedField(g, e)) == {0: 0.05, 1: 0.6, 3: 0.15}
    b = spark.createDataFrame([(0, 0, 0, 0, 2, 2, 2, 0, [0.1] * 8), (1, 2, 0, 0, 2, 2, 2, 0, [0.3] * 8)], BRICKS)
    assert sampled(RegionField(b)) == sampled(BrickField(b)) == {0: 0.1, 3: 0.2}
    low, high, dims = (0.0,) * 3, (8.0,) * 3, (4, 4, 4)
    for field in (e, g, StitchedField(g, e), RegionField(b)):
        ranges = {r.mc_id: (r.vmin, r.vmax) for r in field.ranges(low, high, dims).collect()}
        at = {r.pid: (r.px, r.py, r.pz) for r in points.collect()}
        for pid, value in sampled(field).items():
            x, y, z = (int(c // 2) for c in at[pid])
            lo, hi = ranges[x + 4 * (y + 4 * z)]
            assert lo <= value <= hi
    volume = Volume(StitchedField(g, e), low, high, dims).transfer_function([(1.0, 0.5, 0.0, 0.5)] * 2, (0.0, 1.0))
    ray = spark.createDataFrame([(0, -1.0, 1.5, 1.5, 1.0, 0.0, 0.0, 0.0, 1e20)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double")
    seen = volume.march(ray, 0.5).first()
    assert seen.alpha > 0.9 and seen.g == pytest.approx(seen.r / 2)
    assert volume.trace(ray, (4.0, 20.0, 4.0), bounces=1).count() == 1


BOXES = "b_lx double, b_ly double, b_lz double, b_hx double, b_hy double, b_hz double, b_vmin double, b_vmax double"


def test_ranges_by_summary_equal_all_boxes(spark):
    rng = np.random.default_rng(4)
    low = np.concatenate([rng.uniform(0, 100, (2000, 3)), rng.normal(50, 0.5, (1500, 3))])  # evenly, and most of the rest in one place
    high = low + rng.choice([0.25, 1.0, 30.0], (len(low), 3), p=[0.6, 0.39, 0.01])
    high[5] = low[5]  # no volume
    values = np.sort(rng.normal(size=(len(low), 2)), axis=1)
    rows = [(*map(float, l), *map(float, h), *map(float, v)) for l, h, v in zip(low, high, values)] + [(0.0, 0.0, 0.0, 100.0, 100.0, 100.0, float("nan"), 1.0), (0.0, 0.0, 0.0, 100.0, 100.0, 100.0, None, None)]
    held = pyramid.build(spark.createDataFrame(rows, BOXES))
    assert held.sizes[-1] <= 8 < held.sizes[0] and held.sizes == sorted(held.sizes, reverse=True)
    plow = np.concatenate([rng.uniform(-5, 100, (60, 3)), rng.uniform(48, 52, (20, 3)), [[-10.0] * 3, [500.0] * 3, [1.0] * 3]])
    phigh = plow + np.concatenate([rng.uniform(0, 60, (60, 3)), rng.uniform(0, 2, (20, 3)), [[200.0] * 3, [1.0] * 3, [0.0] * 3]])
    probes = spark.createDataFrame([(i, *map(float, l), *map(float, h)) for i, (l, h) in enumerate(zip(plow, phigh))], "probe_id int, a_lx double, a_ly double, a_lz double, a_hx double, a_hy double, a_hz double")
    want = {}
    for i, (l, h) in enumerate(zip(plow, phigh)):
        met = ((low < h) & (high > l) & (low < high)).all(1) & (l < h).all()
        if met.any():
            want[i] = (values[met, 0].min(), values[met, 1].max())
    assert {r.probe_id: (r.vmin, r.vmax) for r in pyramid.ranges(held, probes).collect()} == want and len(want) > 60
    assert pyramid.ranges(pyramid.build(spark.createDataFrame([], BOXES)), probes).collect() == []


def plain_tree(boxes, low, high, alphas, leaves):
    """The costliest leaf is split, one at a time."""
    n = len(alphas)

    def cost(l, h):
        met = [b for b in boxes if all(b[i] < h[i] and b[3 + i] > l[i] for i in range(3))]
        if not met:
            return 0.0, 0.0
        first, last = (min(n - 1, max(0, math.floor(v * (n - 1)) + k)) for v, k in ((min(b[6] for b in met), 0), (max(b[7] for b in met), 1)))
        x, y, z = (b - a for a, b in zip(l, h))
        m = max(alphas[first : last + 1])
        return 2.0 * (x * y + y * z + z * x) * math.sqrt(x * x + y * y + z * z) * m, m

    open_ = [(math.inf, 0, "", tuple(low), tuple(high), 1.0)]
    while len(open_) < leaves:
        at = min(range(len(open_)), key=lambda i: (-open_[i][0], open_[i][1], open_[i][2]))
        _, depth, path, l, h, _ = open_.pop(at)
        best = None
        for axis in range(3):
            for k in range(1, 8):
                plane = l[axis] + k * ((h[axis] - l[axis]) / 8)
                a, b = (l, tuple(plane if i == axis else v for i, v in enumerate(h))), (tuple(plane if i == axis else v for i, v in enumerate(l)), h)
                total = cost(*a)[0] + cost(*b)[0]
                if best is None or total < best[0]:
                    best = (total, a, b)
        open_ += [(cost(*part)[0], depth + 1, path + str(side), *part, cost(*part)[1]) for side, part in enumerate(best[1:])]
    return sorted((*l, *h, m) for _, _, _, l, h, m in open_)


def test_majorant_tree_by_fronts_is_the_greedy_tree(spark):
    rng = np.random.default_rng(6)
    boxes = [(*map(float, l), *(float(x + 1) for x in l), *sorted(map(float, rng.uniform(0, 1, 2)))) for l in rng.integers(0, 8, (12, 3))]
    alphas = [(i / 7) ** 2 for i in range(8)]
    out = majorant_tree.build(spark, spark.createDataFrame(boxes, BOXES), (0, 0, 0), (8, 8, 8), [(0, 0, 0, a) for a in alphas], (0.0, 1.0), [1, 2, 24])
    for n in (1, 2, 24):
        got = out.where(F.col("leaves") == n).orderBy("domain_id").drop("leaves", "domain_id").collect()
        assert np.array(sorted(map(tuple, got))) == pytest.approx(np.array(plain_tree(boxes, (0, 0, 0), (8, 8, 8), alphas, n)))


def test_tracking_agrees_with_the_integral(spark):
    c = uniform(spark, 8, 8, 8).withColumn("value", F.lit(0.4))
    n = 3000
    r = spark.range(n).select(F.col("id").alias("ray_id"), F.lit(-1.0).alias("ox"), F.lit(4.0).alias("oy"), F.lit(4.0).alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(0.0).alias("tmin"), F.lit(1e20).alias("tmax"))
    m = grid.cell_ranges(c, (0, 0, 0), (8, 8, 8), (2, 2, 2)).withColumn("max_opacity", F.lit(0.8))
    hits = tracking.with_extinction(tracking.tentative(r, m, (0, 0, 0), (8, 8, 8), (2, 2, 2), 0.5, 7), r, c, lambda v: v, 0.5)
    want = math.exp(-0.4 * 0.5 * 8)
    free = 1 - tracking.free_paths(hits, 7).count() / n
    mean = tracking.transmittance(r, hits).agg(F.avg("transmittance")).first()[0]
    assert abs(free - want) < 0.03 and abs(mean - want) < 0.02


def test_collisions_are_those_of_the_running_sum(spark):
    """Thin, thick and very thick segments have as many points as steps before their mean; only those with two or more go through the running sum."""
    r = spark.range(200).select(F.col("id").alias("ray_id"), F.lit(-1.0).alias("ox"), (F.col("id") % 8 + 0.5).alias("oy"), F.lit(4.1).alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(0.0).alias("tmin"), F.lit(1e20).alias("tmax"))
    m = spark.range(64).select(F.col("id").alias("mc_id"), F.element_at(F.array(*map(F.lit, (0.02, 0.5, 3.0, 30.0))), (F.col("id") % 4 + 1).cast("int")).alias("max_opacity"))
    args = (0, 0, 0), (8, 8, 8), (4, 4, 4)
    found = tracking.tentative(r, m, *args, 0.5, 7)
    steps = F.sequence(F.lit(1), F.lit(100))
    far = F.transform(steps, lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a - F.log(tracking.uniform("ray_id", "mc_id", i, F.lit(7)))))
    want = grid.walk(r, *args).join(m, "mc_id").select("ray_id", "mc_id", F.size(F.filter(far, lambda x: x < 0.5 * F.col("max_opacity") * (F.col("t1") - F.col("t0")))).alias("n")).where("n > 0")
    got = found.groupBy("ray_id", "mc_id").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last"))
    counts = {(x.ray_id, x.mc_id): x.n for x in want.collect()}
    assert {(x.ray_id, x.mc_id): x.n for x in got.collect()} == {(x.ray_id, x.mc_id): x.last + 1 for x in got.collect()} == counts and max(counts.values()) > 30 and min(counts.values()) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == plan.count("THEN aggregate(sequence(3") == 1


def test_light_along_paths(spark):
    """In a homogeneous box, light at the first collision has a known mean, and later collisions add to it."""
    n, sigma, albedo = 600, 0.25, 0.7
    c = uniform(spark, 4, 4, 4).withColumn("value", F.lit(1.0))
    r = spark.range(n).select(F.col("id").alias("ray_id"), F.lit(-1.0).alias("ox"), F.lit(2.0).alias("oy"), F.lit(2.0).alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(0.0).alias("tmin"), F.lit(1e20).alias("tmax"))
    m = grid.cell_ranges(c, (0, 0, 0), (4, 4, 4), (1, 1, 1)).withColumn("max_opacity", F.lit(2.0))  # twice what the field has

    def mean(**most):
        found = tracking.trace(r, c, m, lambda v: v, (0, 0, 0), (4, 4, 4), (1, 1, 1), scale=sigma, light=(2.0, 2.0, -1.0), albedo=albedo, roulette=0.5, **most)
        return found.agg(F.avg("radiance")).first()[0]

    def light(x):  # two thirds of the way to the light are in the box
        far = math.hypot(x - 2, 3)
        return sigma * math.exp(-sigma * x) * albedo * math.exp(-sigma * far * 2 / 3) / (4 * math.pi * far * far)

    want = sum(light((k + 0.5) / 250) for k in range(1000)) / 250
    direct, all_ = mean(bounces=1), mean()
    assert abs(direct / want - 1) < 0.12
    # a first collision's light is albedo times as bright at the next one, if there is one: at most a geometric series
    assert 1.1 * direct < all_ < direct / (1 - albedo)


def test_directions(spark):
    d = spark.range(4000).select(tracking.uniform("id", F.lit(1)).alias("u"), tracking.uniform("id", F.lit(2)).alias("v"))
    axis = [F.lit(0.0), F.lit(0.6), F.lit(-0.8)]
    for g in (0.0, 0.7):
        p = d.select(*[x.alias(a) for a, x in zip("xyz", tracking.phase_direction(F.col("u"), F.col("v"), axis, g))])
        s = p.agg(F.avg(F.col("y") * 0.6 - F.col("z") * 0.8).alias("c"), F.max(F.abs(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 - 1)).alias("e")).first()
        assert abs(s.c - g) < 0.05 and s.e < 1e-9
    n = d.select(*[x.alias(a) for a, x in zip("xyz", tracking.diffuse_direction(F.col("u"), F.col("v"), axis))]).agg(F.min(F.col("y") * 0.6 - F.col("z") * 0.8).alias("m"), F.avg(F.col("y") * 0.6 - F.col("z") * 0.8).alias("c")).first()
    assert n.m >= 0 and abs(n.c - 2 / 3) < 0.05


def test_volume_renders(spark, two):
    tf = [(1.0, 0.0, 0.0, 0.5)] * 4
    v = Volume(BrickField(two), (0.0, 0.0, 0.0), (4.0, 2.0, 2.0), (2, 2, 2)).transfer_function(tf, (0.0, 1.0))
    view = G.camera((2.0, 1.0, -4.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), 1.2, 1.0, 8, 8)
    picture = {r.ray_id: r for r in v.render(view, 8, 8, 0.5).collect()}
    assert len(picture) == 64 and picture[27].alpha > 0.5 and picture[0].alpha == 0
    assert picture[27].r == pytest.approx(picture[27].alpha) and picture[27].g == 0
    lines = G.primary_rays(spark, view, 8, 8)
    cut = v.march(lines, 0.5, planes=[((0.0, 0.0, 1.0), -100.0)])
    assert cut.count() <= 64
    lit = Volume(CellField(grid.brick_cells(two)), (0.0,) * 3, (4.0, 2.0, 2.0), (2, 2, 2)).transfer_function(tf, (0.0, 1.0)).trace(lines, (2.0, 9.0, 1.0), bounces=2)
    assert lit.count() == 64 and lit.agg(F.max("radiance")).first()[0] > 0


def test_transforms(spark):
    by = G.between_boxes((0, 0, 0), (2, 2, 2), (10, 10, 10), (11, 14, 12))
    assert by == [(0.5, 10.0), (2.0, 10.0), (1.0, 10.0)]
    power = spark.createDataFrame([(5.0,), (1000.0,), (1001.0,), (5e6,)], "e double").select(G.rescale_power(F.col("e")).alias("p"))
    assert [r.p for r in power.collect()] == [0, 0, 1, 2]


def test_leaves_of_a_tree(spark):
    inner, leaf = (lambda axis, child: axis << 30 | child), tree.LEAF << 30 | 1
    nodes = [(0, (1 << 32) - 2, inner(0, 1)), (1, 7, leaf), (2, 3, inner(2, 3)), (3, 8, leaf), (4, 9, leaf)]  # the first plane is at -2
    found = tree.tree_leaves(spark.createDataFrame(nodes, "idx long, split long, bits long"), (-4, 0, 0), (4, 5, 6))
    got = {r.first_prim: (r.n_prims, r.lx, r.ly, r.lz, r.hx, r.hy, r.hz) for r in found.collect()}
    assert got == {7: (1, -4, 0, 0, -2, 5, 6), 8: (1, -2, 0, 0, 4, 5, 3), 9: (1, -2, 0, 3, 4, 5, 6)}
    assert tree.tree_leaves(spark.createDataFrame([], "idx long, split long, bits long"), (0, 0, 0), (1, 1, 1)).collect() == []


def test_lights_are_drawn_evenly(spark):
    points = spark.range(4000).selectExpr("id AS ray_id", "0D AS px", "0D AS py", "0D AS pz")
    lit = tracking.light_rays(points, [(0.0, 0.0, 2.0, 8.0), (3.0, 0.0, 0.0, 1.0)], 5).groupBy("dx", "dz", "tmax", "falloff").count().collect()
    assert {(r.dx, r.dz, r.tmax, round(r.falloff, 9)) for r in lit} == {(0, 1, 2, 2), (1, 0, 3, round(1 / 9, 9))}
    assert all(1800 < r["count"] < 2200 for r in lit)
    one = tracking.light_rays(points, (0.0, 0.0, 2.0)).first()
    assert (one.tmax, one.falloff) == (2, 0.25)


def test_order_of_cells(spark):
    rows = [(1, 5, 0, 0, 0), (2, -1, 0, 0, 0), (3, 0, -1, 0, 0), (4, 0, 0, 9, 0), (5, 0, 0, 0, 1), (6, 0, 0, 0, 1)]
    got = C.in_order(spark.createDataFrame(rows, "cell_id long, x int, y int, z int, level int")).orderBy("place").collect()
    assert [(r.cell_id, r.place) for r in got] == [(4, 0), (5, 1), (6, 2), (1, 3), (2, 4), (3, 5)]
