"""Plans of queries whose tables may be large: sizes that Spark guesses from files must not send one through the driver."""

import numpy as np
import pytest

from lattica.functions import elements as E
from lattica.operators import bricks as B
from lattica.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", "e2_tetrahedra e6_plane_ratios e6_tilted_hexes e6_pyramid_ratios e6_wedge_ratios e7_all_elements e1_gridlet_trilinear j5_stitched j3_sample_bricks j14_adjacent_bricks a11_splatted_ranges j3_crowded_points j15_rays_and_boxes o6_first_box w6_region_steps j16_rays_and_triangles".split())
def test_no_table_is_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, DATA))


def test_tets_and_planes_of_arrays():
    """A tet without volume holds nothing, and a point on a face or corner is inside."""
    tet = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], [[0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]]], float)
    values = np.array([[1.0, 2.0, 3.0, 4.0]] * 2)
    assert [None if np.isnan(v) else v for v in E.tet_values(tet, values, np.array([[0, 0, 1.0], [1, 0, 0]]))] == [4.0, None]
    cube = np.array([[[x, y, z] for x, y, z in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))]] * 2, float)
    found = E.plane_ratios("hex", cube, np.array([np.arange(8.0)] * 2), np.array([[1, 0, 0], [1.1, 0, 0]]))
    assert found[0] == 1.0 and np.isnan(found[1])


def test_cells_of_regions_are_not_broadcast(spark):
    bricks = spark.createDataFrame([(1, 0, 0, 0, 1, 1, 1, 0, [0.5])], "brick_id long, lx int, ly int, lz int, sx int, sy int, sz int, level int, scalars array<double>")
    regions = spark.createDataFrame([(7, *[-0.5] * 3, *[1.5] * 3, [1])], "region_id long, lx double, ly double, lz double, hx double, hy double, hz double, brick_ids array<long>")
    found = B.region_ranges(regions, bricks)
    assert "BroadcastHashJoin" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(7, 0.5, 0.5, 1.0)]


def test_walks_and_collisions_have_short_plans(spark):
    """Columns of a walk were written out again in each that uses them: the driver planned for most of a minute, in 1.3 GB."""
    from lattica.operators import tracking as X
    from lattica.plans import other_queries as O

    rays = O._unit_rays(spark, DATA)
    majorants = spark.createDataFrame([(0, 1.0)], "mc_id long, max_opacity double")
    found = X.tentative(rays, majorants, O.LOW, O.HIGH, O.DIMS, 0.05, 3)
    assert len(plan(found)) < 20_000
    assert "REPARTITION_BY_NUM" in plan(found)  # rays of one small file are spread


def test_bricks_that_overlap_are_added_up_by_place(spark):
    """Bricks on and off their level's lattice, copies, and points at no number: as by pairs, without a pair of each point and brick."""
    from lattica.functions.geometry import brick_domain
    from lattica.operators import fields as S
    from lattica.operators.range_join import join_points

    kinds = "brick_id long, lx int, ly int, lz int, sx int, sy int, sz int, level int, scalars array<double>"
    copies = [(i, 0, 0, 0, 2, 1, 1, 0, [0.1 * i, None]) for i in range(50)]
    others = [(90, 2, 0, 0, 1, 1, 2, 1, [5.0, float("nan")]), (91, 1, 1, 1, 1, 1, 1, 1, [7.0]), (92, -2, 0, 0, 1, 1, 1, 1, [1.0])]
    bricks = spark.createDataFrame(copies + others, kinds)
    places = [(i, i * 0.31 - 2.0, i * 0.17 - 0.5, i * 0.11 - 0.4) for i in range(25)] + [(98, float("nan"), 0.5, 0.5), (99, 0.5, float("inf"), 0.5)]
    points = spark.createDataFrame(places, "pid long, px double, py double, pz double")
    held = bricks.select("brick_id", *[f"s{a}" for a in "xyz"], "level", "scalars", *[bricks[f"l{a}"].alias(f"b{a}") for a in "xyz"], *brick_domain())
    met = join_points(points, held).drop("lx", "ly", "lz", "hx", "hy", "hz").withColumnsRenamed({f"b{a}": f"l{a}" for a in "xyz"})
    want = {r.pid: round(r.value, 9) for r in S.weighted_mean(S.brick_hits(met), ["pid"]).collect()}
    assert len(want) > 10
    for found in (S.sample_bricks(points, bricks), S.sample_regions(points, B.regions(bricks), bricks)):
        assert {r.pid: round(r.value, 9) for r in found.collect()} == want
    assert "brick_ids" not in plan(S.sample_regions(points, B.regions(bricks), bricks)).split("Scan")[0]
    aligned = bricks.where("brick_id <> 91")
    assert "_class" not in plan(S.sample_bricks(points, aligned))


def test_bricks_that_cover_a_part_cut_it_no_more():
    """A brick that covers a part whole goes down as an id; it was clipped and tested anew for each part."""
    low, high = np.zeros((3, 3)), np.array([[4.0] * 3, [4.0] * 3, [1.0, 4, 4]])
    found = B._divide(low, high, np.array([3, 1, 2]), np.zeros(3), np.full(3, 4.0))
    assert iter(found) is found  # regions come one by one, not as a list of all
    assert sorted((a.tolist(), b.tolist(), ids.tolist()) for a, b, ids in found) == [([0.0, 0, 0], [1.0, 4, 4], [1, 2, 3]), ([1.0, 0, 0], [4.0, 4, 4], [1, 3])]


def test_lists_of_regions_meet_points_by_region(spark):
    """Regions were written to eight bins with their lists of bricks before they met points."""
    text = plan(QUERIES["g5_points_in_regions"](spark, DATA))
    boxes = [line for line in text.splitlines() if "Exchange hashpartitioning(_class" in line]
    assert len(boxes) == 2 and text.count("lx") > 0
    assert not any("bricks" in line or "brick_ids" in line for line in text[text.index("_class") :].splitlines() if "Generate" in line)


def test_copies_of_boxes_are_one_box_of_a_pyramid(spark):
    """Boxes of the same place were kept apart, and up to 100,000 blocks of a level were sent to all through the driver."""
    from lattica.operators import pyramid as P

    boxes = spark.range(4000).selectExpr("id % 40 AS n", "id / 4000 AS v").selectExpr(*[f"double(n) AS b_l{a}" for a in "xyz"], *[f"double(n + 1) AS b_h{a}" for a in "xyz"], "v AS b_vmin", "v AS b_vmax")
    held = P.build(boxes)
    assert held.boxes.count() == 40 and P.BROADCAST <= 1_000
    probes = spark.createDataFrame([(1, *[3.5] * 3, *[4.5] * 3)], "probe_id int, " + ", ".join(f"a_{s} double" for s in P.SIDES))
    found = P.ranges(held, probes)
    assert [tuple(r) for r in found.collect()] == [(1, 3 / 4000, 3964 / 4000)]
    assert plan(found).count("BroadcastHashJoin") == 0


def test_points_of_a_part_count_its_boxes_once(spark):
    """Boxes over all points of a part were paired with each of them."""
    from lattica.operators import quantiles as Q

    points = spark.createDataFrame([(i, 5 + i / 1e4, 5.0, 5.0) for i in range(300)] + [(900, 0.0, 0.0, 0.0), (901, None, 5.0, 5.0), (902, float("nan"), 5.0, 5.0), (903, 99.0, 99.0, 99.0)], "pid long, px double, py double, pz double")
    boxes = spark.createDataFrame([(i, *[0.0] * 3, *[9.0] * 3) for i in range(20)] + [(77, 5.01, 4.0, 4.0, 6.0, 6.0, 6.0)], "brick_id long, lx double, ly double, lz double, hx double, hy double, hz double")
    want = {r.pid: (r.n, r["first"], r["last"]) for r in Q.join_crowded(points, boxes, levels=3).groupBy("pid").agg(*[f for f in (Q.F.count("*").alias("n"), Q.F.min("brick_id").alias("first"), Q.F.max("brick_id").alias("last"))]).collect()}
    assert len(want) == 301 and want[200] == (21, 0, 77)
    assert {r.pid: (r.n, r["first"], r["last"]) for r in Q.holders(points, boxes, "brick_id", levels=3).collect()} == want


def test_elements_with_parallel_edges_are_inverted_once(spark):
    """Sheared, mirrored, flat, bent, empty-valued and touching elements give the same as pair by pair in Python; parallel ones alone don't go there at all."""
    from pyspark.sql import functions as F

    from lattica.operators import fields as S
    from lattica.operators.range_join import join_points

    rng = np.random.default_rng(4)
    unit = {k: np.array(c, float) for k, c in E._CORNERS.items()}
    shear, flat = np.array([[2, 0.3, 0.1], [-0.4, 3, 0.7], [0.2, 0.1, 2.5]]), np.diag([2.0, 3.0, 0.0])
    bent = lambda c: c + np.where(np.arange(len(c)) == len(c) - 1, 0.4, 0.0)[:, None]
    made = [(kind, unit[kind] @ m + at) for kind in unit for m, at in ((shear, (1, 2, 3)), (shear[[1, 0, 2]], (2, 2, 2)), (np.diag([2.0, 2.0, 2.0]), (0, 0, 0)), (flat, (1, 1, 1)))]
    bends = [(kind, bent(unit[kind] @ shear)) for kind in unit] + [("tet", np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0], [0, 0, 4.0]])), ("pyr", np.array([[0, 0, 0], [4, 0, 0], [4, 4, 0], [0, 4, 0], [2, 2, 3.0]]))]

    def packed(some, first):
        rows = [(first + i, kind, *map(float, [*c.min(0), *c.max(0)]), *[c[:, a].tolist() for a in range(3)], [float("nan") if (first + i, k) == (4, 1) else float(v) for k, v in enumerate(rng.uniform(0, 1, len(c)))]) for i, (kind, c) in enumerate(some)]
        return spark.createDataFrame(rows, "elem_id long, kind string, lx double, ly double, lz double, hx double, hy double, hz double, xs array<double>, ys array<double>, zs array<double>, vs array<double>")

    at = [(i, *map(float, p)) for i, p in enumerate([*rng.uniform(0, 6, (1500, 3)), (0, 0, 0), (2, 2, 2), (1, 1, 0), (1, 1, 2), (1, 1, 1), (float("nan"), 1, 1)])]
    points = spark.createDataFrame(at, "pid long, px double, py double, pz double")
    straight, others = packed(made, 0), packed(bends, 50)
    for some in (straight, others, straight.unionByName(others)):
        got = {(r.pid, r.elem_id, r.kind): r.value for r in S.sample_elements(points, some).collect()}
        want = {(r.pid, r.elem_id, r.kind): r.value for r in E.element_values(join_points(points, some)).collect()}
        assert got.keys() == want.keys() and len(got) > 100
        assert np.allclose([got[k] for k in want], list(want.values()), rtol=0, atol=1e-7)
    assert E.with_inverses(straight.unionByName(others)).where("_ox IS NOT NULL").count() == 5  # not flat ones, nor the one with NaN
    sound = straight.where(~F.col("elem_id").isin(3, 4, 7))
    assert "MapInArrow" not in plan(S.sample_elements(points, sound)) and "MapInArrow" in plan(S.sample_elements(points, others))
    assert S.sample_elements(points, straight.limit(0)).count() == 0


def test_ranges_of_regions_do_not_expand_lists(spark):
    """A region was paired with each of its bricks and their cells; cells of one place are one, and those that only touch it count with their brick."""
    rng = np.random.default_rng(3)
    kinds = "brick_id long, lx int, ly int, lz int, sx int, sy int, sz int, level int, scalars array<double>"
    rows = []
    for i in range(40):
        size, level = [int(k) for k in rng.integers(1, 4, 3)], int(rng.integers(0, 2))
        low = [int(k) * (1 + level) if i % 4 else int(k) for k in rng.integers(0, 4, 3)]  # some off their level's lattice
        values = [None if v < 0.1 else float("nan") if v < 0.2 else float(v) for v in rng.uniform(0, 1, int(np.prod(size)))]
        rows.append((i, *low, *size, level, values))
    rows.append((99, 30, 0, 0, 1, 1, 1, 0, [None]))  # a region without values has no row
    bricks = spark.createDataFrame(rows, kinds)
    regions = B.regions(bricks)
    want, by_id = {}, {r[0]: r for r in rows}
    for r in regions.collect():
        found = []
        for b in (by_id[i] for i in r.brick_ids):
            w, size = 2.0 ** b[7], b[4:7]
            for k, v in enumerate(b[8]):
                at = (k % size[0], k // size[0] % size[1], k // (size[0] * size[1]))
                centre = [b[1 + n] + (at[n] + 0.5) * w for n in range(3)]
                if v is not None and not np.isnan(v) and all(c + w >= r[f"l{a}"] and c - w <= r[f"h{a}"] for a, c in zip("xyz", centre)):
                    found.append((v, w))
        if found:
            want[r.region_id] = (min(v for v, _ in found), max(v for v, _ in found), min(w for _, w in found))
    got = B.region_ranges(regions, bricks)
    assert {r.region_id: (r.vmin, r.vmax, r.finest_w) for r in got.collect()} == want and len(want) > 200
    assert "brick_ids" not in plan(got)
    assert B.region_ranges(regions, bricks.limit(0)).count() == 0


def test_points_meet_voxels_of_gridlets_at_their_place(spark):
    """Points met all gridlets of a bin, most of which didn't hold them; faces inside and at the ends, empty corners, levels."""
    from lattica.operators import fields as S

    scalars = [float(k) for k in range(12)]
    rows = [(1, 0, 0, 0, 0, 2, 1, 1, scalars), (2, 0, 2, 0, 0, 2, 1, 1, [None, *scalars[1:]]), (3, 1, -1, 0, 0, 1, 1, 2, scalars), (4, 0, 0, 0, 0, 1, 1, 1, [float("nan"), *scalars[1:8]])]
    gridlets = spark.createDataFrame(rows, "gridlet_id long, level int, lx int, ly int, lz int, dx int, dy int, dz int, scalars array<double>")
    places = [(0.5, 0.5, 0.5), (1.5, 1.5, 1.5), (2.5, 1.0, 1.0), (2.5, 1.5, 1.5), (3.5, 0.75, 0.5), (4.5, 1.5, 1.5), (1.0, 1.0, 5.0), (-1.0, 3.0, 3.0), (1.0, 3.0, 1.0), (float("nan"), 1.0, 1.0), (0.49, 1.0, 1.0), (1.25, 1.25, 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "pid long, px double, py double, pz double")
    want = {}
    for pid, p in enumerate(places):
        for g, level, *box, values in rows:
            q = [c / 2**level - 0.5 - l for c, l in zip(p, box)]
            if all(0 <= x <= n for x, n in zip(q, box[3:])):
                i = [min(int(x), n - 1) for x, n in zip(q, box[3:])]
                f = [x - k for x, k in zip(q, i)]
                corner = lambda k: values[i[0] + (k & 1) + (box[3] + 1) * (i[1] + (k >> 1 & 1) + (box[4] + 1) * (i[2] + (k >> 2)))]
                if all(corner(k) is not None and corner(k) == corner(k) for k in range(8)):
                    share = lambda k: np.prod([x if k >> n & 1 else 1 - x for n, x in enumerate(f)])
                    want[pid, g, i[0] + box[3] * (i[1] + box[4] * i[2])] = round(float(sum(share(k) * corner(k) for k in range(8))), 9)
    found = S.sample_gridlets(points, gridlets)
    assert {(r.pid, r.gridlet_id, r.cell): round(r.value, 9) for r in found.collect()} == want and len(want) > 10
    assert "_class" not in plan(found)
    assert S.sample_gridlets(points, gridlets.limit(0)).count() == 0


def test_tets_and_pyramids_are_inverted_once(spark):
    """They went to Python pair by pair. Faces and tips count as before; flat ones, and pyramids over a bent base, still go there."""
    from lattica.operators import fields as S
    from lattica.operators.range_join import join_points

    rng = np.random.default_rng(8)
    shear = np.array([[2, 0.3, 0.1], [-0.4, 3, 0.7], [0.2, 0.1, 2.5]])
    tet, pyr = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]]), np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0.5, 0.5, 1.0]])
    plain = [(k, c @ m + at) for k, c in (("tet", tet), ("pyr", pyr)) for m, at in ((shear, (1, 2, 3)), (shear[[1, 0, 2]], (2, 2, 2)), (np.diag([4.0] * 3), (0, 0, 0)))]
    others = [("tet", tet @ np.diag([3.0, 3, 0])), ("pyr", pyr @ np.diag([3.0, 0, 3])), ("pyr", pyr @ shear + np.eye(5)[:, [2]] * 0.4)]

    def packed(some):
        rows = [(i, kind, *map(float, [*c.min(0), *c.max(0)]), *[c[:, a].tolist() for a in range(3)], [float(v) for v in rng.uniform(0, 1, len(c))]) for i, (kind, c) in enumerate(some)]
        return spark.createDataFrame(rows, "elem_id long, kind string, lx double, ly double, lz double, hx double, hy double, hz double, xs array<double>, ys array<double>, zs array<double>, vs array<double>")

    corners = [(0, 0, 0), (4, 0, 0), (0, 4, 0), (2, 2, 4), (0, 0, 4), (2, 2, 0), (1, 1, 2), (2, 1, 1), (float("nan"), 1, 1)]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate([*rng.uniform(0, 6, (1500, 3)), *corners])], "pid long, px double, py double, pz double")
    for some in (packed(plain), packed(others), packed(plain + others)):
        got = {(r.pid, r.elem_id, r.kind): r.value for r in S.sample_elements(points, some).collect()}
        want = {(r.pid, r.elem_id, r.kind): r.value for r in E.element_values(join_points(points, some)).collect()}
        assert got.keys() == want.keys() and len(got) > 20
        assert np.allclose([got[k] for k in want], list(want.values()), rtol=0, atol=1e-7)
    assert "MapInArrow" not in plan(S.sample_elements(points, packed(plain))) and "MapInArrow" in plan(S.sample_elements(points, packed(others)))


def test_cells_of_overlapping_bricks_are_splatted_once(spark):
    """Every cell met every brick around it: a hundred bricks in one place were pairs of all their cells."""
    kinds = "brick_id long, lx int, ly int, lz int, sx int, sy int, sz int, level int, scalars array<double>"
    bricks = spark.createDataFrame([(i, 0, 0, 0, 1, 1, 1, 0, [i / 100]) for i in range(100)] + [(200, 1, 0, 0, 1, 1, 1, 0, [None]), (201, 2, 0, 0, 1, 1, 1, 1, [5.0]), (202, 40, 0, 0, 1, 1, 1, 0, [float("nan")])], kinds)
    found = B.splatted_ranges(bricks)
    want = {i: (0.0, 5.0) for i in range(100)} | {200: (0.0, 5.0), 201: (0.0, 5.0)}
    assert {r.brick_id: (r.vmin, r.vmax) for r in found.collect()} == want
    assert "c_brick_id" not in plan(found)


def test_rays_that_are_alike_meet_boxes_and_triangles_once(spark):
    """Copies of rays and of triangles were all paired and put in order."""
    from lattica.operators import rays as Y

    rays = spark.createDataFrame([(i, -1.0, 0.5 + i % 2, 0.5, 1.0, -0.0 if i % 4 else 0.0, 0.0, 0.0, None if i == 7 else 1e20) for i in range(8)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, tmin double, tmax double")
    some, members = Y._distinct(rays)
    assert sorted(r.ray_id for r in some.collect()) == [0, 1, 7] and members.count() == 8
    boxes = spark.createDataFrame([(b, float(b), 0.0, 0.0, b + 1.0, 1.0, 1.0) for b in (2, 1)], "box_id long, lx double, ly double, lz double, hx double, hy double, hz double")
    grid = ((0.0,) * 3, (4.0,) * 3, (2, 2, 2))
    assert {(r.ray_id, r.box_id, r.t0, r.n) for r in Y.box_hits(rays, boxes, "box_id", *grid).collect()} == {(i, b, b + 1.0, b) for i in (0, 2, 4, 6) for b in (1, 2)}
    first = Y.first_box(rays, boxes, "box_id", *grid)
    assert {(r.ray_id, r.box_id, r.t0) for r in first.collect()} == {(i, 1, 2.0) for i in (0, 2, 4, 6)} and "Window" not in plan(first)
    corners = "ax ay az bx b_y bz cx cy cz".split()
    triangles = spark.createDataFrame([(t, 2.0, 0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 0.0, 2.0) for t in (9, 5, 6)], "tri_id long, " + ", ".join(f"{c} double" for c in corners))
    assert {(r.ray_id, r.tri_id, r.t) for r in Y.triangle_hits(rays, triangles, *grid).collect()} == {(i, 5, 3.0) for i in range(7)}
