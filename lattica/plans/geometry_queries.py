"""Row-wise geometry, transfer functions and colours: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions import transfer as T
from lattica.plans.derived import NUDGE, oracle
from lattica.plans.derived import relation as R

LOW, HIGH, DIMS = (0.0, 0.0, 0.0), (64.0, 64.0, 64.0), (8, 8, 8)
RAMP = T.ramp()
MATCH = {"x": (-1.0, 2.0), "y": (3.0, 0.5), "z": (0.0, 4.0)}
PLANES = [((1.0, 0.0, 0.0), 10.0), ((-1.0, 0.0, 0.0), -50.0)]


def rounded(df, *names):
    """Six decimals; NUDGE keeps values that lie between two of them, but for noise, from going either way."""
    return df.withColumns({n: F.round(F.col(n) + NUDGE, 6) + 0.0 for n in names})


def p1_cell_geometry(s, d):
    return R(s, d, "cells").select("cell_id", *G.cell_box(), *G.cell_centre(), *G.cell_neighbour(1, 0, -1))


def p2_basis_domain(s, d):
    return R(s, d, "cells").select("cell_id", *G.cell_box(0.5))


def p3_brick_boxes(s, d):
    b = R(s, d, "bricks")
    return b.select("brick_id", *[c.alias(f"b{n}") for n, c in zip(("lx", "ly", "lz", "hx", "hy", "hz"), G.brick_box())], *G.brick_domain())


def p4_brick_cell_index(s, d):
    cells = R(s, d, "bricks").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sx") * F.col("sy") * F.col("sz") - 1)))
    ix, iy, iz = F.pmod("i", "sx"), F.pmod(F.floor(F.col("i") / F.col("sx")), F.col("sy")), F.floor(F.col("i") / (F.col("sx") * F.col("sy")))
    return cells.select("brick_id", "i", ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), iz.cast("int").alias("iz"), G.linear_index(ix, iy, iz, F.col("sx"), F.col("sy")).cast("int").alias("back"))


def p5_gridlet_boxes(s, d):
    g = R(s, d, "bricks").select("brick_id", "level", "lx", "ly", "lz", F.col("sx").alias("dx"), F.col("sy").alias("dy"), F.col("sz").alias("dz"))
    return g.select("brick_id", *G.gridlet_box())


def p6_grid_index(s, d):
    i = F.pmod("pid", F.lit(512))
    ix, iy, iz = G.grid_index(i, 8, 8)
    return R(s, d, "points").select("pid", ix.alias("ix"), iy.alias("iy"), iz.alias("iz"), G.linear_index(ix, iy, iz, 8, 8).alias("back"))


def p7_project_on_grid(s, d):
    return R(s, d, "points").select("pid", *[G.project_on_grid(F.col(f"p{a}") * 1.5 - 8, 0.0, 64.0, 8).alias(f"g{a}") for a in G.AXES])


def p8_snap(s, d):
    level = (F.col("pid") % 4).cast("int")
    return R(s, d, "points").select("pid", *[G.snap(F.col(f"p{a}") - 20, level).alias(f"s{a}") for a in G.AXES])


def p9_level_and_macro_index(s, d):
    level = (F.col("pid") % 4).cast("int")
    index = [G.level_index(F.col(f"p{a}") - 20, level) for a in G.AXES]
    return R(s, d, "points").select("pid", *[i.alias(f"c{a}") for a, i in zip(G.AXES, index)], *[F.floor(i / 8).cast("int").alias(f"m{a}") for a, i in zip(G.AXES, index)])


def p10_point_in_box(s, d):
    held = R(s, d, "points").select("pid", "px", "py", "pz", F.lit(10.0).alias("lx"), F.lit(20.0).alias("ly"), F.lit(5.0).alias("lz"), F.lit(40.0).alias("hx"), F.lit(45.0).alias("hy"), F.lit(30.0).alias("hz"))
    return held.where(G.contains(("px", "py", "pz"))).select("pid")


def p12_ray_box(s, d):
    r = R(s, d, "rays").withColumns({f"l{a}": F.lit(16.0) for a in G.AXES} | {f"h{a}": F.lit(48.0) for a in G.AXES})
    t0, t1 = G.ray_box()
    return rounded(r.select("ray_id", t0.alias("t0"), t1.alias("t1")).where("t0 < t1"), "t0", "t1")


def p13_ray_plane(s, d):
    t, behind = G.ray_plane((0.2, 1.0, -0.3), 20.0)
    return rounded(R(s, d, "rays").select("ray_id", t.alias("t"), behind.alias("behind")), "t")


def p14_clip_planes(s, d):
    r = G.clip_interval(R(s, d, "rays"), PLANES)
    return rounded(r.select("ray_id", "tmin", F.least("tmax", F.lit(1e6)).alias("tmax")), "tmin", "tmax")


def p15_transform(s, d):
    by = G.between_boxes((0, 0, 0), (64, 64, 64), (-1, 3, 0), (1, 3.5, 4))
    r = G.transform_rays(R(s, d, "rays").withColumn("tmax", F.lit(100.0)), by)
    return rounded(r.select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz", "tmax"), "ox", "oy", "oz", "dx", "dy", "dz", "tmax")


def p16_primary_rays(s, d):
    view = G.camera((0.0, 0.0, -5.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), 1.0, 1.5, 48, 32)
    return rounded(G.primary_rays(s, view, 48, 32).drop("tmax"), "dx", "dy", "dz")


def p17_subimage(s, d):
    window = (0.25, 0.5, 0.75, 1.0)
    p = s.range(64 * 64).select("id", ((F.col("id") % 64 + 0.5) / 64).alias("u"), ((F.floor(F.col("id") / 64) + 0.5) / 64).alias("v"))
    u, v = G.remap_pixel(F.col("u"), F.col("v"), window)
    return p.select("id", u.alias("ru"), v.alias("rv"), G.on_border(F.col("u"), F.col("v"), window, 0.02).alias("border"))


def p18_transfer_table(s, d):
    c = T.lookup(F.col("value"), RAMP, 0.0, 0.08)
    return rounded(R(s, d, "cells").select("cell_id", c.alias("c")).select("cell_id", "c.r", "c.g", "c.b", "c.a"), "r", "g", "b", "a")


def p19_transfer_linear(s, d):
    c = T.lookup_linear(F.col("value"), RAMP, 0.01, 0.06)
    return rounded(R(s, d, "cells").select("cell_id", c.alias("c")).select("cell_id", "c.r", "c.g", "c.b", "c.a"), "r", "g", "b", "a")


def j13_transfer_join(s, d):
    tf = T.table(s, RAMP)  # a fixed 16 rows
    c = R(s, d, "cells").withColumn("i", T.index(F.col("value"), 0.0, 0.08, len(RAMP)))
    return rounded(c.join(F.broadcast(tf), "i").select("cell_id", "i", "a"), "a")


def p20_domain_and_scale(s, d):
    low, high = T.relative_domain(2.0, 10.0, 75.0, 25.0, ordered=True)
    return rounded(R(s, d, "part").select("p_partkey", (F.lit(low) + F.col("p_size") * 0).alias("lo"), (F.lit(high) + F.col("p_size") * 0).alias("hi"), T.opacity_scale(F.col("p_size").cast("double") + 75).alias("scale")), "scale")


def p22_vector_magnitude(s, d):
    return rounded(R(s, d, "vectors").select("vec_id", G.length([F.col("x"), F.col("y"), F.col("z")]).alias("m")), "m")


def p23_planar_faces(s, d):
    corner = lambda k: [F.col("x") + F.lit(k % 2) + (F.col("cell_id") % 3 == k).cast("int"), F.col("y") + F.lit(k // 2), F.col("z") + (F.col("cell_id") % 5 == k).cast("int")]
    return R(s, d, "cells").select("cell_id", G.planar_face(corner(0), corner(1), corner(2), corner(3)).alias("planar"))


def p24_shade_modes(s, d):
    c = R(s, d, "cells")
    tf = T.lookup(F.col("value"), RAMP, 0.0, 0.08)
    board = T.checkerboard(F.col("x"), F.col("y"), F.col("z"))
    blend = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x") + F.col("y") - 40.0) / 20.0))
    return rounded(c.select("cell_id", tf["r"].alias("plain"), F.when(board, tf["r"]).otherwise(tf["r"] * 0.5).alias("board"), (tf["r"] * (1 - blend) + tf["b"] * blend).alias("teaser")), "plain", "board", "teaser")


def p25_colours(s, d):
    v = F.col("value") / 0.08
    heat, hue, sky = T.heat(v), T.hue(v), T.background(v)
    over = T.over([v * 0.5, v * 0.25, v * 0.125, v], [F.lit(1.0)] * 4)
    c = R(s, d, "cells").select("cell_id", *[x.alias(f"heat_{k}") for k, x in zip("rgb", heat)], *[x.alias(f"hue_{k}") for k, x in zip("rgb", hue)], sky[0].alias("sky_r"), over[0].alias("over_r"), over[3].alias("over_a"), T.id_colour(F.col("cell_id"))[1].alias("id_g"), T.packed_rgba([F.lit(0.5), F.lit(0.25), F.col("value") * 10, F.lit(1.0)]).alias("packed"))
    return rounded(c, *[n for n in c.columns if n not in ("cell_id", "packed")])


def p26_plane_polygons(s, d):
    b = R(s, d, "bricks").select("brick_id", *G.brick_box())
    return rounded(G.plane_box_points(b, "brick_id", (0.0, 0.0, 1.0), 50.5).select("brick_id", "n", "px", "py", "pz"), "px", "py", "pz").groupBy("brick_id").agg(F.count(F.lit(1)).alias("corners"), F.round(F.sum("px"), 4).alias("sx"), F.round(F.sum("py"), 4).alias("sy"))


def p29_rescale(s, d):
    return R(s, d, "part").select("p_partkey", G.rescale_power(F.col("p_retailprice") * F.pow(F.lit(10.0), F.col("p_size") % 8)).alias("power"))


def p30_mirror(s, d):
    return rounded(G.mirrored(R(s, d, "points").select("pid", "py"), 64.0, ["py"]), "py")


def _tf_case(column: str, values: str, kind: str) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN {i} THEN {e['rgba'.index(kind)]!r}e0" for i, e in enumerate(RAMP)) + " ELSE 0e0 END)"


_I = "least(15, CAST(floor(least(1e0, greatest(0e0, value / 0.08e0)) * 16) AS INT))"
_L = {k: f"((1 - f) * {_tf_case('i', '', k)} + f * {_tf_case('(i + 1)', '', k)})" for k in "rgba"}


def _w(level: str = "level") -> str:
    return f"power(2e0, {level})"


QUERIES = {f.__name__: f for f in (p1_cell_geometry, p2_basis_domain, p3_brick_boxes, p4_brick_cell_index, p5_gridlet_boxes, p6_grid_index, p7_project_on_grid, p8_snap, p9_level_and_macro_index, p10_point_in_box, p12_ray_box, p13_ray_plane, p14_clip_planes, p15_transform, p16_primary_rays, p17_subimage, p18_transfer_table, p19_transfer_linear, j13_transfer_join, p20_domain_and_scale, p22_vector_magnitude, p23_planar_faces, p24_shade_modes, p25_colours, p26_plane_polygons, p29_rescale, p30_mirror)}

_clamp = lambda x: f"least(1e0, greatest(0e0, {x}))"
ORACLES = {
    k: oracle(v)
    for k, v in {
        "p1_cell_geometry": f"SELECT cell_id, {', '.join(f'CAST({a} AS DOUBLE) AS l{a}, {a} + {_w()} AS h{a}, {a} + 0.5e0 * {_w()} AS c{a}' for a in 'xyz')}, CAST(x + {_w()} AS INT) AS nx, y AS ny, CAST(z - {_w()} AS INT) AS nz FROM {{cells}}",
        "p2_basis_domain": f"SELECT cell_id, {', '.join(f'{a} - 0.5e0 * {_w()} AS l{a}, {a} + 1.5e0 * {_w()} AS h{a}' for a in 'xyz')} FROM {{cells}}",
        "p3_brick_boxes": f"SELECT brick_id, {', '.join(f'CAST(l{a} AS DOUBLE) AS bl{a}, l{a} + s{a} * {_w()} AS bh{a}, l{a} - 0.5e0 * {_w()} AS l{a}, l{a} + (s{a} + 0.5e0) * {_w()} AS h{a}' for a in 'xyz')} FROM {{bricks}}",
        "p4_brick_cell_index": "SELECT brick_id, CAST(i AS INT) AS i, CAST(i % sx AS INT) AS ix, CAST((i // sx) % sy AS INT) AS iy, CAST(i // (sx * sy) AS INT) AS iz, CAST(i AS INT) AS back FROM (SELECT *, unnest(range(sx * sy * sz)) AS i FROM {bricks})",
        "p5_gridlet_boxes": f"SELECT brick_id, {', '.join(f'(l{a} + 0.5e0) * {_w()} AS l{a}, (l{a} + s{a} + 0.5e0) * {_w()} AS h{a}' for a in 'xyz')} FROM {{bricks}}",
        "p6_grid_index": "SELECT pid, CAST(pid % 8 AS INT) AS ix, CAST(pid // 8 % 8 AS INT) AS iy, CAST(pid // 64 % 8 AS INT) AS iz, CAST(pid % 512 AS INT) AS back FROM {points}",
        "p7_project_on_grid": "SELECT pid, " + ", ".join(f"CAST(greatest(0e0, least(7e0, floor((p{a} * 1.5e0 - 8) / 64e0 * 8))) AS INT) AS g{a}" for a in "xyz") + " FROM {points}",
        "p8_snap": "SELECT pid, " + ", ".join(f"floor((p{a} - 20) / power(2e0, pid % 4)) * power(2e0, pid % 4) AS s{a}" for a in "xyz") + " FROM {points}",
        "p9_level_and_macro_index": "SELECT pid, cx, cy, cz, " + ", ".join(f"CAST(floor(c{a} / 8e0) AS INT) AS m{a}" for a in "xyz") + " FROM (SELECT pid, " + ", ".join(f"CAST(floor((p{a} - 20) / power(2e0, pid % 4)) AS INT) AS c{a}" for a in "xyz") + " FROM {points})",
        "p10_point_in_box": "SELECT pid FROM {points} WHERE px BETWEEN 10 AND 40 AND py BETWEEN 20 AND 45 AND pz BETWEEN 5 AND 30",
        "p12_ray_box": "SELECT ray_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM (SELECT ray_id, greatest(tmin, " + ", ".join(f"least((16 - o{a}) / d{a}, (48 - o{a}) / d{a})" for a in "xyz") + ") AS t0, least(tmax, " + ", ".join(f"greatest((16 - o{a}) / d{a}, (48 - o{a}) / d{a})" for a in "xyz") + ") AS t1 FROM {rays}) WHERE t0 < t1",
        "p13_ray_plane": "SELECT ray_id, round((20 - (0.2e0 * ox + oy - 0.3e0 * oz)) / n, 6) + 0e0 AS t, n > 0 AS behind FROM (SELECT *, 0.2e0 * dx + dy - 0.3e0 * dz AS n FROM {rays})",
        "p14_clip_planes": "SELECT ray_id, round(greatest(0e0, (50 - ox) / dx), 6) AS tmin, round(least(1e6, (10 - ox) / dx), 6) AS tmax FROM {rays}",
        "p15_transform": "SELECT ray_id, round(ox / 32 - 1, 6) AS ox, round(oy / 128 + 3, 6) AS oy, round(oz / 16, 6) AS oz, round(dx / 32 / n, 6) AS dx, round(dy / 128 / n, 6) AS dy, round(dz / 16 / n, 6) + 0e0 AS dz, round(100 * n, 6) AS tmax FROM (SELECT *, sqrt(dx * dx / 1024 + dy * dy / 16384 + dz * dz / 256) AS n FROM {rays})",
        "p16_primary_rays": "SELECT id AS ray_id, 0e0 AS ox, 0e0 AS oy, -5e0 AS oz, " + ", ".join(f"round(CASE WHEN abs({a} / n) < 1e-5 THEN 1e-5 ELSE {a} / n END, 6) AS d{a}" for a in "xyz") + ", 0e0 AS tmin FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (SELECT id, (0.5e0 - (id % 48 + 0.5e0) / 48) * 3 * tan(0.5e0) AS x, ((id // 48 + 0.5e0) / 32 - 0.5e0) * 2 * tan(0.5e0) AS y, 1e0 AS z FROM (SELECT range AS id FROM range(48 * 32))))",
        "p17_subimage": "SELECT id, 0.25e0 + u * 0.5e0 AS ru, 0.5e0 + v * 0.5e0 AS rv, u BETWEEN 0.25e0 AND 0.75e0 AND v BETWEEN 0.5e0 AND 1e0 AND (u < 0.27e0 OR u > 0.73e0 OR v < 0.52e0 OR v > 0.98e0) AS border FROM (SELECT range AS id, (range % 64 + 0.5e0) / 64 AS u, (range // 64 + 0.5e0) / 64 AS v FROM range(4096))",
        "p18_transfer_table": "SELECT cell_id, " + ", ".join(f"round({_tf_case('i', '', k)}, 6) AS {k}" for k in "rgba") + f" FROM (SELECT *, {_I} AS i FROM {{cells}})",
        "p19_transfer_linear": "SELECT cell_id, " + ", ".join(f"round(CASE WHEN q > -1 AND q < 16 THEN {_L[k]} ELSE 0e0 END, 6) AS {k}" for k in "rgba") + " FROM (SELECT *, CAST(floor(q) AS INT) AS i, q - floor(q) AS f FROM (SELECT *, (value - 0.01e0) / (0.06e0 - 0.01e0) * 16 - 0.5e0 AS q FROM {cells}))",
        "j13_transfer_join": f"SELECT cell_id, i, round(a, 6) AS a FROM (SELECT *, {_I} AS i FROM {{cells}}) JOIN (SELECT range AS k, power(range / 15e0, 2) AS a FROM range(16)) ON i = k",
        "p20_domain_and_scale": "SELECT p_partkey, 4e0 AS lo, 8e0 AS hi, round(power(1.1e0, p_size - 25), 6) AS scale FROM part",
        "p22_vector_magnitude": "SELECT vec_id, round(sqrt(x * x + y * y + z * z), 6) AS m FROM {vectors}",
        "p23_planar_faces": "SELECT cell_id, (x + i0 = x + 1 + i1 AND x + 1 + i1 = x + i2 AND x + i2 = x + 1 + i3) OR (z0 = z1 AND z1 = z2 AND z2 = z3) AS planar FROM (SELECT *, " + ", ".join(f"CAST(cell_id % 3 = {k} AS INT) AS i{k}, CAST(cell_id % 5 = {k} AS INT) AS z{k}" for k in range(4)) + " FROM {cells})",
        "p24_shade_modes": f"SELECT cell_id, round(r, 6) AS plain, round(CASE WHEN (x + y + z) % 2 = 0 THEN r ELSE r * 0.5e0 END, 6) AS board, round(r * (1 - m) + b * m, 6) AS teaser FROM (SELECT *, {_tf_case('i', '', 'r')} AS r, {_tf_case('i', '', 'b')} AS b, {_clamp('(x + y - 40e0) / 20')} AS m FROM (SELECT *, {_I} AS i FROM {{cells}}))",
        "p25_colours": f"SELECT cell_id, round({_clamp('c - 2')}, 6) AS heat_r, round({_clamp('least(c, 4 - c)')}, 6) AS heat_g, round({_clamp('2 - c')}, 6) AS heat_b, round({_clamp('abs(v * 6 - 3) - 1')}, 6) AS hue_r, round({_clamp('2 - abs(v * 6 - 2)')}, 6) AS hue_g, round({_clamp('2 - abs(v * 6 - 4)')}, 6) AS hue_b, round(1 - 0.5e0 * v, 6) AS sky_r, round(v * 0.5e0 + 1 - v, 6) AS over_r, 1e0 AS over_a, round((cell_id * 151 % 256) / 255e0, 6) AS id_g, 128 + 64 * 256 + CAST(least(255, greatest(0, floor(value * 10 * 256e0))) AS BIGINT) * 65536 + 255 * 16777216::BIGINT AS packed FROM (SELECT *, value / 0.08e0 AS v, {_clamp('value / 0.08e0')} * 4 AS c FROM {{cells}})",
        "p26_plane_polygons": "SELECT brick_id, 4 AS corners, round(2e0 * lx + 2 * (lx + sx * power(2e0, level)), 4) AS sx, round(2e0 * ly + 2 * (ly + sy * power(2e0, level)), 4) AS sy FROM {bricks} WHERE lz < 50.5e0 AND lz + sz * power(2e0, level) > 50.5e0",
        "p29_rescale": "SELECT p_partkey, CAST(greatest(0e0, ceil(log10(p_retailprice * power(10e0, p_size % 8) / 1000) / 3 - 1e-12)) AS INT) AS power FROM part",
        "p30_mirror": "SELECT pid, round(py, 6) AS py, false AS mirror FROM {points} UNION ALL SELECT pid, round(128 - py, 6), true FROM {points}",
    }.items()
}
