"""Multi-level cell lookup, the dual mesh of cells, and gridlets of its cubes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import AXES, linear_index, snap, width
from lattica.operators.joins import by_key
from lattica.operators.numbering import ordinal
from lattica.storage import materialise

#: Corners of a hexahedron in VTK order, as (x, y, z) of the unit cube. A fixed value.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
#: Faces in the order in which they are tried: bottom, top, front, back, left, right; each as the axis and its side.
FACES = [(2, 0), (2, 1), (1, 0), (1, 1), (0, 0), (0, 1)]
#: The same faces in the order in which their parallel edges are tried. A fixed value.
EDGE_FACES = [(1, 0), (1, 1), (2, 1), (2, 0), (0, 0), (0, 1)]


def levels(cells: DataFrame) -> list[int]:
    """Levels in use, finest first; a handful of numbers."""
    return sorted(r[0] for r in cells.select("level").distinct().collect())


def find_cells(points: DataFrame, cells: DataFrame, key: list[str], xyz: tuple[str, str, str] = ("px", "py", "pz"), keep: list[str] | None = None) -> DataFrame:
    """The cell that holds each point, the finest if several do: key, then found_id, found_level and keep columns.

    A point probes one position a level by an equi-join; points that no cell holds have no row.
    """
    keep = keep or []
    known = levels(cells)
    probes = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in known]))) if known else points.limit(0).withColumn("_level", F.lit(0))
    probes = probes.select(*key, "_level", *[snap(F.col(c), F.col("_level")).cast("int").alias(f"_{a}") for a, c in zip(AXES, xyz)])
    side = cells.select(F.col("level").alias("_level"), *[F.col(a).alias(f"_{a}") for a in AXES], F.struct("level", "cell_id", *keep).alias("_found"))
    met = by_key(probes, side, ["_level", "_x", "_y", "_z"]).groupBy(*key).agg(F.min("_found").alias("f"))
    return met.select(*key, F.col("f.cell_id").alias("found_id"), F.col("f.level").alias("found_level"), *[F.col(f"f.{k}").alias(k) for k in keep])


def _neighbour(i: int, j: int, k: int) -> int:
    return (i + 1) + 3 * ((j + 1) + 3 * (k + 1))


def dual_cells(cells: DataFrame) -> DataFrame:
    """Dual cells (cell_id, octant, level, min_level, max_level, corners, n_unique) of non-overlapping cells.

    corners: array of (cell_id, level) in VTK order, in the orientation of the axes. A cell makes a dual cell in an
    octant if all eight neighbours' places are covered and none of them by a finer cell, and of the cells of its level
    among the corners it is the one with the smallest id. The 27 places around a cell are looked up once and shared by
    its octants.
    """
    w = width("level")
    around = list(product((-1, 0, 1), repeat=3))
    places = F.array(*[F.struct(F.lit(_neighbour(i, j, k)).alias("n"), *[(F.col(a) + (d + 0.5) * w).alias(f"p{a}") for a, d in zip(AXES, (i, j, k))]) for i, j, k in around])
    asked = cells.select("cell_id", F.explode(places).alias("p")).select("cell_id", "p.*")
    found = find_cells(asked, cells, ["cell_id", "n"])
    have = found.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct(F.col("found_id").alias("id"), F.col("found_level").alias("level"))))).alias("m"))
    own = by_key(cells.select("cell_id", "level"), have, "cell_id")

    def octant(number: int, step: tuple[int, int, int]) -> Column:
        at = []
        for corner in CORNERS:
            # along an axis that is walked downwards the near corner is the far one of the canonical order
            offset = tuple(d if (c == 1) == (d > 0) else 0 for c, d in zip(corner, step))
            at.append(F.try_element_at("m", F.lit(_neighbour(*offset))))
        return F.struct(F.lit(number).alias("octant"), F.array(*at).alias("corners"))

    octants = F.array(*[octant(n, s) for n, s in enumerate(product((-1, 1), repeat=3))])
    d = own.select("cell_id", "level", F.explode(octants).alias("o")).select("cell_id", "level", "o.*").where(~F.exists("corners", lambda c: c.isNull()))
    d = d.withColumns({"min_level": F.array_min(F.col("corners.level")), "max_level": F.array_max(F.col("corners.level")), "n_unique": F.size(F.array_distinct(F.col("corners.id")))})
    owner = F.array_min(F.transform(F.filter("corners", lambda c: c["level"] == F.col("level")), lambda c: c["id"]))
    return d.where(F.col("min_level") == F.col("level")).where(owner == F.col("cell_id"))


def _of_face(axis: int, side: int) -> list[int]:
    return [i for i, c in enumerate(CORNERS) if c[axis] == side]


def _edges(axis: int, face: tuple[int, int]) -> list[tuple[int, int]]:
    """The face's two edges along an axis, each from its low to its high end."""
    ends = _of_face(*face)
    return [(a, b) for a in ends for b in ends if CORNERS[a][axis] == 0 and CORNERS[b][axis] == 1 and all(CORNERS[a][k] == CORNERS[b][k] for k in range(3) if k != axis)]


def _across(corner: int, axis: int) -> int:
    return CORNERS.index(tuple(1 - v if k == axis else v for k, v in enumerate(CORNERS[corner])))


#: Pairs of corners, in the order of the bits that say that a pair is one cell.
PAIRS = list(combinations(range(8), 2))


def _bits(*groups: Iterable[int]) -> int:
    """The mask in which all corners of each group are one cell."""
    return sum({1 << PAIRS.index(p) for g in groups for p in combinations(sorted(g), 2)})


def _rules() -> list[tuple[str, int | None, int, list[int]]]:
    """Kind ("" for nothing), number of distinct corners (None for any), mask, and the corners that make the element.

    Faces that are one corner are tried in the order of FACES, then parallel edges of faces in that of EDGE_FACES.
    """
    out: list[tuple[str, int | None, int, list[int]]] = []
    for axis, side in FACES:
        gone, ring = _of_face(axis, side), _of_face(axis, 1 - side)
        out.append(("pyr", 5, _bits(gone), [*ring, gone[0]]))
        for k in range(4):
            ends = ring[k], ring[(k + 1) % 4]
            if sum(a != b for a, b in zip(CORNERS[ends[0]], CORNERS[ends[1]])) == 1:
                out.append(("tet", 4, _bits(gone, ends), [ring[(k + 1 + j) % 4] for j in range(3)] + [gone[0]]))
        out.append(("", None, _bits(gone), []))
    for face in EDGE_FACES:
        for axis in (k for k in range(3) if k != face[0]):
            (a, b), (c, d) = _edges(axis, face)
            # each collapsed edge is the tip of a triangle whose other corners are across the face
            out.append(("wedge", None, _bits((a, b), (c, d)), [a, _across(b, face[0]), _across(a, face[0]), c, _across(d, face[0]), _across(c, face[0])]))
    return out


def classify(dual: DataFrame) -> DataFrame:
    """Elements (cell_id, octant, kind, perfect_level, vertex_ids) of dual cells; degenerate ones have no row.

    All corners of a level: a perfect cube (perfect_level tells which). Eight corners: a hex. Fewer than four: nothing.
    A face that is one corner: a pyramid over the other side if five corners are left; if four, a tet, provided that an
    edge of the other side has collapsed, else nothing. Two parallel edges of a face: a wedge. Else a hex with corners
    that coincide. The first rule that holds counts; faces are tried in the order of FACES.

    Which of the 28 pairs of corners are one cell is one number a row; a rule is a test of its bits.
    """
    ids = [F.col("corners")[k]["id"] for k in range(8)]
    mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(ids[a] == ids[b], F.lit(1 << n)).otherwise(F.lit(0)) for n, (a, b) in enumerate(PAIRS)])
    # a generator's column, which the optimiser does not write out again in every rule
    marked = dual.select("*", F.explode(F.array(mask.cast("long"))).alias("_mask"))
    whole, rules = F.lit(-1), _rules()
    rule = F.when((F.col("min_level") == F.col("max_level")) | (F.col("n_unique") == 8), whole).when(F.col("n_unique") < 4, F.lit(None).cast("int"))
    for number, (kind, n, bits, _) in enumerate(rules):
        holds = F.col("_mask").bitwiseAND(F.lit(bits)) == bits
        rule = rule.when(holds & (F.col("n_unique") == n) if n else holds, F.lit(number if kind else None).cast("int"))
    found = marked.select("*", F.explode(F.array(rule.otherwise(whole))).alias("_rule")).where("_rule IS NOT NULL")
    kinds, orders = (F.array(*values) for values in (map(F.lit, ["hex", *[r[0] for r in rules]]), [F.array(*map(F.lit, r)) for r in [list(range(8)), *[r[3] for r in rules]]]))
    ordered = F.transform(F.element_at(orders, F.col("_rule") + 2), lambda i: F.get("corners", i)["id"])
    perfect = F.when(F.col("min_level") == F.col("max_level"), F.col("min_level").cast("int")).otherwise(F.lit(-1))
    return found.select("cell_id", "octant", F.element_at(kinds, F.col("_rule") + 2).alias("kind"), perfect.alias("perfect_level"), ordered.alias("vertex_ids"))


def element_counts(elements: DataFrame) -> DataFrame:
    """Elements by kind, perfect and twisted."""
    return elements.groupBy("kind", (F.col("perfect_level") >= 0).alias("perfect")).agg(F.count(F.lit(1)).alias("n"))


def faces_shared(elements: DataFrame) -> DataFrame:
    """Quad faces of hexes by how many elements share them: more than two would be a broken mesh."""
    faces = F.array(*[F.array_sort(F.array(*[F.col("vertex_ids")[i] for i in _of_face(a, s)])) for a, s in FACES])
    each = elements.where("kind = 'hex'").select(F.explode(faces).alias("face"))
    return each.groupBy("face").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("faces"))


#: Faces of elements in VTK order, seen from outside turning one way.
ORIENTED = {
    "tet": ((0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)),
    "pyr": ((0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)),
    "wedge": ((0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)),
    "hex": ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)),
}


def oriented_faces(elements: DataFrame) -> DataFrame:
    """(elem, face, sign) of the triangles and quads that bound elements (kind, vertex_ids, and elem, any key).

    face is the ring of corners from its smallest one on, in the direction of the smaller neighbour; sign tells whether the
    element turns that way (1) or the other (-1). Corners that coincide are one corner; what is left of a face with fewer than three, or
    one that is folded onto itself, bounds nothing and has no row.
    """
    rings = F.when(F.lit(False), F.array().cast("array<array<int>>"))
    for kind, faces in ORIENTED.items():
        rings = rings.when(F.col("kind") == kind, F.array(*[F.array(*map(F.lit, f)) for f in faces]))
    ring = elements.select("elem", F.explode(F.transform(rings, lambda f: F.transform(f, lambda i: F.get("vertex_ids", i)))).alias("_r"))
    previous = lambda i: F.get("_r", F.pmod(i - 1 + F.size("_r"), F.size("_r")))
    ring = ring.withColumn("_r", F.filter("_r", lambda x, i: x != previous(i))).where((F.size("_r") >= 3) & (F.size(F.array_distinct("_r")) == F.size("_r")))
    first = F.array_position("_r", F.array_min("_r")).cast("int") - 1
    ring = ring.withColumn("_r", F.concat(F.slice("_r", first + 1, F.size("_r") - first), F.slice("_r", F.lit(1), first)))
    other = F.concat(F.slice("_r", 1, 1), F.reverse(F.slice("_r", F.lit(2), F.size("_r") - 1)))
    forward = F.get("_r", F.lit(1)) < F.get("_r", F.size("_r") - 1)
    return ring.select("elem", F.when(forward, F.col("_r")).otherwise(other).alias("face"), F.when(forward, 1).otherwise(-1).alias("sign"))


def conformity(faces: DataFrame) -> DataFrame:
    """(face, n, net, state) of oriented faces: an inner face has two elements that turn it opposite ways and cancel.

    state: boundary (one element), inner (two that cancel), inverted (two that turn it alike), multiple (more than two).
    """
    summed = faces.groupBy("face").agg(F.count(F.lit(1)).alias("n"), F.sum("sign").alias("net"))
    state = F.when(F.col("n") == 1, "boundary").when(F.col("n") > 2, "multiple").when(F.col("net") == 0, "inner").otherwise("inverted")
    return summed.withColumn("state", state)


def cubes(elements: DataFrame, cells: DataFrame) -> DataFrame:
    """Perfect cubes (level, ix, iy, iz, ids): the level's index of the cell at their lower corner, ids in VTK order."""
    own = cells.select(F.col("cell_id").alias("_id"), *AXES, F.col("level").alias("_l"))
    perfect = elements.where("perfect_level >= 0").join(own.hint("merge"), F.col("vertex_ids")[0] == F.col("_id"))
    return perfect.select(F.col("perfect_level").alias("level"), *[F.floor(F.col(a) / width("_l")).cast("int").alias(f"i{a}") for a in AXES], F.col("vertex_ids").alias("ids"))


def cluster_gridlets(cubes: DataFrame, edge: int = 8) -> DataFrame:
    """Gridlets (gridlet keys mx, my, mz, level, lower l*, dims d*, n_cubes, ids): the cubes of each macrocell.

    ids holds the cell at each vertex of the gridlet's box, x fastest, null where no cube has one. Cubes that disagree
    on a vertex raise an error. A macrocell has edge^3 cubes at most, so a group is bounded.
    """
    c = materialise(cubes.withColumns({f"m{a}": F.floor(F.col(f"i{a}") / edge).cast("int") for a in AXES}))  # read twice below
    key = ["level", "mx", "my", "mz"]
    bounds = c.groupBy(*key).agg(*[F.min(f"i{a}").alias(f"l{a}") for a in AXES], *[(F.max(f"i{a}") - F.min(f"i{a}") + 1).alias(f"d{a}") for a in AXES], F.count(F.lit(1)).alias("n_cubes"))
    corner = F.array(*[F.struct(*[(F.col(f"i{a}") + o).alias(f"v{a}") for a, o in zip(AXES, offset)], F.col("ids")[n].alias("id")) for n, offset in enumerate(CORNERS)])
    vertices = c.select(*key, F.explode(corner).alias("v")).select(*key, "v.*").groupBy(*key, "vx", "vy", "vz").agg(F.min("id").alias("id"), F.max("id").alias("_other"))
    vertices = vertices.withColumn("id", F.when(F.col("id") == F.col("_other"), F.col("id")).otherwise(F.raise_error(F.lit("cubes disagree on a vertex")).cast("long")))
    slots = by_key(vertices, bounds, key).withColumn("slot", linear_index(*[F.col(f"v{a}") - F.col(f"l{a}") for a in AXES], F.col("dx") + 1, F.col("dy") + 1))
    filled = slots.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "id"))).alias("m"))
    n = (F.col("dx") + 1) * (F.col("dy") + 1) * (F.col("dz") + 1)
    return by_key(bounds, filled, key).withColumn("ids", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.try_element_at("m", i))).drop("m")


def gridlet_scalars(gridlets: DataFrame, cells: DataFrame) -> DataFrame:
    """Gridlets with scalars for ids (null where there is none): a left join by cell."""
    key = ["level", "mx", "my", "mz"]
    slots = gridlets.select(*key, F.posexplode("ids").alias("slot", "cell_id"))
    values = by_key(slots, cells.select("cell_id", "value"), "cell_id", "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("s"))
    return by_key(gridlets, values.select(*key, F.col("s.value").alias("scalars")), key)


def gridlet_counts(gridlets: DataFrame) -> DataFrame:
    return gridlets.agg(F.count(F.lit(1)).alias("gridlets"), F.sum("n_cubes").alias("cubes"), F.sum(F.size("ids")).alias("slots"), F.sum(F.size(F.filter("ids", lambda i: i.isNull()))).alias("empty"))


def in_order(cells: DataFrame) -> DataFrame:
    """Cells with their place (from 0) in the order of (y, x, level, z), each as an unsigned number, then of the id.

    That is the order of a record of x, y, z and level read as two little-endian 64-bit numbers.
    """
    unsigned = {f"_u{a}": F.pmod(F.col(a).cast("long"), F.lit(1 << 32)) for a in ("y", "x", "level", "z")}
    return ordinal(cells.withColumns(unsigned), ["_uy", "_ux", "_ulevel", "_uz", "cell_id"], "place").drop(*unsigned)
