"""Sampling fields at points: cells, bricks, gridlets and elements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.elements import INVERSE, element_values, inverse_values, pyramid_inverse_values, tet_inverse_values, with_inverses
from lattica.functions.geometry import AXES, brick_domain, linear_index, width
from lattica.operators.cells import levels
from lattica.operators.columns import once, spread
from lattica.operators.grid import brick_cells
from lattica.operators.joins import by_key
from lattica.operators.mesh import SIZES
from lattica.operators.range_join import join_boxes, join_points
from lattica.storage import materialise


def weighted_mean(hits: DataFrame, key: list[str]) -> DataFrame:
    """Mean of value by weight; keys whose weights add up to 0 are misses and have no row."""
    summed = hits.groupBy(*key).agg(F.sum(F.col("weight") * F.col("value")).alias("_wv"), F.sum("weight").alias("_w"))
    return summed.where("_w > 0").select(*key, (F.col("_wv") / F.col("_w")).alias("value"))


def lattice_blocks(cells: DataFrame) -> DataFrame:
    """(_level, _ix, _iy, _iz, s0..s7, n0..n7): for each place between cell centres of a level the eight cells around it.

    s is the sum of their values and n their number (0 where there is no cell; more than 1 where cells coincide), x
    fastest. Depends on the cells alone: make it once for many samples.
    """
    sound = cells.where("value IS NOT NULL AND NOT isnan(value)").withColumn("_w", width("level"))
    at = F.array(*[F.struct(F.lit(k).alias("k"), *[(F.floor(F.col(a) / F.col("_w")) - (k >> i & 1)).cast("int").alias(f"_i{a}") for i, a in enumerate(AXES)]) for k in range(8)])
    each = sound.select(F.col("level").alias("_level"), F.col("value").cast("double").alias("value"), F.explode(at).alias("c")).select("_level", "value", "c.*")
    mine = lambda k, v: F.when(F.col("k") == k, v).otherwise(F.lit(0.0))
    return each.groupBy("_level", *[f"_i{a}" for a in AXES]).agg(*[F.sum(mine(k, F.col("value"))).alias(f"s{k}") for k in range(8)], *[F.sum(mine(k, F.lit(1.0))).alias(f"n{k}") for k in range(8)])


@dataclass(frozen=True)
class Lattice:
    """The blocks of some cells, written once for many samples, and their levels."""

    blocks: DataFrame
    levels: list[int]

    @classmethod
    def of(cls, cells: DataFrame) -> Lattice:
        return cls(materialise(lattice_blocks(cells)), levels(cells))


def sample_cells(points: DataFrame, cells: DataFrame | Lattice) -> DataFrame:
    """(pid, value) by the basis functions of all cells that reach a point, of whatever level.

    Cells lie on their level's lattice, so on each level eight places can reach a point. The cells are put together by
    these eights first; a point then goes to one row a level, by an equi-join, and the weights follow from its place.
    """
    known, blocks = (cells.levels, cells.blocks) if isinstance(cells, Lattice) else (levels(cells), None)
    if not known:
        return points.select("pid", F.lit(0.0).alias("value")).limit(0)
    summed = _lattice_sums(points, known, lattice_blocks(cells) if blocks is None else blocks)
    return summed.where("_w > 0").select("pid", (F.col("_wv") / F.col("_w")).alias("value"))


def _lattice_sums(points: DataFrame, known: list[int], blocks: DataFrame) -> DataFrame:
    """(pid, _wv, _w): sums of weight times value, and of weight, at points, from blocks of the levels known."""
    probes = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in known]))).withColumn("_w", width("_level"))
    probes = probes.withColumns({f"_q{a}": F.col(f"p{a}") / F.col("_w") - 0.5 for a in AXES})
    probes = probes.where(" AND ".join(f"abs(_q{a}) < 2147483647" for a in AXES))  # no cell is further, or at NaN
    probes = probes.select("pid", "_level", *[F.floor(f"_q{a}").cast("int").alias(f"_i{a}") for a in AXES], *[(F.col(f"_q{a}") - F.floor(f"_q{a}")).alias(f"_f{a}") for a in AXES])
    met = by_key(probes, blocks, ["_level", *[f"_i{a}" for a in AXES]])
    share = [reduce(lambda x, y: x * y, [F.col(f"_f{a}") if k >> i & 1 else 1 - F.col(f"_f{a}") for i, a in enumerate(AXES)]) for k in range(8)]
    return met.groupBy("pid").agg(*[F.sum(reduce(lambda x, y: x + y, [w * F.col(f"{c}{k}") for k, w in enumerate(share)])).alias(name) for c, name in (("s", "_wv"), ("n", "_w"))])


def brick_hits(met: DataFrame) -> DataFrame:
    """Contributions (pid, brick_id, weight, value) of the up to eight cells of a brick around a point.

    met: pairs of a point and a brick whose domain holds it. Cells outside the brick don't exist; their corners are
    left out.
    """
    w = width("level")
    q = {a: (F.col(f"p{a}") - F.col(f"l{a}")) / w - 0.5 for a in AXES}
    near = met.withColumns({f"_q{a}": x for a, x in q.items()}).withColumns({f"_i{a}": F.greatest(F.lit(-1.0), F.floor(f"_q{a}")) for a in AXES})
    corners = F.array(*[F.struct(*[(F.col(f"_i{a}") + o).cast("int").alias(a) for a, o in zip(AXES, (k & 1, k >> 1 & 1, k >> 2))]) for k in range(8)])
    each = near.withColumn("c", F.explode(corners))
    for a in AXES:
        each = each.where((F.col(f"c.{a}") >= 0) & (F.col(f"c.{a}") < F.col(f"s{a}")))
    weight = reduce(lambda a, b: a * b, [F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"_q{a}") - F.col(f"c.{a}"))) for a in AXES])
    value = F.element_at("scalars", (linear_index(F.col("c.x"), F.col("c.y"), F.col("c.z"), F.col("sx"), F.col("sy")) + 1).cast("int"))
    return each.select("pid", "brick_id", weight.alias("weight"), value.cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")


def _on_lattice() -> Column:
    """Whether a brick's cells lie on the lattice of its level, as those of a mesh do."""
    return reduce(lambda x, y: x & y, [F.pmod(F.col(f"l{a}").cast("double"), width("level")) == 0 for a in AXES])


def _brick_places(bricks: DataFrame) -> DataFrame:
    """Blocks of eight (see lattice_blocks) around the places of the bricks' cells, of which cells that coincide are put together first."""
    cells = brick_cells(bricks).where("value IS NOT NULL AND NOT isnan(value)")
    # the place a row, not its eight blocks a cell: rows are as many as places, however many bricks overlap
    met = cells.groupBy("level", *AXES).agg(F.sum("value").alias("_s"), F.count(F.lit(1)).cast("double").alias("_n")).withColumn("_w", width("level"))
    at = F.array(*[F.struct(F.lit(k).alias("k"), *[(F.floor(F.col(a) / F.col("_w")) - (k >> i & 1)).cast("int").alias(f"_i{a}") for i, a in enumerate(AXES)]) for k in range(8)])
    each = met.select(F.col("level").alias("_level"), "_s", "_n", F.explode(at).alias("c")).select("_level", "_s", "_n", "c.*")
    mine = lambda k, v: F.when(F.col("k") == k, F.col(v)).otherwise(F.lit(0.0))
    return each.groupBy("_level", *[f"_i{a}" for a in AXES]).agg(*[F.sum(mine(k, "_s")).alias(f"s{k}") for k in range(8)], *[F.sum(mine(k, "_n")).alias(f"n{k}") for k in range(8)])


def brick_sums(points: DataFrame, bricks: DataFrame) -> DataFrame:
    """(pid, _wv, _w): sums of weight times value and of weight of the cells of all bricks around each point.

    Bricks of a level share a lattice, so a cell's weight at a point depends on its place alone, whichever brick it is of. Cells are
    added up by place, and a point then meets one row a level, not one for each brick that holds it: bricks that overlap n-fold
    cost no more pairs than one. Bricks off their level's lattice are met one by one.
    """
    aligned, stray = bricks.where(_on_lattice()), bricks.where(~F.coalesce(_on_lattice(), F.lit(False)))
    known = levels(aligned)
    parts = []
    if known:
        parts.append(_lattice_sums(points, known, _brick_places(aligned)))
    if not known or not stray.isEmpty():
        names = ("lx", "ly", "lz")
        held = stray.select(*[F.col(c).alias(f"b{c}" if c in names else c) for c in stray.columns], *brick_domain())
        met = join_points(points, held).drop("lx", "ly", "lz", "hx", "hy", "hz").withColumnsRenamed({f"b{n}": n for n in names})
        parts.append(brick_hits(met).groupBy("pid").agg(F.sum(F.col("weight") * F.col("value")).alias("_wv"), F.sum("weight").alias("_w")))
    if len(parts) == 1:
        return parts[0]
    return parts[0].unionByName(parts[1]).groupBy("pid").agg(F.sum("_wv").alias("_wv"), F.sum("_w").alias("_w"))


def sample_bricks(points: DataFrame, bricks: DataFrame) -> DataFrame:
    """(pid, value) from all bricks whose domain holds a point; see brick_sums."""
    return brick_sums(points, bricks).where("_w > 0").select("pid", (F.col("_wv") / F.col("_w")).alias("value"))


def sample_regions(points: DataFrame, regions: DataFrame, bricks: DataFrame) -> DataFrame:
    """(pid, value) by way of disjoint regions of these bricks (see bricks.regions): equal to sample_bricks.

    Regions tell which points lie where a brick reaches; the bricks of a region are all that reach into it, so the sums at its points
    are those of brick_sums. A region's list of bricks is not expanded at its points: that is a row for each point and brick. A
    point on the common face of regions is in several, and counts once.
    """
    held = join_points(points, regions.select("lx", "ly", "lz", "hx", "hy", "hz")).select("pid", "px", "py", "pz").distinct()
    return sample_bricks(held, bricks)


def _gridlet_voxels(gridlets: DataFrame) -> DataFrame:
    """(gridlet_id, cell, _level, _ix, _iy, _iz, _last, _s0.._s7): voxels whose eight corners all have values, by their place on the level's lattice.

    _last has a bit for each axis on which a voxel is the gridlet's last, so that its upper face is the gridlet's. Corners go x fastest.
    """
    size = F.col("dx") * F.col("dy") * F.col("dz")
    each = spread(gridlets.where("dx > 0 AND dy > 0 AND dz > 0"), "gridlet_id").withColumn("cell", F.explode(F.sequence(F.lit(0), size - 1)))
    each = once(each, _jx=F.pmod("cell", "dx").cast("int"), _jy=F.pmod(F.floor(F.col("cell") / F.col("dx")), F.col("dy")).cast("int"), _jz=F.floor(F.col("cell") / (F.col("dx") * F.col("dy"))).cast("int"))
    at = lambda k: F.element_at("scalars", (linear_index(F.col("_jx") + (k & 1), F.col("_jy") + (k >> 1 & 1), F.col("_jz") + (k >> 2), F.col("dx") + 1, F.col("dy") + 1) + 1).cast("int")).cast("double")
    each = once(each, **{f"_s{k}": at(k) for k in range(8)}).where(" AND ".join(f"_s{k} IS NOT NULL AND NOT isnan(_s{k})" for k in range(8)))
    last = reduce(lambda x, y: x + y, [(F.col(f"_j{a}") == F.col(f"d{a}") - 1).cast("int") * (1 << n) for n, a in enumerate(AXES)])
    place = [(F.col(f"l{a}") + F.col(f"_j{a}")).cast("int").alias(f"_i{a}") for a in AXES]
    return each.select("gridlet_id", "cell", F.col("level").alias("_level"), *place, last.alias("_last"), *[f"_s{k}" for k in range(8)])


def sample_gridlets(points: DataFrame, gridlets: DataFrame) -> DataFrame:
    """(pid, gridlet_id, cell, value): trilinear in each gridlet that holds a point; empty corners are misses.

    Voxels of a level share a lattice, so a point meets the voxels at its place by an equi-join, and none that doesn't hold it. A point on
    the lower face of a voxel is in the one below only where that is the gridlet's last.
    """
    known = levels(gridlets)
    if not known:
        return points.crossJoin(gridlets.limit(0)).select("pid", "gridlet_id", F.lit(0).alias("cell"), F.lit(0.0).alias("value"))
    probes = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in known])))
    probes = once(probes, **{f"_q{a}": F.col(f"p{a}") / width("_level") - 0.5 for a in AXES}).where(" AND ".join(f"abs(_q{a}) < 2147483647" for a in AXES))
    for n, a in enumerate(AXES):
        q = F.col(f"_q{a}")
        here = F.floor(q).cast("int")
        own = lambda i, needs: F.struct(i.alias("i"), F.lit(needs).alias("needs"))
        probes = probes.withColumn(f"_c{a}", F.explode(F.when(q == here, F.array(own(here, 0), own(here - 1, 1 << n))).otherwise(F.array(own(here, 0)))))
    needs = F.col("_cx.needs") + F.col("_cy.needs") + F.col("_cz.needs")
    probes = probes.select("pid", "_level", *[F.col(f"_c{a}.i").alias(f"_i{a}") for a in AXES], needs.alias("_needs"), *[(F.col(f"_q{a}") - F.col(f"_c{a}.i")).alias(f"_f{a}") for a in AXES])
    met = by_key(probes, _gridlet_voxels(gridlets), ["_level", *[f"_i{a}" for a in AXES]]).where(F.col("_last").bitwiseAND(F.col("_needs")) == F.col("_needs"))
    lerp = lambda a, b, f: a * (1 - F.col(f)) + b * F.col(f)
    rows = [lerp(F.col(f"_s{k}"), F.col(f"_s{k + 1}"), "_fx") for k in (0, 2, 4, 6)]
    value = lerp(lerp(rows[0], rows[1], "_fy"), lerp(rows[2], rows[3], "_fy"), "_fz")
    return met.select("pid", "gridlet_id", "cell", value.alias("value")).where("NOT isnan(value)")


def sample_elements(points: DataFrame, packed: DataFrame) -> DataFrame:
    """(pid, elem_id, kind, value) of each packed element (see mesh.packed) at each point in it.

    Pairs grow with the square of the tables where points and elements fill the same space, so elements that a linear map unfolds are inverted
    once each, and only pairs of others go to Python with their corners.
    """
    every = materialise(with_inverses(packed, tuple(SIZES)))
    sides, inverted = ("lx", "ly", "lz", "hx", "hy", "hz"), F.col(INVERSE[0]).isNotNull()
    held = {(r[0], r[1]) for r in every.select("kind", inverted).distinct().collect()}  # twice the kinds at most
    parts = []
    for kinds, values in ((("wedge", "hex"), inverse_values), (("tet",), tet_inverse_values), (("pyr",), pyramid_inverse_values)):
        if any((k, True) in held for k in kinds):
            plain = every.where(inverted & F.col("kind").isin(*kinds)).select("elem_id", "kind", *sides, *INVERSE)
            parts.append(values(join_points(points, plain, finer=1)))
    if not parts or any(not plain for _, plain in held):
        parts.append(element_values(join_points(points, every.where(~inverted).drop(*INVERSE))))
    return reduce(DataFrame.unionByName, parts)


def stitched(gridlet_hits: DataFrame, element_hits: DataFrame) -> DataFrame:
    """(pid, value, cell): one hit a point, a gridlet's before an element's, then the smaller id."""
    g = gridlet_hits.select("pid", F.struct(F.lit(0).alias("kind"), F.col("gridlet_id").alias("id"), "value", F.col("cell").cast("long").alias("cell")).alias("h"))
    e = element_hits.select("pid", F.struct(F.lit(1).alias("kind"), F.col("elem_id").alias("id"), "value", F.lit(-1).cast("long").alias("cell")).alias("h"))
    return g.unionByName(e).groupBy("pid").agg(F.min("h").alias("h")).select("pid", "h.value", "h.cell")


def box_ranges(probes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(probe_id, vmin, vmax): values of the boxes (b_ prefix, b_vmin, b_vmax) that share volume with probes (a_ prefix)."""
    met = join_boxes(probes, boxes, "a_", "b_")
    return met.groupBy("probe_id").agg(F.min("b_vmin").alias("vmin"), F.max("b_vmax").alias("vmax"))
