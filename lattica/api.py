"""A volume as an object: fields from blocks or cells, a transfer function, rendering by rays."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions.transfer import lookup, opacity_scale
from lattica.operators import bricks, fields, grid, mesh, rays, tracking
from lattica.schema import BRICKS
from lattica.storage import materialise


class Field(Protocol):
    """What a volume is sampled by; points are (pid, px, py, pz)."""

    def sample(self, points: DataFrame) -> DataFrame: ...

    def ranges(self, low: tuple, high: tuple, dims: tuple) -> DataFrame: ...

    @property
    def spark(self) -> SparkSession: ...


def _one(hits: DataFrame, key: str) -> DataFrame:
    """(pid, value): of several hits of a point that of the smallest key."""
    return hits.groupBy("pid").agg(F.min_by("value", key).alias("value"))


@dataclass(frozen=True)
class CellField:
    table: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    def sample(self, points: DataFrame) -> DataFrame:
        return fields.sample_cells(points, self.table)

    def ranges(self, low, high, dims) -> DataFrame:
        return grid.cell_ranges(self.table, low, high, dims)


@dataclass(frozen=True)
class BrickField:
    table: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    def sample(self, points: DataFrame) -> DataFrame:
        return fields.sample_bricks(points, self.table)

    def ranges(self, low, high, dims) -> DataFrame:
        return grid.brick_ranges(self.table, low, high, dims)


@dataclass(frozen=True)
class RegionField:
    """Bricks by way of disjoint regions that know which bricks reach them; regions are made once."""

    table: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    @cached_property
    def regions(self) -> DataFrame:
        return materialise(bricks.regions(self.table))

    def sample(self, points: DataFrame) -> DataFrame:
        return fields.sample_regions(points, self.regions, self.table)

    def ranges(self, low, high, dims) -> DataFrame:
        valued = self.regions.join(bricks.region_ranges(self.regions, self.table), "region_id")
        return grid.value_ranges(valued, low, high, dims)


@dataclass(frozen=True)
class ElementField:
    """An unstructured mesh: elements (elem_id, kind, vertex_ids) and vertices (vertex_id, x, y, z, value)."""

    elements: DataFrame
    vertices: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.elements.sparkSession

    @cached_property
    def packed(self) -> DataFrame:
        return materialise(mesh.packed(mesh.corners(self.elements, self.vertices)))

    def hits(self, points: DataFrame) -> DataFrame:
        return fields.sample_elements(points, self.packed)

    def sample(self, points: DataFrame) -> DataFrame:
        return _one(self.hits(points), "elem_id")

    def ranges(self, low, high, dims) -> DataFrame:
        return grid.element_ranges(mesh.corners(self.elements, self.vertices), low, high, dims)


@dataclass(frozen=True)
class GridletField:
    """Gridlets (gridlet_id, l*, level, d*, scalars at vertices, null where empty)."""

    table: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    def hits(self, points: DataFrame) -> DataFrame:
        return fields.sample_gridlets(points, self.table)

    def sample(self, points: DataFrame) -> DataFrame:
        return _one(self.hits(points), "gridlet_id")

    def ranges(self, low, high, dims) -> DataFrame:
        return grid.gridlet_ranges(self.table, low, high, dims)


@dataclass(frozen=True)
class StitchedField:
    """Gridlets where there are any, and a mesh that stitches them together."""

    gridlets: GridletField
    mesh: ElementField

    @property
    def spark(self) -> SparkSession:
        return self.mesh.spark

    def sample(self, points: DataFrame) -> DataFrame:
        return fields.stitched(self.gridlets.hits(points), self.mesh.hits(points)).select("pid", "value")

    def ranges(self, low, high, dims) -> DataFrame:
        both = self.gridlets.ranges(low, high, dims).unionByName(self.mesh.ranges(low, high, dims))
        return both.groupBy("mc_id").agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def bricks_from_blocks(spark: SparkSession, blocks: list[tuple[tuple[int, ...], int, list[float]]]) -> DataFrame:
    """Bricks from blocks (bounds, level, data): bounds are lx, ly, lz, hx, hy, hz, the upper ones included, in cells of the level."""
    rows = []
    for i, (b, level, data) in enumerate(blocks):
        size = [h - l + 1 for l, h in zip(b[:3], b[3:])]
        if len(data) != size[0] * size[1] * size[2]:
            raise ValueError(f"block {i} has {len(data)} values for {size} cells")
        rows.append((i, *[v << level for v in b[:3]], *size, level, [float(v) for v in data]))
    return spark.createDataFrame(rows, BRICKS)


@dataclass(frozen=True)
class Volume:
    """Immutable: each setter gives a new volume, and nothing runs before a result is asked for."""

    field: Field
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    dims: tuple[int, int, int] = (16, 16, 16)
    entries: tuple = ((0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0))
    domain: tuple[float, float] = (0.0, 1.0)
    opacity: float = 100.0

    @staticmethod
    def from_blocks(spark: SparkSession, blocks: list, low, high, **more) -> Volume:
        return Volume(BrickField(bricks_from_blocks(spark, blocks)), low, high, **more)

    def transfer_function(self, entries, domain: tuple[float, float], opacity: float = 100.0) -> Volume:
        return replace(self, entries=tuple(entries), domain=domain, opacity=opacity)

    def _alpha(self, value: Column) -> Column:
        return F.least(F.lit(1.0), lookup(value, list(self.entries), *self.domain)["a"] * opacity_scale(F.lit(self.opacity)))

    def majorants(self) -> DataFrame:
        """Ranges don't depend on the transfer function: keep field.ranges() and redo only the last step when it changes."""
        m = grid.with_majorants(self.field.ranges(self.low, self.high, self.dims), list(self.entries), *self.domain)
        return m.withColumn("max_opacity", F.least(F.lit(1.0), F.col("max_opacity") * opacity_scale(F.lit(self.opacity))))

    def march(self, lines: DataFrame, dt: float, planes: list | None = None) -> DataFrame:
        """(ray_id, r, g, b, alpha): emission and absorption along rays, in cells that aren't empty, between clip planes."""
        lines = G.clip_interval(lines, planes or [])
        seg = grid.walk(lines, self.low, self.high, self.dims).join(self.majorants().where("max_opacity > 0").select("mc_id"), "mc_id", "left_semi")
        at = rays.steps(seg, dt).select("ray_id", "i", "t").distinct().join(lines, "ray_id")
        points = at.select(F.struct("ray_id", "i", "t").alias("pid"), *[(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"p{a}") for a in "xyz"])
        colour = lookup(F.col("value"), list(self.entries), *self.domain)
        lit = self.field.sample(points).select("pid.ray_id", "pid.t", colour["r"].alias("r"), colour["g"].alias("g"), colour["b"].alias("b"), rays.corrected(self._alpha(F.col("value")), F.lit(dt)).alias("a"))
        return rays.composite(lit)

    def trace(self, lines: DataFrame, light: tuple[float, float, float], bounces: int = 1024, scale: float = 1.0, seed: int = 1) -> DataFrame:
        field = self.field.table if isinstance(self.field, CellField) else self.field.sample
        return tracking.trace(lines, field, self.majorants(), self._alpha, self.low, self.high, self.dims, scale=scale, light=light, bounces=bounces, seed=seed)

    def render(self, view: dict, columns: int, rows: int, dt: float) -> DataFrame:
        """(ray_id, r, g, b, alpha) of every pixel; rays that meet nothing are clear."""
        lines = G.primary_rays(self.field.spark, view, columns, rows)
        seen = self.march(lines, dt)
        return lines.select("ray_id").join(seen, "ray_id", "left").na.fill(0.0)
