"""Unstructured meshes: assembling elements, looking vertices up, compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.joins import by_key
from lattica.operators.numbering import dense_ids

#: Vertices that an element of each kind has.
SIZES = {"tet": 4, "pyr": 5, "wedge": 6, "hex": 8}


def assemble(parts: dict[str, DataFrame]) -> DataFrame:
    """Elements of all kinds (elem_id, kind, vertex_ids) from one table a kind (elem_id, vertex_ids)."""
    for kind in parts:
        if kind not in SIZES:
            raise ValueError(f"no such kind of element: {kind}")
    return reduce(DataFrame.unionByName, [df.select("elem_id", F.lit(kind).alias("kind"), "vertex_ids") for kind, df in parts.items()])


def kind_of() -> Column:
    n = F.size("vertex_ids")
    return reduce(lambda c, k: c.when(n == SIZES[k], F.lit(k)), list(SIZES)[1:], F.when(n == SIZES["tet"], F.lit("tet")))


def vertex_values(vertices: DataFrame, scalars: DataFrame) -> DataFrame:
    """Vertices whose value is the scalar of their tag, else their own, else 0."""
    tagged = vertices.join(scalars.withColumnsRenamed({"idx": "tag", "value": "_scalar"}), "tag", "left")
    return tagged.select("vertex_id", "x", "y", "z", F.coalesce("_scalar", "value", F.lit(0.0)).alias("value"))


def corners(elements: DataFrame, vertices: DataFrame) -> DataFrame:
    """(elem_id, kind, n, x, y, z, value) of each element's vertices."""
    each = elements.select("elem_id", "kind", F.posexplode("vertex_ids").alias("n", "vertex_id"))
    return by_key(each, vertices, "vertex_id").select("elem_id", "kind", "n", "x", "y", "z", "value")


def packed(corners: DataFrame) -> DataFrame:
    """(elem_id, kind, lx..hz, xs, ys, zs, vs): an element's vertices as arrays in their order, with its box."""
    rows = corners.groupBy("elem_id", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y", "z", "value"))).alias("c"))
    boxes = [F.array_min(f"c.{a}").alias(f"l{a}") for a in "xyz"] + [F.array_max(f"c.{a}").alias(f"h{a}") for a in "xyz"]
    return rows.select("elem_id", "kind", *boxes, F.col("c.x").alias("xs"), F.col("c.y").alias("ys"), F.col("c.z").alias("zs"), F.col("c.value").alias("vs"))


def compact(elements: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that elements use, numbered densely in the order of their old ids, and elements with the new ids."""
    used = elements.select(F.explode("vertex_ids").alias("vertex_id")).distinct().join(vertices.hint("merge"), "vertex_id", "left_semi")
    numbered = dense_ids(used, "vertex_id", "new_id")
    kept = by_key(vertices, numbered, "vertex_id").drop("vertex_id").withColumnRenamed("new_id", "vertex_id")
    each = elements.select("elem_id", "kind", F.posexplode("vertex_ids").alias("n", "vertex_id")).join(numbered.hint("merge"), "vertex_id")
    renamed = each.groupBy("elem_id", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "new_id"))).alias("c")).select("elem_id", "kind", F.col("c.new_id").alias("vertex_ids"))
    return kept, renamed


def distinct_vertices(points: DataFrame) -> DataFrame:
    """One vertex a position (x, y, z); of its values the smallest."""
    return points.groupBy("x", "y", "z").agg(F.min("value").alias("value"))
