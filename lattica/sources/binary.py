"""Binary files of volumes and meshes: readers that give DataFrames and writers of the same layouts.

Values are little-endian, without headers unless said. Reading by ranges and writing in parts is the data source of
`records`; file systems that Spark alone knows are read whole files at a time. A data set is a file or a folder of part
files in name order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources import records
from lattica.sources.layouts import BRICK_HEAD, GRIDLET_HEAD, LAYOUTS

#: What begins a transfer-function file. A fixed value.
TRANSFER_MAGIC = 0x1235ABC000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of a data set; where Arrow doesn't know the file system, files of up to 2 GB, a task each."""
    if records.knows(path):
        return records.read(spark, path, kind)
    layout = LAYOUTS[kind]
    listed = _files(spark, path).select("path", "length").orderBy("path").collect()  # names and sizes only
    before, starts = 0, []
    for r in listed:
        starts.append((r["path"], before))
        before += (r["length"] - layout.head) // layout.record if layout.record and layout.one_number else 0
    schema = records.pa_schema(layout.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name, first in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if len(content) > layout.head:
                    columns = layout.decode(content[layout.head :], name, first)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)

    offsets = F.broadcast(spark.createDataFrame(starts, "path string, first long"))
    return _files(spark, path).join(offsets, "path").select("content", "path", "first").mapInArrow(run, layout.schema)


def read_scalars(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value) of a float array."""
    return _read(spark, path, "scalars")


def read_cells(spark: SparkSession, cells: str, scalars: str | None = None) -> DataFrame:
    """Cells (cell_id, x, y, z, level[, value]): the id is the place in the data set, and finds the scalar."""
    found = _read(spark, cells, "cells")
    if scalars is None:
        return found
    return found.join(read_scalars(spark, scalars).withColumnRenamed("idx", "cell_id"), "cell_id")


def read_bricks(spark: SparkSession, path: str) -> DataFrame:
    """Bricks (file, n, l*, s*, level, ids): size, lower, level and the ids of their cells, x fastest; n counts in the file."""
    return _read(spark, path, "bricks")


def read_gridlets(spark: SparkSession, path: str) -> DataFrame:
    """Gridlets (file, n, l*, d*, level, ids): ids of (d + 1)^3 vertices; null where a vertex is empty."""
    return _read(spark, path, "gridlets")


def with_scalars(rows: DataFrame, scalars: DataFrame, key: list[str]) -> DataFrame:
    """rows with scalars for their ids, by a left join: an id without a scalar is an empty place, and null."""
    each = rows.select(*key, F.posexplode("ids").alias("_p", "idx")).join(scalars, "idx", "left")
    values = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_p", "value"))).alias("_v"))
    return rows.join(values, key).withColumn("scalars", F.col("_v.value")).drop("_v")


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Cubes (file_level, level, l*, ids); file_level is the number before .cubes in the file's name."""
    return _read(spark, path, "cubes")


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Majorant domains: files begin with a 64-bit count, then come boxes with their majorants."""
    return _read(spark, path, "domains")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Nodes (idx, split, bits, max_level) of a k-d tree, 12 bytes each."""
    return _read(spark, path, "tree")


def read_triangles(spark: SparkSession, path: str) -> DataFrame:
    """Triangles (mesh_id, tri_id, v1, v2, v3) of all meshes; an index without a vertex is an error. A mesh is one record."""
    return _read(spark, path, "triangles")


def read_transfer_function(spark: SparkSession, path: str) -> dict:
    """A transfer function: opacity_scale, absolute and relative (percent) domain, entries. Small, so read whole."""
    data = bytes(_files(spark, path).select("content").first()[0])
    magic, scale, a0, a1, r0, r1, n = struct.unpack_from("<Q5fi", data)
    if magic != TRANSFER_MAGIC:
        raise ValueError(f"{path}: not a transfer function")
    entries = np.frombuffer(data, "<f4", 4 * n, 32).reshape(n, 4).astype(float)
    return {"opacity_scale": scale, "absolute": (a0, a1), "relative": (r0, r1), "entries": [tuple(e) for e in entries.tolist()]}


def transfer_function_bytes(tf: dict) -> bytes:
    e = np.asarray(tf["entries"], "<f4")
    return struct.pack("<Q5fi", TRANSFER_MAGIC, tf["opacity_scale"], *tf["absolute"], *tf["relative"], len(e)) + e.tobytes()


def _put(spark: SparkSession, path: str, name: str, data: bytes) -> None:
    """Write a part through Hadoop's file system, so that any store will do."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_cells(cells: DataFrame, path: str) -> int:
    return records.write(cells.select("cell_id", "x", "y", "z", "level"), path, "cells", ["cell_id"], ".cells")


def write_scalars(scalars: DataFrame, path: str) -> int:
    return records.write(scalars.select("idx", "value"), path, "scalars", ["idx"], ".scalars")


def write_bricks(bricks: DataFrame, path: str) -> int:
    return records.write(bricks.select("brick_id", *BRICK_HEAD, "ids"), path, "bricks", ["brick_id"], ".bricks")


def write_gridlets(gridlets: DataFrame, path: str) -> int:
    return records.write(gridlets.select("mx", "my", "mz", *GRIDLET_HEAD, "ids"), path, "gridlets", ["level", "mx", "my", "mz"], ".grids")


def write_cubes(cubes: DataFrame, path: str) -> dict[int, int]:
    """Parts a level, with the level in the files' names; lower is the centre of the first cell."""
    slim = cubes.select("level", "ix", "iy", "iz", "ids")
    levels = sorted(r[0] for r in slim.select("level").distinct().collect())  # some twenty at most
    return {k: records.write(slim.where(F.col("level") == k), path, "cubes", ["iz", "iy", "ix"], f"_{k}.cubes") for k in levels}


def write_domains(domains: DataFrame, path: str) -> int:
    """Majorant domains; each part begins with its count."""
    return records.write(domains.select("domain_id", *[f"{e}{a}" for e in "lh" for a in "xyz"], "majorant"), path, "domains", ["domain_id"], ".majorants")


def write_leaf_counts(trees: dict[int, DataFrame], path: str) -> dict[int, int]:
    """Majorant domains of a tree at several numbers of leaves: a folder for each number, named .n and the number."""
    return {n: write_domains(domains, f"{path}.n{n}") for n, domains in sorted(trees.items())}


def write_triangles(triangles: DataFrame, path: str) -> int:
    """Meshes in order, each in one part, three vertices a triangle; meshes are counted first, so a task streams them."""
    counts = triangles.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_n"))
    counted = triangles.select("mesh_id", "tri_id", "v1", "v2", "v3").join(counts, "mesh_id")
    return records.write(counted, path, "triangles", ["mesh_id", "tri_id"], ".tris", whole=["mesh_id"])


def write_mesh(elements: DataFrame, vertices: DataFrame, path: str) -> None:
    """An unstructured mesh in this library's own layout: Parquet, elements in a folder a kind."""
    elements.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/elements")
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    elements = spark.read.parquet(f"{path}/elements").select("elem_id", "kind", "vertex_ids")
    return elements, spark.read.parquet(f"{path}/vertices")


def box_faces(boxes: DataFrame, key: str) -> DataFrame:
    """(key, face, corners): six quads a box, for a look at it in another program."""
    corner = lambda k: F.array(*[F.col(f"{'h' if k >> i & 1 else 'l'}{a}") for i, a in enumerate("xyz")])
    quads = F.array(*[F.array(*[corner(k) for k in face]) for face in ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))])
    return boxes.select(key, F.posexplode(quads).alias("face", "corners"))
