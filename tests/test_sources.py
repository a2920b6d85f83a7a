import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import binary, layouts, records
from lattica.storage import shared_dir


def put(spark, path, data):
    binary._put(spark, path.rsplit("/", 1)[0], path.rsplit("/", 1)[1], data)


def test_cells_and_scalars_in_parts(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = rng.integers(-5, 5, (100, 4)).astype("<i4")
    values = rng.normal(size=100).astype("<f4")
    for i in range(3):  # parts of uneven length
        part = slice((0, 10, 75)[i], (10, 75, 100)[i])
        put(spark, f"{tmp_path}/c/part-{i}", cells[part].tobytes())
        put(spark, f"{tmp_path}/s/part-{i}", values[part].tobytes())
    got = binary.read_cells(spark, f"{tmp_path}/c", f"{tmp_path}/s").orderBy("cell_id").collect()
    assert [tuple(r)[:5] for r in got] == [(i, *map(int, c)) for i, c in enumerate(cells)]
    assert [r.value for r in got] == values.astype(float).tolist()
    put(spark, f"{tmp_path}/bad/x", b"123")
    with pytest.raises(ValueError):
        binary.read_scalars(spark, f"{tmp_path}/bad")


def tasks(df):
    """How many partitions have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_long_files_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "SPLIT", 1000)
    values = np.random.default_rng(2).normal(size=30_011).astype("<f4")  # a prime number of records
    for i, part in enumerate((values[:20_000], values[20_000:20_100], values[20_100:])):
        put(spark, f"{tmp_path}/s/part-{i}", part.tobytes())
    read = binary.read_scalars(spark, f"{tmp_path}/s")
    got = read.orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(values))) and [r.value for r in got] == values.astype(float).tolist()
    assert tasks(read) == 80 + 1 + 40
    assert binary.read_scalars(spark, f"{tmp_path}/s/part-1").count() == 100


def test_one_file_of_varying_records_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layouts, "WINDOW", 100)  # records cross windows, and some are longer than one
    rng = np.random.default_rng(3)
    bricks = [(*map(int, rng.integers(1, 5, 3)), *map(int, rng.integers(-9, 9, 3)), int(rng.integers(0, 3))) for _ in range(211)]
    bricks[100] = (20, 20, 9, 1, 2, 3, 0)
    ids = [np.arange(sx * sy * sz) * 7 + i for i, (sx, sy, sz, *_) in enumerate(bricks)]
    one = b"".join(struct.pack("<7i", *b) + x.astype("<i4").tobytes() for b, x in zip(bricks, ids))
    put(spark, f"{tmp_path}/one.bricks", one)
    want = [(i, *b, x.tolist()) for i, (b, x) in enumerate(zip(bricks, ids))]
    for split in (1, 900, 1 << 26):
        monkeypatch.setattr(records, "SPLIT", split)
        read = binary.read_bricks(spark, f"{tmp_path}/one.bricks")
        got = read.orderBy("n").select("n", "sx", "sy", "sz", "lx", "ly", "lz", "level", "ids").collect()
        assert [tuple(r) for r in got] == want
        assert tasks(read) == {1: 211, 1 << 26: 1}.get(split, tasks(read))
        assert split != 900 or tasks(read) > 20
    put(spark, f"{tmp_path}/cut.bricks", one[:-3])
    with pytest.raises(Exception, match="beyond the end"):
        binary.read_bricks(spark, f"{tmp_path}/cut.bricks")
    put(spark, f"{tmp_path}/endless.bricks", struct.pack("<7i", -7, 1, 1, 0, 0, 0, 0) * 2)
    with pytest.raises(Exception, match="a record of 0 bytes"):
        binary.read_bricks(spark, f"{tmp_path}/endless.bricks")


def test_parts_are_written_by_tasks_and_renamed_on_commit(spark, tmp_path):
    cells = spark.range(0, 5000, 1, 7).select(F.pmod(F.col("id") * 2654435761, F.lit(5003)).alias("cell_id"), *[(F.col("id") % (k + 5)).cast("int").alias(a) for k, a in enumerate("xyz")], F.lit(0).alias("level"))
    assert records.write(cells, f"{tmp_path}/cells", "cells", ["cell_id"], ".cells", parts=6) == 5000
    names = sorted(p.name for p in (tmp_path / "cells").iterdir())
    assert names == ["_records.cells", *[f"part-{i:06d}.cells" for i in range(6)]]
    want = [tuple(r) for r in cells.orderBy("cell_id").select("x", "y", "z").collect()]
    assert [tuple(r) for r in binary.read_cells(spark, f"{tmp_path}/cells").orderBy("cell_id").select("x", "y", "z").collect()] == want
    # written again, with fewer rows: no old part stays
    assert binary.write_cells(cells.where("cell_id < 10"), f"{tmp_path}/cells") == binary.read_cells(spark, f"{tmp_path}/cells").count()
    assert binary.write_cells(cells.where("cell_id < 0"), f"{tmp_path}/none") == 0 and binary.read_cells(spark, f"{tmp_path}/none").count() == 0


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    # the last of four parts can't be written; the others are, under names of their own
    bad = spark.range(1000).select(F.col("id").alias("idx"), F.when(F.col("id") != 990, 0.5).alias("value"))
    with pytest.raises(Exception, match="a null value can't be written"):
        records.write(bad, f"{tmp_path}/s", "scalars", ["idx"], ".scalars", parts=4)
    assert [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")] == []


def test_leaf_counts(spark, tmp_path):
    domains = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 1.0, 1.0, float(i + 1), 0.5) for i in range(6)], "domain_id long, lx double, ly double, lz double, hx double, hy double, hz double, majorant double")
    assert binary.write_leaf_counts({6: domains, 2: domains.where("domain_id < 2")}, f"{tmp_path}/leaves") == {2: 2, 6: 6}
    assert binary.read_domains(spark, f"{tmp_path}/leaves.n2").count() == 2


def test_gridlets_and_bricks(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 0, 0, 1, 2, 3, 1, 1, 1, [0, 1, 2, None, 4, 5, 6, 99])], "level int, mx int, my int, mz int, lx int, ly int, lz int, dx int, dy int, dz int, ids array<int>")
    binary.write_gridlets(g, f"{tmp_path}/g")
    read = binary.read_gridlets(spark, f"{tmp_path}/g")
    r = read.first()
    assert (r.lx, r.ly, r.lz, r.dx, r.level, list(r.ids)) == (1, 2, 3, 1, 0, [0, 1, 2, None, 4, 5, 6, 99])
    scalars = spark.range(10).select(F.col("id").alias("idx"), (F.col("id") * 0.5).alias("value"))
    assert list(binary.with_scalars(read, scalars, ["file", "n"]).first().scalars) == [0.0, 0.5, 1.0, None, 2.0, 2.5, 3.0, None]
    b = spark.createDataFrame([(i, i, 0, 0, 2, 1, 1, 0, [2 * i, 2 * i + 1]) for i in range(5)], "brick_id long, lx int, ly int, lz int, sx int, sy int, sz int, level int, ids array<int>")
    binary.write_bricks(b, f"{tmp_path}/b")
    assert [(x.n, x.lx, list(x.ids)) for x in binary.read_bricks(spark, f"{tmp_path}/b").orderBy("n").collect()] == [(i, i, [2 * i, 2 * i + 1]) for i in range(5)]


def test_cubes_by_level(spark, tmp_path):
    c = spark.createDataFrame([(l, i, 0, 0, [i] * 8) for l in (0, 2) for i in range(3)], "level int, ix int, iy int, iz int, ids array<int>")
    assert binary.write_cubes(c, str(tmp_path)) == {0: 3, 2: 3}
    got = binary.read_cubes(spark, str(tmp_path)).collect()
    assert all(r.file_level == r.level for r in got)
    assert sorted((r.level, r.lx) for r in got) == [(0, 0.5), (0, 1.5), (0, 2.5), (2, 2.0), (2, 6.0), (2, 10.0)]


def test_domains_trees_and_triangles(spark, tmp_path):
    d = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.5), (1, 1.0, 0.0, 0.0, 2.0, 1.0, 1.0, 0.25)], "domain_id long, lx double, ly double, lz double, hx double, hy double, hz double, majorant double")
    binary.write_domains(d, f"{tmp_path}/d")
    assert sorted(map(tuple, binary.read_domains(spark, f"{tmp_path}/d").collect())) == sorted(map(tuple, d.collect()))
    put(spark, f"{tmp_path}/k/tree", np.array([(1, 2, 3), (4, 5, -6)], layouts.NODE).tobytes())
    assert [tuple(r) for r in binary.read_tree(spark, f"{tmp_path}/k").collect()] == [(0, 1, 2, 3), (1, 4, 5, -6)]
    t = spark.createDataFrame([(m, i, [0.0, 0.0, float(i)], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]) for m in (0, 1) for i in range(2)], "mesh_id long, tri_id long, v1 array<double>, v2 array<double>, v3 array<double>")
    binary.write_triangles(t, f"{tmp_path}/t")
    assert sorted(map(str, binary.read_triangles(spark, f"{tmp_path}/t").collect())) == sorted(map(str, t.collect()))
    put(spark, f"{tmp_path}/broken/x", np.array([1], "<i4").tobytes() + np.zeros(3, "<f4").tobytes() + np.array([1, 0, 0, 7], "<i4").tobytes())
    with pytest.raises(Exception, match="no such vertex"):
        binary.read_triangles(spark, f"{tmp_path}/broken").collect()


def test_transfer_functions(spark, tmp_path):
    tf = {"opacity_scale": 100.0, "absolute": (0.0, 2.0), "relative": (0.0, 100.0), "entries": [(0.0, 0.5, 1.0, 0.25), (1.0, 1.0, 1.0, 1.0)]}
    put(spark, f"{tmp_path}/tf.xf", binary.transfer_function_bytes(tf))
    assert binary.read_transfer_function(spark, f"{tmp_path}/tf.xf") == tf
    put(spark, f"{tmp_path}/bad.xf", b"\0" * 40)
    with pytest.raises(ValueError):
        binary.read_transfer_function(spark, f"{tmp_path}/bad.xf")


def test_mesh(spark):
    e = spark.createDataFrame([(0, "tet", [0, 1, 2, 3]), (1, "hex", list(range(8)))], "elem_id long, kind string, vertex_ids array<long>")
    v = spark.createDataFrame([(i, float(i), 0.0, 0.0, 1.0) for i in range(8)], "vertex_id long, x double, y double, z double, value double")
    at = shared_dir(spark)
    binary.write_mesh(e, v, at)
    e2, v2 = binary.read_mesh(spark, at)
    assert sorted(map(str, e2.collect())) == sorted(map(str, e.collect())) and v2.count() == 8
