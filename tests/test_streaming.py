import time

from pyspark.sql import functions as F

from lattica.operators import grid
from lattica.streaming import accumulate, majorants

SCHEMA = "epoch long, pixel long, value double, ts timestamp"


def test_accumulation_of_a_stream_equals_batch(spark, tmp_path):
    for k in range(4):
        rows = spark.range(20).selectExpr(f"CAST({k} DIV 2 AS LONG) AS epoch", "id % 5 AS pixel", f"CAST(id * {k + 1} AS DOUBLE) AS value", f"timestamp'2024-01-0{k + 1} 10:00:00' AS ts")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = accumulate.start(accumulate.accumulated(accumulate.stream(spark, f"{tmp_path}/in", SCHEMA)), "seen", f"{tmp_path}/state", "complete")
    query.awaitTermination()
    want = accumulate.accumulated(spark.read.parquet(f"{tmp_path}/in")).collect()
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, want))
    assert len(want) == 10


def test_windows_close_behind_the_watermark(spark, tmp_path):
    for k in range(4):
        spark.range(5).selectExpr("0L AS epoch", "id AS pixel", "1.0D AS value", f"timestamp'2024-01-0{k + 1} 10:00:00' AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = accumulate.start(accumulate.windowed(accumulate.stream(spark, f"{tmp_path}/in", SCHEMA)), "closed", f"{tmp_path}/state", "append")
    query.awaitTermination()
    days = {str(r.start)[:10] for r in spark.table("closed").collect()}
    assert days == {"2024-01-01", "2024-01-02", "2024-01-03"}


def test_a_stream_of_changes_equals_the_batch_after_each(spark, tmp_path):
    low, high, dims = (0.0,) * 3, (16.0,) * 3, (4, 4, 4)
    cells = spark.range(400).select(*[((F.col("id") * k) % 16).cast("int").alias(a) for a, k in zip("xyz", (1, 3, 7))], F.lit(0).alias("level"), ((F.col("id") % 10) / 10).alias("value"))
    cells = cells.unionByName(spark.createDataFrame([(0, 0, 0, 0, float("nan")), (1, 1, 1, 0, None)], cells.schema))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("version", "long"), ("alphas", "array<double>"), ("low", "double"), ("high", "double"))]
    alphas = {1: [0.0, 0.0, 0.5, 1.0], 2: [0.1, 0.2, 0.5, 1.0], 0: [1.0, 1.0]}
    function = lambda v: spark.createDataFrame([(None, None, None, None, None, v, alphas[v], 0.0, 1.0)], majorants.CHANGES)
    parts = [("cells", "x < 5"), ("function", 1), ("cells", "x >= 5"), ("function", 2), ("function", 0)]  # the last comes late
    for kind, what in parts:
        (cells.where(what).select("*", *none) if kind == "cells" else function(what)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        time.sleep(1.1)  # files are read by their time
    changed = majorants.run(spark, f"{tmp_path}/changes", str(tmp_path), low, high, dims)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    held: dict[int, tuple] = {}
    seen, version = None, None
    rows = changed.collect()
    for trigger, (kind, what) in enumerate(parts):
        own = {r.mc_id: (r.vmin, r.vmax, r.max_opacity) for r in rows if r.trigger == trigger}
        assert all(held.get(m) != v for m, v in own.items())  # only what changed
        held |= own
        if kind == "cells":
            seen = cells.where(what) if seen is None else seen.unionByName(cells.where(what))
        else:
            version = max(what, version or 0)
        if version:
            batch = grid.with_majorants(grid.cell_ranges(seen, low, high, dims), [(0, 0, 0, a) for a in alphas[version]], 0.0, 1.0)
            assert held == {r.mc_id: (r.vmin, r.vmax, r.max_opacity) for r in batch.collect()}
    assert {r.mc_id: (r.vmin, r.vmax, r.max_opacity) for r in majorants.latest(changed).collect()} == held
    assert len(held) > 40 and not [r for r in rows if r.trigger == 4]


def test_a_change_of_many_files_is_one_trigger(spark, tmp_path):
    """Triggers and the state's partitions depend on changes and macrocells, not on files or on the partitions that shuffles have."""
    low, high, dims = (0.0,) * 3, (16.0,) * 3, (4, 4, 4)
    cells = spark.range(200).select(*[((F.col("id") * k) % 16).cast("int").alias(a) for a, k in zip("xyz", (1, 3, 7))], F.lit(0).alias("level"), ((F.col("id") % 10) / 10).alias("value"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("version", "long"), ("alphas", "array<double>"), ("low", "double"), ("high", "double"))]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for change in (cells.select("*", *none).repartition(6), spark.createDataFrame([(None, None, None, None, None, 1, [0.1, 0.5, 1.0], 0.0, 1.0)], majorants.CHANGES)):
        change.write.mode("append").parquet(f"{tmp_path}/changes")
        changed = majorants.run(spark, f"{tmp_path}/changes", str(tmp_path), low, high, dims, files=100)
    assert len(list((tmp_path / "changes").glob("*.parquet"))) >= 7 and len(list((tmp_path / "progress/commits").glob("[0-9]*"))) == 2
    assert len(list((tmp_path / "progress/state/0").glob("[0-9]*"))) == 1 < int(parts) and spark.conf.get("spark.sql.shuffle.partitions") == parts
    batch = grid.with_majorants(grid.cell_ranges(cells, low, high, dims), [(0, 0, 0, a) for a in (0.1, 0.5, 1.0)], 0.0, 1.0)
    assert sorted(tuple(r) for r in majorants.latest(changed).collect()) == sorted((r.mc_id, r.vmin, r.vmax, r.max_opacity) for r in batch.collect())
