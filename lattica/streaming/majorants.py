"""Majorants of macrocells as a stream: cells come, transfer functions change, and only macrocells that change are sent on."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.functions.geometry import cell_box
from lattica.operators.grid import touched

#: A change: cells that come (version null), or a transfer function (cell columns null) with its alphas and domain.
CHANGES = "x int, y int, z int, level int, value double, version long, alphas array<double>, low double, high double"
STATE = "vmin double, vmax double, version long, alphas array<double>, low double, high double, max_opacity double"
OUT = "mc_id long, version long, vmin double, vmax double, max_opacity double"
#: Macrocells that a partition of the state has at least: each costs a Python worker and a store a trigger, however few its keys are.
CELLS_A_PARTITION = 64


def largest(vmin: float, vmax: float, alphas: list[float], low: float, high: float) -> float:
    """Largest alpha that a value in [vmin, vmax] can look up; the same steps as functions.transfer.majorant."""
    last = len(alphas) - 1
    first, end = (min(last, max(0, math.floor((v - low) / (high - low) * last) + more)) for v, more in ((vmin, 0), (vmax, 1)))
    return max(alphas[first : end + 1])


class Majorants(StatefulProcessor):
    """A macrocell's range and transfer function; a row goes on when its majorant, range or its first version is new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        vmin, vmax, version, alphas, low, high, before = self.held.get() if self.held.exists() else (None, None, None, None, None, None, None)
        was = vmin, vmax
        for r in rows:
            if r.version is None:
                vmin, vmax = (r.vmin if vmin is None else min(vmin, r.vmin)), (r.vmax if vmax is None else max(vmax, r.vmax))
            elif version is None or r.version > version:  # a function that comes late is out of date
                version, alphas, low, high = r.version, list(r.alphas), r.low, r.high
        now = largest(vmin, vmax, alphas, low, high) if vmin is not None and alphas else None
        self.held.update((vmin, vmax, version, list(alphas) if alphas else None, low, high, now))
        if now is not None and (now != before or was != (vmin, vmax)):
            yield Row(mc_id=key[0], version=version, vmin=vmin, vmax=vmax, max_opacity=now)

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mc_id, vmin, vmax) of a batch, a row a macrocell: the state is a row a macrocell, and so is what reaches it from each batch."""
    for b in batches:
        found = pa.Table.from_batches([b]).group_by("mc_id").aggregate([("vmin", "min"), ("vmax", "max")])
        yield from found.select(["mc_id", "vmin_min", "vmax_max"]).rename_columns(["mc_id", "vmin", "vmax"]).to_batches()


def updates(changes: DataFrame, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int]) -> DataFrame:
    """A stream of (mc_id, version, vmin, vmax, max_opacity) from a stream of CHANGES.

    Cells go to the macrocells that they touch, half a cell wider; a transfer function goes to every macrocell, as ranges
    don't depend on it and must not be read again. State is one row a macrocell.
    """
    cells = changes.where("version IS NULL").select(*cell_box(0.5), F.col("value").alias("vmin"), F.col("value").alias("vmax"))
    ranged = touched(cells, low, high, dims).mapInArrow(_combined, "mc_id long, vmin double, vmax double")
    none = {c: F.lit(None).cast(t) for c, t in (("version", "long"), ("alphas", "array<double>"), ("low", "double"), ("high", "double"))}
    ranges = ranged.select("mc_id", "vmin", "vmax", *[v.alias(c) for c, v in none.items()])
    n = dims[0] * dims[1] * dims[2]
    functions = changes.where("version IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("mc_id"), F.lit(None).cast("double").alias("vmin"), F.lit(None).cast("double").alias("vmax"), *none)
    return ranges.unionByName(functions).groupBy("mc_id").transformWithState(statefulProcessor=Majorants(), outputStructType=OUT, outputMode="Update", timeMode="None")


def run(spark: SparkSession, path: str, folder: str, low: tuple[float, ...], high: tuple[float, ...], dims: tuple[int, int, int], files: int = 1) -> DataFrame:
    """(trigger, mc_id, version, vmin, vmax, max_opacity): what each trigger changed, of a folder of CHANGES read to its end.

    So many files a trigger, in the order in which they were written. A trigger that is run again overwrites its own files. A second run
    goes on with the files that came since: a change of many files is one trigger if the stream is run after it, with files no less.
    The state has as many partitions as its macrocells need, as many as shuffles have at most, and keeps those of the first run.
    """
    store, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before, many = spark.conf.get(store, None), spark.conf.get(parts)
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(path)

    def write(changed: DataFrame, trigger: int) -> None:
        changed.withColumn("trigger", F.lit(trigger)).write.mode("overwrite").parquet(f"{folder}/majorants/n={trigger}")

    stream = updates(changes, low, high, dims).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    try:  # a stream keeps what is set as it starts
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what this state needs
        spark.conf.set(parts, min(int(many), max(1, math.ceil(dims[0] * dims[1] * dims[2] / CELLS_A_PARTITION))))
        query = stream.start()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
        spark.conf.set(parts, many)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/majorants").drop("n")


def latest(changed: DataFrame) -> DataFrame:
    """(mc_id, vmin, vmax, max_opacity) as all triggers have left them."""
    last = changed.groupBy("mc_id").agg(F.max_by(F.struct("vmin", "vmax", "max_opacity"), "trigger").alias("l"))
    return last.select("mc_id", "l.*")
