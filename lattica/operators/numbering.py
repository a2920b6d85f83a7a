"""Dense numbers in key order, and running sums, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.storage import materialise


def _ranged(df: DataFrame, by: list[str], ranges: int | None) -> DataFrame:
    """df, written in ranges between sampled quantiles, with each row's range and place in it.

    Keys may lie as unevenly as they like; rows that agree in all of these columns stand in any order, and rows that agree in the
    first may be cut by the next. There are as many ranges as shuffle partitions, or the number given.
    """
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
    return materialise(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def _before(written: DataFrame, weight: Column) -> DataFrame:
    """(_range, _before): what the earlier ranges weigh; a row a range, so it can be broadcast."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = written.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    return F.broadcast(sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))


def ordinal(df: DataFrame, by: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """Numbers from 0 in the order of any columns, as a long column.

    A range is written with each row's place in it, and the sizes of earlier ranges are added.
    """
    written = _ranged(df, by, ranges)
    return written.join(_before(written, F.lit(1)), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def dense_ids(df: DataFrame, key: str, name: str, ties: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Numbers from 0 in order of a key (then of ties), as a long column."""
    return ordinal(df, [key, *(ties or [])], name, ranges)


def running_sum(df: DataFrame, key: str, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Sum of value over all rows up to this one, in order of a unique key: within a range, and what the earlier ones add up to."""
    written = _ranged(df, [key], ranges)
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = written.withColumn("_own", F.sum(value).over(inside))
    return summed.join(_before(written, F.col(value)), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_at", "_own", "_before")


def run_lengths(df: DataFrame, key: str, value: str, ranges: int | None = None) -> DataFrame:
    """(run, value, n): runs of equal values in order of a unique key, numbered from 0.

    Within a range a run starts where the value changes; across ranges each first row is held against the last row of the
    nearest earlier range that has rows, which is one row a range.
    """
    written = _ranged(df.select(key, value), [key], ranges)
    inside = Window.partitionBy("_range").orderBy("_at")
    ends = written.groupBy("_range").agg(F.max_by(F.struct(F.col(value).alias("v")), "_at").alias("_last"))
    last = F.broadcast(ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_earlier")))
    placed = written.withColumn("_previous", F.lag(F.struct(F.col(value).alias("v"))).over(inside)).join(last, "_range")
    previous = F.coalesce("_previous", "_earlier")
    marked = placed.withColumn("_new", F.when(previous.isNull() | ~F.col(value).eqNullSafe(previous["v"]), 1).otherwise(0)).drop("_previous", "_earlier")
    started = marked.withColumn("_own", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = started.join(_before(marked, F.col("_new")), "_range").withColumn("_run", F.col("_before") + F.col("_own"))
    return runs.groupBy((F.col("_run") - 1).cast("long").alias("run"), value).agg(F.count(F.lit(1)).alias("n"))
