"""Progressive accumulation of frames, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulated(frames: DataFrame, *, samples_per_pixel: int = 1) -> DataFrame:
    """(epoch, pixel, frames, mean): the running image of each epoch from (epoch, pixel, value).

    A parameter change starts a new epoch, which is a grouping key: nothing is reset. On a stream this is a stateful
    aggregate of two numbers a pixel and epoch, to be written in update mode.
    """
    summed = frames.groupBy("epoch", "pixel").agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("frames"))
    return summed.select("epoch", "pixel", "frames", (F.col("_sum") / (F.col("frames") * samples_per_pixel)).alias("mean"))


def windowed(frames: DataFrame, *, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """The same by event time (ts): windows that the watermark has passed are final, and their state goes."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    summed = timed.groupBy(F.window("ts", every).alias("w"), "pixel").agg(F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("frames"))
    return summed.select(F.col("w.start").alias("start"), "pixel", "frames", (F.col("_sum") / F.col("frames")).alias("mean"))


def stream(spark, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Frames from a folder of Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def start(accumulating: DataFrame, name: str, checkpoint: str, mode: str = "update"):
    """Run to the end of what is there, into an in-memory table."""
    return accumulating.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark, path: str, schema: str, folder: str) -> DataFrame:
    """The running images (see accumulated) of a folder of frames, streamed to the end of what is there.

    Every trigger writes the pixels it changed, with its number, below folder; what is returned is each pixel's latest. A
    trigger that is run again after a failure overwrites its own files.
    """

    def write(changed: DataFrame, trigger: int) -> None:
        changed.withColumn("trigger", F.lit(trigger)).write.mode("overwrite").parquet(f"{folder}/images/n={trigger}")

    images = accumulated(stream(spark, path, schema))
    images.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/images").groupBy("epoch", "pixel").agg(F.max(F.struct("trigger", "frames", "mean")).alias("l"))
    return last.select("epoch", "pixel", "l.frames", "l.mean")
