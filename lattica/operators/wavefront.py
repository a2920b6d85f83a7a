"""Rays marched in fronts: each round takes the next segments of rays that are still transparent, and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.geometry import AXES
from lattica.operators.joins import by_key
from lattica.operators.rays import OPAQUE, steps
from lattica.storage import materialise

#: Segments of a ray in the first round; each round takes twice as many as the one before.
FIRST = 4


def march(rays: DataFrame, segments: DataFrame, sample: Callable[[DataFrame], DataFrame], colour: Callable[[Column], dict[str, Column]], dt: float, colours: tuple[str, ...] = ("r", "g", "b"), first: int = FIRST) -> DataFrame:
    """(ray_id, colours, alpha) of rays (ray_id, o*, d*) along segments (ray_id, t0, t1) that don't overlap.

    sample gives (pid, value) at points (pid, px, py, pz); colour gives the colours and a, the opacity of a step, for a
    value. Samples stand at multiples of dt in each segment and are composited front to back; those behind an alpha of OPAQUE
    or more don't count, and a ray that has come so far is dropped before anything further on it is sampled. Rays
    without a sample have no row.

    Rounds grow with the logarithm of the segments of a ray. A ray's state is one row: its colours, its alpha and the
    logarithm of what it still lets through.
    """
    order = Window.partitionBy("ray_id").orderBy("t0")
    queue = materialise(segments.select("ray_id", "t0", "t1").withColumn("n", F.row_number().over(order) - 1))
    lines = rays.select("ray_id", *[f"{e}{a}" for e in "od" for a in AXES])
    sums = [*colours, "alpha"]
    last = queue.groupBy("ray_id").agg(F.max("n").alias("last"))
    state = materialise(last.select("ray_id", "last", *[F.lit(0.0).alias(c) for c in sums], F.lit(0.0).alias("clear"), F.lit(0).cast("long").alias("samples")))
    low, width = 0, first
    done: list[DataFrame] = []
    while True:
        live = state.where((F.col("last") >= low) & (1 - F.exp("clear") < OPAQUE))
        if not live.take(1):
            break
        done.append(state.where((F.col("last") < low) | (1 - F.exp("clear") >= OPAQUE)))
        now = by_key(queue.where((F.col("n") >= low) & (F.col("n") < low + width)), live.select("ray_id", "clear"), "ray_id")
        at = by_key(steps(now, dt), lines, "ray_id")
        points = at.select(F.struct("ray_id", "t", "clear").alias("pid"), *[(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"p{a}") for a in AXES])
        met = sample(points)
        shade = colour(F.col("value"))
        lit = met.select("pid.ray_id", "pid.t", "pid.clear", *[shade[c].alias(c) for c in (*colours, "a")])
        before = Window.partitionBy("ray_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        step = F.when(F.col("a") < 1, F.log(1 - F.col("a"))).otherwise(F.lit(-1e3))
        through = lit.withColumn("_step", step).withColumn("_clear", F.exp(F.col("clear") + F.coalesce(F.sum("_step").over(before), F.lit(0.0))))
        seen = through.where(1 - F.col("_clear") < OPAQUE)
        more = seen.groupBy("ray_id").agg(*[F.sum(F.col("_clear") * F.col("a") * F.col(c)).alias(f"_{c}") for c in colours], F.sum(F.col("_clear") * F.col("a")).alias("_alpha"), F.sum("_step").alias("_more"), F.count(F.lit(1)).alias("_n"))
        joined = by_key(live, more, "ray_id", "left")
        state = materialise(joined.select("ray_id", "last", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in sums], (F.col("clear") + F.coalesce("_more", F.lit(0.0))).alias("clear"), (F.col("samples") + F.coalesce("_n", F.lit(0))).alias("samples")))
        low, width = low + width, 2 * width
    out = state
    for part in done:
        out = out.unionByName(part)
    return out.where("samples > 0").select("ray_id", *sums)
