"""Stochastic transport: free paths, transmittance and scattering, with random numbers from hashes.

A tentative collision is a point of a Poisson process whose rate in each macrocell is its majorant; it is real with the
probability of the field's extinction over the majorant. So all tentative collisions of all rays are made at once, one
join samples the field at them, and an aggregate finds each ray's first real one. The same seed gives the same numbers
in any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.columns import once
from lattica.operators.fields import Lattice, sample_cells
from lattica.operators.grid import walk
from lattica.operators.joins import by_key
from lattica.storage import materialise


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1) for a key."""
    h = F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in key])
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def tentative(rays: DataFrame, majorants: DataFrame, low, high, dims, scale: float, seed: int) -> DataFrame:
    """(ray_id, mc_id, k, t, mu): the Poisson process along each ray; mu = scale * max_opacity of the macrocell.

    How many points a segment has is drawn by adding up exponential steps until they pass its mean, a running sum of two
    numbers; the points themselves are then uniform in the segment. Most segments have none or one, so two steps are plain
    columns, and only what they don't pass goes on in a running sum, which Spark interprets step by step.
    """
    seg = by_key(walk(rays, low, high, dims), majorants.where("max_opacity > 0").select("mc_id", (F.col("max_opacity") * scale).alias("mu")), "mc_id")
    mean = F.col("mu") * (F.col("t1") - F.col("t0"))
    seg = once(seg, _mean=mean)
    # far more steps than a segment can have: eight deviations above the mean
    most = F.ceil(F.col("_mean") + 8 * F.sqrt("_mean") + 12).cast("int")
    step = lambda k: F.log(uniform("ray_id", "mc_id", k, F.lit(seed)))

    def add(state: Column, k: Column) -> Column:
        far = state["sum"] - step(k)
        return F.struct(far.alias("sum"), (state["n"] + (far < F.col("_mean")).cast("int")).alias("n"))

    seg = once(seg, _far=-step(F.lit(1))).where("_far < _mean")
    seg = once(seg, _next=F.col("_far") - step(F.lit(2)))
    more = F.aggregate(F.sequence(F.lit(3), most), F.struct(F.col("_next").alias("sum"), F.lit(2).alias("n")), add, lambda s: s["n"])
    seg = once(seg, _n=F.when(F.col("_next") < F.col("_mean"), more).otherwise(F.lit(1)))
    each = seg.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.col("t0") + (F.col("t1") - F.col("t0")) * uniform("ray_id", "mc_id", "k", F.lit(seed), F.lit("place"))
    return each.select("ray_id", "mc_id", "k", at.alias("t"), "mu")


def with_extinction(collisions: DataFrame, rays: DataFrame, cells: DataFrame | Lattice | Callable[[DataFrame], DataFrame], alpha: Callable[[Column], Column], scale: float) -> DataFrame:
    """Collisions with sigma, the field's extinction there (0 where there is no field); cells may be any way to sample points.

    Collisions are asked for twice, so they are written first: the walk is done once, and is no part of the plan of what follows.
    """
    collisions = materialise(collisions)
    at = by_key(collisions, rays.select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz"), "ray_id")
    points = at.select(F.struct("ray_id", "mc_id", "k").alias("pid"), *[(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"p{a}") for a in "xyz"])
    found = (cells(points) if callable(cells) else sample_cells(points, cells)).select("pid.ray_id", "pid.mc_id", "pid.k", (alpha(F.col("value")) * scale).alias("sigma"), "value")
    return by_key(collisions, found, ["ray_id", "mc_id", "k"], "left").withColumn("sigma", F.coalesce("sigma", F.lit(0.0)))


def free_paths(collisions: DataFrame, seed: int) -> DataFrame:
    """(ray_id, t, value) of each ray's first real collision; rays that pass have no row."""
    real = collisions.where(uniform("ray_id", "mc_id", "k", F.lit(seed + 1)) * F.col("mu") < F.col("sigma"))
    return real.groupBy("ray_id").agg(F.min(F.struct("t", "value")).alias("h")).select("ray_id", "h.t", "h.value")


def transmittance(rays: DataFrame, collisions: DataFrame) -> DataFrame:
    """(ray_id, transmittance) by ratio tracking: the product of 1 - sigma / mu over the tentative collisions."""
    kept = F.greatest(F.lit(0.0), 1 - F.col("sigma") / F.col("mu"))
    product = collisions.groupBy("ray_id").agg(F.sum(F.when(kept > 0, F.log(kept)).otherwise(F.lit(-1e3))).alias("_l"))
    return by_key(rays.select("ray_id"), product, "ray_id", "left").select("ray_id", F.exp(F.coalesce("_l", F.lit(0.0))).alias("transmittance"))


def phase_direction(u: Column, v: Column, along: list[Column], g: float = 0.0) -> list[Column]:
    """A direction of the Henyey-Greenstein phase function around a unit vector; g = 0 is every direction alike."""
    if abs(g) < 1e-3:
        cosine = 1 - 2 * u
    else:
        s = (1 - g * g) / (1 - g + 2 * g * u)
        cosine = (1 + g * g - s * s) / (2 * g)
    return _around(along, cosine, v)


def diffuse_direction(u: Column, v: Column, normal: list[Column]) -> list[Column]:
    """A direction around a normal with density in proportion to its cosine."""
    return _around(normal, F.sqrt(1 - u), v)


def _around(axis: list[Column], cosine: Column, v: Column) -> list[Column]:
    """The direction at an angle to an axis, turned by v of a whole turn, in an orthonormal basis without a branch at the poles."""
    x, y, z = axis
    sign = F.when(z >= 0, 1.0).otherwise(-1.0)
    a = -1 / (sign + z)
    b = x * y * a
    t = [1 + sign * x * x * a, sign * b, -sign * x]
    s = [b, sign + y * y * a, -y]
    sine = F.sqrt(F.greatest(F.lit(0.0), 1 - cosine * cosine))
    turn = v * 6.283185307179586
    return [F.cos(turn) * sine * p + F.sin(turn) * sine * q + cosine * r for p, q, r in zip(t, s, axis)]


def light_rays(points: DataFrame, light: tuple[float, float, float] | list[tuple[float, float, float, float]], seed: int = 0) -> DataFrame:
    """Rays from (ray_id, px, py, pz) to a point light, t in lengths up to the light, with its falloff: intensity / distance^2.

    light is a place, or a list of places with intensities: each point then asks one of them, drawn evenly.
    """
    lights = [(*light, 1.0)] if isinstance(light, tuple) else list(light)
    places = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x", "y", "z", "intensity"), one)]) for one in lights])
    drawn = F.floor(uniform("ray_id", F.lit(seed), F.lit("light")) * len(lights)).cast("int")
    points = points.withColumn("_light", F.get(places, drawn))
    d = [F.col(f"_light.{a}") - F.col(f"p{a}") for a in "xyz"]
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return points.withColumn("_far", far).where("_far > 0").select("ray_id", *[F.col(f"p{a}").alias(f"o{a}") for a in "xyz"], *[(x / F.col("_far")).alias(f"d{a}") for a, x in zip("xyz", d)], F.lit(0.0).alias("tmin"), F.col("_far").alias("tmax"), (F.col("_light.intensity") / (F.col("_far") * F.col("_far"))).alias("falloff"))


def trace(rays: DataFrame, cells: DataFrame | Callable[[DataFrame], DataFrame], majorants: DataFrame, alpha: Callable[[Column], Column], low, high, dims, *, scale: float = 1.0, light: tuple[float, float, float] | list[tuple[float, float, float, float]], bounces: int = 1024, roulette: float = 0.2, albedo: float = 0.8, seed: int = 1) -> DataFrame:
    """(ray_id, radiance) of rays with unit directions: light from points (see light_rays), scattered until no path is left; 1 bounce is direct lighting.

    A bounce finds free paths, adds the light that reaches the collisions through the volume, and goes on in a new
    direction; a path of throughput below roulette survives with that probability, which ends all paths: bounces is
    only a guard. Each bounce and its light are written, and the light is summed up now and then, so plans don't grow.
    """
    lattice, majorants = cells if callable(cells) else Lattice.of(cells), materialise(majorants)
    paths = rays.withColumn("weight", F.lit(1.0))
    gathered: list[DataFrame] = []

    def total() -> DataFrame:
        return reduce(DataFrame.unionByName, gathered).groupBy("ray_id").agg(F.sum("light").alias("light"))

    for bounce in range(bounces):
        own = seed + 10 * bounce
        hits = with_extinction(tentative(paths, majorants, low, high, dims, scale, own), paths, lattice, alpha, scale)
        met = materialise(by_key(free_paths(hits, own), paths, "ray_id").select("ray_id", "weight", *[(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"p{a}") for a in "xyz"], "dx", "dy", "dz"))
        shadow = materialise(light_rays(met, light, own + 4))
        through = transmittance(shadow, with_extinction(tentative(shadow, majorants, low, high, dims, scale, own + 3), shadow, lattice, alpha, scale))
        lit = by_key(by_key(met, through, "ray_id"), shadow.select("ray_id", "falloff"), "ray_id").select("ray_id", (F.col("weight") * albedo * F.col("transmittance") * F.col("falloff") / 12.566370614359172).alias("light"))
        gathered.append(materialise(lit))
        if len(gathered) == 16:
            gathered = [materialise(total())]
        d = phase_direction(uniform("ray_id", F.lit(own + 5)), uniform("ray_id", F.lit(own + 6)), [F.col("dx"), F.col("dy"), F.col("dz")])
        on = met.select("ray_id", *[F.col(f"p{a}").alias(f"o{a}") for a in "xyz"], *[x.alias(f"d{a}") for a, x in zip("xyz", d)], F.lit(0.0).alias("tmin"), F.lit(1e20).alias("tmax"), (F.col("weight") * albedo).alias("weight"))
        survives = uniform("ray_id", F.lit(own + 7)) < roulette
        paths = materialise(on.where((F.col("weight") >= roulette) | survives).withColumn("weight", F.when(F.col("weight") < roulette, F.col("weight") / roulette).otherwise(F.col("weight"))))
        if paths.isEmpty():
            break
    return by_key(rays.select("ray_id"), total(), "ray_id", "left").select("ray_id", F.coalesce("light", F.lit(0.0)).alias("radiance"))
