"""Transfer functions and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A transfer function has as many entries as fit an expression; from here on use a broadcast join instead.
MOST = 4096


def literal(entries: list[tuple[float, float, float, float]]) -> Column:
    if not 0 < len(entries) <= MOST:
        raise ValueError(f"1 to {MOST} entries are needed, not {len(entries)}")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("rgba", e)]) for e in entries])


def table(spark: SparkSession, entries: list[tuple[float, float, float, float]]) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(entries)], "i int, r double, g double, b double, a double")


def ramp(n: int = 16) -> list[tuple[float, float, float, float]]:
    return [(i / (n - 1), 0.5, 1 - i / (n - 1), (i / (n - 1)) ** 2) for i in range(n)]


def normalised(value: Column, low: float, high: float) -> Column:
    """Place of a value in the domain, clamped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def index(value: Column, low: float, high: float, n: int) -> Column:
    """Entry of a value; an empty domain gives none (null)."""
    if high <= low:
        return F.lit(None).cast("int")
    return F.least(F.lit(n - 1), F.floor(normalised(value, low, high) * n).cast("int"))


def lookup(value: Column, entries: list[tuple[float, float, float, float]], low: float, high: float) -> Column:
    """Colour (r, g, b, a) of a value; all zero where the domain is empty."""
    i = index(value, low, high, len(entries))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "rgba"])
    return F.coalesce(F.element_at(literal(entries), i + 1), zero)


def lookup_linear(value: Column, entries: list[tuple[float, float, float, float]], low: float, high: float) -> Column:
    """Colour between entry centres; a half entry at each end fades to a border of zero, beyond is zero."""
    n = len(entries)
    at = (value - low) / (high - low) * n - 0.5
    i = F.floor(at).cast("int")
    share = at - i
    padded = F.concat(literal([(0, 0, 0, 0)]), literal(entries), literal([(0, 0, 0, 0)]))
    inside = (at > -1) & (at < n)
    a = F.element_at(padded, F.when(inside, i).otherwise(-1) + 2)
    b = F.element_at(padded, F.when(inside, i).otherwise(-1) + 3)
    mixed = F.struct(*[(a[k] * (1 - share) + b[k] * share).alias(k) for k in "rgba"])
    return F.when(inside, mixed).otherwise(F.struct(*[F.lit(0.0).alias(k) for k in "rgba"]))


def relative_domain(low: float, high: float, from_percent: float, to_percent: float, ordered: bool = False) -> tuple[float, float]:
    """Absolute domain narrowed by percentages of it; ordered swaps ends that are the wrong way round."""
    a, b = low + from_percent / 100 * (high - low), low + to_percent / 100 * (high - low)
    return (min(a, b), max(a, b)) if ordered else (a, b)


def opacity_scale(step: Column) -> Column:
    """A slider of 0 to 200: 1 at 100, ten percent more a step."""
    return F.pow(F.lit(1.1), step - 100)


def majorant(vmin: Column, vmax: Column, entries: list[tuple[float, float, float, float]], low: float, high: float) -> Column:
    """Largest alpha that a value in [vmin, vmax] can look up, with one entry to spare; 0 for an empty range."""
    n = len(entries)
    clamp = lambda i: F.least(F.lit(n - 1), F.greatest(F.lit(0), i))
    norm = lambda v: (v - low) / (high - low)
    first = clamp(F.floor(norm(vmin) * (n - 1)).cast("int"))
    last = clamp(F.floor(norm(vmax) * (n - 1)).cast("int") + 1)
    alphas = F.array(*[F.lit(float(e[3])) for e in entries])
    return F.when(vmin <= vmax, F.array_max(F.slice(alphas, first + 1, last - first + 1))).otherwise(F.lit(0.0))


def heat(value: Column) -> list[Column]:
    """Blue, cyan, green, yellow, red for 0 to 1."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * 4
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), v - 2)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(v, 4 - v))), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 - v))]


def hue(h: Column) -> list[Column]:
    """Full-strength colour of a hue in 0..1."""
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return [clamp(F.abs(h * 6 - 3) - 1), clamp(2 - F.abs(h * 6 - 2)), clamp(2 - F.abs(h * 6 - 4))]


def over(front: list[Column], back: list[Column]) -> list[Column]:
    """A colour with premultiplied alpha over another."""
    return [f + (1 - front[3]) * b for f, b in zip(front, back)]


def background(v: Column) -> list[Column]:
    """White at the bottom of the screen, blue at the top."""
    return [1 - 0.5 * v, 1 - 0.3 * v, F.lit(1.0)]


def id_colour(i: Column) -> list[Column]:
    """A fixed colour for an id: three digits of a multiplicative hash."""
    return [F.pmod(i * k, F.lit(256)) / 255.0 for k in (73, 151, 199)]


def checkerboard(ix: Column, iy: Column, iz: Column) -> Column:
    return F.pmod(ix + iy + iz, F.lit(2)) == 0


def packed_rgba(colour: list[Column]) -> Column:
    """Four 8-bit channels in a number, red lowest."""
    byte = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(c * 256.0).cast("int"))).cast("long")
    return byte(colour[0]) + byte(colour[1]) * 256 + byte(colour[2]) * 65536 + byte(colour[3]) * 16777216
