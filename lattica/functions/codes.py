"""Space-filling curves: Morton and Hilbert codes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 16


def quantised(value: Column, low: Column | float, high: Column | float, bits: int = BITS) -> Column:
    """Number of a value's step between the bounds."""
    top = 2**bits - 1
    share = F.try_divide(value - low, high - low) if isinstance(low, Column) else (value - low) / (high - low)
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(F.coalesce(share, F.lit(0.0)) * (2**bits)).cast("int"))).cast("long")


def spread(value: Column, gap: int, bits: int = BITS) -> Column:
    """Bits of a number with gap zeros after each."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value, k).bitwiseAND(F.lit(1).cast("long")), k * (gap + 1)))
    return out


def morton(steps: list[Column]) -> Column:
    """Interleaved bits, the first axis lowest: 48 bits for three axes, 64 for four (as a signed number)."""
    out = spread(steps[0], len(steps) - 1)
    for i, s in enumerate(steps[1:], 1):
        out = out.bitwiseOR(F.shiftleft(spread(s, len(steps) - 1), i))
    return out


def _automaton() -> tuple[list[int], list[int]]:
    """The Hilbert curve in three dimensions as an automaton of 24 states.

    A state is the corner at which the curve enters a cube and the axis along which it leaves. For each state and octant:
    the octant's place along the curve and the state within, as place + 8 * state; and the same by place, with octants.
    An octant's bits are of x, y and z, x lowest. By the rule of Gray codes: octants in order differ in one bit, and a
    part enters where the Gray code of the last even place points.
    """
    gray = [w ^ w >> 1 for w in range(8)]
    turn = lambda bits, k: (bits << k % 3 | bits >> (3 - k % 3)) & 7
    enters = [gray[2 * ((w - 1) // 2)] if w else 0 for w in range(8)]
    leaves = [0 if not w else ((w if w % 2 else w - 1) ^ (w if w % 2 else w - 1) + 1).bit_length() - 1 for w in range(8)]
    by_octant, by_place = [0] * 192, [0] * 192
    for corner in range(8):
        for axis in range(3):
            for w in range(8):
                octant = turn(gray[w], axis + 1) ^ corner
                inner = (corner ^ turn(enters[w], axis + 1)) * 3 + (axis + leaves[w] + 1) % 3
                by_octant[(corner * 3 + axis) * 8 + octant] = w + 8 * inner
                by_place[(corner * 3 + axis) * 8 + w] = octant + 8 * inner
    return by_octant, by_place


BY_OCTANT, BY_PLACE = _automaton()
#: Where a whole cube is entered: corner 0, along the last axis.
START = 2


def _shifted(value: Column, k: Column) -> Column:
    return F.call_function("shiftright", value, k)


def hilbert(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Place along the Hilbert curve of three whole numbers of so many bits each: a walk of the automaton, bit by bit.

    Codes are those of Moore's coordinates-to-index procedure with x as its first coordinate.
    """
    table = F.array(*[F.lit(v) for v in BY_OCTANT])
    bit = lambda v, k: _shifted(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long")).cast("int")

    def step(acc: Column, k: Column) -> Column:
        octant = bit(x, k) + bit(y, k) * 2 + bit(z, k) * 4
        found = F.get(table, acc["state"] * 8 + octant)
        return F.struct((acc["code"] * 8 + found.bitwiseAND(F.lit(7))).alias("code"), _shifted(found, F.lit(3)).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("code"), F.lit(START).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["code"])


def hilbert_point(code: Column, bits: int = BITS) -> Column:
    """The reverse: a struct x, y, z of whole numbers."""
    table = F.array(*[F.lit(v) for v in BY_PLACE])

    def step(acc: Column, k: Column) -> Column:
        place = _shifted(code.cast("long"), k * 3).bitwiseAND(F.lit(7).cast("long")).cast("int")
        found = F.get(table, acc["state"] * 8 + place)
        axes = [(acc[a] * 2 + _shifted(found, F.lit(i)).bitwiseAND(F.lit(1))).alias(a) for i, a in enumerate("xyz")]
        return F.struct(*axes, _shifted(found, F.lit(3)).alias("state"))

    none = F.lit(0).cast("long")
    start = F.struct(none.alias("x"), none.alias("y"), none.alias("z"), F.lit(START).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: F.struct(*[acc[a].alias(a) for a in "xyz"]))
