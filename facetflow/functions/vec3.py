"""Three-vectors as triples of Columns; everything stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V3 = tuple[Column, Column, Column]
TINY = 1e-12


def cols(prefix: str = "", suffix: str = "") -> V3:
    """The columns ``{prefix}x{suffix}``, ``…y…``, ``…z…``."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def lit(x: float, y: float, z: float) -> V3:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: V3, b: V3) -> V3:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: V3, b: V3) -> V3:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: V3, s) -> V3:
    return tuple(p * s for p in a)


def dot(a: V3, b: V3) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: V3, b: V3) -> V3:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: V3) -> Column:
    return F.sqrt(dot(a, a))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def normalize(a: V3) -> V3:
    """Unit vector; a vector shorter than ``TINY`` becomes the zero vector."""
    n = length(a)
    return tuple(F.when(n < TINY, F.lit(0.0)).otherwise(p / n) for p in a)


def normalize_or_null(a: V3, tiny: float = TINY) -> V3:
    n = length(a)
    return tuple(F.when(n >= tiny, p / n) for p in a)


def angle_between(u: V3, v: V3) -> Column:
    """Angle in radians; zero where one of the vectors vanishes."""
    n = length(u) * length(v)
    return F.when(n < 1e-24, F.lit(0.0)).otherwise(F.acos(clamp(dot(u, v) / n, -1.0, 1.0)))


def triangle_area(a: V3, b: V3, c: V3) -> Column:
    return length(cross(sub(b, a), sub(c, a))) * 0.5


def triangle_normal(a: V3, b: V3, c: V3) -> V3:
    return normalize(cross(sub(b, a), sub(c, a)))


def distance2(a: V3, b: V3) -> Column:
    d = sub(a, b)
    return dot(d, d)


def dot_arrays(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2_array(a: Column) -> Column:
    return F.sqrt(dot_arrays(a, a))


def even_sum(values: Column) -> Column:
    """Compensated sum of an array in ascending order: the same whatever order its rows came in."""

    def add(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    # beyond the finite the compensation is no number, and the plain sum stands
    total = F.aggregate(F.array_sort(values), zero, add, lambda acc: F.when(F.isnan(acc["c"]), acc["s"]).otherwise(acc["s"] + acc["c"]))
    return F.when(F.size(values) > 0, total)
