"""Scalar geometry of one triangle, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec3 as v
from .vec3 import V3


def area(a: V3, b: V3, c: V3) -> Column:
    return v.triangle_area(a, b, c)


def normal(a: V3, b: V3, c: V3) -> V3:
    """Unit normal, null for a degenerate triangle."""
    return v.normalize_or_null(v.cross(v.sub(b, a), v.sub(c, a)))


def interior_angle(at: V3, p: V3, q: V3) -> Column:
    return v.angle_between(v.sub(p, at), v.sub(q, at))


def min_angle(a: V3, b: V3, c: V3) -> Column:
    return F.least(interior_angle(a, b, c), interior_angle(b, c, a), interior_angle(c, a, b))


def cotan(at: V3, p: V3, q: V3) -> Column:
    """Cotangent of the angle at ``at``; zero for a degenerate corner."""
    d, e = v.sub(p, at), v.sub(q, at)
    n = v.length(v.cross(d, e))
    return F.when(n < 1e-14, F.lit(0.0)).otherwise(v.dot(d, e) / n)


def aspect_ratio(a: V3, b: V3, c: V3) -> Column:
    """Longest over shortest side, null where a side vanishes."""
    sides = [v.length(v.sub(p, q)) for p, q in ((a, b), (b, c), (c, a))]
    return F.when(F.least(*sides) >= 1e-20, F.greatest(*sides) / F.least(*sides))


def radius_ratio(a: V3, b: V3, c: V3) -> Column:
    """Twice the inradius over the circumradius: 1 for equilateral, 0 if flat."""
    x, y, z = (v.length(v.sub(p, q)) for p, q in ((b, c), (c, a), (a, b)))
    s = (x + y + z) * 0.5
    heron = s * (s - x) * (s - y) * (s - z)
    return F.when(F.least(x, y, z) < 1e-20, F.lit(None)).when(heron <= 0, F.lit(0.0)).otherwise((s - x) * (s - y) * (s - z) * 8.0 / (x * y * z))


def _closest_weights(d1, d2, d3, d4, d5, d6) -> tuple[Column, Column]:
    """Weights of b and c at the closest point, by the seven Voronoi regions of a triangle."""
    vc, vb, va = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    safe = lambda num, den: F.when(den == 0, F.lit(0.0)).otherwise(num / den)
    whole = va + vb + vc
    on_bc = safe(d4 - d3, (d4 - d3) + (d5 - d6))
    zero, one = F.lit(0.0), F.lit(1.0)
    regions = [
        ((d1 <= 0) & (d2 <= 0), zero, zero),
        ((d3 >= 0) & (d4 <= d3), one, zero),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), safe(d1, d1 - d3), zero),
        ((d6 >= 0) & (d5 <= d6), zero, one),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), zero, safe(d2, d2 - d6)),
        ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), one - on_bc, on_bc),
    ]
    wb, wc = F.when(regions[0][0], regions[0][1]), F.when(regions[0][0], regions[0][2])
    for cond, x, y in regions[1:]:
        wb, wc = wb.when(cond, x), wc.when(cond, y)
    return wb.otherwise(safe(vb, whole)), wc.otherwise(safe(vc, whole))


def _closest_dots(p: V3, a: V3, b: V3, c: V3) -> list[Column]:
    ab, ac = v.sub(b, a), v.sub(c, a)
    return [v.dot(e, v.sub(p, at)) for at in (a, b, c) for e in (ab, ac)]


def closest_point(p: V3, a: V3, b: V3, c: V3) -> V3:
    """Closest point of a triangle, as one expression."""
    wb, wc = _closest_weights(*_closest_dots(p, a, b, c))
    return v.add(a, v.add(v.scale(v.sub(b, a), wb), v.scale(v.sub(c, a), wc)))


def with_closest_point(df: DataFrame) -> DataFrame:
    """Adds qx, qy, qz for columns px … and ax … cz; in steps, so that generated code stays small."""
    dots = _closest_dots(v.cols("p"), v.cols("a"), v.cols("b"), v.cols("c"))
    keep = df.columns
    df = df.select(*keep, *(d.alias(f"__d{i}") for i, d in enumerate(dots)))
    wb, wc = _closest_weights(*(F.col(f"__d{i}") for i in range(6)))
    df = df.select(*keep, wb.alias("__wb"), wc.alias("__wc"))
    q = [F.col("a" + k) + (F.col("b" + k) - F.col("a" + k)) * F.col("__wb") + (F.col("c" + k) - F.col("a" + k)) * F.col("__wc") for k in "xyz"]
    return df.select(*keep, *(x.alias("q" + k) for x, k in zip(q, "xyz")))


def point_distance(p: V3, a: V3, b: V3, c: V3) -> Column:
    return F.sqrt(v.distance2(p, closest_point(p, a, b, c)))


def ray_hit(o: V3, d: V3, a: V3, b: V3, c: V3, eps: float = 1e-12) -> tuple[Column, Column, Column]:
    """``(t, u, v)`` of the hit at ``o + t d`` with t > eps, null without one.

    The ray need not be of unit length; hits on edges and corners count.
    """
    e1, e2 = v.sub(b, a), v.sub(c, a)
    h = v.cross(d, e2)
    det = v.dot(e1, h)
    s = v.sub(o, a)
    q = v.cross(s, e1)
    u = v.dot(s, h) / det
    w = v.dot(d, q) / det
    t = v.dot(e2, q) / det
    ok = (det != 0) & (u >= 0) & (w >= 0) & (u + w <= 1) & (t > eps)
    return F.when(ok, t), F.when(ok, u), F.when(ok, w)


def signed_tet_volume(a: V3, b: V3, c: V3) -> Column:
    """Signed volume of the tetrahedron that the triangle spans with the origin."""
    return v.dot(a, v.cross(b, c)) / 6.0


def from_lengths_area(a: Column, b: Column, c: Column) -> Column:
    s = (a + b + c) * 0.5
    return F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))


def cotan_from_lengths(a: Column, b: Column, c: Column) -> Column:
    """Cotangent of the angle opposite ``a``; zero if the triangle is flat."""
    k = from_lengths_area(a, b, c)
    return F.when(k < 1e-14, F.lit(0.0)).otherwise((b * b + c * c - a * a) / (k * 4.0))


def is_intrinsic_delaunay(ab: Column, bc: Column, ca: Column, ad: Column, bd: Column) -> Column:
    """Edge ab with opposite corners c and d: the two cotangents sum to no less than 0."""
    flat = (from_lengths_area(ab, bc, ca) < 1e-14) | (from_lengths_area(ab, ad, bd) < 1e-14)
    return flat | (cotan_from_lengths(ab, bc, ca) + cotan_from_lengths(ab, ad, bd) >= 0)


def intrinsic_cotan_weight(ab: Column, bc: Column, ca: Column, ad: Column, bd: Column) -> Column:
    return (cotan_from_lengths(ab, bc, ca) + cotan_from_lengths(ab, ad, bd)) * 0.5


def flipped_length(ab: Column, bc: Column, ca: Column, ad: Column, bd: Column) -> Column:
    """Length of edge cd after flipping ab, by laying both triangles in a plane."""
    cx = (ab * ab + ca * ca - bc * bc) / (ab * 2.0)
    cy = F.sqrt(F.greatest(ca * ca - cx * cx, F.lit(0.0)))
    dx = (ab * ab + ad * ad - bd * bd) / (ab * 2.0)
    dy = -F.sqrt(F.greatest(ad * ad - dx * dx, F.lit(0.0)))
    return F.sqrt((cx - dx) * (cx - dx) + (cy - dy) * (cy - dy))
