"""Robust predicates: Column determinants, a static filter, exact fallback.

The determinant and its permanent are computed in codegen.  Where the value
stands clear of the rounding bound (Shewchuk's first-stage constants) its sign
is certain; only the uncertain rows reach a vectorised Python function that
evaluates the same determinant in rationals.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.0**-53
CCW_BOUND = (3.0 + 16.0 * EPS) * EPS
O3D_BOUND = (7.0 + 56.0 * EPS) * EPS
ICC_BOUND = (10.0 + 96.0 * EPS) * EPS
ISP_BOUND = (16.0 + 224.0 * EPS) * EPS

P2 = tuple[Column, Column]
P3 = tuple[Column, Column, Column]


def _exact(rows: list[list[float]]) -> float:
    """Determinant of a small matrix in rationals; rounded once, sign kept."""
    m = [[Fraction(x) for x in r] for r in rows]
    det, n = Fraction(1), len(m)
    for i in range(n):
        p = next((r for r in range(i, n) if m[r][i] != 0), None)
        if p is None:
            return 0.0
        if p != i:
            m[i], m[p] = m[p], m[i]
            det = -det
        det *= m[i][i]
        for r in range(i + 1, n):
            k = m[r][i] / m[i][i]
            for c in range(i, n):
                m[r][c] -= k * m[i][c]
    out = float(det)
    return out if out or not det else (5e-324 if det > 0 else -5e-324)


def _fallback(dim: int, lifted: bool):
    def rows(points: list[tuple[float, ...]]) -> list[list]:
        last = [Fraction(x) for x in points[-1]]
        out = []
        for p in points[:-1]:
            d = [Fraction(x) - y for x, y in zip(p, last)]
            out.append([*d, sum(x * x for x in d)] if lifted else d)
        return out

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([_exact(rows([tuple(r[i : i + dim]) for i in range(0, len(r), dim)])) if all(x == x and x is not None for x in r) else None for r in zip(*series)], dtype="float64")

    return F.pandas_udf(run, "double")


def _filtered(det: Column, permanent: Column, bound: float, points, lifted: bool = False, exact: bool = True) -> Column:
    if not exact:
        return det
    sure = F.abs(det) > permanent * bound
    flat = [c for p in points for c in p]
    # null arguments keep certain rows out of the rational arithmetic
    held = [F.when(~sure, c) for c in flat]
    return F.when(sure, det).otherwise(_fallback(len(points[0]), lifted)(*held))


def orient2d(a: P2, b: P2, c: P2, exact: bool = True) -> Column:
    """Twice the signed area of abc: positive if counter-clockwise; exact sign."""
    left = (a[0] - c[0]) * (b[1] - c[1])
    right = (a[1] - c[1]) * (b[0] - c[0])
    return _filtered(left - right, F.abs(left) + F.abs(right), CCW_BOUND, (a, b, c), exact=exact)


def orient3d(a: P3, b: P3, c: P3, d: P3, exact: bool = True) -> Column:
    """Six times the signed volume; positive if d lies below the plane abc (ccw from above)."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (tuple(p - q for p, q in zip(x, d)) for x in (a, b, c))
    det = ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)
    permanent = (F.abs(by * cz) + F.abs(bz * cy)) * F.abs(ax) + (F.abs(bz * cx) + F.abs(bx * cz)) * F.abs(ay) + (F.abs(bx * cy) + F.abs(by * cx)) * F.abs(az)
    return _filtered(det, permanent, O3D_BOUND, (a, b, c, d), exact=exact)


def incircle(a: P2, b: P2, c: P2, d: P2, exact: bool = True) -> Column:
    """Positive if d is inside the circle through the ccw points a, b, c."""
    (ax, ay), (bx, by), (cx, cy) = (tuple(p - q for p, q in zip(x, d)) for x in (a, b, c))
    al, bl, cl = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = al * (bx * cy - cx * by) + bl * (cx * ay - ax * cy) + cl * (ax * by - bx * ay)
    permanent = (F.abs(bx * cy) + F.abs(cx * by)) * al + (F.abs(cx * ay) + F.abs(ax * cy)) * bl + (F.abs(ax * by) + F.abs(bx * ay)) * cl
    return _filtered(det, permanent, ICC_BOUND, (a, b, c, d), lifted=True, exact=exact)


def insphere(a: P3, b: P3, c: P3, d: P3, e: P3, exact: bool = True) -> Column:
    """Positive if e is inside the sphere through a, b, c, d with orient3d(a, b, c, d) > 0."""
    va, vb, vc, vd = (tuple(p - q for p, q in zip(x, e)) for x in (a, b, c, d))
    minor = lambda p, q: p[0] * q[1] - q[0] * p[1]
    sized = lambda p, q: F.abs(p[0] * q[1]) + F.abs(q[0] * p[1])
    lift = [p[0] * p[0] + p[1] * p[1] + p[2] * p[2] for p in (va, vb, vc, vd)]
    three = lambda p, q, r, m: p[2] * m(q, r) - q[2] * m(p, r) + r[2] * m(p, q)
    mag = lambda p, q, r: F.abs(p[2]) * sized(q, r) + F.abs(q[2]) * sized(p, r) + F.abs(r[2]) * sized(p, q)
    det = (lift[3] * three(va, vb, vc, minor) - lift[2] * three(va, vb, vd, minor)) + (lift[1] * three(va, vc, vd, minor) - lift[0] * three(vb, vc, vd, minor))
    permanent = lift[3] * mag(va, vb, vc) + lift[2] * mag(va, vb, vd) + lift[1] * mag(va, vc, vd) + lift[0] * mag(vb, vc, vd)
    return _filtered(det, permanent, ISP_BOUND, (a, b, c, d, e), lifted=True, exact=exact)


def signed_area2d(a: P2, b: P2, c: P2, exact: bool = True) -> Column:
    return orient2d(a, b, c, exact) * 0.5


def triangle_area_2d(a: P2, b: P2, c: P2, exact: bool = True) -> Column:
    return F.abs(signed_area2d(a, b, c, exact))


def is_ccw2d(a: P2, b: P2, c: P2, exact: bool = True) -> Column:
    return orient2d(a, b, c, exact) > 0


def is_collinear2d(a: P2, b: P2, c: P2, exact: bool = True) -> Column:
    return orient2d(a, b, c, exact) == 0


def is_convex_vertex2d(a: P2, b: P2, c: P2, exact: bool = True) -> Column:
    """Corner b of a ccw polygon turns left."""
    return orient2d(a, b, c, exact) > 0


def point_in_triangle_2d(p: P2, a: P2, b: P2, c: P2, exact: bool = True) -> Column:
    """Border included, either winding; a degenerate triangle holds nothing."""
    w = orient2d(a, b, c, exact)
    s = [orient2d(a, b, p, exact), orient2d(b, c, p, exact), orient2d(c, a, p, exact)]
    inside = F.when(w > 0, (s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)).otherwise((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
    return (w != 0) & inside


def tet_signed_volume(a: P3, b: P3, c: P3, d: P3, exact: bool = True) -> Column:
    return orient3d(a, b, c, d, exact) / -6.0


def is_coplanar(a: P3, b: P3, c: P3, d: P3, exact: bool = True) -> Column:
    return orient3d(a, b, c, d, exact) == 0


def is_triangle_degenerate_3d(a: P3, b: P3, c: P3, exact: bool = True) -> Column:
    """Exactly collinear: every axis projection has no area."""
    out = None
    for i, j in ((1, 2), (2, 0), (0, 1)):
        flat = orient2d((a[i], a[j]), (b[i], b[j]), (c[i], c[j]), exact) == 0
        out = flat if out is None else out & flat
    return out
