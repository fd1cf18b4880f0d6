"""Polygon triangulation: a fan as an expression, ear clipping as a kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fan(vs: Column) -> Column:
    """Triangles (v0, vi, vi+1) of an array column; empty below three corners."""
    n = F.size(vs)
    tri = F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array(F.element_at(vs, 1), F.element_at(vs, i.cast("int")), F.element_at(vs, (i + 1).cast("int"))))
    return F.when(n >= 3, tri).otherwise(F.array().cast("array<array<bigint>>"))


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def flatten(points: np.ndarray) -> np.ndarray:
    """Drop the axis along which the polygon's Newell normal is largest; winding is kept."""
    nxt = np.roll(points, -1, axis=0)
    normal = np.cross(points - points[0], nxt - points[0]).sum(axis=0)
    axis = int(np.abs(normal).argmax())
    keep = [(1, 2), (2, 0), (0, 1)][axis]
    flat = points[:, keep]
    return flat if normal[axis] >= 0 else flat * np.array([1.0, -1.0])


def ear_clip(points) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon in 2D or 3D, as indices in the order given.

    Clockwise 2D input is cut as its reverse and mapped back, so indices always
    refer to the input; a polygon that has no ear left gives what was found.
    """
    p = np.asarray(points, float)
    n = len(p)
    if n < 3:
        return []
    flat = flatten(p) if p.shape[1] == 3 else p
    area = float(np.sum(flat[:, 0] * np.roll(flat[:, 1], -1) - np.roll(flat[:, 0], -1) * flat[:, 1]))
    ring = list(range(n)) if area >= 0 else list(range(n - 1, -1, -1))
    out = []
    while len(ring) > 3:
        for k in range(len(ring)):
            i, j, l = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            if _turn(flat[i], flat[j], flat[l]) <= 0:
                continue
            others = [m for m in ring if m not in (i, j, l)]
            if any(_turn(flat[i], flat[j], flat[m]) >= 0 and _turn(flat[j], flat[l], flat[m]) >= 0 and _turn(flat[l], flat[i], flat[m]) >= 0 for m in others):
                continue
            out.append((i, j, l))
            ring.pop(k)
            break
        else:
            return out
    if _turn(*(flat[i] for i in ring)) != 0:
        out.append(tuple(ring))
    return out


def ear_clipping(points: Column) -> Column:
    """Array column of points (2 or 3 doubles) to triangles of indices."""

    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda ps: [list(t) for t in ear_clip(np.array([list(p) for p in ps]))] if ps is not None else None)

    return F.pandas_udf(run, "array<array<int>>")(points)
