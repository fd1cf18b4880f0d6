"""Booleans of closed triangle meshes: range join, grouped split, point-in-mesh join.

Triangles of one mesh that meet the other's in a grid join are cut by the
planes of those triangles, one small grouped kernel per triangle; every piece
is classified by its centroid with a ray parity join, or, if it lies on the
other surface, by that surface's normal.  Pieces are then kept, dropped or
turned by the operation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.lineage import cut
from .repair import number_new
from .spatial import boxed, cell_size, faces_in_aabb, ray_hits

#: A direction that no lattice or symmetric mesh has edges along.
PROBE = (0.5377, 0.2513, 0.8047)
EPS = 1e-9
PIECES = "fid long, k int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, on_side int"


def _cut_polygon(poly: np.ndarray, n: np.ndarray, d: float) -> list[np.ndarray]:
    """A convex polygon on either side of a plane; whole if it does not straddle."""
    s = poly @ n - d
    if (s >= -EPS).all() or (s <= EPS).all():
        return [poly]
    out = []
    for sign in (1, -1):
        part = []
        for i in range(len(poly)):
            a, b, sa, sb = poly[i], poly[(i + 1) % len(poly)], sign * s[i], sign * s[(i + 1) % len(poly)]
            if sa >= -EPS:
                part.append(a)
            if (sa > EPS and sb < -EPS) or (sa < -EPS and sb > EPS):
                part.append(a + (b - a) * sa / (sa - sb))
        if len(part) >= 3:
            out.append(np.array(part))
    return out


def _touches(p: np.ndarray, q: np.ndarray) -> bool:
    """Triangles overlap: no separating axis among normals and edge products."""
    n1, n2 = np.cross(p[1] - p[0], p[2] - p[0]), np.cross(q[1] - q[0], q[2] - q[0])
    axes = [n1, n2]
    e1, e2 = [p[(i + 1) % 3] - p[i] for i in range(3)], [q[(i + 1) % 3] - q[i] for i in range(3)]
    axes += [np.cross(a, b) for a in e1 for b in e2]
    axes += [np.cross(n1, a) for a in e1] + [np.cross(n2, b) for b in e2]
    for a in axes:
        size = np.linalg.norm(a)
        if size < 1e-14:
            continue
        x, y = p @ a / size, q @ a / size
        if x.max() < y.min() - EPS or y.max() < x.min() - EPS:
            return False
    return True


def _split(pdf: pd.DataFrame) -> pd.DataFrame:
    """One triangle (columns a…c) and its candidates (columns u…w) to classified pieces."""
    row = pdf.iloc[0]
    own = row[[f"{p}{c}" for p in "abc" for c in "xyz"]].to_numpy(float).reshape(3, 3)
    others = pdf[[f"{p}{c}" for p in "uvw" for c in "xyz"]].to_numpy(float).reshape(-1, 3, 3)
    others = others[~np.isnan(others).any(axis=(1, 2))]
    others = np.array([q for q in others if _touches(own, q)]).reshape(-1, 3, 3)
    normal = np.cross(own[1] - own[0], own[2] - own[0])
    size = np.linalg.norm(normal)
    if size < 1e-14:
        return pd.DataFrame(columns=[c.split()[0] for c in PIECES.split(", ")])
    normal /= size
    polys = [own]
    level = []
    for q in others:
        n = np.cross(q[1] - q[0], q[2] - q[0])
        l = np.linalg.norm(n)
        if l < 1e-14:
            continue
        n /= l
        if abs(abs(n @ normal) - 1) < 1e-9 and abs((q[0] - own[0]) @ normal) < EPS * 10:
            level.append((q, n))
            planes = []
            for i in range(3):
                m = np.cross(n, q[(i + 1) % 3] - q[i])
                m /= np.linalg.norm(m)
                planes.append((m, float(m @ q[i])))
        else:
            planes = [(n, float(n @ q[0]))]
        for m, d in planes:
            polys = [x for poly in polys for x in _cut_polygon(poly, m, d)]
    rows = []
    for poly in polys:
        mid = poly.mean(axis=0)
        side = 0
        for q, n in level:
            if all(np.cross(q[(i + 1) % 3] - q[i], mid - q[i]) @ n >= -EPS for i in range(3)):
                side = 1 if n @ normal > 0 else -1
        for i in range(1, len(poly) - 1):
            tri = (poly[0], poly[i], poly[i + 1])
            if np.linalg.norm(np.cross(tri[1] - tri[0], tri[2] - tri[0])) > 1e-12:
                rows.append((int(row["fid"]), len(rows), *np.concatenate(tri), side))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def _pieces(a: Mesh, b: Mesh) -> DataFrame:
    """Triangles of a, cut where b crosses them: (fid, k, ax … cz, on_side, inside)."""
    own = cut(boxed(a), "csg-own")
    other = cut(boxed(b), "csg-other")
    size = max(cell_size(a), cell_size(b))
    boxes = own.select(F.col("fid").alias("box_id"), *(F.col("lo" + k).alias("min_" + k) for k in "xyz"), *(F.col("hi" + k).alias("max_" + k) for k in "xyz"))
    near = faces_in_aabb(b, boxes, size).select(F.col("box_id").alias("fid"), F.col("fid").alias("gid"))
    tri = [p + c for p in "abc" for c in "xyz"]
    o = other.select(F.col("fid").alias("gid"), *(F.col(p + c).alias(q + c) for p, q in zip("abc", "uvw") for c in "xyz"))
    met = own.select("fid", *tri).join(near, "fid").join(o, "gid")
    crossed = cut(met.groupBy("fid").applyInPandas(_split, PIECES), "csg-pieces")
    free = own.join(near.select("fid").distinct(), "fid", "left_anti").select("fid", F.lit(0).alias("k"), *tri, F.lit(0).alias("on_side"))
    all_ = cut(crossed.unionByName(free).withColumn("ray_id", F.col("fid") * 100_000 + F.col("k")), "csg-all")
    rays = all_.where("on_side = 0").select(
        "ray_id", *(((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3).alias("o" + c) for c in "xyz"), *(F.lit(x).alias("d" + c) for x, c in zip(PROBE, "xyz"))
    )
    odd = ray_hits(b, rays, size).groupBy("ray_id").agg((F.count("*") % 2 == 1).alias("inside"))
    return all_.join(odd, "ray_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


#: For pieces of the first and second mesh: condition to keep, condition to keep turned.
RULES = {
    "union": (("on_side = 1 OR (on_side = 0 AND NOT inside)", "false"), ("on_side = 0 AND NOT inside", "false")),
    "intersection": (("on_side = 1 OR (on_side = 0 AND inside)", "false"), ("on_side = 0 AND inside", "false")),
    "difference": (("on_side = -1 OR (on_side = 0 AND NOT inside)", "false"), ("false", "on_side = 0 AND inside")),
    "symmetric_difference": (
        ("on_side = -1 OR (on_side = 0 AND NOT inside)", "on_side = 0 AND inside"),
        ("on_side = -1 OR (on_side = 0 AND NOT inside)", "on_side = 0 AND inside"),
    ),
}


def boolean(a: Mesh, b: Mesh, op: str, mesh_id: str = "result") -> Mesh:
    """a op b for one mesh each; vertices closer than 1e-9 per axis become one."""
    (keep_a, turn_a), (keep_b, turn_b) = RULES[op]
    parts = None
    for which, (x, y, keep, turn) in enumerate(((a, b, keep_a, turn_a), (b, a, keep_b, turn_b))):
        p = _pieces(x, y).where(f"({keep}) OR ({turn})").withColumn("turned", F.expr(f"({turn}) AND NOT ({keep})")).withColumn("which", F.lit(which))
        parts = p if parts is None else parts.unionByName(p)
    corner = lambda p: F.struct(*(F.col(p + c).alias(c) for c in "xyz"))
    order = F.when(F.col("turned"), F.array(corner("a"), corner("c"), corner("b"))).otherwise(F.array(corner("a"), corner("b"), corner("c")))
    tris = number_new(parts.select(F.lit(mesh_id).alias("mesh_id"), "which", "fid", "k", order.alias("ps")), ["which", "fid", "k"])
    tris = cut(tris.select("mesh_id", F.col("rank").alias("fid"), F.posexplode("ps").alias("slot", "p")).select("mesh_id", "fid", "slot", *(F.col("p." + c).alias(c) for c in "xyz"), *(F.round(F.col("p." + c) * 1e9).cast("long").alias("q" + c) for c in "xyz")), "csg-tris")
    spots = tris.groupBy("mesh_id", "qx", "qy", "qz").agg(*(F.min(c).alias(c) for c in "xyz"))
    spots = cut(number_new(spots, ["qx", "qy", "qz"]).withColumnRenamed("rank", "vid"), "csg-spots")
    named = tris.select("mesh_id", "fid", "slot", "qx", "qy", "qz").join(spots.select("mesh_id", "qx", "qy", "qz", "vid"), ["mesh_id", "qx", "qy", "qz"])
    faces = named.groupBy("mesh_id", "fid").agg(F.array_sort(F.collect_list(F.struct("slot", "vid"))).alias("l")).select("mesh_id", "fid", F.expr("transform(l, x -> x.vid)").alias("vs"))
    faces = faces.where(F.size(F.array_distinct("vs")) == 3)
    return Mesh(spots.select("mesh_id", "vid", "x", "y", "z"), faces)


def union(a: Mesh, b: Mesh) -> Mesh:
    return boolean(a, b, "union")


def intersection(a: Mesh, b: Mesh) -> Mesh:
    return boolean(a, b, "intersection")


def difference(a: Mesh, b: Mesh) -> Mesh:
    return boolean(a, b, "difference")


def symmetric_difference(a: Mesh, b: Mesh) -> Mesh:
    return boolean(a, b, "symmetric_difference")
