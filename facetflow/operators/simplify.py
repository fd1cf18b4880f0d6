"""Priority-driven algorithms, one kernel per mesh: decimation, remeshing, intrinsic flips."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import triangle as tri
from ..functions.trimesh import TriMesh
from ..mesh import Mesh
from ..plans.kernels import edit, per_mesh
from .measure import edge_lengths


def quadrics(m: TriMesh) -> dict[int, np.ndarray]:
    """Sum of the plane quadrics of the faces around each vertex."""
    q = {v: np.zeros((4, 4)) for v in m.p}
    for k, t in m.f.items():
        n = m.normal(k)
        size = np.linalg.norm(n)
        if size < 1e-14:
            continue
        plane = np.append(n / size, -(n / size) @ m.p[t[0]])
        for v in t:
            q[v] += np.outer(plane, plane)
    return q


def best_place(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Cheapest of both ends, the middle and the quadric's own minimum; the first wins ties."""
    options = [a, b, (a + b) / 2]
    if abs(np.linalg.det(q[:3, :3])) > 1e-10:
        options.append(np.linalg.solve(q[:3, :3], -q[:3, 3]))
    costs = [float(np.append(x, 1) @ q @ np.append(x, 1)) for x in options]
    i = int(np.argmin(costs))
    return max(costs[i], 0.0), options[i]


def decimate_kernel(points: np.ndarray, faces, target: int):
    m = TriMesh(points, faces)
    q = quadrics(m)
    stamp = dict.fromkeys(m.p, 0)
    heap: list = []

    def push(a: int, b: int) -> None:
        cost, at = best_place(q[a] + q[b], m.p[a], m.p[b])
        heapq.heappush(heap, (cost, min(a, b), max(a, b), stamp[a] + stamp[b], tuple(at)))

    for a, b in m.edges():
        push(a, b)
    while len(m.f) > target and heap:
        _, a, b, age, at = heapq.heappop(heap)
        if a not in m.p or b not in m.p or stamp[a] + stamp[b] != age or len(m.sides(a, b)) != 2:
            continue
        at = np.array(at)
        # an edge inside that joins two borders would pinch the surface
        if (m.on_border(a) or m.on_border(b)) or m.folds(a, b, at) or not m.collapse(a, b, at):
            continue
        q[a] = q[a] + q.pop(b)
        stamp[a] += 1 + stamp.pop(b)
        for w in sorted(m.ring(a)):
            push(a, w)
    return m.result()


def decimate(mesh: Mesh, target_faces: int) -> Mesh:
    """Quadric error collapses until ``target_faces`` are left or none is allowed; borders stay."""
    return edit(mesh, lambda p, f: decimate_kernel(p, f, target_faces))


def decimate_to_vertices(mesh: Mesh, target_vertices: int) -> Mesh:
    """For closed meshes of genus 0, where F = 2 V - 4."""
    return decimate(mesh, 2 * target_vertices - 4)


def target_length(mesh: Mesh) -> DataFrame:
    """Mean edge length between the quartiles, per mesh, over directed edges."""
    e = edge_lengths(mesh).withColumn("w", F.greatest(F.col("n_faces"), F.lit(2)))
    n = F.sum("w").over(W.partitionBy("mesh_id"))
    end = F.sum("w").over(W.partitionBy("mesh_id").orderBy("length", "a", "b"))
    lo, hi = F.expr("cast(total div 4 as long)"), F.expr("cast(3 * total div 4 as long)")
    r = e.withColumn("total", n).withColumn("upto", end)
    share = F.greatest(F.least("upto", hi) - F.greatest(F.col("upto") - F.col("w"), lo), F.lit(0))
    return r.withColumn("share", share).groupBy("mesh_id").agg((F.sum(F.col("share") * F.col("length")) / F.sum("share")).alias("target"))


def _auto_length(m: TriMesh) -> float:
    size = sorted(m.length(a, b) for a, b in m.edges() for _ in range(2))
    mid = size[len(size) // 4 : max(3 * len(size) // 4, len(size) // 4 + 1)]
    return float(np.mean(mid)) if mid else 0.0


def remesh_kernel(points: np.ndarray, faces, length: float | None, iterations: int, stats: dict | None = None):
    m = TriMesh(points, faces)
    size = length if length is not None else _auto_length(m)
    n = {"splits": 0, "collapses": 0, "flips": 0}
    if not m.f or size <= 0:
        return m.result()
    for _ in range(iterations):
        for a, b in m.edges():
            if m.length(a, b) > 1.333 * size:
                m.split_edge(a, b)
                n["splits"] += 1
        for a, b in m.edges():
            if a not in m.p or b not in m.p or len(m.sides(a, b)) != 2:
                continue
            if 1e-10 < m.length(a, b) < 0.8 * size and not (m.on_border(a) or m.on_border(b)):
                at = (m.p[a] + m.p[b]) / 2
                if any(np.linalg.norm(at - m.p[w]) > 1.333 * size for w in m.ring(a) | m.ring(b)) or m.folds(a, b, at):
                    continue
                n["collapses"] += m.collapse(a, b, at)
        goal = {v: 4 if m.on_border(v) else 6 for v in m.p}
        for a, b in m.edges():
            pair = m.sides(a, b)
            if len(pair) != 2:
                continue
            four = [a, b, *(m.apex(k, a, b) for k in pair)]
            off = [len(m.ring(v)) - goal[v] for v in four]
            if sum(abs(x + s) for x, s in zip(off, (-1, -1, 1, 1))) < sum(map(abs, off)):
                n["flips"] += m.flip(a, b)
        moved = {}
        for v in m.p:
            ring = m.ring(v)
            if not ring or m.on_border(v):
                continue
            normal = sum((m.normal(k) for k in m.around[v]), np.zeros(3))
            size_n = np.linalg.norm(normal)
            step = np.mean([m.p[w] for w in ring], axis=0) - m.p[v]
            if size_n > 1e-14:
                step = step - (step @ normal) / size_n**2 * normal
            moved[v] = m.p[v] + 0.5 * step
        m.p.update(moved)
    if stats is not None:
        stats |= n
    return m.result()


def isotropic_remesh(mesh: Mesh, length: float | None = None, iterations: int = 3) -> Mesh:
    """Split long, collapse short, flip for valence, smooth tangentially; auto length if none is given."""
    return edit(mesh, lambda p, f: remesh_kernel(p, f, length, iterations))


def quick_remesh(mesh: Mesh) -> Mesh:
    return isotropic_remesh(mesh, None, 3)


def remesh_to_length(mesh: Mesh, length: float) -> Mesh:
    return isotropic_remesh(mesh, length, 5)


def remesh_stats(mesh: Mesh, length: float | None = None, iterations: int = 3) -> DataFrame:
    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        stats: dict = {}
        p, f = remesh_kernel(v[["x", "y", "z"]].to_numpy(float), faces, length, iterations, stats)
        return pd.DataFrame([{**{"splits": 0, "collapses": 0, "flips": 0}, **stats, "n_vertices": len(p), "n_faces": len(f)}])

    return per_mesh(mesh, run, "mesh_id string, splits long, collapses long, flips long, n_vertices long, n_faces long")


def intrinsic_lengths(mesh: Mesh) -> DataFrame:
    return edge_lengths(mesh).select("mesh_id", "a", "b", "length")


def delaunay_edges(mesh: Mesh) -> DataFrame:
    """Interior edges of triangles with cotangent weight and whether they are intrinsically Delaunay."""
    e = edge_lengths(mesh).select("mesh_id", "a", "b", "length")
    side = mesh.corners.where("n = 3").select("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "opp", "heid")
    two = side.groupBy("mesh_id", "a", "b").agg(F.count("*").alias("k"), F.min("opp").alias("c"), F.max("opp").alias("d")).where("k = 2")

    def near(df: DataFrame, p: str, q: str, name: str) -> DataFrame:
        o = e.select("mesh_id", F.col("a").alias("e0"), F.col("b").alias("e1"), F.col("length").alias(name))
        return df.withColumns({"e0": F.least(p, q), "e1": F.greatest(p, q)}).join(o, ["mesh_id", "e0", "e1"]).drop("e0", "e1")

    t = two.join(e.withColumnRenamed("length", "ab"), ["mesh_id", "a", "b"])
    for p, q, name in (("b", "c", "bc"), ("c", "a", "ca"), ("a", "d", "ad"), ("b", "d", "bd")):
        t = near(t, p, q, name)
    l = [F.col(x) for x in ("ab", "bc", "ca", "ad", "bd")]
    return t.select("mesh_id", "a", "b", tri.intrinsic_cotan_weight(*l).alias("weight"), tri.is_intrinsic_delaunay(*l).alias("is_delaunay"), tri.flipped_length(*l).alias("flipped"))


def _area(a: float, b: float, c: float) -> float:
    s = (a + b + c) / 2
    return max(s * (s - a) * (s - b) * (s - c), 0.0) ** 0.5


def _cot(a: float, b: float, c: float) -> float:
    k = _area(a, b, c)
    return 0.0 if k < 1e-14 else (b * b + c * c - a * a) / (4 * k)


def intrinsic_delaunay_kernel(points: np.ndarray, faces):
    """Flips until every interior edge is Delaunay; lengths live on edges, places never change."""
    m = TriMesh(points, faces)
    key = lambda a, b: (min(a, b), max(a, b))
    size = {e: m.length(*e) for e in m.edges()}
    queue, cap, flips = deque(m.edges()), 10 * len(size), 0
    waiting = set(queue)
    while queue and flips < cap:
        a, b = queue.popleft()
        waiting.discard((a, b))
        pair = m.sides(a, b)
        if len(pair) != 2:
            continue
        k, l = pair if m.forward(pair[0], a, b) else pair[::-1]
        c, d = m.apex(k, a, b), m.apex(l, a, b)
        ab, bc, ca, ad, bd = (size[key(*e)] for e in ((a, b), (b, c), (c, a), (a, d), (b, d)))
        if c == d or _area(ab, bc, ca) < 1e-14 or _area(ab, ad, bd) < 1e-14 or _cot(ab, bc, ca) + _cot(ab, ad, bd) >= -1e-12 or m.sides(c, d):
            continue
        cx, dx = (ab**2 + ca**2 - bc**2) / (2 * ab), (ab**2 + ad**2 - bd**2) / (2 * ab)
        cy, dy = max(ca**2 - cx**2, 0.0) ** 0.5, -(max(ad**2 - dx**2, 0.0) ** 0.5)
        m.drop_face(k)
        m.drop_face(l)
        m.add_face(c, a, d)
        m.add_face(d, b, c)
        del size[key(a, b)]
        size[key(c, d)] = ((cx - dx) ** 2 + (cy - dy) ** 2) ** 0.5
        flips += 1
        for e in ((a, c), (c, b), (a, d), (d, b)):
            if key(*e) not in waiting:
                waiting.add(key(*e))
                queue.append(key(*e))
    left = 0
    for a, b in m.edges():
        pair = m.sides(a, b)
        if len(pair) == 2:
            c, d = (m.apex(k, a, b) for k in pair)
            ls = [size[key(*e)] for e in ((a, b), (b, c), (c, a), (a, d), (b, d))]
            left += _area(*ls[:3]) >= 1e-14 and _area(ls[0], *ls[3:]) >= 1e-14 and _cot(*ls[:3]) + _cot(ls[0], *ls[3:]) < -1e-9
    return m, size, flips, left


def intrinsic_delaunay(mesh: Mesh) -> DataFrame:
    """Edges of the intrinsic Delaunay triangulation: (mesh_id, a, b, length), by vertex id."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        _, size, _, _ = intrinsic_delaunay_kernel(v[["x", "y", "z"]].to_numpy(float), faces)
        ids = v["vid"].to_numpy()
        return pd.DataFrame([(ids[a], ids[b], l) for (a, b), l in sorted(size.items())], columns=["a", "b", "length"])

    return per_mesh(mesh, run, "mesh_id string, a long, b long, length double")


def intrinsic_delaunay_stats(mesh: Mesh) -> DataFrame:
    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        _, size, flips, left = intrinsic_delaunay_kernel(v[["x", "y", "z"]].to_numpy(float), faces)
        return pd.DataFrame([{"n_edges": len(size), "flips": flips, "not_delaunay": int(left)}])

    return per_mesh(mesh, run, "mesh_id string, n_edges long, flips long, not_delaunay long")
