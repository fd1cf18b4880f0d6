"""Distances along a mesh: edge graph, heat method, exact windows."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import solvers as S
from ..functions.trimesh import TriMesh
from ..mesh import Mesh
from ..plans.kernels import per_mesh
from ..plans.lineage import cut
from .measure import edge_lengths

FIELD = "mesh_id string, vid long, distance double"


def _marked(sources: DataFrame) -> DataFrame:
    return sources.select("mesh_id", "vid").distinct().withColumn("source", F.lit(True))


def _source_rows(v: pd.DataFrame) -> np.ndarray:
    return np.flatnonzero(v["source"].fillna(False).astype(bool).to_numpy())


def _neighbors(points: np.ndarray, faces) -> list[list[tuple[int, float]]]:
    out: list[dict[int, float]] = [{} for _ in points]
    for f in faces:
        for a, b in zip(f, [*f[1:], f[0]]):
            out[a][b] = out[b][a] = float(np.linalg.norm(points[a] - points[b]))
    return [sorted(d.items()) for d in out]


def dijkstra_kernel(points: np.ndarray, faces, sources) -> tuple[np.ndarray, np.ndarray]:
    """Distances and parents (-1: none); equal distances keep the smallest parent."""
    near = _neighbors(points, faces)
    dist, parent = np.full(len(points), math.inf), np.full(len(points), -1, np.int64)
    heap = []
    for s in sources:
        dist[s] = 0.0
        heap.append((0.0, int(s)))
    heapq.heapify(heap)
    while heap:
        d, a = heapq.heappop(heap)
        if d > dist[a]:
            continue
        for b, w in near[a]:
            if d + w < dist[b] or (d + w == dist[b] and parent[b] > a and dist[b] > 0):
                better = d + w < dist[b]
                dist[b], parent[b] = d + w, a
                if better:
                    heapq.heappush(heap, (d + w, b))
    return dist, parent


def dijkstra(mesh: Mesh, sources: DataFrame) -> DataFrame:
    """(mesh_id, vid, distance, parent) over edges; unreachable: infinite, no parent."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        d, p = dijkstra_kernel(v[["x", "y", "z"]].to_numpy(float), faces, _source_rows(v))
        ids = v["vid"].to_numpy()
        return pd.DataFrame({"vid": ids, "distance": d, "parent": pd.array([int(ids[i]) if i >= 0 else None for i in p], "Int64")})

    return per_mesh(mesh, run, FIELD + ", parent long", _marked(sources))


def dijkstra_distributed(mesh: Mesh, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """The same distances for one mesh beyond a worker: rounds over the frontier only, until it is empty."""
    e = cut(edge_lengths(mesh).select("mesh_id", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("e"), "length").select("mesh_id", "e.s", "e.t", "length"), "graph")
    front = sources.select("mesh_id", "vid").distinct().withColumn("distance", F.lit(0.0))
    best = front = cut(front, "front")
    for n in itertools.count():
        if n == max_rounds:
            raise RuntimeError(f"the frontier is not empty after {max_rounds} rounds")
        step = front.withColumnRenamed("vid", "s").join(e, ["mesh_id", "s"]).groupBy("mesh_id", F.col("t").alias("vid")).agg(F.min(F.col("distance") + F.col("length")).alias("d"))
        old = best.select("mesh_id", "vid", F.col("distance").alias("old"))
        front = cut(step.join(old, ["mesh_id", "vid"], "left").where("old IS NULL OR d < old").select("mesh_id", "vid", F.col("d").alias("distance")), "front")
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("mesh_id", "vid").agg(F.min("distance").alias("distance")), "best")
    all_ = mesh.vertices.select("mesh_id", "vid").join(best, ["mesh_id", "vid"], "left")
    return all_.select("mesh_id", "vid", F.coalesce("distance", F.lit(math.inf)).alias("distance"))


def shortest_paths(mesh: Mesh, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(mesh_id, target, path): vertices from a source to each target, empty if none is reached."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        ids = v["vid"].to_numpy()
        d, p = dijkstra_kernel(v[["x", "y", "z"]].to_numpy(float), faces, _source_rows(v))
        rows = []
        for t in np.flatnonzero(v["target"].fillna(False).astype(bool).to_numpy()):
            path = []
            at = t if math.isfinite(d[t]) else -1
            while at >= 0:
                path.append(int(ids[at]))
                at = p[at]
            rows.append((int(ids[t]), path[::-1]))
        return pd.DataFrame(rows, columns=["target", "path"])

    wanted = targets.select("mesh_id", "vid").distinct().withColumn("target", F.lit(True))
    marks = _marked(sources).join(wanted, ["mesh_id", "vid"], "full")
    return per_mesh(mesh, run, "mesh_id string, target long, path array<long>", marks)


def descent_path(mesh: Mesh, field: DataFrame, targets: DataFrame) -> DataFrame:
    """(mesh_id, target, path): steepest descent of a distance field over edges, to a local minimum."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        ids, d = v["vid"].to_numpy(), v["distance"].to_numpy(float)
        near = _neighbors(v[["x", "y", "z"]].to_numpy(float), faces)
        rows = []
        for t in np.flatnonzero(v["target"].fillna(False).astype(bool).to_numpy()):
            path, at = [t], t
            for _ in range(2 * len(ids)):
                drop, to = max(((d[at] - d[b]) / max(w, 1e-300), -b) for b, w in near[at]) if near[at] else (0, 0)
                if not drop > 0:
                    break
                at = -to
                path.append(at)
            rows.append((int(ids[t]), [int(ids[i]) for i in path[::-1]]))
        return pd.DataFrame(rows, columns=["target", "path"])

    wanted = targets.select("mesh_id", "vid").distinct().withColumn("target", F.lit(True))
    return per_mesh(mesh, run, "mesh_id string, target long, path array<long>", field.select("mesh_id", "vid", "distance").join(wanted, ["mesh_id", "vid"], "full"))


def heat_kernel(points: np.ndarray, faces, sources) -> np.ndarray | None:
    t = S.triangles(faces)
    if not len(t) or not len(sources):
        return None
    lap, mass = S.cotan_matrix(points, t), S.lumped_mass(points, t)
    e = np.unique(np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1), axis=0)
    h = np.linalg.norm(points[e[:, 0]] - points[e[:, 1]], axis=1).mean()
    n = np.arange(len(points))
    start = np.zeros(len(points))
    start[sources] = 1.0
    u = S.conjugate_gradient(S.Coo(lap.n, lap.i, lap.j, lap.v * h * h).plus(n, n, mass + 1e-12), start, tol=1e-12)
    if u is None:
        return None
    p = [points[t[:, k]] for k in range(3)]
    normal = np.cross(p[1] - p[0], p[2] - p[0])
    area2 = np.maximum(np.linalg.norm(normal, axis=1), 1e-300)
    unit = normal / area2[:, None]
    grad = sum(u[t[:, k]][:, None] * np.cross(unit, p[(k + 2) % 3] - p[(k + 1) % 3]) for k in range(3)) / area2[:, None]
    x = -grad / np.maximum(np.linalg.norm(grad, axis=1), 1e-300)[:, None]
    cot = S.corner_cotangents(points, t)
    div = np.zeros(len(points))
    for k in range(3):
        e1, e2 = p[(k + 1) % 3] - p[k], p[(k + 2) % 3] - p[k]
        part = (cot[:, (k + 2) % 3] * (e1 * x).sum(axis=1) + cot[:, (k + 1) % 3] * (e2 * x).sum(axis=1)) / 2
        np.add.at(div, t[:, k], part)
    used = np.zeros(len(points), bool)
    used[t] = True
    fixed = ~used
    fixed[sources[0]] = True
    phi = S.dirichlet(lap, fixed, np.zeros((len(points), 1)), -div[:, None])
    if phi is None:
        return None
    phi = phi[:, 0] - phi[sources].min()
    out = np.where(used, np.maximum(phi, 0.0), np.inf)
    out[sources] = 0.0
    return out


def heat_geodesic(mesh: Mesh, sources: DataFrame) -> DataFrame:
    """Heat method: (mesh_id, vid, distance); no rows where the solver fails or no source lies."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        d = heat_kernel(v[["x", "y", "z"]].to_numpy(float), faces, _source_rows(v))
        return pd.DataFrame({"vid": v["vid"] if d is not None else v["vid"][:0], "distance": d if d is not None else np.zeros(0)})

    return per_mesh(mesh, run, FIELD, _marked(sources))


def window_kernel(points: np.ndarray, faces, sources, cap: int | None = None) -> np.ndarray:
    """Exact distances over faces by windows of straight lines through unfolded triangles.

    A window is a stretch of an edge lit by a source, kept as the source's place
    in the edge's plane and the distance behind it.  Vertices that windows or
    edges reach where straight lines can bend (saddles, border) become sources
    themselves.  Windows that no vertex can profit from are dropped; all others are
    followed to the end, unless ``cap`` is given: beyond ``20 * cap`` steps a face
    it raises.
    """
    m = TriMesh(points, faces)
    dist = np.full(len(points), np.inf)
    angle = np.zeros(len(points))
    for t in m.f.values():
        for k in range(3):
            u, w = m.p[t[(k + 1) % 3]] - m.p[t[k]], m.p[t[(k + 2) % 3]] - m.p[t[k]]
            c = u @ w / max(np.linalg.norm(u) * np.linalg.norm(w), 1e-300)
            angle[t[k]] += math.acos(min(1.0, max(-1.0, c)))
    bends = np.array([bool(m.around[v]) and (m.on_border(v) or angle[v] > 2 * math.pi - 1e-9) for v in range(len(points))])
    heap: list = []
    count = 0

    def emit(d: float, kind: str, data: tuple) -> None:
        nonlocal count
        count += 1
        heapq.heappush(heap, (d, count, kind, data))

    def reach(v: int, d: float) -> None:
        if d < dist[v] - 1e-12:
            dist[v] = d
            if bends[v]:
                emit(d, "v", (v, d))

    def lay(a: int, b: int, c: int) -> tuple[float, float]:
        """Place of c with a at the origin and b on the positive x-axis, c below."""
        ab, ac, bc = m.length(a, b), m.length(a, c), m.length(b, c)
        x = (ab * ab + ac * ac - bc * bc) / (2 * max(ab, 1e-300))
        return x, -math.sqrt(max(ac * ac - x * x, 0.0))

    def push(a: int, b: int, lo: float, hi: float, sx: float, sy: float, behind: float, face: int) -> None:
        if hi - lo < 1e-11:
            return
        size = m.length(a, b)
        near = behind + math.hypot(min(max(sx, lo), hi) - sx, sy)
        if near > dist[a] + hi and near > dist[b] + size - lo:
            return
        # a way over an end of the edge that is already shorter everywhere on the window
        if behind + math.hypot(sx - lo, sy) >= dist[a] + lo + 1e-12 and behind + math.hypot(sx - hi, sy) >= dist[a] + hi + 1e-12:
            return
        if behind + math.hypot(sx - lo, sy) >= dist[b] + size - lo + 1e-12 and behind + math.hypot(sx - hi, sy) >= dist[b] + size - hi + 1e-12:
            return
        emit(near, "w", (a, b, lo, hi, sx, sy, behind, face))

    def shine(v: int, d: float) -> None:
        for k in sorted(m.around[v]):
            t = m.f[k]
            i = t.index(v)
            a, b = t[(i + 1) % 3], t[(i + 2) % 3]
            reach(a, d + m.length(v, a))
            reach(b, d + m.length(v, b))
            x, y = lay(a, b, v)
            push(a, b, 0.0, m.length(a, b), x, -y, d, k)

    for s in sources:
        dist[s] = 0.0
        shine(int(s), 0.0)
    steps, most = 0, None if cap is None else cap * max(len(m.f), 1) * 20
    while heap:
        if steps == most:
            raise RuntimeError(f"windows are left after {most} steps")
        steps += 1
        near, _, kind, data = heapq.heappop(heap)
        if kind == "v":
            if data[1] <= dist[data[0]] + 1e-12 and data[1] > 0:
                shine(*data)
            continue
        a, b, lo, hi, sx, sy, behind, face = data
        over = [k for k in m.sides(a, b) if k != face]
        if not over:
            continue
        k = over[0]
        c = m.apex(k, a, b)
        cx, cy = lay(a, b, c)
        size = m.length(a, b)
        # shadow of the window on the line through c: where the ray source -> c crosses the edge
        cross = sx + (cx - sx) * sy / max(sy - cy, 1e-300)
        if lo - 1e-12 <= cross <= hi + 1e-12:
            reach(c, behind + math.hypot(cx - sx, cy - sy))

        def hit(x: float, px: float, py: float, qx: float, qy: float) -> float:
            """Share of p -> q where the ray from the source through (x, 0) meets it."""
            dx, dy = x - sx, -sy
            ex, ey = qx - px, qy - py
            den = dx * ey - dy * ex
            if abs(den) < 1e-300:
                return 0.0
            return min(1.0, max(0.0, (dx * (sy - py) - dy * (sx - px)) / den))

        for p, q, (px, py), (qx, qy), l0, l1 in (
            (a, c, (0.0, 0.0), (cx, cy), lo, min(hi, cross)),
            (c, b, (cx, cy), (size, 0.0), max(lo, cross), hi),
        ):
            if l1 - l0 < 1e-12:
                continue
            edge = m.length(p, q)
            s0, s1 = sorted((hit(l0, px, py, qx, qy) * edge, hit(l1, px, py, qx, qy) * edge))
            ux, uy = (qx - px) / max(edge, 1e-300), (qy - py) / max(edge, 1e-300)
            nx = (sx - px) * ux + (sy - py) * uy
            ny = abs((sx - px) * uy - (sy - py) * ux)
            push(p, q, s0, s1, nx, ny, behind, k)
    # ways along edges are never shorter than allowed, and close what windows left out
    near_ = _neighbors(points, [list(t) for t in m.f.values()])
    heap2 = [(d, v) for v, d in enumerate(dist) if math.isfinite(d)]
    heapq.heapify(heap2)
    while heap2:
        d, v = heapq.heappop(heap2)
        if d > dist[v]:
            continue
        for w, size in near_[v]:
            if d + size < dist[w]:
                dist[w] = d + size
                heapq.heappush(heap2, (d + size, w))
    return dist


def exact_geodesic(mesh: Mesh, sources: DataFrame) -> DataFrame:
    """Exact polyhedral distances: (mesh_id, vid, distance), infinite where nothing leads."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        src = _source_rows(v)
        pts = v[["x", "y", "z"]].to_numpy(float)
        return pd.DataFrame({"vid": v["vid"], "distance": window_kernel(pts, faces, src) if len(src) else np.full(len(v), np.inf)})

    return per_mesh(mesh, run, FIELD, _marked(sources))
