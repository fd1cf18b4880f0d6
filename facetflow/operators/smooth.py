"""Jacobi-style smoothing: one join and one aggregate a step, bounded plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec3 as v
from ..mesh import Mesh
from ..plans.lineage import cut

#: Steps per written table: a plan of a few steps is cheaper than a cut each step.
EVERY = 3


def ring_mean(mesh: Mesh) -> DataFrame:
    """Mean of the neighbours; an isolated vertex is its own mean."""
    m = mesh.adjacency.join(mesh.points("dst", "q"), ["mesh_id", "dst"]).groupBy("mesh_id", F.col("src").alias("vid")).agg(*(F.collect_list("q" + k).alias("q" + k) for k in "xyz"))
    m = m.select("mesh_id", "vid", *((v.even_sum(F.col("q" + k)) / F.size("q" + k)).alias("m" + k) for k in "xyz"))
    return mesh.vertices.join(m, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(F.coalesce("m" + k, k).alias("m" + k) for k in "xyz"))


def _step(mesh: Mesh, vertices: DataFrame, adj: DataFrame, factor: float) -> DataFrame:
    q = vertices.select("mesh_id", F.col("vid").alias("dst"), *(F.col(k).alias("q" + k) for k in "xyz"))
    m = adj.join(q, ["mesh_id", "dst"]).groupBy("mesh_id", F.col("src").alias("vid")).agg(*(F.avg("q" + k).alias("m" + k) for k in "xyz"))
    rest = [c for c in vertices.columns if c not in ("mesh_id", "vid", "x", "y", "z")]
    moved = [(F.col(k) + F.lit(factor) * (F.coalesce("m" + k, k) - F.col(k))).alias(k) for k in "xyz"]
    return vertices.join(m, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *moved, *rest)


def _run(mesh: Mesh, factors: list[float]) -> Mesh:
    if not factors:
        return mesh
    adj = cut(mesh.adjacency, "adjacency") if len(factors) > 1 else mesh.adjacency
    vertices = mesh.vertices
    for i, f in enumerate(factors, 1):
        vertices = _step(mesh, vertices, adj, f)
        if i % EVERY == 0 and i < len(factors):
            vertices = cut(vertices, "smooth")
    return mesh.with_vertices(vertices)


def laplacian_smooth(mesh: Mesh, lam: float, iterations: int) -> Mesh:
    """p ← (1 - λ) p + λ mean; λ is clamped to 1, nothing happens for λ ≤ 0.  The border moves too."""
    return _run(mesh, [min(lam, 1.0)] * iterations if lam > 0 else [])


def taubin_smooth(mesh: Mesh, lam: float, mu: float, iterations: int) -> Mesh:
    """A shrinking step λ and an inflating step μ < 0 per iteration; no-op if the signs are wrong."""
    if lam <= 0 or mu >= 0:
        return mesh
    return _run(mesh, [min(lam, 1.0), max(mu, -1.0)] * iterations)


def bilateral_smooth(mesh: Mesh, sigma_c: float, sigma_s: float, iterations: int) -> Mesh:
    """Neighbours weighted by distance and by difference of normals; normals are renewed each step."""
    from .measure import vertex_normals

    if sigma_c <= 0 or sigma_s <= 0:
        return mesh
    adj = mesh.adjacency
    for i in range(iterations):
        n = vertex_normals(mesh, fill=True)
        p = mesh.vertices.select("mesh_id", "vid", "x", "y", "z").join(n, ["mesh_id", "vid"])
        mine = p.select("mesh_id", F.col("vid").alias("src"), *(F.col(k).alias("p" + k) for k in "xyz"), *(F.col("n" + k).alias("a" + k) for k in "xyz"))
        other = p.select("mesh_id", F.col("vid").alias("dst"), *(F.col(k).alias("q" + k) for k in "xyz"), *(F.col("n" + k).alias("b" + k) for k in "xyz"))
        e = adj.join(mine, ["mesh_id", "src"]).join(other, ["mesh_id", "dst"])
        w = F.exp(-v.distance2(v.cols("p"), v.cols("q")) / (2 * sigma_c**2)) * F.exp(-v.distance2(v.cols("a"), v.cols("b")) / (2 * sigma_s**2))
        e = e.withColumn("w", w)
        g = e.groupBy("mesh_id", F.col("src").alias("vid")).agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col("q" + k)).alias("m" + k) for k in "xyz"))
        ok = F.col("w") >= 1e-20
        rest = [c for c in mesh.vertices.columns if c not in ("mesh_id", "vid", "x", "y", "z")]
        moved = mesh.vertices.join(g, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(F.when(ok, F.col("m" + k) / F.col("w")).otherwise(F.col(k)).alias(k) for k in "xyz"), *rest)
        mesh = mesh.with_vertices(cut(moved, "bilateral") if i + 1 < iterations else moved)
    return mesh


def tangential_smooth(mesh: Mesh, lam: float = 0.5) -> Mesh:
    """Move interior vertices towards the ring's mean within the tangent plane."""
    from .measure import vertex_normals

    rim = mesh.edges.where("n_faces = 1").select("mesh_id", F.explode(F.array("a", "b")).alias("vid")).distinct().withColumn("rim", F.lit(True))
    d = mesh.vertices.join(ring_mean(mesh), ["mesh_id", "vid"]).join(vertex_normals(mesh, fill=True), ["mesh_id", "vid"]).join(rim, ["mesh_id", "vid"], "left")
    step = v.sub(v.cols("m"), v.cols())
    along = v.dot(step, v.cols("n"))
    flat = v.sub(step, v.scale(v.cols("n"), along))
    rest = [c for c in mesh.vertices.columns if c not in ("mesh_id", "vid", "x", "y", "z")]
    return mesh.with_vertices(d.select("mesh_id", "vid", *(F.when(F.col("rim"), F.col(k)).otherwise(F.col(k) + f * lam).alias(k) for k, f in zip("xyz", flat)), *rest))
