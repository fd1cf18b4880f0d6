"""Deterministic meshes as table-valued sources, made in parallel from ``range``."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.lineage import cut


def _mesh(vertices, faces, mesh_id: str) -> Mesh:
    m = F.lit(mesh_id).alias("mesh_id")
    return Mesh(vertices.select(m, F.col("vid").cast("long").alias("vid"), *(F.col(c).cast("double").alias(c) for c in "xyz")), faces.select(m, F.col("fid").cast("long").alias("fid"), F.col("vs").cast("array<bigint>").alias("vs")))


def cube(spark: SparkSession, size: float = 1.0, mesh_id: str = "cube") -> Mesh:
    """Centred, 8 vertices and 12 triangles; corner k sits at the bits of k."""
    h = size / 2
    bit = lambda k: F.expr(f"IF(shiftright(id, {k}) % 2 = 1, {h!r}, -{h!r})")
    vs = spark.range(8).select(F.col("id").alias("vid"), *(bit(k).alias(c) for k, c in enumerate("xyz")))
    quads = []
    for k in range(3):
        u, w = 1 << (k + 1) % 3, 1 << (k + 2) % 3
        quads += [[(1 << k) | x for x in (0, u, u | w, w)], [0, w, u | w, u]]
    tris = [t for a, b, c, d in quads for t in ([a, b, c], [a, c, d])]
    return _mesh(vs, spark.createDataFrame(list(enumerate(tris)), "fid long, vs array<bigint>"), mesh_id)


def grid(spark: SparkSession, width: float, depth: float, nx: int, nz: int, mesh_id: str = "grid") -> Mesh:
    """XZ plane, centred: (nx+1)(nz+1) vertices and 2·nx·nz triangles facing +y."""
    nx, nz = max(nx, 1), max(nz, 1)
    m = nx + 1
    vs = spark.range(m * (nz + 1)).select(F.col("id").alias("vid"), (F.col("id") % m * (width / nx) - width / 2).alias("x"), F.lit(0.0).alias("y"), (F.floor(F.col("id") / m) * (depth / nz) - depth / 2).alias("z"))
    a = F.expr(f"(id div 2) div {nx} * {m} + (id div 2) % {nx}")
    fs = spark.range(2 * nx * nz).select(F.col("id").alias("fid"), a.alias("a")).select("fid", F.expr(f"IF(fid % 2 = 0, array(a, a + {m}, a + 1), array(a + {m}, a + {m} + 1, a + 1))").alias("vs"))
    return _mesh(vs, fs, mesh_id)


def uv_sphere(spark: SparkSession, radius: float, slices: int, stacks: int, mesh_id: str = "uv_sphere") -> Mesh:
    """(slices+1)(stacks+1) vertices, seam and poles doubled; pole triangles that vanish are left out."""
    s, t = max(slices, 3), max(stacks, 2)
    m = s + 1
    vs = spark.range(m * (t + 1)).select(F.col("id").alias("vid"), (F.col("id") % m * (2 * math.pi / s)).alias("a"), (F.floor(F.col("id") / m) * (math.pi / t)).alias("b"))
    vs = vs.select("vid", (F.sin("b") * F.cos("a") * radius).alias("x"), (F.cos("b") * radius).alias("y"), (F.sin("b") * F.sin("a") * radius).alias("z"))
    fs = spark.range(2 * s * t).select(F.col("id").alias("fid"), F.expr(f"(id div 2) div {s}").alias("r"), F.expr(f"(id div 2) div {s} * {m} + (id div 2) % {s}").alias("a"))
    fs = fs.where(f"(fid % 2 = 0 AND r < {t - 1}) OR (fid % 2 = 1 AND r > 0)")
    return _mesh(vs, fs.select("fid", F.expr(f"IF(fid % 2 = 0, array(a, a + {m} + 1, a + {m}), array(a, a + 1, a + {m} + 1))").alias("vs")), mesh_id)


def cylinder(spark: SparkSession, radius: float, height: float, slices: int, mesh_id: str = "cylinder") -> Mesh:
    """Along y: 2s + 2 vertices, 4s triangles; the last two vertices are the caps' centres."""
    s = max(slices, 3)
    vs = spark.range(2 * s + 2).select(F.col("id").alias("vid"), F.expr(f"IF(id < {2 * s}, (id % {s}) * {2 * math.pi / s!r}, 0)").alias("a"), F.expr(f"IF(id < {s} OR id = {2 * s}, -{height / 2!r}, {height / 2!r})").alias("y"), F.expr(f"IF(id < {2 * s}, {float(radius)!r}, 0.0D)").alias("r"))
    vs = vs.select("vid", (F.cos("a") * F.col("r")).alias("x"), "y", (F.sin("a") * F.col("r")).alias("z"))
    fs = spark.range(4 * s).selectExpr("id AS fid", f"id div 4 AS i", f"(id div 4 + 1) % {s} AS j")
    e = f"CASE fid % 4 WHEN 0 THEN array(i, i + {s}, j) WHEN 1 THEN array(j, i + {s}, j + {s}) WHEN 2 THEN array({2 * s}L, i, j) ELSE array({2 * s + 1}L, j + {s}, i + {s}) END"
    return _mesh(vs, fs.select("fid", F.expr(e).alias("vs")), mesh_id)


def cone(spark: SparkSession, radius: float, height: float, slices: int, mesh_id: str = "cone") -> Mesh:
    """Along y: s + 2 vertices, 2s triangles; apex is vertex s, base centre s + 1."""
    s = max(slices, 3)
    vs = spark.range(s + 2).select(F.col("id").alias("vid"), F.expr(f"IF(id < {s}, id * {2 * math.pi / s!r}, 0)").alias("a"), F.expr(f"IF(id < {s}, {float(radius)!r}, 0.0D)").alias("r"), F.expr(f"IF(id = {s}, {height / 2!r}, -{height / 2!r})").alias("y"))
    vs = vs.select("vid", (F.cos("a") * F.col("r")).alias("x"), "y", (F.sin("a") * F.col("r")).alias("z"))
    fs = spark.range(2 * s).selectExpr("id AS fid", "id div 2 AS i", f"(id div 2 + 1) % {s} AS j")
    return _mesh(vs, fs.select("fid", F.expr(f"IF(fid % 2 = 0, array(i, {s}L, j), array({s + 1}L, i, j))").alias("vs")), mesh_id)


def torus(spark: SparkSession, major: float, minor: float, n_major: int, n_minor: int, mesh_id: str = "torus") -> Mesh:
    """Around y: n_major · n_minor vertices, twice as many triangles."""
    p, q = max(n_major, 3), max(n_minor, 3)
    vs = spark.range(p * q).select(F.col("id").alias("vid"), (F.floor(F.col("id") / q) * (2 * math.pi / p)).alias("a"), (F.col("id") % q * (2 * math.pi / q)).alias("b"))
    ring = F.cos("b") * minor + major
    vs = vs.select("vid", (F.cos("a") * ring).alias("x"), (F.sin("b") * minor).alias("y"), (F.sin("a") * ring).alias("z"))
    fs = spark.range(2 * p * q).selectExpr("id AS fid", f"(id div 2) div {q} AS i", f"(id div 2) % {q} AS j").selectExpr(
        "fid", f"i * {q} + j AS a", f"i * {q} + (j + 1) % {q} AS b", f"(i + 1) % {p} * {q} + j AS c", f"(i + 1) % {p} * {q} + (j + 1) % {q} AS d"
    )
    return _mesh(vs, fs.select("fid", F.expr("IF(fid % 2 = 0, array(a, b, c), array(c, b, d))").alias("vs")), mesh_id)


def icosahedron(spark: SparkSession, mesh_id: str = "icosphere") -> Mesh:
    """Regular, on the unit sphere; faces found as triples of mutual nearest neighbours, outward."""
    g = (1 + math.sqrt(5)) / 2
    r = math.sqrt(1 + g * g)
    pts = [tuple((0.0, s, t * g)[(k + j) % 3] / r for j in range(3)) for k in range(3) for s in (-1.0, 1.0) for t in (-1, 1)]
    near = lambda i, j: abs(math.dist(pts[i], pts[j]) - 2 / r) < 1e-6
    tris = []
    for i in range(12):
        for j in range(i + 1, 12):
            for k in range(j + 1, 12):
                if near(i, j) and near(j, k) and near(i, k):
                    a, b, c = pts[i], pts[j], pts[k]
                    out = sum(a[x] * (b[(x + 1) % 3] * c[(x + 2) % 3] - b[(x + 2) % 3] * c[(x + 1) % 3]) for x in range(3))
                    tris.append([i, j, k] if out > 0 else [i, k, j])
    return Mesh.from_lists(spark, pts, tris, mesh_id)


def icosphere(spark: SparkSession, n: int, mesh_id: str = "icosphere") -> Mesh:
    """n midpoint subdivisions of the icosahedron, pushed to the sphere: 10·4ⁿ+2 vertices, 20·4ⁿ faces."""
    from ..operators.refine import midpoint_subdivide

    mesh = icosahedron(spark, mesh_id)
    for _ in range(n):
        mesh = midpoint_subdivide(mesh)
        size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
        mesh = Mesh(cut(mesh.vertices.select("mesh_id", "vid", *((F.col(c) / size).alias(c) for c in "xyz")), "sphere"), cut(mesh.faces, "sphere"))
    return mesh
