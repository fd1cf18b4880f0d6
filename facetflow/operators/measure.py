"""Per-element geometry and whole-mesh measures: Column math over few joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import triangle as tri
from ..functions import vec3 as v
from ..mesh import Mesh

A, B, C = (lambda: v.cols("a")), (lambda: v.cols("b")), (lambda: v.cols("c"))


def edge_lengths(mesh: Mesh) -> DataFrame:
    """(mesh_id, a, b, n_faces, heid, length) of every undirected edge."""
    e = mesh.edges.join(mesh.points("a", "p"), ["mesh_id", "a"]).join(mesh.points("b", "q"), ["mesh_id", "b"])
    return e.select("mesh_id", "a", "b", "n_faces", "heid", v.length(v.sub(v.cols("p"), v.cols("q"))).alias("length"))


def face_geometry(mesh: Mesh) -> DataFrame:
    """Triangles only: area, unit normal (null if flat), smallest angle, centroid."""
    n = tri.normal(A(), B(), C())
    return mesh.triangles.select(
        "mesh_id", "fid", "v0", "v1", "v2",
        tri.area(A(), B(), C()).alias("area"),
        n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"),
        tri.min_angle(A(), B(), C()).alias("min_angle"),
        *(((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3.0).alias("c" + c + "_mid") for c in "xyz"),
    )


def polygon_geometry(mesh: Mesh) -> DataFrame:
    """Newell area and unit normal of faces of any size, centred on the centroid."""
    c = mesh.corners.join(mesh.points("src", "p"), ["mesh_id", "src"]).join(mesh.points("dst", "q"), ["mesh_id", "dst"])
    mid = mesh.corners.join(mesh.points("src", "m"), ["mesh_id", "src"]).groupBy("mesh_id", "fid").agg(*(F.avg("m" + k).alias("m" + k) for k in "xyz"))
    c = c.join(mid, ["mesh_id", "fid"])
    s = v.cross(v.sub(v.cols("p"), v.cols("m")), v.sub(v.cols("q"), v.cols("m")))
    g = c.groupBy("mesh_id", "fid").agg(*(F.sum(x).alias("s" + k) for x, k in zip(s, "xyz")), F.count("*").alias("n"))
    u = v.normalize_or_null(v.cols("s"))
    return g.select("mesh_id", "fid", "n", (v.length(v.cols("s")) * 0.5).alias("area"), u[0].alias("nx"), u[1].alias("ny"), u[2].alias("nz"))


def vertex_normals(mesh: Mesh, fill: bool = False) -> DataFrame:
    """Area-weighted unit normals; null (or zero with ``fill``) where there is none."""
    s = v.scale(v.cross(v.sub(B(), A()), v.sub(C(), A())), 0.5)
    t = mesh.triangles.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *(x.alias("s" + k) for x, k in zip(s, "xyz")))
    g = t.groupBy("mesh_id", "vid").agg(*(F.sum("s" + k).alias("s" + k) for k in "xyz"))
    u = v.normalize_or_null(v.cols("s"))
    out = mesh.vertices.select("mesh_id", "vid").join(g, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(x.alias("n" + k) for x, k in zip(u, "xyz")))
    return out.fillna(0.0, ["nx", "ny", "nz"]) if fill else out


def cotan_weights(mesh: Mesh) -> DataFrame:
    """(mesh_id, a, b, w): cot α + cot β of the triangles at an edge."""
    t = mesh.triangles
    corner = lambda i, j, k, at, p, q: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), tri.cotan(at, p, q).alias("c"))
    cs = F.explode(F.array(corner("v1", "v2", "v0", A(), B(), C()), corner("v2", "v0", "v1", B(), C(), A()), corner("v0", "v1", "v2", C(), A(), B())))
    return t.select("mesh_id", cs.alias("e")).groupBy("mesh_id", "e.a", "e.b").agg(F.sum("e.c").alias("w"))


def directed_weights(mesh: Mesh) -> DataFrame:
    """Both directions of ``cotan_weights``: (mesh_id, src, dst, w)."""
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return cotan_weights(mesh).select("mesh_id", both.alias("e"), "w").select("mesh_id", "e.src", "e.dst", "w")


def cotan_laplacian(mesh: Mesh) -> DataFrame:
    """Σ (cot α + cot β)(p_u - p_v) per vertex, not normalised."""
    w = directed_weights(mesh).join(mesh.points("src", "p"), ["mesh_id", "src"]).join(mesh.points("dst", "q"), ["mesh_id", "dst"])
    return w.groupBy("mesh_id", F.col("src").alias("vid")).agg(*(F.sum(F.col("w") * (F.col("q" + k) - F.col("p" + k))).alias("l" + k) for k in "xyz"))


def dihedral_angles(mesh: Mesh) -> DataFrame:
    """Angle between the normals of the two faces of an interior edge (0 if flat)."""
    n = tri.normal(A(), B(), C())
    t = mesh.triangles.select("mesh_id", "fid", "v0", "v1", "v2", *(x.alias("n" + k) for x, k in zip(n, "xyz")))
    sides = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))))
    e = t.select("mesh_id", "fid", sides.alias("e"), "nx", "ny", "nz").groupBy("mesh_id", "e.a", "e.b").agg(
        F.count("*").alias("k"),
        F.min_by(F.struct("nx", "ny", "nz"), "fid").alias("p"),
        F.max_by(F.struct("nx", "ny", "nz"), "fid").alias("q"),
    ).where("k = 2")
    p, q = tuple(F.col("p.n" + k) for k in "xyz"), tuple(F.col("q.n" + k) for k in "xyz")
    return e.select("mesh_id", "a", "b", F.acos(v.clamp(v.dot(p, q), -1.0, 1.0)).alias("angle"))


def feature_edges(mesh: Mesh, threshold: float) -> DataFrame:
    return dihedral_angles(mesh).where(F.col("angle") > threshold)


def face_quality(mesh: Mesh) -> DataFrame:
    return mesh.triangles.select("mesh_id", "fid", tri.aspect_ratio(A(), B(), C()).alias("aspect"), tri.radius_ratio(A(), B(), C()).alias("radius_ratio"))


def surface_area(mesh: Mesh) -> DataFrame:
    """Total area of the triangles of each mesh."""
    return mesh.triangles.groupBy("mesh_id").agg(F.sum(tri.area(A(), B(), C())).alias("area"), F.count("*").alias("n_triangles"))


def volume(mesh: Mesh) -> DataFrame:
    """Signed volume; positive for closed meshes that are oriented outwards."""
    return mesh.triangles.groupBy("mesh_id").agg(F.sum(tri.signed_tet_volume(A(), B(), C())).alias("volume"))


def aabb(mesh: Mesh) -> DataFrame:
    """Box, centre and diagonal; isolated vertices count."""
    g = mesh.vertices.groupBy("mesh_id").agg(*(F.min(k).alias("min_" + k) for k in "xyz"), *(F.max(k).alias("max_" + k) for k in "xyz"))
    size = v.sub(tuple(F.col("max_" + k) for k in "xyz"), tuple(F.col("min_" + k) for k in "xyz"))
    return g.select("*", *(((F.col("min_" + k) + F.col("max_" + k)) / 2).alias("mid_" + k) for k in "xyz"), v.length(size).alias("diagonal"))


def aabb_union(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Smallest box around boxes with min_/max_ columns; empty boxes are absent rows."""
    return boxes.groupBy(*(by or [])).agg(*(F.min("min_" + k).alias("min_" + k) for k in "xyz"), *(F.max("max_" + k).alias("max_" + k) for k in "xyz"))


def centroid(mesh: Mesh) -> DataFrame:
    return mesh.vertices.groupBy("mesh_id").agg(*(F.avg(k).alias("mid_" + k) for k in "xyz"))


def edge_stats(mesh: Mesh) -> DataFrame:
    """Population statistics of undirected edge lengths; ratio is infinite if the least vanishes."""
    g = edge_lengths(mesh).groupBy("mesh_id").agg(
        F.min("length").alias("min_len"), F.max("length").alias("max_len"), F.avg("length").alias("mean_len"),
        F.var_pop("length").alias("var_len"), F.stddev_pop("length").alias("std_len"), F.count("*").alias("n_edges"),
    )
    ratio = F.when(F.col("min_len") < 1e-20, F.lit(math.inf)).otherwise(F.col("max_len") / F.col("min_len"))
    return g.withColumn("ratio", ratio)


def quality(mesh: Mesh) -> DataFrame:
    q = face_quality(mesh).where("aspect IS NOT NULL").groupBy("mesh_id").agg(
        F.min("aspect").alias("min_aspect"), F.max("aspect").alias("max_aspect"), F.avg("aspect").alias("mean_aspect"),
        F.min("radius_ratio").alias("min_radius_ratio"), F.avg("radius_ratio").alias("mean_radius_ratio"), F.count("*").alias("face_count"),
    )
    return q.join(edge_stats(mesh), "mesh_id")


def curvature(mesh: Mesh) -> DataFrame:
    """Per vertex: barycentric area, Gaussian K (0 on the border), mean H, principal curvatures.

    K = (2π - Σ angles) / A; H = ‖Σ (cot α + cot β)(p_u - p_v)‖ / (4 A), unsigned;
    k1, k2 = H ± √max(H² - K, 0).  Vertices without a triangle are null.
    """
    t = mesh.triangles
    third = tri.area(A(), B(), C()) / 3.0
    corner = lambda i, at, p, q: F.struct(F.col(i).alias("vid"), tri.interior_angle(at, p, q).alias("g"))
    cs = F.explode(F.array(corner("v0", A(), B(), C()), corner("v1", B(), C(), A()), corner("v2", C(), A(), B())))
    g = t.select("mesh_id", cs.alias("k"), third.alias("m")).groupBy("mesh_id", "k.vid").agg(F.sum("k.g").alias("angles"), F.sum("m").alias("area"))
    rim = mesh.edges.where("n_faces = 1").select("mesh_id", F.explode(F.array("a", "b")).alias("vid")).distinct().withColumn("rim", F.lit(True))
    lap = cotan_laplacian(mesh)
    out = mesh.vertices.select("mesh_id", "vid").join(g, ["mesh_id", "vid"], "left").join(lap, ["mesh_id", "vid"], "left").join(rim, ["mesh_id", "vid"], "left")
    ok = F.col("area") > 1e-14
    k = F.when(F.coalesce("rim", F.lit(False)), F.lit(0.0)).when(ok, (2 * math.pi - F.col("angles")) / F.col("area"))
    h = F.when(ok, v.length(v.cols("l")) / (F.col("area") * 4.0))
    out = out.select("mesh_id", "vid", "area", k.alias("gaussian"), h.alias("mean"), F.coalesce("rim", F.lit(False)).alias("on_border"))
    root = F.sqrt(F.greatest(F.col("mean") * F.col("mean") - F.col("gaussian"), F.lit(0.0)))
    return out.withColumn("k1", F.col("mean") + root).withColumn("k2", F.col("mean") - root)
