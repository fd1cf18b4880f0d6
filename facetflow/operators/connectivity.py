"""Components, sub-meshes and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.components import connected_components


def _key(col: str):
    return F.struct(F.col("mesh_id").alias("m"), F.col(col).alias("i"))


def vertex_components(mesh: Mesh) -> DataFrame:
    """(mesh_id, vid, component): smallest vid reachable; isolated vertices are their own."""
    e = mesh.edges.select(_key("a").alias("a"), _key("b").alias("b"))
    lone = mesh.vertices.select(_key("vid").alias("a"), _key("vid").alias("b"))
    c = connected_components(e.unionByName(lone))
    return c.select(F.col("id.m").alias("mesh_id"), F.col("id.i").alias("vid"), F.col("component.i").alias("component"))


def face_components(mesh: Mesh, by: str = "vertex") -> DataFrame:
    """(mesh_id, fid, component): smallest fid of the faces that hang together by vertices or edges."""
    c = mesh.corners
    if by == "vertex":
        keys = c.select("mesh_id", "fid", F.col("src").alias("k1"), F.lit(None).cast("long").alias("k2"))
    elif by == "edge":
        keys = c.select("mesh_id", "fid", F.least("src", "dst").alias("k1"), F.greatest("src", "dst").alias("k2"))
    else:
        raise ValueError("by must be 'vertex' or 'edge'")
    # a star per vertex or edge, towards its smallest face, not all pairs of faces
    hub = keys.groupBy("mesh_id", "k1", "k2").agg(F.min("fid").alias("hub"))
    same = (F.col("l.mesh_id") == F.col("r.mesh_id")) & (F.col("l.k1") == F.col("r.k1")) & F.col("l.k2").eqNullSafe(F.col("r.k2"))
    star = keys.alias("l").join(hub.alias("r"), same).select(F.col("l.mesh_id").alias("mesh_id"), "fid", "hub")
    got = connected_components(star.select(_key("fid").alias("a"), _key("hub").alias("b")))
    return got.select(F.col("id.m").alias("mesh_id"), F.col("id.i").alias("fid"), F.col("component.i").alias("component"))


def component_count(mesh: Mesh, by: str = "vertex") -> DataFrame:
    n = face_components(mesh, by).groupBy("mesh_id").agg(F.count_distinct("component").alias("n_components"))
    return mesh.vertices.select("mesh_id").distinct().join(n, "mesh_id", "left").fillna(0, ["n_components"])


def component_of_face(mesh: Mesh, seeds: DataFrame, by: str = "vertex") -> DataFrame:
    """All faces in the components of the seed faces (mesh_id, fid)."""
    c = face_components(mesh, by)
    wanted = c.join(seeds.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_semi").select("mesh_id", "component").distinct()
    return c.join(wanted, ["mesh_id", "component"], "left_semi")


def extract_faces(mesh: Mesh, faces: DataFrame) -> Mesh:
    """The sub-mesh of the given faces (mesh_id, fid) and the vertices they use."""
    kept = mesh.faces.join(faces.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_semi")
    used = kept.select("mesh_id", F.explode("vs").alias("vid")).distinct()
    return Mesh(mesh.vertices.join(used, ["mesh_id", "vid"], "left_semi").select(*mesh.vertices.columns), kept.select(*mesh.faces.columns))


def extract_component(mesh: Mesh, seeds: DataFrame, by: str = "vertex") -> Mesh:
    return extract_faces(mesh, component_of_face(mesh, seeds, by))


def split_components(mesh: Mesh, by: str = "vertex") -> Mesh:
    """Every component becomes a mesh of its own: ``{mesh_id}/{component}``."""
    named = F.concat_ws("/", "mesh_id", F.col("component").cast("string"))
    faces = mesh.faces.join(face_components(mesh, by), ["mesh_id", "fid"])
    used = faces.select("mesh_id", "component", F.explode("vs").alias("vid")).distinct()
    vertices = mesh.vertices.join(used, ["mesh_id", "vid"])
    rest_v = [c for c in mesh.vertices.columns if c != "mesh_id"]
    rest_f = [c for c in mesh.faces.columns if c != "mesh_id"]
    return Mesh(vertices.select(named.alias("mesh_id"), *rest_v), faces.select(named.alias("mesh_id"), *rest_f))


def merge_meshes(a: Mesh, b: Mesh, mesh_id: str = "merged") -> Mesh:
    """Disjoint union as one mesh; ids of b are moved behind those of a."""
    top = a.vertices.agg(F.coalesce(F.max("vid") + 1, F.lit(0)).alias("dv")).crossJoin(F.broadcast(a.faces.agg(F.coalesce(F.max("fid") + 1, F.lit(0)).alias("df"))))
    v0 = a.vertices.withColumn("mesh_id", F.lit(mesh_id))
    f0 = a.faces.withColumn("mesh_id", F.lit(mesh_id))
    one = F.broadcast(top)  # a single row
    v1 = b.vertices.crossJoin(one).withColumn("vid", F.col("vid") + F.col("dv")).withColumn("mesh_id", F.lit(mesh_id)).drop("dv", "df")
    f1 = b.faces.crossJoin(one).select(F.lit(mesh_id).alias("mesh_id"), (F.col("fid") + F.col("df")).alias("fid"), F.transform("vs", lambda x: x + F.col("dv")).alias("vs"))
    return Mesh(v0.unionByName(v1, allowMissingColumns=True), f0.select("mesh_id", "fid", "vs").unionByName(f1))
