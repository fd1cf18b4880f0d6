"""Counts, adjacency, rings, borders: equi-joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.components import connected_components
from ..plans.lineage import cut


def counts(mesh: Mesh) -> DataFrame:
    """Vertices, faces, directed edges (border ones included), edges, χ and genus per mesh.

    χ = V - E + F over undirected edges; genus = (2 - χ) div 2, which says
    something for closed meshes only.
    """
    v = mesh.vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))
    f = mesh.faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
    e = mesh.edges.groupBy("mesh_id").agg(
        F.count("*").alias("n_edges"),
        F.sum(F.when(F.col("n_faces") == 1, 1).otherwise(0)).alias("n_border_edges"),
        F.sum(F.greatest(F.col("n_faces"), F.lit(2))).alias("n_darts"),
    )
    out = v.join(f, "mesh_id", "left").join(e, "mesh_id", "left").fillna(0)
    chi = F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")
    return out.withColumn("euler", chi).withColumn("genus", F.expr("(2 - euler) div 2"))


def is_empty(mesh: Mesh) -> bool:
    return mesh.vertices.isEmpty() and mesh.faces.isEmpty()


def valence(mesh: Mesh) -> DataFrame:
    """Number of edges at each vertex; isolated vertices have 0."""
    n = mesh.adjacency.groupBy("mesh_id", F.col("src").alias("vid")).agg(F.count("*").alias("valence"))
    return mesh.vertices.select("mesh_id", "vid").join(n, ["mesh_id", "vid"], "left").fillna(0, ["valence"])


def max_valence(mesh: Mesh) -> DataFrame:
    return valence(mesh).groupBy("mesh_id").agg(F.max("valence").alias("max_valence"))


def vertex_neighbors(mesh: Mesh) -> DataFrame:
    return mesh.adjacency.select("mesh_id", F.col("src").alias("vid"), F.col("dst").alias("nbr"))


def vertex_faces(mesh: Mesh) -> DataFrame:
    return mesh.corners.select("mesh_id", F.col("src").alias("vid"), "fid")


def vertex_edges(mesh: Mesh) -> DataFrame:
    e = mesh.edges
    return e.select("mesh_id", F.explode(F.array("a", "b")).alias("vid"), "a", "b")


def vertex_darts(mesh: Mesh) -> DataFrame:
    """Outgoing directed edges of every vertex, as a set."""
    return mesh.darts.select("mesh_id", F.col("src").alias("vid"), "heid", "fid", "dst")


def face_darts(mesh: Mesh) -> DataFrame:
    return mesh.corners.select("mesh_id", "fid", "slot", "heid", "src", "dst")


def face_vertices(mesh: Mesh) -> DataFrame:
    """Tips of the boundary in ``next`` order: the face's list rotated by one."""
    rotated = F.concat(F.slice("vs", 2, F.size("vs") - 1), F.slice("vs", 1, 1))
    return mesh.faces.where(F.size("vs") >= 3).select("mesh_id", "fid", rotated.alias("vs"))


def vertex_rings(mesh: Mesh, max_rounds: int = 64) -> DataFrame:
    """Outgoing directed edges in counter-clockwise order: (mesh_id, vid, hop, heid).

    The order is a rank along ``ccw = prev.twin``, found by pointer doubling:
    log2(valence) joins, whatever the valence.  Open fans start at the
    clockwise-most directed edge, closed ones at the smallest id.
    """
    inner = mesh.paired.select("mesh_id", "heid", "src", "prev", "twin")
    prev_twin = mesh.paired.select("mesh_id", F.col("heid").alias("prev"), F.col("twin").alias("ccw"))
    he = inner.join(prev_twin, ["mesh_id", "prev"], "left").select("mesh_id", "heid", F.col("src").alias("vid"), "ccw")
    has_cw = he.where("ccw IS NOT NULL").select("mesh_id", F.col("ccw").alias("heid")).distinct().withColumn("has_cw", F.lit(True))
    he = he.join(has_cw, ["mesh_id", "heid"], "left")
    start = F.min_by("heid", F.struct(F.coalesce("has_cw", F.lit(False)), F.col("heid")))
    first = he.groupBy("mesh_id", "vid").agg(start.alias("first"))
    he = he.join(first, ["mesh_id", "vid"])
    # distance to the end of the fan: the last element has no successor or wraps to first
    nxt = F.when(F.col("ccw") != F.col("first"), F.col("ccw"))
    state = cut(he.select("mesh_id", "vid", "heid", nxt.alias("to"), F.when(nxt.isNull(), 0).otherwise(1).cast("long").alias("left")), "ring")
    for _ in range(max_rounds):
        if state.where("to IS NOT NULL").isEmpty():
            break
        jump = state.select("mesh_id", F.col("heid").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        state = cut(
            state.join(jump, ["mesh_id", "to"], "left").select("mesh_id", "vid", "heid", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")),
            "ring",
        )
    size = state.groupBy("mesh_id", "vid").agg(F.max("left").alias("most"))
    return state.join(size, ["mesh_id", "vid"]).select("mesh_id", "vid", (F.col("most") - F.col("left")).alias("hop"), "heid")


def stars(mesh: Mesh) -> DataFrame:
    """Neighbours of every vertex of a face, as a list without repeats: (mesh_id, vid, ns).

    Straight from the faces, so that those of a vertex that lie near each other are one row before the shuffle.
    """
    c = mesh.faces.where(F.size("vs") >= 3).select("mesh_id", F.size("vs").alias("n"), "vs", F.posexplode("vs").alias("slot", "vid"))
    c = c.select("mesh_id", "vid", F.expr("array(vs[(slot + 1) % n], vs[(slot + n - 1) % n])").alias("ends"))
    return c.groupBy("mesh_id", "vid").agg(F.array_distinct(F.flatten(F.collect_set("ends"))).alias("ns"))


def two_ring(mesh: Mesh) -> DataFrame:
    """Pairs at hop distance exactly 2.

    Every vertex sends its neighbours to each of them; what comes together there
    is the whole second ring, without a row for each path of two edges.
    """
    sent = stars(mesh).select("mesh_id", F.explode("ns").alias("to"), F.array_prepend("ns", F.col("vid")).alias("via"))
    got = sent.groupBy("mesh_id", F.col("to").alias("vid")).agg(F.collect_list("via").alias("l"))
    near = F.array_append(F.transform("l", lambda x: x[0]), F.col("vid"))
    return got.select("mesh_id", "vid", F.explode(F.array_except(F.flatten("l"), near)).alias("nbr"))


def k_disk(mesh: Mesh, seeds: DataFrame, k: int) -> DataFrame:
    """Vertices within k hops of each seed: (mesh_id, seed, vid, hop).

    seeds: (mesh_id, vid).  One join a round against the frontier only; the
    visited set grows by an anti-join, so a vertex keeps its smallest hop.
    """
    adj = mesh.adjacency
    seen = seeds.select("mesh_id", F.col("vid").alias("seed"), "vid", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, k + 1):
        reach = front.join(adj.withColumnRenamed("src", "vid"), ["mesh_id", "vid"]).select("mesh_id", "seed", F.col("dst").alias("vid")).distinct()
        front = reach.join(seen, ["mesh_id", "seed", "vid"], "left_anti").withColumn("hop", F.lit(hop))
        if hop % 3 == 0:
            front = cut(front, "front")
            seen = cut(seen.unionByName(front), "seen")
        else:
            seen = seen.unionByName(front)
    return seen


def k_ring(mesh: Mesh, seeds: DataFrame, k: int) -> DataFrame:
    return k_disk(mesh, seeds, k).where(F.col("hop") == k)


def border_darts(mesh: Mesh) -> DataFrame:
    """Interior directed edges without a twin: (mesh_id, heid, src, dst)."""
    return mesh.edges.where("n_faces = 1").join(mesh.corners.select("mesh_id", "heid", "src", "dst"), ["mesh_id", "heid"]).select("mesh_id", "heid", "src", "dst")


def border_vertices(mesh: Mesh) -> DataFrame:
    e = mesh.edges.where("n_faces = 1")
    return e.select("mesh_id", F.explode(F.array("a", "b")).alias("vid")).distinct()


def is_closed(mesh: Mesh) -> DataFrame:
    """Strict: every directed directed edge has its twin; one row per mesh."""
    open_ = mesh.paired.groupBy("mesh_id").agg(F.max(F.col("twin").isNull().cast("int")).alias("o"))
    ids = mesh.vertices.select("mesh_id").distinct()
    return ids.join(open_, "mesh_id", "left").select("mesh_id", (F.coalesce("o", F.lit(0)) == 0).alias("is_closed"))


def border_loops(mesh: Mesh, max_rounds: int = 64) -> DataFrame:
    """Border directed edges with loop and rank: (mesh_id, loop, hop, heid, src, dst).

    loop = smallest border id; rank counts from it along ``next``.  The loop is
    a component of border directed edges, the rank comes from pointer doubling.
    """
    rim = mesh.darts.where("fid IS NULL").select("mesh_id", "heid", "src", "dst", "next")
    key = lambda c: F.struct(F.col("mesh_id").alias("m"), F.col(c).alias("h"))
    comps = connected_components(rim.select(key("heid").alias("a"), F.coalesce(key("next"), key("heid")).alias("b")))
    rim = rim.join(comps.select(F.col("id.m").alias("mesh_id"), F.col("id.h").alias("heid"), F.col("component.h").alias("loop")), ["mesh_id", "heid"])
    nxt = F.when(F.col("next") != F.col("loop"), F.col("next"))
    state = cut(rim.select("mesh_id", "loop", "heid", "src", "dst", nxt.alias("to"), F.when(nxt.isNull(), 0).otherwise(1).cast("long").alias("left")), "loops")
    for _ in range(max_rounds):
        if state.where("to IS NOT NULL").isEmpty():
            break
        jump = state.select("mesh_id", F.col("heid").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        state = cut(
            state.join(jump, ["mesh_id", "to"], "left").select("mesh_id", "loop", "heid", "src", "dst", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")),
            "loops",
        )
    size = state.groupBy("mesh_id", "loop").agg(F.max("left").alias("most"))
    return state.join(size, ["mesh_id", "loop"]).select("mesh_id", "loop", (F.col("most") - F.col("left")).alias("hop"), "heid", "src", "dst")


def link_condition(mesh: Mesh, pairs: DataFrame, ring: DataFrame | None = None) -> DataFrame:
    """For edges (mesh_id, a, b): whether the common neighbours are exactly the two opposite corners.

    An opposite corner is a common neighbour, so of two both are opposite if the
    smallest and the largest opposite corner differ.  ring: ``stars``, if at hand.
    """
    nb = stars(mesh) if ring is None else ring
    opp = mesh.corners.where("opp IS NOT NULL").groupBy("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("opp").alias("c"), F.max("opp").alias("d"))
    p = pairs.select("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    p = p.join(nb.select("mesh_id", F.col("vid").alias("a"), F.col("ns").alias("na")), ["mesh_id", "a"])
    p = p.join(nb.select("mesh_id", F.col("vid").alias("b"), F.col("ns").alias("nb")), ["mesh_id", "b"])
    p = p.select("mesh_id", "a", "b", F.sort_array(F.array_intersect("na", "nb")).alias("common")).join(opp, ["mesh_id", "a", "b"], "left")
    return p.select("mesh_id", "a", "b", ((F.size("common") == 2) & (F.col("common") == F.array("c", "d"))).alias("ok"))
