"""Topology edits in batches, as relational rewrites; requests carry a status.

A batch is a set of edits that do not touch each other.  Of requests that
conflict, the one with the smallest random rank in its neighbourhood is applied
and the others report ``conflict``; they can be asked for again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec3 as v
from ..mesh import Mesh
from ..plans.lineage import cut
from .refine import _numbered
from .repair import number_new, remap_faces
from .topology import link_condition, stars

XYZ = ("x", "y", "z")


def add_vertices(mesh: Mesh, points: DataFrame) -> Mesh:
    """points: (mesh_id, x, y, z); ids follow those in use, in coordinate order."""
    top = mesh.vertices.groupBy("mesh_id").agg((F.max("vid") + 1).alias("top"))
    new = number_new(points.select("mesh_id", *XYZ), list(XYZ)).join(top, "mesh_id", "left")
    new = new.select("mesh_id", (F.coalesce("top", F.lit(0)) + F.col("rank")).alias("vid"), *XYZ)
    return mesh.with_vertices(mesh.vertices.unionByName(new, allowMissingColumns=True))


def remove_vertices(mesh: Mesh, ids: DataFrame) -> Mesh:
    """Delete rows only; faces that name them stay (``validate`` reports those)."""
    return mesh.with_vertices(mesh.vertices.join(ids.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti").select(*mesh.vertices.columns))


def set_positions(mesh: Mesh, moved: DataFrame) -> Mesh:
    """moved: (mesh_id, vid, x, y, z)."""
    m = moved.select("mesh_id", "vid", *(F.col(c).alias("m" + c) for c in XYZ))
    rest = [c for c in mesh.vertices.columns if c not in ("mesh_id", "vid", *XYZ)]
    return mesh.with_vertices(mesh.vertices.join(m, ["mesh_id", "vid"], "left").select("mesh_id", "vid", *(F.coalesce("m" + c, c).alias(c) for c in XYZ), *rest))


def add_triangles(mesh: Mesh, triangles: DataFrame) -> tuple[Mesh, DataFrame]:
    """triangles: (mesh_id, vs) of existing, distinct vertices; and a status per request.

    repeated_vertex · missing_vertex · nonmanifold: a directed edge is taken · ok
    """
    t = number_new(triangles.select("mesh_id", "vs").distinct(), ["vs"])
    c = t.select("mesh_id", "rank", F.posexplode("vs").alias("slot", "src"), "vs").withColumn("dst", F.expr("vs[(slot + 1) % 3]"))
    known = mesh.vertices.select("mesh_id", F.col("vid").alias("src")).withColumn("known", F.lit(1))
    taken = mesh.corners.select("mesh_id", "src", "dst").distinct().withColumn("taken", F.lit(1))
    first = c.groupBy("mesh_id", "src", "dst").agg(F.min("rank").alias("first"))
    s = c.join(known, ["mesh_id", "src"], "left").join(taken, ["mesh_id", "src", "dst"], "left").join(first, ["mesh_id", "src", "dst"], "left")
    g = s.groupBy("mesh_id", "rank", "vs").agg(F.count("known").alias("known"), F.max(F.coalesce(F.col("taken"), (F.col("first") < F.col("rank")).cast("int"), F.lit(0))).alias("taken"))
    status = (
        F.when(F.size(F.array_distinct("vs")) < 3, "repeated_vertex").when(F.col("known") < 3, "missing_vertex").when(F.col("taken") > 0, "nonmanifold").otherwise("ok")
    )
    g = cut(g.withColumn("status", status), "add")
    top = mesh.faces.groupBy("mesh_id").agg((F.max("fid") + 1).alias("top"))
    new = g.where("status = 'ok'").join(top, "mesh_id", "left").select("mesh_id", (F.coalesce("top", F.lit(0)) + F.col("rank")).alias("fid"), "vs")
    return mesh.with_faces(mesh.faces.select("mesh_id", "fid", "vs").unionByName(new)), g.select("mesh_id", "vs", "status")


def split_edges(mesh: Mesh, edges: DataFrame) -> Mesh:
    """Put a vertex in the middle of any set of edges (mesh_id, a, b) at once.

    Triangles with one, two or three split edges become two, three or four.
    """
    e = edges.select("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(mesh.edges.select("mesh_id", "a", "b"), ["mesh_id", "a", "b"])
    e = e.join(mesh.points("a", "p"), ["mesh_id", "a"]).join(mesh.points("b", "q"), ["mesh_id", "b"])
    mids = cut(_numbered(mesh, e.select("mesh_id", "a", "b", *(((F.col("p" + k) + F.col("q" + k)) / 2).alias(k) for k in XYZ)), ["a", "b"]), "split")
    c = mesh.corners.where("n = 3").select("mesh_id", "fid", "slot", "src", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    g = c.join(mids.select("mesh_id", "a", "b", F.col("vid").alias("m")), ["mesh_id", "a", "b"], "left").groupBy("mesh_id", "fid").agg(
        *(F.max(F.when(F.col("slot") == s, F.col(x))).alias(f"{y}{s}") for s in range(3) for x, y in (("src", "v"), ("m", "m")))
    )
    # turn the corner order so that the split edges come first
    n = "(IF(m0 IS NULL, 0, 1) + IF(m1 IS NULL, 0, 1) + IF(m2 IS NULL, 0, 1))"
    turn = f"CASE {n} WHEN 1 THEN IF(m0 IS NOT NULL, 0, IF(m1 IS NOT NULL, 1, 2)) WHEN 2 THEN IF(m2 IS NULL, 0, IF(m0 IS NULL, 1, 2)) ELSE 0 END"
    g = g.withColumn("n", F.expr(n)).withColumn("t", F.expr(turn))
    for s in range(3):
        g = g.withColumn(f"w{s}", F.expr(f"array(v0, v1, v2)[({s} + t) % 3]")).withColumn(f"k{s}", F.expr(f"array(m0, m1, m2)[({s} + t) % 3]"))
    parts = F.expr(
        """CASE n WHEN 0 THEN array(array(v0, v1, v2))
               WHEN 1 THEN array(array(w0, k0, w2), array(k0, w1, w2))
               WHEN 2 THEN array(array(w0, k0, w2), array(k0, w1, k1), array(k0, k1, w2))
               ELSE array(array(v0, m0, m2), array(v1, m1, m0), array(v2, m2, m1), array(m0, m1, m2)) END"""
    )
    faces = g.select("mesh_id", F.col("fid").alias("of"), F.posexplode(parts).alias("k", "vs")).select("mesh_id", (F.col("of") * 4 + F.col("k")).alias("fid"), "vs")
    others = mesh.faces.where(F.size("vs") != 3).select("mesh_id", (F.col("fid") * 4).alias("fid"), "vs")
    return Mesh(mesh.vertices.select("mesh_id", "vid", *XYZ).unionByName(mids.select("mesh_id", "vid", *XYZ)), faces.unionByName(others))


def split_faces(mesh: Mesh, faces: DataFrame | None = None) -> Mesh:
    """Triangles (all, or those of (mesh_id, fid)) to three at their centroid."""
    t = mesh.triangles
    if faces is not None:
        t = t.join(faces.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_semi")
    mid = cut(_numbered(mesh, t.select("mesh_id", "fid", "v0", "v1", "v2", *(((F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / 3).alias(k) for k in XYZ)), ["fid"]), "centroids")
    parts = F.posexplode(F.expr("array(array(v0, v1, vid), array(v1, v2, vid), array(v2, v0, vid))"))
    made = mid.select("mesh_id", "fid", parts.alias("k", "vs")).select("mesh_id", (F.col("fid") * 3 + F.col("k")).alias("fid"), "vs")
    rest = mesh.faces.join(mid.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_anti").select("mesh_id", (F.col("fid") * 3).alias("fid"), "vs")
    return Mesh(mesh.vertices.select("mesh_id", "vid", *XYZ).unionByName(mid.select("mesh_id", "vid", *XYZ)), made.unionByName(rest))


def _edge_status(mesh: Mesh, edges: DataFrame) -> DataFrame:
    """Requests with their two faces and apexes: (mesh_id, a, b, k, f, g, c, d)."""
    e = edges.select("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = mesh.corners.where("n = 3").select("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "fid", "opp", (F.col("src") < F.col("dst")).alias("up"))
    both = side.groupBy("mesh_id", "a", "b").agg(
        F.count("*").alias("k"), F.max(F.when(F.col("up"), F.col("fid"))).alias("f"), F.max(F.when(~F.col("up"), F.col("fid"))).alias("g"),
        F.max(F.when(F.col("up"), F.col("opp"))).alias("c"), F.max(F.when(~F.col("up"), F.col("opp"))).alias("d"),
    )
    return e.join(both, ["mesh_id", "a", "b"], "left")


def _independent(requests: DataFrame, touched: DataFrame, seed: int = 0) -> DataFrame:
    """Requests (mesh_id, a, b) that come first, by random rank, at every element they touch."""
    ranked = touched.withColumn("rank", F.struct(F.xxhash64("a", "b", F.lit(seed)).alias("h"), "a", "b"))
    best = ranked.groupBy("mesh_id", "what").agg(F.min("rank").alias("best"))
    won = ranked.join(best, ["mesh_id", "what"]).groupBy("mesh_id", "a", "b").agg(F.min((F.col("rank") == F.col("best")).cast("int")).alias("won"))
    return requests.join(won, ["mesh_id", "a", "b"], "left").withColumn("won", F.coalesce(F.col("won") == 1, F.lit(False)))


def _apart(requests: DataFrame, ring: DataFrame, seed: int = 0) -> DataFrame:
    """Requests (mesh_id, a, b) that come first, by random rank, at all neighbours of their ends; ring: ``stars``.

    As ``_independent`` over these neighbours, without a row for each: the least
    rank goes from the ends to their neighbours and from there back.
    """
    rank = F.struct(F.xxhash64("a", "b", F.lit(seed)).alias("h"), "a", "b")
    least = requests.select("mesh_id", F.explode(F.array("a", "b")).alias("vid"), rank.alias("rank")).groupBy("mesh_id", "vid").agg(F.min("rank").alias("rank"))
    for _ in range(2):
        told = least.join(ring, ["mesh_id", "vid"]).select("mesh_id", F.explode(F.array_append("ns", F.col("vid"))).alias("vid"), "rank")
        least = told.groupBy("mesh_id", "vid").agg(F.min("rank").alias("rank"))
    least = cut(least.select("mesh_id", "vid", F.col("rank.a").alias("ra"), F.col("rank.b").alias("rb")), "least")
    for end in ("a", "b"):
        requests = requests.join(least.withColumnRenamed("vid", end), ["mesh_id", end]).where("a = ra AND b = rb").select("mesh_id", "a", "b")
    return requests


def flip_edges(mesh: Mesh, edges: DataFrame, seed: int = 0) -> tuple[Mesh, DataFrame]:
    """Replace ab by cd.  Status: ok · invalid_edge · border · degenerate · duplicate_edge · conflict."""
    s = _edge_status(mesh, edges)
    there = mesh.edges.select("mesh_id", F.col("a").alias("lo"), F.col("b").alias("hi")).withColumn("there", F.lit(True))
    s = s.withColumns({"lo": F.least("c", "d"), "hi": F.greatest("c", "d")}).join(there, ["mesh_id", "lo", "hi"], "left")
    why = F.when(F.col("k").isNull(), "invalid_edge").when((F.col("k") != 2) | F.col("f").isNull() | F.col("g").isNull(), "border").when(F.col("c") == F.col("d"), "degenerate").when(F.col("there"), "duplicate_edge")
    s = cut(s.withColumn("why", why), "flip")
    ok = s.where("why IS NULL").select("mesh_id", "a", "b", "f", "g", "c", "d", "lo", "hi")
    # edits that share a face conflict, and edits that would make the same edge
    touch = ok.select("mesh_id", "a", "b", F.explode(F.array(F.concat(F.lit("f"), "f"), F.concat(F.lit("f"), "g"), F.concat_ws("-", F.lit("e"), "lo", "hi"))).alias("what"))
    chosen = cut(_independent(ok, touch, seed), "flip-chosen")
    go = chosen.where("won")
    made = go.select("mesh_id", F.explode(F.array(
        F.struct(F.col("f").alias("fid"), F.array("c", "a", "d").alias("vs")), F.struct(F.col("g").alias("fid"), F.array("d", "b", "c").alias("vs"))
    )).alias("n")).select("mesh_id", "n.fid", "n.vs")
    faces = mesh.faces.select("mesh_id", "fid", "vs").join(made.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_anti").unionByName(made)
    status = s.join(chosen.select("mesh_id", "a", "b", "won"), ["mesh_id", "a", "b"], "left").select("mesh_id", "a", "b", F.coalesce("why", F.when(F.col("won"), "ok").otherwise("conflict")).alias("status"))
    return mesh.with_faces(faces), status


def collapse_edges(mesh: Mesh, edges: DataFrame, targets: DataFrame | None = None, seed: int = 0) -> tuple[Mesh, DataFrame]:
    """Merge b into a, at the middle or at (mesh_id, a, b, x, y, z) of ``targets``.

    Status: ok · invalid_edge · border · link_condition · conflict.  Edits whose
    neighbourhoods share a vertex conflict.
    """
    s = _edge_status(mesh, edges)
    ring = cut(stars(mesh), "stars")
    link = link_condition(mesh, s.where("k = 2").select("mesh_id", "a", "b"), ring).withColumnRenamed("ok", "link")
    s = s.join(link, ["mesh_id", "a", "b"], "left")
    why = F.when(F.col("k").isNull(), "invalid_edge").when(F.col("k") != 2, "border").when(~F.coalesce("link", F.lit(False)), "link_condition")
    s = cut(s.select("mesh_id", "a", "b", why.alias("why")), "collapse")
    ok = s.where("why IS NULL").select("mesh_id", "a", "b")
    won = cut(_apart(ok, ring, seed), "collapse-chosen")
    go = won.join(mesh.points("a", "p"), ["mesh_id", "a"]).join(mesh.points("b", "q"), ["mesh_id", "b"])
    at = go.select("mesh_id", "a", "b", *(((F.col("p" + k) + F.col("q" + k)) / 2).alias(k) for k in XYZ))
    if targets is not None:
        t = targets.select("mesh_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(F.col(k).alias("t" + k) for k in XYZ))
        at = at.join(t, ["mesh_id", "a", "b"], "left").select("mesh_id", "a", "b", *(F.coalesce("t" + k, k).alias(k) for k in XYZ))
    at = cut(at, "collapse-at")
    moved = set_positions(mesh, at.select("mesh_id", F.col("a").alias("vid"), *XYZ))
    vertices = moved.vertices.join(at.select("mesh_id", F.col("b").alias("vid")), ["mesh_id", "vid"], "left_anti").select(*mesh.vertices.columns)
    faces = remap_faces(mesh.faces, at.select("mesh_id", F.col("b").alias("vid"), F.col("a").alias("to")))
    status = s.join(won.withColumn("won", F.lit(True)), ["mesh_id", "a", "b"], "left").select("mesh_id", "a", "b", F.coalesce("why", F.when(F.col("won"), "ok").otherwise("conflict")).alias("status"))
    return Mesh(vertices, faces), status


def extrude_region(mesh: Mesh, faces: DataFrame, offset: tuple[float, float, float]) -> Mesh:
    """Move a region of faces (mesh_id, fid) and wall in its rim, two triangles per rim edge.

    Inner vertices move in place, rim vertices are doubled; a region without a
    rim just moves.
    """
    if sum(x * x for x in offset) < 1e-24:
        raise ValueError("the offset vanishes")
    region = mesh.faces.join(faces.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_semi").select("mesh_id", "fid", "vs")
    sub = Mesh(mesh.vertices, region)
    rim = cut(sub.paired.where("twin IS NULL").select("mesh_id", "src", "dst"), "rim")
    rest = mesh.faces.join(faces.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_anti").select("mesh_id", "fid", "vs")
    used = region.select("mesh_id", F.explode("vs").alias("vid")).distinct()
    # a vertex inside the region that faces outside also use must be doubled as well
    outer = rest.select("mesh_id", F.explode("vs").alias("vid")).distinct()
    double = rim.select("mesh_id", F.explode(F.array("src", "dst")).alias("vid")).union(used.join(outer, ["mesh_id", "vid"], "left_semi")).distinct()
    spots = mesh.vertices.select("mesh_id", "vid", *XYZ).join(double, ["mesh_id", "vid"], "left_semi")
    new = cut(_numbered(mesh, spots.withColumnRenamed("vid", "old"), ["old"]), "doubled")
    shift = lambda df: df.withColumns({k: F.col(k) + float(o) for k, o in zip(XYZ, offset)})
    inner = used.join(double, ["mesh_id", "vid"], "left_anti").withColumn("moves", F.lit(True))
    kept = mesh.vertices.select("mesh_id", "vid", *XYZ).join(inner, ["mesh_id", "vid"], "left")
    kept = kept.select("mesh_id", "vid", *(F.when(F.col("moves"), F.col(k) + float(o)).otherwise(F.col(k)).alias(k) for k, o in zip(XYZ, offset)))
    vertices = kept.unionByName(shift(new).select("mesh_id", "vid", *XYZ))
    to = new.select("mesh_id", F.col("old").alias("vid"), F.col("vid").alias("to"))
    top = remap_faces(region, to)
    m = to.select("mesh_id", F.col("vid").alias("src"), F.col("to").alias("s2")), to.select("mesh_id", F.col("vid").alias("dst"), F.col("to").alias("d2"))
    wall = rim.join(m[0], ["mesh_id", "src"]).join(m[1], ["mesh_id", "dst"])
    wall = wall.select("mesh_id", "src", "dst", F.posexplode(F.expr("array(array(src, dst, d2), array(src, d2, s2))")).alias("k", "vs"))
    last = mesh.faces.groupBy("mesh_id").agg((F.max("fid") + 1).alias("top"))
    sides = number_new(wall, ["src", "dst", "k"]).join(last, "mesh_id").select("mesh_id", (F.col("top") + F.col("rank")).alias("fid"), "vs")
    return Mesh(vertices, rest.unionByName(top).unionByName(sides))


def extrude_faces(mesh: Mesh, faces: DataFrame, offset: tuple[float, float, float]) -> Mesh:
    """Each face on its own: it gets vertices of its own and walls to its old border."""
    if sum(x * x for x in offset) < 1e-24:
        raise ValueError("the offset vanishes")
    own = mesh.corners.join(faces.select("mesh_id", "fid").distinct(), ["mesh_id", "fid"], "left_semi")
    spots = own.join(mesh.points("src", ""), ["mesh_id", "src"]).select("mesh_id", "fid", "slot", "src", "dst", "n", *((F.col(k) + float(o)).alias(k) for k, o in zip(XYZ, offset)))
    new = cut(_numbered(mesh, spots, ["fid", "slot"]), "own-corners")
    top = new.groupBy("mesh_id", "fid").agg(F.expr("transform(array_sort(collect_list(named_struct('slot', slot, 'vid', vid))), x -> x.vid)").alias("vs"))
    nxt = new.select("mesh_id", "fid", F.expr("(slot + n - 1) % n").alias("slot"), F.col("vid").alias("d2"))
    wall = new.join(nxt, ["mesh_id", "fid", "slot"]).select("mesh_id", "fid", "slot", F.posexplode(F.expr("array(array(src, dst, d2), array(src, d2, vid))")).alias("k", "vs"))
    last = mesh.faces.groupBy("mesh_id").agg((F.max("fid") + 1).alias("top"))
    sides = number_new(wall, ["fid", "slot", "k"]).join(last, "mesh_id").select("mesh_id", (F.col("top") + F.col("rank")).alias("fid"), "vs")
    rest = mesh.faces.join(faces.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_anti").select("mesh_id", "fid", "vs")
    return Mesh(mesh.vertices.select("mesh_id", "vid", *XYZ).unionByName(new.select("mesh_id", "vid", *XYZ)), rest.unionByName(top).unionByName(sides))


def translated(mesh: Mesh, offset: tuple[float, float, float]) -> Mesh:
    moved = v.add(v.cols(), v.lit(*offset))
    rest = [c for c in mesh.vertices.columns if c not in ("mesh_id", "vid", *XYZ)]
    return mesh.with_vertices(mesh.vertices.select("mesh_id", "vid", *(x.alias(k) for x, k in zip(moved, XYZ)), *rest))
