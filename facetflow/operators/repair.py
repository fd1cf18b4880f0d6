"""Validation, welding, cleaning, orientation and hole filling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import vec3 as v
from ..functions.polygons import ear_clip
from ..mesh import Mesh
from ..plans.components import connected_components
from ..plans.lineage import cut
from .topology import border_loops


def validate(mesh: Mesh) -> DataFrame:
    """All violations as rows (mesh_id, kind, element_id, detail).

    dangling_vertex: a face names a vertex that does not exist · repeated_vertex:
    a face names one twice · face_size: fewer than three corners ·
    not_triangular · degenerate_face: collinear corners · duplicate_dart: a
    directed edge twice, i.e. faces that disagree in orientation ·
    nonmanifold_edge: more than two faces · nonmanifold_vertex: more than one
    fan · isolated_vertex · duplicate_id.
    """
    f, out = mesh.faces, []

    def add(df: DataFrame, kind: str, element: str, detail) -> None:
        out.append(df.select("mesh_id", F.lit(kind).alias("kind"), F.col(element).cast("long").alias("element_id"), detail.cast("string").alias("detail")))

    used = f.select("mesh_id", "fid", F.explode("vs").alias("vid"))
    named = used.select("mesh_id", "vid").distinct().hint("merge")
    # as a rule none: the faces that name them are looked up without a shuffle
    lost = cut(named.join(mesh.vertices.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti"), "lost")
    add(used.join(lost, ["mesh_id", "vid"], "left_semi"), "dangling_vertex", "fid", F.col("vid"))
    add(f.where(F.size("vs") != F.size(F.array_distinct("vs"))), "repeated_vertex", "fid", F.size("vs"))
    add(f.where(F.size("vs") < 3), "face_size", "fid", F.size("vs"))
    add(f.where(F.size("vs") > 3), "not_triangular", "fid", F.size("vs"))
    a, b, c = v.cols("a"), v.cols("b"), v.cols("c")
    add(mesh.triangles.where(pr.is_triangle_degenerate_3d(a, b, c)), "degenerate_face", "fid", F.lit("collinear"))
    twice = mesh.corners.groupBy("mesh_id", "src", "dst").agg(F.count("*").alias("n"), F.min("heid").alias("heid")).where("n > 1")
    add(twice, "duplicate_dart", "heid", F.col("n"))
    add(mesh.edges.where("n_faces > 2"), "nonmanifold_edge", "heid", F.col("n_faces"))
    add(nonmanifold_vertices(mesh), "nonmanifold_vertex", "vid", F.col("n_fans"))
    add(mesh.vertices.join(named, ["mesh_id", "vid"], "left_anti"), "isolated_vertex", "vid", F.lit(""))
    add(mesh.vertices.groupBy("mesh_id", "vid").count().where("count > 1"), "duplicate_id", "vid", F.col("count"))
    add(f.groupBy("mesh_id", "fid").count().where("count > 1"), "duplicate_id", "fid", F.col("count"))
    got = out[0]
    for df in out[1:]:
        got = got.unionByName(df)
    return got


#: Kinds that break a manifold triangle mesh; the others are remarks.
ERRORS = ("dangling_vertex", "repeated_vertex", "face_size", "not_triangular", "degenerate_face", "duplicate_dart", "nonmanifold_edge", "nonmanifold_vertex", "duplicate_id")


def check(mesh: Mesh) -> bool:
    return validate(mesh).where(F.col("kind").isin(*ERRORS)).isEmpty()


def first_error(mesh: Mesh):
    return validate(mesh).where(F.col("kind").isin(*ERRORS)).orderBy("mesh_id", "kind", "element_id").first()


def nonmanifold_edges(mesh: Mesh) -> DataFrame:
    return mesh.edges.where("n_faces > 2")


#: Faces at a vertex up to which its fans are counted within its row; the steps grow with their square.
ROW_FACES = 64


def nonmanifold_vertices(mesh: Mesh) -> DataFrame:
    """Vertices whose faces form more than one fan: border runs, or separate closed fans.

    Around a vertex of a proper mesh at most one border edge comes in.  Two
    closed fans that share a vertex have no border, so fans are counted as
    components of the faces at a vertex over its edges: within a row for the
    usual vertex; by rounds over all of them for hubs, and where a face names a
    vertex twice.
    """
    c = mesh.faces.where(F.size("vs") >= 3).select("mesh_id", "fid", F.size("vs").alias("n"), (F.size(F.array_distinct("vs")) < F.size("vs")).alias("twice"), "vs", F.posexplode("vs").alias("slot", "v"))
    c = c.select("mesh_id", "v", "fid", "twice", F.expr("array(vs[(slot + 1) % n], vs[(slot + n - 1) % n])").alias("ends"))
    hubs = cut(c.groupBy("mesh_id", "v").agg(F.count("*").alias("k"), F.max("twice").alias("twice")).where(f"k > {ROW_FACES} OR twice").select("mesh_id", "v"), "hubs")
    plain = c if hubs.isEmpty() else c.join(hubs, ["mesh_id", "v"], "left_anti")
    touching = lambda x, e: F.arrays_overlap(x, e)
    joined = lambda sets, e: F.array_append(
        F.filter(sets, lambda x: ~touching(x, e)), F.array_distinct(F.concat(F.flatten(F.filter(sets, lambda x: touching(x, e))), e))
    )
    fans = F.aggregate("l", F.array().cast("array<array<bigint>>"), joined, F.size)
    out = plain.groupBy("mesh_id", "v").agg(F.collect_list("ends").alias("l")).select("mesh_id", F.col("v").alias("vid"), fans.cast("long").alias("n_fans")).where("n_fans > 1")
    if hubs.isEmpty():
        return out
    c = c.join(hubs, ["mesh_id", "v"], "left_semi")
    corner = F.struct(F.col("mesh_id").alias("m"), "v", F.col("fid").alias("f"))
    spokes = c.select("mesh_id", "v", F.explode("ends").alias("w"), "fid")
    hub = spokes.groupBy("mesh_id", "v", "w").agg(F.min("fid").alias("hub"))
    star = spokes.join(hub, ["mesh_id", "v", "w"])
    got = connected_components(
        star.select(corner.alias("a"), F.struct(F.col("mesh_id").alias("m"), "v", F.col("hub").alias("f")).alias("b")).unionByName(c.select(corner.alias("a"), corner.alias("b")))
    )
    n = got.groupBy(F.col("id.m").alias("mesh_id"), F.col("id.v").alias("vid")).agg(F.count_distinct("component").alias("n_fans"))
    return out.unionByName(n.where("n_fans > 1"))


def remove_isolated_vertices(mesh: Mesh) -> Mesh:
    used = mesh.faces.select("mesh_id", F.explode("vs").alias("vid")).distinct()
    return mesh.with_vertices(mesh.vertices.join(used, ["mesh_id", "vid"], "left_semi").select(*mesh.vertices.columns))


def remove_degenerate_faces(mesh: Mesh) -> Mesh:
    """Faces that are no triangle, repeat a vertex or are collinear go."""
    a, b, c = v.cols("a"), v.cols("b"), v.cols("c")
    good = mesh.triangles.where("v0 <> v1 AND v1 <> v2 AND v2 <> v0").where(~pr.is_triangle_degenerate_3d(a, b, c)).select("mesh_id", "fid")
    return mesh.with_faces(mesh.faces.join(good, ["mesh_id", "fid"], "left_semi").select(*mesh.faces.columns))


def remove_faces(mesh: Mesh, faces: DataFrame) -> Mesh:
    return mesh.with_faces(mesh.faces.join(faces.select("mesh_id", "fid"), ["mesh_id", "fid"], "left_anti").select(*mesh.faces.columns))


def weld(mesh: Mesh, epsilon: float) -> Mesh:
    """Join vertices closer than ε, transitively; faces with fewer than three corners left go.

    The range join has a grid cell as its equality: a vertex looks into the 27
    cells around its own, and pairs within a cell of many vertices first join
    equal positions, so that repeated points cost no pairs.
    """
    if epsilon <= 0:
        return mesh
    spots = mesh.vertices.groupBy("mesh_id", "x", "y", "z").agg(F.min("vid").alias("rep"))
    cell = spots.select("*", *(F.floor(F.col(k) / epsilon).cast("long").alias("c" + k) for k in "xyz"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> flatten(transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> named_struct('i', i, 'j', j, 'k', k))))))"))
    probe = cell.select("mesh_id", F.col("rep").alias("r0"), *(F.col(k).alias("p" + k) for k in "xyz"), "cx", "cy", "cz", around.alias("o")).select(
        "mesh_id", "r0", "px", "py", "pz", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("cz") + F.col("o.k")).alias("cz")
    )
    near = probe.join(cell, ["mesh_id", "cx", "cy", "cz"]).where((F.col("r0") < F.col("rep")) & (v.distance2(v.cols("p"), v.cols()) < epsilon * epsilon))
    key = lambda c: F.struct(F.col("mesh_id").alias("m"), F.col(c).alias("i"))
    comps = connected_components(near.select(key("r0").alias("a"), key("rep").alias("b")))
    comps = comps.select(F.col("id.m").alias("mesh_id"), F.col("id.i").alias("rep"), F.col("component.i").alias("to"))
    target = spots.join(comps, ["mesh_id", "rep"], "left").select("mesh_id", "x", "y", "z", F.coalesce("to", "rep").alias("to"))
    moved = cut(mesh.vertices.join(target, ["mesh_id", "x", "y", "z"]).select("mesh_id", "vid", "to"), "weld")
    faces = remap_faces(mesh.faces, moved)
    return Mesh(mesh.vertices.join(moved.where("vid = to").select("mesh_id", "vid"), ["mesh_id", "vid"], "left_semi").select(*mesh.vertices.columns), faces)


def remap_faces(faces: DataFrame, moved: DataFrame) -> DataFrame:
    """Replace vertices by (mesh_id, vid, to); faces keep at least three distinct corners or go."""
    c = faces.select("mesh_id", "fid", F.posexplode("vs").alias("slot", "vid")).join(moved, ["mesh_id", "vid"], "left")
    g = c.groupBy("mesh_id", "fid").agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("to", "vid").alias("to")))).alias("l"))
    # neighbours that became one corner collapse; a corner met twice apart makes the face degenerate
    g = g.select("mesh_id", "fid", F.expr("transform(l, x -> x.to)").alias("l"))
    g = g.select("mesh_id", "fid", F.expr("filter(l, (x, i) -> x <> l[(i + 1) % size(l)])").alias("vs"))
    return g.where((F.size("vs") >= 3) & (F.size("vs") == F.size(F.array_distinct("vs"))))


def is_orientation_consistent(mesh: Mesh) -> DataFrame:
    """Per mesh: no directed edge occurs twice."""
    bad = mesh.corners.groupBy("mesh_id", "src", "dst").count().where("count > 1").select("mesh_id").distinct().withColumn("bad", F.lit(True))
    return mesh.vertices.select("mesh_id").distinct().join(bad, "mesh_id", "left").select("mesh_id", F.col("bad").isNull().alias("consistent"))


def _double_cover(mesh: Mesh, lone: bool = True) -> DataFrame:
    """Components of (face, orientation) over interior edges; a component per way to orient.

    Faces that traverse an edge the same way need opposite orientations.  A
    part that can be oriented gives two components, one that cannot gives one.
    A face and its orientation, or its direction along an edge, are one number.
    lone: with faces that have no neighbour.
    """
    c = mesh.corners.select("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("fid") * 2 + (F.col("src") < F.col("dst")).cast("long")).alias("side"))
    hub = c.groupBy("mesh_id", "a", "b").agg(F.count("*").alias("n"), F.min("side").alias("p"), F.max("side").alias("q")).where("n = 2 AND shiftright(p, 1) <> shiftright(q, 1)")
    node = lambda k: F.struct(F.col("mesh_id").alias("m"), F.expr(k).alias("k"))
    # p and q run against each other: they keep their orientation together
    turn = "IF(p % 2 <> q % 2, 0, 1)"
    pairs = [F.struct(node(f"shiftright(p, 1) * 2 + {s}").alias("a"), node(f"shiftright(q, 1) * 2 + abs({turn} - {s})").alias("b")) for s in (0, 1)]
    e = hub.select(F.explode(F.array(*pairs)).alias("e")).select("e.a", "e.b")
    if lone:
        e = e.unionByName(mesh.faces.select("mesh_id", F.explode(F.array(F.col("fid") * 2, F.col("fid") * 2 + 1)).alias("k")).select(node("k").alias("a"), node("k").alias("b")))
    got = connected_components(e, near=True)
    return got.select(F.col("id.m").alias("mesh_id"), F.expr("shiftright(id.k, 1)").alias("fid"), F.expr("CAST(id.k & 1 AS INT)").alias("s"), F.col("component.k").alias("component"))


def is_orientable(mesh: Mesh) -> DataFrame:
    cover = _double_cover(mesh).groupBy("mesh_id", "fid").agg(F.count_distinct("component").alias("k"))
    return cover.groupBy("mesh_id").agg((F.min("k") == 2).alias("orientable"))


def fix_orientation(mesh: Mesh) -> Mesh:
    """Turn faces so that each connected part agrees with its smallest face; parts that cannot stay."""
    cover = _double_cover(mesh, lone=False)
    both = cover.groupBy("mesh_id", "fid").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(F.when(F.col("s") == 1, F.col("component"))).alias("turned"))
    # the component that holds the smallest face unturned is the smaller one: turned faces are in it with s = 1
    flip = both.where("c0 <> c1 AND turned = c0").select("mesh_id", "fid").withColumn("flip", F.lit(True))
    f = mesh.faces.join(flip, ["mesh_id", "fid"], "left")
    turned = F.when(F.col("flip"), F.reverse("vs")).otherwise(F.col("vs")).alias("vs")
    rest = [c for c in mesh.faces.columns if c not in ("mesh_id", "fid", "vs")]
    return mesh.with_faces(f.select("mesh_id", "fid", turned, *rest))


def fill_holes(mesh: Mesh, loops: DataFrame | None = None) -> Mesh:
    """Close border loops by ear clipping in their dominant plane, one kernel call per loop."""
    rim = border_loops(mesh)
    if loops is not None:
        rim = rim.join(loops.select("mesh_id", "loop"), ["mesh_id", "loop"], "left_semi")
    pts = rim.join(mesh.points("src", ""), ["mesh_id", "src"]).select("mesh_id", "loop", "hop", "src", "x", "y", "z")

    def clip(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hop")
        ids = pdf["src"].to_numpy()
        tris = ear_clip(pdf[["x", "y", "z"]].to_numpy()) if len(ids) >= 3 else []
        return pd.DataFrame({"mesh_id": pdf["mesh_id"].iloc[0], "loop": pdf["loop"].iloc[0], "k": range(len(tris)), "vs": [[int(ids[i]) for i in t] for t in tris]})

    made = pts.groupBy("mesh_id", "loop").applyInPandas(clip, "mesh_id string, loop long, k long, vs array<long>")
    # ids behind those in use: loop ids are negative and distinct, so are (loop, k)
    top = mesh.faces.groupBy("mesh_id").agg((F.max("fid") + 1).alias("top"))
    numbered = number_new(cut(made, "caps"), ["loop", "k"]).join(top, "mesh_id").select("mesh_id", (F.col("top") + F.col("rank")).alias("fid"), "vs")
    return mesh.with_faces(mesh.faces.select("mesh_id", "fid", "vs").unionByName(numbered))


def number_new(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, dense from 0 per mesh, in the given order.

    Ranges are numbered in parallel: partition counts are gathered (one number
    per partition and mesh) and added as offsets, so no mesh is sorted in one task.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, "mesh_id", *order).sortWithinPartitions("mesh_id", *order).withColumn("part", F.spark_partition_id())
    held = cut(sorted_, "ranged")
    per = held.groupBy("mesh_id", "part").agg(F.count("*").alias("n"))
    before = per.withColumn("base", F.sum("n").over(W.partitionBy("mesh_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("mesh_id", "part", F.coalesce("base", F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("mesh_id", "part").orderBy(*order)) - 1
    return held.withColumn("i", within).join(before, ["mesh_id", "part"]).withColumn("rank", F.col("base") + F.col("i")).drop("part", "i", "base")


def repair(mesh: Mesh) -> tuple[Mesh, DataFrame]:
    """Fill holes, drop degenerate faces and isolated vertices, orient; and what changed per mesh."""
    steps = [("start", mesh)]
    m = fill_holes(mesh)
    steps.append(("holes_filled", m))
    m = remove_degenerate_faces(m)
    steps.append(("degenerate_removed", m))
    m = remove_isolated_vertices(m)
    steps.append(("isolated_removed", m))
    m = fix_orientation(m)
    stats = None
    for name, step in steps:
        f = step.faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces")).join(step.vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices")), "mesh_id", "outer").withColumn("step", F.lit(name))
        stats = f if stats is None else stats.unionByName(f)
    return m, stats

