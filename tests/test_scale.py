"""Plans and results of steps that must hold on large meshes."""

import pytest
from pyspark.sql import functions as F

from facetflow.mesh import Mesh
from facetflow.operators import edit, repair, topology
from facetflow.plans import components
from facetflow.sources.derive import terrain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def land(spark, sf):
    return terrain(spark, sf)


def test_corners_are_never_broadcast_by_guess(land):
    assert "Broadcast" not in plan(land.paired)
    assert "Broadcast" not in plan(land.darts)
    assert "Broadcast" not in plan(land.corners.join(land.points("src", "p"), ["mesh_id", "src"]))
    assert "Broadcast" not in plan(land.adjacency.join(land.points("dst", "q"), ["mesh_id", "dst"]))


def test_triangles_without_aggregate(land):
    assert "Aggregate" not in plan(land.triangles) and "Broadcast" not in plan(land.triangles)


def test_triangles_dealt_over_parts(land):
    wide = Mesh(land.vertices, land.faces, parts=9)
    assert ", 9), REPARTITION_BY_NUM" in plan(wide.triangles)
    both = [sorted(map(tuple, m.triangles.collect())) for m in (land, wide)]
    assert both[0] == both[1] and len(both[0]) == land.faces.count()


def test_triangles_leave_out_others(spark):
    m = Mesh.from_lists(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [[0, 1, 2, 3], [2, 3, 0]])
    dangling = m.faces.where("fid = 1").select("mesh_id", F.lit(7).cast("long").alias("fid"), F.array(*(F.lit(x).cast("long") for x in (0, 1, 9))).alias("vs"))
    t = m.with_faces(m.faces.unionByName(dangling)).triangles.collect()
    assert [(x.fid, x.v0, x.v1, x.v2, x.ax, x.by, x.cx) for x in t] == [(1, 2, 3, 0, 1.0, 1.0, 0.0)]


def fan(hub, rim, first):
    """Closed fan of triangles around ``hub``."""
    return [[hub, first + i, first + (i + 1) % rim] for i in range(rim)]


def test_two_ring_without_pairs_of_edges(spark, land):
    assert "Join" not in plan(topology.two_ring(land))
    faces = fan(0, 6, 1) + [[1, 7, 2], [1, 1, 8], [2, 7, 9, 10]]
    m = Mesh.from_lists(spark, [(i, i % 3, 0) for i in range(11)], faces)
    near = {(r.src, r.dst) for r in m.adjacency.collect()}
    far = {(a, d) for a, b in near for c, d in near if b == c and a != d} - near
    got = [(r.vid, r.nbr) for r in topology.two_ring(m).collect()]
    assert len(got) == len(set(got)) and set(got) == far


@pytest.mark.parametrize("bound", [64, 3])
def test_fans_in_a_row_and_by_rounds(spark, monkeypatch, bound):
    monkeypatch.setattr(repair, "ROW_FACES", bound)
    two = fan(0, 4, 1) + fan(0, 5, 5)  # two closed fans share vertex 0
    open_ = [[10, 11, 12], [10, 13, 14]]  # two triangles share a corner
    quads = [[20, 21, 22, 23], [20, 23, 24, 25]]  # one fan of quads around 20
    m = Mesh.from_lists(spark, [(i, i * i, 0) for i in range(26)], two + open_ + quads)
    assert sorted((r.vid, r.n_fans) for r in repair.nonmanifold_vertices(m).collect()) == [(0, 2), (10, 2)]


def test_validation_counts_fans_without_rounds(spark, land, monkeypatch):
    def rounds(*_):
        raise AssertionError("no vertex of the terrain is a hub")

    monkeypatch.setattr(repair, "connected_components", rounds)
    assert repair.validate(land).isEmpty()
    cut_off = land.faces.where("fid = 0").select("mesh_id", F.lit(-1).cast("long").alias("fid"), F.array(F.lit(0), F.lit(1), F.lit(10**9)).cast("array<bigint>").alias("vs"))
    bad = repair.validate(land.with_faces(land.faces.unionByName(cut_off))).where("kind = 'dangling_vertex'").collect()
    assert [(r.element_id, r.detail) for r in bad] == [(-1, str(10**9))]


def test_ranges_of_ids_go_first(spark, monkeypatch):
    pairs = [(i, i + 3) for i in range(0, 300) if i % 50] + [(7, 900), (900, 1200), (1500, 1500)]
    text = lambda i: f"m{i % 1}"
    e = spark.createDataFrame([((text(i), i), (text(j), j)) for i, j in pairs], "a struct<m:string,k:long>, b struct<m:string,k:long>")
    want = {(r.id.k, r.component.k) for r in components.connected_components(e).collect()}
    monkeypatch.setattr(components, "DRIVER_EDGES", 5)
    monkeypatch.setattr(components, "NEAR_EDGES", 40)
    got = [(r.id.k, r.component.k) for r in components.connected_components(e, near=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_orientation_over_ranges(land, monkeypatch):
    monkeypatch.setattr(components, "DRIVER_EDGES", 500)
    monkeypatch.setattr(components, "NEAR_EDGES", 2_000)
    turned = land.faces.withColumn("vs", F.when(F.col("fid") % 10 == 1, F.reverse("vs")).otherwise(F.col("vs")))
    fixed = repair.fix_orientation(land.with_faces(turned))
    assert repair.is_orientation_consistent(fixed).first().consistent
    assert fixed.faces.exceptAll(land.faces).isEmpty() and fixed.faces.count() == land.faces.count()
    assert repair.is_orientable(land).first().orientable


def test_collapses_are_those_of_all_touched_vertices(land):
    e = land.edges.select("mesh_id", "a", "b").where("a % 3 > 0")
    reach = e.select("mesh_id", "a", "b", F.explode(F.array("a", "b")).alias("src"))
    near = reach.join(land.adjacency, ["mesh_id", "src"]).select("mesh_id", "a", "b", F.col("dst").alias("what")).unionByName(reach.select("mesh_id", "a", "b", F.col("src").alias("what"))).distinct()
    want = {(r.a, r.b) for r in edit._independent(e, near).where("won").collect()}
    assert {(r.a, r.b) for r in edit._apart(e, topology.stars(land)).collect()} == want and want
    _, status = edit.collapse_edges(land, land.edges)
    assert status.count() == land.edges.count() and status.where("status = 'ok'").count() > 0
