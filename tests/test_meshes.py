"""Closed-form values and invariants on generated and hand-written meshes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow import queries
from facetflow.functions import predicates
from facetflow.functions import vec3 as v
from facetflow.functions.polygons import ear_clip
from facetflow.functions.trimesh import TriMesh
from facetflow.mesh import Mesh
from facetflow.operators import attributes, connectivity, csg, edit, fields, geodesics, implicit, linalg, measure, navigate, refine, repair, simplify, smooth, spatial, topology
from facetflow.plans.lineage import cut
from facetflow.sources import formats, generators


def held(mesh):
    return Mesh(cut(mesh.vertices), cut(mesh.faces))


@pytest.fixture(scope="module")
def cube(spark):
    return held(generators.cube(spark, 1.0))


@pytest.fixture(scope="module")
def ico(spark):
    return held(generators.icosphere(spark, 1))


@pytest.fixture(scope="module")
def triangle(spark):
    return held(Mesh.from_lists(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [[0, 1, 2]]))


@pytest.fixture(scope="module")
def quad(spark):
    return held(Mesh.from_lists(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [[0, 1, 2], [0, 2, 3]]))


def sizes(mesh):
    return mesh.vertices.count(), mesh.faces.count()


def test_generators(spark):
    assert sizes(generators.cube(spark)) == (8, 12)
    assert sizes(generators.cylinder(spark, 1, 2, 16)) == (34, 64)
    assert sizes(generators.torus(spark, 1, 0.3, 16, 8)) == (128, 256)
    assert sizes(generators.cone(spark, 1, 2, 16)) == (18, 32)
    assert sizes(generators.grid(spark, 1, 1, 4, 4)) == (25, 32)
    assert sizes(generators.icosahedron(spark)) == (12, 20)
    for m in (generators.cube(spark), generators.cylinder(spark, 1, 2, 16), generators.torus(spark, 1, 0.3, 16, 8), generators.cone(spark, 1, 2, 16)):
        assert measure.volume(m).first().volume > 0
        assert topology.is_closed(m).first().is_closed
    assert generators.uv_sphere(spark, 1, 8, 4).vertices.count() == 45


def test_cube_measures(cube):
    assert measure.surface_area(cube).first().area == pytest.approx(6)
    assert measure.volume(cube).first().volume == pytest.approx(1)
    c = topology.counts(cube).first()
    assert (c.n_vertices, c.n_edges, c.n_faces, c.euler, c.genus, c.n_darts) == (8, 18, 12, 2, 0, 36)
    assert repair.check(cube)


def test_icosphere(spark, ico):
    assert sizes(ico) == (42, 80)
    zero = generators.icosahedron(spark)
    assert measure.surface_area(zero).first().area == pytest.approx(9.574541383)
    assert measure.volume(zero).first().volume == pytest.approx(2.536150710)
    assert measure.edge_stats(zero).first().mean_len == pytest.approx(1.051462224)
    k = measure.curvature(zero).select(F.sum(F.col("gaussian") * F.col("area")).alias("t"), F.min(F.col("gaussian") * F.col("area")).alias("d")).first()
    assert k.t == pytest.approx(4 * math.pi) and k.d == pytest.approx(math.pi / 3)


def test_unit_triangle(triangle):
    g = measure.face_geometry(triangle).first()
    assert g.area == pytest.approx(0.5) and (g.nx, g.ny, g.nz) == pytest.approx((0, 0, 1)) and g.min_angle == pytest.approx(math.pi / 4)
    assert triangle.darts.where("fid IS NULL").count() == 3
    assert not topology.is_closed(triangle).first().is_closed


def test_empty_mesh(spark):
    e = Mesh.empty(spark)
    assert topology.is_empty(e) and topology.counts(e).count() == 0 and measure.surface_area(e).count() == 0
    assert repair.check(e) and connectivity.vertex_components(e).count() == 0


def test_bad_index(spark):
    with pytest.raises(IndexError):
        Mesh.from_lists(spark, [(0, 0, 0)], [[0, 1, 2]])


def test_rings_and_loops(quad, ico):
    r = topology.vertex_rings(ico).groupBy("vid").agg(F.count("*").alias("n"), F.count_distinct("hop").alias("h")).collect()
    assert all(x.n == x.h and x.n in (5, 6) for x in r)
    loops = topology.border_loops(quad).orderBy("hop").collect()
    assert [x.hop for x in loops] == [0, 1, 2, 3] and all(a.dst == b.src for a, b in zip(loops, loops[1:]))


@pytest.mark.parametrize(("name", "want"), [("loop", (162, 320)), ("sqrt3", (122, 240))])
def test_subdivision_counts(ico, name, want):
    m = held({"loop": refine.loop_subdivide, "sqrt3": refine.sqrt3_subdivide}[name](ico))
    assert sizes(m) == want and repair.check(m) and topology.counts(m).first().euler == 2


def test_subdivision_open(triangle, quad):
    assert sizes(refine.loop_subdivide(triangle)) == (6, 4) and sizes(refine.loop_subdivide(quad)) == (9, 8)
    assert sizes(refine.sqrt3_subdivide(triangle)) == (4, 3) and sizes(refine.sqrt3_subdivide(quad)) == (6, 6)
    assert sizes(refine.catmull_clark_subdivide(triangle)) == (7, 6)


def test_catmull_clark_quads(spark):
    q = [[0, 2, 3, 1], [4, 5, 7, 6], [0, 1, 5, 4], [2, 6, 7, 3], [0, 4, 6, 2], [1, 3, 7, 5]]
    pts = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    m = held(refine.catmull_clark_subdivide(Mesh.from_lists(spark, pts, q)))
    assert sizes(m) == (26, 48) and topology.counts(m).first().euler == 2


def test_smoothing(ico):
    assert smooth.laplacian_smooth(ico, 0.0, 3) is ico and smooth.taubin_smooth(ico, 0.5, 0.5, 1) is ico
    small = measure.volume(smooth.laplacian_smooth(ico, 0.5, 2)).first().volume
    assert small < measure.volume(ico).first().volume
    assert sizes(smooth.tangential_smooth(ico)) == (42, 80)


def test_validation_finds_faults(spark):
    pts = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 1, 0), (5, 5, 5)]
    m = Mesh.from_lists(spark, pts, [[0, 1, 2], [0, 1, 3], [0, 1, 3], [1, 1, 3], [0, 1, 2, 3]])
    m = m.with_faces(m.faces.unionByName(spark.createDataFrame([("m", 9, [0, 1, 99])], m.faces.schema)))
    kinds = {x.kind for x in repair.validate(m).select("kind").distinct().collect()}
    assert {"dangling_vertex", "repeated_vertex", "not_triangular", "degenerate_face", "duplicate_dart", "nonmanifold_edge", "isolated_vertex"} <= kinds
    assert not repair.check(m) and repair.first_error(m) is not None


def test_nonmanifold_vertex(spark):
    m = Mesh.from_lists(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0)], [[0, 1, 2], [0, 3, 4]])
    assert [(x.vid, x.n_fans) for x in repair.nonmanifold_vertices(m).collect()] == [(0, 2)]


def test_weld(spark):
    m = Mesh.from_lists(spark, [(0, 0, 0), (0.001, 0, 0), (1, 0, 0)], [])
    assert repair.weld(m, 0.01).vertices.count() == 2 and repair.weld(m, 0).vertices.count() == 3


def test_holes_and_orientation(ico):
    holed = held(repair.remove_faces(ico, ico.faces.where("fid = 3")))
    filled = held(repair.fill_holes(holed))
    assert topology.is_closed(filled).first().is_closed and repair.check(filled)
    turned = held(ico.with_faces(ico.faces.withColumn("vs", F.when(F.col("fid") % 3 == 1, F.reverse("vs")).otherwise(F.col("vs")))))
    assert not repair.is_orientation_consistent(turned).first().consistent
    assert repair.is_orientable(turned).first().orientable
    assert repair.is_orientation_consistent(repair.fix_orientation(turned)).first().consistent


def test_components(spark):
    m = Mesh.from_lists(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (5, 0, 0), (6, 0, 0), (5, 1, 0)], [[0, 1, 2], [3, 4, 5]])
    assert connectivity.component_count(m).first().n_components == 2
    parts = connectivity.split_components(m)
    assert sorted((r.mesh_id, r["count"]) for r in parts.vertices.groupBy("mesh_id").count().collect()) == [("m/0", 3), ("m/1", 3)]
    assert sizes(connectivity.extract_component(m, m.faces.where("fid = 1"))) == (3, 1)
    assert sizes(connectivity.merge_meshes(m, m)) == (12, 4)


def test_edits(quad, ico):
    m, s = edit.flip_edges(quad, quad.edges.where("a = 0 AND b = 2"))
    assert [x.status for x in s.collect()] == ["ok"] and m.edges.where("a = 1 AND b = 3").count() == 1
    _, s = edit.flip_edges(quad, quad.edges.where("a = 0 AND b = 1"))
    assert [x.status for x in s.collect()] == ["border"]
    m, s = edit.collapse_edges(ico, ico.edges.orderBy("a", "b").limit(1))
    assert [x.status for x in s.collect()] == ["ok"] and sizes(m) == (41, 78) and repair.check(held(m))
    m = held(edit.split_edges(quad, quad.edges.where("a = 0 AND b = 2")))
    assert sizes(m) == (5, 4) and repair.check(m)
    assert sizes(edit.split_edges(quad, quad.edges)) == (9, 8)
    assert sizes(edit.split_faces(quad)) == (6, 6)
    assert sizes(edit.extrude_region(quad, quad.faces, (0, 0, 1))) == (8, 10)
    assert sizes(edit.extrude_faces(quad, quad.faces.where("fid = 0"), (0, 0, 1))) == (7, 8)
    with pytest.raises(ValueError):
        edit.extrude_region(quad, quad.faces, (0, 0, 0))


def test_add_triangles(spark, quad):
    new = spark.createDataFrame([("m", [0, 1, 9]), ("m", [0, 0, 1]), ("m", [0, 1, 2])], "mesh_id string, vs array<long>")
    _, s = edit.add_triangles(quad, new)
    assert sorted(x.status for x in s.collect()) == ["missing_vertex", "nonmanifold", "repeated_vertex"]


def test_rays_and_nearest(spark, cube):
    rays = spark.createDataFrame([(0, 0.1, 0.2, 5.0, 0.0, 0.0, -1.0), (1, 0.1, 0.2, 0.0, 0.3, 0.2, 0.9), (2, 9.0, 9.0, 9.0, 1.0, 0.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    first = {x.ray_id: x.t for x in spatial.ray_first_hit(cube, rays).collect()}
    assert first[0] == pytest.approx(4.5) and 2 not in first
    odd = {x.ray_id: x.inside for x in spatial.ray_parity(cube, rays).collect()}
    assert odd == {0: False, 1: True}
    pts = spark.createDataFrame([(0, 0.0, 0.0, 3.0), (1, 0.1, 0.0, 0.0), (2, 2.0, 2.0, 2.0)], "pt_id long, x double, y double, z double")
    got = {x.pt_id: x.d2 for x in spatial.nearest_point(cube, pts).collect()}
    assert got == pytest.approx({0: 6.25, 1: 0.16, 2: 3 * 1.5**2})


def test_solvers(spark):
    n = 30
    a = [("m", i, i, 2.5) for i in range(n)] + [("m", i, j, -1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    coo = spark.createDataFrame(a, "mesh_id string, i long, j long, v double")
    rhs = spark.createDataFrame([("m", i, float(i % 3)) for i in range(n)], "mesh_id string, i long, b double")
    dense = np.zeros((n, n))
    for _, i, j, x in a:
        dense[i, j] += x
    want = np.linalg.solve(dense, np.array([float(i % 3) for i in range(n)]))
    for sym in (True, False):
        got = np.array([r.x for r in linalg.solve(coo, rhs, symmetric=sym).orderBy("i").collect()])
        assert np.allclose(got, want, atol=1e-6)
    got = np.array([r.x for r in linalg.solve_distributed(coo, rhs, max_iter=40).orderBy("i").collect()])
    assert np.allclose(got, want, atol=1e-4)


def test_geodesics(spark, ico):
    src = spark.createDataFrame([("icosphere", 0)], "mesh_id string, vid long")
    edge = {x.vid: x.distance for x in geodesics.dijkstra(ico, src).collect()}
    exact = {x.vid: x.distance for x in geodesics.exact_geodesic(ico, src).collect()}
    heat = {x.vid: x.distance for x in geodesics.heat_geodesic(ico, src).collect()}
    far = {x.vid: x.distance for x in geodesics.dijkstra_distributed(ico, src).collect()}
    assert edge == pytest.approx(far)
    assert edge[0] == exact[0] == 0 and all(exact[k] <= edge[k] + 1e-9 for k in edge)
    assert 2.8 < max(exact.values()) <= math.pi + 1e-6 and abs(max(heat.values()) - max(exact.values())) < 0.6
    to = spark.createDataFrame([("icosphere", 5)], "mesh_id string, vid long")
    p = geodesics.shortest_paths(ico, src, to).first().path
    assert p[0] == 0 and p[-1] == 5


def test_geodesics_never_stop_silently(spark, ico):
    src = spark.createDataFrame([(ico.vertices.first().mesh_id, 0)], "mesh_id string, vid long")
    with pytest.raises(RuntimeError):
        geodesics.dijkstra_distributed(ico, src, max_rounds=2).count()
    points = np.array([(float(x), float(y), 0.0) for y in range(4) for x in range(4)])
    faces = [t for y in range(3) for x in range(3) for a in (4 * y + x,) for t in ((a, a + 1, a + 5), (a, a + 5, a + 4))]
    with pytest.raises(RuntimeError):
        geodesics.window_kernel(points, faces, [0], cap=0)
    assert np.allclose(geodesics.window_kernel(points, faces, [0]), np.hypot(points[:, 0], points[:, 1]))


def test_exact_geodesic_on_plane(spark):
    g = held(generators.grid(spark, 4, 4, 4, 4))
    src = spark.createDataFrame([("grid", 0)], "mesh_id string, vid long")
    p = {x.vid: (x.x, x.z) for x in g.vertices.collect()}
    for x in geodesics.exact_geodesic(g, src).collect():
        assert x.distance == pytest.approx(math.dist(p[0], p[x.vid]), abs=1e-6)


def test_parameterization(spark):
    g = held(generators.grid(spark, 4, 4, 4, 4))
    for fn in (fields.tutte_embedding, fields.harmonic_parameterization, fields.mean_value_parameterization):
        uv = {x.vid: (x.u, x.v) for x in fn(g).collect()}
        assert len(uv) == 25 and all(u * u + v * v <= 1 + 1e-9 for u, v in uv.values())
        area = [(uv[b][0] - uv[a][0]) * (uv[c][1] - uv[a][1]) - (uv[b][1] - uv[a][1]) * (uv[c][0] - uv[a][0]) for a, b, c in (f.vs for f in g.faces.collect())]
        assert all(x > 0 for x in area) or all(x < 0 for x in area)
    uv = {x.vid: (x.u, x.v) for x in fields.lscm(g).collect()}
    p = {x.vid: (x.x, x.z) for x in g.vertices.collect()}
    assert math.dist(uv[0], uv[1]) * math.dist(p[0], p[24]) == pytest.approx(math.dist(p[0], p[1]), rel=1e-3)
    assert fields.two_point_harmonic(g).count() == 25
    assert fields.tutte_embedding(held(generators.cube(spark))).count() == 0


def test_deformation(spark):
    g = held(generators.grid(spark, 4, 4, 4, 4))
    pins = g.vertices.where("vid < 5 OR vid >= 20").select("mesh_id", "vid", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    p = {x.vid: (x.x, x.y, x.z) for x in g.vertices.collect()}
    for out in (fields.laplacian_deformation(g, pins), fields.arap_deformation(g, pins, 3)):
        for x in out.collect():
            assert (x.x, x.y, x.z) == pytest.approx(p[x.vid], abs=1e-6)
    assert fields.harmonic_map(g, pins).count() == 25
    assert fields.scale_factors(g, g.vertices.select("mesh_id", "vid", F.lit(0.0).alias("k"))).count() == 25


def test_mobius(spark):
    co = fields.mobius_to_center((0.3, -0.2))
    u, v = fields.mobius(F.lit(0.3), F.lit(-0.2), *co)
    r = spark.range(1).select(u.alias("u"), v.alias("v")).first()
    assert (r.u, r.v) == pytest.approx((0, 0))


@pytest.mark.parametrize("n", [1, 2, 4])
def test_singularities_sum_to_euler(ico, n):
    theta = cut(fields.smoothest_field(ico, n))
    total = fields.singularities(ico, theta, n).agg(F.sum("index")).first()[0]
    assert total == pytest.approx(2, abs=1e-6)


def test_marching_cubes(spark):
    assert sum(len(c) for c in implicit.cases()) > 700 and implicit.cases()[0] == implicit.cases()[255] == []
    m = held(implicit.march_sdf(spark, implicit.Sphere(radius=0.8), implicit.Grid((12, 12, 12), (-1.2, -1.2, -1.2), (0.2, 0.2, 0.2))))
    assert repair.is_orientation_consistent(m).first().consistent and topology.is_closed(m).first().is_closed
    assert topology.counts(m).first().euler == 2
    assert measure.volume(m).first().volume == pytest.approx(4 / 3 * math.pi * 0.8**3, rel=0.06)


def test_sdf(spark):
    a, b = implicit.Sphere(), implicit.Translate(implicit.Box((0.5, 0.5, 0.5)), (1.0, 0.0, 0.0))
    x = tuple(F.lit(c) for c in (2.0, 0.0, 0.0))
    row = spark.range(1).select(*(s.eval(*x).alias(str(i)) for i, s in enumerate((a, b, a | b, a & b, a - b, implicit.SmoothUnion(a, b, 0.1), implicit.Capsule(), implicit.Torus())))).first()
    assert list(row) == pytest.approx([1, 0.5, 0.5, 1, 1, 0.5, 1.5, 0.75])


def test_booleans(spark):
    a = held(generators.cube(spark, 2.0, "a"))
    b = held(edit.translated(generators.cube(spark, 2.0, "b"), (0.7, 0.6, 0.5)))
    far = held(edit.translated(generators.cube(spark, 2.0, "c"), (9, 0, 0)))
    inter = 1.3 * 1.4 * 1.5
    vol = lambda m: (measure.volume(m).first() or [0, 0])[-1]
    assert vol(csg.union(a, b)) == pytest.approx(16 - inter)
    assert vol(csg.intersection(a, b)) == pytest.approx(inter)
    assert vol(csg.difference(a, b)) == pytest.approx(8 - inter)
    assert csg.union(a, far).faces.count() == 24 and csg.intersection(a, far).faces.count() == 0
    assert csg.difference(a, a).faces.count() == 0


def test_simplification(spark):
    ico2 = held(generators.icosphere(spark, 2))
    m = held(simplify.decimate(ico2, 100))
    assert m.faces.count() <= 100 and repair.check(m) and topology.counts(m).first().euler == 2
    s = simplify.remesh_stats(ico2).first()
    assert s.n_faces > 0
    assert simplify.quick_remesh(ico2).faces.count() == s.n_faces
    d = simplify.intrinsic_delaunay_stats(ico2).first()
    assert d.not_delaunay == 0 and d.n_edges == 480
    assert simplify.target_length(ico2).first().target > 0


def test_ear_clipping():
    shape = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    area = lambda t: abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[1][1] - t[0][1]) * (t[2][0] - t[0][0])) / 2
    for pts in (shape, shape[::-1]):
        tris = ear_clip(pts)
        assert len(tris) == 4 and sum(area([pts[i] for i in t]) for t in tris) == pytest.approx(3)
    assert ear_clip(shape[:2]) == [] and len(ear_clip([(*p, 0.5) for p in shape])) == 4


def test_trimesh_kernel():
    m = TriMesh(np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], float), [[0, 1, 2], [0, 2, 3]])
    assert m.flip(0, 2) and m.edges() == [(0, 1), (0, 3), (1, 2), (1, 3), (2, 3)] and not m.flip(0, 1)
    m.split_edge(1, 3)
    assert len(m.f) == 4 and not m.collapse(0, 1, m.p[0])


@pytest.mark.parametrize("kind", sorted(formats.WRITERS))
def test_formats_round_trip(spark, kind):
    m = held(generators.icosahedron(spark))
    data = bytes(formats.format_meshes(m, kind).first().content)
    s = formats.parse("x." + kind.split("_")[0], data)
    assert len(s.points) == 12 and len(s.faces) == 20
    again = formats.WRITERS[kind](s)
    assert len(formats.parse("x." + kind.split("_")[0], again).faces) == 20


def test_read_and_save(spark, tmp_path):
    formats.save_meshes(held(generators.cube(spark)), str(tmp_path / "out"), "obj")
    (tmp_path / "out" / "bad.off").write_text("OFF\n1 1 0\n0 0 0\n3 0 1 2\n")
    mesh, failed = formats.read_meshes(spark, str(tmp_path / "out"))
    assert sizes(mesh) == (8, 12) and [x.mesh_id for x in failed.collect()] == ["bad.off"]


def test_obj_details():
    s = formats.parse_obj(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 1\nvn 0 0 1\nf -3/1/1 -2//1 -1\n")
    assert s.faces == [[0, 1, 2]] and s.uvs[0].tolist() == [0, 1] and s.normals[1].tolist() == [0, 0, 1]
    for bad in (b"v 0 0 0\nf 0 1 1\n", b"v 0 0\n", b"v 0 0 0\nf 1 2 3\n"):
        with pytest.raises(formats.MeshError):
            formats.parse_obj(bad)


def test_attributes(cube):
    m = attributes.add_builtin(cube, "vertex_size")
    m = attributes.set_property(m, "vertex", "size", m.vertices.where("vid < 3").select("mesh_id", "vid", F.lit(2.0).alias("value")))
    assert attributes.property_count(m, "vertex", "size").first().n == 3
    m = attributes.select(m, "face", m.faces.where("fid < 5"))
    assert attributes.count_selected(attributes.toggle(m, "face", m.faces.where("fid < 1")), "face").first().n == 4
    n = attributes.populate_normals(cube)
    assert n.faces.where("n_x IS NULL").count() == 0
    e = attributes.select_edges(cube, cube.corners.where("heid = 0"))
    assert attributes.count_selected(e, "dart").first().n == 2 and attributes.selected_edges(e).count() == 1


def test_navigation(cube):
    q = navigate.MeshQuery.darts(cube)
    back = q.ccw_rotated().cw_rotated().run()
    assert back.where("start <> at").count() == 0
    assert navigate.MeshQuery.faces(cube).dart().face().run().where("start <> at").count() == 0
    with pytest.raises(TypeError):
        navigate.MeshQuery.vertices(cube).twin()


def test_streaming(spark, tmp_path):
    from facetflow.streaming import measures

    t = spark.createDataFrame([("m", i * 60) for i in range(30)], "mesh_id string, s long").select(
        "mesh_id", F.timestamp_seconds("s").alias("ts"), *(F.lit(float(x)).alias(c) for c, x in zip(["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"], [0, 0, 0, 1, 0, 0, 0, 1, 0]))
    )
    t.write.parquet(str(tmp_path / "in"))
    got = measures.run_once(measures.windowed_area(measures.triangle_stream(spark, str(tmp_path / "in"))), "areas", "complete", str(tmp_path / "ck"))
    assert sorted(x.area for x in got.collect()) == pytest.approx([5.0, 5.0, 5.0])


def test_a_polygon_of_too_many_corners_raises(spark):
    vertices = spark.range(5000).selectExpr("'m' AS mesh_id", "id AS vid", "cos(id) AS x", "sin(id) AS y", "0D AS z")
    face = lambda n: Mesh(vertices, spark.createDataFrame([("m", 0, list(range(n)))], "mesh_id string, fid long, vs array<long>"))
    assert face(4096).corners.select("heid").distinct().count() == 4096
    with pytest.raises(Exception, match="more than 4096 corners"):
        face(4097).corners.select("heid").collect()


def test_orient3d_is_expanded_by_rows_as_the_sql_of_its_query(spark):
    # one triangle of the terrain whose determinant lies on a half of the third digit
    t = spark.createDataFrame([(69.0, 103.0, 4.6486674, 70.0, 102.0, 0.938282, 70.0, 103.0, 3.689362)], "ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    ax, ay, az, bx, by, bz, cx, cy, cz = t.first()
    want = ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)
    assert t.select(predicates.orient3d(v.cols("a"), v.cols("b"), v.cols("c"), v.lit(0, 0, 0)).alias("d")).first().d == want


def uneven_fan(spark):
    """A closed fan of six whose rim's heights cancel: a plain sum loses the small ones."""
    rim = [(math.cos(i * math.pi / 3), math.sin(i * math.pi / 3), z) for i, z in enumerate([1e16, 1.0, 3.0, -1e16, 1.0, 1.0])]
    return Mesh.from_lists(spark, [(0.0, 0.0, 0.0), *rim], [[0, i + 1, (i + 1) % 6 + 1] for i in range(6)])


def test_loop_even_rule_sums_the_same_in_any_order(spark):
    got = refine.loop_subdivide(uneven_fan(spark)).vertices.where("vid = 0").first().z
    assert got == pytest.approx(6.0 / 16)


def test_queries_round_halves_as_duckdb_does(spark, duck):
    xs = [3.2118349999999998, 2.404565, -3.2118349999999998, 0.5, 0.0, -0.0]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(queries.halves("x", 5).alias("y")).collect()]
    assert got == [duck.sql(f"SELECT round({x!r}::DOUBLE, 5) + 0.0").fetchall()[0][0] for x in xs]


def test_ring_mean_sums_the_same_in_any_order(spark):
    got = smooth.ring_mean(uneven_fan(spark)).where("vid = 0").first().mz
    assert got == 1.0
