"""Queries over meshes derived from the benchmark tables, and their SQL.

Each query runs over its whole tables.  Floats are rounded in both engines, and
``+ 0.0`` removes negative zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as pr
from .functions import triangle as tri
from .functions import vec3 as v
from .functions.polygons import fan
from .mesh import SLOTS, Mesh
from .operators import attributes, connectivity, edit, fields, geodesics, implicit, linalg, measure, navigate, refine, repair, simplify, smooth, spatial, topology
from .operators import csg
from .plans.lineage import cut
from .sources import formats, generators
from .sources.derive import TERRAIN_SQL, event_points, event_rays, point_cloud, terrain, tiles

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: str = TERRAIN_SQL):
    """Register a function under its name, with the SQL that follows the prelude."""

    def add(fn):
        Q[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = f"WITH {prelude}{sql}" if sql.startswith(",") else f"WITH {prelude}\n{sql}"
        return fn

    return add


def r(col, n: int = 4):
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, n) + F.lit(0.0)


def rounded(df: DataFrame, n: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*((r(c, n).alias(c) if t == "double" and c not in keep else F.col(c)) for c, t in df.dtypes if c != "mesh_id"))


def halves(col, n: int):
    """Rounded as DuckDB rounds: a half of the product, not of the shortest decimal, goes away from zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col * F.lit(10.0**n)) / F.lit(10.0**n) + F.lit(0.0)


def rr(x: str, name: str, n: int = 4) -> str:
    return f"round({x}, {n}) + 0.0 AS {name}"


# counts and adjacency


@query("""SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM f) AS n_faces, count(*) AS n_edges,
 CAST(sum(CASE WHEN n_faces = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_border_edges, CAST(sum(greatest(n_faces, 2)) AS BIGINT) AS n_darts,
 (SELECT count(*) FROM v) - count(*) + (SELECT count(*) FROM f) AS euler, (2 - ((SELECT count(*) FROM v) - count(*) + (SELECT count(*) FROM f))) // 2 AS genus FROM e""")
def mesh_counts(spark, sf):
    return topology.counts(terrain(spark, sf)).drop("mesh_id")


@query("SELECT src, dst FROM h WHERE NOT EXISTS (SELECT 1 FROM h t WHERE t.src = h.dst AND t.dst = h.src)")
def border_darts(spark, sf):
    return topology.border_darts(terrain(spark, sf)).select("src", "dst")


@query("SELECT a, b, CAST(n_faces AS INT) AS n_faces FROM e")
def undirected_edges(spark, sf):
    return terrain(spark, sf).edges.select("a", "b", "n_faces")


@query(f"""SELECT h.fid * {SLOTS} + h.slot AS heid, h.src, h.dst, h.opp, h.fid * {SLOTS} + (h.slot + 1) % 3 AS next, h.fid * {SLOTS} + (h.slot + 2) % 3 AS prev, t.fid * {SLOTS} + t.slot AS twin
 FROM h LEFT JOIN h t ON t.src = h.dst AND t.dst = h.src""")
def interior_darts(spark, sf):
    return terrain(spark, sf).paired.select("heid", "src", "dst", "opp", "next", "prev", "twin")


@query(f"""SELECT -(h.fid * {SLOTS} + h.slot) - 1 AS heid, h.dst AS src, h.src AS dst,
 -(n.fid * {SLOTS} + n.slot) - 1 AS next FROM h JOIN h n ON n.dst = h.src
 WHERE NOT EXISTS (SELECT 1 FROM h t WHERE t.src = h.dst AND t.dst = h.src) AND NOT EXISTS (SELECT 1 FROM h t WHERE t.src = n.dst AND t.dst = n.src)""")
def border_successors(spark, sf):
    return terrain(spark, sf).darts.where("fid IS NULL").select("heid", "src", "dst", "next")


@query("SELECT valence, count(*) AS n FROM (SELECT v.vid, count(adj.dst) AS valence FROM v LEFT JOIN adj ON adj.src = v.vid GROUP BY v.vid) GROUP BY valence")
def valence_histogram(spark, sf):
    return topology.valence(terrain(spark, sf)).groupBy("valence").agg(F.count("*").alias("n"))


@query("SELECT max(k) AS max_valence FROM (SELECT count(*) AS k FROM adj GROUP BY src)")
def max_valence(spark, sf):
    return topology.max_valence(terrain(spark, sf)).select("max_valence")


@query("SELECT src AS vid, dst AS nbr FROM adj")
def vertex_neighbors(spark, sf):
    return topology.vertex_neighbors(terrain(spark, sf)).select("vid", "nbr")


@query("SELECT src AS vid, count(*) AS n_faces, CAST(sum(fid) AS BIGINT) AS fid_sum FROM h GROUP BY src")
def vertex_faces(spark, sf):
    return topology.vertex_faces(terrain(spark, sf)).groupBy("vid").agg(F.count("*").alias("n_faces"), F.sum("fid").alias("fid_sum"))


@query("SELECT vid, count(*) AS n_edges FROM (SELECT a AS vid FROM e UNION ALL SELECT b FROM e) GROUP BY vid")
def vertex_edges(spark, sf):
    return topology.vertex_edges(terrain(spark, sf)).groupBy("vid").agg(F.count("*").alias("n_edges"))


@query("SELECT fid, v1 AS t0, v2 AS t1, v0 AS t2 FROM f")
def face_tips(spark, sf):
    return topology.face_vertices(terrain(spark, sf)).select("fid", F.col("vs")[0].alias("t0"), F.col("vs")[1].alias("t1"), F.col("vs")[2].alias("t2"))


@query("""SELECT vid, count(*) AS n FROM (SELECT DISTINCT p.src AS vid, q2.dst AS far FROM adj p JOIN adj q2 ON q2.src = p.dst WHERE p.src <> q2.dst) x
 WHERE NOT EXISTS (SELECT 1 FROM adj z WHERE z.src = x.vid AND z.dst = x.far) GROUP BY vid""")
def two_ring_sizes(spark, sf):
    return topology.two_ring(terrain(spark, sf)).groupBy("vid").agg(F.count("*").alias("n"))


@query("SELECT CAST(x + y AS INT) AS hop, vid FROM v WHERE x + y <= 10")
def k_disk_of_corner(spark, sf):
    mesh = terrain(spark, sf)
    seed = spark.createDataFrame([("terrain", 0)], "mesh_id string, vid long")
    return topology.k_disk(mesh, seed, 10).select("hop", "vid")


@query("SELECT vid FROM v WHERE x + y = 4")
def k_ring_of_corner(spark, sf):
    seed = spark.createDataFrame([("terrain", 0)], "mesh_id string, vid long")
    return topology.k_ring(terrain(spark, sf), seed, 4).select("vid")


@query("SELECT DISTINCT vid FROM (SELECT a AS vid FROM e WHERE n_faces = 1 UNION ALL SELECT b FROM e WHERE n_faces = 1)")
def border_vertices(spark, sf):
    return topology.border_vertices(terrain(spark, sf)).select("vid")


@query("SELECT count(*) = 0 AS is_closed FROM e WHERE n_faces = 1")
def closed_mesh(spark, sf):
    return topology.is_closed(terrain(spark, sf)).select("is_closed")


@query("SELECT count(*) AS n_loops, max(k) AS longest FROM (SELECT 1 AS one, count(*) AS k FROM e WHERE n_faces = 1)")
def border_loop_lengths(spark, sf):
    loops = topology.border_loops(terrain(spark, sf)).groupBy("loop").agg(F.count("*").alias("k"))
    return loops.agg(F.count("*").alias("n_loops"), F.max("k").alias("longest"))


@query("SELECT vid, count(*) AS ring, CAST(count(*) - 1 AS BIGINT) AS last_hop FROM (SELECT src AS vid FROM h) GROUP BY vid")
def ordered_rings(spark, sf):
    return topology.vertex_rings(terrain(spark, sf)).groupBy("vid").agg(F.count("*").alias("ring"), F.max("hop").alias("last_hop"))


# geometry


@query(f"SELECT a, b, {rr('sqrt((p.x - q2.x) ** 2 + (p.y - q2.y) ** 2 + (p.z - q2.z) ** 2)', 'length', 6)} FROM e JOIN v p ON p.vid = a JOIN v q2 ON q2.vid = b")
def edge_length(spark, sf):
    return measure.edge_lengths(terrain(spark, sf)).select("a", "b", r("length", 6).alias("length"))


@query(f"SELECT fid, {rr('n2 / 2', 'area', 6)}, {rr('nx / n2', 'nx', 6)}, {rr('ny / n2', 'ny', 6)}, {rr('nz / n2', 'nz', 6)} FROM ta")
def face_area_normal(spark, sf):
    return rounded(measure.face_geometry(terrain(spark, sf)).select("fid", "area", "nx", "ny", "nz"), 6)


def _angle(p: str, q: str, o: str) -> str:
    """Angle at o of a triangle with corner columns (ax, ay, az) …"""
    c = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}
    d = " + ".join(f"({i} - {k}) * ({j} - {k})" for i, j, k in zip(c[p], c[q], c[o]))
    n = [" + ".join(f"({i} - {k}) * ({i} - {k})" for i, k in zip(c[x], c[o])) for x in (p, q)]
    return f"acos(({d}) / (sqrt({n[0]}) * sqrt({n[1]})))"


ANGLES = {"a": _angle("b", "c", "a"), "b": _angle("c", "a", "b"), "c": _angle("a", "b", "c")}


@query(f"SELECT fid, {rr('least(' + ', '.join(ANGLES.values()) + ')', 'min_angle', 5)} FROM t")
def face_min_angle(spark, sf):
    return measure.face_geometry(terrain(spark, sf)).select("fid", r("min_angle", 5).alias("min_angle"))


VN = """, vs AS (SELECT vid, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM (SELECT v0 AS vid, nx, ny, nz FROM ta UNION ALL SELECT v1, nx, ny, nz FROM ta UNION ALL SELECT v2, nx, ny, nz FROM ta) GROUP BY vid),
vn AS (SELECT vid, sx / sqrt(sx * sx + sy * sy + sz * sz) AS nx, sy / sqrt(sx * sx + sy * sy + sz * sz) AS ny, sz / sqrt(sx * sx + sy * sy + sz * sz) AS nz FROM vs)"""


@query(VN + f" SELECT vid, {rr('nx', 'nx', 5)}, {rr('ny', 'ny', 5)}, {rr('nz', 'nz', 5)} FROM vn")
def vertex_normal(spark, sf):
    return rounded(measure.vertex_normals(terrain(spark, sf)), 5)


@query(f"SELECT fid, {rr('n2 / 2', 'area', 5)}, {rr('nz / n2', 'nz', 5)} FROM ta")
def polygon_area_normal(spark, sf):
    return measure.polygon_geometry(terrain(spark, sf)).select("fid", r("area", 5).alias("area"), r("nz", 5).alias("nz"))


COT = """, ct AS (SELECT least(i, j) AS a, greatest(i, j) AS b, c FROM (
 SELECT v1 AS i, v2 AS j, (ux * wx + uy * wy + uz * wz) / n2 AS c FROM ta
 UNION ALL SELECT v2, v0, ((cx - bx) * (ax - bx) + (cy - by_) * (ay - by_) + (cz - bz) * (az - bz)) / n2 FROM ta
 UNION ALL SELECT v0, v1, ((ax - cx) * (bx - cx) + (ay - cy) * (by_ - cy) + (az - cz) * (bz - cz)) / n2 FROM ta)),
cw AS (SELECT a, b, sum(c) AS w FROM ct GROUP BY a, b),
cd AS (SELECT a AS src, b AS dst, w FROM cw UNION ALL SELECT b, a, w FROM cw),
lap AS (SELECT src AS vid, sum(w * (q2.x - p.x)) AS lx, sum(w * (q2.y - p.y)) AS ly, sum(w * (q2.z - p.z)) AS lz FROM cd JOIN v p ON p.vid = src JOIN v q2 ON q2.vid = dst GROUP BY src)"""


@query(COT + f" SELECT a, b, {rr('w', 'w', 5)} FROM cw")
def cotan_edge_weight(spark, sf):
    return rounded(measure.cotan_weights(terrain(spark, sf)), 5)


@query(COT + f" SELECT vid, {rr('lx', 'lx')}, {rr('ly', 'ly')}, {rr('lz', 'lz')} FROM lap")
def cotan_laplacian(spark, sf):
    return rounded(measure.cotan_laplacian(terrain(spark, sf)))


@query(COT + f", d AS (SELECT src AS i, src AS j, sum(w) / 2 AS v FROM cd GROUP BY src UNION ALL SELECT src, dst, -w / 2 FROM cd) SELECT i, j, {rr('v', 'v', 5)} FROM d")
def cotan_matrix_entries(spark, sf):
    return rounded(linalg.cotan_coo(terrain(spark, sf)), 5)


@query(COT + f", x AS (SELECT src AS i, sum(w / 2 * (p.z - q2.z)) AS y FROM cd JOIN v p ON p.vid = src JOIN v q2 ON q2.vid = dst GROUP BY src) SELECT i, {rr('y', 'y')} FROM x")
def matrix_vector_product(spark, sf):
    mesh = terrain(spark, sf)
    x = mesh.vertices.select("mesh_id", F.col("vid").alias("i"), F.col("z").alias("x"))
    return rounded(linalg.matvec(linalg.cotan_coo(mesh), x))


DIH = """, fe AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, h.fid, nx / n2 AS nx, ny / n2 AS ny, nz / n2 AS nz FROM h JOIN ta ON ta.fid = h.fid),
dh AS (SELECT p.a, p.b, acos(least(1.0, greatest(-1.0, p.nx * q2.nx + p.ny * q2.ny + p.nz * q2.nz))) AS angle FROM fe p JOIN fe q2 ON p.a = q2.a AND p.b = q2.b AND p.fid < q2.fid)"""


@query(DIH + f" SELECT a, b, {rr('angle', 'angle')} FROM dh")
def dihedral_angle(spark, sf):
    return rounded(measure.dihedral_angles(terrain(spark, sf)))


@query(DIH + " SELECT count(*) AS n FROM dh WHERE angle > 1.0001234")
def feature_edge_count(spark, sf):
    return measure.feature_edges(terrain(spark, sf), 1.0001234).agg(F.count("*").alias("n"))


SIDES = """, sd AS (SELECT fid, sqrt((cx - bx) ** 2 + (cy - by_) ** 2 + (cz - bz) ** 2) AS la, sqrt(wx * wx + wy * wy + wz * wz) AS lb, sqrt(ux * ux + uy * uy + uz * uz) AS lc FROM ta),
qs AS (SELECT *, (la + lb + lc) / 2 AS s FROM sd)"""


@query(SIDES + f" SELECT fid, {rr('greatest(la, lb, lc) / least(la, lb, lc)', 'aspect', 5)}, {rr('8 * (s - la) * (s - lb) * (s - lc) / (la * lb * lc)', 'radius_ratio', 5)} FROM qs")
def face_quality(spark, sf):
    return rounded(measure.face_quality(terrain(spark, sf)), 5)


@query(f"SELECT {rr('sum(n2) / 2', 'area', 3)}, count(*) AS n_triangles FROM ta")
def surface_area(spark, sf):
    return rounded(measure.surface_area(terrain(spark, sf)), 3)


@query(f"SELECT {rr('sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6', 'volume', 2)} FROM t")
def signed_volume(spark, sf):
    return rounded(measure.volume(terrain(spark, sf)), 2)


@query(f"""SELECT {', '.join(rr(f'{g}({c})', f'{g}_{c}') for g in ('min', 'max') for c in 'xyz')}, {', '.join(rr(f'(min({c}) + max({c})) / 2', f'mid_{c}') for c in 'xyz')},
 {rr('sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2)', 'diagonal')} FROM v""")
def bounding_box(spark, sf):
    return rounded(measure.aabb(terrain(spark, sf)))


@query(f"SELECT {', '.join(rr(f'avg({c})', f'mid_{c}') for c in 'xyz')} FROM v")
def centroid(spark, sf):
    return rounded(measure.centroid(terrain(spark, sf)))


CLOUD = "c AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


@query(f"SELECT {', '.join(rr(f'{g}({c})', f'{g}_{c}', 5) for g in ('min', 'max') for c in 'xyz')} FROM c", CLOUD)
def point_cloud_box(spark, sf):
    return rounded(measure.aabb(point_cloud(spark, sf)).select("min_x", "min_y", "min_z", "max_x", "max_y", "max_z"), 5)


EL = ", el AS (SELECT sqrt((p.x - q2.x) ** 2 + (p.y - q2.y) ** 2 + (p.z - q2.z) ** 2) AS l FROM e JOIN v p ON p.vid = a JOIN v q2 ON q2.vid = b)"


@query(EL + f" SELECT {rr('min(l)', 'min_len')}, {rr('max(l)', 'max_len')}, {rr('avg(l)', 'mean_len')}, {rr('var_pop(l)', 'var_len')}, {rr('stddev_pop(l)', 'std_len')}, count(*) AS n_edges, {rr('max(l) / min(l)', 'ratio')} FROM el")
def edge_statistics(spark, sf):
    return rounded(measure.edge_stats(terrain(spark, sf)))


@query(SIDES + f""", q1 AS (SELECT greatest(la, lb, lc) / least(la, lb, lc) AS ar, 8 * (s - la) * (s - lb) * (s - lc) / (la * lb * lc) AS rrat FROM qs)
 SELECT {rr('min(ar)', 'min_aspect')}, {rr('max(ar)', 'max_aspect')}, {rr('avg(ar)', 'mean_aspect')}, {rr('min(rrat)', 'min_radius_ratio')}, {rr('avg(rrat)', 'mean_radius_ratio')}, count(*) AS face_count FROM q1""")
def mesh_quality(spark, sf):
    return rounded(measure.quality(terrain(spark, sf)).select("min_aspect", "max_aspect", "mean_aspect", "min_radius_ratio", "mean_radius_ratio", "face_count"))


CURV = COT + f""", an AS (SELECT v0 AS vid, {ANGLES['a']} AS g, n2 / 6 AS m FROM ta UNION ALL SELECT v1, {ANGLES['b']}, n2 / 6 FROM ta UNION ALL SELECT v2, {ANGLES['c']}, n2 / 6 FROM ta),
ag AS (SELECT vid, sum(g) AS g, sum(m) AS area FROM an GROUP BY vid),
rim AS (SELECT DISTINCT vid FROM (SELECT a AS vid FROM e WHERE n_faces = 1 UNION ALL SELECT b FROM e WHERE n_faces = 1)),
cu AS (SELECT ag.vid, area, rim.vid IS NOT NULL AS on_border, CASE WHEN rim.vid IS NOT NULL THEN 0.0 ELSE ({2 * math.pi!r} - g) / area END AS k, sqrt(lx * lx + ly * ly + lz * lz) / (4 * area) AS hh
 FROM ag JOIN lap ON lap.vid = ag.vid LEFT JOIN rim ON rim.vid = ag.vid)"""


@query(CURV + f""" SELECT vid, {rr('area', 'area')}, {rr('k', 'gaussian')}, {rr('hh', 'mean')}, on_border, {rr('hh + sqrt(greatest(hh * hh - k, 0.0))', 'k1', 3)}, {rr('hh - sqrt(greatest(hh * hh - k, 0.0))', 'k2', 3)} FROM cu""")
def curvature(spark, sf):
    c = measure.curvature(terrain(spark, sf))
    return c.select("vid", r("area").alias("area"), r("gaussian").alias("gaussian"), r("mean").alias("mean"), "on_border", r("k1", 3).alias("k1"), r("k2", 3).alias("k2"))


# smoothing

STEP = "SELECT v.vid, v.x + {l} * (coalesce(m.x, v.x) - v.x) AS x, v.y + {l} * (coalesce(m.y, v.y) - v.y) AS y, v.z + {l} * (coalesce(m.z, v.z) - v.z) AS z FROM {t} v LEFT JOIN (SELECT src, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM adj JOIN {t} w ON w.vid = dst GROUP BY src) m ON m.src = v.vid"
POS = ", ".join(["vid", rr("x", "x", 5), rr("y", "y", 5), rr("z", "z", 5)])


@query(f", s1 AS ({STEP.format(l=0.5, t='v')}), s2 AS ({STEP.format(l=0.5, t='s1')}), s3 AS ({STEP.format(l=0.5, t='s2')}) SELECT {POS} FROM s3")
def laplacian_smoothing(spark, sf):
    return rounded(smooth.laplacian_smooth(terrain(spark, sf), 0.5, 3).vertices, 5)


@query(f", s1 AS ({STEP.format(l=0.5, t='v')}), s2 AS ({STEP.format(l=-0.5301, t='s1')}) SELECT {POS} FROM s2")
def taubin_smoothing(spark, sf):
    return rounded(smooth.taubin_smooth(terrain(spark, sf), 0.5, -0.5301, 1).vertices, 5)


@query(f", s1 AS ({STEP.format(l=1.0, t='v')}) SELECT {POS} FROM s1")
def ring_mean(spark, sf):
    m = smooth.ring_mean(terrain(spark, sf))
    return m.select("vid", *(halves("m" + c, 5).alias(c) for c in "xyz"))


@query(VN + f""", bw AS (SELECT src AS vid, exp(-((p.x - q2.x) ** 2 + (p.y - q2.y) ** 2 + (p.z - q2.z) ** 2) / 4.5) * exp(-((a1.nx - b1.nx) ** 2 + (a1.ny - b1.ny) ** 2 + (a1.nz - b1.nz) ** 2) / 0.5) AS w, q2.x, q2.y, q2.z
 FROM adj JOIN v p ON p.vid = src JOIN v q2 ON q2.vid = dst JOIN vn a1 ON a1.vid = src JOIN vn b1 ON b1.vid = dst),
bs AS (SELECT vid, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * z) AS sz FROM bw GROUP BY vid)
SELECT v.vid, {rr('CASE WHEN w >= 1e-20 THEN sx / w ELSE v.x END', 'x')}, {rr('CASE WHEN w >= 1e-20 THEN sy / w ELSE v.y END', 'y')}, {rr('CASE WHEN w >= 1e-20 THEN sz / w ELSE v.z END', 'z')} FROM v LEFT JOIN bs ON bs.vid = v.vid""")
def bilateral_smoothing(spark, sf):
    return rounded(smooth.bilateral_smooth(terrain(spark, sf), 1.5, 0.5, 1).vertices)


# spatial

RAYS = """, dn AS (SELECT n FROM dim), er AS (SELECT event_id AS ray_id, CAST(event_id * 7 % (n - 1) AS DOUBLE) + 0.25 + user_id % 3 * 0.125 AS ox, CAST(event_id * 13 % (n - 1) AS DOUBLE) + 0.125 + user_id % 5 * 0.0625 AS oy FROM events, dn),
hit AS (SELECT ray_id, fid, ((wy * (ox - ax) - wx * (oy - ay)) / (ux * wy - uy * wx)) AS bu, ((ux * (oy - ay) - uy * (ox - ax)) / (ux * wy - uy * wx)) AS bv, az, uz, wz
 FROM er JOIN ta ON least(ax, bx, cx) = floor(ox) AND least(ay, by_, cy) = floor(oy)),
ok AS (SELECT *, 1000.0 - (az + bu * uz + bv * wz) AS t FROM hit WHERE bu >= 0 AND bv >= 0 AND bu + bv <= 1)"""


@query(RAYS + f" SELECT ray_id, min(fid) AS fid, {rr('min(t)', 't')} FROM ok GROUP BY ray_id")
def ray_first_hit(spark, sf):
    return rounded(spatial.ray_first_hit(terrain(spark, sf), event_rays(spark, sf), 1.0).select("ray_id", "fid", "t"), 4)


@query(RAYS + " SELECT ray_id, count(*) AS n_hits, count(*) % 2 = 1 AS inside FROM ok GROUP BY ray_id")
def ray_parity(spark, sf):
    return spatial.ray_parity(terrain(spark, sf), event_rays(spark, sf), 1.0).select("ray_id", "n_hits", "inside")


@query(RAYS + """, pt AS (SELECT ray_id, ox, oy, CAST(ray_id % 11 AS DOUBLE) AS oz FROM er), bx AS (SELECT ray_id AS box_id, ox - 1.5 AS x0, ox + 1.5 AS x1, oy - 0.5 AS y0, oy + 0.5 AS y1, oz - 1.0 AS z0, oz + 1.0 AS z1 FROM pt),
fb AS (SELECT fid, least(ax, bx, cx) AS lx, greatest(ax, bx, cx) AS hx, least(ay, by_, cy) AS ly, greatest(ay, by_, cy) AS hy, least(az, bz, cz) AS lz, greatest(az, bz, cz) AS hz FROM t)
SELECT box_id, count(*) AS n, CAST(sum(fid) AS BIGINT) AS fid_sum FROM bx JOIN fb ON lx BETWEEN floor(x0) - 1 AND ceil(x1) AND ly BETWEEN floor(y0) - 1 AND ceil(y1) AND lx <= x1 AND x0 <= hx AND ly <= y1 AND y0 <= hy AND lz <= z1 AND z0 <= hz WHERE box_id % 1 = 0 GROUP BY box_id""")
def faces_in_box(spark, sf):
    p = event_points(spark, sf)
    half = {"x": 1.5, "y": 0.5, "z": 1.0}
    boxes = p.select(F.col("pt_id").alias("box_id"), *((F.col(k) - h).alias("min_" + k) for k, h in half.items()), *((F.col(k) + h).alias("max_" + k) for k, h in half.items()))
    got = spatial.faces_in_aabb(terrain(spark, sf), boxes, 2.0)
    return got.groupBy("box_id").agg(F.count("*").alias("n"), F.sum("fid").alias("fid_sum"))


@query()
def nearest_point(spark, sf):
    """Closest point of the terrain to every event's place."""
    return rounded(spatial.nearest_point(terrain(spark, sf), event_points(spark, sf)).select("pt_id", "fid", "d2"))


@query()
def grid_index_histogram(spark, sf):
    return rounded(spatial.grid_histogram(terrain(spark, sf)))


# validation, repair, connectivity


@query("SELECT kind, count(*) AS n FROM (SELECT 'repeated_vertex' AS kind FROM f WHERE v0 = v1 OR v1 = v2 OR v2 = v0 UNION ALL SELECT 'nonmanifold_edge' FROM e WHERE n_faces > 2 UNION ALL SELECT 'isolated_vertex' FROM v WHERE vid NOT IN (SELECT src FROM h)) GROUP BY kind")
def validation_report(spark, sf):
    return repair.validate(terrain(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT a, b, n FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM (SELECT * FROM h UNION ALL SELECT fid + 1000000000, slot, src, dst, opp FROM h WHERE fid % 97 = 0) GROUP BY 1, 2) WHERE n > 2")
def nonmanifold_edges(spark, sf):
    mesh = terrain(spark, sf)
    extra = mesh.faces.where("fid % 97 = 0").withColumn("fid", F.col("fid") + 1_000_000_000)
    return repair.nonmanifold_edges(mesh.with_faces(mesh.faces.unionByName(extra))).select("a", "b", F.col("n_faces").cast("long").alias("n"))


@query("SELECT count(*) = 0 AS consistent FROM (SELECT src, dst FROM (SELECT src, dst, fid FROM h WHERE fid % 10 <> 0 UNION ALL SELECT dst, src, fid FROM h WHERE fid % 10 = 0) GROUP BY src, dst HAVING count(*) > 1)")
def orientation_check(spark, sf):
    mesh = terrain(spark, sf)
    turned = mesh.faces.withColumn("vs", F.when(F.col("fid") % 10 == 0, F.reverse("vs")).otherwise(F.col("vs")))
    return repair.is_orientation_consistent(mesh.with_faces(turned)).select("consistent")


@query("SELECT count(*) = 0 AS consistent, (SELECT count(*) FROM f) AS n_faces FROM (SELECT src, dst FROM h GROUP BY src, dst HAVING count(*) > 1)")
def orientation_fix(spark, sf):
    mesh = terrain(spark, sf)
    turned = mesh.faces.withColumn("vs", F.when(F.col("fid") % 10 == 0, F.reverse("vs")).otherwise(F.col("vs")))
    fixed = repair.fix_orientation(mesh.with_faces(turned))
    n = fixed.faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))
    return repair.is_orientation_consistent(fixed).join(n, "mesh_id").select("consistent", "n_faces")


@query("""SELECT count(*) AS n_vertices, (SELECT count(*) FROM f) AS n_faces FROM v""")
def weld_soup(spark, sf):
    """Every triangle with corners of its own, welded back together."""
    mesh = terrain(spark, sf)
    c = mesh.faces.select("mesh_id", "fid", F.posexplode("vs").alias("slot", "old")).join(mesh.points("old", ""), ["mesh_id", "old"])
    vs = c.select("mesh_id", (F.col("fid") * 3 + F.col("slot")).alias("vid"), "x", "y", "z")
    fs = mesh.faces.select("mesh_id", "fid", F.expr("transform(vs, (x, i) -> fid * 3 + i)").alias("vs"))
    w = repair.weld(Mesh(vs, fs), 1e-6)
    return w.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(w.faces.agg(F.count("*").alias("n_faces"))))


@query("SELECT component, count(*) AS n FROM (SELECT CAST(floor(y / 10) AS BIGINT) AS band, min(vid) OVER (PARTITION BY floor(y / 10)) AS component FROM v) GROUP BY component")
def vertex_components(spark, sf):
    """Components after the rows of cells between bands of ten vertex rows are taken out."""
    mesh = terrain(spark, sf)
    y = mesh.vertices.select("mesh_id", "vid", F.floor(F.col("y") / 10).alias("band"))
    bad = mesh.faces.select("mesh_id", "fid", F.explode("vs").alias("vid")).join(y, ["mesh_id", "vid"]).groupBy("mesh_id", "fid").agg(F.count_distinct("band").alias("k")).where("k > 1")
    return connectivity.vertex_components(repair.remove_faces(mesh, bad)).groupBy("component").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_faces, 1 AS n_components FROM f")
def face_components(spark, sf):
    c = connectivity.face_components(terrain(spark, sf), "edge")
    return c.agg(F.count("*").alias("n_faces"), F.count_distinct("component").cast("int").alias("n_components"))


@query("SELECT (SELECT count(*) FROM v) * 2 AS n_vertices, count(*) * 2 AS n_faces, CAST(max(fid) * 2 + 1 AS BIGINT) AS last FROM f")
def merge_meshes(spark, sf):
    a = terrain(spark, sf)
    m = connectivity.merge_meshes(a, a)
    return m.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(m.faces.agg(F.count("*").alias("n_faces"), F.max("fid").alias("last"))))


@query("SELECT count(DISTINCT vid) AS n_vertices, count(DISTINCT fid) AS n_faces FROM (SELECT fid, unnest([v0, v1, v2]) AS vid FROM f WHERE fid % 5 = 0)")
def extract_faces(spark, sf):
    mesh = terrain(spark, sf)
    m = connectivity.extract_faces(mesh, mesh.faces.where("fid % 5 = 0"))
    return m.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(m.faces.agg(F.count("*").alias("n_faces"))))


TILE = ", tl AS (SELECT fid, CAST(CAST(floor(fid // 2 % n / 16) AS INT) AS VARCHAR) || '-' || CAST(CAST(floor(fid // 2 // n / 16) AS INT) AS VARCHAR) AS tile FROM f, dim)"


@query(TILE + f" SELECT tile, {rr('sum(n2) / 2', 'area')}, count(*) AS n_triangles FROM tl JOIN ta ON ta.fid = tl.fid GROUP BY tile")
def tile_areas(spark, sf):
    a = measure.surface_area(tiles(spark, sf))
    return a.select(F.col("mesh_id").alias("tile"), r("area").alias("area"), "n_triangles")


# refinement

EDGE4 = """, es AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS k, sum(o.x) AS ox, sum(o.y) AS oy, sum(o.z) AS oz FROM h JOIN v o ON o.vid = opp GROUP BY 1, 2),
em AS (SELECT a, b, k, (row_number() OVER (ORDER BY a, b)) - 1 + (SELECT count(*) FROM v) AS vid, CASE WHEN k = 2 THEN (p.x + q2.x) * 0.375 + ox * 0.125 ELSE (p.x + q2.x) / 2 END AS x,
 CASE WHEN k = 2 THEN (p.y + q2.y) * 0.375 + oy * 0.125 ELSE (p.y + q2.y) / 2 END AS y, CASE WHEN k = 2 THEN (p.z + q2.z) * 0.375 + oz * 0.125 ELSE (p.z + q2.z) / 2 END AS z FROM es JOIN v p ON p.vid = a JOIN v q2 ON q2.vid = b)"""
NB = ", nb AS (SELECT vid, count(*) AS n, count(CASE WHEN k = 1 THEN 1 END) AS nr, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(CASE WHEN k = 1 THEN x END) AS rx, sum(CASE WHEN k = 1 THEN y END) AS ry, sum(CASE WHEN k = 1 THEN z END) AS rz FROM (SELECT a AS vid, k, w.x, w.y, w.z FROM es JOIN v w ON w.vid = b UNION ALL SELECT b, k, w.x, w.y, w.z FROM es JOIN v w ON w.vid = a) GROUP BY vid)"
BETA = f"((0.625 - (0.375 + 0.25 * cos({2 * math.pi!r} / nb.n)) ** 2) / nb.n)"
EVEN = ", ".join(f"CASE WHEN nr = 2 THEN v.{c} * 0.75 + r{c} * 0.125 WHEN nr > 0 THEN v.{c} ELSE v.{c} * (1 - nb.n * {BETA}) + s{c} * {BETA} END AS {c}" for c in "xyz")


@query(EDGE4 + NB + f", lv AS (SELECT v.vid, {EVEN} FROM v JOIN nb ON nb.vid = v.vid UNION ALL SELECT vid, x, y, z FROM em) SELECT {POS} FROM lv")
def loop_subdivision_points(spark, sf):
    m = refine.loop_subdivide(terrain(spark, sf))
    return m.vertices.select("vid", *(halves(c, 5).alias(c) for c in "xyz"))


@query(EDGE4 + """, lf AS (SELECT fid, v0, v1, v2, m0.vid AS m0, m1.vid AS m1, m2.vid AS m2 FROM f JOIN em m0 ON m0.a = least(v0, v1) AND m0.b = greatest(v0, v1) JOIN em m1 ON m1.a = least(v1, v2) AND m1.b = greatest(v1, v2) JOIN em m2 ON m2.a = least(v2, v0) AND m2.b = greatest(v2, v0))
SELECT fid * 4 AS fid, v0 AS a, m0 AS b, m2 AS c FROM lf UNION ALL SELECT fid * 4 + 1, v1, m1, m0 FROM lf UNION ALL SELECT fid * 4 + 2, v2, m2, m1 FROM lf UNION ALL SELECT fid * 4 + 3, m0, m1, m2 FROM lf""")
def loop_subdivision_faces(spark, sf):
    return refine.loop_subdivide(terrain(spark, sf)).faces.select("fid", F.col("vs")[0].alias("a"), F.col("vs")[1].alias("b"), F.col("vs")[2].alias("c"))


@query("SELECT (SELECT count(*) FROM v) + (SELECT count(*) FROM e) + count(*) AS n_vertices, count(*) * 6 AS n_faces FROM f")
def catmull_clark_counts(spark, sf):
    m = refine.catmull_clark_subdivide(terrain(spark, sf))
    return m.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(m.faces.agg(F.count("*").alias("n_faces"))))


@query(f"""SELECT {rr('sum(x)', 'sx', 2)}, {rr('sum(y)', 'sy', 2)}, {rr('sum(z)', 'sz', 3)}, count(*) AS n FROM (SELECT (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y, (az + bz + cz) / 3 AS z FROM t)""")
def sqrt3_new_points(spark, sf):
    mesh = terrain(spark, sf)
    m = refine.sqrt3_subdivide(mesh)
    new = m.vertices.join(mesh.vertices.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti")
    return new.agg(r(F.sum("x"), 2).alias("sx"), r(F.sum("y"), 2).alias("sy"), r(F.sum("z"), 3).alias("sz"), F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM v) + count(*) AS n_vertices, 3 * count(*) AS n_faces FROM f")
def sqrt3_counts(spark, sf):
    m = refine.sqrt3_subdivide(terrain(spark, sf))
    return m.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(m.faces.agg(F.count("*").alias("n_faces"))))


@query("SELECT 2 * a AS cell, a AS p, a + 1 AS q1, a + n + 1 AS s FROM q UNION ALL SELECT 2 * a, a, a + n + 1, a + n FROM q")
def fan_triangles(spark, sf):
    """The terrain's cells as quads, cut into fans."""
    n = math.isqrt(spark.read.parquet(f"{sf}/orders.parquet").count())
    a = spark.range(n * (n - 1)).where(F.col("id") % n < n - 1)
    quads = a.select((2 * F.col("id")).alias("cell"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + n + 1, F.col("id") + n).alias("vs"))
    t = quads.select("cell", F.explode(fan(F.col("vs"))).alias("t"))
    return t.select("cell", F.col("t")[0].alias("p"), F.col("t")[1].alias("q1"), F.col("t")[2].alias("s"))


@query("SELECT (SELECT count(*) FROM v) + count(*) AS n_vertices, 3 * count(*) AS n_faces FROM f")
def split_all_faces(spark, sf):
    m = edit.split_faces(terrain(spark, sf))
    return m.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(m.faces.agg(F.count("*").alias("n_faces"))))


@query("""SELECT (SELECT count(*) FROM v) + count(*) AS n_vertices, (SELECT count(*) FROM f) + CAST(sum(n_faces) AS BIGINT) AS n_faces FROM e WHERE (a + b) % 7 = 0""")
def split_some_edges(spark, sf):
    mesh = terrain(spark, sf)
    m = edit.split_edges(mesh, mesh.edges.where("(a + b) % 7 = 0"))
    return m.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(m.faces.agg(F.count("*").alias("n_faces"))))


@query("SELECT a, b, n_faces = 2 AS ok FROM e")
def link_condition(spark, sf):
    mesh = terrain(spark, sf)
    return topology.link_condition(mesh, mesh.edges).select("a", "b", F.coalesce("ok", F.lit(False)).alias("ok"))


@query("""SELECT count(*) + (SELECT count(*) FROM (SELECT DISTINCT src FROM h WHERE fid < 200)) AS n_vertices, (SELECT count(*) FROM f) + 2 * (SELECT count(*) FROM (SELECT src, dst FROM h WHERE fid < 200 AND NOT EXISTS (SELECT 1 FROM h t WHERE t.fid < 200 AND t.src = h.dst AND t.dst = h.src))) AS n_faces FROM v""")
def extrude_strip(spark, sf):
    """The first hundred cells pulled up with walls around them (a strip without inner vertices)."""
    mesh = terrain(spark, sf)
    m = edit.extrude_region(mesh, mesh.faces.where("fid < 200"), (0.0, 0.0, 5.0))
    return m.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(F.broadcast(m.faces.agg(F.count("*").alias("n_faces"))))


# intrinsic geometry

INTR = EL.replace("el AS (SELECT sqrt", "el AS (SELECT a, b, sqrt") + """, sd AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, opp FROM h), tw AS (SELECT a, b, min(opp) AS c, max(opp) AS d FROM sd GROUP BY a, b HAVING count(*) = 2),
ls AS (SELECT tw.a, tw.b, e0.l AS ab, e1.l AS bc, e2.l AS ca, e3.l AS ad, e4.l AS bd FROM tw JOIN el e0 ON e0.a = tw.a AND e0.b = tw.b JOIN el e1 ON e1.a = least(tw.b, c) AND e1.b = greatest(tw.b, c)
 JOIN el e2 ON e2.a = least(c, tw.a) AND e2.b = greatest(c, tw.a) JOIN el e3 ON e3.a = least(tw.a, d) AND e3.b = greatest(tw.a, d) JOIN el e4 ON e4.a = least(tw.b, d) AND e4.b = greatest(tw.b, d)),
kk AS (SELECT *, sqrt(greatest((ab + bc + ca) * (-ab + bc + ca) * (ab - bc + ca) * (ab + bc - ca), 0)) / 4 AS k1, sqrt(greatest((ab + ad + bd) * (-ab + ad + bd) * (ab - ad + bd) * (ab + ad - bd), 0)) / 4 AS k2 FROM ls)"""


@query(INTR + f" SELECT a, b, {rr('((bc * bc + ca * ca - ab * ab) / (4 * k1) + (ad * ad + bd * bd - ab * ab) / (4 * k2)) / 2', 'weight')} FROM kk")
def intrinsic_weights(spark, sf):
    return rounded(simplify.delaunay_edges(terrain(spark, sf)).select("a", "b", "weight"))


@query(INTR + " SELECT count(*) AS n, CAST(sum(CASE WHEN (bc * bc + ca * ca - ab * ab) / (4 * k1) + (ad * ad + bd * bd - ab * ab) / (4 * k2) >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_delaunay FROM kk")
def delaunay_edge_count(spark, sf):
    d = simplify.delaunay_edges(terrain(spark, sf))
    return d.agg(F.count("*").alias("n"), F.sum(F.col("is_delaunay").cast("long")).alias("n_delaunay"))


# predicates


@query(f"SELECT fid, {rr('(bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)', 'area2', 6)}, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) > 0 AS ccw, n2 = 0 AS degenerate FROM ta")
def predicates_on_faces(spark, sf):
    t = terrain(spark, sf).triangles
    p = [(F.col(k + "x"), F.col(k + "y")) for k in "abc"]
    return t.select("fid", r(pr.orient2d(*p), 6).alias("area2"), pr.is_ccw2d(*p).alias("ccw"), pr.is_triangle_degenerate_3d(v.cols("a"), v.cols("b"), v.cols("c")).alias("degenerate"))


@query(f"SELECT fid, {rr('-(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx))', 'det', 3)} FROM t")
def orientation_3d(spark, sf):
    t = terrain(spark, sf).triangles
    zero = v.lit(0, 0, 0)
    return t.select("fid", r(-pr.orient3d(v.cols("a"), v.cols("b"), v.cols("c"), zero), 3).alias("det"))


# attributes, navigation, export


@query("SELECT count(*) AS n FROM v WHERE NOT (vid % 3 = 0)")
def selection_algebra(spark, sf):
    mesh = terrain(spark, sf)
    m = attributes.invert_selection(attributes.select(mesh, "vertex", mesh.vertices.where("vid % 3 = 0")), "vertex")
    return attributes.count_selected(m, "vertex").select("n")


@query("SELECT a, b FROM e WHERE a % 11 = 0 AND b = a + 1")
def edge_selection(spark, sf):
    mesh = terrain(spark, sf)
    some = mesh.darts.where("least(src, dst) % 11 = 0 AND greatest(src, dst) = least(src, dst) + 1 AND src < dst")
    return attributes.selected_edges(attributes.select_edges(mesh, some)).select("a", "b")


@query("SELECT fid, CAST(least(greatest((fid % 7) / 4.0 - 0.25, 0.0), 1.0) AS DOUBLE) AS opacity FROM f")
def face_opacity(spark, sf):
    mesh = terrain(spark, sf)
    m = attributes.add_builtin(mesh, "face_opacity")
    m = attributes.set_opacity(m, mesh.faces.select("mesh_id", "fid", ((F.col("fid") % 7) / 4.0 - 0.25).alias("value")))
    return m.faces.select("fid", "opacity")


@query(""", hh AS (SELECT h.src AS s0, h.dst AS d0, t.fid AS tf, t.slot AS ts FROM h LEFT JOIN h t ON t.src = h.dst AND t.dst = h.src)
SELECT s0, d0, n.dst AS reached FROM hh JOIN h n ON n.fid = tf AND n.slot = (ts + 1) % 3""")
def rotate_clockwise(spark, sf):
    """dst(next(twin(h))) of every interior directed edge with a twin."""
    mesh = terrain(spark, sf)
    start = mesh.paired.where("twin IS NOT NULL").select("mesh_id", "heid")
    got = navigate.MeshQuery.darts(mesh, start).cw_rotated().dst_vert().run().select(F.col("start").alias("heid"), F.col("at").alias("reached"))
    return mesh.paired.select("heid", "src", "dst").join(got, "heid").select(F.col("src").alias("s0"), F.col("dst").alias("d0"), "reached")


@query("SELECT tile, count(DISTINCT vid) * 3 AS n_positions, count(DISTINCT ff.fid) * 3 AS n_indices FROM (SELECT tl.tile, f.fid, unnest([v0, v1, v2]) AS vid FROM tl JOIN f ON f.fid = tl.fid) ff GROUP BY tile".replace("SELECT tile", TILE + " SELECT tile", 1))
def export_buffers(spark, sf):
    b = formats.index_buffers(tiles(spark, sf))
    return b.select(F.col("mesh_id").alias("tile"), F.size("positions").cast("long").alias("n_positions"), F.size("indices").cast("long").alias("n_indices"))


@query("SELECT CAST(floor(ray_id / 1) AS BIGINT) AS ray_id, 1 AS one FROM (SELECT event_id AS ray_id FROM events)", "x AS (SELECT 1)")
def ray_source(spark, sf):
    return event_rays(spark, sf).select("ray_id", F.lit(1).alias("one"))


# implicit surfaces


@query("""SELECT CAST(x AS INT) AS ix, CAST(y AS INT) AS iy, CAST(z AS INT) AS iz, round(least(sqrt((x / 10 - 1) ** 2 + (y / 10 - 1) ** 2 + (z / 10 - 1) ** 2) - 0.7, greatest(abs(x / 10 - 0.5) - 0.3, abs(y / 10 - 0.5) - 0.3, abs(z / 10 - 0.5) - 0.3)), 6) + 0.0 AS val
FROM (SELECT CAST(i % 21 AS DOUBLE) AS x, CAST(i // 21 % 21 AS DOUBLE) AS y, CAST(i // 441 AS DOUBLE) AS z FROM range(9261) t(i))""", "one AS (SELECT 1)")
def sdf_samples(spark, sf):
    box = implicit.Expression(lambda x, y, z: F.greatest(F.abs(x - 0.5) - 0.3, F.abs(y - 0.5) - 0.3, F.abs(z - 0.5) - 0.3))
    sdf = implicit.Sphere((1.0, 1.0, 1.0), 0.7) | box
    return rounded(implicit.sample(spark, sdf, implicit.Grid((20, 20, 20), (0.0, 0.0, 0.0), (0.1, 0.1, 0.1))).drop("grid_id"), 6)


# rows-only: iterative and sequential algorithms


def _small(spark, sf) -> Mesh:
    return cut_mesh(tiles(spark, sf))


def cut_mesh(mesh: Mesh) -> Mesh:
    return Mesh(cut(mesh.vertices, "mesh-v"), cut(mesh.faces, "mesh-f"))


def _firsts(mesh: Mesh) -> DataFrame:
    return mesh.vertices.groupBy("mesh_id").agg(F.min("vid").alias("vid"))


@query()
def dijkstra_distances(spark, sf):
    m = _small(spark, sf)
    return geodesics.dijkstra(m, _firsts(m)).withColumn("distance", r("distance"))


@query()
def heat_geodesics(spark, sf):
    m = _small(spark, sf)
    return geodesics.heat_geodesic(m, _firsts(m)).withColumn("distance", r("distance", 3))


@query()
def exact_geodesics(spark, sf):
    m = generators.icosphere(spark, 2)
    return geodesics.exact_geodesic(m, _firsts(m)).withColumn("distance", r("distance"))


@query()
def shortest_paths(spark, sf):
    m = _small(spark, sf)
    last = m.vertices.groupBy("mesh_id").agg(F.max("vid").alias("vid"))
    return geodesics.shortest_paths(m, _firsts(m), last)


@query()
def tutte(spark, sf):
    return rounded_mesh(fields.tutte_embedding(_small(spark, sf)))


@query()
def harmonic(spark, sf):
    return rounded_mesh(fields.harmonic_parameterization(_small(spark, sf)))


@query()
def mean_value(spark, sf):
    return rounded_mesh(fields.mean_value_parameterization(_small(spark, sf)))


@query()
def conformal_lscm(spark, sf):
    return rounded_mesh(fields.lscm(generators.grid(spark, 4.0, 4.0, 12, 12)), 3)


@query()
def deformation_arap(spark, sf):
    m = generators.grid(spark, 4.0, 4.0, 10, 10)
    ends = m.vertices.where("vid < 11 OR vid >= 110").select("mesh_id", "vid", F.col("x").alias("tx"), F.when(F.col("vid") < 11, F.lit(0.0)).otherwise(F.lit(1.0)).alias("ty"), F.col("z").alias("tz"))
    return rounded_mesh(fields.arap_deformation(m, ends), 3)


@query()
def cross_field_singularities(spark, sf):
    m = generators.icosphere(spark, 2)
    theta = cut(fields.smoothest_cross_field(m), "theta")
    return fields.singularities(m, theta, 4).agg(r(F.sum("index"), 2).alias("total"))


@query()
def decimated_tiles(spark, sf):
    m = simplify.decimate(_small(spark, sf), 200)
    return m.faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"))


@query()
def remeshed_sphere(spark, sf):
    return simplify.remesh_stats(generators.icosphere(spark, 2))


@query()
def intrinsic_delaunay(spark, sf):
    return simplify.intrinsic_delaunay_stats(_small(spark, sf))


@query()
def marching_cubes(spark, sf):
    m = implicit.march_sdf(spark, implicit.Sphere(radius=0.8), implicit.Grid((24, 24, 24), (-1.2, -1.2, -1.2), (0.1, 0.1, 0.1)))
    return measure.volume(cut_mesh(m)).withColumn("volume", r("volume"))


@query()
def csg_difference(spark, sf):
    a = generators.cube(spark, 2.0, "a")
    b = edit.translated(generators.cube(spark, 2.0, "b"), (0.7, 0.6, 0.5))
    return rounded(measure.volume(csg.difference(a, b)))


@query()
def hole_filling(spark, sf):
    m = generators.icosphere(spark, 1)
    holed = repair.remove_faces(m, m.faces.where("fid < 1"))
    return topology.counts(cut_mesh(repair.fill_holes(holed)))


@query()
def flipped_edges(spark, sf):
    m = terrain(spark, sf)
    _, status = edit.flip_edges(m, m.edges)
    return status.groupBy("status").agg(F.count("*").alias("n"))


@query()
def collapsed_edges(spark, sf):
    m = terrain(spark, sf)
    _, status = edit.collapse_edges(m, m.edges)
    return status.groupBy("status").agg(F.count("*").alias("n"))


@query()
def obj_files(spark, sf):
    return formats.format_meshes(_small(spark, sf), "obj").select("mesh_id", F.octet_length("content").alias("n_bytes"))


@query(f"""SELECT vid, CASE WHEN den < 1e-14 THEN 0.0 ELSE round((nr * dr + ni * di) / den, 6) + 0.0 END AS u, CASE WHEN den < 1e-14 THEN 0.0 ELSE round((ni * dr - nr * di) / den, 6) + 0.0 END AS w
FROM (SELECT vid, nr, ni, dr, di, dr * dr + di * di AS den FROM (SELECT vid, x / 1000 - 0.3 AS nr, y / 1000 + 0.2 AS ni, -0.3 * x / 1000 + 0.2 * y / 1000 + 1 AS dr, -0.3 * y / 1000 - 0.2 * x / 1000 AS di FROM v))""")
def mobius_transform(spark, sf):
    """The disc automorphism that moves 0.3 - 0.2 i to the origin, on scaled lattice places."""
    u, w = fields.mobius(F.col("x") / 1000, F.col("y") / 1000, *fields.mobius_to_center((0.3, -0.2)))
    return terrain(spark, sf).vertices.select("vid", r(u, 6).alias("u"), r(w, 6).alias("w"))


@query(f"""SELECT fid, {rr('al * (px * qy - qx * py) + pl * (qx * ky - kx * qy) + ql * (kx * py - px * ky)', 'det', 5)} FROM (SELECT fid, kx, ky, px, py, qx, qy, kx * kx + ky * ky AS al, px * px + py * py AS pl, qx * qx + qy * qy AS ql
 FROM (SELECT fid, ax - dx AS kx, ay - dy AS ky, bx - dx AS px, by_ - dy AS py, cx - dx AS qx, cy - dy AS qy FROM (SELECT *, ax + 0.25 + az / 8 AS dx, ay + 0.5 AS dy FROM t)))""")
def incircle_test(spark, sf):
    """A place near the first corner against the circle through each triangle's corners, seen from above."""
    t = terrain(spark, sf).triangles
    p = [(F.col(k + "x"), F.col(k + "y")) for k in "abc"]
    d = (F.col("ax") + 0.25 + F.col("az") / 8, F.col("ay") + 0.5)
    return t.select("fid", r(pr.incircle(*p, d), 5).alias("det"))


@query("""SELECT fid, (s1 >= 0 AND s2 >= 0 AND s3 >= 0) AS inside FROM (SELECT fid, (bx - ax) * (py - ay) - (by_ - ay) * (px - ax) AS s1, (cx - bx) * (py - by_) - (cy - by_) * (px - bx) AS s2, (ax - cx) * (py - cy) - (ay - cy) * (px - cx) AS s3
 FROM (SELECT *, ax + az / 8 AS px, ay + 0.3125 AS py FROM t))""")
def point_in_triangle(spark, sf):
    t = terrain(spark, sf).triangles
    p = (F.col("ax") + F.col("az") / 8, F.col("ay") + 0.3125)
    return t.select("fid", pr.point_in_triangle_2d(p, *[(F.col(k + "x"), F.col(k + "y")) for k in "abc"]).alias("inside"))


@query(TILE + f""", tv AS (SELECT tile, x, y, z FROM tl JOIN (SELECT fid, unnest([v0, v1, v2]) AS vid FROM f) c ON c.fid = tl.fid JOIN v ON v.vid = c.vid)
SELECT tile, {', '.join(rr(f'{g}({c})', f'{g}_{c}') for g in ('min', 'max') for c in 'xyz')} FROM tv GROUP BY tile""")
def tile_boxes(spark, sf):
    b = measure.aabb(tiles(spark, sf))
    return b.select(F.col("mesh_id").alias("tile"), *(r(f"{g}_{c}").alias(f"{g}_{c}") for g in ("min", "max") for c in "xyz"))


@query(f"SELECT {', '.join(rr(f'{g}({c})', f'{g}_{c}') for g in ('min', 'max') for c in 'xyz')} FROM v")
def union_of_boxes(spark, sf):
    return rounded(measure.aabb_union(measure.aabb(tiles(spark, sf))))


FRAMES = """, sh AS (SELECT *, sqrt((cx - bx) ** 2 + (cy - by_) ** 2 + (cz - bz) ** 2) AS la, sqrt(wx * wx + wy * wy + wz * wz) AS lb, sqrt(ux * ux + uy * uy + uz * uz) AS lc FROM ta),
fr AS (SELECT fid, least(la, lb, lc) AS l, CASE WHEN lc = least(la, lb, lc) THEN ux WHEN la = least(la, lb, lc) THEN cx - bx ELSE -wx END AS sx, CASE WHEN lc = least(la, lb, lc) THEN uy WHEN la = least(la, lb, lc) THEN cy - by_ ELSE -wy END AS sy, CASE WHEN lc = least(la, lb, lc) THEN uz WHEN la = least(la, lb, lc) THEN cz - bz ELSE -wz END AS sz FROM sh)"""


@query(FRAMES + f" SELECT fid, {rr('sx / l', 'ex', 5)}, {rr('sy / l', 'ey', 5)}, {rr('sz / l', 'ez', 5)} FROM fr")
def face_frames(spark, sf):
    f = fields.face_frames(terrain(spark, sf))
    return f.select("fid", r("e1x", 5).alias("ex"), r("e1y", 5).alias("ey"), r("e1z", 5).alias("ez"))


@query("SELECT vid, count(*) AS n FROM (SELECT a AS vid FROM e WHERE n_faces = 2 UNION ALL SELECT b FROM e WHERE n_faces = 2) GROUP BY vid")
def inner_edges_at_vertices(spark, sf):
    e = terrain(spark, sf).edges.where("n_faces = 2")
    return e.select(F.explode(F.array("a", "b")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n"))


@query("SELECT count(*) - (SELECT count(DISTINCT src) FROM h WHERE fid % 5 = 0) AS n_gone FROM v")
def isolated_after_removal(spark, sf):
    """Vertices that go once only every fifth face is left."""
    mesh = terrain(spark, sf)
    left = mesh.with_faces(mesh.faces.where("fid % 5 = 0"))
    kept = repair.remove_isolated_vertices(left).vertices.agg(F.count("*").alias("k"))
    return mesh.vertices.agg(F.count("*").alias("n")).crossJoin(F.broadcast(kept)).select((F.col("n") - F.col("k")).alias("n_gone"))


@query()
def transported_frames(spark, sf):
    return rounded(fields.transport_angles(terrain(spark, sf)))


@query()
def harmonic_positions(spark, sf):
    m = generators.grid(spark, 4.0, 4.0, 10, 10)
    ends = m.vertices.where("vid < 11 OR vid >= 110").select("mesh_id", "vid", F.col("x").alias("tx"), F.lit(0.5).alias("ty"), F.col("z").alias("tz"))
    return rounded_mesh(fields.harmonic_map(m, ends))


@query()
def laplacian_deformation(spark, sf):
    m = generators.grid(spark, 4.0, 4.0, 10, 10)
    ends = m.vertices.where("vid < 11 OR vid >= 110").select("mesh_id", "vid", F.col("x").alias("tx"), F.when(F.col("vid") < 11, F.lit(0.0)).otherwise(F.lit(1.0)).alias("ty"), F.col("z").alias("tz"))
    return rounded_mesh(fields.laplacian_deformation(m, ends), 3)


@query()
def conformal_factors(spark, sf):
    m = generators.icosphere(spark, 1)
    return rounded_mesh(fields.scale_factors(m, m.vertices.select("mesh_id", "vid", F.lit(4 * math.pi / 42).alias("k"))))


@query()
def two_point_harmonic(spark, sf):
    return rounded_mesh(fields.two_point_harmonic(generators.grid(spark, 4.0, 4.0, 12, 12)), 3)


@query()
def catmull_clark_points(spark, sf):
    return rounded(refine.catmull_clark_subdivide(terrain(spark, sf)).vertices)


@query()
def remesh_target_lengths(spark, sf):
    return rounded_mesh(simplify.target_length(_small(spark, sf)))


def rounded_mesh(df: DataFrame, n: int = 4) -> DataFrame:
    return df.select(*((r(c, n).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["queries", "oracle_sql", "tri", "pr"]
