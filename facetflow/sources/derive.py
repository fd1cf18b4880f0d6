"""Meshes, rays and points derived from the benchmark tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cells that a task makes faces of, and those for which faces get a partition in a shuffle.
CELLS_A_TASK, CELLS_A_PART = 250_000, 100_000


def terrain(spark: SparkSession, sf_dir: str, mesh_id: str = "terrain") -> Mesh:
    """A height field over a square lattice of orders; two triangles per cell."""
    orders = _table(spark, sf_dir, "orders")
    n = math.isqrt(orders.count())
    k = F.col("o_orderkey")
    v = orders.where(k < n * n).select(
        F.lit(mesh_id).alias("mesh_id"), k.alias("vid"), (k % n).cast("double").alias("x"), F.floor(k / n).cast("double").alias("y"), (F.col("o_totalprice") / 100000.0).alias("z")
    )
    cells = n * (n - 1)
    a = spark.range(0, cells, 1, max(spark.sparkContext.defaultParallelism, cells // CELLS_A_TASK)).where(F.col("id") % n < n - 1).withColumnRenamed("id", "a")
    f = a.select("a", F.explode(F.array(F.struct((2 * F.col("a")).alias("fid"), F.array(F.col("a"), F.col("a") + 1, F.col("a") + n).alias("vs")), F.struct((2 * F.col("a") + 1).alias("fid"), F.array(F.col("a") + n, F.col("a") + 1, F.col("a") + n + 1).alias("vs")))).alias("f"))
    return Mesh(v, f.select(F.lit(mesh_id).alias("mesh_id"), "f.fid", "f.vs"), parts=cells // CELLS_A_PART if cells > 4 * CELLS_A_PART else None)


def tiles(spark: SparkSession, sf_dir: str, size: int = 16) -> Mesh:
    """The terrain cut into tiles of ``size`` cells a side: many small meshes with shared ids."""
    orders = _table(spark, sf_dir, "orders")
    n = math.isqrt(orders.count())
    t = terrain(spark, sf_dir)
    cell = F.floor(F.col("fid") / 2)
    tile = F.concat_ws("-", F.floor(cell % n / size).cast("int"), F.floor(F.floor(cell / n) / size).cast("int"))
    faces = t.faces.select(tile.alias("mesh_id"), "fid", "vs")
    used = faces.select("mesh_id", F.explode("vs").alias("vid")).distinct()
    return Mesh(used.join(t.vertices.drop("mesh_id"), "vid").select("mesh_id", "vid", "x", "y", "z"), faces)


def event_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downward rays from above the terrain: (ray_id, ox … dz), places from ids and values."""
    n = math.isqrt(_table(spark, sf_dir, "orders").count())
    e = _table(spark, sf_dir, "events")
    x = (F.col("event_id") * 7 % (n - 1)).cast("double") + 0.25 + F.col("user_id") % 3 * 0.125
    y = (F.col("event_id") * 13 % (n - 1)).cast("double") + 0.125 + F.col("user_id") % 5 * 0.0625
    return e.select(F.col("event_id").alias("ray_id"), x.alias("ox"), y.alias("oy"), F.lit(1000.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_rays(spark, sf_dir)
    return r.select(F.col("ray_id").alias("pt_id"), F.col("ox").alias("x"), F.col("oy").alias("y"), (F.col("ray_id") % 11).cast("double").alias("z"))


def point_cloud(spark: SparkSession, sf_dir: str) -> Mesh:
    """First three components of the embeddings as vertices without faces."""
    e = _table(spark, sf_dir, "embeddings")
    v = e.select(F.lit("cloud").alias("mesh_id"), F.col("vec_id").alias("vid"), *(F.element_at("embedding", k + 1).cast("double").alias(c) for k, c in enumerate("xyz")))
    return Mesh(v, Mesh.empty(spark).faces)


#: The same terrain as common table expressions, for DuckDB.
TERRAIN_SQL = """dim AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM orders),
v AS (SELECT o_orderkey AS vid, CAST(o_orderkey % n AS DOUBLE) AS x, CAST(floor(o_orderkey / n) AS DOUBLE) AS y, o_totalprice / 100000.0 AS z, n FROM orders, dim WHERE o_orderkey < n * n),
q AS (SELECT vid AS a, n FROM v WHERE x < n - 1 AND y < n - 1),
f AS (SELECT 2 * a AS fid, a AS v0, a + 1 AS v1, a + n AS v2 FROM q UNION ALL SELECT 2 * a + 1, a + n, a + 1, a + n + 1 FROM q),
h AS MATERIALIZED (SELECT fid, 0 AS slot, v0 AS src, v1 AS dst, v2 AS opp FROM f UNION ALL SELECT fid, 1, v1, v2, v0 FROM f UNION ALL SELECT fid, 2, v2, v0, v1 FROM f),
e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n_faces FROM h GROUP BY 1, 2),
adj AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT f.*, p.x AS ax, p.y AS ay, p.z AS az, q1.x AS bx, q1.y AS by_, q1.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
      FROM f JOIN v p ON p.vid = v0 JOIN v q1 ON q1.vid = v1 JOIN v r ON r.vid = v2),
g AS (SELECT *, bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS wx, cy - ay AS wy, cz - az AS wz FROM t),
tn AS (SELECT *, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM g),
ta AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n2 FROM tn)"""
