"""Signed distance functions as Columns, and marching cubes over lattice rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec3 as v
from ..mesh import Mesh


class Sdf:
    """``eval`` maps coordinate columns to a signed distance column; negative is inside."""

    def eval(self, x: Column, y: Column, z: Column) -> Column:
        raise NotImplementedError

    def gradient(self, x: Column, y: Column, z: Column, eps: float = 1e-6) -> v.V3:
        """Central differences."""
        p = (x, y, z)
        out = []
        for k in range(3):
            hi = [c + eps if i == k else c for i, c in enumerate(p)]
            lo = [c - eps if i == k else c for i, c in enumerate(p)]
            out.append((self.eval(*hi) - self.eval(*lo)) / (2 * eps))
        return tuple(out)

    def __or__(self, other: "Sdf") -> "Sdf":
        return Union(self, other)

    def __and__(self, other: "Sdf") -> "Sdf":
        return Intersection(self, other)

    def __sub__(self, other: "Sdf") -> "Sdf":
        return Difference(self, other)


@dataclass
class Sphere(Sdf):
    center: tuple[float, float, float] = (0.0, 0.0, 0.0)
    radius: float = 1.0

    def eval(self, x, y, z):
        return v.length(v.sub((x, y, z), v.lit(*self.center))) - self.radius


@dataclass
class Box(Sdf):
    half: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def eval(self, x, y, z):
        q = [F.abs(c) - h for c, h in zip((x, y, z), self.half)]
        out = v.length(tuple(F.greatest(c, F.lit(0.0)) for c in q))
        return out + F.least(F.greatest(*q), F.lit(0.0))


@dataclass
class Capsule(Sdf):
    a: tuple[float, float, float] = (0.0, 0.0, 0.0)
    b: tuple[float, float, float] = (0.0, 1.0, 0.0)
    radius: float = 0.5

    def eval(self, x, y, z):
        pa, ba = v.sub((x, y, z), v.lit(*self.a)), [q - p for p, q in zip(self.a, self.b)]
        size = sum(c * c for c in ba)
        h = v.clamp(sum(p * c for p, c in zip(pa, ba)) / size, 0.0, 1.0) if size > 0 else F.lit(0.0)
        return v.length(tuple(p - h * c for p, c in zip(pa, ba))) - self.radius


@dataclass
class Torus(Sdf):
    """Around the y-axis."""

    major: float = 1.0
    minor: float = 0.25

    def eval(self, x, y, z):
        q = F.sqrt(x * x + z * z) - self.major
        return F.sqrt(q * q + y * y) - self.minor


@dataclass
class Expression(Sdf):
    """Any function of three Columns."""

    fn: object

    def eval(self, x, y, z):
        return self.fn(x, y, z)


@dataclass
class Union(Sdf):
    a: Sdf
    b: Sdf

    def eval(self, x, y, z):
        return F.least(self.a.eval(x, y, z), self.b.eval(x, y, z))


@dataclass
class Intersection(Sdf):
    a: Sdf
    b: Sdf

    def eval(self, x, y, z):
        return F.greatest(self.a.eval(x, y, z), self.b.eval(x, y, z))


@dataclass
class Difference(Sdf):
    a: Sdf
    b: Sdf

    def eval(self, x, y, z):
        return F.greatest(self.a.eval(x, y, z), -self.b.eval(x, y, z))


@dataclass
class SmoothUnion(Sdf):
    """Polynomial smooth minimum of width k."""

    a: Sdf
    b: Sdf
    k: float = 0.1

    def eval(self, x, y, z):
        p, q = self.a.eval(x, y, z), self.b.eval(x, y, z)
        h = v.clamp((q - p) / self.k * 0.5 + 0.5, 0.0, 1.0)
        return q + (p - q) * h - h * (1 - h) * self.k


@dataclass
class Translate(Sdf):
    inner: Sdf
    offset: tuple[float, float, float]

    def eval(self, x, y, z):
        return self.inner.eval(*(c - o for c, o in zip((x, y, z), self.offset)))


@dataclass
class Grid:
    """nx × ny × nz cells from an origin."""

    n: tuple[int, int, int]
    origin: tuple[float, float, float]
    cell: tuple[float, float, float]


def sample(spark: SparkSession, sdf: Sdf, grid: Grid, grid_id: str = "g") -> DataFrame:
    """Lattice rows (grid_id, ix, iy, iz, val), (nx+1)(ny+1)(nz+1) of them, made in parallel."""
    mx, my, mz = (k + 1 for k in grid.n)
    r = spark.range(mx * my * mz)
    r = r.select((F.col("id") % mx).cast("int").alias("ix"), (F.floor(F.col("id") / mx) % my).cast("int").alias("iy"), F.floor(F.col("id") / (mx * my)).cast("int").alias("iz"))
    at = [F.col("i" + k) * c + o for k, c, o in zip("xyz", grid.cell, grid.origin)]
    return r.select(F.lit(grid_id).alias("grid_id"), "ix", "iy", "iz", sdf.eval(*at).alias("val"))


# corner c of a cube sits at its bits (x = 1, y = 2, z = 4); an edge joins two corners that differ in one bit
EDGES = [(c, c | (1 << k), k) for k in range(3) for c in range(8) if not c >> k & 1]
EDGE_OF = {(a, b): i for i, (a, b, _) in enumerate(EDGES)} | {(b, a): i for i, (a, b, _) in enumerate(EDGES)}


def _face_rings() -> list[list[int]]:
    """Corners of the six faces, counter-clockwise seen from outside."""
    out = []
    for k in range(3):
        u, w = (k + 1) % 3, (k + 2) % 3
        square = [0, 1 << u, (1 << u) | (1 << w), 1 << w]
        out.append([c | (1 << k) for c in square])
        out.append(square[::-1])
    return out


@lru_cache(maxsize=1)
def cases() -> list[list[tuple[int, int, int]]]:
    """Triangles of cut edges for each of the 256 corner patterns, made by rule.

    On every face the surface runs from the edge where a walk around the face
    leaves the inside to the edge where that walk entered it, so two diagonal
    inside corners stay apart and neighbouring cubes agree.  The runs join to
    loops, and loops are cut into fans.
    """
    rings = _face_rings()
    table = []
    for pattern in range(256):
        inside = [bool(pattern >> c & 1) for c in range(8)]
        nxt: dict[int, int] = {}
        for ring in rings:
            entered = None
            walk = [(ring[i], ring[(i + 1) % 4]) for i in range(4)]
            # begin where the walk enters the inside, if it does
            starts = [i for i, (a, b) in enumerate(walk) if not inside[a] and inside[b]]
            if not starts:
                continue
            for i in range(4):
                a, b = walk[(starts[0] + i) % 4]
                if not inside[a] and inside[b]:
                    entered = EDGE_OF[a, b]
                elif inside[a] and not inside[b]:
                    nxt[EDGE_OF[a, b]] = entered
        tris, seen = [], set()
        for s in sorted(nxt):
            if s in seen:
                continue
            loop, at = [], s
            while at not in seen:
                seen.add(at)
                loop.append(at)
                at = nxt[at]
            tris += [(loop[0], loop[i + 1], loop[i]) for i in range(1, len(loop) - 1)]
        table.append(tris)
    return table


def march(field: DataFrame, grid: Grid, iso: float = 0.0) -> Mesh:
    """Surface val = iso of lattice rows, inside below; vertices are shared between cubes.

    A vertex is named by its lattice edge, so welding needs no comparison: id =
    3 × lattice index + axis.  Cubes gather their corners by one exploded
    equi-aggregate instead of seven self-joins.
    """
    mx, my, mz = (k + 1 for k in grid.n)
    f = field.select("grid_id", "ix", "iy", "iz", (F.col("val") < iso).alias("in_"), "val")
    # every lattice point offers itself to the eight cubes around it
    offers = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(c & 1).alias("dx"), F.lit(c >> 1 & 1).alias("dy"), F.lit(c >> 2 & 1).alias("dz")) for c in range(8))))
    cubes = f.select("grid_id", (F.col("ix")).alias("ix"), "iy", "iz", "in_", "val", offers.alias("o")).select(
        "grid_id", (F.col("ix") - F.col("o.dx")).alias("cx"), (F.col("iy") - F.col("o.dy")).alias("cy"), (F.col("iz") - F.col("o.dz")).alias("cz"), F.col("o.c").alias("c"), "in_", "val"
    ).where(f"cx BETWEEN 0 AND {grid.n[0] - 1} AND cy BETWEEN 0 AND {grid.n[1] - 1} AND cz BETWEEN 0 AND {grid.n[2] - 1}")
    cubes = cubes.groupBy("grid_id", "cx", "cy", "cz").agg(
        F.sum(F.when(F.col("in_"), F.expr("shiftleft(1, c)")).otherwise(0)).cast("int").alias("pattern"), F.count("*").alias("n")
    ).where("n = 8 AND pattern > 0 AND pattern < 255")
    spark = field.sparkSession
    flat = [(p, k, list(t)) for p, ts in enumerate(cases()) for k, t in enumerate(ts)]
    table = F.broadcast(spark.createDataFrame(flat, "pattern int, k int, edges array<int>"))  # at most 256 x 5 rows
    tris = cubes.join(table, "pattern")
    index = "((CAST(cz + {z} AS LONG) * {my} + cy + {y}) * {mx} + cx + {x}) * 3 + {k}"
    ids = [index.format(x=a & 1, y=a >> 1 & 1, z=a >> 2 & 1, k=k, mx=mx, my=my) for a, _, k in EDGES]
    vid = "element_at(array(" + ", ".join(ids) + "), e + 1)"
    cube = "(CAST(cz AS LONG) * {my} + cy) * {mx} + cx".format(mx=mx, my=my)
    faces = tris.select(F.col("grid_id").alias("mesh_id"), F.expr(f"({cube}) * 8 + k").alias("fid"), F.expr(f"transform(edges, e -> {vid})").alias("vs"))
    # cut lattice edges: each point with its neighbour ahead on each axis
    ahead = f.select("grid_id", "in_", "val", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(int(i == k)).alias("d" + c) for i, c in enumerate("xyz"))) for k in range(3)))).alias("o"), "ix", "iy", "iz")
    back = ahead.select("grid_id", (F.col("ix") - F.col("o.dx")).alias("ix"), (F.col("iy") - F.col("o.dy")).alias("iy"), (F.col("iz") - F.col("o.dz")).alias("iz"), F.col("o.k").alias("k"), F.col("in_").alias("in2"), F.col("val").alias("val2"))
    cut_ = f.join(back, ["grid_id", "ix", "iy", "iz"]).where("in_ <> in2")
    t = (F.lit(iso) - F.col("val")) / (F.col("val2") - F.col("val"))
    at = [(F.col("i" + c) + F.when(F.col("k") == i, t).otherwise(F.lit(0.0))) * s + o for i, (c, s, o) in enumerate(zip("xyz", grid.cell, grid.origin))]
    lid = F.expr(f"((CAST(iz AS LONG) * {my} + iy) * {mx} + ix) * 3 + k")
    vertices = cut_.select(F.col("grid_id").alias("mesh_id"), lid.alias("vid"), *(x.alias(c) for x, c in zip(at, "xyz")))
    return Mesh(vertices, faces)


def march_sdf(spark: SparkSession, sdf: Sdf, grid: Grid, iso: float = 0.0, mesh_id: str = "g") -> Mesh:
    return march(sample(spark, sdf, grid, mesh_id), grid, iso)
