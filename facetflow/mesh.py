"""The mesh: relations keyed by ``mesh_id``, and the views derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTICES = T.StructType(
    [T.StructField("mesh_id", T.StringType()), T.StructField("vid", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "xyz")]
)
FACES = T.StructType(
    [T.StructField("mesh_id", T.StringType()), T.StructField("fid", T.LongType()), T.StructField("vs", T.ArrayType(T.LongType()))]
)
#: Directed edge ids are ``fid * SLOTS + slot``: stable without any sort.
SLOTS = 1 << 12


@dataclass
class Mesh:
    """Any number of meshes.  ``faces.vs`` is the source of truth for topology;
    vertex attributes are further columns of ``vertices``, face attributes of
    ``faces``, and directed edge attributes a table of their own.  ``parts`` is
    known for one large mesh alone: partitions for a shuffle of its faces."""

    vertices: DataFrame
    faces: DataFrame
    dart_attrs: DataFrame | None = None
    parts: int | None = None
    _views: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    @classmethod
    def from_lists(cls, spark: SparkSession, points, polygons, mesh_id: str = "m") -> "Mesh":
        """Indexed input on the driver; for fixtures and generators."""
        n = len(points)
        for poly in polygons:
            for i in poly:
                if not 0 <= i < n:
                    raise IndexError(f"index {i} out of range for {n} vertices")
        vs = [(mesh_id, i, float(p[0]), float(p[1]), float(p[2])) for i, p in enumerate(points)]
        fs = [(mesh_id, i, [int(j) for j in poly]) for i, poly in enumerate(p for p in polygons if len(p) >= 3)]
        return cls(spark.createDataFrame(vs, VERTICES), spark.createDataFrame(fs, FACES))

    @classmethod
    def empty(cls, spark: SparkSession) -> "Mesh":
        return cls(spark.createDataFrame([], VERTICES), spark.createDataFrame([], FACES))

    def with_vertices(self, vertices: DataFrame) -> "Mesh":
        return Mesh(vertices, self.faces, self.dart_attrs, self.parts)

    def with_faces(self, faces: DataFrame) -> "Mesh":
        return Mesh(self.vertices, faces, parts=self.parts)

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` dealt by ``keys`` over ``parts``, so that a task's share stays the same however large the mesh."""
        return df if self.parts is None else df.repartition(max(self.parts, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), *keys)

    def persist(self) -> "Mesh":
        """Keep the derived views too; ``unpersist`` drops them (caches need no invalidation)."""
        self.vertices, self.faces = self.vertices.persist(), self.faces.persist()
        self._views = {}
        self._views["darts"] = self.darts.persist()
        return self

    def unpersist(self) -> "Mesh":
        for df in (self.vertices, self.faces, *self._views.values()):
            df.unpersist()
        self._views = {}
        return self

    def _view(self, name: str, make) -> DataFrame:
        if name not in self._views:
            self._views[name] = make()
        return self._views[name]

    @property
    def corners(self) -> DataFrame:
        """One row per face corner: the interior directed edge src -> dst.

        ``opp`` is the remaining vertex of a triangle, else null.  No shuffle.  A
        face of more than ``SLOTS`` corners raises once its ids are asked for.
        Joins shuffle: by Spark's guess, which takes an exploded list for one
        row, millions of corners are small enough to go through the driver.
        """

        def make():
            c = self.faces.where(F.size("vs") >= 3).select("mesh_id", "fid", "vs", F.size("vs").alias("n"), F.posexplode("vs").alias("slot", "src"))
            # ids of a larger polygon would run into those of the next face
            first = F.when(F.col("n") <= SLOTS, F.col("fid") * SLOTS).otherwise(F.raise_error(F.lit(f"a face has more than {SLOTS} corners; triangulate it first")))
            return c.select(
                "mesh_id",
                "fid",
                "slot",
                "n",
                "src",
                F.expr("vs[(slot + 1) % n]").alias("dst"),
                F.expr("CASE WHEN n = 3 THEN vs[(slot + 2) % 3] END").alias("opp"),
                (first + F.col("slot")).alias("heid"),
                (first + F.expr("(slot + 1) % n")).alias("next"),
                (first + F.expr("(slot + n - 1) % n")).alias("prev"),
            ).hint("merge")

        return self._view("corners", make)

    @property
    def paired(self) -> DataFrame:
        """Interior directed edges with ``twin`` (null on the border).

        One shuffle: both directions of an edge meet under its undirected key.
        A directed edge that occurs twice pairs with the smallest opposite id.
        """

        def make():
            c = self.corners.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
            back = self.corners.groupBy("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.min("heid").alias("twin"))
            return c.join(back, ["mesh_id", "src", "dst"], "left").select(
                "mesh_id", "heid", "fid", "slot", "n", "src", "dst", "opp", "next", "prev", "twin", "a", "b"
            )

        return self._view("paired", make)

    @property
    def darts(self) -> DataFrame:
        """All directed edges: interior ones, and a border row (fid null) per unpaired one.

        A border directed edge has the id ``-heid - 1`` of its interior partner; its
        successor is the border directed edge that starts at its tip.
        """

        def make():
            inner = self.paired
            rim = inner.where("twin IS NULL").select(
                "mesh_id", (-F.col("heid") - 1).alias("heid"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("heid").alias("twin")
            )
            after = rim.groupBy("mesh_id", "src").agg(F.min("heid").alias("next")).withColumnRenamed("src", "dst")
            before = rim.groupBy("mesh_id", "dst").agg(F.min("heid").alias("prev")).withColumnRenamed("dst", "src")
            linked = rim.join(after, ["mesh_id", "dst"], "left").join(before, ["mesh_id", "src"], "left")
            names = ["mesh_id", "heid", "fid", "slot", "src", "dst", "opp", "next", "prev", "twin"]
            inside = inner.withColumn("twin", F.coalesce("twin", -F.col("heid") - 1)).select(*names)
            outside = linked.select(
                "mesh_id", "heid", F.lit(None).cast("long").alias("fid"), F.lit(None).cast("int").alias("slot"), "src", "dst",
                F.lit(None).cast("long").alias("opp"), "next", "prev", "twin",
            )
            return inside.unionByName(outside)

        return self._view("darts", make)

    @property
    def edges(self) -> DataFrame:
        """Undirected edges a < b: number of incident faces, smallest directed edge."""

        def make():
            return self.corners.groupBy("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
                F.count("*").cast("int").alias("n_faces"), F.min("heid").alias("heid")
            )

        return self._view("edges", make)

    @property
    def adjacency(self) -> DataFrame:
        """Both directions of every edge: (mesh_id, src, dst)."""

        def make():
            e = self.edges.select("mesh_id", "a", "b")
            both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
            return e.select("mesh_id", both.alias("e")).select("mesh_id", "e.src", "e.dst")

        return self._view("adjacency", make)

    def points(self, key: str, prefix: str) -> DataFrame:
        """Vertex positions renamed for a join: key column and ``{prefix}x…``."""
        return self.vertices.select("mesh_id", F.col("vid").alias(key), *(F.col(c).alias(prefix + c) for c in "xyz"))

    @property
    def triangles(self) -> DataFrame:
        """Triangles with positions a, b, c: (mesh_id, fid, v0, v1, v2, ax … cz).

        One join a corner: a row a face is shuffled and sorted, where exploded
        corners and their aggregate take three, each as wide as the triangle.
        Faces of other sizes are left out.
        """

        def make():
            t = self.faces.where(F.size("vs") == 3).select("mesh_id", "fid", *(F.col("vs")[s].alias(f"v{s}") for s in range(3)))
            for s, p in enumerate("abc"):
                t = self.spread(t, f"v{s}").hint("merge").join(self.points(f"v{s}", p), ["mesh_id", f"v{s}"])
            return t.select("mesh_id", "fid", "v0", "v1", "v2", *(p + c for p in "abc" for c in "xyz"))

        return self._view("triangles", make)


def dart_id(fid, slot):
    return fid * SLOTS + slot
