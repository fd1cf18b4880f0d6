"""Element attributes and selections: nullable columns and join-updates.

Vertex attributes are columns of ``vertices``, face attributes of ``faces``;
directed edge attributes live in ``dart_attrs`` by (mesh_id, heid).  A selection
is a boolean column where null counts as false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.lineage import cut
from .measure import face_geometry, vertex_normals

KEYS = {"vertex": "vid", "face": "fid", "dart": "heid"}
#: Built-in attributes: element, columns and type.
BUILTIN = {
    "vertex_normal": ("vertex", ("n_x", "n_y", "n_z"), "double"),
    "vertex_color": ("vertex", ("c_r", "c_g", "c_b"), "double"),
    "vertex_uv": ("vertex", ("uv_u", "uv_v"), "double"),
    "vertex_selected": ("vertex", ("selected",), "boolean"),
    "vertex_size": ("vertex", ("size",), "double"),
    "face_normal": ("face", ("n_x", "n_y", "n_z"), "double"),
    "face_selected": ("face", ("selected",), "boolean"),
    "face_color": ("face", ("c_r", "c_g", "c_b"), "double"),
    "face_opacity": ("face", ("opacity",), "double"),
    "dart_selected": ("dart", ("selected",), "boolean"),
    "dart_color": ("dart", ("c_r", "c_g", "c_b"), "double"),
    "dart_thickness": ("dart", ("thickness",), "double"),
}


def table(mesh: Mesh, element: str) -> DataFrame:
    if element == "vertex":
        return mesh.vertices
    if element == "face":
        return mesh.faces
    return mesh.dart_attrs if mesh.dart_attrs is not None else mesh.darts.select("mesh_id", "heid")


def with_table(mesh: Mesh, element: str, df: DataFrame) -> Mesh:
    if element == "vertex":
        return Mesh(df, mesh.faces, mesh.dart_attrs)
    if element == "face":
        return Mesh(mesh.vertices, df, mesh.dart_attrs)
    return Mesh(mesh.vertices, mesh.faces, df)


def properties(mesh: Mesh, element: str) -> list[str]:
    core = {"mesh_id", "vid", "x", "y", "z", "fid", "vs", "heid"}
    return [c for c in table(mesh, element).columns if c not in core]


def has_property(mesh: Mesh, element: str, name: str) -> bool:
    return name in properties(mesh, element)


def add_property(mesh: Mesh, element: str, name: str, kind: str, value=None) -> Mesh:
    """A column of any Spark type; one that exists is kept as it is."""
    if has_property(mesh, element, name):
        return mesh
    return with_table(mesh, element, table(mesh, element).withColumn(name, F.lit(value).cast(kind)))


def add_builtin(mesh: Mesh, name: str) -> Mesh:
    element, columns, kind = BUILTIN[name]
    for c in columns:
        mesh = add_property(mesh, element, c, kind)
    return mesh


def drop_property(mesh: Mesh, element: str, name: str) -> Mesh:
    return with_table(mesh, element, table(mesh, element).drop(name))


def set_property(mesh: Mesh, element: str, name: str, values: DataFrame) -> Mesh:
    """values: (mesh_id, id, value) by the element's id column; other rows keep theirs."""
    key = KEYS[element]
    t = table(mesh, element)
    new = values.select("mesh_id", F.col(key), F.col("value").alias("__new"), F.lit(True).alias("__set"))
    old = F.col(name) if name in t.columns else F.lit(None)
    j = t.join(new, ["mesh_id", key], "left")
    out = F.when(F.col("__set"), F.col("__new")).otherwise(old)
    return with_table(mesh, element, j.withColumn(name, out).drop("__new", "__set"))


def get_property(mesh: Mesh, element: str, name: str) -> DataFrame:
    return table(mesh, element).select("mesh_id", KEYS[element], F.col(name).alias("value"))


def remove_property_of(mesh: Mesh, element: str, name: str, ids: DataFrame) -> Mesh:
    """Null the property for the given ids."""
    kind = dict(table(mesh, element).dtypes)[name]
    return set_property(mesh, element, name, ids.select("mesh_id", KEYS[element], F.lit(None).cast(kind).alias("value")))


def clear_property(mesh: Mesh, element: str, name: str) -> Mesh:
    t = table(mesh, element)
    return with_table(mesh, element, t.withColumn(name, F.lit(None).cast(dict(t.dtypes)[name])))


def property_count(mesh: Mesh, element: str, name: str) -> DataFrame:
    return table(mesh, element).groupBy("mesh_id").agg(F.count(name).alias("n"))


def remove_elements(mesh: Mesh, element: str, ids: DataFrame) -> Mesh:
    """Delete elements with all their attributes."""
    key = KEYS[element]
    t = table(mesh, element)
    return with_table(mesh, element, t.join(ids.select("mesh_id", key), ["mesh_id", key], "left_anti").select(*t.columns))


def populate_normals(mesh: Mesh) -> Mesh:
    """Fill vertex and face normals from the geometry."""
    n = vertex_normals(mesh).select("mesh_id", "vid", *(F.col("n" + k).alias("n_" + k) for k in "xyz"))
    f = face_geometry(mesh).select("mesh_id", "fid", *(F.col("n" + k).alias("n_" + k) for k in "xyz"))
    drop = [f"n_{k}" for k in "xyz"]
    return Mesh(mesh.vertices.drop(*drop).join(n, ["mesh_id", "vid"], "left"), mesh.faces.drop(*drop).join(f, ["mesh_id", "fid"], "left"), mesh.dart_attrs)


def collect_vectors(mesh: Mesh, columns: list[str], default: float = 0.0) -> DataFrame:
    """(mesh_id, values): one array per mesh in vertex order, missing values as the default."""
    row = F.array(*(F.coalesce(F.col(c), F.lit(default)) for c in columns))
    g = mesh.vertices.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("vid", row.alias("v")))).alias("l"))
    return g.select("mesh_id", F.expr("transform(l, x -> x.v)").alias("values"))


# selections


def select(mesh: Mesh, element: str, ids: DataFrame, on: bool = True) -> Mesh:
    return set_property(add_property(mesh, element, "selected", "boolean"), element, "selected", ids.select("mesh_id", KEYS[element]).distinct().withColumn("value", F.lit(on)))


def deselect(mesh: Mesh, element: str, ids: DataFrame) -> Mesh:
    return select(mesh, element, ids, False)


def _is_on():
    return F.coalesce(F.col("selected"), F.lit(False))


def toggle(mesh: Mesh, element: str, ids: DataFrame) -> Mesh:
    mesh = add_property(mesh, element, "selected", "boolean")
    key = KEYS[element]
    t = table(mesh, element)
    hit = ids.select("mesh_id", key).distinct().withColumn("__hit", F.lit(True))
    j = t.join(hit, ["mesh_id", key], "left")
    return with_table(mesh, element, j.withColumn("selected", F.when(F.col("__hit"), ~_is_on()).otherwise(_is_on())).drop("__hit"))


def select_all(mesh: Mesh, element: str, on: bool = True) -> Mesh:
    return with_table(mesh, element, table(mesh, element).withColumn("selected", F.lit(on)))


def clear_selection(mesh: Mesh, element: str) -> Mesh:
    return select_all(mesh, element, False)


def invert_selection(mesh: Mesh, element: str) -> Mesh:
    mesh = add_property(mesh, element, "selected", "boolean")
    return with_table(mesh, element, table(mesh, element).withColumn("selected", ~_is_on()))


def selected_ids(mesh: Mesh, element: str) -> DataFrame:
    return table(mesh, element).where(_is_on()).select("mesh_id", KEYS[element])


def count_selected(mesh: Mesh, element: str) -> DataFrame:
    return table(mesh, element).groupBy("mesh_id").agg(F.sum(_is_on().cast("long")).alias("n"))


def edge_twins(mesh: Mesh, darts: DataFrame) -> DataFrame:
    """Both directed edges of the edges given by one of them."""
    h = mesh.darts.select("mesh_id", "heid", "twin").join(darts.select("mesh_id", "heid").distinct(), ["mesh_id", "heid"], "left_semi")
    return h.select("mesh_id", F.explode(F.array("heid", "twin")).alias("heid")).distinct()


def select_edges(mesh: Mesh, darts: DataFrame, on: bool = True) -> Mesh:
    return select(mesh, "dart", cut(edge_twins(mesh, darts), "twins"), on)


def selected_edges(mesh: Mesh) -> DataFrame:
    """Each selected edge once, by its smaller directed edge id of interior faces first."""
    s = selected_ids(mesh, "dart").join(mesh.darts.select("mesh_id", "heid", "src", "dst"), ["mesh_id", "heid"])
    return s.groupBy("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("heid").alias("heid"))


def set_edge_property(mesh: Mesh, name: str, values: DataFrame) -> Mesh:
    """values: (mesh_id, heid, value); written to both directed edges."""
    h = mesh.darts.select("mesh_id", "heid", "twin").join(values, ["mesh_id", "heid"])
    both = h.select("mesh_id", F.explode(F.array("heid", "twin")).alias("heid"), "value").groupBy("mesh_id", "heid").agg(F.first("value").alias("value"))
    return set_property(mesh, "dart", name, both)


def edge_property(mesh: Mesh, name: str) -> DataFrame:
    """Value of an edge from either of its directed edges: (mesh_id, a, b, value)."""
    h = table(mesh, "dart").select("mesh_id", "heid", F.col(name).alias("value")).join(mesh.darts.select("mesh_id", "heid", "src", "dst"), ["mesh_id", "heid"])
    return h.groupBy("mesh_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("value").alias("value"))


def set_uniform(mesh: Mesh, element: str, name: str, value, kind: str = "double") -> Mesh:
    """One value for every element; opacity is clamped to [0, 1]."""
    if name == "opacity":
        value = min(max(float(value), 0.0), 1.0)
    return with_table(mesh, element, table(mesh, element).withColumn(name, F.lit(value).cast(kind)))


def set_opacity(mesh: Mesh, values: DataFrame) -> Mesh:
    """values: (mesh_id, fid, value), clamped to [0, 1]."""
    return set_property(mesh, "face", "opacity", values.select("mesh_id", "fid", F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)).alias("value")))
