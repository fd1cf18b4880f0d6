"""One grouped Arrow kernel per mesh, for algorithms that are sequential by nature.

Meshes run in parallel; a kernel sees the vertices (with any columns joined to
them) and the faces of one mesh.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from .lineage import cut

MESH_ROWS = "mesh_id string, kind string, id long, x double, y double, z double, vs array<long>"


def per_mesh(mesh: Mesh, kernel: Callable[[pd.DataFrame, list[list[int]], list[int]], pd.DataFrame], schema: str, extra: DataFrame | None = None) -> DataFrame:
    """``kernel(vertices, faces, face_ids)`` per mesh; its frame lacks only ``mesh_id``.

    Vertices come sorted by id, and faces refer to their row numbers.  extra:
    columns by (mesh_id, vid) to join to the vertices; missing ones are null.
    """
    vs = mesh.vertices if extra is None else mesh.vertices.join(extra, ["mesh_id", "vid"], "left")

    def run(key, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("vid").reset_index(drop=True)
        f = f.sort_values("fid")
        row = pd.Series(np.arange(len(v)), index=v["vid"].to_numpy())
        faces = [[int(row[i]) for i in vs] for vs in f["vs"]]
        out = kernel(v, faces, [int(i) for i in f["fid"]])
        out.insert(0, "mesh_id", key[0])
        return out

    # fresh names: both sides may stem from one plan
    left = vs.select(*(F.col(c).alias(c) for c in vs.columns))
    right = mesh.faces.select(*(F.col(c).alias(c) for c in ("mesh_id", "fid", "vs")))
    return left.groupBy("mesh_id").cogroup(right.groupBy("mesh_id")).applyInPandas(run, schema)


def edit(mesh: Mesh, kernel: Callable[[np.ndarray, list[list[int]]], tuple[np.ndarray, list[list[int]]]]) -> Mesh:
    """A kernel from points and faces to points and faces, as a new mesh."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        points, made = kernel(v[["x", "y", "z"]].to_numpy(float), faces)
        n = len(points)
        top = pd.DataFrame({"kind": "v", "id": np.arange(n), "x": points[:, 0] if n else [], "y": points[:, 1] if n else [], "z": points[:, 2] if n else [], "vs": [None] * n})
        low = pd.DataFrame({"kind": "f", "id": np.arange(len(made)), "x": np.nan, "y": np.nan, "z": np.nan, "vs": [[int(i) for i in f] for f in made]})
        return pd.concat([x for x in (top, low) if len(x)] or [top], ignore_index=True)

    rows = cut(per_mesh(mesh, run, MESH_ROWS), "edited")
    return Mesh(
        rows.where("kind = 'v'").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z"),
        rows.where("kind = 'f'").select("mesh_id", F.col("id").alias("fid"), "vs"),
    )
