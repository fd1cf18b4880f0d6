"""Sparse matrices as (mesh_id, i, j, v) rows, and solvers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solvers import Coo, bicgstab, conjugate_gradient
from ..mesh import Mesh
from ..plans.lineage import cut
from .measure import directed_weights
from .repair import number_new


def vertex_index(mesh: Mesh) -> DataFrame:
    """Dense row numbers per mesh: (mesh_id, vid, i), in id order."""
    return number_new(mesh.vertices.select("mesh_id", "vid"), ["vid"]).select("mesh_id", "vid", F.col("rank").alias("i"))


def assemble(entries: DataFrame, symmetric: bool = False) -> DataFrame:
    """Sum triplets; with ``symmetric`` an off-diagonal entry counts in both places."""
    e = entries.select("mesh_id", "i", "j", "v")
    if symmetric:
        e = e.unionByName(e.where("i <> j").select("mesh_id", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return e.groupBy("mesh_id", "i", "j").agg(F.sum("v").alias("v"))


def cotan_coo(mesh: Mesh) -> DataFrame:
    """Laplacian by vertex ids: L_ij = -w, L_ii = Σ w with w = (cot α + cot β) / 2."""
    w = directed_weights(mesh).withColumn("w", F.col("w") / 2)
    off = w.select("mesh_id", F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v"))
    diag = w.groupBy("mesh_id", "src").agg(F.sum("w").alias("v")).select("mesh_id", F.col("src").alias("i"), F.col("src").alias("j"), "v")
    return off.unionByName(diag)


def regularize(coo: DataFrame, lam: float) -> DataFrame:
    """Add λ to the stored diagonal entries."""
    return coo.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") + lam).otherwise(F.col("v")))


def jacobi(coo: DataFrame) -> DataFrame:
    d = coo.where("i = j")
    return d.select("mesh_id", "i", F.when(F.abs("v") > 1e-14, 1 / F.col("v")).otherwise(F.lit(1.0)).alias("m"))


def matvec(coo: DataFrame, x: DataFrame) -> DataFrame:
    """(mesh_id, i, y) of a product with (mesh_id, i, x)."""
    xs = x.select("mesh_id", F.col("i").alias("j"), "x")
    return coo.join(xs, ["mesh_id", "j"]).groupBy("mesh_id", "i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def solve(coo: DataFrame, rhs: DataFrame, tol: float = 1e-10, max_iter: int = 5000, symmetric: bool = True) -> DataFrame:
    """One kernel per mesh: (mesh_id, i, x); no rows for a system that does not converge."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([a["i"], a["j"], b["i"]]))
        at = lambda s: np.searchsorted(ids, s.to_numpy())
        m = Coo(len(ids), at(a["i"]), at(a["j"]), a["v"].to_numpy())
        right = np.bincount(at(b["i"]), weights=b["b"].to_numpy(), minlength=len(ids)) if len(b) else np.zeros(len(ids))
        x = conjugate_gradient(m, right, max_iter, tol) if symmetric else bicgstab(m, right, max_iter, tol)
        return pd.DataFrame({"mesh_id": key[0], "i": ids if x is not None else ids[:0], "x": x if x is not None else np.zeros(0)})

    return coo.groupBy("mesh_id").cogroup(rhs.select("mesh_id", "i", "b").groupBy("mesh_id")).applyInPandas(run, "mesh_id string, i long, x double")


def solve_distributed(coo: DataFrame, rhs: DataFrame, tol: float = 1e-8, max_iter: int = 200) -> DataFrame:
    """Conjugate gradients over DataFrames, for one system too large for a worker.

    rhs: (i, b).  Two scalars a step come to the driver; vectors stay distributed.
    """
    diag = coo.where("i = j").select("i", F.col("v").alias("d"))
    s = rhs.select("i", F.lit(0.0).alias("x"), F.col("b").alias("r")).join(diag, "i", "left")
    s = s.withColumn("d", F.coalesce("d", F.lit(1.0))).withColumn("p", F.col("r") / F.col("d"))
    s = cut(s, "cg")
    start, rz = s.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()
    if not start:
        return s.select("i", "x")
    for _ in range(max_iter):
        ap = coo.join(s.select(F.col("i").alias("j"), F.col("p").alias("pj")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("pj")).alias("ap"))
        t = cut(s.join(ap, "i", "left").fillna(0.0, ["ap"]), "cg")
        pap = t.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        if not pap or abs(pap) < 1e-30:
            raise ArithmeticError("the matrix is not positive definite")
        step = rz / pap
        t = t.withColumn("x", F.col("x") + step * F.col("p")).withColumn("r", F.col("r") - step * F.col("ap"))
        rr, new = t.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()
        if rr <= tol * tol * start:
            return t.select("i", "x")
        s = cut(t.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p")).select("i", "x", "r", "d", "p"), "cg")
        rz = new
    raise ArithmeticError(f"no convergence in {max_iter} steps")
