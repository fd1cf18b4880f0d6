"""Distributed connected components by contraction.

Each round every node hooks onto the neighbour (or itself) with most edges, by
smallest hash among equals; the edge list is rewritten on the hooks and loses
its loops and repeats.  Stars vanish in a round, and since hashes are drawn anew
each round, long chains shrink by a constant factor.  No step gathers a component
in a task: hooks are partial aggregates and the joins are plain equi-joins that
adaptive execution can split.

What is left once it is counted and few is settled on the driver: each round is
a dozen shuffles, which cost more than so short a list, whatever the machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .lineage import Scratch

#: Edges that a task contracts at once.
NEAR_EDGES = 500_000
#: Edges that the driver may settle (some 0.5 KB each while it does).
DRIVER_EDGES = 50_000


def _plain(kind: T.DataType) -> bool:
    """Types whose values Python orders as Spark does."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind)
    return isinstance(kind, (T.IntegralType, T.StringType))


def _order(x):
    return tuple(map(_order, x)) if isinstance(x, tuple) else (x is not None, x)


def _settled(edges: DataFrame) -> DataFrame:
    """``(id, up)`` of all ends of a few edges ``(u, v)``; up = smallest id of the component."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for u, v in edges.collect():
        a, b = (root(up.setdefault(x, x)) for x in (u, v))
        if a != b:
            a, b = sorted((a, b), key=_order)
            up[b] = a
    kind = edges.schema["u"].dataType
    wide = to_arrow_type(kind)
    table = pa.table({"id": pa.array(list(up), wide), "up": pa.array([root(x) for x in up], wide)})
    return edges.sparkSession.createDataFrame(table, T.StructType([T.StructField("id", kind), T.StructField("up", kind)]))


def _codes(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ones."""
    if not pa.types.is_struct(ids.type):
        return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.zeros(len(ids), np.int64)
    for x in ids.flatten():
        rank = _codes(x)
        code = np.unique(code * (rank.max() + 1) + rank, return_inverse=True)[1] if len(rank) else rank
    return code


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task to rows (id, up): every node below the smallest it reaches within a stretch of them."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held])
        _, first, node = np.unique(_codes(ids), return_index=True, return_inverse=True)
        u, v = node[: len(node) // 2], node[len(node) // 2 :]
        up = np.arange(len(first))
        while True:
            u, v = up[u], up[v]
            apart = u != v
            if not apart.any():
                break
            u, v = u[apart], v[apart]
            np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
            while (up != up[up]).any():
                up = up[up]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), ids.take(pa.array(first[up]))], ["id", "up"])

    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= NEAR_EDGES:
            yield settle(held)
            held, n = [], 0
    if n:
        yield settle(held)


def _near_first(given: DataFrame, count: int, scratch: Scratch, max_rounds: int) -> DataFrame:
    """Components where ids near each other tend to hang together.

    Ranges of ids are contracted in one task each; the rounds are left with what
    hangs together across ranges.  A local component has its smallest node for a
    root, and one that is part of more shares a node with another range.
    """
    kind = T.StructType([T.StructField(c, given.schema["u"].dataType) for c in ("id", "up")])
    near = given.repartitionByRange(count // NEAR_EDGES + 1, "u").mapInArrow(_contracted, kind)
    ups = near.groupBy("id").agg(F.collect_set("up").alias("ups"))
    near = scratch.cut(ups.select("id", F.array_min("ups").alias("up"), F.when(F.size("ups") > 1, F.col("ups")).alias("ups")), "cc-near")
    far = near.where("ups IS NOT NULL").select(F.explode("ups").alias("u"), F.col("up").alias("v")).where("u <> v")
    rest = connected_components(far.distinct(), "u", "v", max_rounds)
    out = scratch.cut(near.join(rest.withColumnRenamed("id", "up"), "up", "left").select("id", F.coalesce("component", "up").alias("component")), "cc-labels")
    scratch.release(but=(out,))
    return out


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 200, near: bool = False) -> DataFrame:
    """Rows ``(id, component)`` for every node of ``edges``; component = smallest id.

    Loops only name their node; null ends are ignored.  Any orderable id type
    works, structs included.  An empty edge list gives an empty result.  near:
    ids near each other tend to hang together, so that ranges go first.
    """
    scratch = Scratch(edges.sparkSession)
    cut = scratch.cut
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    plain = _plain(given.schema["u"].dataType) and given.schema["u"].dataType == given.schema["v"].dataType
    if plain:
        given = cut(given, "cc-given")
        count = given.count()
        if near and count > DRIVER_EDGES:
            return _near_first(given, count, scratch, max_rounds)
        if count <= DRIVER_EDGES:
            out = cut(_settled(given).withColumnRenamed("up", "component"), "cc-labels")
            scratch.release(but=(out,))
            return out
    live = given.where("u <> v")
    hooks: list[DataFrame] = []
    nodes = given.select(F.col("u").alias("id")).union(given.select(F.col("v").alias("id"))).distinct()
    for step in range(max_rounds):
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        both = cut(both, "cc-edges")
        if both.isEmpty():
            scratch.release(but=(given, *hooks))
            break
        if plain and both.count() <= 2 * DRIVER_EDGES:
            hooks.append(cut(_settled(both.where("u < v")), "cc-hooks"))
            scratch.release(but=(given, *hooks))
            break
        degree = both.groupBy("u").agg(F.count("*").alias("d"))
        order = lambda c, d: F.struct((-F.col(d)).alias("d"), F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("x"))
        ranked = both.join(degree.withColumnRenamed("u", "v"), "v")
        hook = ranked.groupBy("u").agg(F.min(order("v", "d")).alias("m"), F.count("*").alias("own")).select(
            F.col("u").alias("id"), F.least(F.col("m"), order("u", "own"))["x"].alias("up")
        )
        hook = cut(hook, "cc-hooks")
        hooks.append(hook)
        scratch.release(but=(given, *hooks, both))
        left = hook.select(F.col("id").alias("u"), F.col("up").alias("pu"))
        right = hook.select(F.col("id").alias("v"), F.col("up").alias("pv"))
        live = both.where("u < v").join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    top = None
    for hook in reversed(hooks):
        if top is None:
            top = hook
        else:
            up = top.select(F.col("id").alias("up"), F.col("up").alias("root"))
            top = hook.join(up, "up", "left").select("id", F.coalesce("root", "up").alias("up"))
    if top is None:  # nothing but loops
        return nodes.select("id", F.col("id").alias("component"))
    rooted = nodes.join(top, "id", "left").select("id", F.coalesce("up", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    out = cut(rooted.join(least, "root").select("id", "component"), "cc-labels")
    scratch.release(but=(out,))
    return out
