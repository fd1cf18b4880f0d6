"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles.  Two permutations of
``[0, D)`` give all coordinates: the first shuffles the shingle's place, the
second is read at that place plus the coordinate's number, i.e. circularly
shifted by one for each coordinate.  Bands of the signature are buckets;
documents with the same whole set are one node before banding, so that copies
cost nothing; links are confirmed on full sets (64-bit shingle fingerprints).

With 16 bands of 4 coordinates a pair at similarity 0.85 shares no band with a
probability of about 8e-6, one at 0.95 with less than 1e-11.

Defined results: a null, empty or wordless text has an empty set and is a
component of its own; a text of fewer words than a shingle is one shingle;
rows that repeat an id are one document, their sets are linked; a row without an
id is compared like others but names no component; a component without any id
has none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.lineage import Scratch
from . import bytesops as B
from .links import linked_components

UNIVERSE = 1 << 20
#: Ids, buckets and components may be broadcast up to this many (40 bytes each).
BROADCAST_IDS = 200_000


@lru_cache(maxsize=2)
def circulant(coords: int, universe: int = UNIVERSE, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one unrolled for reading ``coords`` in a row."""
    rng = np.random.default_rng(seed)
    first = rng.permutation(universe).astype(np.int32)
    second = rng.permutation(universe).astype(np.int32)
    rolled = np.concatenate([second, second[:coords]])
    return first, np.lib.stride_tricks.sliding_window_view(rolled, coords)


def signature(fingerprints: np.ndarray, coords: int) -> np.ndarray:
    first, shifted = circulant(coords)
    place = first[(fingerprints & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(coords, UNIVERSE, np.int32)
    for i in range(0, len(place), 4096):
        np.minimum(out, shifted[place[i : i + 4096]].min(axis=0), out=out)
    return out


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word; one long text is read in stretches that end between words."""
    hashes, rows = [], []
    for lo, hi in B.stretches(data, off, B.SPACE):
        part = B.LOWER[data[lo:hi]]
        local = off if hi - lo == len(data) else np.array([0, hi - lo])
        s, e, row = B.word_spans(part, local, B.SPACE)
        hashes.append(B.span_hashes(B.prefix_hashes(part), s, e))
        rows.append(row)
    return np.concatenate(hashes), np.concatenate(rows)


def text_sets(col, k: int):
    """Per block of rows: first row, distinct fingerprints, offsets."""
    data, off = B.column_bytes(col)
    for i, j in B.blocks(off):
        words, row = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        hashes, rows = B.shingle_hashes(words, row, j - i, k)
        yield i, j, *B.distinct_per_row(hashes, rows, j - i)


def sign_batches(k: int, bands: int, rows: int):
    def run(batches):
        salt = B.random_u64(rows, 31) | np.uint64(1)
        lane = B.random_u64(bands, 37)
        for batch in batches:
            n, k1, k2, keys = [], [], [], []
            for i, j, vals, bound in text_sets(batch.column(1), k):
                size = np.diff(bound)
                sig = np.zeros((j - i, bands * rows), np.int32)
                for r in np.flatnonzero(size):
                    own = vals[bound[r] : bound[r + 1]]
                    sig[r] = signature(own, bands * rows)
                    for at, x in zip((k1, k2), set_key(own)):
                        at.append(x)
                n.append(size)
                with np.errstate(over="ignore"):
                    wide = sig.reshape(j - i, bands, rows).astype(np.uint64) + np.uint64(1)
                    keys.append(B.mix((wide * salt).sum(axis=2) + lane)[size > 0])
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            flat = np.concatenate(keys).astype(np.int64).ravel() if keys else np.zeros(0, np.int64)
            full = n > 0
            wide = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            fill = lambda xs: pa.array(_spread(np.array(xs, np.int64), full), mask=~full)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), fill(k1), fill(k2), pa.ListArray.from_arrays(pa.array(wide), pa.array(flat))],
                names=["id", "t", "n", "k1", "k2", "bands"],
            )
            B.trim()

    return run


def _spread(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where), np.int64)
    out[where] = values
    return out


def set_batches(k: int):
    def run(batches):
        for batch in batches:
            for _, _, vals, bound in text_sets(batch.column(0), k):
                some = np.flatnonzero(np.diff(bound))
                key = np.array([set_key(vals[bound[r] : bound[r + 1]]) for r in some], np.int64).reshape(-1, 2)
                off = np.concatenate([bound[some], bound[-1:]]).astype(np.int32)
                node = pa.StructArray.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1])], ["k1", "k2"])
                yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(off), pa.array(vals.view(np.int64)))], names=["id", "items"])
            B.trim()

    return run


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def few(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` only if it is counted and below the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 85,
    bands: int = 16,
    rows: int = 4,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row.

    ``component_id`` is the smallest id reachable over links; it is kept.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    signed = texts.select("id", "text", "t").mapInArrow(sign_batches(k, bands, rows), "id long, t long, n long, k1 long, k2 long, bands array<long>")
    signed = cut(signed, "signed")
    # nodes are distinct sets; equal sets have equal bands
    full = signed.where("n > 0").select(F.struct("k1", "k2").alias("node"), "id", "t", "n", "bands")
    per = full.groupBy("node").agg(F.min("t").alias("t"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(per, "nodes")
    members = nodes.select("node", "t", "n", F.explode(F.array_distinct("bands")).alias("bucket"))
    crowd = cut(nodes.select(F.explode(F.array_distinct("bands")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowd")
    shared = cut(members.join(few(crowd), "bucket").select("bucket", F.col("node").alias("id"), "n", "crowd", "t"), "shared")
    wanted = cut(shared.select("t").distinct(), "wanted")
    sets = texts.join(few(wanted), "t", "left_semi").select("text").mapInArrow(set_batches(k), "id struct<k1:long,k2:long>, items array<long>")
    sets = cut(sets.dropDuplicates(["id"]), "sets")
    labels = cut(linked_components(shared.drop("t"), sets, percent), "linked")
    scratch.release(but=(signed, nodes, labels))
    # the texts of one id are one document
    ids = full.where("id IS NOT NULL").select("id", "node")
    twice = cut(ids.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a"), "twice")
    spread = cut(ids.join(few(twice), "id").select("a", F.col("node").alias("b")).distinct(), "spread") if not twice.isEmpty() else twice
    if not spread.isEmpty():
        both = spread.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = cut(connected_components(both), "joined")
    # the rest is alone in its component
    of = nodes.select("node", "low").join(few(labels.withColumnRenamed("id", "node")), "node", "left")
    of = cut(of, "of")
    least = cut(of.where("component IS NOT NULL").groupBy("component").agg(F.min("low").alias("component_id")), "least")
    known = of.join(few(least), "component", "left")
    known = known.select("node.k1", "node.k2", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    known = cut(known, "known")
    scratch.release(but=(signed, known))
    out = signed.select("id", "n", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    """The query: every whole text of ``documents`` at 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs).withColumnRenamed("id", "doc_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
           FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM hits JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
     e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
     r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
