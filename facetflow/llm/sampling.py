"""Bounded, reproducible training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Rates may be broadcast up to this many; beyond it they are joined by shuffle.
BROADCAST_KEYS = 200_000


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(1))


def bounded(rows: DataFrame, key: str, per_key: int, salt: int = 17) -> DataFrame:
    """About ``per_key`` rows of each value of ``key`` that is not null.

    Rows are taken by a hash of their id, at a rate from the counts, so that the
    same rows are taken whatever their order or partitioning.
    """
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count("*").alias("key_rows"))
    n_keys = counts.count()
    if n_keys <= BROADCAST_KEYS:
        counts = F.broadcast(counts)
    rate = F.least(F.lit(1.0), F.lit(float(per_key)) / F.col("key_rows"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0
    taken = rows.join(counts, key).where(draw < rate).select(*rows.columns)
    return taken.limit(2 * per_key * max(n_keys, 1))
