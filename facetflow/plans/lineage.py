"""Cutting lineage: a written table in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it, a finished query's shuffle files go at once and not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where neither the setting nor the context names one and all executors run
    in this process (tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="facetflow-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def _clean_shuffles(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The plan runs a single time, later uses read the files, and a lost executor
    costs at most the tasks that were running.
    """
    return Scratch(df.sparkSession).cut(df, name)


class Scratch:
    """Tables of one operator; those that nothing reads any more can be released."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with _clean_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def release(self, *tables: DataFrame, but: tuple[DataFrame, ...] = ()) -> None:
        """Delete the given tables, or all but those in ``but``."""
        jvm = self.spark._jvm
        kept = []
        for df, path in self.paths:
            gone = any(df is t for t in tables) if tables else not any(df is t for t in but)
            if not gone:
                kept.append((df, path))
                continue
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = kept
