"""Streaming over mesh events and files: stateless measures and watermarked windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import triangle as tri
from ..functions import vec3 as v

#: A triangle with its positions, as a stream of self-contained rows.
TRIANGLE_ROWS = "mesh_id string, ts timestamp, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def triangle_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of triangle rows as they arrive."""
    return spark.readStream.schema(TRIANGLE_ROWS).parquet(path)


def with_area(triangles: DataFrame) -> DataFrame:
    """Works on batches and streams alike."""
    return triangles.withColumn("area", tri.area(v.cols("a"), v.cols("b"), v.cols("c")))


def windowed_area(triangles: DataFrame, window: str = "10 minutes", late: str = "20 minutes", slide: str | None = None) -> DataFrame:
    """Area and triangles per mesh and event-time window; rows later than the watermark are dropped by it."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = with_area(triangles).withWatermark("ts", late).groupBy("mesh_id", w.alias("w"))
    return g.agg(F.sum("area").alias("area"), F.count("*").alias("n")).select("mesh_id", F.col("w.start").alias("start"), "area", "n")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drain what is there into a memory table and return it (tests, small jobs)."""
    w = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
