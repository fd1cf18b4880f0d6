"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.llm.decontaminate import decontaminate
from facetflow.llm.exact_dedup import exact_dedup
from facetflow.llm.minhash_dedup import near_dedup
from facetflow.llm.sentencepiece_codec import with_pieces
from facetflow.llm.toxicity import clean_rows
from facetflow.plans.lineage import cut


#: Ids of documents that go may be broadcast up to this many (8 bytes each).
BROADCAST_IDS = 200_000


def keep(docs: DataFrame, verdicts: DataFrame, id_col: str, stays: str) -> DataFrame:
    """``docs`` without the rows that go, by id.

    Rows that share an id, or have none, share its fate: they stay if the
    condition ``stays`` holds for one of them.  The ids that go are fewer than
    those that stay; they are broadcast only if counted and below the bound.
    """
    fate = verdicts.groupBy(F.col(id_col).alias("gone_id")).agg(F.max(F.expr(stays)).alias("stays"))
    gone = cut(fate.where("NOT stays").select("gone_id"), "gone")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; decided row by row, no join."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return clean_rows(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of rows that repeat it, one."""
    out = keep(docs, exact_dedup(docs), "id", "kept")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        same = "same"
        while same in out.columns:
            same += "_"
        out = out.withColumn(same, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", same]).drop(same)
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, alike to 0.8 or more, stays."""
    return keep(docs, near_dedup(docs, percent=80), "id", "kept OR id IS NULL")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return keep(docs, decontaminate(docs, items), "id", "NOT contaminated")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left, behind all its columns; decoding gives its text back."""
    return with_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentence pieces", to_pieces),
]

#: A classifier is no SQL, so the pipeline is tested against its parts instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
