"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text is cut where its own content says so, each chunk gets an identifier and
a text becomes the ordered list of its identifiers, its recipe.  Equal texts
have equal recipes; the converse holds once the identifiers are verified, i.e.
once no identifier stands for two different chunks.  Chunk texts therefore move
once, map-side deduplicated, and all that follows moves recipes.

Defined results: a null text counts as empty; an empty text has an empty
recipe, so that empty texts are copies of each other; an empty table gives an
empty result; columns other than the id and the text are not looked at; rows
that repeat an id are rows of their own; just one row of a group is kept, also
of rows that share an id or have none (a row without an id only if none has one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch

#: A chunk ends behind white space when the next letters are of a kind that
#: content decides, after ``least`` characters and before ``most``.
BOUNDARY = r"(?<=\s)(?=[a-mA-M][aeiou])"


def chunks(text, least: int = 256, most: int = 4096):
    """The chunks of a text column in order; they concatenate to the text."""
    rule = rf"(?s).{{{least},{most}}}?(?:{BOUNDARY}|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def identifier(chunk):
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, recipe, text_sha256)`` for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).alias("n_bytes"),
        F.transform(chunks(text), identifier).alias("recipe"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def clashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Identifiers that stand for more than one chunk text (normally none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = docs.select(F.explode(chunks(text)).alias("chunk")).select(identifier(F.col("chunk")).alias("ident"), "chunk")
    return pieces.distinct().groupBy("ident").agg(F.count("*").alias("n")).where("n > 1").select("ident")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The largest id of a group stays.  Where a clash of identifiers is found,
    the texts that hold such a chunk are compared in full beside their recipes.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut
    # the number of a row is drawn once, as the table is written
    listed = cut(recipes(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "recipes")
    bad = cut(clashes(docs, text_col), "clashes")
    if bad.isEmpty():
        keyed = listed.withColumn("full", F.lit(""))
    else:
        hit = listed.select("text_sha256", F.explode("recipe").alias("ident")).join(bad, "ident", "left_semi").select("text_sha256").distinct()
        full = F.coalesce(F.col(text_col), F.lit(""))
        texts = docs.select(F.sha2(full, 256).alias("text_sha256"), full.alias("full")).distinct().join(hit, "text_sha256", "left_semi")
        keyed = listed.join(texts, "text_sha256", "left").withColumn("full", F.coalesce("full", F.lit("")))
    same = ["n_bytes", "recipe", "full"]
    groups = keyed.groupBy(*same).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    out = keyed.join(groups, same)
    # rows without an id, or that repeat one, are told apart by their number
    vague = listed.groupBy("id").agg(F.count("*").alias("c")).where("c > 1 OR id IS NULL").select("id")
    if vague.isEmpty():
        kept = F.col("id") == F.col("keep_id")
    else:
        last = keyed.groupBy(*same).agg(F.max(F.struct("id", "row"))["row"].alias("last"))
        out = out.join(last, same)
        kept = F.col("row") == F.col("last")
    return out.select("id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: every row and whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).withColumnRenamed("id", "doc_id")


OP4_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
