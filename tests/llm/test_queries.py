"""The registered queries against SQL, and the pipeline against its parts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetflow.llm import queries as llm_queries
from facetflow.llm import toxicity

from ..conftest import same_result
from . import brute


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    same_result(spark, duck, llm_queries.queries()[name], llm_queries.oracle_sql()[name], sf)


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in llm_queries.queries()} == set(range(1, 11))


def test_suffix_query(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in llm_queries.queries()["op5_suffix_dedup"](spark, sf).collect()}
    assert got == dict(zip(rows, brute.suffix(rows.values())))


def test_license_query(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in llm_queries.queries()["op8_license_scan"](spark, sf).collect()}
    assert got == {i: brute.licenses(t) for i, t in rows.items()}


def test_line_query_recall(spark, sf):
    """Candidates come from a signature, so a link may be missed; none is invented."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    from facetflow.llm.line_dedup import line_dedup

    got = {r.id: set(r.removed) for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {i: set(x) for i, x in brute.lines(docs).items()}
    found = sum(len(got[i] & want[i]) for i in want)
    assert found >= 0.99 * sum(map(len, want.values()))


def test_line_query_takes_short_lines(spark, tmp_path):
    """Short lines repeat and resemble each other too; blank ones stay."""
    short = ["All rights reserved.", "a", "-----", "---------", "abcdefgh", "abcdefghi", "Seite 1", "é", "* * *"]
    docs = [(i, "\n".join([f"line {i} of its own kind {i * 7919}", "", " ", *short[i % 4 :], "All rights reserved. "])) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed for r in llm_queries.queries()["op9_line_dedup"](spark, str(tmp_path)).collect()}
    want = brute.lines(docs, least=1)
    assert got == want and sum(map(len, want.values())) > 60


@pytest.mark.parametrize(("name", "column"), [("op2_toxicity", "predicted"), ("op10_language_id", "lang_pred")])
def test_held_out_accuracy(spark, sf, name, column):
    larger = sf.replace("sf0.001", "sf0.01")
    got = llm_queries.queries()[name](spark, larger).where("held_out")
    truth = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", F.col("toxic").alias("y")) if column == "predicted" else spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", F.col("lang").alias("y"))
    right, n = got.join(truth, "doc_id").agg(F.sum((F.col(column) == F.col("y")).cast("int")), F.count("*")).first()
    assert right / n > 0.9


def test_sentencepiece_query_is_lossless(spark, sf):
    got = llm_queries.queries()["op6_sentencepiece"](spark, sf)
    assert got.where("lossless").count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_against_its_parts(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "sentence pieces"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = [(r.doc_id, r.text) for r in toxicity.clean_rows(docs, labels).collect()]
    last = {}
    for i, t in held:
        last[t or ""] = max(i, last.get(t or "", -1))
    held = [(i, t) for i, t in held if last[t or ""] == i]
    near = brute.near(held, 80)
    held = [(i, t) for i, t in held if near[i][2]]
    dirty = brute.decontaminate(held, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    want = {i for i, _ in held if not dirty[i][4]}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").collect()} == want and got.where("NOT lossless").count() == 0


def test_stages_keep_columns_and_take_odd_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "", "en", "s", 0), (9003, "", "en", "s", 0), (None, "alone", "en", "s", 5)], docs.schema)
    for extra in (docs.unionByName(odd), docs.where("false")):
        n = extra.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, extra, sf)
            assert out.columns == docs.columns and out.count() <= n, name
    copies = corpus_pipeline.drop_copies(spark, docs.unionByName(odd), sf)
    assert copies.where("coalesce(text, '') = ''").count() == 1
