"""Registered queries against their SQL, and the pipeline's stages against plain rules."""

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from sparkprep.llm import queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF_DIR), duck(SF_DIR), queries.oracle_sql()[name]) == ""


def test_all_are_registered():
    names = registered.queries().keys()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and "pipeline" not in registered.oracle_sql()


def test_stages_keep_columns_and_do_their_work(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = "/root/testdata/sf0.001"
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.where(F.length("text") != F.col("n_chars")).isEmpty(), name
        sizes.append(docs.count())
    assert sizes[1] == sizes[2] >= sizes[3] >= sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    want = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in last.collect()} == want
    assert corpus_pipeline.run(spark, folder).count() == sizes[4]


def test_copies_stage_repeats_rows_by_copies(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.mix_copies(spark, docs, folder)
    assert got.columns == corpus_pipeline.COLUMNS
    copies = {r["doc_id"]: r["copies"] for r in queries.op7_mixing_copies(spark, folder).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == copies
    assert max(copies.values()) > 1
