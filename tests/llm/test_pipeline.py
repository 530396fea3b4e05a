"""Registered queries and the pipeline on the smallest tables and on odd ones."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siftwork.llm import queries, stages

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = list(queries.registered())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_query_returns_every_row(spark, name):
    table = {"op9": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    rows = queries.registered()[name](spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert rows.count() >= n if name.startswith("op4") else rows.count() == n


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "token_ids", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 100


def test_stages_keep_odd_rows_and_columns(spark, clashing, no_labels, sf):
    folder = sf(labels=no_labels)
    docs = clashing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "pack_sequences":
            assert out.columns == docs.columns, name
            docs = out.cache()
            assert docs.count() > 0
    assert out.count() > 0


def test_stages_on_an_empty_table(spark, no_docs, no_labels, sf):
    folder = sf(labels=no_labels)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, folder).count() == 0


def test_surrogates_keep_the_length_column_right(spark):
    docs = spark.createDataFrame([(1, "mail to a.b@mail.example.com", 28)], "doc_id bigint, text string, n_chars bigint")
    row = stages.pii_surrogates(spark, docs, "").first()
    assert row.n_chars == len(row.text) and "a.b@mail" not in row.text
