from __future__ import annotations

import json

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append((name, docs))
    return out


def test_stages_keep_columns_and_only_remove_rows(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in first.collect()}
    for _, df in stages[:-1]:
        assert df.schema.names == first.schema.names
        now = {r.doc_id for r in df.collect()}
        assert now <= before
        before = now
    assert {r.doc_id for r in stages[-1][1].collect()} == before


def test_run_gives_the_rows_of_the_stages(spark, stages):
    told = lambda df: sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    assert told(corpus_pipeline.run(spark, SF)) == told(stages[-1][1])


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
