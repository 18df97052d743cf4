"""The stages one after the other on the smallest tables: what each promises of the one before it."""

import os

import pytest

import corpus_pipeline as P
from lodestone.llm import decontaminate, jaccard
from lodestone.llm.common import Table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, Table(stage(spark, docs, DATA), name).df
        assert docs.columns == before.columns
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            found = jaccard.near_duplicates(docs)
            assert found.where("doc_id <> component_id").count() == 0
            assert docs.count() == jaccard.near_duplicates(before).where("doc_id = component_id").count()
        if name == "repeated_passages":
            assert docs.count() == before.count()
        if name == "contamination":
            assert decontaminate.contained(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    mixed = P.STAGES[-1][1](spark, docs, DATA)
    assert mixed.where("taken > 2 * size or taken <= 0").count() == 0
