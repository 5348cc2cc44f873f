"""The stages on a small folder, each against its own rule; and the contract of the entry points."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from cytoloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        docs = out.cache()
        counts.append(docs.count())
    # Nothing but languages, copies and leaks may go before the mix.
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0.5 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    size = {r.shard: r.n for r in last.selectExpr("shard", "octet_length(text) + 1 as b").groupBy("shard").agg({"b": "sum"}).toDF("shard", "n").collect()}
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) < 100_000
    assert last.count() == counts[-1]


def test_registration():
    for name in queries.QUERIES:
        assert name in contract.queries()
    assert "pipeline" in contract.queries() and set(queries.CHECKS) <= set(queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
