"""Columns of the input with the names of the operators' own."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

CLASHES = ["_kept", "_words", "_score", "_language", "_gone", "_i", "_k", "_c", "_spans", "_best", "_lang", "_text", "aside0", "node", "key"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_any_columns(spark, data, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    docs = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    found = stage(spark, docs, data)
    assert found.columns == docs.columns
    rows = found.collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, plain, data).collect())
