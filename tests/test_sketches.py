"""Sketches of batches against exact figures, and the join of bucketed tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import sketches
from quarry.operators.enrich import filter_expired
from quarry.sources.bucketed import filter_expired_bucketed, write_bucketed


def batches(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 40_000).cast("string").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"),
        # Lengths with a long tail.
        F.pow(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0, 4).cast("long").alias("length"),
    )
    return rows, [rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == i) for i in range(3)]


def test_distinct_after_appends_and_deletions(spark, folder):
    rows, parts = batches(spark)
    for i, part in enumerate([*parts, parts[0]]):
        sketches.batch_sketches(part, F.col("length"), ["category"]).write.parquet(f"{folder}/{i}")
    stored = spark.read.parquet(*[f"{folder}/{i}" for i in range(4)])
    assert stored.count() == 8
    found = sketches.distinct_keys(stored).first()["documents"]
    assert abs(found - 40_000) < 800
    gone = spark.range(15_000).select(F.col("id").cast("string").alias("doc_id"))
    assert abs(sketches.distinct_keys(stored, deleted=sketches.deleted_sketch(gone)).first()["documents"] - 25_000) < 800
    exact = {r["category"]: r["n"] for r in rows.groupBy("category").agg(F.count_distinct("doc_id").alias("n")).collect()}
    for r in sketches.distinct_keys(stored, ["category"]).collect():
        assert abs(r["documents"] - exact[r["category"]]) < 0.02 * exact[r["category"]]


def test_rank_error_of_quantiles(spark):
    rows, parts = batches(spark)
    stored = sketches.batch_sketches(parts[0], F.col("length"), ["category"])
    for part in parts[1:]:
        stored = stored.unionByName(sketches.batch_sketches(part, F.col("length"), ["category"]))
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    for r in sketches.quantiles(stored, wanted, ["category"]).collect():
        lengths = sorted(x["length"] for x in rows.where(F.col("category") == r["category"]).collect())
        for name, p in wanted.items():
            below, upto = (sum(test(x) for x in lengths) / len(lengths) for test in (lambda x: x < r[name], lambda x: x <= r[name]))
            assert below - 0.01 <= p <= upto + 0.01


@pytest.mark.parametrize("buckets", [4, 7])
def test_bucketed_join_has_no_exchange(spark, folder, buckets):
    docs = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
    relations = spark.range(0, 600, 3).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "2024-01-01").otherwise("2025-01-01").alias("expired_on"))
    names = [f"docs_{uuid.uuid4().hex}", f"relations_{uuid.uuid4().hex}"]
    for df, name in zip((docs, relations), names):
        write_bucketed(df, name, f"{folder}/{name}", buckets=buckets)
    found = filter_expired_bucketed(spark, *names, F.lit("2024-06-01"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    expected = filter_expired(docs, relations, F.lit("2024-06-01"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    for name in names:
        spark.sql(f"DROP TABLE {name}")
