"""Vector search by graphs against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.graph_search import build_graphs, graph_search
from quarry.operators.retrieval import knn_cosine


def vectors(spark, count, size=32, centres=40, seed=3):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, size))
    points = middle[draw.integers(0, centres, count)] + 0.7 * draw.normal(size=(count, size))
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<float>")


def test_recall_with_few_vectors_looked_at(spark, folder):
    index = vectors(spark, 9_000)
    build_graphs(index, "vec_id", part_rows=5_000).write.parquet(folder + "/graphs")
    graphs = spark.read.parquet(folder + "/graphs")
    assert graphs.agg(F.sum("n")).first()[0] == 9_000 and graphs.count() == 2
    asked = index.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    seen = spark.sparkContext.accumulator(0)
    pairs = lambda frame: {(r["query_id"], r["vec_id"]) for r in frame.collect()}
    found, exact = pairs(graph_search(graphs, asked, key="vec_id", looked_at=seen)), pairs(knn_cosine(index, asked, key="vec_id"))
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact) == 1_800
    # A fifth of the vectors at most, for each question.
    assert 0 < seen.value < 9_000 * 180 / 5


@pytest.mark.parametrize("count", [0, 1, 2, 30])
def test_small_parts_are_searched_whole(spark, count):
    index = vectors(spark, count).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 32)], "vec_id long, embedding array<float>"))
    asked = vectors(spark, 3, seed=9).unionByName(spark.createDataFrame([(7, None), (8, [0.0] * 32)], "vec_id long, embedding array<float>")).withColumnRenamed("vec_id", "query_id")
    rows = lambda frame: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in frame.collect())
    found = graph_search(build_graphs(index, "vec_id"), asked, 5, key="vec_id", broadcast_questions=2)
    assert rows(found) == rows(knn_cosine(index, asked, 5, key="vec_id"))
