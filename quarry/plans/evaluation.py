"""Evaluating retrieval against a gold set as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.evaluate import eval_summary, join_hits_to_gold, score_hits
from quarry.operators.retrieval import bm25_search, with_hit_fields

# Fixed value: hits per question.
TOP_K = 5


def evaluate(gold: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """Precision, recall, category hit and hit count per gold question."""
    queries = gold.select(F.col("id").alias("query_id"), "question")
    hits = with_hit_fields(bm25_search(index, queries, k), index, k * queries.count())
    return score_hits(join_hits_to_gold(gold, hits))


def summarize(gold: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    return eval_summary(evaluate(gold, index, k))
