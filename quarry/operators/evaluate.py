"""Retrieval quality against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_match(text: Column, keywords: Column) -> Column:
    """Any keyword is a substring, ignoring case."""
    lowered = F.lower(text)
    return F.exists(keywords, lambda word: F.contains(lowered, F.lower(word)))


def category_match(category: Column, expected: Column) -> Column:
    return (F.coalesce(category, F.lit("")) != "") & F.array_contains(expected, category)


def join_hits_to_gold(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Every gold question with its hits; questions without hits stay."""
    return gold.join(hits, gold["id"] == hits["query_id"], "left").drop("query_id")


def score_hits(joined: DataFrame) -> DataFrame:
    """Precision, recall, category hit and hit count per gold question."""
    blank = F.lit("")
    text = F.concat_ws(" ", *[F.coalesce(c, blank) for c in ("title", "chunk_text", "url")])
    is_hit = F.col("chunk_id").isNotNull()
    matched = is_hit & keyword_match(text, F.coalesce("expected_keywords", F.array().cast("array<string>")))
    category = F.coalesce(F.nullif("category", blank), F.col("doc_type"))
    in_category = is_hit & category_match(category, F.coalesce("expected_categories", F.array().cast("array<string>")))
    n = F.count_if(is_hit)
    return joined.groupBy("id").agg(
        F.coalesce(F.count_if(matched) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("precision"),
        (F.count_if(matched) > 0).cast("double").alias("recall"),
        F.coalesce(F.bool_or(in_category), F.lit(False)).alias("category_hit"),
        n.alias("n"),
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """Means over questions with hits and no error, and both counts.

    ``latency_ms`` and ``error`` are optional columns of ``results``.
    """
    ok = F.col("n") > 0
    if "error" in results.columns:
        ok = ok & F.col("error").isNull()

    def mean(value: Column) -> Column:
        return F.avg(F.when(ok, value.cast("double")))

    latency = [mean(F.col("latency_ms")).alias("mean_latency_ms")] if "latency_ms" in results.columns else []
    return results.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(ok).alias("successful"),
        mean(F.col("precision")).alias("mean_precision"),
        mean(F.col("recall")).alias("mean_recall"),
        mean(F.col("category_hit").cast("int")).alias("category_hit_rate"),
        *latency,
    )
