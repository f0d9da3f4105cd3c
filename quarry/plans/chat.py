"""Answering a table of questions as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.intents import smalltalk_intent, smalltalk_reply
from quarry.functions.privacy import question_hash, redact_pii
from quarry.functions.replies import NO_INFO_REPLY, parse_model_reply
from quarry.functions.text import strip_space
from quarry.operators.rag import MIN_SCORE, build_context, cite_sources, route_path, threshold_gate
from quarry.operators.retrieval import TOP_K, hybrid_search, with_hit_fields
from quarry.session import durable


def prepare(questions: DataFrame, index: DataFrame, threshold: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Questions with intent, gate and user message, and their hits.

    ``questions`` has ``query_id, question, embedding``; blank ones drop. The
    hits serve four later steps, so they are searched once and checkpointed.
    """
    asked = questions.withColumn("question", strip_space(F.col("question"))).filter("question <> ''")
    asked = asked.withColumn("intent", smalltalk_intent(F.col("question")))
    searched = asked.filter("intent is null")
    hits = durable(with_hit_fields(hybrid_search(index, searched), index, TOP_K * searched.count()))
    gated = threshold_gate(asked, hits, threshold)
    return build_context(gated, hits), hits


def answer(prepared: DataFrame, hits: DataFrame, replies: DataFrame, cached: DataFrame) -> DataFrame:
    """Route, answer and source count per question.

    ``replies`` has ``query_id, raw``; ``cached`` has ``query_id, cache_hit,
    cached_answer, cached_sources``.
    """
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hit_count"))
    joined = (
        prepared.join(sizes, "query_id", "left")
        .join(replies, "query_id", "left")
        .join(cached, "query_id", "left")
        .withColumn("reply", parse_model_reply(F.col("raw"), F.coalesce("hit_count", F.lit(0))))
        .withColumn("answer", F.col("reply.answer"))
        .withColumn("used", F.col("reply.used"))
        .withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))
        .withColumn("path", route_path(F.col("intent"), F.col("cache_hit"), F.col("refused"), F.col("answer")))
    )
    cited = cite_sources(joined.filter("path in ('rag', 'no_info')").select("query_id", "answer", "used"), hits)
    counts = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("_cited"))
    final = (
        F.when(F.col("path") == "smalltalk", smalltalk_reply(F.col("question")))
        .when(F.col("path") == "cache", F.col("cached_answer"))
        .when(F.col("path") == "threshold_refused", NO_INFO_REPLY)
        .otherwise(F.col("answer"))
    )
    cached_count = F.coalesce("cached_sources", F.lit(0))
    sources = F.when(F.col("path") == "cache", cached_count).otherwise(F.coalesce("_cited", F.lit(0)))
    return joined.join(counts, "query_id", "left").select(
        "query_id", "question", "path", final.alias("answer"), sources.cast("int").alias("source_count"), "cache_hit"
    )


def audit_records(answers: DataFrame, timestamp: Column, latency_ms: Column) -> DataFrame:
    """Sanitised record per answered question."""
    sanitized, redactions = redact_pii(F.col("question"))
    return answers.select(
        timestamp.alias("timestamp"),
        question_hash(F.col("question")).alias("question_hash"),
        sanitized.alias("question_sanitized"),
        F.length("answer").alias("answer_length"),
        F.col("source_count").cast("int").alias("source_count"),
        latency_ms.cast("int").alias("latency_ms"),
        redactions.cast("int").alias("pii_redactions"),
        "cache_hit",
    )
