"""Fixed schemas shared by the batch and the streaming side."""

from __future__ import annotations

from pyspark.sql import types as T

# Field order of the raw document record.
RAW_FIELDS = (
    "id",
    "title",
    "content",
    "category",
    "doc_type",
    "doc_number",
    "agency",
    "published_date",
    "url",
    "crawled_at",
)

RAW = T.StructType([T.StructField(name, T.StringType()) for name in RAW_FIELDS])

INDEX = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("agency", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("question_hash", T.StringType()),
        T.StructField("question_sanitized", T.StringType()),
        T.StructField("answer_length", T.IntegerType()),
        T.StructField("source_count", T.IntegerType()),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("pii_redactions", T.IntegerType()),
        T.StructField("cache_hit", T.BooleanType()),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_categories", T.ArrayType(T.StringType())),
        T.StructField("expected_keywords", T.ArrayType(T.StringType())),
    ]
)

MODEL_REPLY = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("used_sources", T.ArrayType(T.VariantType())),
    ]
)
