"""Record shapes: normalising, aligning and projecting raw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import has_iso_date
from quarry.functions.text import strip_space
from quarry.schemas import RAW, RAW_FIELDS


def _filled(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def normalize_record(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Raw document fields from a general or a question/answer record.

    An empty title, content or agency is taken from question, answer or
    author. ``crawled_at`` defaults to ``now`` only when the column is absent.
    """
    instead = {"title": "question", "content": "answer", "agency": "author"}
    if now is None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

    def field(name: str) -> Column:
        if name in instead:
            return F.coalesce(_filled(df, name), _filled(df, instead[name]), F.lit(""))
        if name in df.columns:
            return F.coalesce(F.col(name), F.lit(""))
        return now if name == "crawled_at" else F.lit("")

    return df.select(*[field(name).alias(name) for name in RAW_FIELDS])


def drop_blank_records(df: DataFrame) -> DataFrame:
    """Drop records with neither id nor title."""
    return df.filter((F.coalesce("id", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != ""))


def align_schema(df: DataFrame) -> DataFrame:
    """Null-fill missing raw fields and drop extra ones."""
    empty = df.sparkSession.createDataFrame([], RAW)
    return empty.unionByName(df, allowMissingColumns=True).select(*RAW_FIELDS)


def item_to_document(items: DataFrame, crawled_at: Column) -> DataFrame:
    """Raw document of a crawled question/answer item."""
    blank = F.lit("")
    fields = {
        "id": "id", "title": "question", "content": "answer", "category": "category",
        "agency": "author", "published_date": "published_date", "url": "url",
    }
    return items.select(
        *[
            crawled_at.alias(name)
            if name == "crawled_at"
            else (F.coalesce(F.col(fields[name]), blank) if name in fields else blank).alias(name)
            for name in RAW_FIELDS
        ]
    )


def index_projection(chunks: DataFrame) -> DataFrame:
    """Columns of the chunk index; agency and date ride along for search hits."""
    return chunks.select(
        F.col("id").alias("doc_id"), "chunk_no", "chunk_text", "title", "url",
        "category", "doc_type", "agency", "published_date",
    )


def valid_published(docs: DataFrame, category: str | None = None) -> DataFrame:
    """Documents of a category whose published date starts as an ISO date."""
    if category:
        docs = docs.filter(F.col("category") == category)
    return docs.filter(has_iso_date(F.col("published_date")))


def published_counts(docs: DataFrame) -> DataFrame:
    """Kept and skipped documents of ``valid_published``, per category."""
    valid = has_iso_date(F.col("published_date"))
    return docs.groupBy("category").agg(
        F.count_if(valid).alias("kept"), F.count_if(~valid).alias("skipped")
    )


def reject_reason(crawled_at: Column, doc_id: Column) -> Column:
    """Why a record cannot enter the master dataset, null when it can."""
    return F.when(strip_space(F.coalesce(doc_id, F.lit(""))) == "", "missing id").when(
        crawled_at.isNull(), "missing crawled_at"
    )
