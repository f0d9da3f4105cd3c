"""Keeping one row per chunk: last writes, known documents and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import chunk_id


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the last row of each key.

    Spark applies the rank limit before the shuffle as well, so a key with
    very many rows sends one row per input partition.
    """
    newest = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_age", F.row_number().over(newest)).filter("_age = 1").drop("_age")


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """Add ``chunk_id``; chunks without a document id are keyed by their url."""
    own = chunk_id(F.col("doc_id"), F.col("chunk_text"))
    by_url = F.md5(F.concat_ws(":", F.coalesce("url", F.lit("")), "chunk_text"))
    return chunks.withColumn("chunk_id", F.coalesce(F.nullif(own, F.lit("")), by_url))


def distinct_ids(docs: DataFrame, id_col: str = "id") -> DataFrame:
    return docs.select(id_col).filter(F.coalesce(id_col, F.lit("")) != "").distinct()


def skip_indexed_docs(docs: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Documents whose id is not in the index; all of them when forced.

    The ids are compared first, as one narrow column. Only the ids that are
    new then select the full documents, so the contents of known documents are
    never shuffled. Documents without an id count as new.
    """
    if force:
        return docs
    key = F.coalesce(F.col("id"), F.lit(""))
    known = index.select(F.col("doc_id").alias("_id")).filter("_id <> ''").distinct()
    fresh = docs.select(key.alias("_id")).distinct().join(known, "_id", "left_anti")
    # Looked up in a hash table of the new ids, so that contents are not sorted.
    return docs.withColumn("_id", key).join(fresh.hint("shuffle_hash"), "_id", "left_semi").drop("_id")


def existing_docs(ids: DataFrame, index: DataFrame) -> DataFrame:
    """The given ids (column ``id``) that the index holds."""
    return ids.join(index.select(F.col("doc_id").alias("id")), "id", "left_semi")


def chunk_count_for(ids: DataFrame, index: DataFrame) -> DataFrame:
    """Number of chunks of each given id, 0 when it is not indexed."""
    counts = index.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("chunks"))


def upsert_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing chunks with the incoming ones put in; a repeated id is replaced."""
    fresh = last_per_key(incoming, ["chunk_id"], [F.desc("chunk_no")])
    kept = existing.join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """As ``upsert_chunks``, but all old chunks of an incoming document go."""
    kept = existing.join(distinct_ids(incoming, "doc_id"), "doc_id", "left_anti")
    return upsert_chunks(kept, incoming)


def delete_by_doc_id(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the chunks of the given ids (column ``id``)."""
    return index.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def deleted_count(index: DataFrame, ids: DataFrame) -> DataFrame:
    gone = index.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return gone.agg(F.count(F.lit(1)).alias("deleted"))


def serving_view(batch: DataFrame, speed: DataFrame) -> DataFrame:
    """Both layers as one index in which every chunk id appears once.

    The batch layer is only scanned: its ids are matched against the (much
    smaller) speed layer, which then drops what the batch layer has already.
    """
    newest = last_per_key(speed, ["chunk_id"], [F.desc("chunk_no")])
    shared = batch.select("chunk_id").join(newest.select("chunk_id"), "chunk_id", "left_semi")
    return batch.unionByName(newest.join(shared, "chunk_id", "left_anti"))


def upsert_csv_rows(existing: DataFrame, incoming: DataFrame, arrival: str | None = None) -> DataFrame:
    """Rows by id, incoming over existing, newest published date first.

    Of incoming rows with one id the last stays: the largest value of the column ``arrival``, which
    is dropped, or without one the newest published date.
    """
    fresh = incoming.filter(F.coalesce("id", F.lit("")) != "")
    others = [F.desc(c) for c in existing.columns if c != "id"]
    fresh = last_per_key(fresh, ["id"], [F.desc(arrival or "published_date"), *others]).select(*existing.columns)
    kept = existing.filter(F.coalesce("id", F.lit("")) != "").join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh).orderBy(F.desc("published_date"), "id")
