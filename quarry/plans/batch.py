"""Batch layer: documents to chunk index."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import MAX_LENGTH, OVERLAP, chunk_id, chunk_text, clean_text, explode_chunks
from quarry.operators.index import last_per_key, skip_indexed_docs, with_chunk_id
from quarry.operators.normalize import index_projection
from quarry.operators.retrieval import embed_chunks
from quarry.session import broadcast_if_small
from quarry.sources.chunk_table import append_batch, note_version, read_index
from quarry.sources.manifest import read_manifest

Embed = Callable[[list[str]], list[list[float]]]


def document_chunks(docs: DataFrame, max_length: int = MAX_LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """Clean, split and number the chunks of raw documents."""
    cleaned = docs.withColumn("clean_text", clean_text(F.col("content")))
    return with_chunk_id(index_projection(explode_chunks(cleaned, "clean_text", max_length, overlap)))


def distinct_chunks(docs: DataFrame, max_length: int = MAX_LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """``document_chunks`` with one row per chunk id, the one with the largest number.

    A chunk id begins with that of its document, so the chunks of an id that one document has are compared within its row
    and never shuffled. Those of repeated and of missing ids are compared by chunk id.
    """
    known = F.coalesce(F.col("id"), F.lit("")) != ""
    repeated = docs.where(known).groupBy(F.col("id").alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again")
    several, unknown = not repeated.isEmpty(), not docs.where(~known).isEmpty()
    single, others = docs.where(known), docs.where(~known)
    if several:
        repeated, same = broadcast_if_small(repeated), F.col("id") == F.col("_again")
        others = others.unionByName(docs.join(repeated, same, "left_semi"))
        single = single.join(repeated, same, "left_anti")
    cleaned = single.withColumn("clean_text", clean_text(F.col("content")))
    texts = chunk_text(F.col("clean_text"), max_length, overlap)
    kept = with_chunk_id(index_projection(cleaned.select("*", F.inline(_last_of_each(F.col("id"), texts)))))
    if not (several or unknown):
        return kept
    return kept.unionByName(last_per_key(document_chunks(others, max_length, overlap), ["chunk_id"], [F.desc("chunk_no")]))


def _last_of_each(doc_id: Column, texts: Column) -> Column:
    """``chunk_no, chunk_text`` of the chunks of a document, of those with one chunk id the last."""
    numbered = F.transform(texts, lambda text, at: F.struct(chunk_id(doc_id, text).alias("own"), at.alias("chunk_no"), text.alias("chunk_text")))

    def last(rows: Column) -> Column:
        return F.filter(rows, lambda row, at: ~F.coalesce(F.get(rows, at + 1)["own"] == row["own"], F.lit(False)))

    # Behind a transform the sorted rows are made once, though each is compared with the next.
    kept = F.get(F.transform(F.array(F.array_sort(numbered)), last), F.lit(0))
    return F.transform(kept, lambda row: F.struct(row["chunk_no"], row["chunk_text"]))


def new_chunks(
    docs: DataFrame, embed: Embed | None = None, max_length: int = MAX_LENGTH, overlap: int = OVERLAP
) -> DataFrame:
    """Chunks with vectors, one row per chunk id; repeats are dropped before embedding."""
    return embed_chunks(distinct_chunks(docs, max_length, overlap), embed)


def rebuild(
    docs: DataFrame,
    root: str,
    batch: str,
    force: bool = False,
    embed: Embed | None = None,
    max_length: int = MAX_LENGTH,
    overlap: int = OVERLAP,
) -> int:
    """Index the documents that are not indexed yet; returns the chunk count.

    A forced run indexes all of them and hides the chunks they had before.
    """
    spark = docs.sparkSession
    now = F.lit(datetime.now(timezone.utc))
    ids = docs.select(F.col("id").alias("doc_id"))
    at = read_manifest(spark, root)
    # Where no other batch has chunks all documents are new, and none is looked up.
    everything = force or all(e.batch == batch for e in at.of("chunks"))
    fresh = docs if everything else skip_indexed_docs(docs, read_index(spark, root, without_batch=batch, doc_ids=ids, manifest=at))
    written = append_batch(new_chunks(fresh, embed, max_length, overlap), root, batch, now, deletes=docs if force else None)
    if written:
        note_version(spark, root, batch)
    return written
