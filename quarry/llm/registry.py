"""Queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import oracles
from quarry.llm.common import fresh_folder, stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _entry(query):
    QUERIES[query.__name__] = query
    return query


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_entry
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.packing import pack

    docs = table(spark, folder, "documents")
    return pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, keep_ids=False).drop("ids")


@_entry
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@_entry
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.secrets import scan

    return scan(table(spark, folder, "documents")).drop("marked", "text_key")


SQL["op10_secret_scan"] = oracles.secrets_sql(copied_owners=3, copied_repositories=4)


@_entry
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.pii import find

    return find(table(spark, folder, "documents")).drop("marked")


@_entry
def op1_warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm import warc

    archives = fresh_folder(spark, "warc")
    warc.write_archives(warc.captures_of(table(spark, folder, "pages")), archives)
    records = stored(warc.read_archives(spark, archives, keep_payload=False), "records")
    return warc.page_summary(warc.assemble(records))


SQL["op1_warc_transactions"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, min(page_id) AS holder FROM p WHERE strlen(h) >= 100 GROUP BY d)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest,
        CASE WHEN page_id > holder THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id > holder THEN holder END AS refers_to
    FROM p LEFT JOIN f USING (d)"""


@_entry
def op2_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.divergence import judge

    judged = judge(table(spark, folder, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
    rounded = {"char_distance", "word_distance"}
    return judged.select("doc_id", *[(F.round(f"_{n}", 4) if n in rounded else F.col(f"_{n}")).alias(n) for n in names])


SQL["op2_quality_divergence"] = oracles.divergence_sql(
    least_words=50, repeated=50, guard_chars=200, guard_words=100, reference_words=5_000, common=25, letters=5, chars=0.30, words=0.45, share=0.75
)


@_entry
def op4_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.pieces import decode, segment

    path = vocabulary("piece_bpe_32k.model")
    back = decode(segment(table(spark, folder, "documents"), path), path, into="back")
    return back.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"), (F.col("back") == F.col("text")).alias("lossless"),
    )


@_entry
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.language import identify

    found = identify(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.col("_language").alias("language"), F.round("_probability", 9).alias("probability"),
        F.col("_text_language").alias("text_language"), F.col("lang").alias("declared"), F.col("_kept").alias("kept"),
    )


@_entry
def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator where all its evidence exists: markup, address suffix and host levels."""
    from quarry.llm.language import identify

    markup = F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]{2,3})", 1)
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[a-z]+;", " ")
    pages = table(spark, folder, "pages").select("page_id", "url", F.when(markup != "", markup).alias("lang"), text.alias("text"))
    found = identify(pages, id_column="page_id", host=None, address="url")
    return found.select(
        "page_id", F.col("_language").alias("language"), F.round("_probability", 9).alias("probability"),
        F.col("_text_language").alias("text_language"), F.col("lang").alias("declared"), F.col("_kept").alias("kept"),
    )


@_entry
def op3_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.kmeans_tree import search

    return search(table(spark, folder, "embeddings"))


@_entry
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.jaccard_join import link

    return link(table(spark, folder, "documents"))


@_entry
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.str_tree import mine

    vectors = table(spark, folder, "embeddings")
    # Planted wrong labels of the contract.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label))


SQL["op11_hard_negatives"] = oracles.hard_negatives_sql(every=100, positives=5, negatives=10, low=30, high=90, scale=256)


@_entry
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.prefix_trie import trie

    return trie(table(spark, folder, "conversations"))


SQL["op13_conversation_trie"] = oracles.trie_sql(family=100, heads=6)


@_entry
def op12_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))
