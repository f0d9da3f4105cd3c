"""Pipeline over ``documents``: each stage works on what the one before kept.

Language, quality, near-duplicate and secret stages return the columns of documents; packing
returns pieces of token sequences. Between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import divergence, jaccard_join, language, packing, secrets
from quarry.llm.common import selected, stored
from quarry.llm.registry import vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with enough probability.

    Null, empty and letterless texts go; repeated rows are judged each, ids may be null, texts of any length are read whole.
    An empty table gives no rows; other columns may have any name. This holds for the next stage too.
    """
    return selected(docs, language.identify)


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's references; a null text has no words and goes."""
    return selected(docs, divergence.judge)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Texts without words are all kept, rows that repeat id and text once; ids may be null (see ``one_of_each``).
    """
    return jaccard_join.one_of_each(docs, words=5, share=80)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with base and live-looking secrets masked in the text; null and empty texts stay as they are."""
    return secrets.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row per piece with its token ids; a null or empty text is its end alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("language", identified), ("quality", sound), ("near_duplicates", distinct), ("secrets", masked), ("packing", packed)]

# Neither the trained language model nor the tokenizer can be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
