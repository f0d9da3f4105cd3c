"""Joins that add dictionary entries or remove expired documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small


def enrich_dictionary(df: DataFrame, dictionary: DataFrame, on: str) -> DataFrame:
    """Left join with a dictionary; broadcast only once its size is known."""
    return df.join(broadcast_if_small(dictionary), on, "left")


def filter_expired(docs: DataFrame, relations: DataFrame, as_of: Column) -> DataFrame:
    """Drop documents that a relation marks as expired on or before ``as_of``.

    ``relations`` has ``id`` and ``expired_on``. Both sides may be large, so
    this is a sort-merge anti join; AQE splits a skewed document side.
    """
    expired = relations.filter(F.col("expired_on") <= as_of).select("id")
    return docs.join(expired.hint("merge"), "id", "left_anti")


def with_replacement(docs: DataFrame, relations: DataFrame, as_of: Column) -> DataFrame:
    """Surviving documents together with the relation that is to replace them."""
    joined = docs.join(relations.hint("merge"), "id", "left")
    return joined.filter(F.col("expired_on").isNull() | (F.col("expired_on") > as_of))
