"""Tables kept in buckets of a key and sorted by it, so that joins by this key move no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "id", buckets: int = 200) -> None:
    """Write ``df`` as table ``name`` in ``path``: one sorted file per bucket.

    Rows are dealt by the key first, so that a bucket is written by one task.
    """
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)


def filter_expired_bucketed(spark: SparkSession, docs: str, relations: str, as_of: Column, key: str = "id") -> DataFrame:
    """``filter_expired`` of two tables in as many buckets of ``key``: a merge join without an exchange."""
    expired = spark.table(relations).filter(F.col("expired_on") <= as_of).select(key)
    return spark.table(docs).join(expired.hint("merge"), key, "left_anti")
