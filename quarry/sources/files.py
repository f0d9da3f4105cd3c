"""Landing files, the master dataset, the gold set and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.dates import crawl_instant, crawled_partition
from quarry.operators.index import last_per_key
from quarry.operators.normalize import reject_reason
from quarry.schemas import GOLD, RAW, RAW_FIELDS
from quarry.sources.storage import read_if_present

CORRUPT = "_corrupt_record"
QUOTING = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}

# The writer trims values unless told not to.
WRITING = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_landing_csv(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """CSV with header, doubled quotes and line breaks inside fields.

    Rows that do not fit keep their text in ``_corrupt_record``.
    """
    return spark.read.schema(_with_corrupt(schema)).options(**QUOTING, mode="PERMISSIVE").csv(path)


def valid_rows(scanned: DataFrame) -> DataFrame:
    """Complete rows with an id."""
    kept = scanned.filter(F.col(CORRUPT).isNull() & (F.coalesce("id", F.lit("")) != ""))
    return kept.drop(CORRUPT)


def stream_landing_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW,
    archive: str | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """CSV files as they land; each base name is read once.

    With ``archive``, finished files move there when a later batch runs.
    """
    reader = (
        spark.readStream.schema(schema)
        .options(**QUOTING)
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .option("fileNameOnly", "true")
        .option("maxFilesPerTrigger", max_files)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.csv(path)


def read_master_json(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One JSON object (or array of them) per file below ``path``; keys that are missing are null.

    Unreadable files keep their text in ``_corrupt_record``.
    """
    return (
        spark.read.schema(_with_corrupt(RAW))
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .json(path)
    )


def split_unreadable(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable documents, and the number of unreadable ones."""
    good = scanned.filter(F.col(CORRUPT).isNull()).select(*RAW_FIELDS)
    # Spark refuses to read the corrupt column alone, so the id is looked at too.
    unreadable = F.col(CORRUPT).isNotNull() & ~F.col(CORRUPT).eqNullSafe(F.col("id"))
    skipped = scanned.agg(F.count_if(unreadable).alias("skipped"))
    return good, skipped


def master_rows(docs: DataFrame, fallback: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for the master dataset with ``year`` and ``month``, and rejects."""
    reason = reject_reason(F.col("crawled_at"), F.col("id"))
    checked = docs.withColumn("reason", reason)
    year, month = crawled_partition(F.col("crawled_at"), fallback)
    good = checked.filter("reason is null").drop("reason")
    return good.withColumn("year", year).withColumn("month", month), checked.filter("reason is not null")


def _newest_first() -> list[Column]:
    """Order of crawls by their moment; unreadable times are older than all others."""
    return [F.desc_nulls_last(crawl_instant(F.col("crawled_at"))), F.desc("crawled_at")]


def write_master(docs: DataFrame, path: str, batch: str, fallback: Column) -> None:
    """Append a batch of documents below ``year/month``.

    Writing a batch again replaces that batch only, so a replay changes
    nothing and no earlier month has to be rewritten.
    """
    rows, rejects = master_rows(docs, fallback)
    newest = last_per_key(rows, ["year", "month", "id"], _newest_first())
    _write_batch(newest, f"{path}/documents", ["year", "month", "batch"], batch)
    _write_batch(rejects, f"{path}/rejects", ["batch"], batch)


def _write_batch(rows: DataFrame, path: str, partitions: list[str], batch: str) -> None:
    """Write a batch in few files per folder; a large folder is split by AQE."""
    (
        rows.withColumn("batch", F.lit(batch))
        .hint("rebalance", *partitions)
        .write.partitionBy(*partitions)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_master(spark: SparkSession, path: str, all_versions: bool = False) -> DataFrame:
    """Documents of the master dataset, the latest crawl of each id.

    ``all_versions`` keeps one row per (year, month, id) instead.
    """
    stored = T.StructType(
        [
            *RAW.fields,
            T.StructField("year", T.IntegerType()),
            T.StructField("month", T.IntegerType()),
            T.StructField("batch", T.StringType()),
        ]
    )
    rows = read_if_present(spark, f"{path}/documents", stored)
    keys = ["year", "month", "id"] if all_versions else ["id"]
    order = [F.desc("batch"), *_newest_first()] if all_versions else [*_newest_first(), F.desc("batch")]
    return last_per_key(rows, keys, order).drop("batch")


def write_csv_artifact(rows: DataFrame, path: str) -> None:
    """Sorted CSV with every field quoted."""
    rows.write.mode("overwrite").options(**WRITING).csv(path)


def landing_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files and bytes per first path segment below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length")
    )
    below = F.split(F.substring_index("path", path.rstrip("/") + "/", -1), "/")
    return files.groupBy(below[0].alias("prefix")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def read_gold_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON object with a ``queries`` array."""
    holder = T.StructType([T.StructField("queries", T.ArrayType(GOLD))])
    return spark.read.schema(holder).option("multiLine", "true").json(path).select(F.inline("queries"))
