"""Documents on a message topic: key is the id, value the JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schemas import RAW, RAW_FIELDS

def to_records(docs: DataFrame) -> DataFrame:
    """``key, value`` as bytes; nulls stay in the JSON, letters stay as they are."""
    value = F.to_json(F.struct(*RAW_FIELDS), {"ignoreNullFields": "false"})
    return docs.select(
        F.coalesce("id", F.lit("")).cast("binary").alias("key"), value.cast("binary").alias("value")
    )


def from_records(records: DataFrame) -> DataFrame:
    """Documents of ``key, value`` records; a broken value gives only nulls."""
    parsed = F.from_json(F.col("value").cast("string"), RAW)
    return records.select(parsed.alias("data")).select("data.*")


def rejected_records(records: DataFrame) -> DataFrame:
    """``key``, ``value`` and ``reason`` of the records whose value is no JSON object, with what they held."""
    text = F.col("value").cast("string")
    seen = F.try_parse_json(text)
    reason = (
        F.when(text.isNull(), "no value")
        .when(seen.isNull(), "not JSON")
        .when(~F.schema_of_variant(seen).startswith("OBJECT"), "no object")
    )
    return records.select(F.col("key").cast("string").alias("key"), text.alias("value"), reason.alias("reason")).where("reason is not null")


def read_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Stream of documents from the earliest record on; ``max_offsets`` bounds a trigger, by default nothing does."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return from_records(reader.load())


def publish(docs: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Write a batch, or start a stream, of documents to a topic."""
    records = to_records(docs)
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if docs.isStreaming:
        if not checkpoint:
            raise ValueError("a stream needs a checkpoint folder")
        return records.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()
    return records.write.format("kafka").options(**options).save()
