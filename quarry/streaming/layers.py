"""Streams from landing files to topic, master dataset and chunk index.

The steps are those of the batch layer. A failing micro-batch raises, so the
checkpoint replays it; every sink write is keyed by the batch and a replay
replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.text import MAX_LENGTH, OVERLAP
from quarry.operators.index import skip_indexed_docs
from quarry.operators.normalize import drop_blank_records, normalize_record
from quarry.plans.batch import Embed, new_chunks
from quarry.sources.chunk_table import append_batch, note_version, read_index
from quarry.sources.files import write_master
from quarry.sources.topic import to_records


def landing_to_records(landed: DataFrame) -> DataFrame:
    """Normalised topic records of landed rows; batch and stream alike."""
    return to_records(drop_blank_records(normalize_record(landed)))


def _start(df: DataFrame, write, checkpoint: str, trigger: dict) -> StreamingQuery:
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def landing_to_topic(
    landed: DataFrame, checkpoint: str, sink: str = "kafka", trigger: dict | None = None, **options: str
) -> StreamingQuery:
    """Publish landed rows; ``sink`` and its options name the topic."""
    writer = landing_to_records(landed).writeStream.format(sink).options(**options)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def master_archiver(docs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the master dataset up to date; its own query and checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_master(batch, path, f"stream-{batch_id:012d}", F.current_timestamp())

    return _start(docs, write, checkpoint, trigger or {"processingTime": "10 seconds"})


def speed_layer(
    docs: DataFrame,
    root: str,
    checkpoint: str,
    embed: Embed | None = None,
    trigger: dict | None = None,
    max_length: int = MAX_LENGTH,
    overlap: int = OVERLAP,
) -> StreamingQuery:
    """Index documents as they arrive.

    Known documents are skipped before anything is cleaned or embedded, and of a large index only the
    batches are read that may hold one of them. The
    batch's own earlier output is not counted as known, or a replay after a
    failure between write and commit would lose it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"speed-{batch_id:012d}"
        spark = batch.sparkSession
        known = read_index(spark, root, without_batch=name, doc_ids=batch.select(F.col("id").alias("doc_id")))
        chunks = new_chunks(skip_indexed_docs(batch, known), embed, max_length, overlap)
        if append_batch(chunks, root, name):
            note_version(spark, root, name)

    return _start(docs, write, checkpoint, trigger or {"processingTime": "10 seconds"})
