"""The chunk index as parquet: batches of chunks and of deletions under numbered manifests.

Each write puts its rows into folders of its own and then commits a manifest that names
them, so that a reader, who takes one manifest, sees all of a batch or nothing. Writing a batch again
replaces its entries, so a replayed micro-batch changes nothing. A write compares its chunk ids with
those of the index and hides older rows of the same chunk; a writer that another one overtook compares with
what came in between before it commits, so that a chunk is read once whoever writes at the same time. Deletions are
rows that hide older chunks; ``compact`` writes what is left as one batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.index import distinct_ids
from quarry.schemas import AUDIT, INDEX
from quarry.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small
from quarry.sources.id_filter import may_hold, write_filters
from quarry.sources.manifest import Entry, Manifest, commit, read_manifest
from quarry.sources.postings import write_postings
from quarry.sources.storage import read_if_present

_BATCH = T.StructField("batch", T.StringType())
STORED = T.StructType([*INDEX.fields, T.StructField("written_at", T.TimestampType()), T.StructField("entry", T.StringType())])
DELETED = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("deleted_at", T.TimestampType())])
REPLACED = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("entry", T.StringType())])
VERSION = T.StructType([T.StructField("ts", T.TimestampType()), _BATCH])

# Indexes of fewer rows are read by their id column alone, which takes less time than asking filters.
FILTERED_ROWS = 1_000_000

# Rows of a file whose bits, as Spark makes them, tell which of them are hidden.
BITS_POWER = 15
BITS = 1 << BITS_POWER


def _put(rows: DataFrame, path: str, batch: str) -> None:
    (
        rows.withColumn("batch", F.lit(batch))
        .write.partitionBy("batch")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def _folder(root: str, kind: str) -> str:
    return f"{root}/data/{kind}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, entries: Iterable[Entry], schema: T.StructType) -> DataFrame:
    folders = [e.folder for e in entries]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _numbers(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """Commit number of each entry; as many rows as the manifest has."""
    rows = [(e.folder.rsplit("/", 1)[-1], e.number) for e in entries]
    return F.broadcast(spark.createDataFrame(rows, "entry string, number long"))


def _small(side: DataFrame, entries: list[Entry]) -> DataFrame:
    """Broadcast a side whose rows, as the manifest counts them, are few; ids and times only."""
    return F.broadcast(side) if sum(e.rows for e in entries) <= BROADCAST_ROWS else side


def entries_holding(
    spark: SparkSession, entries: list[Entry], ids: DataFrame, name: str = "doc_id", least_rows: int = FILTERED_ROWS
) -> list[Entry]:
    """The entries that may hold one of the values of ``ids``' column ``name``, by the filters beside them.

    ``name`` is ``doc_id`` or ``chunk_id``. Entries without filters are always among them.
    """
    if sum(e.rows for e in entries) < least_rows:
        return entries
    folder_of = {f"{e.filters}/{name}": e for e in entries if e.filters}
    held = set(may_hold(spark, list(folder_of), ids, name))
    return [e for e in entries if not e.filters or f"{e.filters}/{name}" in held]


def read_index(
    spark: SparkSession,
    root: str,
    without_batch: str | None = None,
    doc_ids: DataFrame | None = None,
    manifest: Manifest | None = None,
    least_rows: int = FILTERED_ROWS,
) -> DataFrame:
    """Chunks that no later deletion or batch hides, optionally without one batch.

    With ``doc_ids`` (column ``doc_id``) only the batches that may hold one of these documents are read. The frame is
    pinned to one manifest, the newest unless given.
    """
    at = manifest or read_manifest(spark, root)
    entries = [e for e in at.of("chunks") if e.batch != without_batch]
    if doc_ids is not None:
        entries = entries_holding(spark, entries, doc_ids, least_rows=least_rows)
    return visible(spark, at, entries).select(*INDEX.names)


def stored_rows(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """All rows of the entries, hidden ones too."""
    return _read(spark, entries, STORED)


def visible(spark: SparkSession, at: Manifest, entries: list[Entry]) -> DataFrame:
    """The stored rows of the entries that nothing in the manifest hides.

    Where many rows hide others, ids and times alone are compared, and the hidden rows go to the scans as bits by their place
    in the files: contents are not moved.
    """
    chunks = _read(spark, entries, STORED)
    hiding = at.of("deleted") + at.of("replaced")
    if not entries or not hiding:
        return chunks
    if max(sum(e.rows for e in at.of(kind)) for kind in ("deleted", "replaced")) <= BROADCAST_ROWS or not _bits_fit(chunks, entries):
        for kind in ("deleted", "replaced"):
            chunks = _split(spark, at, entries, chunks, kind, "left_anti")
        return chunks.select(*STORED.names)
    places = chunks.select("doc_id", "chunk_id", "entry", "written_at", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    hidden = [_split(spark, at, entries, places, kind, "left_semi").select("entry", "_file", "_row") for kind in ("deleted", "replaced") if at.of(kind)]
    bits = reduce(DataFrame.unionByName, hidden).groupBy(F.col("entry").alias("_in"), F.col("_file").alias("_of"), F.shiftright("_row", BITS_POWER).alias("_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("_row").bitwiseAND(BITS - 1)).alias("_bits"))
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    placed = chunks.select("*", name.alias("_file"), F.shiftright(row, BITS_POWER).alias("_at"), row.bitwiseAND(BITS - 1).cast("int").alias("_bit"))
    same = (F.col("entry") == F.col("_in")) & (F.col("_file") == F.col("_of")) & (F.col("_at") == F.col("_part"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_hidden = F.getbit(byte, F.col("_bit").bitwiseAND(7)) == 1
    return placed.join(F.broadcast(bits), same, "left").where(F.col("_bits").isNull() | ~is_hidden).select(*STORED.names)


def _split(spark: SparkSession, at: Manifest, entries: list[Entry], rows: DataFrame, kind: str, how: str) -> DataFrame:
    """Of ``rows`` those that deletions or, by ``kind``, later rows of a chunk hide (``left_semi``), or the others (``left_anti``)."""
    hiding = at.of(kind)
    if not hiding:
        return rows
    if kind == "deleted":
        gone = _read(spark, hiding, DELETED).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("deleted_at").alias("_deleted_at"))
        hidden = (F.col("doc_id") == F.col("_doc")) & (F.col("written_at") < F.col("_deleted_at"))
        return rows.join(_small(gone, hiding), hidden, how)
    newest = _read(spark, hiding, REPLACED).join(_numbers(spark, hiding), "entry").groupBy(F.col("chunk_id").alias("_chunk")).agg(F.max("number").alias("_number"))
    # Of the rows of a chunk the one that was committed last stays.
    hidden = (F.col("chunk_id") == F.col("_chunk")) & (F.col("number") < F.col("_number"))
    return rows.join(_numbers(spark, entries), "entry").join(_small(newest, hiding), hidden, how)


def _bits_fit(chunks: DataFrame, entries: list[Entry]) -> bool:
    """The bits of all rows, with a part of a file at least for each file, are within the limit of a broadcast."""
    parts = sum(e.rows for e in entries) // BITS + len(chunks.inputFiles())
    return parts * BITS // 8 <= BROADCAST_BYTES


def append_batch(
    chunks: DataFrame,
    root: str,
    batch: str,
    now: Column | None = None,
    deletes: DataFrame | None = None,
    fields: list[str] | None = None,
    least_rows: int = FILTERED_ROWS,
) -> int:
    """Put a batch of chunks into the index by chunk id; returns the row count.

    Where other batches hold a chunk id already, a row that hides it goes with the batch: chunk
    ids alone are compared, contents are neither read nor moved. Of a chunk that comes repeatedly in the
    batch one row is written. ``deletes`` (column ``id``) hides older chunks of these documents with the same commit.
    ``fields`` are the text columns whose postings are written too (see ``postings``).
    """
    spark = chunks.sparkSession
    stamp = F.current_timestamp() if now is None else now
    rows = chunks.select(*[F.col(f.name).cast(f.dataType) for f in INDEX.fields], stamp.alias("written_at"))
    folder = _written_once(rows, root)
    written = spark.read.schema(STORED).parquet(folder)
    count = written.count()
    filters, postings = _beside(written, count, root, fields)
    new = [Entry("chunks", batch, folder, count, filters=filters, postings=postings)] if count else []
    if deletes is not None:
        new.append(_written_deletes(deletes, root, batch, stamp))
    seen: set[str] = set()

    def change(current: Manifest) -> list[Entry]:
        kept = [e for e in current.entries if e.batch != batch]
        # After a lost race only the entries that came in between are compared.
        others = [e for e in kept if e.kind == "chunks" and e.folder not in seen]
        seen.update(e.folder for e in others)
        if count and others:
            new.extend(_written_replaced(spark, written, others, root, batch, least_rows))
        return [*kept, *new]

    commit(spark, root, change)
    return count


def _written_once(rows: DataFrame, root: str) -> str:
    """Folder with the rows, of those with one chunk id a single one.

    They are written as they come. Only where ids of the written rows repeat, contents move, those of the repeated ids
    alone, and the rows are written again.
    """
    spark = rows.sparkSession

    def put(some: DataFrame) -> str:
        folder = _folder(root, "chunks")
        some.withColumn("entry", F.lit(folder.rsplit("/", 1)[-1])).write.parquet(folder)
        return folder

    folder = put(rows)
    written = spark.read.schema(STORED).parquet(folder)
    repeated = written.groupBy(F.col("chunk_id").alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again")
    if repeated.isEmpty():
        return folder
    repeated, same = broadcast_if_small(repeated), F.col("chunk_id").eqNullSafe(F.col("_again"))
    first = written.join(repeated, same, "left_semi").dropDuplicates(["chunk_id"])
    return put(written.join(repeated, same, "left_anti").unionByName(first))


def _beside(written: DataFrame, count: int, root: str, fields: list[str] | None) -> tuple[str | None, str | None]:
    """Folders of the filters and, if asked for, of the postings of written chunks."""
    if not count:
        return None, None
    filters, postings = _folder(root, "filters"), None
    for name in ("doc_id", "chunk_id"):
        write_filters(written, name, count, f"{filters}/{name}")
    if fields:
        postings = _folder(root, "postings")
        write_postings(written, fields, postings)
    return filters, postings


def _written_replaced(spark: SparkSession, written: DataFrame, others: list[Entry], root: str, batch: str, least_rows: int) -> list[Entry]:
    """An entry with the chunk ids of the batch that others hold; none if there are none."""
    others = entries_holding(spark, others, written.select("chunk_id"), "chunk_id", least_rows)
    if not others:
        return []
    folder = _folder(root, "replaced")
    known = _read(spark, others, STORED).select("chunk_id")
    again = written.select("chunk_id").join(known, "chunk_id", "left_semi").withColumn("entry", F.lit(folder.rsplit("/", 1)[-1]))
    again.write.parquet(folder)
    rows = spark.read.schema(REPLACED).parquet(folder).count()
    return [Entry("replaced", batch, folder, rows)] if rows else []


def _written_deletes(ids: DataFrame, root: str, batch: str, stamp: Column) -> Entry:
    folder = _folder(root, "deleted")
    distinct_ids(ids).select(F.col("id").alias("doc_id"), stamp.alias("deleted_at")).write.parquet(folder)
    return Entry("deleted", batch, folder, ids.sparkSession.read.schema(DELETED).parquet(folder).count())


def delete_docs(ids: DataFrame, root: str, batch: str, now: Column | None = None) -> None:
    """Hide every chunk of the given ids (column ``id``) written before ``now``."""
    new = _written_deletes(ids, root, batch, F.current_timestamp() if now is None else now)
    commit(ids.sparkSession, root, lambda current: [*[e for e in current.entries if (e.kind, e.batch) != ("deleted", batch)], new])


def compact(spark: SparkSession, root: str, keep: DataFrame | None = None, fields: list[str] | None = None) -> None:
    """Put the visible chunks, or ``keep``, in the place of all entries they come from.

    An empty ``keep`` wipes the index. Entries that other writers commit meanwhile stay; if one of the entries read
    is replaced meanwhile, the work is done again. ``fields`` as in ``append_batch``.
    """
    while True:
        at = read_manifest(spark, root)
        folder = _folder(root, "chunks")
        # Rows keep their time, so that a deletion that is under way hides them as before.
        rows = visible(spark, at, at.of("chunks")) if keep is None else keep.select(*INDEX.names, F.current_timestamp().alias("written_at"))
        rows.withColumn("entry", F.lit(folder.rsplit("/", 1)[-1])).write.parquet(folder)
        written = spark.read.schema(STORED).parquet(folder)
        count, read = written.count(), {e.folder for e in at.entries}
        filters, postings = _beside(written, count, root, fields)
        # The number of the newest entry read: later ones still hide its rows.
        new = [Entry("chunks", f"compacted-{folder[-12:]}", folder, count, number=at.number or 1, filters=filters, postings=postings)] if count else []
        stale = []

        def change(current: Manifest) -> list[Entry] | None:
            if not read <= {e.folder for e in current.entries}:
                stale.append(True)
                return None
            return [*new, *[e for e in current.entries if e.folder not in read]]

        commit(spark, root, change)
        if not stale:
            return


def note_version(spark: SparkSession, root: str, batch: str) -> None:
    """Record that the index changed; cached answers older than this are void."""
    _put(spark.range(1).select(F.current_timestamp().alias("ts")), f"{root}/versions", batch)


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    return read_if_present(spark, f"{root}/versions", VERSION).select("ts")


def take_snapshot(tables: dict[str, DataFrame | None], root: str, stamp: str) -> str:
    """Copy tables into ``root/snap-<stamp>``; missing ones are left out."""
    folder = f"{root}/snap-{stamp}"
    for name, table in tables.items():
        if table is not None:
            table.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return folder


def restore_snapshot(spark: SparkSession, root: str, stamp: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snap-{stamp}/{name}")


def write_audit(records: DataFrame, path: str, batch: str) -> None:
    """Append audit records of one batch of questions."""
    _put(records.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT.fields]), path, batch)
