"""Keeping the chunk index: known documents, upserts, deletes, both layers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.fixtures import chunks_v, docs_v, labelled_v, scratch, sql, table
from catalog.registry import Registry
from quarry.operators import enrich, index, listing
from quarry.plans.batch import document_chunks, rebuild
from quarry.schemas import RAW_FIELDS
from quarry.session import spread
from quarry.sources import bucketed, chunk_table, files, topic
from quarry.sources.bucketed import write_bucketed
from quarry.streaming import layers

registry = Registry()
QUERIES, SQL, entry = registry.queries, registry.sql, registry.entry

KEPT = "doc_id, chunk_no, category, chunk_id"


def good_ids(spark, folder):
    return labelled_v(spark, folder).filter("quality = 1").select("id")


def toxic_ids(spark, folder):
    return labelled_v(spark, folder).filter("toxic = 1").select("id")


# The index holds the chunks of labelled documents.
@entry(
    "skip_indexed_docs",
    sql("SELECT id, title, category FROM docs_v d WHERE NOT EXISTS (SELECT 1 FROM labelled_v l WHERE l.id = d.id)", "docs_v", "labelled_v"),
)
def skip_indexed_docs(spark, folder):
    docs = docs_v(spark, folder)
    indexed = docs.join(labelled_v(spark, folder), "id", "left_semi")
    held = indexed.select(F.col("id").alias("doc_id"))
    return index.skip_indexed_docs(docs, held).select("id", "title", "category")


@entry(
    "doc_exists",
    sql("SELECT id FROM labelled_v WHERE quality = 1 AND id IN (SELECT doc_id FROM chunks_v)", "labelled_v", "chunks_v"),
)
def doc_exists(spark, folder):
    return index.existing_docs(good_ids(spark, folder), chunks_v(spark, folder))


@entry(
    "chunk_count_for",
    sql(
        """SELECT l.id, count(c.chunk_id) AS chunks FROM labelled_v l LEFT JOIN chunks_v c ON c.doc_id = l.id GROUP BY l.id""",
        "labelled_v",
        "chunks_v",
    ),
)
def chunk_count_for(spark, folder):
    return index.chunk_count_for(labelled_v(spark, folder).select("id"), chunks_v(spark, folder))


@entry(
    "enrich_dictionary",
    """SELECT c_custkey, c_name, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def enrich_dictionary(spark, folder):
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    joined = enrich.enrich_dictionary(table(spark, folder, "customer"), nation, "c_nationkey")
    return joined.select("c_custkey", "c_name", "n_name", "n_regionkey")


# Toxic documents expire on the tenth, the others that are labelled much later.
RELATIONS = """SELECT id, CASE toxic WHEN 1 THEN '2024-01-10' ELSE '2030-01-01' END AS expired_on,
    'replaced-' || id AS replaced_by FROM labelled_v"""


def relations(spark, folder):
    return labelled_v(spark, folder).selectExpr(
        "id", "if(toxic = 1, '2024-01-10', '2030-01-01') expired_on", "concat('replaced-', id) replaced_by"
    )


@entry(
    "filter_expired",
    sql(
        """SELECT id, title, category FROM docs_v d
        WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.id = d.id AND r.expired_on <= '2024-02-01')""",
        "docs_v",
        "labelled_v",
        relations=RELATIONS,
    ),
)
def filter_expired(spark, folder):
    kept = enrich.filter_expired(docs_v(spark, folder), relations(spark, folder), F.lit("2024-02-01"))
    return kept.select("id", "title", "category")


@entry(
    "filter_replaced",
    sql(
        """SELECT d.id, title, replaced_by FROM docs_v d LEFT JOIN relations r ON r.id = d.id
        WHERE expired_on IS NULL OR expired_on > '2024-02-01'""",
        "docs_v",
        "labelled_v",
        relations=RELATIONS,
    ),
)
def filter_replaced(spark, folder):
    kept = enrich.with_replacement(docs_v(spark, folder), relations(spark, folder), F.lit("2024-02-01"))
    return kept.select("id", "title", "replaced_by")


# Documents of good quality come again under another category.
@entry(
    "upsert_chunk_index",
    sql(
        f"""SELECT doc_id, chunk_no, CASE WHEN doc_id IN (SELECT id FROM labelled_v WHERE quality = 1)
            THEN category || '-again' ELSE category END AS category, chunk_id FROM chunks_v""",
        "chunks_v",
        "labelled_v",
    ),
)
def upsert_chunk_index(spark, folder):
    again = spread(docs_v(spark, folder)).join(good_ids(spark, folder), "id", "left_semi")
    incoming = document_chunks(again.withColumn("category", F.concat("category", F.lit("-again"))))
    return index.upsert_chunks(chunks_v(spark, folder), incoming).select("doc_id", "chunk_no", "category", "chunk_id")


# The same documents come with their title as content: their old chunks go.
@entry(
    "replace_documents",
    sql(
        """SELECT doc_id, chunk_id, length(chunk_text) AS characters FROM chunks_v
            WHERE doc_id NOT IN (SELECT id FROM labelled_v WHERE quality = 1)
        UNION ALL SELECT id, id || '_' || substr(md5(id || ':' || t), 1, 12), length(t) FROM (
            SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM docs_v
            WHERE id IN (SELECT id FROM labelled_v WHERE quality = 1)) WHERE t <> ''""",
        "chunks_v",
        "labelled_v",
    ),
)
def replace_documents(spark, folder):
    again = spread(docs_v(spark, folder)).join(good_ids(spark, folder), "id", "left_semi")
    incoming = document_chunks(again.withColumn("content", F.col("title")))
    replaced = index.replace_documents(chunks_v(spark, folder), incoming)
    return replaced.select("doc_id", "chunk_id", F.length("chunk_text").cast("long").alias("characters"))


@entry(
    "upsert_csv_artifact",
    sql(
        """SELECT id, CASE WHEN id IN (SELECT id FROM labelled_v) THEN 'again ' || title ELSE title END AS title, published_date
        FROM docs_v""",
        "docs_v",
        "labelled_v",
    ),
)
def upsert_csv_artifact(spark, folder):
    docs = docs_v(spark, folder)
    again = docs.join(labelled_v(spark, folder), "id", "left_semi")
    again = again.withColumn("title", F.concat(F.lit("again "), "title"))
    return index.upsert_csv_rows(docs, again).select("id", "title", "published_date")


@entry(
    "delete_by_doc_id",
    sql(f"SELECT {KEPT} FROM chunks_v WHERE doc_id NOT IN (SELECT id FROM labelled_v WHERE toxic = 1)", "chunks_v", "labelled_v"),
)
def delete_by_doc_id(spark, folder):
    return index.delete_by_doc_id(chunks_v(spark, folder), toxic_ids(spark, folder)).select(*KEPT.split(", "))


@entry(
    "deleted_count",
    sql("SELECT count(*) AS deleted FROM chunks_v WHERE doc_id IN (SELECT id FROM labelled_v WHERE toxic = 1)", "chunks_v", "labelled_v"),
)
def deleted_count(spark, folder):
    return index.deleted_count(chunks_v(spark, folder), toxic_ids(spark, folder))


# The speed layer holds the labelled documents, partly known to the batch layer.
@entry(
    "serving_view",
    sql(
        f"""SELECT {KEPT} FROM chunks_v WHERE doc_id NOT IN (SELECT id FROM labelled_v WHERE quality = 1)
        UNION ALL SELECT doc_id, chunk_no, 'speed', chunk_id FROM chunks_v
            WHERE doc_id IN (SELECT id FROM labelled_v WHERE quality = 1)""",
        "chunks_v",
        "labelled_v",
    ),
)
def serving_view(spark, folder):
    chunks = chunks_v(spark, folder)
    batch = chunks.join(good_ids(spark, folder).selectExpr("id doc_id"), "doc_id", "left_anti")
    speed = chunks.join(labelled_v(spark, folder).selectExpr("id doc_id"), "doc_id", "left_semi")
    view = index.serving_view(batch, speed.withColumn("category", F.lit("speed")))
    return view.select(*KEPT.split(", "))


@entry("distinct_ids", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events")
def distinct_ids(spark, folder):
    return index.distinct_ids(table(spark, folder, "events").selectExpr("cast(user_id as string) id"))


@entry(
    "last_per_key",
    """SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def last_per_key(spark, folder):
    newest = index.last_per_key(table(spark, folder, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return newest.select("user_id", "event_id", "event_type", "value")


# Listings run from the highest document id down; toxic documents are known.
LISTING = """SELECT source AS category, -doc_id AS position,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS seen FROM documents d"""


def seen_listing(spark, folder):
    known = table(spark, folder, "labels").filter("toxic = 1").selectExpr("doc_id", "true known")
    docs = table(spark, folder, "documents").select("doc_id", "source").join(known, "doc_id", "left")
    return docs.selectExpr("source category", "-doc_id position", "coalesce(known, false) seen")


@entry(
    "new_until_seen",
    sql(
        """SELECT * EXCLUDE (stops) FROM (SELECT *, count(*) FILTER (WHERE seen) OVER (
            PARTITION BY category ORDER BY position ROWS UNBOUNDED PRECEDING) AS stops FROM listing) WHERE stops = 0""",
        listing=LISTING,
    ),
)
def new_until_seen(spark, folder):
    return listing.new_until_seen(seen_listing(spark, folder), F.col("seen"))


@entry("skip_seen", sql("SELECT * FROM listing WHERE NOT seen", listing=LISTING))
def skip_seen(spark, folder):
    return listing.new_until_seen(seen_listing(spark, folder), F.col("seen"), stop_on_seen=False)


# Every document is crawled again an hour later, labelled ones also next month.
CRAWLS = """SELECT id, crawled_at, 1 AS n FROM docs_v
    UNION ALL SELECT id, strftime(CAST(crawled_at AS TIMESTAMP) + to_hours(1), '%Y-%m-%dT%H:%M:%SZ'), 2 FROM docs_v
    UNION ALL SELECT id, strftime(CAST(crawled_at AS TIMESTAMP) + to_days(31), '%Y-%m-%dT%H:%M:%S'), 3 FROM docs_v
        WHERE id IN (SELECT id FROM labelled_v)"""


def crawls(spark, folder):
    docs = docs_v(spark, folder)
    stamp = "to_timestamp(crawled_at)"
    later = docs.withColumn("crawled_at", F.expr(f"date_format({stamp} + interval 1 hour, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    month = docs.join(labelled_v(spark, folder), "id", "left_semi").withColumn(
        "crawled_at", F.expr(f"date_format({stamp} + interval 31 day, \"yyyy-MM-dd'T'HH:mm:ss\")")
    )
    return docs, later, month


def written_master(spark, folder):
    root = scratch(spark)
    for number, batch in enumerate(crawls(spark, folder)):
        files.write_master(batch, root, f"b{number}", F.current_timestamp())
    return root


@entry(
    "write_master",
    sql(
        """SELECT id, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, crawled_at FROM (
            SELECT *, CAST(rtrim(crawled_at, 'Z') AS TIMESTAMP) AS t FROM crawls)
        QUALIFY row_number() OVER (PARTITION BY id, year(t), month(t) ORDER BY n DESC) = 1""",
        "docs_v",
        "labelled_v",
        crawls=CRAWLS,
    ),
)
def write_master(spark, folder):
    stored = files.read_master(spark, written_master(spark, folder), all_versions=True)
    return stored.select("id", "year", "month", "crawled_at")


@entry(
    "read_master",
    sql(
        "SELECT id, crawled_at FROM crawls QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1",
        "docs_v",
        "labelled_v",
        crawls=CRAWLS,
    ),
)
def read_master(spark, folder):
    return files.read_master(spark, written_master(spark, folder)).select("id", "crawled_at")


ALL_RAW = sql(f"SELECT {', '.join(RAW_FIELDS)} FROM docs_v", "docs_v")


def landed_csv(spark, folder):
    root = scratch(spark)
    files.write_csv_artifact(docs_v(spark, folder), f"{root}/raw")
    return f"{root}/raw"


# The reader takes an empty field for null.
@entry("read_landing_csv", sql(f"SELECT {', '.join(f'nullif({f}, ' + chr(39) * 2 + f') AS {f}' for f in RAW_FIELDS)} FROM docs_v", "docs_v"))
def read_landing_csv(spark, folder):
    return files.valid_rows(files.read_landing_csv(spark, landed_csv(spark, folder)))


@entry("read_master_json", ALL_RAW)
def read_master_json(spark, folder):
    """Files with one JSON value each, here an array of documents."""
    root = scratch(spark)
    docs = docs_v(spark, folder)
    # About 500 documents an array, however many there are.
    bucket = F.pmod(F.xxhash64("id"), F.lit(max(64, -(-docs.count() // 500))))
    arrays = docs.groupBy(bucket.alias("bucket")).agg(
        F.to_json(F.collect_list(F.struct(*RAW_FIELDS))).alias("value")
    )
    arrays.write.partitionBy("bucket").option("compression", "none").text(f"{root}/text")
    good, _ = files.split_unreadable(files.read_master_json(spark, f"{root}/text", "*.txt"))
    return good


@entry(
    "landing_inventory",
    "SELECT source AS prefix, count(*) AS documents FROM documents GROUP BY source",
)
def landing_inventory(spark, folder):
    root = scratch(spark)
    docs = docs_v(spark, folder)
    docs.write.partitionBy("category").csv(f"{root}/raw")
    found = files.landing_inventory(spark, f"{root}/raw", "*.csv")
    counts = docs.groupBy("category").agg(F.count(F.lit(1)).alias("documents"))
    named = found.select(F.regexp_extract("prefix", "category=(.*)", 1).alias("category"), "files", "bytes")
    return named.filter("files > 0 and bytes > 0").join(counts, "category").selectExpr("category prefix", "documents")


@entry(
    "rebuild",
    sql("SELECT doc_id, chunk_no, chunk_text, chunk_id FROM chunks_v", "chunks_v"),
)
def rebuild_index(spark, folder):
    """A first run over the labelled documents, then one over all of them."""
    root = scratch(spark)
    docs = spread(docs_v(spark, folder))
    # Looked up in a hash table of the ids, so that contents are not sorted.
    rebuild(docs.join(labelled_v(spark, folder).hint("shuffle_hash"), "id", "left_semi"), root, "first")
    rebuild(docs, root, "second")
    return chunk_table.read_index(spark, root).select("doc_id", "chunk_no", "chunk_text", "chunk_id")


@entry(
    "rebuild_forced",
    sql(f"SELECT {KEPT} FROM chunks_v", "chunks_v"),
)
def rebuild_forced(spark, folder):
    """A forced run with other chunk sizes leaves no old chunks behind."""
    root = scratch(spark)
    docs = spread(docs_v(spark, folder))
    rebuild(docs, root, "first", max_length=300, overlap=0)
    rebuild(docs, root, "second", force=True)
    return chunk_table.read_index(spark, root).select(*KEPT.split(", "))


@entry(
    "snapshot_index",
    sql(f"SELECT {KEPT} FROM chunks_v WHERE doc_id NOT IN (SELECT id FROM labelled_v WHERE toxic = 1)", "chunks_v", "labelled_v"),
)
def snapshot_index(spark, folder):
    """Chunks deleted and compacted, then snapshot and restored."""
    root = scratch(spark)
    chunk_table.append_batch(chunks_v(spark, folder).withColumn("embedding", F.lit(None).cast("array<float>")), root, "all")
    chunk_table.delete_docs(toxic_ids(spark, folder), root, "toxic")
    chunk_table.compact(spark, root)
    chunk_table.take_snapshot({"index": chunk_table.read_index(spark, root), "audit": None}, f"{root}/snapshots", "20240201")
    restored = chunk_table.restore_snapshot(spark, f"{root}/snapshots", "20240201", "index")
    return restored.select(*KEPT.split(", "))


@entry("stream_landing_csv", ALL_RAW)
def stream_landing_csv(spark, folder):
    """Landed files through the record form and back, as one stream."""
    root = scratch(spark)
    landed = files.stream_landing_csv(spark, landed_csv(spark, folder))
    query = layers.landing_to_topic(
        landed, f"{root}/checkpoint", "parquet", {"availableNow": True}, path=f"{root}/records"
    )
    query.awaitTermination()
    return topic.from_records(spark.read.parquet(f"{root}/records"))


def streamed_docs(spark, folder):
    """The documents in two micro-batches of as many files as the scan has partitions, at least four."""
    path, docs = scratch(spark), docs_v(spark, folder)
    each = max(2, -(-docs.rdd.getNumPartitions() // 2))
    docs.repartition(2 * each).write.parquet(path)
    reader = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", each)
    return reader.parquet(path)


@entry("master_archiver", ALL_RAW)
def master_archiver(spark, folder):
    root = scratch(spark)
    query = layers.master_archiver(
        streamed_docs(spark, folder), f"{root}/master", f"{root}/checkpoint", {"availableNow": True}
    )
    query.awaitTermination()
    return files.read_master(spark, f"{root}/master").select(*RAW_FIELDS)


@entry("speed_layer", sql("SELECT doc_id, chunk_no, chunk_text, chunk_id FROM chunks_v", "chunks_v"))
def speed_layer(spark, folder):
    root = scratch(spark)
    query = layers.speed_layer(
        streamed_docs(spark, folder), f"{root}/index", f"{root}/checkpoint", trigger={"availableNow": True}
    )
    query.awaitTermination()
    stored = chunk_table.read_index(spark, f"{root}/index")
    return stored.select("doc_id", "chunk_no", "chunk_text", "chunk_id")


# Two batches that share a third of the documents are written at the same moment.
@entry("concurrent_batches", sql(f"SELECT {KEPT} FROM chunks_v", "chunks_v"))
def concurrent_batches(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    root = scratch(spark)
    chunks = chunks_v(spark, folder).withColumn("embedding", F.lit(None).cast("array<float>"))
    third = F.pmod(F.col("doc_id").cast("long"), F.lit(3))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda left: chunk_table.append_batch(chunks.where(third != left), root, f"without-{left}"), (0, 1)))
    return chunk_table.read_index(spark, root).select(*KEPT.split(", "))


# The index holds eight batches of labelled documents; the batches that may hold a document are told by filters.
@entry(
    "skip_by_filters",
    sql("SELECT id, category FROM docs_v d WHERE NOT EXISTS (SELECT 1 FROM labelled_v l WHERE l.id = d.id)", "docs_v", "labelled_v"),
)
def skip_by_filters(spark, folder):
    root = scratch(spark)
    docs = docs_v(spark, folder)
    labelled = labelled_v(spark, folder).select(F.col("id").alias("doc_id"))
    chunks = chunks_v(spark, folder).join(labelled, "doc_id", "left_semi").withColumn("embedding", F.lit(None).cast("array<float>"))
    for part in range(8):
        chunk_table.append_batch(chunks.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == part), root, f"part-{part}")
    ids = docs.select(F.col("id").alias("doc_id"))
    return index.skip_indexed_docs(docs, chunk_table.read_index(spark, root, doc_ids=ids, least_rows=0)).select("id", "category")


@entry("filter_expired_bucketed", SQL["filter_expired"])
def filter_expired_bucketed(spark, folder):
    """Both sides as tables in buckets of the id."""
    names = [f"quarry_{kind}_{uuid.uuid4().hex}" for kind in ("docs", "relations")]
    for df, name in zip((docs_v(spark, folder).select("id", "title", "category"), relations(spark, folder)), names):
        write_bucketed(df, name, scratch(spark), buckets=8)
    return bucketed.filter_expired_bucketed(spark, *names, F.lit("2024-02-01")).select("id", "title", "category")
