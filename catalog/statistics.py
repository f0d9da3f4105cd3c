"""Corpus statistics, pivots and ordered scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.fixtures import chunks_v, docs_v, sql, table
from catalog.registry import Registry
from quarry.operators import rag, sketches, stats

registry = Registry()
QUERIES, SQL, entry = registry.queries, registry.sql, registry.entry


@entry("total_chunks", sql("SELECT count(*) AS chunks FROM chunks_v", "chunks_v"))
def total_chunks(spark, folder):
    return stats.total_chunks(chunks_v(spark, folder))


@entry("unique_documents", sql("SELECT count(DISTINCT doc_id) AS documents FROM chunks_v", "chunks_v"))
def unique_documents(spark, folder):
    return stats.unique_documents(chunks_v(spark, folder))


@entry("unique_documents_approx")
def unique_documents_approx(spark, folder):
    return stats.unique_documents(chunks_v(spark, folder), approximate=True)


@entry(
    "chunks_by_category",
    sql(
        """SELECT category, chunks, round(chunks * 100.0 / sum(chunks) OVER (), 6) AS percent FROM (
            SELECT category, count(*) AS chunks FROM chunks_v WHERE category IS NOT NULL
            GROUP BY category ORDER BY chunks DESC, category LIMIT 20)""",
        "chunks_v",
    ),
)
def chunks_by_category(spark, folder):
    return stats.chunks_by_category(chunks_v(spark, folder))


@entry(
    "document_details",
    sql(
        """SELECT doc_id, category, chunks, doc_chunks, category_rank FROM (
            SELECT p.doc_id, category, chunks, doc_chunks,
                row_number() OVER (PARTITION BY p.doc_id ORDER BY chunks DESC, category) AS category_rank
            FROM (SELECT doc_id, category, count(*) AS chunks FROM chunks_v GROUP BY ALL) p
            JOIN (SELECT doc_id, count(*) AS doc_chunks FROM chunks_v GROUP BY doc_id
                ORDER BY doc_chunks DESC, doc_id LIMIT 50) d ON d.doc_id = p.doc_id)
        WHERE category_rank <= 50""",
        "chunks_v",
    ),
)
def document_details(spark, folder):
    return stats.document_details(chunks_v(spark, folder))


@entry(
    "documents_per_category",
    sql(
        """SELECT category, count(DISTINCT doc_id) AS documents FROM chunks_v WHERE category IS NOT NULL
        GROUP BY category ORDER BY documents DESC, category LIMIT 20""",
        "chunks_v",
    ),
)
def documents_per_category(spark, folder):
    return stats.documents_per_category(chunks_v(spark, folder))


@entry(
    "longest_documents",
    sql("SELECT doc_id, count(*) AS chunks FROM chunks_v GROUP BY doc_id ORDER BY chunks DESC, doc_id LIMIT 10", "chunks_v"),
)
def longest_documents(spark, folder):
    return stats.longest_documents(chunks_v(spark, folder))


@entry(
    "avg_chunks_per_document",
    sql("SELECT count(*) / count(DISTINCT doc_id) AS avg_chunks FROM chunks_v", "chunks_v"),
)
def avg_chunks_per_document(spark, folder):
    return stats.avg_chunks_per_document(chunks_v(spark, folder))


@entry("latest_articles", sql("SELECT * FROM docs_v ORDER BY published_date DESC, id LIMIT 10", "docs_v"))
def latest_articles(spark, folder):
    return stats.latest_articles(docs_v(spark, folder))


@entry(
    "latest_articles_of_category",
    sql("SELECT * FROM docs_v WHERE category = 'src1' ORDER BY published_date DESC, id LIMIT 10", "docs_v"),
)
def latest_articles_of_category(spark, folder):
    return stats.latest_articles(docs_v(spark, folder), 10, "src1")


@entry(
    "document_stats",
    sql(
        """SELECT category, doc_type, CAST(CASE WHEN category IS NULL THEN 3 WHEN doc_type IS NULL THEN 1 ELSE 0 END AS BIGINT) AS level,
            count(*) AS documents, round(avg(length(content)), 6) AS avg_length,
            round(stddev_samp(length(content)), 6) AS stddev_length,
            quantile_cont(length(content), 0.5) AS median_length,
            arg_max(id, (length(content), id)) AS longest_id
        FROM docs_v GROUP BY ROLLUP (category, doc_type)""",
        "docs_v",
    ),
)
def document_stats(spark, folder):
    rounded = {c: F.round(c, 6) for c in ("avg_length", "stddev_length")}
    return stats.document_stats(docs_v(spark, folder)).withColumns(rounded)


# Orders stand for documents: type is the priority, the date its publication.
YEARS = list(range(1992, 2000))


def orders_v(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("doc_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date")
    )


@entry(
    "pivot_type_by_year",
    "SELECT o_orderpriority AS doc_type, "
    + ", ".join(f'count(*) FILTER (WHERE year(o_orderdate) = {y}) AS "{y}"' for y in YEARS)
    + " FROM orders GROUP BY o_orderpriority",
)
def pivot_type_by_year(spark, folder):
    return stats.pivot_type_by_year(orders_v(spark, folder), YEARS)


@entry(
    "unpivot_type_by_year",
    " UNION ALL ".join(
        f"SELECT o_orderpriority AS doc_type, '{y}' AS year, count(*) FILTER (WHERE year(o_orderdate) = {y}) AS documents"
        " FROM orders GROUP BY o_orderpriority"
        for y in YEARS
    ),
)
def unpivot_type_by_year(spark, folder):
    return stats.unpivot_type_by_year(stats.pivot_type_by_year(orders_v(spark, folder), YEARS))


@entry(
    "document_rank_stats",
    sql(
        """SELECT id, category, day, length, row_number() OVER w AS row_no, rank() OVER d AS rank,
            dense_rank() OVER d AS dense_rank, ntile(4) OVER w AS tile, lag(length) OVER w AS previous_length,
            CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_length,
            round(avg(length) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg
        FROM (SELECT id, category, substr(published_date, 1, 10) AS day, length(content) AS length FROM docs_v)
        WINDOW w AS (PARTITION BY category ORDER BY day, id), d AS (PARTITION BY category ORDER BY day)""",
        "docs_v",
    ),
)
def document_rank_stats(spark, folder):
    ranked = stats.document_rank_stats(docs_v(spark, folder))
    return ranked.withColumn("moving_avg", F.round("moving_avg", 6))


@entry(
    "history_window",
    """SELECT conv_id, turn, role, text, coalesce(array_to_string(list(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history
    FROM conversations""",
)
def history_window(spark, folder):
    return rag.history_window(table(spark, folder, "conversations"))


# Sketches of four batches, united: within 2 % of the exact count, and 1 % of rank of the exact quantiles.
@entry(
    "unique_documents_sketched",
    sql(
        """SELECT category, count(DISTINCT doc_id) AS documents, true AS count_near, true AS median_near, true AS tail_near
        FROM chunks_v WHERE category IS NOT NULL GROUP BY category""",
        "chunks_v",
    ),
)
def unique_documents_sketched(spark, folder):
    chunks = chunks_v(spark, folder).where("category is not null").withColumn("length", F.length("chunk_text"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    stored = reduce(DataFrame.unionByName, [sketches.batch_sketches(chunks.where(part == i), F.col("length"), ["category"]) for i in range(4)])
    found = sketches.distinct_keys(stored, ["category"]).join(sketches.quantiles(stored, {"p50": 0.5, "p90": 0.9}, ["category"]), "category")
    # A row per category, joined with the rows it stands for.
    ranked = chunks.join(found.withColumnRenamed("documents", "estimate"), "category")

    def near(name, p):
        below, upto = (F.avg((F.col("length") < F.col(name)).cast("int")), F.avg((F.col("length") <= F.col(name)).cast("int")))
        return (below - 0.01 <= p) & (upto + 0.01 >= p)

    return ranked.groupBy("category").agg(
        F.count_distinct("doc_id").alias("documents"),
        (F.abs(F.first("estimate") - F.count_distinct("doc_id")) <= 0.02 * F.count_distinct("doc_id")).alias("count_near"),
        near("p50", 0.5).alias("median_near"), near("p90", 0.9).alias("tail_near"),
    )
