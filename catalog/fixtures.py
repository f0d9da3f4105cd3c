"""The given tables seen as documents, questions and a request log.

Every view exists twice: as a DataFrame and, under the same name, as a common
table expression for the SQL that checks it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.batch import distinct_chunks
from quarry.session import checkpoint_dir, spread
from quarry.sources.chunk_table import append_batch, read_index

LINK = r'href="([^"]+)"'
SITE = "https://docs.example.com"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}"


def _iso(hours: str) -> str:
    return f"replace(cast(timestampadd(HOUR, {hours}, TIMESTAMP_NTZ '2024-01-01 00:00:00') as string), ' ', 'T')"


def docs_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "cast(doc_id as string) id",
        "substr(text, 1, 60) title",
        "text content",
        "source category",
        "lang doc_type",
        "'' doc_number",
        "'' agency",
        f"{_iso('doc_id')} published_date",
        f"concat('{SITE}/a-', doc_id, '.html') url",
        f"{_iso('doc_id + 24')} crawled_at",
    )


def index_v(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk index of all documents; a document's vector is that of its id.

    It is built and stored once per session, as a search index is, and read
    by every query on it.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        docs = spread(docs_v(spark, folder))
        vectors = table(spark, folder, "embeddings").selectExpr("cast(vec_id as string) doc_id", "embedding")
        root = scratch(spark)
        # Chunks are dealt by document and looked up in a hash table of its vectors, so their contents are not sorted.
        append_batch(distinct_chunks(docs).join(vectors.hint("shuffle_hash"), "doc_id", "left"), root, "all")
        _STORED[key] = root
    return spread(read_index(spark, _STORED[key]))


_STORED: dict[tuple[str, str], str] = {}


def chunks_v(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index without vectors."""
    return index_v(spark, folder).drop("embedding")


def questions_v(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").selectExpr("item_id query_id", "text question")
    vectors = table(spark, folder, "embeddings").selectExpr("vec_id query_id", "embedding")
    return asked.join(vectors, "query_id", "left")


def labelled_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").selectExpr("cast(doc_id as string) id", "quality", "toxic")


def links_v(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the stored pages in page order, with the site of the page."""
    pages = table(spark, folder, "pages")
    links = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("position", "href"))
    return links.withColumn("site", F.regexp_extract("url", r"^(https?://[^/]+)", 1))


def requests_v(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    paths = {
        "signup": "smalltalk", "view": "cache", "purchase": "rag",
        "click": "threshold_refused", "error": "no_info",
    }
    path = F.lit(None).cast("string")
    for event, name in paths.items():
        path = F.when(F.col("event_type") == event, name).otherwise(path)
    return events.select(
        "event_id", "ts", "user_id", path.alias("path"),
        (F.col("value") / 50).alias("latency_seconds"),
        (F.get_json_object("props", "$.k").cast("int") % 6).cast("double").alias("sources"),
    )


_CTES = {
    "docs_v": (
        [],
        f"""SELECT CAST(doc_id AS VARCHAR) AS id, substr(text, 1, 60) AS title, text AS content, source AS category,
            lang AS doc_type, '' AS doc_number, '' AS agency,
            strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%S') AS published_date,
            '{SITE}/a-' || doc_id || '.html' AS url,
            strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id + 24), '%Y-%m-%dT%H:%M:%S') AS crawled_at
        FROM documents""",
    ),
    "cleaned": (
        ["docs_v"],
        r"SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS clean FROM docs_v",
    ),
    "sentences": (
        ["cleaned"],
        r"""SELECT id, clean, list_filter(list_transform(
                string_split_regex(regexp_replace(clean, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'),
                lambda s: trim(s)), lambda s: s <> '') AS s
        FROM cleaned""",
    ),
    "chunks": (
        ["packed", "cleaned"],
        """SELECT c.id AS doc_id, CAST(p.chunk_no AS INTEGER) AS chunk_no, p.chunk_text, c.title, c.url, c.category, c.doc_type,
            c.agency, c.published_date, c.id || '_' || substr(md5(c.id || ':' || p.chunk_text), 1, 12) AS chunk_id
        FROM cleaned c JOIN packed p ON c.id = p.id""",
    ),
    "chunks_v": (
        ["chunks"],
        "SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_no DESC) = 1",
    ),
    "index_v": (
        ["chunks_v"],
        "SELECT c.*, e.embedding FROM chunks_v c LEFT JOIN embeddings e ON c.doc_id = CAST(e.vec_id AS VARCHAR)",
    ),
    "questions_v": (
        [],
        """SELECT b.item_id AS query_id, b.text AS question, e.embedding
        FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
    ),
    "labelled_v": ([], "SELECT CAST(doc_id AS VARCHAR) AS id, quality, toxic FROM labels"),
    "links_v": (
        [],
        f"""SELECT page_id, url, site, i - 1 AS position, h[i] AS href FROM (
            SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, h, unnest(range(1, len(h) + 1)) AS i
            FROM (SELECT *, regexp_extract_all(html, '{LINK}', 1) AS h FROM pages))""",
    ),
    "requests_v": (
        [],
        """SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'smalltalk' WHEN 'view' THEN 'cache'
            WHEN 'purchase' THEN 'rag' WHEN 'click' THEN 'threshold_refused' WHEN 'error' THEN 'no_info' END AS path,
            value / 50 AS latency_seconds, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 AS DOUBLE) AS sources
        FROM events""",
    ),
}


def packed_sql(source: str = "sentences", max_length: int = 1000, overlap: int = 100) -> str:
    """Greedy packing as a recursive query, one step per sentence."""
    step = max_length - overlap
    fits = f"(CASE WHEN cur IS NULL THEN length(x) ELSE n + 1 + length(x) END) <= {max_length}"
    carry = f"right(cur, {overlap}) || ' ' || x" if overlap else "x"
    tail = f"least(length(cur), {overlap}) + 1 + length(x)"
    return f"""SELECT id, i AS chunk_no, c[i + 1] AS chunk_text FROM (
        SELECT id, c, unnest(range(0, len(c))) AS i FROM (
            SELECT id, [clean] AS c FROM {source} WHERE length(clean) BETWEEN 1 AND 49
            UNION ALL
            SELECT id, CASE WHEN cur IS NULL THEN done ELSE list_append(done, cur) END FROM (
                WITH RECURSIVE walk AS (
                    SELECT id, s, 1 AS i, s[1] AS x, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS cur, 0 AS n
                    FROM {source} WHERE length(clean) >= 50
                    UNION ALL
                    SELECT id, s, i + 1, s[i + 1],
                        CASE WHEN length(x) > {max_length} THEN list_concat(
                                CASE WHEN cur IS NULL THEN done ELSE list_append(done, cur) END,
                                list_transform(range(0, length(x), {step}), lambda k: trim(substr(x, k + 1, {max_length}))))
                            WHEN {fits} THEN done ELSE list_append(done, cur) END,
                        CASE WHEN length(x) > {max_length} THEN NULL
                            WHEN {fits} THEN CASE WHEN cur IS NULL THEN x ELSE cur || ' ' || x END ELSE {carry} END,
                        CASE WHEN length(x) > {max_length} THEN 0
                            WHEN {fits} THEN CASE WHEN cur IS NULL THEN length(x) ELSE n + 1 + length(x) END ELSE {tail} END
                    FROM walk WHERE i <= len(s))
                SELECT id, done, cur FROM walk WHERE i = len(s) + 1)))"""


_CTES["packed"] = (["sentences"], packed_sql())


def fold_sql(text: str) -> str:
    return f"strip_accents(replace(replace(lower({text}), 'ß', 'ss'), 'đ', 'd'))"


def tokens_sql(text: str) -> str:
    return rf"list_filter(string_split_regex({fold_sql(text)}, '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def bm25_sql(field: str, source: str = "chunks_v", key: str = "chunk_id") -> str:
    return f"""SELECT query_id, {key}, sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5))
            * tf / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))) AS score
        FROM (SELECT {key}, size, term, count(*) AS tf FROM (
                SELECT {key}, len(t) AS size, unnest(t) AS term FROM (SELECT {key}, {tokens_sql(field)} AS t FROM {source}))
            GROUP BY ALL) p
        JOIN terms USING (term)
        JOIN (SELECT term, count(*) AS df FROM (
                SELECT DISTINCT {key}, unnest({tokens_sql(field)}) AS term FROM {source}) GROUP BY term) f USING (term)
        CROSS JOIN (SELECT count(*) AS docs, avg(len(t)) AS mean_size FROM (
                SELECT {tokens_sql(field)} AS t FROM {source}) WHERE len(t) > 0) c
        GROUP BY query_id, {key}"""


_CTES["terms"] = (
    ["questions_v"],
    f"""SELECT query_id, term, count(*) AS weight FROM (
        SELECT query_id, unnest({tokens_sql("question")}) AS term FROM questions_v) GROUP BY ALL""",
)
_CTES["text_scores"] = (
    ["terms", "chunks_v"],
    f"""SELECT query_id, chunk_id, sum(score) AS score FROM (
        SELECT query_id, chunk_id, 5.0 * score AS score FROM ({bm25_sql("chunk_text")})
        UNION ALL SELECT query_id, chunk_id, 3.0 * score FROM ({bm25_sql("title")})) GROUP BY ALL""",
)
_CTES["text_hits"] = (
    ["text_scores", "chunks_v"],
    """SELECT t.*, c.* EXCLUDE (chunk_id, chunk_no, published_date) FROM (
        SELECT query_id, chunk_id, round(score, 6) AS score,
            row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank
        FROM text_scores QUALIFY rank <= 10) t JOIN chunks_v c USING (chunk_id)""",
)
_CTES["vector_hits"] = (
    ["index_v", "questions_v"],
    """SELECT q.query_id, i.chunk_id, round((1 + list_cosine_similarity(
            CAST(i.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2, 6) AS score,
        row_number() OVER (PARTITION BY q.query_id ORDER BY round((1 + list_cosine_similarity(
            CAST(i.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2, 6) DESC, i.chunk_id) AS rank
    FROM index_v i, questions_v q WHERE i.embedding IS NOT NULL AND q.embedding IS NOT NULL QUALIFY rank <= 10""",
)


def sql(select: str, *needs: str, **extra: str) -> str:
    """``select`` with the views it needs, and theirs, written before it."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in ordered:
            before, body = _CTES[name]
            for other in before:
                add(other)
            ordered[name] = body

    for name in needs:
        add(name)
    ordered.update(extra)
    views = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in ordered.items())
    return f"WITH {views}\n{select}" if ordered else select
