"""Search, answering and evaluation over all questions and all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.documents import REDACTED_COUNT, REDACTED_TEXT
from catalog.fixtures import chunks_v, docs_v, index_v, labelled_v, questions_v, requests_v, scratch, sql, table, tokens_sql
from catalog.registry import Registry
from quarry.functions.replies import NO_CONTEXT, NO_INFO_REPLY
from quarry.operators import evaluate, graph_search, rag, retrieval
from quarry.operators.stored_search import stored_search
from quarry.plans import chat, evaluation
from quarry.sources.chunk_table import append_batch

registry = Registry()
QUERIES, SQL, entry = registry.queries, registry.sql, registry.entry

HIT = "query_id, chunk_id, score, rank"


def rounded(scores):
    return scores.withColumn("score", F.round("score", 6))


def text_hits(spark, folder, k=10):
    index = chunks_v(spark, folder)
    questions = questions_v(spark, folder)
    return retrieval.with_hit_fields(retrieval.bm25_search(index, questions, k), index, k * questions.count())


@entry("bm25_match", sql("SELECT query_id, chunk_id, round(score, 6) AS score FROM text_scores", "text_scores"))
def bm25_match(spark, folder):
    return rounded(retrieval.bm25_match(chunks_v(spark, folder), questions_v(spark, folder)))


@entry("topk_per_query", sql(f"SELECT {HIT} FROM text_hits", "text_hits"))
def topk_per_query(spark, folder):
    scores = retrieval.bm25_match(chunks_v(spark, folder), questions_v(spark, folder))
    return retrieval.topk_per_query(scores).select(*HIT.split(", "))


@entry("bm25_search", sql(f"SELECT {HIT} FROM text_hits", "text_hits"))
def bm25_search(spark, folder):
    return retrieval.bm25_search(chunks_v(spark, folder), questions_v(spark, folder)).select(*HIT.split(", "))


@entry("knn_cosine", sql(f"SELECT {HIT} FROM vector_hits", "vector_hits"))
def knn_cosine(spark, folder):
    return retrieval.knn_cosine(index_v(spark, folder), questions_v(spark, folder)).select(*HIT.split(", "))


# The mean vector of each label looks for the vectors nearest to it.
@entry(
    "knn_label_centres",
    """SELECT * FROM (SELECT c.label AS query_id, e.vec_id, round((1 + list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centre)) / 2, 6) AS score,
        row_number() OVER (PARTITION BY c.label ORDER BY round((1 + list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centre)) / 2, 6) DESC, e.vec_id) AS rank
    FROM embeddings e, (SELECT label, list(mean ORDER BY i) AS centre FROM (
        SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS mean
        FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label) c)
    WHERE rank <= 10""",
)
def knn_label_centres(spark, folder):
    vectors = table(spark, folder, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda p: p["mean"]).alias("embedding"))
    )
    return retrieval.knn_cosine(vectors, means, key="vec_id")


MERGED = """SELECT query_id, chunk_id, round(coalesce(t.score, 0) + 0.3 * coalesce(v.score, 0), 6) AS score
    FROM text_scores t
    FULL OUTER JOIN vector_hits v USING (query_id, chunk_id)"""
HYBRID = f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM ({MERGED}) QUALIFY rank <= 10"""


@entry("merge_text_and_vector", sql(MERGED, "text_scores", "vector_hits"))
def merge_text_and_vector(spark, folder):
    index, questions = index_v(spark, folder), questions_v(spark, folder)
    text, vector = retrieval.bm25_match(index, questions), retrieval.knn_cosine(index, questions)
    return rounded(retrieval.merge_text_and_vector(text, vector))


@entry("hybrid_search", sql(HYBRID, "text_scores", "vector_hits"))
def hybrid_search(spark, folder):
    return retrieval.hybrid_search(index_v(spark, folder), questions_v(spark, folder)).select(*HIT.split(", "))


@entry("embed_chunks")
def embed_chunks(spark, folder):
    embedded = retrieval.embed_chunks(chunks_v(spark, folder))
    return embedded.select("chunk_id", F.size("embedding").alias("size"))


@entry(
    "tfidf_rank",
    sql(
        f"""SELECT query_id, id, round(sum(weight * ln((n + 1) / (df + 1)) * tf), 6) AS score
        FROM (SELECT id, term, count(*) AS tf FROM postings GROUP BY ALL) p
        JOIN terms USING (term) JOIN (SELECT term, count(DISTINCT id) AS df FROM postings GROUP BY term) f USING (term)
        CROSS JOIN (SELECT count(*) AS n FROM docs_v) c GROUP BY query_id, id""",
        "terms",
        "docs_v",
        postings=f"SELECT id, unnest({tokens_sql('content')}) AS term FROM docs_v",
    ),
)
def tfidf_rank(spark, folder):
    return rounded(retrieval.tfidf_rank(docs_v(spark, folder), questions_v(spark, folder)))


# Unboosted thresholds never refuse on these texts; 150 refuses some of them.
THRESHOLD = 150.0


@entry(
    "threshold_gate",
    sql(
        f"""SELECT query_id, coalesce(max(score), 0) AS top_score, coalesce(max(score), 0) < {THRESHOLD} AS refused
        FROM questions_v q LEFT JOIN text_hits h USING (query_id) GROUP BY query_id""",
        "questions_v",
        "text_hits",
    ),
)
def threshold_gate(spark, folder):
    hits = retrieval.bm25_search(chunks_v(spark, folder), questions_v(spark, folder))
    return rag.threshold_gate(questions_v(spark, folder).select("query_id"), hits, THRESHOLD)


@entry(
    "build_context",
    sql(
        f"""SELECT query_id, 'Tài liệu tham khảo:' || chr(10) || coalesce(blocks, '{NO_CONTEXT}') || chr(10) || chr(10) || 'Câu hỏi: ' || question AS user_content
        FROM questions_v LEFT JOIN (SELECT query_id, string_agg('[' || (rank - 1) || '] ' || title || chr(10) || chunk_text,
            chr(10) || chr(10) ORDER BY rank) AS blocks FROM text_hits GROUP BY query_id) b USING (query_id)""",
        "questions_v",
        "text_hits",
    ),
)
def build_context(spark, folder):
    built = rag.build_context(questions_v(spark, folder).select("query_id", "question"), text_hits(spark, folder))
    return built.select("query_id", "user_content")


# Answers: long questions get a refusal, short ones cite nothing, others hits 4, 1, 4 and 40.
ANSWERS = f"""SELECT query_id, CASE WHEN length(question) > 300 THEN '{NO_INFO_REPLY}' ELSE question END AS answer,
    CASE WHEN length(question) < 200 THEN CAST([] AS INTEGER[]) ELSE [4, 1, 4, 40] END AS used FROM questions_v"""


def answers(spark, folder):
    length = F.length("question")
    return questions_v(spark, folder).select(
        "query_id",
        F.when(length > 300, NO_INFO_REPLY).otherwise(F.col("question")).alias("answer"),
        F.when(length < 200, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, (4, 1, 4, 40)))).alias("used"),
    )


@entry(
    "cite_sources",
    sql(
        """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position, title, url, doc_id FROM (
            SELECT w.query_id, place, title, url, doc_id FROM (
                SELECT query_id, unnest(range(0, len(u))) AS place, unnest(u) AS at FROM (
                    SELECT query_id, CASE WHEN len(used) = 0 THEN [0, 1, 2] ELSE used END AS u FROM answers
                    WHERE lower(answer) NOT LIKE '%không tìm thấy thông tin%')) w
            JOIN text_hits h ON h.query_id = w.query_id AND h.rank = w.at + 1
            QUALIFY row_number() OVER (PARTITION BY w.query_id, url ORDER BY place) = 1)""",
        "questions_v",
        "text_hits",
        answers=ANSWERS,
    ),
)
def cite_sources(spark, folder):
    return rag.cite_sources(answers(spark, folder), text_hits(spark, folder))


# Every request of the log asks a question: the path it takes.
@entry(
    "route_question",
    sql(
        f"""SELECT event_id, CASE WHEN path = 'smalltalk' THEN 'smalltalk' WHEN path = 'cache' THEN 'cache'
            WHEN latency_seconds < 0.2 THEN 'threshold_refused' WHEN path = 'no_info' THEN 'no_info' ELSE 'rag' END AS route
        FROM requests_v""",
        "requests_v",
    ),
)
def route_question(spark, folder):
    asked = requests_v(spark, folder)
    answer = F.when(F.col("path") == "no_info", NO_INFO_REPLY).otherwise("answer")
    route = rag.route_path(
        F.when(F.col("path") == "smalltalk", "greeting"),
        F.col("path") == "cache",
        F.col("latency_seconds") < 0.2,
        answer,
    )
    return asked.select("event_id", route.alias("route"))


# Gold set: a question expects the category and some words of a labelled document.
GOLD = """SELECT query_id AS id, question, ['src' || (query_id % 20), 'src3'] AS expected_categories,
    [substr(question, 1, 12), substr(question, 20, 6)] AS expected_keywords FROM questions_v"""


def gold_v(spark, folder):
    return questions_v(spark, folder).select(
        F.col("query_id").alias("id"), "question",
        F.array(F.concat(F.lit("src"), F.col("query_id") % 20), F.lit("src3")).alias("expected_categories"),
        F.array(F.substring("question", 1, 12), F.substring("question", 20, 6)).alias("expected_keywords"),
    )


@entry(
    "keyword_match",
    sql(
        """SELECT id, len(list_filter([substr(title, 3, 5), 'THATION'], lambda w: contains(lower(content), lower(w)))) > 0 AS words,
            category IN ('src1', 'src2') AND category <> '' AS in_category FROM docs_v""",
        "docs_v",
    ),
)
def keyword_match(spark, folder):
    words = F.array(F.substring("title", 3, 5), F.lit("THATION"))
    expected = F.array(F.lit("src1"), F.lit("src2"))
    return docs_v(spark, folder).select(
        "id",
        evaluate.keyword_match(F.col("content"), words).alias("words"),
        evaluate.category_match(F.col("category"), expected).alias("in_category"),
    )


@entry(
    "join_hits_to_gold",
    sql(
        "SELECT g.id, array_to_string(expected_keywords, ';') AS keywords, chunk_id, rank FROM gold g LEFT JOIN text_hits h ON h.query_id = g.id",
        "questions_v",
        "text_hits",
        gold=GOLD,
    ),
)
def join_hits_to_gold(spark, folder):
    joined = evaluate.join_hits_to_gold(gold_v(spark, folder), text_hits(spark, folder))
    return joined.select("id", F.array_join("expected_keywords", ";").alias("keywords"), "chunk_id", "rank")


SCORED = """SELECT id, coalesce(count(*) FILTER (WHERE hit) / nullif(count(chunk_id), 0), 0) AS precision,
        CAST(coalesce(bool_or(hit), false) AS DOUBLE) AS recall, coalesce(bool_or(in_category), false) AS category_hit,
        count(chunk_id) AS n
    FROM (SELECT g.id, chunk_id, list_contains(expected_categories, category) AS in_category,
            len(list_filter(expected_keywords, lambda w: contains(lower(title || ' ' || chunk_text || ' ' || url), lower(w)))) > 0 AS hit
        FROM gold g LEFT JOIN (SELECT * FROM text_hits WHERE rank <= 5) h ON h.query_id = g.id)
    GROUP BY id"""


@entry(
    "score_hits",
    sql("SELECT id, round(precision, 6) AS precision, recall, category_hit, n FROM scored", "questions_v", "text_hits", gold=GOLD, scored=SCORED),
)
def score_hits(spark, folder):
    scored = evaluation.evaluate(gold_v(spark, folder), chunks_v(spark, folder))
    return scored.withColumn("precision", F.round("precision", 6))


@entry(
    "eval_summary",
    sql(
        """SELECT count(*) AS queries, count(*) FILTER (WHERE n > 0) AS successful, round(avg(precision) FILTER (WHERE n > 0), 6) AS mean_precision,
            round(avg(recall) FILTER (WHERE n > 0), 6) AS mean_recall,
            round(avg(CAST(category_hit AS INTEGER)) FILTER (WHERE n > 0), 6) AS category_hit_rate FROM scored""",
        "questions_v",
        "text_hits",
        gold=GOLD,
        scored=SCORED,
    ),
)
def eval_summary(spark, folder):
    summary = evaluation.summarize(gold_v(spark, folder), chunks_v(spark, folder))
    return summary.withColumns({c: F.round(c, 6) for c in ("mean_precision", "mean_recall", "category_hit_rate")})


# Retrieval quality with labelled relevance: a hit counts when its document is good.
@entry(
    "relevant_hits",
    sql(
        """SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE quality = 1) AS relevant
        FROM text_hits LEFT JOIN labelled_v ON id = doc_id GROUP BY query_id""",
        "text_hits",
        "labelled_v",
    ),
)
def relevant_hits(spark, folder):
    judged = text_hits(spark, folder).join(labelled_v(spark, folder).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(F.col("quality") == 1).alias("relevant")
    )


@entry(
    "write_audit",
    f"""SELECT TIMESTAMP '2024-02-01 00:00:00' AS timestamp, sha256(text) AS question_hash, {REDACTED_TEXT} AS question_sanitized,
        CAST(length(text) AS INTEGER) AS answer_length, CAST(turn AS INTEGER) AS source_count, CAST(conv_id AS INTEGER) AS latency_ms,
        CAST({REDACTED_COUNT} AS INTEGER) AS pii_redactions, false AS cache_hit
    FROM conversations WHERE role = 'user'""",
)
def write_audit(spark, folder):
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    answered = turns.select(
        F.col("text").alias("question"), F.col("text").alias("answer"), F.col("turn").alias("source_count"),
        F.lit(False).alias("cache_hit"), "conv_id",
    )
    stamp = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    return chat.audit_records(answered, stamp, F.col("conv_id"))


@entry(
    "chat",
    sql(
        f"""SELECT query_id, CASE WHEN top < {THRESHOLD} THEN 'threshold_refused' WHEN length(question) > 300 THEN 'no_info' ELSE 'rag' END AS path,
            CASE WHEN top < {THRESHOLD} OR length(question) > 300 THEN '{NO_INFO_REPLY}' ELSE 'Re: ' || question END AS answer,
            CAST(CASE WHEN top < {THRESHOLD} OR length(question) > 300 THEN 0 ELSE urls END AS INTEGER) AS source_count
        FROM (SELECT query_id, trim(question, chr(10) || ' ') AS question FROM questions_v)
        JOIN (SELECT query_id, max(score) AS top, count(DISTINCT url) FILTER (WHERE rank <= 3) AS urls
            FROM hybrid JOIN chunks_v USING (chunk_id) GROUP BY query_id) h USING (query_id)""",
        "text_scores",
        "vector_hits",
        "questions_v",
        "chunks_v",
        hybrid=HYBRID,
    ),
)
def chat_table(spark, folder):
    """All questions answered in one job; the replies name no sources."""
    questions = questions_v(spark, folder)
    asked, hits = chat.prepare(questions, index_v(spark, folder), THRESHOLD)
    text = F.trim(F.regexp_replace("question", r"^\s+|\s+$", ""))
    reply = F.when(F.length(text) > 300, NO_INFO_REPLY).otherwise(F.concat(F.lit("Re: "), text))
    raw = F.to_json(F.struct(reply.alias("answer"), F.array().cast("array<int>").alias("used_sources")))
    replies = questions.select("query_id", raw.alias("raw"))
    cached = questions.limit(0).selectExpr(
        "query_id", "false cache_hit", "question cached_answer", "0 cached_sources"
    )
    return chat.answer(asked, hits, replies, cached).select("query_id", "path", "answer", "source_count")


# The chunks are written in two batches with their postings, and searched by these.
@entry("bm25_stored", sql(f"SELECT {HIT} FROM text_hits", "text_hits"))
def bm25_stored(spark, folder):
    root = scratch(spark)
    chunks = chunks_v(spark, folder).withColumn("embedding", F.lit(None).cast("array<float>"))
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2))
    for part in (0, 1):
        append_batch(chunks.where(half == part), root, f"part-{part}", fields=["chunk_text", "title"])
    return stored_search(spark, root, questions_v(spark, folder)).select(*HIT.split(", "))


# Stored graphs are asked with every fiftieth vector: nine tenths of the exact hits are found.
@entry(
    "knn_graph",
    """SELECT count(*) AS questions, 10 * count(*) AS hits, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0""",
)
def knn_graph(spark, folder):
    vectors = table(spark, folder, "embeddings")
    root = scratch(spark)
    graph_search.build_graphs(vectors, "vec_id").write.parquet(root)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = graph_search.graph_search(spark.read.parquet(root), asked, key="vec_id")
    exact = retrieval.knn_cosine(vectors, asked, key="vec_id").select("query_id", "vec_id", F.lit(1).alias("exact"))
    both = found.join(exact, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("questions"), F.count(F.lit(1)).alias("hits"), (F.count("exact") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))
