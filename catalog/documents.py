"""Projections, text functions, links and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import docs_v, links_v, packed_sql, sql, table, tokens_sql
from catalog.registry import Registry
from quarry.functions import dates, html, intents, privacy, replies, text, urls
from quarry.operators import listing, normalize
from quarry.plans.batch import document_chunks
from quarry.schemas import RAW_FIELDS
from quarry.session import spread
from quarry.sources import topic

registry = Registry()
QUERIES, SQL, entry = registry.queries, registry.sql, registry.entry


# Question/answer records: German ones have no title, English ones no content.
QA = """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'de' THEN '' ELSE substr(text, 1, 60) END AS title,
    substr(text, 1, 30) AS question, CASE WHEN lang = 'en' THEN NULL ELSE text END AS content, text AS answer,
    source AS category, '' AS agency, lang AS author FROM documents"""


@entry(
    "normalize_record",
    sql(
        """SELECT id, coalesce(nullif(title, ''), question) AS title, coalesce(nullif(content, ''), answer) AS content,
            category, '' AS doc_type, '' AS doc_number, coalesce(nullif(agency, ''), author) AS agency,
            '' AS published_date, '' AS url, '2024-02-01T00:00:00+00:00' AS crawled_at FROM qa""",
        qa=QA,
    ),
)
def normalize_record(spark, folder):
    records = table(spark, folder, "documents").selectExpr(
        "cast(doc_id as string) id",
        "if(lang = 'de', '', substr(text, 1, 60)) title",
        "substr(text, 1, 30) question",
        "if(lang = 'en', null, text) content",
        "text answer", "source category", "'' agency", "lang author",
    )
    return normalize.normalize_record(records, F.lit("2024-02-01T00:00:00+00:00"))


@entry(
    "drop_blank_records",
    """SELECT CASE WHEN lang IN ('de', 'fr') THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id,
        CASE WHEN lang IN ('de', 'en') THEN NULL ELSE source END AS title, doc_id
    FROM documents WHERE lang <> 'de'""",
)
def drop_blank_records(spark, folder):
    records = table(spark, folder, "documents").selectExpr(
        "if(lang in ('de', 'fr'), '', cast(doc_id as string)) id",
        "if(lang in ('de', 'en'), null, source) title",
        "doc_id",
    )
    return normalize.drop_blank_records(records)


@entry(
    "align_schema",
    sql(
        """SELECT id, title, content, NULL AS category, NULL AS doc_type, NULL AS doc_number, NULL AS agency,
            published_date, url, crawled_at FROM docs_v""",
        "docs_v",
    ),
)
def align_schema(spark, folder):
    partial = docs_v(spark, folder).drop("category", "doc_type", "doc_number", "agency").withColumn("extra", F.lit(1))
    return normalize.align_schema(partial)


@entry(
    "item_to_document",
    sql(
        """SELECT id, title, content, category, '' AS doc_type, '' AS doc_number, doc_type AS agency, published_date, url,
            '2024-02-01T00:00:00+00:00' AS crawled_at FROM docs_v""",
        "docs_v",
    ),
)
def item_to_document(spark, folder):
    items = docs_v(spark, folder).selectExpr(
        "id", "title question", "content answer", "category", "doc_type author", "published_date", "url"
    )
    return normalize.item_to_document(items, F.lit("2024-02-01T00:00:00+00:00"))


@entry(
    "index_projection",
    sql(
        "SELECT doc_id, chunk_no, chunk_text, title, url, category, doc_type, agency, published_date FROM chunks",
        "chunks",
    ),
)
def index_projection(spark, folder):
    cleaned = spread(docs_v(spark, folder)).withColumn("clean_text", text.clean_text(F.col("content")))
    return normalize.index_projection(text.explode_chunks(cleaned))


# Spanish documents have no date, French ones an address in its place.
UNDATED = """SELECT id, category, CASE doc_type WHEN 'es' THEN '' WHEN 'fr' THEN url ELSE published_date END AS published_date
    FROM docs_v"""


def undated(spark, folder):
    return docs_v(spark, folder).selectExpr(
        "id", "category", "case doc_type when 'es' then '' when 'fr' then url else published_date end published_date"
    )


@entry(
    "valid_published_filter",
    sql("SELECT * FROM undated WHERE regexp_matches(published_date, '^\\d{4}-\\d{2}-\\d{2}')", "docs_v", undated=UNDATED),
)
def valid_published_filter(spark, folder):
    return normalize.valid_published(undated(spark, folder))


@entry(
    "valid_published_counts",
    sql(
        """SELECT category, count(*) FILTER (WHERE regexp_matches(published_date, '^\\d{4}-\\d{2}-\\d{2}')) AS kept,
            count(*) FILTER (WHERE NOT regexp_matches(published_date, '^\\d{4}-\\d{2}-\\d{2}')) AS skipped
        FROM undated GROUP BY category""",
        "docs_v",
        undated=UNDATED,
    ),
)
def valid_published_counts(spark, folder):
    return normalize.published_counts(undated(spark, folder))


# Links written to the hub: articles for one kind of page, listings for others.
HUB_LINKS = r"""SELECT page_id, CASE WHEN url LIKE 'https%' THEN '/hoi-dap-phap-luat/bai-viet-' || page_id || '.html'
    WHEN url LIKE '%html' THEN url ELSE url || '/hoi-dap-phap-luat/chu-de-' || page_id END AS href FROM pages"""


def hub_links(spark, folder):
    return table(spark, folder, "pages").selectExpr(
        "page_id",
        "case when url like 'https%' then concat('/hoi-dap-phap-luat/bai-viet-', page_id, '.html')"
        " when url like '%html' then url else concat(url, '/hoi-dap-phap-luat/chu-de-', page_id) end href",
    )


@entry(
    "article_link_filter",
    sql("SELECT * FROM hub WHERE regexp_matches(href, '/hoi-dap-phap-luat/[^/]+-\\d+\\.html$')", hub=HUB_LINKS),
)
def article_link_filter(spark, folder):
    return hub_links(spark, folder).filter(urls.is_article_link(F.col("href")))


@entry(
    "clean_text",
    sql("SELECT id, clean AS text FROM cleaned", "cleaned"),
)
def clean_text(spark, folder):
    return spread(docs_v(spark, folder)).select("id", text.clean_text(F.col("content")).alias("text"))


VISIBLE = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
        '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages"""


@entry("clean_page_text", VISIBLE)
def clean_page_text(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", text.clean_text(F.col("html")).alias("text"))


@entry(
    "split_sentences",
    sql(
        """SELECT id, CAST(unnest(range(0, len(s))) AS INTEGER) AS position, unnest(s) AS sentence FROM (
            SELECT id, list_filter(list_transform(string_split_regex(
                regexp_replace(content, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)),
                lambda x: x <> '') AS s FROM docs_v)""",
        "docs_v",
    ),
)
def split_sentences(spark, folder):
    split = text.split_sentences(F.col("content"))
    return spread(docs_v(spark, folder)).select("id", F.posexplode(split).alias("position", "sentence"))


def _chunk_entry(name: str, max_length: int, overlap: int) -> None:
    statement = sql(
        "SELECT id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk_text FROM repacked",
        "sentences",
        repacked=packed_sql("sentences", max_length, overlap),
    )

    @entry(name, statement)
    def run(spark, folder):
        cleaned = spread(docs_v(spark, folder)).select("id", text.clean_text(F.col("content")).alias("clean_text"))
        return text.explode_chunks(cleaned, "clean_text", max_length, overlap).drop("clean_text")


_chunk_entry("chunk_text", 1000, 100)
_chunk_entry("chunk_text_small", 200, 30)
_chunk_entry("chunk_text_no_overlap", 300, 0)


@entry(
    "explode_chunks",
    sql(
        """SELECT doc_id, count(*) AS chunks, CAST(min(chunk_no) AS INTEGER) AS first_no,
            CAST(max(chunk_no) AS INTEGER) AS last_no, CAST(sum(length(chunk_text)) AS BIGINT) AS characters
        FROM chunks GROUP BY doc_id""",
        "chunks",
    ),
)
def explode_chunks(spark, folder):
    return (
        document_chunks(spread(docs_v(spark, folder)))
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.min("chunk_no").alias("first_no"),
            F.max("chunk_no").alias("last_no"),
            F.sum(F.length("chunk_text")).alias("characters"),
        )
    )


@entry("chunk_id", sql("SELECT doc_id, chunk_no, chunk_id FROM chunks", "chunks"))
def chunk_id(spark, folder):
    return document_chunks(spread(docs_v(spark, folder))).select("doc_id", "chunk_no", "chunk_id")


@entry(
    "fold_tokens",
    sql(f"SELECT id, array_to_string({tokens_sql('content')}, ' ') AS tokens FROM docs_v", "docs_v"),
)
def fold_tokens(spark, folder):
    return spread(docs_v(spark, folder)).select("id", F.array_join(text.fold_tokens(F.col("content")), " ").alias("tokens"))


@entry(
    "normalize_lines",
    sql(
        """SELECT id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)),
            lambda x: x <> ''), ' ') AS text FROM docs_v""",
        "docs_v",
    ),
)
def normalize_lines(spark, folder):
    return spread(docs_v(spark, folder)).select("id", text.normalize_lines(F.col("content")).alias("text"))


@entry(
    "extract_article_title",
    r"""SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'),
        '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""",
)
def extract_article_title(spark, folder):
    found = html.extract_article(F.col("html"), "article", None)
    return spread(table(spark, folder, "pages")).select("page_id", found["title"].alias("title"))


@entry("extract_article")
def extract_article(spark, folder):
    pages = spread(table(spark, folder, "pages")).withColumn("found", html.extract_article(F.col("html"), "article", None))
    return pages.select("page_id", "url", "found.title", F.array_join("found.blocks", "\n\n").alias("content"))


@entry("extract_page_meta")
def extract_page_meta(spark, folder):
    pages = spread(table(spark, folder, "pages")).withColumn("meta", html.extract_page_meta(F.col("html")))
    published = dates.parse_published_date(dates.published_in_metadata(F.col("html")), F.col("meta.shown_date"))
    return pages.select(
        "page_id", "meta.author", urls.join_list(F.col("meta.legal_refs")).alias("legal_refs"),
        urls.join_list(F.col("meta.tags")).alias("tags"), html.view_count(F.col("meta.views")).alias("views"),
        published.alias("published_date"),
    )


REDACTED = {}
_text = "text"
for _name, _pattern in privacy.PATTERNS:
    _label = _name.strip("[]")
    REDACTED[_label] = (f"len(regexp_extract_all({_text}, '{_pattern}'))", f"regexp_replace({_text}, '{_pattern}', '[{_label}]', 'g')")
    _text = REDACTED[_label][1]
REDACTED_TEXT = _text
REDACTED_COUNT = " + ".join(count for count, _ in REDACTED.values())


@entry(
    "redact_pii",
    f"SELECT doc_id, {REDACTED_TEXT} AS sanitized, CAST({REDACTED_COUNT} AS INTEGER) AS redactions FROM documents",
)
def redact_pii(spark, folder):
    sanitized, redactions = privacy.redact_pii(F.col("text"))
    return spread(table(spark, folder, "documents")).select(
        "doc_id", sanitized.alias("sanitized"), redactions.alias("redactions")
    )


@entry(
    "question_hash",
    "SELECT conv_id, turn, sha256(text) AS question_hash, 'chat:' || sha256(text) AS cache_key FROM conversations",
)
def question_hash(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", privacy.question_hash(F.col("text")).alias("question_hash"),
        privacy.cache_key(F.col("text")).alias("cache_key"),
    )


# Phrases taken by the number in the event, besides the event's own words.
PHRASES = [
    "Xin chào!", "chào bạn", "HELLO", "Bạn có thể giúp được gì nhiều?", "chức năng của bạn", "bạn là ai???", "Cảm ơn",
    "thanks you", "TY", "tạm biệt...", "bye bye", "Goodbye !", "hi đ", "ty ệ", "xin chào, tôi muốn hỏi về thừa kế", "bạn làm gì để thừa kế",
]
_PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_INTENT_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(trim(q), '(?i)^({pattern})[^\\p{{L}}\\p{{N}}_]*$') THEN '{name}'"
    for name, pattern in intents.PATTERNS.items()
) + " END"
SAID = f"""SELECT event_id, CASE WHEN event_type = 'signup' THEN event_type || ' ' || value
    ELSE {_PHRASE_SQL}[CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(PHRASES)} + 1] END AS q FROM events"""


def said(spark, folder):
    phrase = F.element_at(
        F.array(*map(F.lit, PHRASES)), F.get_json_object("props", "$.k").cast("int") % len(PHRASES) + 1
    )
    own = F.concat_ws(" ", "event_type", F.col("value").cast("string"))
    question = F.when(F.col("event_type") == "signup", own).otherwise(phrase)
    return table(spark, folder, "events").select("event_id", question.alias("q"))


@entry(
    "smalltalk_intent",
    sql(
        f"""SELECT event_id, intent, CASE intent {' '.join(f"WHEN '{n}' THEN '{r}'" for n, r in intents.REPLIES.items())} END AS reply
        FROM (SELECT event_id, {_INTENT_SQL} AS intent FROM said)""",
        said=SAID,
    ),
)
def smalltalk_intent(spark, folder):
    question = F.col("q")
    return said(spark, folder).select(
        "event_id", intents.smalltalk_intent(question).alias("intent"), intents.smalltalk_reply(question).alias("reply")
    )


@entry(
    "doc_id_from_url",
    sql("SELECT url, regexp_extract(url, '-(\\d+)\\.html$', 1) AS doc_id FROM docs_v", "docs_v"),
)
def doc_id_from_url(spark, folder):
    return docs_v(spark, folder).select("url", urls.doc_id_from_url(F.col("url")).alias("doc_id"))


LANGS = "(?:de|en|es|fr)"
_SLUG_SQL = rf"""nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''),
    '^https?://[^/]+/{LANGS}/([^/]+)$', 1), '')"""
CATEGORY_SQL = f"CASE WHEN {_SLUG_SQL} NOT LIKE '%.html' THEN {_SLUG_SQL} END"


@entry("category_from_url", f"SELECT page_id, {CATEGORY_SQL} AS category FROM pages")
def category_from_url(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.category_from_url(F.col("url"), LANGS).alias("category"))


@entry("sorted_categories", f"SELECT DISTINCT {CATEGORY_SQL} AS category FROM pages WHERE {CATEGORY_SQL} IS NOT NULL")
def sorted_categories(spark, folder):
    return listing.sorted_categories(table(spark, folder, "pages"), F.col("url"), hub=LANGS)


ABSOLUTE = "CASE WHEN href LIKE '/%' THEN site || href WHEN href LIKE 'http%' THEN href END"


@entry("absolutize_url", sql(f"SELECT page_id, position, {ABSOLUTE} AS url FROM links_v", "links_v"))
def absolutize_url(spark, folder):
    return links_v(spark, folder).select(
        "page_id", F.col("position").cast("long").alias("position"),
        urls.absolutize_url(F.col("href"), F.col("site")).alias("url"),
    )


LINKS = f"SELECT page_id, position, {ABSOLUTE} AS link FROM links_v"


def absolute_links(spark, folder):
    return absolutize_url(spark, folder).withColumnRenamed("url", "link").filter("link is not null")


_FIRST_SQL = """SELECT link, page_id, position FROM links WHERE link IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, position) = 1"""


@entry("first_occurrence", sql(_FIRST_SQL, "links_v", links=LINKS))
def first_occurrence(spark, folder):
    return listing.first_occurrence(absolute_links(spark, folder), "link", ["page_id", "position"])


@entry("limit_links", sql(f"SELECT * FROM ({_FIRST_SQL}) ORDER BY page_id, position LIMIT 50", "links_v", links=LINKS))
def limit_links(spark, folder):
    return listing.limit_links(absolute_links(spark, folder), "link", ["page_id", "position"], 50)


# Dates of orders written in each accepted form; one priority has no date.
_WRITTEN = {
    "1-URGENT": ("%Y-%m-%dT%H:%M:%S+0700", "yyyy-MM-dd'T'HH:mm:ss'+0700'", "meta", "%Y-%m-%dT%H:%M:%S"),
    "2-HIGH": ("%H:%M | %d/%m/%Y", "HH:mm | dd/MM/yyyy", "shown", "%Y-%m-%dT%H:%M:00"),
    "3-MEDIUM": ("%d-%m-%Y", "dd-MM-yyyy", "shown", "%Y-%m-%dT00:00:00"),
    "4-NOT SPECIFIED": ("no date", "'no date'", "shown", ""),
    "5-LOW": ("%Y/%m/%d", "yyyy/MM/dd", "shown", "%Y-%m-%dT00:00:00"),
}


def _published_sql() -> str:
    cases = " ".join(
        f"WHEN '{p}' THEN {f'''strftime(o_orderdate, '{out}')''' if out else repr('')}" for p, (_, _, _, out) in _WRITTEN.items()
    )
    return f"SELECT o_orderkey, CASE o_orderpriority {cases} ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS published_date FROM orders"


@entry("parse_published_date", _published_sql())
def parse_published_date(spark, folder):
    orders = table(spark, folder, "orders")
    meta, shown = F.lit(""), F.date_format("o_orderdate", "dd/MM/yyyy")
    for priority, (_, pattern, place, _) in _WRITTEN.items():
        written = F.date_format("o_orderdate", pattern)
        here = F.col("o_orderpriority") == priority
        if place == "meta":
            meta = F.when(here, F.concat(F.lit('{"datePublished" : "'), written, F.lit('"}'))).otherwise(meta)
        else:
            shown = F.when(here, written).otherwise(shown)
    published = dates.parse_published_date(dates.published_in_metadata(meta), shown)
    return orders.select("o_orderkey", published.alias("published_date"))


@entry(
    "crawled_partition",
    """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 2025 ELSE year(o_orderdate) END AS INTEGER) AS year,
        CAST(CASE o_orderstatus WHEN 'P' THEN 1 ELSE month(o_orderdate) END AS INTEGER) AS month FROM orders""",
)
def crawled_partition(spark, folder):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    crawled = (
        F.when(F.col("o_orderstatus") == "F", F.concat(stamp, F.lit("Z")))
        .when(F.col("o_orderstatus") == "O", F.concat(stamp, F.lit(".123456+07:00")))
        .otherwise(F.concat(F.lit("https://docs.example.com/"), stamp))
    )
    year, month = dates.crawled_partition(crawled, F.lit("2025-01-31 12:00:00").cast("timestamp"))
    return table(spark, folder, "orders").select("o_orderkey", year.alias("year"), month.alias("month"))


@entry("join_list_fields", "SELECT doc_id, lang || ';' || source AS tags FROM documents")
def join_list_fields(spark, folder):
    return table(spark, folder, "documents").select("doc_id", urls.join_list(F.array("lang", "source")).alias("tags"))


# Replies of three kinds: fenced JSON, bare JSON and free text.
@entry(
    "parse_model_reply",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN '0;1;2' WHEN 'user' THEN '' ELSE '0;2' END AS used, text AS answer
    FROM conversations""",
)
def parse_model_reply(spark, folder):
    turns = table(spark, folder, "conversations")
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1)
    body = F.concat(F.lit('{"answer": '), quoted, F.lit(', "used_sources": [0, "1", 2.0, null]}'))
    bare = F.concat(F.lit('  {"answer": '), quoted, F.lit("}\n"))
    raw = (
        F.when(F.col("role") == "system", F.col("text"))
        .when(F.col("role") == "user", bare)
        .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    )
    parsed = turns.withColumn("reply", replies.parse_model_reply(raw, F.lit(3)))
    return parsed.select("conv_id", "turn", F.array_join("reply.used", ";").alias("used"), "reply.answer")


@entry(
    "strip_outer_quotes",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'asked' WHEN 'user' THEN trim(text, chr(10) || ' ')
        ELSE trim(text, chr(10) || ' ') END AS query FROM conversations""",
)
def strip_outer_quotes(spark, folder):
    rewritten = (
        F.when(F.col("role") == "system", F.lit(' "" '))
        .when(F.col("role") == "user", F.concat(F.lit('"'), F.col("text"), F.lit('"\n')))
        .otherwise(F.concat(F.lit(" '"), F.col("text"), F.lit("'")))
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", replies.strip_outer_quotes(rewritten, F.lit("asked")).alias("query")
    )


@entry(
    "publish_topic",
    sql(
        f"SELECT id AS key, CAST(to_json(struct_pack({', '.join(f'{f} := {f}' for f in RAW_FIELDS)})) AS VARCHAR) AS value FROM docs_v",
        "docs_v",
    ),
)
def publish_topic(spark, folder):
    return topic.to_records(docs_v(spark, folder)).select(F.col("key").cast("string"), F.col("value").cast("string"))


@entry(
    "parse_topic",
    sql(f"SELECT {', '.join(RAW_FIELDS)} FROM docs_v", "docs_v"),
)
def parse_topic(spark, folder):
    return topic.from_records(topic.to_records(docs_v(spark, folder)))
