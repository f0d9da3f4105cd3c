"""Privacy, intents, URLs, dates, replies and HTML."""

import datetime
import time

from pyspark.sql import functions as F

from quarry.functions import dates, html, intents, privacy, replies, urls


def one(spark, column):
    return spark.range(1).select(column.alias("out")).first()["out"]


def redact(spark, value):
    row = spark.createDataFrame([(value,)], "v string")
    sanitized, n = privacy.redact_pii(F.col("v"))
    return tuple(row.select(sanitized, n).first())


def test_redact_literal_cases(spark):
    assert redact(spark, "viết cho ban.doc+1@bao.example.org nha") == ("viết cho [EMAIL] nha", 1)
    for written in ("0987001122", "0987 001 122", "0987.001.122"):
        assert redact(spark, f"số máy {written}, buổi tối")[0].startswith("số máy [PHONE]")
    assert redact(spark, "từ xa: +84987001122") == ("từ xa: +[PHONE]", 1)
    assert redact(spark, "thẻ cũ 204060801") == ("thẻ cũ [ID]", 1)
    assert "034056078090" not in redact(spark, "thẻ mới 034056078090")[0]
    assert redact(spark, "mã thuế 2468013579-002!") == ("mã thuế [TAX_ID]!", 1)
    assert redact(spark, "mã thuế 0246801357-002") == ("mã thuế [PHONE]002", 1)
    clean = "Năm 1999 có 12 chương và 340 điều."
    assert redact(spark, clean) == (clean, 0)
    assert redact(spark, "x@y.org; 0987001122; 204060801")[1] == 3
    # Letters with marks are word characters: no boundary, no match.
    assert redact(spark, "ổ204060801") == ("ổ204060801", 0)


def test_many_unclosed_elements_parse_fast():
    started = time.monotonic()
    assert html.visible_text("<ul>" + "<li>a" * 10_000) == " ".join(["a"] * 10_000)
    assert time.monotonic() - started < 1


def test_question_hash(spark):
    assert one(spark, privacy.cache_key(F.lit("hỏi"))).startswith("chat:")
    assert len(one(spark, privacy.question_hash(F.lit("hỏi")))) == 64


def test_smalltalk(spark):
    cases = {
        "Xin chào!": "greeting", "chào bạn": "greeting", "HEY...": "greeting", "  hi  ": "greeting",
        "bạn có thể giúp được gì?": "capabilities", "bạn là ai": "identity", "thanks you": "thanks",
        "Cám ơn": "thanks", "tạm biệt": "goodbye", "chào tạm biệt": "goodbye", "bye bye!": "goodbye",
        "hi đ": None, "ty ệ": None, "": None, "bạn làm gì để thừa kế": None, "xin chào, cho tôi hỏi": None,
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string")
    found = {r["q"]: r["i"] for r in rows.select("q", intents.smalltalk_intent(F.col("q")).alias("i")).collect()}
    assert found == cases
    assert one(spark, intents.smalltalk_reply(F.lit("bye"))) == "Tạm biệt! Chúc bạn một ngày tốt lành."


def test_urls(spark):
    assert one(spark, urls.doc_id_from_url(F.lit("https://x/y-z-123.html"))) == "123"
    assert one(spark, urls.doc_id_from_url(F.lit("https://x/y.html?p=1"))) == ""
    hub = "https://s.example.com/hoi-dap-phap-luat"
    assert one(spark, urls.category_from_url(F.lit(f"{hub}/thua-ke/?page=2#x"))) == "thua-ke"
    assert one(spark, urls.category_from_url(F.lit(f"{hub}/a-1.html"))) is None
    assert one(spark, urls.category_from_url(F.lit(f"{hub}/a/b"))) is None
    assert one(spark, urls.absolutize_url(F.lit("/a"), "https://s")) == "https://s/a"
    assert one(spark, urls.absolutize_url(F.lit("mailto:x"), "https://s")) is None
    assert one(spark, urls.is_article_link(F.lit("/hoi-dap-phap-luat/a-b-12.html")))
    assert not one(spark, urls.is_article_link(F.lit("/hoi-dap-phap-luat/x/a-12.html")))


def test_published_date(spark):
    def parse(meta, shown=""):
        return one(spark, dates.parse_published_date(F.lit(meta), F.lit(shown)))

    assert parse("2024-05-01T10:20:30+07:00") == "2024-05-01T10:20:30"
    assert parse("2024-05-01T10:20:30Z") == "2024-05-01T10:20:30"
    assert parse("2024-05-01T10:20:30") == "2024-05-01T10:20:30"
    assert parse("2024-05-01", "01/01/2020") == "2024-05-01T00:00:00"
    assert parse("soon", "10:05 | 31/12/2023") == "2023-12-31T10:05:00"
    for shown in ("31/12/2023", "31-12-2023", "2023-12-31", "2023/12/31"):
        assert parse("", shown) == "2023-12-31T00:00:00"
    assert parse("", "31/13/2023") == "" and parse("", "") == ""
    page = F.lit('<script>{"datePublished" : "2024-05-01"}</script>')
    assert one(spark, dates.published_in_metadata(page)) == "2024-05-01"


def test_crawled_partition(spark):
    fallback = F.lit(datetime.datetime(2031, 7, 1))

    def parts(value):
        year, month = dates.crawled_partition(F.lit(value).cast("string"), fallback)
        return tuple(spark.range(1).select(year, month).first())

    assert parts("2024-06-01T10:00:00Z") == (2024, 6)
    assert parts("2024-06-30T23:59:59.123456+07:00") == (2024, 6)
    assert parts("2024-06-30") == (2024, 6)
    for bad in ("https://x/y", "", None, "2024-13-01T00:00:00", "2024-06-31", "2024-06-01T25:00:00"):
        assert parts(bad) == (2031, 7)


def reply(spark, raw, hits=3):
    parsed = replies.parse_model_reply(F.lit(raw), F.lit(hits))
    row = spark.range(1).select(parsed.alias("r")).first()["r"]
    return row["answer"], row["used"]


def test_parse_model_reply(spark):
    assert reply(spark, '{"answer": "a", "used_sources": [0, 2]}') == ("a", [0, 2])
    assert reply(spark, '```json\n{"answer": "a", "used_sources": [1.9, "2", null, true]}\n```') == ("a", [1, 1])
    assert reply(spark, '  {"answer": "a"} ') == ("a", [])
    assert reply(spark, "no json") == ("no json", [0, 1, 2])
    assert reply(spark, "no json", 0) == ("no json", [])


def test_strip_outer_quotes(spark):
    def strip(value):
        return one(spark, replies.strip_outer_quotes(F.lit(value).cast("string"), F.lit("asked")))

    assert strip(' "a b" ') == "a b" and strip("'a'") == "a" and strip("\"a'") == "\"a'"
    assert strip("") == "asked" and strip(None) == "asked" and strip('" "') == "asked"


def test_article_blocks(spark):
    page = (
        '<h1>T <b>one</b></h1><p>outside</p><section id="news-content"><h2>H</h2><p>a<br>b &amp; c</p><p><img src=x></p>'
        "<ul><li>i<p>n</p></li></ul><blockquote>q</blockquote></section><h1>two</h1><p>after</p>"
    )
    found = one(spark, html.extract_article(F.lit(page)))
    assert found["title"] == "T one"
    assert found["blocks"] == ["H", "a b & c", "i n", "n", "q"]
    assert one(spark, html.extract_article(F.lit("<h1>x</h1>")))["blocks"] == []


def test_unclosed_paragraph_holds_what_follows(spark):
    found = one(spark, html.extract_article(F.lit("<article><p>a<p>b</p>c</article>"), "article", None))
    assert found["blocks"] == ["a b c", "b"]


def test_page_meta(spark):
    page = (
        '<div class="post-meta"><span class="author">Out</span></div><article><p class="author"> Ann \n Lee</p>'
        '<div class="tags"><a>t1</a><a> t2 </a></div><i class="ref-list">Law 1</i><i class="refs">Law 2</i>'
        '<b class="views">Views: 1,234</b><span class="small text-muted text-nowrap ms-auto">10:05 | 31/12/2023</span></article>'
    )
    meta = one(spark, html.extract_page_meta(F.lit(page)))
    assert (meta["author"], meta["legal_refs"], meta["tags"]) == ("Ann Lee", ["Law 1", "Law 2"], ["t1", "t2"])
    assert one(spark, html.view_count(F.lit(meta["views"]))) == 1234
    assert meta["shown_date"] == "10:05 | 31/12/2023"
    empty = one(spark, html.extract_page_meta(F.lit("<p>x</p>")))
    assert (empty["author"], empty["tags"], one(spark, html.view_count(F.lit(empty["views"])))) == ("", [], 0)
