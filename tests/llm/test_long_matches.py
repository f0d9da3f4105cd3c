"""Texts with very many matches, and a text without common words."""

import time

from pyspark.sql import functions as F

from quarry.llm import divergence, secrets


def test_span_search_takes_time_in_proportion_to_the_matches(spark):
    key = "AKIA" + "B" * 16 + " "
    docs = spark.createDataFrame([(1, "x", "s", "en"), (2, "", "s", "en")], "doc_id long, text string, source string, lang string")
    began = time.monotonic()
    many = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit(key), 20_000)).otherwise(F.col("text")))
    scanned = {r["doc_id"]: r for r in secrets.scan(many).collect()}
    assert scanned[1]["n_access"] == 20_000 and scanned[1]["spans"].endswith(f"access:{21 * 19_999}:{21 * 19_999 + 20}")
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_documents(many).collect()}
    assert masked[1] == "[SECRET] " * 20_000 and masked[2] == ""
    assert time.monotonic() - began < 150


def test_repositories_decide_with_owners(spark):
    value = lambda c: f'password = "{c * 12}"'
    rows = [(i, value("a"), f"o{i}", "x") for i in range(3)]
    rows += [(10 + i, value("b"), f"o{i % 2}", f"r{i // 2}") for i in range(4)]
    rows += [(20 + i, value("c"), "o", f"r{i}") for i in range(6)] + [(30 + i, value("d"), f"o{i}", "x") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = {r["doc_id"]: (r["n_copied"], r["most_owners"], r["most_repositories"]) for r in secrets.scan(docs).collect()}
    assert found[0] == (1, 3, 3) and found[10] == (1, 2, 4) and found[20] == (0, 1, 6) and found[30] == (0, 2, 2)


def test_text_without_common_words_is_rejected_by_the_query_rule(spark):
    common = "the of and to in is it on as was for".split()
    words = lambda i: " ".join(f"{common[(i + j) % 11]} w{chr(97 + j % 26)}rdq{chr(97 + (i * j) % 26)}lm" for j in range(60))
    rows = [(i, words(i), "en") for i in range(120)] + [(999, " ".join(f"w{chr(97 + j % 26)}rdz{chr(97 + j * 7 % 26)}lm" for j in range(120)), "en")]
    verdict = {r["doc_id"]: r["_kept"] for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not verdict[999] and sum(verdict[i] for i in range(120)) >= 115


def test_language_of_five_rows_is_a_language(spark):
    import random

    from quarry.llm import language

    draw = random.Random(8)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}
    text = lambda lang: " ".join("".join(draw.choices(letters[lang], k=5)) for _ in range(60))
    rows = [(i, text(lang), lang, "s") for i, lang in enumerate(["aa"] * 60 + ["bb"] * 40 + ["cc"] * 5)] + [(999, text("cc"), None, "s")]
    found = {r["doc_id"]: (r["_language"], r["_kept"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i] == (lang, True) for i, _, lang, _ in rows[:-1]) and found[999] == ("cc", True)
