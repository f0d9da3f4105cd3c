"""Cleaning, splitting, chunking and folding."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text


def apply(spark, function, values, *more):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", function(F.col("v"), *more).alias("out")).orderBy("i").collect()]


def test_clean_text_literal_cases(spark):
    given = [
        "<p>A    B\n\n\nC</p>", "", None, "<b>Điều 1.</b><i>Nhà nước</i>", "Vie\u0302\u0323t", "Việt",
        "a&amp;b &copy; &&& x", "<script>var x = '</p>';</script><style>p{}</style>k<!-- no -->ept",
        "x\u00a0\u2003y\x1cz", "AT&T &unknown; 1 < 2",
    ]
    assert apply(spark, text.clean_text, given) == [
        "A B C", "", "", "Điều 1. Nhà nước", "Việt", "Việt", "a&b © &&& x", "k ept", "x y z", "AT&T &unknown 1 < 2",
    ]


def test_clean_text_uses_arrow_for_markup_only(spark):
    plan = spark.range(1).select(text.clean_text(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan


def test_split_sentences(spark):
    given = ["One. Two! Three?  Four\n\n five ", "  a.b c\n", "", "x.\n\n\ty"]
    assert apply(spark, text.split_sentences, given) == [
        ["One.", "Two!", "Three?", "Four", "five"], ["a.b c"], [], ["x.", "y"],
    ]


def test_chunk_text_short_and_long(spark):
    assert apply(spark, text.chunk_text, ["Một dòng.", "", None]) == [["Một dòng."], [], []]
    numbered = "".join(f"{i:05d}" for i in range(600))
    windows = apply(spark, text.chunk_text, [numbered])[0]
    # A sentence over the limit: windows of the limit, each 900 characters after the one before.
    assert [numbered.index(w) for w in windows] == [0, 900, 1800, 2700] and windows[-1] == numbered[2700:]


@pytest.mark.parametrize("limit,overlap", [(1000, 100), (80, 10), (60, 0), (45, 29)])
def test_chunk_borders(spark, limit, overlap):
    """Without carried tails the chunks are the sentences in order, and no chunk had room for one more."""
    draw = random.Random(limit)
    words = ["đất", "law", "a", "house.", "why?", "end!", "x" * 20, "\n", "một", "ok.\n\n"]
    values = [v for v in (" ".join(draw.choices(words, k=draw.randint(1, 120))) for _ in range(150)) if len(v) >= 50]
    cut = apply(spark, text.split_sentences, values)
    for sentences, parts in zip(cut, apply(spark, text.chunk_text, values, limit, overlap), strict=True):
        if max(map(len, sentences)) > limit:
            continue
        at, before = 0, ""
        for part in parts:
            carried = before[-overlap:] + " " if before and overlap else ""
            assert part.startswith(carried)
            body, first = part[len(carried) :], at
            while at < len(sentences) and len(" ".join(sentences[first:at])) < len(body):
                at += 1
            assert " ".join(sentences[first:at]) == body and at > first
            if at < len(sentences):
                # An empty tail still counts with its blank.
                assert len(part) + 1 + len(sentences[at]) + (0 if overlap else 1) > limit
            before = part
        assert at == len(sentences)


def test_chunk_text_bound_and_coverage(spark):
    draw = random.Random(7)
    values = [". ".join("w" * draw.randint(1, 90) for _ in range(60)) for _ in range(50)]
    for value, parts in zip(values, apply(spark, text.chunk_text, values, 200, 30)):
        assert max(map(len, parts)) <= 231
        assert all(s in " ".join(parts) for s in value.split(". "))


def test_chunk_text_stays_in_the_jvm(spark):
    plan = spark.range(1).select(text.chunk_text(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_chunk_id(spark):
    rows = spark.createDataFrame([("7", "abc"), ("", "abc"), (None, "abc")], "d string, c string")
    out = [r[0] for r in rows.select(text.chunk_id(F.col("d"), F.col("c"))).collect()]
    assert out == ["7_a784c91635ba", "", ""]


def test_fold_tokens(spark):
    given = ["Điều 1: Nhà-nước Ｗide ĂÂ", "e\u0301te\u0301 Straße Œuvre", "", None]
    assert apply(spark, text.fold_tokens, given) == [
        ["dieu", "1", "nha", "nuoc", "wide", "aa"], ["ete", "strasse", "oeuvre"], [], [],
    ]


def test_normalize_lines(spark):
    assert apply(spark, text.normalize_lines, ["  a \n\n b\r\nc ", "", None]) == ["a b c", "", ""]


@pytest.mark.parametrize("overlap", [0, 30])
def test_chunks_of_a_very_long_text(spark, overlap, monkeypatch):
    """Pieces of any size give the same chunks; 5 MB take time in proportion."""
    content = " ".join(f"Câu số {i} nói về luật số {i % 97}." + (" x" * 150 if i % 50 == 0 else "") for i in range(2_000))
    frame = spark.createDataFrame([(content,)], "t string")
    in_pieces = frame.select(text.chunk_text(F.col("t"), 200, overlap)).first()[0]
    monkeypatch.setattr(text, "PIECE", 10**6)
    assert in_pieces == frame.select(text.chunk_text(F.col("t"), 200, overlap)).first()[0] and len(in_pieces) > 300
    monkeypatch.undo()
    began = time.monotonic()
    long = frame.select(F.repeat(F.concat("t", F.lit(" ")), 60).alias("t"))
    assert long.select(F.size(text.chunk_text(F.col("t"), 200, overlap))).first()[0] > 18_000
    assert time.monotonic() - began < 60
