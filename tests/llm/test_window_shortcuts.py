"""Measures that skip what cannot count: texts without repeated windows, words longer than the asked ones."""

from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import divergence

TEXTS = ["", "a", "a b", "a b c", "a b c a b c", "a b c d e f", "x a b c y a b c", "a a a a", "lange Wörter und und der der der", "é ü der é ü der é"]


def covered(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def test_repeated_words_with_and_without_repeats(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("w", F.split("text", " "))
    found = rows.select("text", divergence.repeated_words(F.col("w")).alias("n"))
    assert {r["text"]: r["n"] for r in found.collect()} == {t: covered(t.split(" ")) for t in TEXTS}
    # Windows are sorted only where their hashes repeat.
    assert "array_distinct" in found._jdf.queryExecution().analyzed().toString()


def test_occurrences_of_asked_words(spark):
    asked = ["der", "und", "é"]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("w", F.split("text", " "))
    rows = rows.withColumn("asked", F.when(F.col("text") != "a", F.array(*map(F.lit, asked))))
    found = rows.select("text", divergence.occurrences(F.col("w"), F.col("asked")).alias("n"))
    assert {r["text"]: r["n"] for r in found.collect()} == {t: None if t == "a" else [float(t.split(" ").count(w)) for w in asked] for t in TEXTS}
    assert "array_max" in found._jdf.queryExecution().analyzed().toString()
