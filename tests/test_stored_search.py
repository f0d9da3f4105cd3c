"""Search over stored postings against the search that reads the texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators.stored_search import stored_search
from quarry.schemas import INDEX
from quarry.sources import chunk_table, postings
from quarry.sources.manifest import read_manifest

FIELDS = ["chunk_text", "title"]


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**34, 5])
    content, starts = postings.varint(values)
    assert postings.numbers(content.tobytes()).tolist() == values.tolist()
    assert postings.numbers(content[starts[3] : starts[5]].tobytes()).tolist() == [128, 16383]
    assert postings.numbers(b"").tolist() == [] and len(postings.varint(values[:0])[0]) == 0


def test_impacts_hold_every_largest_score():
    draw = np.random.default_rng(1)
    for _ in range(50):
        tf, size = draw.integers(1, 9, 30), draw.integers(1, 60, 30)
        kept = postings._impacts(tf, size)
        for mean in (1, 10, 40):
            score = lambda t, s: t / (t + 1.2 * (0.25 + 0.75 * s / mean))
            assert max(score(t, s) for t, s in kept) == pytest.approx(score(tf, size).max())


def chunks(spark, seed, ids, words):
    draw = random.Random(seed)
    rows = []
    for i in ids:
        # Rare words lie in few windows.
        rare = [f"rare{i // 40}"] if draw.random() < 0.3 else []
        rows.append((f"c{i:05d}", str(i // 3), " ".join(draw.choices(words, k=draw.randint(0, 12)) + rare), draw.choice([*words, "", None])))
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_text string, title string")
    return frame.select(*[F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in INDEX.fields])


def hits(frame):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 4)) for r in frame.collect())


@pytest.fixture
def small_windows(monkeypatch):
    monkeypatch.setattr(postings, "WINDOW", 16)
    monkeypatch.setattr(postings, "PART", 8)


def test_same_hits_with_fewer_blocks(spark, folder, small_windows):
    words = ["đất", "nhà", "luật", "thuế", "xe", "phạt", "lao", "động"]
    for batch, ids in (("a", range(0, 400)), ("b", range(400, 700))):
        chunk_table.append_batch(chunks(spark, 1, ids, words).repartition(2), folder, batch, fields=FIELDS)
    questions = [(0, "rare3 nhà"), (1, "rare11 rare12"), (2, "luật thuế thuế"), (3, "nothing here"), (4, None), (5, "đất nhà luật thuế xe phạt")]
    queries = spark.createDataFrame(questions, "query_id long, question string")
    expected = hits(retrieval.bm25_search(chunk_table.read_index(spark, folder), queries, 5))
    decoded = spark.sparkContext.accumulator(0)
    assert hits(stored_search(spark, folder, queries, 5, decoded=decoded)) == expected
    assert hits(stored_search(spark, folder, queries, 5, limit=4)) == expected
    held = spark.read.schema(postings.SCHEMA).parquet(*[e.postings for e in read_manifest(spark, folder).of("chunks")])
    terms = retrieval.query_terms(queries).select("term").distinct()
    blocks = held.join(terms, "term").count()
    # Not all blocks of the asked terms are decoded, and far from all blocks of the index.
    decoded.value = 0
    rare = queries.where("query_id < 2")
    assert hits(stored_search(spark, folder, rare, 5, decoded=decoded)) == [h for h in expected if h[0] < 2]
    assert 0 < decoded.value < held.where("term in ('nha', 'rare3', 'rare11', 'rare12')").count() < blocks < held.count()


def test_hidden_chunks_take_no_part(spark, folder, small_windows):
    words = ["alpha", "beta", "gamma", "delta"]
    chunk_table.append_batch(chunks(spark, 2, range(300), words).repartition(2), folder, "a", fields=FIELDS)
    chunk_table.delete_docs(spark.range(0, 40).select(F.col("id").cast("string").alias("id")), folder, "gone")
    chunk_table.append_batch(chunks(spark, 3, range(250, 330), words), folder, "b", fields=FIELDS)
    queries = spark.createDataFrame([(0, "alpha rare2"), (1, "beta gamma rare6"), (2, "rare0")], "query_id long, question string")
    expected = hits(retrieval.bm25_search(chunk_table.read_index(spark, folder), queries, 7))
    assert hits(stored_search(spark, folder, queries, 7)) == expected
    chunk_table.compact(spark, folder, fields=FIELDS)
    assert hits(stored_search(spark, folder, queries, 7)) == expected
    chunk_table.append_batch(chunks(spark, 4, range(5), words), folder, "c")
    with pytest.raises(ValueError, match="without postings"):
        stored_search(spark, folder, queries)


def test_empty_index(spark, folder):
    queries = spark.createDataFrame([(0, "alpha")], "query_id long, question string")
    assert stored_search(spark, folder, queries).count() == 0
