"""Steps whose shuffles, passes or state calls would grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from catalog.indexing import streamed_docs
from quarry.functions import html
from quarry.operators import retrieval
from quarry.operators.index import last_per_key
from quarry.operators.stored_search import _postings, stored_search
from quarry.plans.batch import distinct_chunks, document_chunks
from quarry.schemas import INDEX, RAW_FIELDS
from quarry.sources import chunk_table
from quarry.sources.manifest import read_manifest
from quarry.streaming import answer_cache


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def texts(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, chunk_text string, title string")


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def test_scores_of_all_rows_move_none(spark):
    index = texts(spark, [("a", "x y", "x"), ("b", "y z", None), ("c", "w", "")])
    scores = retrieval.bm25_match(index, asked(spark, "x y", "y"))
    assert "Exchange" not in plan(scores)
    assert sorted((r["query_id"], r["chunk_id"]) for r in scores.collect()) == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]


def test_a_repeated_or_null_key_is_one_row(spark):
    # Rows of one key and length count as one document with the sum of their frequencies.
    index = texts(spark, [("a", "x y", ""), ("a", "x z", ""), (None, "x x", ""), (None, "y y", ""), ("b", "x", ""), ("c", "w w w", "")])
    found = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25_match(index, asked(spark, "x", "y"), {"chunk_text": 1.0}).collect()}
    mean = (2 + 2 + 1 + 3) / 4

    def part(tf, size, df):
        return float(retrieval.np.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * size / mean)))

    expected = {(0, "a"): part(2, 2, 3), (0, None): part(2, 2, 3), (0, "b"): part(1, 1, 3), (1, "a"): part(1, 2, 2), (1, None): part(2, 2, 2)}
    assert found == pytest.approx(expected)


def test_blocks_of_questions_and_null_ids(spark):
    index = texts(spark, [(f"c{i}", f"x{i % 3} y{i % 5}", "z") for i in range(30)])
    queries = spark.createDataFrame([(1, "x0 y1 z"), (2, "x1"), (None, "y2 z"), (4, "y3 x2 z z")], "query_id long, question string")
    rows = lambda frame: sorted((str(r["query_id"]), r["chunk_id"], round(r["score"], 9)) for r in frame.collect())
    whole = rows(retrieval.bm25_match(index, queries))
    assert whole == rows(retrieval.bm25_match(index, queries, limit=3)) and {"None", "1", "2", "4"} == {q for q, _, _ in whole}


def test_a_word_of_all_documents_scores_nothing_but_counts(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x"), ("b", "x"), ("c", None)], "id string, content string").where("id <> 'c'")
    ranked = retrieval.tfidf_rank(docs, asked(spark, "x y"))
    assert "Exchange" not in plan(retrieval.tfidf_rank(docs.where("id = 'a'"), asked(spark, "x")))
    assert {r["id"] for r in ranked.collect()} == {"a", "b"}
    same = docs.where("id = 'a'").unionByName(spark.createDataFrame([("d", "x")], docs.schema))
    assert {r["id"]: r["score"] for r in retrieval.tfidf_rank(same, asked(spark, "x")).collect()} == {"a": 0.0, "d": 0.0}


def test_few_rows_are_sorted_for_the_best(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HELD_ROWS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        scores = spark.range(4000).selectExpr("id % 2 query_id", "concat('c', id % 1000) chunk_id", "double(id % 7) score").repartition(2)
        odd = [(0, "n", float("nan")), (0, "m", None), (0, None, 6.0), (None, "q", 1.0), (7, "only", -1.0)]
        scores = scores.unionByName(spark.createDataFrame(odd, scores.schema))
        assert retrieval._leading(scores, 5, "chunk_id").count() < 400
        key = lambda r: (str(r["query_id"]), r["rank"])
        best = sorted(retrieval.topk_per_query(scores, 5).collect(), key=key)
        expected = sorted(retrieval._ranked(scores, 5, "chunk_id").collect(), key=key)
        assert [str(r) for r in best] == [str(r) for r in expected]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_vector_hits_do_not_move_the_text_scores(spark):
    text = spark.range(50).selectExpr("id % 5 query_id", "concat('c', id) chunk_id", "double(id) score")
    vector = spark.createDataFrame([(0, "c5", 1.0), (0, "c6", 1.0), (None, "c7", 1.0), (9, "c1", 0.5)], "query_id long, chunk_id string, score double")
    merged = retrieval.merge_text_and_vector(text, vector)
    assert "SortMergeJoin" not in plan(merged) and "hashpartitioning" not in plan(merged)
    rows = lambda frame: sorted((str(r["query_id"]), r["chunk_id"], round(r["score"], 9)) for r in frame.collect())
    wide = retrieval._merged(text, vector.withColumnRenamed("score", "_vector"), 0.3, "chunk_id")
    assert rows(merged) == rows(wide) and len(rows(merged)) == 53


def documents(spark, rows):
    frame = spark.createDataFrame(rows, "id string, url string, content string")
    return frame.select(*[F.col(c) if c in frame.columns else F.lit("").alias(c) for c in RAW_FIELDS])


def test_chunks_of_single_ids_are_not_shuffled(spark):
    same = "The same sentence stands here again. " * 40
    plain = documents(spark, [("1", "u1", "A text. " * 300), ("2", "u2", same), ("3", "u3", None)])
    assert "Exchange" not in plan(distinct_chunks(plain, 80, 0))
    odd = plain.unionByName(documents(spark, [("2", "u9", same), ("4", "a", same), ("4", "b", "Another. " * 90), (None, "u", same), ("", "u", same), (None, None, "Short text"), (" ", "", same)]))
    for docs in (plain, odd):
        for length, overlap in ((80, 0), (300, 40)):
            expected = last_per_key(document_chunks(docs, length, overlap), ["chunk_id"], [F.desc("chunk_no")])
            rows = lambda frame: sorted((r["chunk_id"], r["chunk_no"], str(r["doc_id"] or ""), r["chunk_text"]) for r in frame.collect())
            assert rows(distinct_chunks(docs, length, overlap)) == rows(expected)


def test_rows_are_written_as_they_come(spark, folder, monkeypatch):
    def chunks(ids):
        frame = spark.createDataFrame([(i, "d", "text") for i in ids], "chunk_id string, doc_id string, chunk_text string")
        return frame.select(*[F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in INDEX.fields])

    monkeypatch.setattr(chunk_table.DataFrame, "dropDuplicates", None)
    assert chunk_table.append_batch(chunks(["a", "b"]).repartition(2), folder, "one") == 2
    monkeypatch.undo()
    assert chunk_table.append_batch(chunks(["c", "c", "d", None, None, "a"]).repartition(3), folder, "two") == 4
    held = chunk_table.read_index(spark, folder)
    assert sorted(str(r["chunk_id"]) for r in held.collect()) == ["None", "a", "b", "c", "d"]


def test_terms_are_selected_in_the_scan_of_the_postings(spark, folder):
    rows = spark.range(40).selectExpr("concat('c', id) chunk_id", "concat('w', id % 4, ' x') chunk_text")
    index = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in INDEX.fields])
    chunk_table.append_batch(index, folder, "a", fields=["chunk_text"])
    read = _postings(spark, read_manifest(spark, folder).of("chunks")).where(F.col("term").isin("w1", "x"))
    scan = next(line for line in read._jdf.queryExecution().toString().splitlines() if "FileScan" in line)
    assert "In(term" in scan
    assert read.select("folder").distinct().count() == 1
    hits = stored_search(spark, folder, asked(spark, "w1 x"), 3, {"chunk_text": 1.0}).collect()
    assert sorted(r["chunk_id"] for r in hits) == ["c1", "c13", "c17"]


def test_pages_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for make in (html.extract_article, html.extract_page_meta):
        spark.conf.unset(name)
        make(F.col("html"))
        assert spark.conf.get(name) == "8m"
    spark.conf.unset(name)


def test_streamed_files_grow_with_the_scan(spark, folder):
    rows = spark.range(120).selectExpr("id doc_id", "'text' text", "'en' lang", "'s' source", "4L n_chars")
    rows.repartition(11).write.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        stream = streamed_docs(spark, folder)
        query = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("streamed").count() == 120 and len(query.recentProgress) == 2
        scans = {r["f"] for r in spark.read.parquet(f"{folder}/documents.parquet").select(F.input_file_name().alias("f")).distinct().collect()}
        assert query.recentProgress[0]["numInputRows"] <= 60 and len(scans) == 11
        assert answer_files(spark, query) >= 11
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def answer_files(spark, query):
    """Files that the stream read: those of its source folder."""
    source = query.lastProgress["sources"][0]["description"]
    return len(spark.read.parquet(source[source.index("[") + 1 : -1]).inputFiles())


class Counted:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.value, self.calls = {}, 0

    def exists(self):
        self.calls += 1
        return bool(self.value)

    def iterator(self):
        self.calls += 1
        return iter(list(self.value.items()))

    def get(self):
        self.calls += 1
        return iter(self.value)

    def put(self, rows):
        self.calls, self.value = self.calls + 1, rows

    def clear(self):
        self.calls, self.value = self.calls + 1, {}

    def containsKey(self, own):
        self.calls += 1
        return own in self.value

    def getValue(self, own):
        self.calls += 1
        return self.value.get(own)

    def updateValue(self, own, at):
        self.calls += 1
        self.value[own] = at

    def removeKey(self, own):
        self.calls += 1
        self.value.pop(own)


class Handle:
    def __init__(self):
        self.timers = []

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_state_is_asked_per_timer_and_not_per_row():
    cache = answer_cache._OrderedCache(60)
    cache.handle, cache.waiting, cache.answers = Handle(), Counted(), Counted()
    second = 1_000_000
    rows = [(str(i % 3), i, i * second, True, False) for i in range(1, 1000)]
    cache.waiting.value = [*rows, (None, None, 500 * second, False, True), (None, 5000, 999 * second, True, False)]
    out = list(cache.handleExpiredTimer(("0",), Clock(1_000_000), None))[0]
    assert len(out) == 1000 and cache.waiting.calls + cache.answers.calls < 12
    hits = dict(zip(out["id"], out["cache_hit"]))
    assert hits[497] and hits[499] and not hits[500] and not hits[501] and not hits[502] and hits[503]
    assert set(cache.answers.value) == {("0",), ("1",), ("2",), (None,)} and cache.handle.timers
    list(cache.handleExpiredTimer(("0",), Clock(2_000_000), None))
    assert not cache.answers.value
