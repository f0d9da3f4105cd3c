"""Skew-safe scans, index keeping, retrieval, cache and metrics."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import cache, evaluate, index, listing, metrics, normalize, rag, retrieval, stats
from quarry.operators.ordered import look_back, running, slice_by_order


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows, and days repeat."""
    draw = random.Random(3)
    data = [("hot" if draw.random() < 0.7 else f"k{draw.randint(1, 5)}", f"2024-01-{draw.randint(1, 4):02d}", i) for i in range(600)]
    return spark.createDataFrame([*data, (None, "2024-01-01", 1000), (None, "2024-01-02", 1001)], "category string, day string, id int")


@pytest.mark.parametrize("slices", [1, 3, 17])
def test_running_and_look_back_equal_windows(spark, skewed, slices):
    keys, order = ["category"], ["day", "id"]
    sliced = slice_by_order(skewed, keys, order, slices)
    got = look_back(sliced, keys, order, F.col("id"), 4, "before")
    got = running(got, keys, order, {"total": ("sum", F.col("id")), "top": ("max", F.col("id") % 7), "n": ("sum", F.lit(1))})
    window = W.partitionBy("category").orderBy("day", "id")
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    expected = skewed.select(
        "*", F.collect_list("id").over(window.rowsBetween(-4, -1)).alias("before"), F.sum("id").over(upto),
        F.max(F.col("id") % 7).over(upto), F.row_number().over(window),
    )
    assert rows(got.drop("slice_no"), "id") == rows(expected, "id")


def test_hot_key_is_spread_over_slices(spark, skewed):
    sliced = slice_by_order(skewed, ["category"], ["day", "id"], 8)
    hot = sliced.filter("category = 'hot'").groupBy("slice_no").count().collect()
    assert len(hot) >= 5 and max(r["count"] for r in hot) < 150


def test_document_rank_stats_against_windows(spark, skewed):
    docs = skewed.filter("category is not null").selectExpr(
        "cast(id as string) id", "category", "concat(day, 'T00:00:00') published_date", "repeat('x', id % 50) content"
    )
    plain = docs.selectExpr("id", "category", "substr(published_date, 1, 10) day", "cast(length(content) as long) length")
    w = W.partitionBy("category").orderBy("day", "id")
    d = W.partitionBy("category").orderBy("day")
    expected = plain.select(
        "*", F.row_number().over(w), F.rank().over(d), F.dense_rank().over(d), F.ntile(4).over(w), F.lag("length").over(w),
        F.sum("length").over(w.rowsBetween(W.unboundedPreceding, 0)), F.avg("length").over(w.rowsBetween(-2, 0)),
    )
    got, wanted = rows(stats.document_rank_stats(docs, slices=9), "id"), rows(expected, "id")
    assert [g[:-1] for g in got] == [e[:-1] for e in wanted]
    assert np.allclose([g[-1] for g in got], [e[-1] for e in wanted])


def test_history_over_slices(spark):
    turns = spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(40)] + [(2, 0, "system", "s")],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r["conv_id"], r["turn"]): r["history"] for r in rag.history_window(turns, slices=11).collect()}
    for t in range(40):
        lines = [("User: " if i % 2 == 0 else "Assistant: ") + f"t{i}" for i in range(max(0, t - 6), t)]
        assert got[(1, t)] == "\n".join(lines)
    assert got[(2, 0)] == ""


def replay_by_hand(requests, marks, ttl):
    out, set_at = {}, {}
    for key, at, ident, settable in sorted(requests, key=lambda r: (r[1], r[2])):
        last = set_at.get(key)
        hit = last is not None and at - last <= ttl and not any(last < m <= at for m in marks)
        made = settable and not hit
        if made:
            set_at[key] = at
        out[ident] = (hit, made)
    return out


@pytest.mark.parametrize("rows_per_key", [0, 50, 10_000])
def test_cache_replay(spark, rows_per_key):
    draw = random.Random(11)
    log = [
        ("hot" if draw.random() < 0.6 else f"k{draw.randint(1, 8)}", draw.randint(0, 3000), i, draw.random() < 0.7)
        for i in range(700)
    ]
    marks = [400, 401, 1500, 2222]
    frame = spark.createDataFrame(log, "key string, s long, id long, settable boolean").withColumn("ts", F.timestamp_seconds("s"))
    changes = spark.createDataFrame([(m,) for m in marks], "s long").select(F.timestamp_seconds("s").alias("ts"))
    for some, given in ((changes, marks), (None, [])):
        got = cache.answer_cache_replay(frame.drop("s"), some, 60, rows_per_key)
        assert {r["id"]: (r["cache_hit"], r["answer_set"]) for r in got.collect()} == replay_by_hand(log, given, 60)


def test_normalize_record(spark):
    qa = spark.createDataFrame([("1", "", "Q", None, "A", "me"), ("", "", None, "c", None, None)], "id string, title string, question string, content string, answer string, author string")
    out = normalize.drop_blank_records(normalize.normalize_record(qa, F.lit("now"))).collect()
    assert [tuple(r) for r in out] == [("1", "Q", "A", "", "", "", "me", "", "", "now")]
    dated = normalize.normalize_record(qa.withColumn("crawled_at", F.lit("")), F.lit("now")).first()
    assert dated["crawled_at"] == ""


def test_skip_indexed_docs(spark):
    docs = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c"), ("", "d")], "id string, content string")
    held = spark.createDataFrame([("2",), ("9",)], "doc_id string")
    assert sorted(r["content"] for r in index.skip_indexed_docs(docs, held).collect()) == ["a", "c", "d"]
    assert index.skip_indexed_docs(docs, held, force=True).count() == 4
    plan = index.skip_indexed_docs(docs, held)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_last_per_key_limits_before_the_shuffle(spark):
    frame = spark.range(100).selectExpr("id % 3 k", "id v")
    newest = index.last_per_key(frame, ["k"], [F.desc("v")])
    assert rows(newest, "k") == [(0, 99), (1, 97), (2, 98)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_upsert_twice_is_upsert_once(spark):
    held = spark.createDataFrame([("a_1", "a", 0, "old"), ("b_1", "b", 0, "old")], "chunk_id string, doc_id string, chunk_no int, title string")
    come = spark.createDataFrame([("a_1", "a", 0, "new"), ("a_1", "a", 1, "new2"), ("c_1", "c", 0, "new")], held.schema)
    once = index.upsert_chunks(held, come)
    assert rows(once, "chunk_id") == rows(index.upsert_chunks(once, come), "chunk_id")
    assert {r["chunk_id"]: r["title"] for r in once.collect()} == {"a_1": "new2", "b_1": "old", "c_1": "new"}


def test_chunk_without_document_id_is_keyed_by_url(spark):
    frame = spark.createDataFrame([("", "u", "t"), (None, "u", "t"), ("1", "u", "t")], "doc_id string, url string, chunk_text string")
    ids = [r["chunk_id"] for r in index.with_chunk_id(frame).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 32 and ids[2].startswith("1_")


def test_new_until_seen(spark):
    frame = spark.createDataFrame([("c", 1, False), ("c", 2, True), ("c", 3, False), ("d", 1, False), (None, 1, True)], "category string, position int, seen boolean")
    assert rows(listing.new_until_seen(frame, F.col("seen")).select("category", "position"), "category") == [("c", 1), ("d", 1)]
    assert listing.new_until_seen(frame, F.col("seen"), stop_on_seen=False).count() == 3


@pytest.mark.parametrize("sent", [100, 0])
def test_knn_against_numpy(spark, sent, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 7)
    monkeypatch.setattr(retrieval, "SLICE_VECTORS", 90)
    draw = np.random.default_rng(5)
    vectors, asked = draw.normal(size=(400, 12)), draw.normal(size=(30, 12))
    vectors[7] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    got = {}
    for r in retrieval.knn_cosine(frame, queries, 5, broadcast_questions=sent).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    norms = np.linalg.norm(vectors, axis=1)
    for q, v in enumerate(asked):
        cosine = np.where(norms > 0, vectors @ v / np.where(norms > 0, norms, 1) / np.linalg.norm(v), -9)
        assert [got[q][r] for r in range(1, 6)] == list(np.argsort(-cosine)[:5])


def test_bm25_by_hand_and_plan(spark):
    frame = spark.createDataFrame([("c1", "đất đai nhà", "x"), ("c2", "nhà nhà ở", "đất"), ("c3", "khác", "")], "chunk_id string, chunk_text string, title string")
    queries = spark.createDataFrame([(1, "Đất nhà")], "query_id int, question string")
    scored = retrieval.bm25_match(frame, queries)
    got = {r["chunk_id"]: r["score"] for r in scored.collect()}

    def part(tf, size, mean, df, n):
        return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * size / mean))

    mean = 7 / 3
    assert got["c1"] == pytest.approx(5 * (part(1, 3, mean, 1, 3) + part(1, 3, mean, 2, 3)), abs=1e-5)
    assert got["c2"] == pytest.approx(5 * part(2, 3, mean, 2, 3) + 3 * part(1, 1, 1, 1, 2), abs=1e-5)
    assert set(got) == {"c1", "c2"}
    plan = retrieval.topk_per_query(scored)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("limit", [1000, 3])
def test_candidates_hold_the_best_and_the_wanted(spark, limit, monkeypatch):
    monkeypatch.setattr(retrieval, "STRIP_CELLS", 40)
    draw = random.Random(2)
    words = ["đất", "nhà", "luật", "thuế", "xe", "phạt", "lao", "động"]
    texts = [(f"c{i:03d}", " ".join(draw.choices(words, k=draw.randint(0, 9))), draw.choice(words)) for i in range(150)]
    index = spark.createDataFrame(texts, "chunk_id string, chunk_text string, title string").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(draw.choices(words[:6], k=3))) for q in range(6)], "query_id long, question string")
    every = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.bm25_match(index, queries).collect()}
    best = retrieval.topk_per_query(retrieval.bm25_match(index, queries), 4)
    wanted = spark.createDataFrame([(0, "c001"), (1, "c001"), (5, "c149"), (77, "c002")], "query_id long, chunk_id string")
    found = retrieval.bm25_candidates(index, queries, 4, also=wanted, limit=limit)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in found.collect()}
    # At most k a question and batch, whatever the limit, besides the wanted pairs.
    assert len(got) < len(every) and found.count() <= 4 * 6 * 3 * 5 + 3
    assert all(got[pair] == pytest.approx(every[pair]) for pair in got)
    assert {p for p in [(0, "c001"), (1, "c001"), (5, "c149")] if p in every} <= set(got)
    assert rows(retrieval.topk_per_query(found, 4), "query_id", "rank") == rows(best, "query_id", "rank")


def test_embed_failure_gives_null(spark):
    def failing(texts):
        raise RuntimeError("no model")

    frame = spark.createDataFrame([("a",), (None,)], "chunk_text string")
    assert retrieval.embed_chunks(frame, failing).filter("embedding is null").count() == 2
    twice = [retrieval.embed_chunks(frame).collect() for _ in range(2)]
    assert twice[0] == twice[1] and len(twice[0][0]["embedding"]) == 256


def test_gate_and_sources(spark):
    hits = spark.createDataFrame(
        [(1, r, 9.0 - r, f"t{r}", f"u{r % 3}" if r != 2 else "", f"d{r}") for r in range(1, 7)],
        "query_id int, rank int, score double, title string, url string, doc_id string",
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert rows(rag.threshold_gate(queries, hits, 2.0), "query_id") == [(1, 8.0, False), (2, 0.0, True)]

    def cited(answer, used):
        frame = spark.createDataFrame([(1, answer, used)], "query_id int, answer string, used array<int>")
        return [(r["position"], r["doc_id"]) for r in rag.cite_sources(frame, hits).orderBy("position").collect()]

    assert cited("ok", [5, 2, 0, 99]) == [(1, "d6"), (2, "d1")]
    assert cited("ok", []) == [(1, "d1"), (2, "d3")]
    assert cited("ok", [-1]) == [(1, "d6")]
    assert cited("Xin lỗi, tôi KHÔNG tìm thấy thông tin", [0]) == []


def test_context_without_hits(spark):
    queries = spark.createDataFrame([(1, "hỏi")], "query_id int, question string")
    none = spark.createDataFrame([], "query_id int, rank int, title string, chunk_text string")
    text = rag.build_context(queries, none).first()["user_content"]
    assert text == "Tài liệu tham khảo:\n(Không có tài liệu liên quan)\n\nCâu hỏi: hỏi"


def test_score_hits(spark):
    gold = spark.createDataFrame([(1, ["c"], ["Đất"]), (2, ["c"], ["x"])], "id int, expected_categories array<string>, expected_keywords array<string>")
    hits = spark.createDataFrame(
        [(1, "h1", "đất", "", "", "", "c"), (1, "h2", "none", None, "", "d", "")],
        "query_id int, chunk_id string, title string, chunk_text string, url string, category string, doc_type string",
    )
    scored = evaluate.score_hits(evaluate.join_hits_to_gold(gold, hits))
    assert rows(scored, "id") == [(1, 0.5, 1.0, True, 2), (2, 0.0, 0.0, False, 0)]
    summary = evaluate.eval_summary(scored.withColumn("latency_ms", F.lit(4))).first()
    assert tuple(summary) == (2, 1, 0.5, 1.0, 1.0, 4.0)


def test_quantile_edges(spark):
    def quantile(values):
        log = spark.createDataFrame([("p", float(v)) for v in values], "path string, latency_seconds double")
        return metrics.histogram_quantile(log, 0.95).first()["quantile"]

    assert quantile([0.005] * 10) == pytest.approx(0.0095)
    assert quantile([50.0] * 10) == 10.0
    assert quantile([0.2] * 90 + [0.7] * 10) == pytest.approx(0.75)


def test_windows_on_a_stream_equal_the_batch(spark, folder):
    log = spark.range(2000).selectExpr("timestamp_seconds(1700000000 + id * 7) ts", "if(id % 3 = 0, 'cache', 'rag') path", "id % 5 / 2.0 latency_seconds", "cast(id % 4 as double) sources")
    log.write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{folder}/log")
    for number, report in enumerate((metrics.request_rate_5m, metrics.latency_p95_5m, metrics.share_5m, metrics.avg_sources_5m)):
        name = f"report{number}"
        query = report(stream).writeStream.format("memory").queryName(name).outputMode("complete").start()
        query.processAllAvailable()
        query.stop()
        assert rows(spark.table(name), "window_start", *spark.table(name).columns[2:]) == rows(report(log), "window_start", *report(log).columns[2:])
