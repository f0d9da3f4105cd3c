"""Files, master dataset, chunk table, batch layer and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import index
from quarry.plans.batch import rebuild
from quarry.schemas import RAW, RAW_FIELDS
from quarry.sources import chunk_table, files, topic
from quarry.streaming import layers
from quarry.streaming.answer_cache import answer_cache_stream

NOW = {"availableNow": True}


def docs(spark, ids, word="nhà", crawled="2024-06-01T10:00:00Z"):
    rows = [
        (str(i), f"title {i}", f"Câu {i} {word}. " * 30 + '"quoted",\nnext line', "cat", "type", "", "", "2024-05-01", f"https://x/a-{i}.html", crawled)
        for i in ids
    ]
    return spark.createDataFrame(rows, RAW)


def put(df, path, name):
    """One CSV file of a known name."""
    files.write_csv_artifact(df.coalesce(1), f"{path}-{name}")
    part = next(f for f in os.listdir(f"{path}-{name}") if f.startswith("part"))
    os.makedirs(path, exist_ok=True)
    with open(f"{path}-{name}/{part}", "rb") as source, open(f"{path}/{name}", "wb") as target:
        target.write(source.read())


def test_landing_csv_round_trip(spark, folder):
    put(docs(spark, range(3)), f"{folder}/raw", "a.csv")
    back = files.valid_rows(files.read_landing_csv(spark, f"{folder}/raw/*.csv"))
    assert sorted(r["content"] for r in back.collect()) == sorted(r["content"] for r in docs(spark, range(3)).collect())


def test_landing_csv_broken_rows(spark, folder):
    with open(f"{folder}/x.csv", "w") as f:
        f.write(",".join(RAW_FIELDS) + "\n" + ",".join(["v"] * 10) + "\nonly,three,fields\n" + "," * 9 + "\n")
    scanned = files.read_landing_csv(spark, f"{folder}/x.csv")
    assert scanned.count() == 3
    assert [r["id"] for r in files.valid_rows(scanned).collect()] == ["v"]


def test_master_json(spark, folder):
    os.makedirs(f"{folder}/2024/06")
    for name, value in {"1": {"id": "1", "title": "t", "extra": 1}, "2": {"id": "2", "content": "c\nd"}}.items():
        with open(f"{folder}/2024/06/{name}.json", "w") as f:
            json.dump(value, f, indent=1)
    with open(f"{folder}/2024/bad.json", "w") as f:
        f.write("{nothing")
    with open(f"{folder}/2024/skip.txt", "w") as f:
        f.write("x")
    good, skipped = files.split_unreadable(files.read_master_json(spark, folder))
    assert sorted((r["id"], r["title"], r["content"]) for r in good.collect()) == [("1", "t", None), ("2", None, "c\nd")]
    assert skipped.first()["skipped"] == 1


def test_gold_set_and_inventory(spark, folder):
    os.makedirs(f"{folder}/raw/sub")
    with open(f"{folder}/gold.json", "w") as f:
        json.dump({"queries": [{"id": "q1", "question": "hỏi", "expected_categories": ["a"], "expected_keywords": ["k", "l"]}]}, f)
    row = files.read_gold_set(spark, f"{folder}/gold.json").first()
    assert row["id"] == "q1" and row["expected_keywords"] == ["k", "l"]
    for name in ("raw/a.csv", "raw/sub/b.csv"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("12345")
    found = files.landing_inventory(spark, folder, "*.csv").collect()
    assert [tuple(r) for r in found] == [("raw", 2, 10)]


def test_topic_records(spark):
    records = topic.to_records(docs(spark, [5]).withColumn("agency", F.lit(None).cast("string")))
    row = records.first()
    assert bytes(row["key"]) == b"5" and "Câu" in bytes(row["value"]).decode() and json.loads(row["value"])["agency"] is None
    assert topic.from_records(records).first()["id"] == "5"


def test_master_replay_and_versions(spark, folder):
    fallback = F.lit("2030-02-01").cast("timestamp")
    first = docs(spark, [1, 2]).unionByName(docs(spark, [None], crawled="2024-06-01")).filter("true")
    first = first.withColumn("id", F.nullif("id", F.lit("None")))
    for _ in range(2):
        files.write_master(first, folder, "b1", fallback)
    files.write_master(docs(spark, [1], "mới", "2024-07-02T00:00:00Z"), folder, "b2", fallback)
    files.write_master(docs(spark, [3], crawled="https://x/y"), folder, "b3", fallback)
    latest = {r["id"]: (r["year"], r["month"]) for r in files.read_master(spark, folder).collect()}
    assert latest == {"1": (2024, 7), "2": (2024, 6), "3": (2030, 2)}
    assert files.read_master(spark, folder, all_versions=True).count() == 4
    rejected = spark.read.parquet(f"{folder}/rejects").collect()
    assert [r["reason"] for r in rejected] == ["missing id"]


def chunk_ids(spark, root):
    return sorted(r["chunk_id"] for r in chunk_table.read_index(spark, root).collect())


def test_batch_layer(spark, folder):
    root = f"{folder}/index"
    assert rebuild(docs(spark, [1, 2]), root, "b1", max_length=200, overlap=20) > 2
    first = chunk_ids(spark, root)
    assert rebuild(docs(spark, [1, 2]), root, "b2", max_length=200, overlap=20) == 0
    assert rebuild(docs(spark, [1, 2]), root, "b1", max_length=200, overlap=20) == len(first)
    assert chunk_ids(spark, root) == first
    rebuild(docs(spark, [2, 3], "khác"), root, "b3", max_length=200, overlap=20)
    assert not chunk_table.read_index(spark, root).filter("chunk_text like '%khác%' and doc_id = '2'").count()
    rebuild(docs(spark, [2], "khác"), root, "b4", force=True, max_length=200, overlap=20)
    changed = chunk_table.read_index(spark, root).filter("doc_id = '2'")
    assert changed.count() and changed.filter("chunk_text not like '%khác%'").count() == 0
    assert chunk_table.read_versions(spark, root).count() == 3
    before = chunk_ids(spark, root)
    chunk_table.compact(spark, root)
    assert chunk_ids(spark, root) == before
    chunk_table.delete_docs(spark.createDataFrame([("3",)], "id string"), root, "d1")
    assert not [c for c in chunk_ids(spark, root) if c.startswith("3_")]
    chunk_table.compact(spark, root, chunk_table.read_index(spark, root).limit(0))
    assert chunk_ids(spark, root) == []


def test_snapshot(spark, folder):
    root = f"{folder}/index"
    rebuild(docs(spark, [1]), root, "b1")
    chunk_table.take_snapshot({"index": chunk_table.read_index(spark, root), "gone": None}, f"{folder}/s", "1")
    assert chunk_table.restore_snapshot(spark, f"{folder}/s", "1", "index").count() == len(chunk_ids(spark, root))
    with pytest.raises(Exception, match="already exists"):
        chunk_table.take_snapshot({"index": chunk_table.read_index(spark, root)}, f"{folder}/s", "1")


def landing(spark, folder):
    return files.stream_landing_csv(spark, f"{folder}/raw", archive=f"{folder}/done", max_files=1)


def test_streams_equal_batch_and_restart(spark, folder):
    put(docs(spark, [1, 2]), f"{folder}/raw", "a.csv")
    put(docs(spark, [2, 3]), f"{folder}/raw", "b.csv")

    def publish():
        layers.landing_to_topic(landing(spark, folder), f"{folder}/c1", "parquet", NOW, path=f"{folder}/topic").awaitTermination()

    def consume():
        records = spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 1).parquet(f"{folder}/topic")
        archived = layers.master_archiver(topic.from_records(records), f"{folder}/master", f"{folder}/c2", NOW)
        indexed = layers.speed_layer(topic.from_records(records), f"{folder}/index", f"{folder}/c3", trigger=NOW, max_length=200, overlap=20)
        archived.awaitTermination()
        indexed.awaitTermination()

    publish()
    consume()
    put(docs(spark, [4]), f"{folder}/raw", "c.csv")
    publish()
    consume()
    stored = files.read_master(spark, f"{folder}/master")
    assert sorted(r["id"] for r in stored.collect()) == ["1", "2", "3", "4"]
    rebuild(stored.select(*RAW_FIELDS), f"{folder}/batch", "b", max_length=200, overlap=20)
    assert chunk_ids(spark, f"{folder}/index") == chunk_ids(spark, f"{folder}/batch")


def test_speed_layer_raises(spark, folder):
    docs(spark, [1]).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(RAW).parquet(f"{folder}/in")
    blocked = f"{folder}/index"
    with open(blocked, "w") as f:
        f.write("a file where the folder should be")
    query = layers.speed_layer(stream, blocked, f"{folder}/c", trigger=NOW)
    with pytest.raises(Exception):
        query.awaitTermination()


def test_cache_stream(spark, folder):
    log = [("a", 0, True), ("a", 50, True), ("a", 61, True), ("b", 10, False), ("b", 20, True), ("b", 30, False), ("a", 100, False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(log)], "id long, key string, s long, settable boolean")
    frame = frame.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for part in ("id < 4", "id >= 4"):
        frame.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        query = (
            answer_cache_stream(spark.readStream.schema(frame.schema).parquet(f"{folder}/log"), ttl=60)
            .writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
            .trigger(**NOW).start()
        )
        query.awaitTermination()
    got = {r["id"]: r["cache_hit"] for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_master_orders_by_moment(spark, folder):
    fallback = F.lit("2024-09-09").cast("timestamp")
    files.write_master(docs(spark, [1, 2], "good", "2024-07-02T05:00:00Z"), folder, "b1", fallback)
    # Later as text, but two hours earlier; and no time at all.
    files.write_master(docs(spark, [1], "shifted", "2024-07-02T10:00:00+07:00"), folder, "b2", fallback)
    files.write_master(docs(spark, [2], "broken", "https://x/y"), folder, "b3", fallback)
    assert all("good" in r["content"] for r in files.read_master(spark, folder).collect())


def test_index_holds_a_chunk_once(spark, folder):
    rows = docs(spark, [1, 2], "t" * 60).withColumn("id", F.when(F.col("id") == "1", F.col("id")))
    for stamp, forced in (("a", False), ("b", False), ("c", True)):
        rebuild(rows, folder, stamp, force=forced)
    ids = [r["chunk_id"] for r in chunk_table.read_index(spark, folder).collect()]
    assert ids and len(ids) == len(set(ids))


def test_incoming_rows_repeat(spark):
    schema = "id string, title string, published_date string"
    old = spark.createDataFrame([("1", "old", "2024"), ("2", "kept", "2023")], schema)
    new = spark.createDataFrame([("1", "a", "2025", 1), ("1", "b", "2025", 2), ("", "no id", "2025", 3)], schema + ", n int")
    rows = index.upsert_csv_rows(old, new, arrival="n").collect()
    assert [tuple(r) for r in rows] == [("1", "b", "2025"), ("2", "kept", "2023")]


def test_rejected_records_keep_their_value(spark):
    rows = [(b"k", b'{"id": "1"}'), (b"k", b"no json"), (b"k", b"[1]"), (b"k", None)]
    found = topic.rejected_records(spark.createDataFrame(rows, "key binary, value binary")).collect()
    assert {(r["value"], r["reason"]) for r in found} == {("no json", "not JSON"), ("[1]", "no object"), (None, "no value")}
