"""The answer cache of a stream that arrives out of order, against the replay of the whole log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators.cache import answer_cache_replay
from quarry.streaming.answer_cache import ordered_cache_stream

START = datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp, settable boolean"


def log(seed, count=240):
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        key = draw.choice(["a", "a", "b", "c", "d", None])
        # Times repeat, and some lie within one millisecond.
        at = timedelta(seconds=draw.randint(0, 600), microseconds=draw.choice([0, 0, 1, 999]))
        rows.append((i, key, START + at, draw.random() < 0.6))
    return rows


def run(spark, folder, slices, changes=None, ttl=60):
    """Feed slices of rows as micro-batches; returns output rows and the last progress."""
    for n, rows in enumerate(slices):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log/{n:03d}")
    read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    if changes is not None:
        spark.createDataFrame([(c,) for c in changes], "ts timestamp").coalesce(1).write.parquet(f"{folder}/changes")
    stream = ordered_cache_stream(
        read(f"{folder}/log", SCHEMA), ttl, "15 minutes", None if changes is None else read(f"{folder}/changes", "ts timestamp"), buckets=3
    )
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").collect()
    return {r["id"]: (r["key"], r["cache_hit"], r["answer_set"]) for r in out}, len(out), query.lastProgress


@pytest.mark.parametrize("with_changes", [False, True])
def test_stream_out_of_order_equals_replay(spark, folder, with_changes):
    rows = log(3)
    # The clock goes on: the watermark passes all rows, and later all answers.
    later = [[(1000, "z", START + timedelta(hours=1), False)], [(1001, "z", START + timedelta(hours=2), False)]]
    changes = [START + timedelta(seconds=s) for s in (0, 100, 101, 350)] if with_changes else None
    shuffled = random.Random(1).sample(rows, len(rows))
    slices = [shuffled[i::4] for i in range(4)] + later
    frame = spark.createDataFrame(rows, SCHEMA)
    marks = None if changes is None else spark.createDataFrame([(c,) for c in changes], "ts timestamp")
    expected = {r["id"]: (r["key"], r["cache_hit"], r["answer_set"]) for r in answer_cache_replay(frame, marks, ttl=60).collect()}
    assert 20 < sum(hit for _, hit, _ in expected.values()) < 220
    found, count, progress = run(spark, folder, slices, changes)
    assert {i: r for i, r in found.items() if i < 1000} == expected and count == len(found)
    # Only the last request still waits: no answer outlives its time.
    assert sum(s["numRowsTotal"] for s in progress["stateOperators"]) <= 6
    left = spark.read.format("statestore").option("path", f"{folder}/c").option("stateVarName", "answers").load()
    assert left.count() == 0


def test_restart_keeps_waiting_rows(spark, folder):
    rows = [(0, "a", START, True), (1, "a", START + timedelta(seconds=30), True), (2, "a", START + timedelta(seconds=61), True)]
    found, _, _ = run(spark, folder, [[rows[2]], [rows[0]]])
    assert found == {}
    spark.createDataFrame([rows[1], (9, "z", START + timedelta(hours=3), False)], SCHEMA).coalesce(1).write.parquet(f"{folder}/log/900")
    found, _, _ = run(spark, folder, [])
    assert found == {0: ("a", False, True), 1: ("a", True, False), 2: ("a", False, True)}
