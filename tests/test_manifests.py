"""Concurrent writers, pinned readers and id filters of the chunk index."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarry.schemas import INDEX
from quarry.sources import chunk_table, id_filter
from quarry.sources.manifest import Entry, commit, read_manifest
from quarry.sources.storage import child_names, create_text, read_text


def chunks(spark, docs, word="a"):
    rows = [(f"{d}_{c}", str(d), c, f"{word} {d} {c}") for d in docs for c in range(2)]
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_no int, chunk_text string")
    return frame.select(*[F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in INDEX.fields])


def texts(spark, root, **options):
    return sorted(r["chunk_text"] for r in chunk_table.read_index(spark, root, **options).collect())


def expected(**words):
    return sorted(f"{w} {d} {c}" for w, docs in words.items() for d in docs for c in range(2))


def test_a_file_is_created_once(spark, folder):
    assert create_text(spark, f"{folder}/log/1", "nhà") and not create_text(spark, f"{folder}/log/1", "other")
    assert read_text(spark, f"{folder}/log/1") == "nhà"
    assert child_names(spark, f"{folder}/log") == ["1"]


def test_commits_of_many_writers_are_all_kept(spark, folder):
    def write(i):
        commit(spark, folder, lambda current: [*current.entries, Entry("x", str(i), f"f{i}", i)])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(12)))
    last = read_manifest(spark, folder)
    assert last.number == 12 and {e.batch for e in last.entries} == {str(i) for i in range(12)}
    assert sorted(e.number for e in last.entries) == list(range(1, 13))


@pytest.mark.parametrize("least_rows", [0, 10**9])
def test_overtaken_writer_checks_again(spark, folder, monkeypatch, least_rows):
    """Batch b comes in between when batch a has compared its ids and is about to commit."""
    real, done = chunk_table.read_manifest, []
    chunk_table.append_batch(chunks(spark, [1], "old"), folder, "first")
    from quarry.sources import manifest

    before = manifest.create_text

    def create(spark_, path, text):
        if not done:
            done.append(True)
            chunk_table.append_batch(chunks(spark, [2, 3], "b"), folder, "b", least_rows=least_rows)
        return before(spark_, path, text)

    monkeypatch.setattr(manifest, "create_text", create)
    pinned = real(spark, folder)
    assert chunk_table.append_batch(chunks(spark, [1, 2], "a"), folder, "a", least_rows=least_rows) == 4
    # a was committed last and replaces what both wrote; nothing is there twice.
    assert texts(spark, folder) == expected(a=[1, 2], b=[3])
    assert texts(spark, folder, manifest=pinned) == expected(old=[1])
    assert chunk_table.append_batch(chunks(spark, [2], "b2"), folder, "b") == 2
    assert texts(spark, folder) == expected(a=[1], b2=[2])


def test_threads_leave_each_chunk_once(spark, folder):
    parts = {"a": range(0, 6), "b": range(3, 9), "c": range(5, 7)}

    def read(_):
        found = texts(spark, folder)
        ids = [t.split(" ", 1)[1] for t in found]
        # A reader sees whole batches, and each chunk once.
        return len(ids) == len(set(ids)) and len(ids) in (0, 4, 12, 14, 18)

    with ThreadPoolExecutor(5) as pool:
        readers = pool.map(read, range(4))
        writers = [pool.submit(chunk_table.append_batch, chunks(spark, docs, word), folder, word) for word, docs in parts.items()]
        assert [w.result() for w in writers] == [12, 12, 4] and all(readers)
    found = texts(spark, folder)
    assert len(found) == 18 and {t.split(" ", 1)[1] for t in found} == {f"{d} {c}" for d in range(9) for c in range(2)}


def test_compaction_beside_other_writers(spark, folder, monkeypatch):
    from quarry.sources import manifest

    chunk_table.append_batch(chunks(spark, [1, 2], "a"), folder, "a", F.lit("2024-01-01").cast("timestamp"))
    before, done = manifest.create_text, []

    def create(spark_, path, text):
        if not done:
            done.append(True)
            chunk_table.append_batch(chunks(spark, [2, 3], "b"), folder, "b")
            chunk_table.delete_docs(spark.createDataFrame([("1",)], "id string"), folder, "d", F.lit("2024-06-01").cast("timestamp"))
        return before(spark_, path, text)

    monkeypatch.setattr(manifest, "create_text", create)
    chunk_table.compact(spark, folder)
    assert texts(spark, folder) == expected(b=[2, 3])
    assert len(read_manifest(spark, folder).of("chunks")) == 2
    # A batch that is written again while it is compacted is read again.
    done.clear()
    monkeypatch.setattr(manifest, "create_text", lambda s, p, t: (done or (done.append(True), chunk_table.append_batch(chunks(spark, [4], "c"), folder, "b")), before(s, p, t))[1])
    chunk_table.compact(spark, folder)
    # The second writing of b no longer hides the rows of a.
    assert texts(spark, folder) == expected(a=[2], c=[4])


def test_forced_batch_hides_and_adds_at_once(spark, folder):
    chunk_table.append_batch(chunks(spark, [1, 2], "a"), folder, "a")
    ids = spark.createDataFrame([("1",)], "id string")
    chunk_table.append_batch(chunks(spark, [5], "b"), folder, "b", deletes=ids)
    assert [e.kind for e in read_manifest(spark, folder).entries] == ["chunks", "chunks", "deleted"]
    assert read_manifest(spark, folder).number == 2 and texts(spark, folder) == expected(a=[2], b=[5])
    with open(f"{folder}/manifests/000000000002.json", encoding="utf-8") as file:
        assert len(json.load(file)["entries"]) == 3


def test_filters_name_the_batches_to_read(spark, folder):
    for i in range(8):
        chunk_table.append_batch(chunks(spark, range(100 * i, 100 * i + 60)), folder, f"b{i}")
    entries = read_manifest(spark, folder).of("chunks")
    ids = spark.createDataFrame([("105",), ("110",), ("730",), ("777777",), (None,)], "doc_id string")
    held = chunk_table.entries_holding(spark, entries, ids, least_rows=0)
    assert [e.batch for e in held] == ["b1", "b7"]
    found = chunk_table.read_index(spark, folder, doc_ids=ids, least_rows=0)
    assert found.count() == 240 and found.join(ids, "doc_id", "left_semi").count() == 6
    assert chunk_table.entries_holding(spark, entries, ids.limit(0), least_rows=0) == []


def test_filters_lose_no_id_and_pass_few(spark, folder, monkeypatch):
    monkeypatch.setattr(id_filter, "SEGMENT_IDS", 5_000)
    ids = spark.range(40_000).select(F.col("id").cast("string").alias("id"))
    id_filter.write_filters(ids, "id", 40_000, f"{folder}/f")
    assert spark.read.parquet(f"{folder}/f").count() == 8
    for at in (0, 39_999, 17_171):
        assert id_filter.may_hold(spark, [f"{folder}/f"], ids.where(F.col("id") == str(at)), "id") == [f"{folder}/f"]
    others = [id_filter.may_hold(spark, [f"{folder}/f"], spark.createDataFrame([(f"x{i}",)], "id string"), "id") for i in range(12)]
    assert others.count([]) >= 11
    assert id_filter.may_hold(spark, [f"{folder}/f"], ids, "id", limit=10) == [f"{folder}/f"]
