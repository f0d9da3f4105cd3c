"""Python tasks give freed memory back to the system, and packing hands its sequences over part by part."""

import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from quarry.llm import common, packing
from quarry.llm.registry import vocabulary


def resident():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def scattered():
    """Freed heap blocks below one that lives on, as many small arrays leave them."""
    blocks = [np.ones(12_000) for _ in range(1_000)]
    last = np.ones(12_000)
    del blocks
    return last


def test_memory_of_a_task_is_given_back():
    held = []

    def run(batches):
        for batch in batches:
            held.append(scattered())
            yield batch

    for _ in run([1]):
        kept = resident()
    assert list(common.given_back(run)([1, 2])) == [1, 2]
    assert resident() < kept - 50


def test_memory_of_groups_is_given_back(monkeypatch):
    monkeypatch.setattr(common, "REST", -1.0)
    held = []

    def compare(key, rows):
        held.append(scattered())
        return rows

    compare((0,), None)
    kept = resident()
    table = pa.table({"a": [1]})
    assert common.given_back_by_group(compare)((0,), table) is table
    assert resident() < kept - 50


def test_packing_hands_over_the_sequences_of_a_part(spark, monkeypatch):
    # 300 000 tokens in 500 documents, so that each part fills a pool of windows.
    batch = pa.record_batch([pa.array(range(1500)), pa.array(["some words " * 300] * 1500)], ["doc_id", "text"])
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    made = list(packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)(iter([batch])))
    assert sum(b.num_rows > 0 for b in made) >= 4
    assert sum(pc.sum(b["length"]).as_py() for b in made) == 1500 * len(packing.document_ids(batch["text"][:1], vocabulary("word_bpe_49k.json"), 2)[0]) // 4
