"""Hidden rows are told by ids alone."""

import re

from pyspark.sql import functions as F

from quarry.sources import chunk_table


def exchanged(frame):
    """Inputs of the exchanges of the plan."""
    plan = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [block for block in plan.split("\n\n") if re.match(r"\(\d+\) (Exchange|Sort)\b", block)]


def test_hidden_rows_move_ids_alone(spark, tmp_path, monkeypatch):
    """Many deletions and replaced chunks hide the same rows as few, and no exchange or sort holds a text (F11, F12)."""
    root = str(tmp_path / "index")
    names = ["doc_id", "chunk_no", "chunk_id", "chunk_text"]
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in chunk_table.INDEX.fields if f.name not in names]

    def batch(documents, text):
        rows = [(str(d), n, f"{d}_{n}", f"{text} {d} {n}") for d in documents for n in range(3)]
        return spark.createDataFrame(rows, "doc_id string, chunk_no int, chunk_id string, chunk_text string").select(*names, *others).repartition(3)

    chunk_table.append_batch(batch(range(3_000), "old"), root, "first")
    chunk_table.delete_docs(spark.createDataFrame([(str(d),) for d in range(0, 3_000, 7)], "id string"), root, "gone")
    chunk_table.append_batch(batch(range(1, 3_000, 2), "new"), root, "second")
    expected = {(f"{d}_{n}", f"{'new' if d % 2 else 'old'} {d} {n}") for d in range(3_000) for n in range(3) if d % 2 or d % 7}
    read = lambda: chunk_table.read_index(spark, root).select("chunk_id", "chunk_text")
    few = read().collect()
    monkeypatch.setattr(chunk_table, "BROADCAST_ROWS", 0)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for power in (15, 4):
            monkeypatch.setattr(chunk_table, "BITS_POWER", power)
            monkeypatch.setattr(chunk_table, "BITS", 1 << power)
            many = read()
            assert not [x for x in exchanged(many) if "chunk_text" in x and "Broadcast" not in x]
            got = many.collect()
            assert len(got) == len(few) == len(expected) and {tuple(r) for r in got} == {tuple(r) for r in few} == expected
        # Beyond what a broadcast may hold the rows are joined by their ids.
        monkeypatch.setattr(chunk_table, "BROADCAST_BYTES", 0)
        assert {tuple(r) for r in read().collect()} == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
