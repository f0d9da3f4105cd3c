"""Stored postings of the chunk index, written beside a batch.

Rows are dealt into windows of consecutive rows of a task. A window has a row per field and term with its delta-coded
row numbers and frequencies, and the pairs of frequency and field length that no other pair of the block beats: from
them follows the largest score of the term in the window whatever the statistics of the corpus become. A row
per field holds the field lengths, a row per window the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fold_tokens

# Rows of a window, and windows that are searched together.
WINDOW = 1_024
PART = 64

# Stand for the rows with field lengths and with keys.
LENGTHS = ""
KEYS = ""

SCHEMA = "part long, window int, field string, term string, n int, total long, impacts array<struct<tf:int,size:int>>, docs binary, tfs binary, keys array<string>"


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each number, seven bits a byte with the last one marked, and where each number begins."""
    values = values.astype(np.uint64)
    length = np.ones(len(values), np.int64)
    for more in range(1, 5):
        length += values >= np.uint64(1 << 7 * more)
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(start[-1], np.uint8)
    for i in range(int(length.max(initial=0))):
        has = length > i
        out[start[:-1][has] + i] = (values[has] >> np.uint64(7 * i)) & np.uint64(127)
    out[start[1:] - 1] |= 128
    return out, start


def numbers(content: bytes) -> np.ndarray:
    """The numbers that ``varint`` wrote."""
    read = np.frombuffer(content, np.uint8)
    last = np.flatnonzero(read & 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for i in range(int((last - first).max(initial=-1)) + 1):
        has = last - first >= i
        out[has] |= (read[first[has] + i] & 127).astype(np.int64) << (7 * i)
    return out


def _unbeaten(block: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the pairs that no other pair of their block beats, by block and size: a higher frequency in a field not longer."""
    order = np.lexsort((-tf, size, block))
    height = block[order].astype(np.int64) * (int(tf.max(initial=0)) + 1) + tf[order]
    before = np.concatenate([[-1], np.maximum.accumulate(height)[:-1]])
    return order[height > before]


def _impacts(tf: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of one block."""
    kept = _unbeaten(np.zeros(len(tf), np.int64), tf, size)
    return list(zip(tf[kept].tolist(), size[kept].tolist()))


def _binary(content: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(content)])


def _blocks(part: int, window: int, rows: pa.Table, fields: list[str], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of a window: its keys and lengths, then the terms of each field."""
    heads = [(KEYS, LENGTHS, rows.num_rows, 0, None, rows[key].to_pylist())]
    found = []
    for field in fields:
        tokens = rows[field].combine_chunks()
        size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths, _ = varint(size)
        heads.append((field, LENGTHS, int((size > 0).sum()), int(size.sum()), lengths.tobytes(), None))
        if size.sum():
            found.append(_terms(part, window, field, tokens.flatten().dictionary_encode(), size))
    column = [pa.array(c, t) for c, t in zip(zip(*heads), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string())))]
    field, term, n, total, tfs, keys = column
    yield _rows(part, window, field, term, n, total, None, None, tfs, keys)
    yield from found


def _terms(part: int, window: int, field: str, tokens: pa.DictionaryArray, size: np.ndarray) -> pa.RecordBatch:
    code = tokens.indices.to_numpy().astype(np.int64)
    place, tf = np.unique(code * WINDOW + np.repeat(np.arange(len(size)), size), return_counts=True)
    term, doc = place // WINDOW, place % WINDOW
    first = np.concatenate([[True], term[1:] != term[:-1]])
    gap = doc - np.where(first, 0, np.concatenate([[0], doc[:-1]]))
    docs, doc_at = varint(gap)
    tfs, tf_at = varint(tf)
    edges = np.append(np.flatnonzero(first), len(term))
    count, block = len(edges) - 1, np.cumsum(first) - 1
    kept = _unbeaten(block, tf, size[doc])
    pairs = pa.StructArray.from_arrays([pa.array(tf[kept], pa.int32()), pa.array(size[doc[kept]], pa.int32())], ["tf", "size"])
    impacts = pa.ListArray.from_arrays(pa.array(np.searchsorted(block[kept], np.arange(count + 1)), pa.int32()), pairs)
    names = tokens.dictionary.take(pa.array(term[edges[:-1]]))
    n, total = pa.array(np.diff(edges), pa.int32()), pa.array(np.zeros(count, np.int64))
    return _rows(part, window, pa.array([field] * count), names, n, total, impacts, _binary(docs, doc_at[edges]), _binary(tfs, tf_at[edges]), None)


def _rows(part: int, window: int, field, term, n, total, impacts, docs, tfs, keys) -> pa.RecordBatch:
    types = {"impacts": pa.list_(pa.struct([("tf", pa.int32()), ("size", pa.int32())])), "docs": pa.binary(), "keys": pa.list_(pa.string())}
    columns = {
        "part": pa.array(np.full(len(field), part, np.int64)), "window": pa.array(np.full(len(field), window, np.int32)),
        "field": field, "term": term, "n": n, "total": total, "impacts": impacts, "docs": docs, "tfs": tfs, "keys": keys,
    }
    return pa.RecordBatch.from_pydict({name: pa.nulls(len(field), types[name]) if c is None else c for name, c in columns.items()})


def write_postings(rows: DataFrame, fields: list[str], folder: str, key: str = "chunk_id") -> None:
    """Postings of the text columns ``fields``; sorted by term, so that a search skips the row groups of others."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, window, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= WINDOW:
                yield from _blocks(own + window // PART, window % PART, held.slice(0, WINDOW), fields, key)
                held, window = held.slice(WINDOW), window + 1
        if held is not None and held.num_rows:
            yield from _blocks(own + window // PART, window % PART, held, fields, key)

    tokens = rows.select(F.col(key), *[fold_tokens(F.col(f)).alias(f) for f in fields])
    tokens.mapInArrow(build, SCHEMA).sortWithinPartitions("term", "field", "part", "window").write.parquet(folder)
