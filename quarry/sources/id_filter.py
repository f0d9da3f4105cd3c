"""Bloom filters of ids, written beside a batch: which batches may hold a given id.

Ids are dealt by hash into segments of a bounded number of ids, each with a filter of a fixed size, so that a
batch of any size has filters of a size its tasks can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import BROADCAST_ROWS

# Ids of a segment, bits of its filter and bits set by an id: about one id in 2 000 is taken for a held one.
SEGMENT_IDS = 65_536
BITS = 1 << 20
PROBES = 8

SCHEMA = "segment long, segments long, bits binary"


def _hashes(name: str) -> list[Column]:
    return [F.xxhash64(name).alias("h0"), F.xxhash64(name, F.lit(1)).alias("h1")]


def _places(h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """The bits of each id, one row each."""
    with np.errstate(over="ignore"):
        steps = h1.astype(np.uint64)[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)[None, :]
        return ((h0.astype(np.uint64)[:, None] + steps) >> np.uint64(13)) % np.uint64(BITS)


def write_filters(ids: DataFrame, name: str, rows: int, folder: str) -> None:
    """Filters of the distinct values of column ``name``, of which there are at most ``rows``."""
    segments = max(1, -(-rows // SEGMENT_IDS))
    # A segment is told by bits that do not place its ids within the filter.
    hashed = ids.where(F.col(name).isNotNull()).select(*_hashes(name)).distinct().withColumn("segment", F.pmod(F.xxhash64("h0"), F.lit(segments)))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(BITS, bool)
        bits[_places(table.column("h0").to_numpy(), table.column("h1").to_numpy()).ravel()] = True
        return pa.table({"segment": [key[0].as_py()], "segments": pa.array([segments], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    hashed.groupBy("segment").applyInArrow(make, SCHEMA).write.parquet(folder)


def may_hold(spark: SparkSession, folders: list[str], ids: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> list[str]:
    """Those of the filter folders whose batch may hold one of the ids.

    Up to ``limit`` ids are sent to the tasks that read the filters; for more, every batch is taken to hold one.
    """
    asked = ids.where(F.col(name).isNotNull()).select(*_hashes(name), F.xxhash64(F.xxhash64(name)).alias("s")).distinct().limit(limit + 1).toPandas()
    if len(asked) > limit:
        return folders
    if asked.empty or not folders:
        return []
    h0, h1, s = (asked[c].to_numpy() for c in ("h0", "h1", "s"))
    sent = spark.sparkContext.broadcast((_places(h0, h1), s))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, s = sent.value
        for batch in batches:
            found = []
            for segment, segments, content in zip(batch.column("segment").to_pylist(), batch.column("segments").to_pylist(), batch.column("bits"), strict=True):
                own = places[np.mod(s, segments) == segment]
                bits = np.unpackbits(np.frombuffer(content.as_py(), np.uint8))
                found.append(bool(len(own)) and bool(bits[own.astype(np.int64)].all(1).any()))
            yield pa.record_batch([batch.column("folder").filter(pa.array(found, pa.bool_()))], names=["folder"])

    # A folder is told by the last two names of the path of its files.
    read = spark.read.schema(SCHEMA).parquet(*folders).withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)/[^/]+$", 1))
    hit = {r["folder"] for r in read.mapInArrow(probe, "folder string").distinct().collect()}
    return [f for f in folders if "/".join(f.split("/")[-2:]) in hit]
