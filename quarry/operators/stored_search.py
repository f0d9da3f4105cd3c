"""Text search over the stored postings of the chunk index.

The scores are those of ``bm25_match`` over the visible chunks. A window of rows is decoded only if the largest
scores of its blocks can bring one of its rows among a question's best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators import retrieval
from quarry.operators.retrieval import FIELD_BOOSTS, K1, B, TOP_K, _BestText, _offer_text, _ranked, _slot_table, query_terms
from quarry.session import BROADCAST_ROWS, broadcast_if_small
from quarry.sources.chunk_table import stored_rows, visible
from quarry.sources.manifest import Entry, Manifest, read_manifest
from quarry.sources.postings import KEYS, LENGTHS, SCHEMA, numbers

# Terms that are named to the scan of the postings, which then skips what lies between them; of more, a join selects.
NAMED_TERMS = 5_000


def _postings(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    # A column of the scan, so that terms are selected before folders are named.
    path = F.substring_index(F.col("_metadata.file_path"), "/", -2)
    return spark.read.schema(SCHEMA).parquet(*[e.postings for e in entries]).withColumn("folder", F.substring_index(path, "/", 1))


def _statistics(blocks: DataFrame, hidden: DataFrame | None, boosts: dict[str, float], names: list[str]) -> dict[str, tuple[np.ndarray, float]]:
    """Boosted idf of each term and mean length, per field: sums over blocks, less what hidden rows add."""
    counted = blocks.where(F.col("field") != KEYS).groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("total").alias("total")).toPandas()
    slot = {name: i for i, name in enumerate(names)}
    df = {f: np.zeros(len(names)) for f in boosts}
    docs, total = dict.fromkeys(boosts, 0.0), dict.fromkeys(boosts, 0.0)
    for field, term, n, size in counted.itertuples(index=False):
        if term == LENGTHS:
            docs[field], total[field] = n, size
        elif term in slot:
            df[field][slot[term]] = n
    if hidden is not None:
        for field, (gone, gone_docs, gone_total) in retrieval.field_counts(hidden, boosts, names).items():
            df[field] -= gone
            docs[field] -= gone_docs
            total[field] -= gone_total
    out = {}
    for field, boost in boosts.items():
        mean = total[field] / docs[field] if docs[field] else 1.0
        out[field] = (boost * np.log1p(np.maximum(docs[field] - df[field] + 0.5, 0.5) / (df[field] + 0.5)), mean)
    return out


def _array(rows: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(rows[name].chunks) if rows[name].num_chunks else pa.array([], rows[name].type)


def _at(column: pa.Array, values: list[str]) -> np.ndarray:
    """Place of each entry among the values, -1 for others."""
    return pc.fill_null(pc.index_in(column, pa.array(values, pa.string())), -1).to_numpy(zero_copy_only=False)


def _content(column: pa.Array, places: np.ndarray) -> np.ndarray:
    """The numbers of several binary entries, one after the other."""
    taken = column.take(pa.array(places))
    _, starts, content = taken.buffers()
    starts = np.frombuffer(starts, np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return numbers(np.frombuffer(content, np.uint8)[starts[0] : starts[-1]])


class _Part:
    """The windows of a part with the blocks of the asked terms."""

    def __init__(self, rows: pa.Table, terms: pd.Index, weights: dict[str, tuple[np.ndarray, float]]):
        self.idf = np.stack([idf for idf, _ in weights.values()])
        self.mean = np.array([mean for _, mean in weights.values()])
        window, field, term = (_array(rows, c) for c in ("window", "field", "term"))
        window, of_field, slot = window.to_numpy(), _at(field, list(weights)), _at(term, list(terms))
        marks, keyed = pc.equal(term, LENGTHS).to_numpy(zero_copy_only=False), pc.equal(field, KEYS).to_numpy(zero_copy_only=False)
        keys, hidden, self.docs, self.tfs = (_array(rows, c) for c in ("keys", "hidden", "docs", "tfs"))
        heads = np.flatnonzero(marks & keyed)
        self.keys = {window[i]: np.asarray(keys[i].as_py(), dtype=object) for i in heads}
        self.gone = {window[i]: np.asarray(hidden[i].as_py()) for i in heads if hidden[i].is_valid}
        self.lengths = {(window[i], of_field[i]): i for i in np.flatnonzero(marks & ~keyed & (of_field >= 0))}
        self.at = np.flatnonzero(~marks & (slot >= 0) & (of_field >= 0))
        self.at = self.at[np.argsort(window[self.at], kind="stable")]
        self.field, self.slot = of_field[self.at], slot[self.at]
        self.n = _array(rows, "n").to_numpy()[self.at]
        self.most = self._most(_array(rows, "impacts").take(pa.array(self.at)))
        own, first = np.unique(window[self.at], return_index=True)
        self.of = {w: slice(low, high) for w, low, high in zip(own, first, [*first[1:], len(self.at)])}

    def _parts(self, field: np.ndarray, slot: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[field, slot] * tf / (tf + K1 * (1 - B + B * size / self.mean[field]))

    def _most(self, impacts: pa.ListArray) -> np.ndarray:
        """The largest score part of each block."""
        if not len(impacts):
            return np.zeros(0)
        count = pc.list_value_length(impacts).to_numpy(zero_copy_only=False)
        tf, size = (x.to_numpy(zero_copy_only=False) for x in impacts.flatten().flatten())
        parts = self._parts(np.repeat(self.field, count), np.repeat(self.slot, count), tf, size)
        return np.maximum.reduceat(parts, np.cumsum(count) - count)

    def bound(self, window: int, table: tuple[np.ndarray, ...]) -> np.ndarray:
        """The largest score any row of the window may have, per question."""
        ids, starts, query, weight = table
        at = self.of.get(window)
        if at is None:
            return np.zeros(len(ids))
        slot = self.slot[at]
        runs = starts[slot + 1] - starts[slot]
        places = np.arange(runs.sum()) + np.repeat(starts[slot] - np.cumsum(runs) + runs, runs)
        return np.bincount(query[places], np.repeat(self.most[at], runs) * weight[places], len(ids))

    def decode(self, window: int, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Row, slot and score part of the postings of the needed terms."""
        own = self.of[window]
        kept = np.flatnonzero(needed[self.slot[own]]) + own.start
        n = self.n[kept]
        gap, tf = _content(self.docs, self.at[kept]), _content(self.tfs, self.at[kept])
        first = np.cumsum(n) - n
        row = np.cumsum(gap)
        row = row - np.repeat(row[first] - gap[first], n)
        field, slot = np.repeat(self.field[kept], n), np.repeat(self.slot[kept], n)
        size = np.zeros(len(row), np.int64)
        for f in np.unique(self.field[kept]):
            lengths = _content(self.tfs, np.array([self.lengths[window, f]]))
            size[field == f] = lengths[row[field == f]]
        return row, slot, self._parts(field, slot, tf, size), len(kept)


def stored_search(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    k: int = TOP_K,
    boosts: dict[str, float] | None = None,
    manifest: Manifest | None = None,
    limit: int = BROADCAST_ROWS,
    decoded: Accumulator | None = None,
) -> DataFrame:
    """Best ``k`` chunks per question by the postings that ``append_batch(..., fields=...)`` wrote: ``bm25_search`` of ``read_index``.

    Only blocks of asked terms are read. A task searches a part of up to 64 windows: the window with the largest bound
    first, and none whose bound is below the k-th score of every question. Terms of the questions are sent to all tasks; with
    more than ``limit`` of them the questions are searched in blocks. Chunks that deletions or later batches hide are left
    out, and out of the statistics. ``decoded`` counts the blocks that were decoded.
    """
    boosts = boosts or FIELD_BOOSTS
    at = manifest or read_manifest(spark, root)
    entries = at.of("chunks")
    if lacking := [e.batch for e in entries if not e.postings]:
        raise ValueError(f"batches without postings: {lacking[:5]}; write them with fields, or compact with fields")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType())])
    nothing = _ranked(spark.createDataFrame([], schema), k, "chunk_id")
    asked = query_terms(queries).limit(limit + 1).toPandas()
    if len(asked) > limit:
        if asked["query_id"].nunique() > 1 or queries.select("query_id").distinct().count() > 1:
            blocks = 2 * -(-query_terms(queries).count() // limit)
            dealt = F.pmod(F.xxhash64("query_id", F.lit(len(asked) + blocks)), F.lit(blocks))
            found = nothing
            for block in range(blocks):
                found = found.unionByName(stored_search(spark, root, queries.where(dealt == block), k, boosts, at, limit, decoded))
            return found
        asked = query_terms(queries).toPandas()
    if asked.empty or not entries:
        return nothing
    asked["slot"], names = pd.factorize(asked["term"])
    names = list(names)
    table = _slot_table(asked, len(names))
    read = _postings(spark, entries)
    if len(names) <= NAMED_TERMS:
        blocks = read.where(F.col("term").isin([*names, LENGTHS]))
    else:
        wanted = spark.createDataFrame([(n,) for n in [*names, LENGTHS]], "term string")
        blocks = read.join(F.broadcast(wanted), "term", "left_semi")  # a row per question term, whose number is checked
    hidden = None
    if at.of("deleted") or at.of("replaced"):
        hidden = stored_rows(spark, entries).join(visible(spark, at, entries).select("entry", "chunk_id"), ["entry", "chunk_id"], "left_anti")
    weights = _statistics(blocks, hidden, boosts, names)
    sent = spark.sparkContext.broadcast((pd.Index(names), weights, table))
    if hidden is not None:
        blocks = blocks.join(broadcast_if_small(_places(read, hidden, entries)), ["folder", "part", "window"], "left")
    else:
        blocks = blocks.withColumn("hidden", F.lit(None).cast("array<int>"))

    found_as = to_arrow_schema(schema)

    def search(rows: pa.Table) -> pa.Table:
        terms, weights, table = sent.value
        part = _Part(rows, terms, weights)
        best = _BestText(table[0], k, "chunk_id")
        bounds = {w: part.bound(w, table) for w in part.keys}
        ids, starts, query, _ = table
        slot_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for window in sorted(bounds, key=lambda w: -bounds[w].max(initial=0.0)):
            # A score is rounded before it is compared, so a bound just below the k-th one does not rule it out.
            wants = (bounds[window] > 0) & (bounds[window] + 1e-6 >= best.floor)
            if not wants.any():
                continue
            needed = np.bincount(slot_of, wants[query], len(starts) - 1) > 0
            row, slot, score, count = part.decode(window, needed)
            if decoded is not None:
                decoded.add(count)
            if window in part.gone:
                left = ~np.isin(row, part.gone[window])
                row, slot, score = row[left], slot[left], score[left]
            keys = part.keys[window]
            for _ in _offer_text(best, keys, [None] * len(keys), row, slot, score, table):
                pass
            best.shrink()
        out = list(best.rows())
        return pa.Table.from_pandas(out[0], found_as, preserve_index=False) if out else found_as.empty_table()

    return _ranked(blocks.groupBy("folder", "part").applyInArrow(search, schema), k, "chunk_id")


def _places(read: DataFrame, hidden: DataFrame, entries: list[Entry]) -> DataFrame:
    """Row numbers of the hidden chunks by window."""
    folders = read.sparkSession.createDataFrame([(e.folder.rsplit("/", 1)[-1], e.postings.rsplit("/", 1)[-1]) for e in entries], "entry string, folder string")
    keys = read.where((F.col("term") == LENGTHS) & (F.col("field") == KEYS)).select("folder", "part", "window", F.posexplode("keys").alias("at", "chunk_id"))
    gone = hidden.select("entry", "chunk_id").join(F.broadcast(folders), "entry")  # a row per entry of the manifest
    return keys.join(gone.select("folder", "chunk_id"), ["folder", "chunk_id"]).groupBy("folder", "part", "window").agg(F.collect_list("at").alias("hidden"))
