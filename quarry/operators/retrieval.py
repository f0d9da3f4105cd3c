"""Ranking chunks for a table of questions: BM25, cosine, hybrid, TF-IDF.

Questions are a DataFrame with ``query_id`` and ``question``; the index has
``chunk_id``, ``chunk_text``, ``title`` and ``embedding``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.text import fold_tokens
from quarry.session import BROADCAST_ROWS, broadcast_if_small, durable, is_small, stored

# Field weights, vector weight, hit count and BM25 constants.
FIELD_BOOSTS = {"chunk_text": 5.0, "title": 3.0}
VECTOR_BOOST = 0.3
TOP_K = 10
K1 = 1.2
B = 0.75
EMBED_BATCH = 100

# Digits that order hits; beyond them a sum depends on its order.
SCORE_DIGITS = 6

# Stand for the rows that carry only a field's length.
NO_TERM = ""
NO_SLOT = -1

# Questions sent to every task; beyond that, questions and vectors that meet in
# one task; questions multiplied at a time.
BROADCAST_QUESTIONS = 4096
BLOCK_QUESTIONS = 4096
SLICE_VECTORS = 65_536
QUESTION_STRIP = 256

# Cells of the score matrix a task holds at a time.
STRIP_CELLS = 2_000_000

# Scores that leave a task at a time, and rows it holds to pick the best of them.
BATCH_PAIRS = 1 << 17
HELD_ROWS = 1 << 17


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, weight``; a repeated term counts as often as it occurs."""
    terms = queries.select("query_id", F.explode(fold_tokens(F.col("question"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def _tokens(index: DataFrame, fields: list[str], key: str) -> DataFrame:
    """``key, field, size, term``: one row per token of each field.

    Another row per field has the empty term. It survives any selection of
    terms, so that field lengths need no pass of their own.
    """
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), fold_tokens(F.col(f)).alias("tokens")) for f in fields])
    tokens = index.select(key, F.inline(per_field))
    return tokens.select(key, "field", F.size("tokens").alias("size"), F.explode(F.concat("tokens", F.array(F.lit(NO_TERM)))).alias("term"))


def postings(index: DataFrame, fields: list[str], terms: DataFrame, small: bool, key: str = "chunk_id") -> DataFrame:
    """``key, field, size, term, tf`` of the asked and the empty term, in one pass over the index.

    Tokens that nobody asks for are dropped before the shuffle. The shuffle is
    by ``key`` alone, so the later sum over (query, key) needs no other one
    and a frequent term is spread over all partitions.
    """
    marker = terms.sparkSession.createDataFrame([(NO_TERM,)], "term string")
    asked = terms.select("term").distinct().union(marker)
    return (
        _tokens(index, fields, key)
        .join(F.broadcast(asked) if small else asked, "term", "left_semi")
        .repartition(key)
        .groupBy(key, "field", "size", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def bm25_match(
    index: DataFrame, queries: DataFrame, boosts: dict[str, float] | None = None, key: str = "chunk_id", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Sum of the boosted field scores: ``query_id, key, score``.

    Per field and term it is idf * tf / (tf + norm). Rows without any term of
    a question get no score.
    """
    boosts = boosts or FIELD_BOOSTS

    def weigh(counts: dict[str, tuple[np.ndarray, float, float]]) -> dict[str, tuple[np.ndarray, float]]:
        return _boosted_weights(counts, boosts)

    return _every_score(index, queries, list(boosts), key, weigh, True, limit)


def _every_score(
    index: DataFrame,
    queries: DataFrame,
    fields: list[str],
    key: str,
    weigh: Callable[[dict[str, tuple[np.ndarray, float, float]]], dict[str, tuple[np.ndarray, float]]],
    saturated: bool,
    limit: int,
) -> DataFrame:
    """The score of every row that has a term of a question; a task adds up those of its own rows, and nothing is shuffled.

    Question terms are sent to all tasks as in ``bm25_candidates``. Only rows whose key is null or comes again are brought
    together, as their frequencies are one. ``weigh`` makes idf and mean length out of the counts of each field.
    """
    spark = index.sparkSession
    terms = query_terms(queries)
    asked = terms.limit(limit + 1).toArrow()
    if asked.num_rows > limit:
        if queries.select("query_id").distinct().count() > 1:
            return _in_blocks(queries, limit, lambda some: _every_score(index, some, fields, key, weigh, saturated, limit))
        asked = terms.toArrow()  # the terms of one question
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField(key, index.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not asked.num_rows:
        return spark.createDataFrame([], schema)
    slot, query = (asked[c].combine_chunks().dictionary_encode("encode") for c in ("term", "query_id"))
    names = slot.dictionary.to_pylist()
    order = np.argsort(slot.indices.to_numpy(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(slot.indices.to_numpy(), minlength=len(names)))])
    table = (query.dictionary, starts, query.indices.to_numpy()[order], asked["weight"].to_numpy()[order].astype(np.float64))
    single, rest = _apart(index, key)
    counts = field_counts(single, fields, names)
    if rest is not None:
        found = postings(rest, fields, terms, True, key)
        counts = _added(counts, found, names)
    weights = weigh(counts)
    sent = spark.sparkContext.broadcast((names, weights, table))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, table = sent.value
        values = pa.array(names, pa.string())
        for batch in batches:
            found = [_field_parts(batch.column(f), values, *weights[f], saturated) for f in fields]
            row, slot, part = (np.concatenate(column) for column in zip(*found))
            yield from _every_pair(batch.column(key), row, slot, part, table, key)

    scores = single.select(key, *[fold_tokens(F.col(f)).alias(f) for f in fields]).mapInArrow(scan, schema)
    if rest is None:
        return scores
    rows = [(f, name, float(idf[i]), float(mean)) for f, (idf, mean) in weights.items() for i, name in enumerate(names)]
    weighted = spark.createDataFrame(rows, "field string, term string, idf double, mean_size double")  # a row per field and question term
    again = found.join(F.broadcast(weighted), ["field", "term"]).join(F.broadcast(terms), "term").groupBy("query_id", key)
    part = F.col("weight") * F.col("idf") * (_saturation() if saturated else F.col("tf"))
    return scores.unionByName(again.agg(F.sum(part).alias("score")))


def _apart(index: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the others, if there are any. Keys alone are compared."""
    repeated = index.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or _again is null").select("_again")
    if repeated.isEmpty():
        return index, None
    repeated, same = broadcast_if_small(repeated), F.col(key).eqNullSafe(F.col("_again"))
    return index.join(repeated, same, "left_anti"), index.join(repeated, same, "left_semi")


def _added(counts: dict[str, tuple[np.ndarray, float, float]], found: DataFrame, names: list[str]) -> dict[str, tuple[np.ndarray, float, float]]:
    """Counts with those of ``postings`` added."""
    more = found.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.count_if(F.col("size") > 0).alias("docs"), F.sum("size").alias("total")
    ).toPandas()  # a row per field and question term
    out = {}
    for field, (df, docs, total) in counts.items():
        mine = more[more["field"] == field].set_index("term")
        df = df + mine["df"].reindex(names, fill_value=0).to_numpy(dtype=np.float64)
        out[field] = (df, docs + float(mine["docs"].get(NO_TERM, 0)), total + float(mine["total"].get(NO_TERM, 0)))
    return out


def _every_pair(
    keys: pa.Array, row: np.ndarray, slot: np.ndarray, part: np.ndarray, table: tuple, key: str
) -> Iterator[pa.RecordBatch]:
    """The score of each row for each query it has a term of, in batches of a bounded size."""
    ids, starts, query, weight = table
    order = np.argsort(row, kind="stable")
    row, slot, part = row[order], slot[order], part[order]
    strip = max(BATCH_PAIRS // len(ids), 1)
    for first in range(0, len(keys), strip):
        count = min(strip, len(keys) - first)
        low, high = np.searchsorted(row, [first, first + count])
        runs = starts[slot[low:high] + 1] - starts[slot[low:high]]
        at = np.arange(runs.sum()) + np.repeat(starts[slot[low:high]] - np.cumsum(runs) + runs, runs)
        cell = np.repeat(row[low:high] - first, runs) * len(ids) + query[at]
        sums = np.bincount(cell, np.repeat(part[low:high], runs) * weight[at], count * len(ids))
        met = np.zeros(len(sums), bool)  # a sum may be 0
        met[cell] = True
        pairs = np.flatnonzero(met)
        if len(pairs):
            columns = [ids.take(pa.array(pairs % len(ids))), keys.take(pa.array(first + pairs // len(ids))), pa.array(sums[pairs])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", key, "score"])


def _saturation() -> Column:
    return F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))


def bm25_candidates(
    index: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    boosts: dict[str, float] | None = None,
    key: str = "chunk_id",
    also: DataFrame | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Scores of ``bm25_match`` for each query's best ``k`` rows at least.

    ``also`` names further (query_id, key) pairs whose score is wanted. Up to
    ``limit`` question terms, with their frequencies in the corpus, are sent to
    all tasks. A task adds up the scores of a strip of rows in a matrix, keeps its
    best ``k`` per query and emits them once: neither the tokens nor the many rows that
    share only a common term with a question are ever shuffled. Texts are cut into tokens
    once: the asked terms of each row are stored and read for the frequencies in the corpus and for the scores. Questions with
    more terms than ``limit`` are dealt into blocks, each with a scan of its own, so
    that the output is bounded alike for any number of questions.
    """
    boosts = boosts or FIELD_BOOSTS
    fields = list(boosts)
    spark = index.sparkSession
    asked = query_terms(queries).limit(limit + 1).toPandas()
    if len(asked) > limit:
        if asked["query_id"].nunique() > 1 or queries.select("query_id").distinct().count() > 1:
            return _in_blocks(queries, limit, lambda some: bm25_candidates(index, some, k, boosts, key, also, limit))
        asked = query_terms(queries).toPandas()  # the terms of one question
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField(key, index.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if asked.empty:
        return spark.createDataFrame([], schema)
    asked["slot"], names = pd.factorize(asked["term"])
    table = _slot_table(asked, len(names))
    rows = stored(_counted(index, fields, list(names), key), "counted")
    weights = _boosted_weights(_summed_counts(rows, fields, list(names), _counts_of), boosts)
    sent = spark.sparkContext.broadcast((weights, table))
    if also is None:
        rows = rows.withColumn("_wanted", F.array().cast(T.ArrayType(schema["query_id"].dataType)))
    else:
        pairs = also.groupBy(F.col(key).alias("_key")).agg(F.collect_set("query_id").alias("_wanted"))
        rows = rows.join(broadcast_if_small(pairs), "_key", "left")
    found_as = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, table = sent.value
        best = _BestText(table[0], k, key)

        def rows_of(found: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            return (pa.RecordBatch.from_pandas(rows, found_as, preserve_index=False) for rows in found)

        for batch in batches:
            found = [_parts_of(*_counts_of(batch, i), *weights[f]) for i, f in enumerate(fields)]
            row, slot, part = (np.concatenate(column) for column in zip(*found))
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            yield from rows_of(_offer_text(best, keys, batch.column("_wanted").to_pylist(), row, slot, part, table))
        yield from rows_of(best.rows())

    return rows.mapInArrow(scan, schema)


def _in_blocks(queries: DataFrame, limit: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A search in blocks of questions, about half as many terms in each as may be sent.

    Blocks that come out larger are dealt again, by another hash.
    """
    total = query_terms(queries).count()
    blocks = 2 * -(-total // limit)
    block = F.pmod(F.xxhash64("query_id", F.lit(total)), F.lit(blocks))
    return reduce(DataFrame.unionByName, [search(queries.filter(block == b)) for b in range(blocks)])


def _counted(index: DataFrame, fields: list[str], names: list[str], key: str) -> DataFrame:
    """``_key`` of each row and, per field, its number of tokens and the asked terms it has with their frequencies."""
    sent = index.sparkSession.sparkContext.broadcast(names)
    columns = [T.StructField("_key", index.schema[key].dataType)]
    for i in range(len(fields)):
        columns.append(T.StructField(f"size{i}", T.LongType()))
        columns += [T.StructField(f"{kind}{i}", T.ArrayType(T.IntegerType())) for kind in ("slot", "tf")]
    schema = T.StructType(columns)
    titles = schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(sent.value, pa.string())
        for batch in batches:
            made = [batch.column(0)]
            for i in range(len(fields)):
                row, slot, tf, size = _slots(batch.column(i + 1), values)
                edges = pa.array(np.searchsorted(row, np.arange(len(size) + 1)), pa.int32())
                made += [pa.array(size), *(pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (slot, tf))]
            yield pa.RecordBatch.from_arrays(made, titles)

    tokens = [fold_tokens(F.col(f)).alias(f"tokens{i}") for i, f in enumerate(fields)]
    return index.select(F.col(key).alias("_key"), *tokens).mapInArrow(count, schema)


def _counts_of(batch: pa.RecordBatch, i: int, _: pa.Array | None = None) -> tuple[np.ndarray, ...]:
    """What ``_slots`` found for field ``i`` of rows of ``_counted``."""
    slots, tfs = batch.column(f"slot{i}"), batch.column(f"tf{i}")
    row = np.repeat(np.arange(len(slots)), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
    slot, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (slots, tfs))
    return row, slot, tf, batch.column(f"size{i}").to_numpy(zero_copy_only=False)


def field_counts(index: DataFrame, fields: Iterable[str], names: list[str]) -> dict[str, tuple[np.ndarray, float, float]]:
    """Per field: rows with each term, rows that are not empty, and their tokens."""
    fields = list(fields)
    tokens = index.select(*[fold_tokens(F.col(f)).alias(f) for f in fields])
    return _summed_counts(tokens, fields, names, lambda batch, i, values: _slots(batch.column(i), values))


def _summed_counts(
    rows: DataFrame, fields: list[str], names: list[str], found_in: Callable[[pa.RecordBatch, int, pa.Array], tuple[np.ndarray, ...]]
) -> dict[str, tuple[np.ndarray, float, float]]:
    """``field_counts`` of rows in whose batches ``found_in`` finds row, slot, frequency and the rows' sizes of a field.

    A task counts in arrays of a place per question term and emits them once.
    """
    sent = rows.sparkSession.sparkContext.broadcast(list(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(sent.value, pa.string())
        df = {f: np.zeros(len(values), np.int64) for f in fields}
        docs, total = dict.fromkeys(fields, 0), dict.fromkeys(fields, 0)
        for batch in batches:
            for i, f in enumerate(fields):
                _, slot, _, size = found_in(batch, i, values)
                df[f] += np.bincount(slot, minlength=len(values))
                docs[f] += int((size > 0).sum())
                total[f] += int(size.sum())
        for f in fields:
            held = np.flatnonzero(df[f])
            none = np.zeros(len(held), np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "field": [f] * (len(held) + 1),
                    "slot": pa.array([NO_SLOT, *held.tolist()], pa.int32()),
                    "df": pa.array([0, *df[f][held].tolist()], pa.int64()),
                    "docs": pa.array([docs[f], *none], pa.int64()),
                    "total": pa.array([total[f], *none], pa.int64()),
                }
            )

    counted = (
        rows.mapInArrow(count, "field string, slot int, df long, docs long, total long")
        .groupBy("field", "slot")
        .agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"), F.sum("total").alias("total"))
        .toPandas()
    )
    found = {}
    for field in fields:
        mine = counted[counted["field"] == field].set_index("slot")
        df = mine["df"].reindex(range(len(names)), fill_value=0).to_numpy(dtype=np.float64)
        found[field] = (df, float(mine["docs"].get(NO_SLOT, 0)), float(mine["total"].get(NO_SLOT, 0)))
    return found


def _boosted_weights(counts: dict[str, tuple[np.ndarray, float, float]], boosts: dict[str, float]) -> dict[str, tuple[np.ndarray, float]]:
    """Boosted idf of each term and mean length, per field."""
    weights = {}
    for field, (df, docs, total) in counts.items():
        mean = total / docs if docs else 1.0
        weights[field] = (boosts[field] * np.log1p(np.maximum(docs - df + 0.5, 0.5) / (df + 0.5)), mean)
    return weights


def _slot_table(asked: pd.DataFrame, slots: int) -> tuple[np.ndarray, ...]:
    """Query ids, and for each slot the run of its queries with their weights."""
    query, ids = pd.factorize(asked["query_id"])
    order = np.argsort(asked["slot"].to_numpy(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(asked["slot"], minlength=slots))])
    return np.asarray(ids), starts, query[order], asked["weight"].to_numpy(dtype=np.float64)[order]


def _slots(tokens: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, slot and frequency of each distinct asked term of each row, and the rows' sizes."""
    size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = pc.fill_null(pc.index_in(tokens.flatten(), terms), NO_SLOT).to_numpy(zero_copy_only=False).astype(np.int64)
    known = slot >= 0
    code, tf = np.unique(np.repeat(np.arange(len(size)), size)[known] * len(terms) + slot[known], return_counts=True)
    return code // len(terms), code % len(terms), tf, size


def _field_parts(tokens: pa.ListArray, terms: pa.Array, idf: np.ndarray, mean: float, saturated: bool = True) -> tuple[np.ndarray, ...]:
    """Row, slot and score part of each distinct asked term of each row."""
    return _parts_of(*_slots(tokens, terms), idf, mean, saturated)


def _parts_of(row: np.ndarray, slot: np.ndarray, tf: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float, saturated: bool = True) -> tuple[np.ndarray, ...]:
    return row, slot, idf[slot] * (tf / (tf + K1 * (1 - B + B * size[row] / mean)) if saturated else tf)


class _BestText:
    """The best ``k`` rows per query that a task has seen; ties go to the smaller key."""

    def __init__(self, ids: np.ndarray, k: int, key: str):
        self.ids, self.k, self.key = ids, k, key
        # The k-th best rounded score of each query, 0 while it has fewer rows.
        self.floor = np.zeros(len(ids))
        self.held: list[pd.DataFrame] = []
        self.size = 0

    def offer(self, query: np.ndarray, keys: np.ndarray, score: np.ndarray, ranked: np.ndarray, sent: np.ndarray) -> None:
        """Rows that may be among the best; ``sent`` marks those that have left already."""
        self.held.append(pd.DataFrame({"q": query, self.key: keys, "s": score, "r": ranked, "sent": sent}))
        self.size += len(query)
        if self.size > 2 * self.k * len(self.ids) + STRIP_CELLS // 100:
            self.shrink()

    def shrink(self) -> None:
        if not self.held:
            return
        rows = pd.concat(self.held).sort_values(["q", "r", self.key], ascending=[True, False, True])
        rows = rows.groupby("q").head(self.k)
        last = rows.groupby("q")["r"].agg(["size", "last"])
        full = last[last["size"] == self.k]
        self.floor[full.index.to_numpy(np.int64)] = full["last"].to_numpy()
        self.held, self.size = [rows], len(rows)

    def rows(self) -> Iterator[pd.DataFrame]:
        if self.held:
            self.shrink()
            left = self.held[0][~self.held[0]["sent"].to_numpy(bool)]
            yield pd.DataFrame({"query_id": self.ids[left["q"].to_numpy(np.int64)], self.key: left[self.key].to_numpy(), "score": left["s"].to_numpy()})


def _offer_text(
    best: _BestText, keys: np.ndarray, wanted: list, row: np.ndarray, slot: np.ndarray, part: np.ndarray, table: tuple[np.ndarray, ...]
) -> Iterator[pd.DataFrame]:
    """Score rows in strips of a bounded matrix, offer what may be among the best and yield the wanted pairs."""
    ids, starts, query, weight = table
    k, key = best.k, best.key
    column_of = {q: c for c, q in enumerate(ids.tolist())}
    order = np.argsort(row, kind="stable")
    row, slot, part = row[order], slot[order], part[order]
    strip = max(STRIP_CELLS // len(ids), 1)
    for first in range(0, len(keys), strip):
        count = min(strip, len(keys) - first)
        low, high = np.searchsorted(row, [first, first + count])
        runs = starts[slot[low:high] + 1] - starts[slot[low:high]]
        # Position of every (part, query of its term) pair in the slot table.
        at = np.arange(runs.sum()) + np.repeat(starts[slot[low:high]] - np.cumsum(runs) + runs, runs)
        cell = np.repeat(row[low:high] - first, runs) * len(ids) + query[at]
        sums = np.bincount(cell, np.repeat(part[low:high], runs) * weight[at], count * len(ids))
        sums = sums.reshape(count, len(ids))
        ranked = np.round(sums, SCORE_DIGITS)
        floor = np.maximum(best.floor, np.partition(ranked, -k, axis=0)[-k]) if count > k else best.floor
        asked = [
            (p, column_of[q])
            for p, names in enumerate(wanted[first : first + count])
            for q in (names if names is not None else ())
            if q in column_of
        ]
        sent = np.zeros(sums.shape, bool)
        if asked:
            p, q = np.array(asked).T
            sent[p, q] = sums[p, q] > 0
            p, q = np.nonzero(sent)
            yield pd.DataFrame({"query_id": ids[q], key: keys[first + p], "score": sums[p, q]})
        place, column = np.nonzero((ranked >= floor) & (sums > 0))
        best.offer(column, keys[first + place], sums[place, column], ranked[place, column], sent[place, column])


def bm25_search(index: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per query by text, with ``rank``."""
    return _ranked(bm25_candidates(index, queries, k, key=key), k, key)


def topk_per_query(scores: DataFrame, k: int = TOP_K, key: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per query with ``rank`` from 1; ties go to the smaller key.

    Scores are rounded first, as the last digits of a sum depend on its order.
    A task passes on what may be among the best ``k`` of its rows and sorts that alone.
    """
    scores = scores.withColumn("score", F.round("score", SCORE_DIGITS))
    return _ranked(_leading(scores, k, key), k, key)


def _ranked(scores: DataFrame, k: int, key: str) -> DataFrame:
    """``topk_per_query`` of rows that are few already."""
    scores = scores.withColumn("score", F.round("score", SCORE_DIGITS))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _leading(scores: DataFrame, k: int, key: str) -> DataFrame:
    """Rows that may be among the best ``k`` of their query, a few times ``k`` per query and task.

    Rows without a number for a score, and without a key, all stay.
    """
    if not isinstance(scores.schema[key].dataType, T.StringType | T.IntegralType) or not isinstance(scores.schema["score"].dataType, T.DoubleType):
        return scores

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = floors = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if floors is not None:
                known = pc.index_in(rows["query_id"], floors["query_id"])
                leads = pc.fill_null(pc.greater_equal(rows["score"], floors["floor"].take(known)), True)
                rows = rows.filter(pc.or_(leads, pc.is_null(rows["score"], nan_is_null=True)))
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows > HELD_ROWS:
                held, floors = _best_of(held, k, key)
                if held.num_rows > HELD_ROWS // 2:  # of very many queries
                    yield from held.to_batches(HELD_ROWS // 8)
                    held = None
        if held is not None:
            yield from _best_of(held, k, key)[0].to_batches(HELD_ROWS // 8)

    return scores.mapInArrow(pick, scores.schema)


def _best_of(rows: pa.Table, k: int, key: str) -> tuple[pa.Table, pa.Table]:
    """The best ``k`` rows per query, and the k-th score of queries that have as many."""
    odd = pc.or_(pc.or_(pc.is_null(rows["score"], nan_is_null=True), pc.is_null(rows[key])), pc.is_null(rows["query_id"]))
    odd, plain = rows.filter(odd), rows.filter(pc.invert(odd))
    query = pa.concat_arrays(plain["query_id"].chunks).dictionary_encode() if plain.num_rows else None
    if query is None:
        return odd, None
    code = pa.array(query.indices.to_numpy(zero_copy_only=False))
    order = pc.sort_indices(pa.table({"q": code, "s": plain["score"], "key": plain[key]}), [("q", "ascending"), ("s", "descending"), ("key", "ascending")]).to_numpy()
    own = code.to_numpy()[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
    place = np.arange(len(own)) - np.repeat(first, np.diff([*first, len(own)]))
    last = order[place == k - 1]
    floors = pa.table({"query_id": plain["query_id"].take(pa.array(last)), "floor": plain["score"].take(pa.array(last))})
    return pa.concat_tables([plain.take(pa.array(order[place < k])), odd]), floors


def knn_cosine(
    index: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    key: str = "chunk_id",
    digits: int = SCORE_DIGITS,
    broadcast_questions: int = BROADCAST_QUESTIONS,
) -> DataFrame:
    """Exact ``k`` nearest rows per query; score is (1 + cosine) / 2.

    ``queries`` has ``query_id`` and ``embedding``. Every task keeps its own
    best ``k`` per question, so pairs are never rows. Up to
    ``broadcast_questions`` questions are sent to all tasks and the index is
    scanned once; more are joined block by block. Scores are rounded so that
    equal vectors tie wherever they are computed. Null and zero vectors take
    no part.
    """
    vectors = index.select(key, "embedding").filter(F.col("embedding").isNotNull())
    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField(key, index.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    some = asked.limit(broadcast_questions + 1).toPandas()
    if len(some) <= broadcast_questions:
        sent = index.sparkSession.sparkContext.broadcast(some)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                found = _best(batch, sent.value, k, key, digits)
                best = found if best is None else _head(pd.concat([best, found]), k, key)
            if best is not None:
                yield best

        return _ranked(vectors.mapInPandas(scan, schema), k, key)

    def match(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _best(part, block, k, key, digits)

    blocks = math.ceil(asked.count() / BLOCK_QUESTIONS)
    slices = max(math.ceil(vectors.count() / SLICE_VECTORS), 1)
    first = F.lit(0).cast("long")
    places = ["_slice", "_block"]
    left = vectors.select(
        "*", F.pmod(F.xxhash64(key), F.lit(slices)).alias("_slice"),
        F.explode(F.sequence(first, F.lit(blocks - 1).cast("long"))).alias("_block"),
    )
    right = asked.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"),
        F.explode(F.sequence(first, F.lit(slices - 1).cast("long"))).alias("_slice"),
    )
    found = left.groupBy(*places).cogroup(right.groupBy(*places)).applyInPandas(match, schema)
    return _ranked(found, k, key)


def _unit(frame: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors scaled to length one, without zero vectors."""
    if frame.empty:
        return np.array([]), np.zeros((0, 0))
    vectors = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
    length = np.linalg.norm(vectors, axis=1)
    kept = length > 0
    return frame[name].to_numpy()[kept], vectors[kept] / length[kept, None]


def _head(found: pd.DataFrame, k: int, key: str) -> pd.DataFrame:
    ranked = found.sort_values(["query_id", "score", key], ascending=[True, False, True])
    return ranked.groupby("query_id").head(k)


def _best(part: pd.DataFrame, asked: pd.DataFrame, k: int, key: str, digits: int) -> pd.DataFrame:
    """Best ``k`` vectors of ``part`` for each question of ``asked``."""
    keys, vectors = _unit(part, key)
    ids, questions = _unit(asked, "query_id")
    out = [pd.DataFrame({"query_id": ids[:0], key: keys[:0], "score": np.zeros(0)})]
    if len(keys):
        for start in range(0, len(ids), QUESTION_STRIP):
            strip = questions[start : start + QUESTION_STRIP]
            scores = np.round((1.0 + vectors @ strip.T) / 2.0, digits)
            # The k-th best score; whatever ties with it stays in for now.
            floor = np.partition(scores, -min(k, len(keys)), axis=0)[-min(k, len(keys))]
            at, query = np.nonzero(scores >= floor)
            found = pd.DataFrame({"query_id": ids[start + query], key: keys[at], "score": scores[at, query]})
            out.append(_head(found, k, key))
    return pd.concat(out) if len(out) > 1 else out[0]


def merge_text_and_vector(
    text: DataFrame, vector: DataFrame, vector_boost: float = VECTOR_BOOST, key: str = "chunk_id"
) -> DataFrame:
    """Text score plus boosted vector score; a row in either list counts.

    A small vector side is sent to the text rows, which do not move; a second pass over these tells which vector
    rows have no text score.
    """
    vector = durable(vector.select("query_id", key, F.col("score").alias("_vector")))
    if not is_small(vector):
        return _merged(text, vector, vector_boost, key)
    pairs = ["query_id", key]
    met = durable(text.join(F.broadcast(vector.select(*pairs)), pairs, "left_semi").select(*pairs).distinct())
    alone = vector.join(F.broadcast(met), pairs, "left_anti")  # no more pairs than there are vector rows
    found = text.withColumnRenamed("score", "_text").join(F.broadcast(vector), pairs, "left")
    return _summed(found.select(*pairs, "_text", "_vector").unionByName(alone, allowMissingColumns=True), vector_boost, key)


def _merged(text: DataFrame, vector: DataFrame, vector_boost: float, key: str) -> DataFrame:
    return _summed(text.withColumnRenamed("score", "_text").join(vector, ["query_id", key], "full_outer"), vector_boost, key)


def _summed(found: DataFrame, vector_boost: float, key: str) -> DataFrame:
    nothing = F.lit(0.0)
    return found.select(
        "query_id", key, (F.coalesce("_text", nothing) + vector_boost * F.coalesce("_vector", nothing)).alias("score")
    )


def hybrid_search(index: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """BM25 over both fields plus the vector part of its own best ``k``.

    A row without a vector part is among the best ``k`` only if at most ``k``
    rows with one come before it by text, so the best ``2 * k`` by text and the
    rows with a vector part are all that matter. The vector hits are found once and kept.
    """
    vector = durable(knn_cosine(index, queries, k))
    text = bm25_candidates(index, queries, 2 * k, also=vector)
    vector = vector.select("query_id", "chunk_id", F.col("score").alias("_vector"))
    return _ranked(_merged(text, vector, VECTOR_BOOST, "chunk_id"), k, "chunk_id")


def with_hit_fields(hits: DataFrame, index: DataFrame, most: int | None = None) -> DataFrame:
    """Attach the stored fields of the hits.

    ``most`` is a bound on the number of hits, such as questions times ``k``.
    Within the broadcast limit the index is scanned without a shuffle.
    """
    fields = ["chunk_id", "chunk_text", "title", "url", "category", "doc_type", "doc_id", "agency"]
    found = index.select(*fields)
    few = F.broadcast(hits) if most is not None and most <= BROADCAST_ROWS else hits
    return found.join(few, "chunk_id").select(*hits.columns, *fields[1:])


def hashed_ngrams(size: int = 256, n: int = 3) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for a hosted model: hashed character n-grams."""

    def embed(texts: list[str]) -> list[list[float]]:
        vectors = []
        for text in texts:
            padded = f" {text.lower()} ".ljust(n)
            codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            mixed = np.zeros(len(codes) - n + 1, dtype=np.uint64)
            for i in range(n):
                mixed = mixed * np.uint64(1_000_003) + codes[i : len(codes) - n + 1 + i]
            vector = np.bincount(((mixed >> np.uint64(7)) % np.uint64(size)).astype(np.int64), minlength=size)
            vectors.append(vector / np.linalg.norm(vector))
        return vectors

    return embed


def embed_chunks(
    chunks: DataFrame,
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    text: str = "chunk_text",
    batch: int = EMBED_BATCH,
) -> DataFrame:
    """Add ``embedding``, calling ``embed`` with up to ``batch`` texts at a time.

    A failing call gives null vectors, which vector search leaves out. Only
    the text column visits the Python worker.
    """
    model = embed or hashed_ngrams()

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out: list = []
        for start in range(0, len(texts), batch):
            part = texts.iloc[start : start + batch].fillna("").tolist()
            try:
                out.extend(model(part))
            except Exception:  # a remote model may fail in any way
                out.extend([None] * len(part))
        return pd.Series(out, dtype=object)

    return chunks.withColumn("embedding", vectors(F.col(text)))


def tfidf_rank(docs: DataFrame, queries: DataFrame, field: str = "content", key: str = "id", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Sum of tf * ln((N + 1) / (df + 1)) over the question's terms."""
    total = docs.count()

    def weigh(counts: dict[str, tuple[np.ndarray, float, float]]) -> dict[str, tuple[np.ndarray, float]]:
        return {field: (np.log((total + 1) / (df + 1)), 1.0) for field, (df, _, _) in counts.items()}

    return _every_score(docs, queries, [field], key, weigh, False, limit)
