"""Approximate vector search by navigable graphs, one per part of the index.

A part is a bounded number of vectors with links from each to near ones in different directions. A search walks
the links with a bounded list of candidates and looks at a small share of the
vectors; the best of all parts are merged. Scores are those of ``knn_cosine``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.retrieval import BROADCAST_QUESTIONS, SCORE_DIGITS, TOP_K, _ranked

# Fixed value: candidates of a search.
CANDIDATES = 100
PART_ROWS = 8_192
# Links of a vector, and nearest vectors they are chosen from.
DEGREE = 24
NEAREST = 64
# Vectors a walk may start at: the best of these.
STARTS = 64


def linked(unit: np.ndarray, degree: int = DEGREE, nearest: int = NEAREST) -> np.ndarray:
    """Links of each vector, -1 where it has fewer than twice ``degree``.

    Of the nearest vectors, nearest first, one is linked unless it is nearer to one linked already; links
    go both ways as long as there is room.
    """
    n = len(unit)
    out = [[] for _ in range(n)]
    for first in range(0, n, 512):
        scores = unit[first : first + 512] @ unit.T
        scores[np.arange(len(scores)), np.arange(first, first + len(scores))] = -np.inf
        size = min(nearest, n - 1)
        near = np.argpartition(-scores, size - 1, axis=1)[:, :size] if size else np.zeros((len(scores), 0), np.int64)
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(scores, near, 1), axis=1, kind="stable"), 1)
        for row, own in enumerate(near):
            between = unit[own] @ unit[own].T
            kept: list[int] = []
            for j in range(len(own)):
                if not kept or (between[j, kept] < scores[row, own[j]]).all():
                    kept.append(j)
                    if len(kept) == degree:
                        break
            out[first + row] = own[kept].tolist()
    for i, own in enumerate([list(x) for x in out]):
        for j in own:
            if len(out[j]) < 2 * degree and i not in out[j]:
                out[j].append(i)
    links = np.full((n, 2 * degree), -1, np.int32)
    for i, own in enumerate(out):
        links[i, : len(own)] = own
    return links


def walk(unit: np.ndarray, links: np.ndarray, question: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best candidates of a walk with their scores, and how many vectors it looked at."""
    n = len(unit)
    seen = np.zeros(n, bool)
    ids = np.unique(np.linspace(0, n - 1, min(STARTS, n)).astype(np.int64))
    seen[ids] = True
    score, done = unit[ids] @ question, np.zeros(len(ids), bool)
    while True:
        order = np.argsort(-score, kind="stable")[:candidates]
        ids, score, done = ids[order], score[order], done[order]
        left = np.flatnonzero(~done)[:4]
        if not len(left):
            return ids, score, int(seen.sum())
        done[left] = True
        new = np.unique(links[ids[left]])
        new = new[(new >= 0) & ~seen[new]]
        seen[new] = True
        ids, score, done = np.concatenate([ids, new]), np.concatenate([score, unit[new] @ question]), np.concatenate([done, np.zeros(len(new), bool)])


def build_graphs(index: DataFrame, key: str = "chunk_id", part_rows: int = PART_ROWS) -> DataFrame:
    """One row per part: its keys, unit vectors and links; to be stored with the index.

    Null, empty and zero vectors take no part. All vectors have one length.
    """
    vectors = index.select(key, "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    parts = max(1, -(-vectors.count() // part_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        matrix = np.stack(table.column("embedding").to_pandas().to_numpy()).astype(np.float64)
        length = np.linalg.norm(matrix, axis=1)
        keys = table.column(key).combine_chunks().filter(pa.array(length > 0))
        matrix = matrix[length > 0] / length[length > 0, None]
        for first in range(0, len(matrix), 2 * part_rows):
            unit = matrix[first : first + 2 * part_rows]
            own = keys.slice(first, len(unit))
            yield pa.record_batch(
                [pa.array([len(unit)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([unit.tobytes()], pa.binary()), pa.array([linked(unit).tobytes()], pa.binary())],
                names=["n", "keys", "vectors", "links"],
            )

    kind = index.schema[key].dataType
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType()), T.StructField("links", T.BinaryType())])
    return vectors.repartition(parts, key).mapInArrow(build, schema)


def graph_search(
    graphs: DataFrame, queries: DataFrame, k: int = TOP_K, candidates: int = CANDIDATES, key: str = "chunk_id", digits: int = SCORE_DIGITS,
    broadcast_questions: int = BROADCAST_QUESTIONS, looked_at: Accumulator | None = None,
) -> DataFrame:
    """The ``k`` best of the candidates of every part for each question; see ``knn_cosine`` for scores and ties.

    Up to ``broadcast_questions`` questions are sent to all tasks; more are searched in blocks of as many, a scan of the
    graphs each. ``looked_at`` counts the vectors that were scored.
    """
    spark = graphs.sparkSession
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    schema = T.StructType(
        [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, graphs.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())]
    )

    def searched(block: pd.DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            questions = np.stack(sent.value["embedding"].to_numpy()).astype(np.float64)
            length = np.linalg.norm(questions, axis=1)
            for batch in batches:
                for n, keys, vectors, links in zip(batch["n"], batch["keys"], batch["vectors"], batch["links"]):
                    if not n:
                        continue
                    unit, graph = np.frombuffer(vectors).reshape(n, -1), np.frombuffer(links, np.int32).reshape(n, -1)
                    for query, vector, size in zip(sent.value["query_id"], questions, length):
                        if size == 0:
                            continue
                        at, score, seen = walk(unit, graph, vector / size, max(candidates, k))
                        if looked_at is not None:
                            looked_at.add(seen)
                        found = pd.DataFrame({"query_id": query, key: np.asarray(keys, dtype=object)[at], "score": np.round((1.0 + score) / 2.0, digits)})
                        yield found.sort_values(["score", key], ascending=[False, True]).head(k)

        return graphs.mapInPandas(run, schema)

    total = asked.count()
    blocks = max(1, -(-total // broadcast_questions))
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [searched(part) for b in range(blocks) if len(part := asked.where(dealt == b).toPandas())]
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part)
    return _ranked(found, k, key)
