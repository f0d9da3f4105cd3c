"""Hard negatives by exact inner-product search in STR-packed R-trees.

Rows are sorted into slabs, and within a task tile by tile, into blocks of one label; a block is a packed R-tree
whose nodes are runs of its rows. The bounding box of a node gives, coordinate by coordinate, an interval of its
inner products with an anchor. A best-first queue opens boxes by their upper bound and leaves those that lie
outside the score windows or strictly below the k-th score found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh_folder, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# Window of negative scores in percent of the positive score.
LOW, HIGH = 30, 90
# Rows of a tree, of a leaf and of a slab that one task sorts; nodes under a node; coordinates that tile a slab.
BLOCK = 2_048
LEAF = 64
SLAB = 16_384
FAN = 8
TILED = 3
# Anchors that one scan of the trees answers.
ANCHORS = 8_192

_BLOCKS = "label long, n int, ids binary, points binary"
_FOUND = "anchor_id long, low long, high long, id long, score long"
# Stands for a window without a bound.
_OPEN = 2**60


def str_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in sort-tile-recursive order, tiled by the coordinates that vary most."""
    dims = np.argsort(-points.astype(np.float64).var(0), kind="stable")[:TILED]

    def tile(rows: np.ndarray, dims: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(points[rows, dims[0]], kind="stable")]
        pages = -(-len(rows) // leaf)
        if len(dims) == 1 or pages <= 1:
            return [rows]
        slices = int(np.ceil(pages ** (1 / len(dims))))
        size = -(-pages // slices) * leaf
        return [part for at in range(0, len(rows), size) for part in tile(rows[at : at + size], dims[1:])]

    return np.concatenate(tile(np.arange(len(points)), dims)) if points.shape[1] else np.arange(len(points))


class PackedTree:
    """Bounding boxes of the leaves of a block and of the nodes above, level by level; the last level is one root."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        starts = np.arange(0, len(points), leaf)
        self.levels = [(np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def intervals(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level, least and largest possible inner product of each anchor with each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high in self.levels]


class Best:
    """The ``k`` best (score, id) of one anchor within each of its windows, ties to the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        # A score below this one is of no use to the window.
        self.need = low.copy()
        self.scores = [np.zeros(0) for _ in low]
        self.ids = [np.zeros(0, np.int64) for _ in low]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.need[:, None]) & (scores <= self.high[:, None])
        for w in np.flatnonzero(fits.any(1)):
            score, own = np.concatenate([self.scores[w], scores[fits[w]]]), np.concatenate([self.ids[w], ids[fits[w]]])
            order = np.lexsort((own, -score))[: self.k]
            self.scores[w], self.ids[w] = score[order], own[order]
            if len(order) == self.k:
                self.need[w] = max(self.low[w], score[order[-1]])

    def wants(self, least: float, most: float) -> bool:
        """Whether a box with these bounds may hold a row for a window: ties with the k-th may."""
        return bool(((most >= self.need) & (least <= self.high)).any())


def search_block(tree: PackedTree, ids: np.ndarray, anchor_ids: np.ndarray, anchors: np.ndarray, best: list[Best]) -> None:
    """Best-first search of a block for each anchor; its own id is no candidate."""
    bounds = tree.intervals(anchors)
    top = len(tree.levels) - 1
    for i, own in enumerate(best):
        if not own.wants(bounds[top][0][i, 0], bounds[top][1][i, 0]):
            continue
        reach = own.high.max()
        queue = [(-min(bounds[top][1][i, 0], reach), top, 0)]
        while queue:
            _, level, node = heapq.heappop(queue)
            least, most = bounds[level][0][i], bounds[level][1][i]
            if not own.wants(least[node], most[node]):
                continue
            if level == 0:
                rows = slice(node * tree.leaf, (node + 1) * tree.leaf)
                others = ids[rows] != anchor_ids[i]
                own.offer((tree.points[rows] @ anchors[i])[others], ids[rows][others])
                continue
            least, most = bounds[level - 1][0][i], bounds[level - 1][1][i]
            for child in range(node * FAN, min((node + 1) * FAN, len(most))):
                if own.wants(least[child], most[child]):
                    heapq.heappush(queue, (-min(most[child], reach), level - 1, child))


def _points(content: bytes, n: int) -> np.ndarray:
    # Whole numbers whose products stay below 2**53 are exact in double precision.
    return np.frombuffer(content, np.int32).reshape(n, -1).astype(np.float64)


def quantised(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """``vec_id``, ``label`` and ``point`` (whole numbers) of the rows that take part.

    Rows with a null id, label or vector, with an empty vector or a null or non-finite component do not, nor do
    vectors of another length than most, nor those with a component so large that a product of two such vectors could
    pass 2**53.
    """
    v = F.col(vector_column)
    read = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), v.cast("array<double>").alias("vector"))
    read = read.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    largest = F.sqrt(F.lit(float(2**52)) / F.size("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale > largest))
    good = read.where((F.size("vector") > 0) & ~bad)
    sizes = good.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    good = good.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))
    return good.select("vec_id", "label", F.transform("vector", lambda x: F.floor(x * scale).cast("int")).alias("point"))


def packed(rows: DataFrame, block: int = BLOCK, leaf: int = LEAF, slab: int = SLAB) -> DataFrame:
    """Blocks of the trees, one row each: rows of one label in sort-tile-recursive order.

    Slabs are ranges of (label, the coordinate that varies most, id), so that neither a label nor equal
    vectors, however many, come to one task; each is tiled by further coordinates within its task.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, 0.0, 0.0
        for batch in batches:
            points = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            n, total, squares = n + len(points), total + points.sum(0), squares + (points**2).sum(0)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n, np.int64)), pa.array(total), pa.array(squares)], names=["i", "n", "s", "q"])

    spreads = rows.select("point").mapInArrow(moments, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    widest = spreads.select("i", "n", (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("v")).orderBy(F.desc("v"), "i").limit(1).collect()
    at, count = (widest[0]["i"], widest[0]["n"]) if widest else (0, 0)
    # Few rows are spread over the cores all the same.
    parts = max(1, -(-count // slab), min(rows.sparkSession.sparkContext.defaultParallelism, count // block))
    slabs = rows.repartitionByRange(parts, "label", F.get("point", F.lit(at)), "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        points = np.concatenate([c.flatten().to_numpy() for c in table.column("point").chunks]).reshape(len(ids), -1).astype(np.int32)
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            own = own[str_order(points[own], leaf)]
            for first in range(0, len(own), block):
                part = own[first : first + block]
                yield pa.record_batch([pa.array([label], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([points[part].tobytes()], pa.binary())], names=["label", "n", "ids", "points"])

    return slabs.mapInArrow(cut, _BLOCKS)


def scan(blocks: DataFrame, asked: pd.DataFrame, same_label: bool, k: int, leaf: int = LEAF) -> DataFrame:
    """The best ``k`` rows within each window of each anchor of ``asked``, each task's own best.

    ``asked`` has ``anchor_id, label, point, low, high``, the last two lists with the bounds of the windows;
    it is sent to every task, so its length is the caller's to bound. Candidates have the anchor's label or, else, any other.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(
        (asked["anchor_id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64), np.array(asked["point"].to_list(), np.float64), asked["low"].to_list(), asked["high"].to_list())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, labels, points, lows, highs = sent.value
        best = [Best(np.array(low, np.float64), np.array(high, np.float64), k) for low, high in zip(lows, highs, strict=True)]
        for batch in batches:
            for label, n, ids, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                chosen = np.flatnonzero((labels == label) == same_label)
                if len(chosen):
                    search_block(PackedTree(_points(content, n), leaf), np.frombuffer(ids, np.int64), anchor_ids[chosen], points[chosen], [best[i] for i in chosen])
        for at in range(0, len(best), 500):
            found = [(anchor, *window) for anchor, own in zip(anchor_ids[at : at + 500], best[at : at + 500], strict=True) for window in zip(own.low, own.high, own.ids, own.scores, strict=True)]
            sizes = [len(ids) for *_, ids, _ in found]
            if sum(sizes):
                anchor, low, high, ids, scores = zip(*found, strict=True)
                flat = [np.repeat(anchor, sizes), np.repeat(low, sizes), np.repeat(high, sizes), np.concatenate(ids), np.concatenate(scores)]
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in flat], names=["anchor_id", "low", "high", "id", "score"])

    return blocks.select("label", "n", "ids", "points").mapInArrow(run, _FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _groups(spark: SparkSession, anchors: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Anchors in groups of about ``size``, dealt by id."""
    groups = max(1, -(-anchors.count() // size))
    for g in range(groups):
        part = anchors.where(F.pmod(F.xxhash64("anchor_id"), F.lit(groups)) == g).toPandas()
        if len(part):
            yield part


def mine(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block: int = BLOCK,
    leaf: int = LEAF,
    slab: int = SLAB,
    anchors: int = ANCHORS,
) -> DataFrame:
    """Hard negatives of each positive of each anchor, the rows whose id is divisible by ``every``.

    Components are ``floor(scale * x)`` and a score is the inner product of two such vectors. An anchor's positives
    are its first ``positives`` other rows of the same label; a positive's negatives are the first ``negatives`` rows
    of another label with ``low * p <= 100 * score <= high * p`` for the positive's score ``p``. Higher scores come
    first, ties by smaller id. Columns: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The trees are written once and scanned twice for every ``anchors`` anchors, which alone are sent to the
    tasks; rows are never copied for an anchor. The search is exact: a task keeps its ``k`` best of a window and opens
    every box that could hold a better row or a tie.

    Rows that ``quantised`` leaves out take no part. Of repeated ids each row is a candidate, and rows with the
    anchor's own id are none; a repeated anchor is asked once, with its smallest (label, vector). Positives of a negative score
    have no negatives, as their window is empty. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_column, vector_column, label_column, scale), "quantised")
    blocks = stored(packed(rows, block, leaf, slab), "trees")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "point")).alias("a")).select("anchor_id", "a.label", "a.point")
    asked = stored(asked, "anchors")
    near, far = fresh_folder(spark, "positives"), fresh_folder(spark, "negatives")
    empty = spark.createDataFrame([], f"{_FOUND}, rank int")
    for folder in (near, far):
        empty.write.parquet(folder)
    for part in _groups(spark, asked, anchors):
        everything = part.assign(low=[[-_OPEN]] * len(part), high=[[_OPEN]] * len(part))
        found = _first(scan(blocks, everything, True, positives, leaf), ["anchor_id"], positives)
        found.write.mode("append").parquet(near)
    found = spark.read.schema(empty.schema).parquet(near)
    edges = [F.ceil(F.col("score") * low / 100).alias("low"), F.floor(F.col("score") * high / 100).alias("high")]
    # Positives of equal score have one window.
    bounds = found.select("anchor_id", *edges).where("low <= high").distinct()
    windows = bounds.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("high", "low"))).alias("w"))
    windowed = asked.join(windows, "anchor_id").select("anchor_id", "label", "point", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    for part in _groups(spark, stored(windowed, "windows"), anchors):
        _first(scan(blocks, part, False, negatives, leaf), ["anchor_id", "low", "high"], negatives).write.mode("append").parquet(far)
    hard = spark.read.schema(empty.schema).parquet(far).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    good = found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *edges)
    return good.join(hard, ["anchor_id", "low", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
