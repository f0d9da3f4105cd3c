"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.session import broadcast_if_small

# Bounds of the sample that the tree is fitted on and of the queries it is calibrated with.
SAMPLE = 20_000
CALIBRATION = 200
BRANCHES = 8
LEAF = 384
ROUNDS = 8
RECALL = 0.97
# Vectors of neighbouring leaves, and queries, that one task compares at a time.
BLOCK = 1_024
# Leaves whose sample vectors tell a score below which nothing can be among the nearest.
FLOOR_LEAVES = 8


class Tree:
    """k-means tree: a node has its centre and either children or a leaf number."""

    def __init__(self, points: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, rounds: int = ROUNDS):
        self.centres: list[np.ndarray] = [points.mean(0) if len(points) else np.zeros(points.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf_of: list[int] = [-1]
        self.leaves = 0
        generator = np.random.default_rng(7)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            groups = self._split(points[rows], branches, rounds, generator) if len(rows) > leaf else []
            if len(groups) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for group in groups:
                number = len(self.centres)
                self.centres.append(points[rows[group]].mean(0))
                self.children.append([])
                self.leaf_of.append(-1)
                self.children[node].append(number)
                todo.append((number, rows[group]))
        self.stacked = [np.array([self.centres[c] for c in own]) if own else None for own in self.children]

    @staticmethod
    def _split(points: np.ndarray, branches: int, rounds: int, generator: np.random.Generator) -> list[np.ndarray]:
        """Groups of Lloyd's algorithm; fewer than two where all points are alike."""
        centres = points[generator.choice(len(points), min(branches, len(points)), replace=False)]
        for _ in range(rounds):
            nearest = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
            centres = np.array([points[nearest == i].mean(0) for i in np.unique(nearest)])
        nearest = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
        return [np.flatnonzero(nearest == i) for i in np.unique(nearest)]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point, by descent to the nearest centre."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.stacked[node] is None:
                out[rows] = self.leaf_of[node]
                continue
            centres = self.stacked[node]
            nearest = np.argmin((centres**2).sum(1) - 2 * points[rows] @ centres.T, 1)
            todo += [(self.children[node][i], rows[nearest == i]) for i in np.unique(nearest)]
        return out

    def visits(self, point: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves of a best-bin-first traversal.

        A queue of the branches seen so far, nearest centre first; each descent goes to a leaf and
        leaves the siblings it passes in the queue.
        """
        queue, found = [(0.0, 0)], []
        while queue and len(found) < leaves:
            node = heapq.heappop(queue)[1]
            while self.stacked[node] is not None:
                far = ((self.stacked[node] - point) ** 2).sum(1)
                order = np.argsort(far, kind="stable")
                for i in order[1:]:
                    heapq.heappush(queue, (float(far[i]), self.children[node][i]))
                node = self.children[node][order[0]]
            found.append(self.leaf_of[node])
        return found

    def keep(self, ids: np.ndarray, vectors: np.ndarray, lifted: np.ndarray) -> None:
        """Keep the sample by leaf, for lower bounds."""
        leaf = self.assign(lifted)
        order = np.argsort(leaf, kind="stable")
        parts = np.split(order, np.searchsorted(leaf[order], np.arange(1, self.leaves)))
        self.kept = [(ids[part], vectors[part]) for part in parts]

    def floor(self, query: int, vector: np.ndarray, leaves: list[int], k: int) -> float:
        """A score that ``k`` vectors of the sample reach, those of the first leaves; none if they hold fewer."""
        ids, points = (np.concatenate([self.kept[leaf][i] for leaf in leaves]) for i in (0, 1))
        scores = _exact(vector[None, :], points[ids != query])[0]
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with one more coordinate that makes all norms ``most``: then nearest means largest product."""
    return np.hstack([vectors, np.sqrt(np.maximum(most**2 - (vectors**2).sum(1), 0.0))[:, None]])


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, size))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order whatever the block."""
    return np.einsum("qd,rd->qr", queries, rows, optimize=False)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part.

    Vectors that are null, empty, zero or hold null or non-finite components do not, nor do rows
    without an id. Vectors of another length than most have no product with the others and are left
    out too.
    """
    v = F.col(vector_column)
    read = vectors.where(F.col(id_column).isNotNull() & v.isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = read.where(~bad & F.exists("vector", lambda x: x != 0))
    sizes = good.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return good.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))


def search(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 20,
    k: int = 20,
    recall: float = RECALL,
    sample: int = SAMPLE,
    leaf: int = LEAF,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest rows by inner product of each row whose id is divisible by ``every``.

    A tree is fitted on a bounded sample; every vector is put into its leaf. A bounded set of
    queries is compared with all vectors, and the number of leaves to visit is widened until the leaves visited first
    hold ``recall`` of their true neighbours. Then each query meets the vectors of the blocks its leaves lie
    in and drops what scores below ``k`` vectors of the sample. A block has about ``block`` rows, a full
    leaf several blocks, and queries are split likewise, so no leaf, however full, is one task's.

    Columns: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``, ties to the smaller id. Rows that
    ``usable`` leaves out take no part. Of repeated ids each row is a candidate and the query's own
    id is none; the repeated id is asked once, with its smallest vector. An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_column, vector_column), "vectors")
    sized = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("most"), F.max(F.size("vector")).alias("size")).first()
    count, size = sized["n"], sized["size"] or 0
    most = float(np.sqrt(sized["most"] or 0.0))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, count // sample))) == 0).limit(2 * sample).toPandas()
    lifted = _lifted(_matrix(drawn["vector"], size), most)
    tree = Tree(lifted, leaf=leaf)
    tree.keep(drawn["vec_id"].to_numpy(), _matrix(drawn["vector"], size), lifted)
    # By value, as the workers have no copy of this package.
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(tree))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = cloudpickle.loads(shared.value)
        for part in batches:
            yield part.assign(leaf=tree.assign(_lifted(_matrix(part["vector"], size), most)))

    index = stored(rows.mapInPandas(place, "vec_id long, vector array<double>, leaf long"), "leaves")
    asked = index.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    wide = _calibrated(index, asked, tree, most, size, k, recall)

    # One row per leaf, bounded by the tree. Neighbouring leaves of few rows share a block, a leaf of
    # many rows has several.
    full = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, blocks, room = {}, -1, 0
    for number in sorted(full):
        if full[number] > room:
            blocks, room = blocks + 1, block
        first[number] = blocks
        more = -(-max(0, full[number] - room) // block)
        blocks, room = blocks + more, room - full[number] + more * block
    last = {number: first[number] + -(-max(0, full[number] - block) // block) for number in first}

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = cloudpickle.loads(shared.value)
        for part in batches:
            points = _matrix(part["vector"], size)
            leaves = [tree.visits(np.append(p, 0.0), wide) for p in points]
            floors = [tree.floor(i, p, own[:FLOOR_LEAVES], k) for i, p, own in zip(part["vec_id"], points, leaves, strict=True)]
            into = [sorted({b for leaf in own if leaf in first for b in range(first[leaf], last[leaf] + 1)}) for own in leaves]
            yield part.assign(floor=floors, block=into)

    routed = asked.repartition(spark.sparkContext.defaultParallelism, "vec_id").mapInPandas(routes, "vec_id long, vector array<double>, floor double, block array<long>")
    routed = stored(routed, "routed")
    # A block is copied for as many shares as the queries that visit it fill.
    loads = routed.select(F.explode("block").alias("block")).groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("shares"))
    loads = broadcast_if_small(stored(loads, "loads"))
    spread = spark.createDataFrame([(n, first[n], last[n] - first[n] + 1) for n in first], "leaf long, first long, blocks long")
    stocked = index.join(F.broadcast(spread), "leaf").select("vec_id", "vector", (F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), "blocks")).alias("block"))
    stocked = stocked.join(loads, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    visits = routed.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "floor", F.explode("block").alias("block"))
    sought = visits.join(loads, "block").withColumn("share", F.pmod(F.xxhash64("query_id"), "shares").cast("int"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ids, points = right["vec_id"].to_numpy(), _matrix(right["vector"], size)
        for query, floor, scores in zip(left["query_id"], left["floor"], _exact(_matrix(left["query"], size), points), strict=True):
            near = np.flatnonzero((scores >= floor) & (ids != query))
            best = near[_best(scores[near], ids[near], k)]
            found.append((np.full(len(best), query), ids[best], scores[best]))
        return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    sought, stocked = sought.drop("shares"), stocked.drop("shares")
    pairs = sought.groupBy("block", "share").cogroup(stocked.groupBy("block", "share")).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _calibrated(index: DataFrame, asked: DataFrame, tree: Tree, most: float, size: int, k: int, recall: float) -> int:
    """Leaves to visit so that a bounded set of queries finds ``recall`` of its true neighbours among all vectors."""
    chosen = asked.orderBy(F.xxhash64("vec_id")).limit(CALIBRATION).toPandas()
    if not len(chosen):
        return 1
    ids, points = chosen["vec_id"].to_numpy(), _matrix(chosen["vector"], size)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for part in batches:
            own, leaves = part["vec_id"].to_numpy(), part["leaf"].to_numpy()
            for query, scores in zip(ids.tolist(), _exact(points, _matrix(part["vector"], size)), strict=True):
                others = np.flatnonzero(own != query)
                best = others[_best(scores[others], own[others], k)]
                before = kept.get(query, ([], [], []))
                merged = [np.concatenate([b, x[best]]) for b, x in zip(before, (scores, own, leaves), strict=True)]
                top = _best(merged[0], merged[1], k)
                kept[query] = [m[top] for m in merged]
        for query, (scores, own, leaves) in kept.items():
            yield pd.DataFrame({"query_id": query, "vec_id": own.astype(np.int64), "leaf": leaves.astype(np.int64), "score": scores.astype(float)})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = index.mapInPandas(nearest, "query_id long, vec_id long, leaf long, score double")
    true = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "leaf").toPandas()
    at = []
    for query, point in zip(ids.tolist(), points, strict=True):
        visited = {leaf: i for i, leaf in enumerate(tree.visits(np.append(point, 0.0), tree.leaves))}
        at += [visited[leaf] for leaf in true.loc[true["query_id"] == query, "leaf"]]
    if not at:
        return tree.leaves
    # The smallest number of visits that reaches the recall.
    return int(np.sort(at)[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1
