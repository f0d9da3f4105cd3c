"""Exact Jaccard self-join of shingle sets with a count-vector R-tree, and its components.

A set is hashed into groups in two ways. Fine groups, as many as two linked sets can differ in and
a few more, leave some groups equal in both sets, so that sets meet only under the content of several
fine groups. Coarse groups give the point of a set, its count vector, whose coordinate minima
bound the overlap of two sets: points that meet go through an R-tree on these vectors, and
surviving pairs are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import given_back, given_back_by_group, shielded, small_batches, stored, whole_text
from quarry.session import broadcast_if_small

# Fewest coordinates of a point (a set of more elements has one for every one or two of them), points
# of an R-tree leaf, rows that one tile of a group holds.
COORDINATES = 64
LEAF = 16
TILE = 512
# Rows, and bytes of sets, of one block of a tile whose sets are compared in place.
DENSE = 1_024
DENSE_BYTES = 1 << 23
# Keys that two linked sets share where they can: keys beyond those that guarantee it are not written.
SHARED = 8
# Sizes of one band of sets grow by this factor.
BAND = 1.6
FIRST_BAND = 5

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, none if it has no word."""
    seen = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    gap = _GAP[seen]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(seen) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint64)
    place = _place(start, len(seen))
    power = np.cumprod(np.full(int(place.max()) + 1, _ODD[0]))
    value = (seen[start[0] :].astype(np.uint64) + np.uint64(1)) * power[place]
    value[gap[start[0] :]] = 0
    word = mixed(np.add.reduceat(value, start - start[0]))
    if len(word) < words:
        total = np.uint64(len(word))
        for w in word:
            total = mixed(np.array([total * _ODD[1] + w]))[0]
        return np.array([total], np.uint64)
    n = len(word) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = total * _ODD[2] + word[k : k + n]
    return np.unique(mixed(total))


def _place(start: np.ndarray, size: int) -> np.ndarray:
    """Place of each byte, from the first word on, counted from the start of its word."""
    each = np.diff(np.concatenate([start, [size]]))
    return np.arange(start[0], size) - np.repeat(start, each)


def identity(own: np.ndarray) -> int:
    """One signed number for a set."""
    return int(mixed(np.array([mixed(own).sum() ^ (np.uint64(len(own)) * _ODD[3])]))[0].view(np.int64))


class Scheme:
    """Numbers of fine groups by band of set sizes, for links from ``share`` percent on."""

    def __init__(self, share: int):
        self.share = share
        self.least = [1]
        size = float(FIRST_BAND)
        while size < 1 << 40:
            self.least.append(math.ceil(size))
            size *= BAND
        self.parts = []
        for upper in self.least[1:]:
            small = upper - 1
            large = small * 100 // share
            # Elements in which two linked sets can differ.
            differ = self.differ(small, large)
            spare = 3 + differ // 12
            self.parts.append(differ + 1 + spare)

    def bands(self, size: int) -> list[int]:
        """The band of a size, and the one below if a set there can be linked with it."""
        own = int(np.searchsorted(self.least, size, side="right")) - 1
        smallest = -(-self.share * size // 100)
        return [own] if own == 0 or smallest >= self.least[own] else [own - 1, own]

    def differ(self, size: int, other: int) -> int:
        """Elements in which linked sets of these sizes can differ."""
        return (100 - self.share) * (size + other) // (100 + self.share)

    def groups(self, own: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Group of each element of a set, where each group that is not empty begins, and how many of these a linked set of the band has alike at least."""
        part = ((own >> np.uint64(32)) * np.uint64(self.parts[band])) >> np.uint64(32)
        first = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        other = len(own) * 100 // self.share
        if len(own) >= self.least[band + 1]:
            # In the band below its own the set is the larger one.
            other = min(other, self.least[band + 1] - 1)
        return part, first, len(first) - self.differ(len(own), other)

    def shared(self, own: np.ndarray) -> int:
        """Keys that a set has in common with any set linked with it, at least."""
        return max(1, min(SHARED, *(self.groups(own, band)[2] for band in self.bands(len(own)))))

    def keys(self, own: np.ndarray) -> np.ndarray:
        """Keys of a set: the content of fine groups that are not empty, in the order of the groups.

        Where a set has ``alike`` groups in common with any linked one, the last ``alike - SHARED`` are left out: of the
        common groups ``SHARED`` or all come before these in both sets. A set that may have none in common but empty
        ones has keys for all its groups, the empty ones too.
        """
        found = []
        value = mixed(own ^ _ODD[4])
        for band in self.bands(len(own)):
            part, first, alike = self.groups(own, band)
            content, at = np.add.reduceat(value, first), part[first]
            if alike > SHARED:
                content, at = content[: SHARED - alike], at[: SHARED - alike]
            elif alike < 1:
                empty = np.setdiff1d(np.arange(self.parts[band], dtype=np.uint64), at)
                content, at = np.concatenate([content, np.zeros(len(empty), np.uint64)]), np.concatenate([at, empty])
            found.append(mixed(content + at * _ODD[1] + np.uint64(band + 1) * _ODD[2]))
        return np.concatenate(found).view(np.int64)


def point(own: np.ndarray) -> bytes:
    """Count vector of a set: a power of two of coordinates, as many as keep its counts in a byte."""
    size = max(COORDINATES, 1 << (len(own) // 2).bit_length())
    while (counts := np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)).max() > 255:
        size *= 2
    return counts.astype(np.uint8).tobytes()


def folded(points: list[bytes]) -> np.ndarray:
    """Points as rows of a matrix, added up to the fewest coordinates that one of them has."""
    size = min(map(len, points))
    return np.array([np.frombuffer(p, np.uint8).reshape(-1, size).sum(0, dtype=np.int32) for p in points])


def tree_pairs(points: np.ndarray, sizes: np.ndarray, class_of: np.ndarray, share: int) -> Iterator[tuple[int, int]]:
    """Pairs of different classes, one leaf against another at a time, whose points do not rule a link out, by a packed R-tree.

    Leaves hold points of like size and direction; a leaf's vector of largest counts bounds the overlap with any
    of its points by the sum of coordinate minima, first against whole leaves, then against points.
    """
    need = lambda a, b: share * (a + b)  # noqa: E731  overlap * (100 + share) must reach it
    order = np.lexsort((points.argmax(1), sizes))
    leaves = [order[at : at + LEAF] for at in range(0, len(order), LEAF)]
    most = np.array([points[leaf].max(0) for leaf in leaves])
    least = np.array([sizes[leaf].min() for leaf in leaves])
    largest = np.array([sizes[leaf].max() for leaf in leaves])
    for i, leaf in enumerate(leaves):
        bound = np.minimum(most[i], most[i:]).sum(1)
        near = (bound * (100 + share) >= need(least[i], least[i:])) & (largest[i] * 100 >= least[i:] * share)
        for j in np.flatnonzero(near) + i:
            other = leaves[j]
            overlap = np.minimum(points[leaf][:, None, :], points[other][None, :, :]).sum(2)
            fits = (overlap * (100 + share) >= need(sizes[leaf][:, None], sizes[other][None, :])) & (class_of[leaf][:, None] != class_of[other][None, :])
            for a, b in zip(*(x.tolist() for x in np.nonzero(fits)), strict=True):
                if i != j or a < b:
                    yield int(leaf[a]), int(other[b])


def members(docs: DataFrame, id_column: str, text_column: str, words: int, share: int) -> DataFrame:
    """``doc_id``, key of the text, size and number of its set, its point and the keys it shares with any linked set; null number for no set."""

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(share)
        for batch in batches:
            sizes, nodes, points, shared = [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column(2):
                    own = shingles(text.as_py(), words)
                    sizes.append(len(own))
                    nodes.append(identity(own) if len(own) else None)
                    points.append(point(own) if len(own) else None)
                    shared.append(scheme.shared(own) if len(own) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary()), pa.array(shared, pa.int32())]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_key", "n", "node", "point", "shared"])

    return _read(docs, id_column, text_column).mapInArrow(run, "doc_id long, text_key long, n long, node long, point binary, shared int")


def _read(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = whole_text(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def shared_groups(docs: DataFrame, id_column: str, text_column: str, words: int, share: int) -> DataFrame:
    """``key``, ``node`` and ``m``, the sets under the key, for every fine group that two sets or more have alike.

    Copies within a task are written once. Sorted by key, rows stream through a task; a key's rows are
    never held together.
    """

    @given_back
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, known = Scheme(share), set()
        for batch in batches:
            keys, nodes, size = [], [], 0
            with np.errstate(over="ignore"):
                for text in batch.column(2):
                    own = shingles(text.as_py(), words)
                    node = identity(own) if len(own) else None
                    if node is None or node in known:
                        continue
                    known.add(node)
                    # Sets so small that only equal ones are linked need no keys.
                    if (100 - share) * (len(own) + len(own) * 100 // share) // (100 + share) == 0:
                        continue
                    own_keys = scheme.keys(own)
                    keys.append(own_keys)
                    nodes.append(np.full(len(own_keys), node, np.int64))
                    size += len(own_keys)
                    if size > 500_000:
                        yield pa.record_batch([np.concatenate(keys), np.concatenate(nodes)], names=["key", "node"])
                        keys, nodes, size = [], [], 0
            if keys:
                yield pa.record_batch([np.concatenate(keys), np.concatenate(nodes)], names=["key", "node"])

    @given_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that equal a neighbour in the key, each node once."""
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def alike(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
            keys, nodes = keys[new], nodes[new]
            same = keys[1:] == keys[:-1]
            again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            return pa.record_batch([keys[again], nodes[again]], names=["key", "node"])

        for batch in batches:
            keys = np.concatenate([held[0], batch.column(0).to_numpy()])
            nodes = np.concatenate([held[1], batch.column(1).to_numpy()])
            if not len(keys):
                continue
            # The last key may go on: its last two rows wait, the others of a long key leave.
            last = int(np.searchsorted(keys, keys[-1]))
            if last == 0 and len(keys) > 2:
                yield alike(keys[:-1], nodes[:-1])
                held = (keys[-2:], nodes[-2:])
                continue
            if last:
                yield alike(keys[:last], nodes[:last])
            held = (keys[last:], nodes[last:])
        if len(held[0]):
            yield alike(*held)

    rows = _read(docs, id_column, text_column).mapInArrow(write, "key long, node long")
    alike = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(count, "key long, node long")
    return alike.distinct()


def sets_of(nodes: DataFrame, seen: DataFrame, docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """``node`` and ``own``, its sorted shingle hashes, made anew from one text each."""
    source = seen.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("s")).select("node", F.col("s.doc_id").alias("_id"), F.col("s.text_key").alias("_key"))
    source = stored(source, "sources")
    texts = _read(docs, id_column, text_column)
    found = texts.join(broadcast_if_small(source), texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["text_key"] == F.col("_key"))).select("node", "text")

    @given_back
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                own = [shingles(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    # Rows that repeat an id and a text give a set repeatedly.
    return found.mapInArrow(sets, "node long, own binary")


def linked(own: np.ndarray, other: np.ndarray, share: int) -> bool:
    both = len(np.intersect1d(own, other, assume_unique=True))
    return 100 * both >= share * (len(own) + len(other) - both)


def verified(pairs: DataFrame, seen: DataFrame, docs: DataFrame, id_column: str, text_column: str, words: int, share: int) -> DataFrame:
    """The pairs (``u``, ``v``) of set numbers whose sets are linked.

    Pairs are dealt by ``u`` and, for a ``u`` with many, a salt; the sets of a share stream through
    a task behind that of its ``u``.
    """
    counted = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(counted, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / TILE)).alias("salt"))
    salted = stored(salted, "pairs")
    wanted = salted.select(F.col("u").alias("node"), F.col("u").alias("hub"), "salt", F.lit(0).alias("role")).distinct()
    wanted = wanted.unionByName(salted.select(F.col("v").alias("node"), F.col("u").alias("hub"), "salt", F.lit(1).alias("role")))
    own = sets_of(wanted.select("node").distinct(), seen, docs, id_column, text_column, words)
    dealt = own.join(wanted, "node").select("hub", "salt", "role", "node", "own")
    dealt = dealt.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    @given_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for hub, role, node, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                other = np.frombuffer(content.as_py(), np.uint64)
                if role == 0:
                    at, own = hub, other
                    continue
                assert at == hub
                if linked(own, other, share):
                    us.append(hub)
                    vs.append(node)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every linked node, by contraction.

    In a round each node moves to its smallest neighbour's, and edges are rewritten between the
    nodes that remain; a component is one node after a number of rounds like the logarithm of its
    longest path. Every round is written to the shared folder.
    """
    edges = stored(links.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).withColumnRenamed("a", "from")
        near = stored(near, "near")
        onward = near.select(F.col("from").alias("to"), F.col("to").alias("further"))
        jump = stored(near.join(onward, "to").select("from", F.col("further").alias("to")), "jump")
        label = jump.select(F.col("from").alias("node"), F.col("to").alias("root")) if label is None else label.join(
            jump.withColumnRenamed("from", "root"), "root", "left"
        ).select("node", F.coalesce("to", "root").alias("root"))
        label = stored(label, "label")
        moved = edges.join(jump.select(F.col("from").alias("a"), F.col("to").alias("a2")), "a").join(jump.select(F.col("from").alias("b"), F.col("to").alias("b2")), "b")
        edges = stored(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    if label is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root")).where("false")
    return label


def candidate_hubs(groups: DataFrame) -> DataFrame:
    """For each set the one it is compared with first: of its keys' hubs the most frequent.

    A key's hub is the set that shares most with others over all its keys, as the source of many
    copies does.
    """
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    sized = groups.join(sizes, "key")
    weight = sized.groupBy("node").agg(F.sum("m").alias("w"))
    hubs = groups.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    offers = groups.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    return offers.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("o")).select(F.col("o.hub").alias("u"), F.col("node").alias("v"))


def plausible(pairs: DataFrame, points: DataFrame, share: int) -> DataFrame:
    """The pairs (``u``, ``v``) whose points do not rule a link out; sets are fetched for these alone."""
    sides = [points.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}")) for x in "uv"]

    @given_back
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            overlap = np.array([np.minimum(*folded([a.as_py(), b.as_py()])).sum() for a, b in zip(batch.column("pu"), batch.column("pv"), strict=True)], np.int64)
            fits = pa.array(overlap * (100 + share) >= share * sizes)
            yield pa.record_batch([batch.column("u").filter(fits), batch.column("v").filter(fits)], names=["u", "v"])

    met = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "nu", "nv", "pu", "pv")
    return met.mapInArrow(bound, "u long, v long")


class Union:
    """Classes of the rows of a tile that are joined one by one."""

    def __init__(self, class_of: np.ndarray):
        _, first, of = np.unique(class_of, return_index=True, return_inverse=True)
        # The first row of a class stands for it.
        self.up = first[of].tolist()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def crossing(groups: DataFrame, label: DataFrame, least: DataFrame) -> DataFrame:
    """The rows of ``groups`` that can still join components: under keys of several, of sets with as many such keys as ``least`` says.

    Sets that have but a few groups in common, as by one repeated passage, lose their rows here. What a round takes leaves keys
    of a single component, which the next one takes.
    """
    rows = groups.join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    for _ in range(2):
        several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        rows = stored(rows.join(several, "key"), "crossing")
        enough = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(least, "node").where("c >= shared").select("node")
        rows = rows.join(enough, "node")
    return stored(rows.select("key", "node"), "crossing")


def further_links(groups: DataFrame, label: DataFrame, points: DataFrame, pairs_of: Callable, verify: Callable, sets: Callable, share: int) -> DataFrame:
    """Links (``u``, ``v``) that join all linked sets under a key that are not yet in one component.

    ``points`` has ``node, n, point``; ``pairs_of(points, sizes, classes)`` are the pairs of rows that points do not rule
    out. Only keys whose sets lie in several components are looked at. A key with many sets is cut into tiles of two
    blocks each, so that no task holds more than two blocks. A tile with fewer pairs than rows hands them to ``verify``;
    the keys of other tiles get the sets themselves (``sets(nodes)``) and compare there, each pair that is not joined yet,
    so that no more links than rows leave a tile.
    """
    labelled = groups.join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    digest = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    open_ = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"), *digest).where("low <> high")
    # Sets that are alike meet under many keys: keys with the same sets are looked at once.
    open_ = open_.groupBy("m", "x0", "x1").agg(F.min("key").alias("key")).select("key", "m")
    rows = stored(labelled.join(open_, "key").join(points, "node").select("key", "m", "node", "root", "n", "point"), "open")

    def tiles(rows: DataFrame, blocks: Column) -> DataFrame:
        dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def candidates(table: pa.Table) -> Iterator[tuple[int, int]]:
        return pairs_of(table.column("point").to_pylist(), table.column("n").to_numpy(), table.column("root").to_numpy())

    @given_back_by_group
    def narrow(key: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        found = list(islice(candidates(table), len(nodes) + 1))
        if len(found) > len(nodes):
            return pa.table({"u": pa.array([None], pa.int64()), "v": pa.array([None], pa.int64()), "dense": pa.array([key[0].as_py()], pa.int64())})
        left, right = (nodes[[p[i] for p in found]] if found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"u": np.minimum(left, right), "v": np.maximum(left, right), "dense": pa.nulls(len(found), pa.int64())})

    @given_back_by_group
    def compare(_: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        _, once = np.unique(nodes, return_index=True)
        table = table.take(np.sort(once))
        nodes, own = table.column("node").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()]
        classes, found = Union(table.column("root").to_numpy()), []
        for i, j in candidates(table):
            if classes.find(i) != classes.find(j) and linked(own[i], own[j], share):
                classes.join(i, j)
                found.append((nodes[i], nodes[j]))
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    columns, tile = ["key", "low", "high", "node", "root", "n", "point"], ["key", "low", "high"]
    # Few bytes mean much work here: tiles are dealt over all partitions, however small they are.
    spread = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = stored(tiles(rows, F.ceil(F.col("m") / TILE)).select(*columns).repartition(spread, *tile).groupBy(*tile).applyInArrow(narrow, "u long, v long, dense long"), "tiles")
    links = verify(first.where("u is not null").select("u", "v").distinct())
    dense = first.where("dense is not null").select(F.col("dense").alias("key")).distinct()
    if dense.isEmpty():
        return links
    crowded = stored(rows.join(dense, "key"), "crowded")
    size = crowded.groupBy("key").agg(F.greatest(F.ceil(F.sum("n") * 8 / DENSE_BYTES), F.ceil(F.count(F.lit(1)) / DENSE)).alias("blocks"))
    whole = stored(sets(crowded.select("node").distinct()).dropDuplicates(["node"]), "sets")
    dealt = tiles(crowded.join(size, "key").withColumnRenamed("blocks", "parts"), F.col("parts")).select(*columns)
    return links.unionByName(dealt.join(whole, "node").repartition(spread, *tile).groupBy(*tile).applyInArrow(compare, "u long, v long"))


def link(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, share: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Two documents are linked when their sets of ``words``-word shingles have at least ``share`` percent of
    their union in common; a component is named by its smallest document id. Equal sets are one set
    throughout. Each set that shares a fine group with others is first compared with its hub, which joins
    groups of copies of any size by one pair a copy; what shares a fine group and is still apart is
    compared by the R-tree. Sets are compared by 64-bit hashes of their shingles.

    A null or wordless text has no set, is linked with nothing and is its own component. Rows with a
    null id keep it and get the smallest id of their component, null if there is none. Repeated rows are
    each returned. An empty table gives no rows; other columns are ignored.
    """
    rooted = rooted_rows(docs, id_column, text_column, words, share)
    least = rooted.where("node is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def rooted_rows(docs: DataFrame, id_column: str, text_column: str, words: int, share: int) -> DataFrame:
    """The rows of ``members`` with ``root``, the set that stands for their component; null for no set."""
    small_batches(docs.sparkSession)
    seen = stored(members(docs, id_column, text_column, words, share), "members")
    groups = stored(shared_groups(docs, id_column, text_column, words, share), "groups")
    narrow = seen.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("point").alias("point"), F.min("shared").alias("shared"))
    held = stored(groups.select("node").distinct().join(narrow, "node"), "points")
    args = (seen, docs, id_column, text_column, words, share)
    first = stored(verified(plausible(candidate_hubs(groups), held, share), *args), "links")
    label = components(first)
    rest = crossing(groups, label, held.select("node", "shared"))
    more = further_links(rest, label, held.drop("shared"), lambda points, sizes, classes: tree_pairs(folded(points), sizes, classes, share), lambda pairs: verified(pairs, *args), lambda nodes: sets_of(nodes, *args[:-1]), share)
    more = stored(more, "links")
    if not more.isEmpty():
        label = components(first.unionByName(more))
    return seen.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))


@shielded()
def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, nulls last.

    Rows are told apart by id and text, as ids may be null or repeated; of one id the text with the
    smallest hash stays. Documents without words are all kept, as they are linked with nothing. Rows that
    repeat the id and the text of another are reduced to one of them.
    """
    found = stored(rooted_rows(docs, id_column, text_column, words, share).where("node is not null").select("root", "doc_id", "text_key"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = found.groupBy("root").agg(F.min(order).alias("_first"))
    gone = found.join(first, "root").where(order != F.col("_first")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    same = F.col(id_column).cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(whole_text(text_column)) == F.col("_gone_key"))
    kept = docs.join(broadcast_if_small(gone), same, "left_anti")
    # Repeated rows are few: only they go through a grouping of whole rows.
    key = [F.col(id_column).cast("long").alias("_i"), F.xxhash64(whole_text(text_column)).alias("_k")]
    worded = docs.where(whole_text(text_column).rlike(r"[^\x20\x09-\x0D]"))
    again = worded.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    marked = kept.join(
        broadcast_if_small(again), F.col(id_column).cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(whole_text(text_column)) == F.col("_k")), "left"
    )
    once = marked.where("_k is not null").dropDuplicates(["_i", "_k"])
    return marked.where("_k is null").unionByName(once).select(*[f"`{c}`" for c in docs.columns])
