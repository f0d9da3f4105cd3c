"""Prefix trie of conversations, its subtrees delimited in balanced parentheses.

Conversations are sequences of turns, a node is a distinct sequence of first turns. Node keys are polynomial hashes
of the turns, so that all nodes come from one ordered pass and a grouping. What only one conversation has is a chain
that ends in one leaf. The shared part is sorted by path and dealt into shards; a shard is written as balanced
parentheses, where the matching parenthesis delimits a subtree, the rank of ``()`` counts its leaves and cumulative
sums give its savings. Nodes on the border of shards, the shared spines, are merged by adding up.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.session import broadcast_if_small

FAMILY = 100
HEADS = 6
# Positions of an excess block, of a shard, leaves that one row of a path stands for, ids of a joined segment.
EXCESS_BLOCK = 64
SHARD = 1 << 18
LEAVES = 1 << 16
SEGMENT = 4_096

# Odd multipliers of the two lanes of a node's key, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_KEY = ["d", "p1", "p2"]


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent modulo 2**64."""
    out, square, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.int64)
    while left.any():
        out[left & 1 == 1] *= np.uint64(square)
        square, left = square * square % (1 << 64), left >> 1
    return out


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], names=list(columns))


def numbered(turns: DataFrame, slices: int) -> DataFrame:
    """Turns without their texts: ``conv_id, slice, k, t1, t2, s1, s2, chars``.

    Turns are sorted by conversation and place in ranges (``slice``) that may cut a conversation. ``k`` is the place
    within conversation and slice, ``t1`` and ``t2`` are hashes of the turn, ``s1`` and ``s2`` their sums up to here,
    each times the multiplier to the power of ``k``.
    """
    order = ["conv_id", "turn", "role", "text"]
    # Equal turns are told apart by a number, so that no run of them, however long, is one range.
    hashed = turns.withColumn("row", F.monotonically_increasing_id())
    sorted_ = hashed.repartitionByRange(slices, *order, "row").sortWithinPartitions(*order, "row")
    narrow = sorted_.select("conv_id", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2"), F.length("text").cast("long").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        last, placed, sums = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            length = np.diff(np.concatenate([first, [len(conv)]]))
            start = np.repeat(first, length)
            carried = np.arange(len(conv)) < (length[0] if conv[0] == last else 0)
            k = np.arange(len(conv)) - start + 1 + np.where(carried, placed, 0)
            out = {"conv_id": conv, "slice": np.full(len(conv), own, np.int32), "k": k}
            lanes = []
            with np.errstate(over="ignore"):
                for base, name, before in zip(_BASES, ("t1", "t2"), sums, strict=True):
                    out[name] = _unsigned(batch, name)
                    part = out[name] * _powers(base, k)
                    total = np.cumsum(part)
                    total = total - (total - part)[start] + np.where(carried, before, np.uint64(0))
                    lanes.append(total)
            out |= {"s1": lanes[0], "s2": lanes[1], "chars": batch.column("chars").to_numpy()}
            last, placed, sums = conv[-1], int(k[-1]), [lane[-1] for lane in lanes]
            yield _batch(out)

    return narrow.mapInArrow(run, "conv_id long, slice int, k long, t1 long, t2 long, s1 long, s2 long, chars long")


def _offsets(turns: DataFrame) -> DataFrame:
    """Turns and sums before each slice of the conversations that lie in several; two rows a slice at most."""
    cut = turns.groupBy("conv_id").agg(F.min("slice").alias("low"), F.max("slice").alias("high")).where("low < high").select("conv_id")
    ends = turns.join(broadcast_if_small(cut), "conv_id").groupBy("conv_id", "slice").agg(F.max(F.struct("k", "s1", "s2")).alias("e")).orderBy("conv_id", "slice").collect()
    rows, conv, before = [], None, (0, 0, 0)
    for end in ends:
        if end["conv_id"] != conv:
            conv, before = end["conv_id"], (0, 0, 0)
        rows.append((conv, end["slice"], before[0], *[((b + (1 << 63)) % (1 << 64)) - (1 << 63) for b in before[1:]]))
        shift = [pow(base, before[0], 1 << 64) for base in _BASES]
        before = (before[0] + end["e"]["k"], *[(b + s * e) % (1 << 64) for b, s, e in zip(before[1:], shift, (end["e"]["s1"], end["e"]["s2"]), strict=True)])
    return turns.sparkSession.createDataFrame(rows, "conv_id long, slice int, k0 long, o1 long, o2 long")


def placed(turns: DataFrame) -> DataFrame:
    """``numbered`` turns with ``no``, the place in the whole conversation, and sums to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k0 = batch.column("k0").to_numpy()
            out = {"conv_id": batch.column("conv_id").to_numpy(), "no": batch.column("k").to_numpy() + k0, "t1": _unsigned(batch, "t1"), "t2": _unsigned(batch, "t2")}
            with np.errstate(over="ignore"):
                for i, base in enumerate(_BASES, 1):
                    out[f"s{i}"] = _unsigned(batch, f"o{i}") + _powers(base, k0) * _unsigned(batch, f"s{i}")
            yield _batch(out | {"chars": batch.column("chars").to_numpy()})

    # Two rows a slice at most.
    joined = turns.join(F.broadcast(_offsets(turns)), ["conv_id", "slice"], "left").fillna(0, ["k0", "o1", "o2"])
    return joined.mapInArrow(run, "conv_id long, no long, t1 long, t2 long, s1 long, s2 long, chars long")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per member of a node: ``d``, its key ``p1, p2``, its parent's ``q1, q2``, ``conv_id``, ``chars``, ``ends``.

    A conversation's first turns are those of the first one of its family, as many as ``crc32(conv_id) % heads``; its own
    follow after as many. Places of own turns move where the family's first one is shorter.
    """
    crc = F.crc32(F.col("conv_id").cast("string")) % heads
    counted = turns.groupBy("conv_id").agg(F.max("no").alias("turns"))
    convs = counted.select("conv_id", "turns", crc.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    # At most ``heads - 1`` turns of each family.
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("no") < heads)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("no", "t1", "t2", "s1", "s2", "chars"))).alias("head")
    )
    skipped = turns.where(F.col("no") < heads).where(F.col("no") == F.crc32(F.col("conv_id").cast("string")) % heads).select("conv_id", F.col("s1").alias("h1"), F.col("s2").alias("h2"))
    known = convs.join(first, "base", "left").join(skipped, "conv_id", "left")
    known = known.withColumn("head", F.filter(F.coalesce("head", F.array()), lambda x: x["no"] <= F.col("h"))).withColumn("b", F.size("head").cast("long"))
    known = known.withColumn("length", F.col("b") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))
    known = stored(known.withColumn("last", F.try_element_at("head", F.lit(-1))), "conversations")
    zero = F.lit(0).cast("long")
    roots = known.select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"), zero.alias("t1"), zero.alias("t2"), "conv_id", zero.alias("chars"), (F.col("length") == 0).alias("ends"))
    opened = known.select("conv_id", "length", F.explode("head").alias("x")).select(
        F.col("x.no").alias("d"), F.col("x.s1").alias("p1"), F.col("x.s2").alias("p2"), F.col("x.t1").alias("t1"), F.col("x.t2").alias("t2"), "conv_id", F.col("x.chars").alias("chars"), (F.col("x.no") == F.col("length")).alias("ends")
    )
    narrow = known.where(F.col("turns") > F.col("h")).select(
        "conv_id", "h", "b", "length", *[F.coalesce(f"h{i}", zero).alias(f"h{i}") for i in (1, 2)], *[F.coalesce(f"last.s{i}", zero).alias(f"l{i}") for i in (1, 2)]
    )

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, b, no = (batch.column(c).to_numpy() for c in ("h", "b", "no"))
            d = b + no - h
            out = {"d": d}
            with np.errstate(over="ignore"):
                for i, inverse in enumerate(_INVERSE, 1):
                    moved = _powers(inverse, h - b) * (_unsigned(batch, f"s{i}") - _unsigned(batch, f"h{i}"))
                    out[f"p{i}"] = _unsigned(batch, f"l{i}") + moved
            out |= {"t1": _unsigned(batch, "t1"), "t2": _unsigned(batch, "t2"), "conv_id": batch.column("conv_id").to_numpy(), "chars": batch.column("chars").to_numpy()}
            yield _batch(out | {"ends": d == batch.column("length").to_numpy()})

    own = turns.join(narrow, "conv_id").where("no > h")
    members = "d long, p1 long, p2 long, t1 long, t2 long, conv_id long, chars long, ends boolean"
    every = roots.unionByName(opened).unionByName(own.mapInArrow(shift, members))

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            out = {"d": d}
            with np.errstate(over="ignore"):
                for i, base in enumerate(_BASES, 1):
                    out[f"p{i}"] = _unsigned(batch, f"p{i}")
                    out[f"q{i}"] = out[f"p{i}"] - _unsigned(batch, f"t{i}") * _powers(base, d)
            yield _batch(out | {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("conv_id", "chars", "ends")})

    return every.mapInArrow(parents, "d long, p1 long, q1 long, p2 long, q2 long, conv_id long, chars long, ends boolean")


class Parentheses:
    """A balanced sequence (true opens) with the least excess of each block and of runs of blocks."""

    def __init__(self, bits: np.ndarray, block: int = EXCESS_BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int32)
        blocks = max(1, -(-len(bits) // block))
        padded = np.full(blocks * block, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(blocks, block)
        self.least = [self.rows.min(1)]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            if len(low) % 2:
                low = self.least[-1] = np.append(low, np.iinfo(np.int32).max)
            self.least.append(low.reshape(-1, 2).min(1))
        self.pairs = np.concatenate([[0], np.cumsum(bits[:-1] & ~bits[1:]), [0]])
        self.pairs[-1] = self.pairs[-2]

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The matching parenthesis of each open one: the next place of a smaller excess."""
        out = np.zeros(len(opens), np.int64)
        for at in range(0, len(opens), 65_536):
            out[at : at + 65_536] = self._find(opens[at : at + 65_536])
        return out

    def _find(self, opens: np.ndarray) -> np.ndarray:
        target, block = self.excess[opens], opens // self.block
        here = (self.rows[block] < target[:, None]) & (np.arange(self.block) > (opens % self.block)[:, None])
        out = block * self.block + here.argmax(1)
        left = np.flatnonzero(~here.any(1))
        node = block[left]
        for level in range(len(self.least) - 1):
            if not len(left):
                break
            # The run on the right of a left one is the next to look at; else up.
            hit = (node % 2 == 0) & (self.least[level][np.minimum(node + 1, len(self.least[level]) - 1)] < target[left])
            found, place = left[hit], node[hit] + 1
            for below in range(level - 1, -1, -1):
                place = 2 * place + (self.least[below][2 * place] >= target[found])
            out[found] = place * self.block + (self.rows[place] < target[found][:, None]).argmax(1)
            left, node = left[~hit], node[~hit] // 2
        return out

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Pairs ``()`` from each open parenthesis to its close."""
        return self.pairs[closes] - self.pairs[opens]


def encoded(paths: list[list[tuple]], alone: list[int]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Nodes ``(d, p1, p2)`` of sorted paths, their leaves, savings and closes.

    A path is a list of ``(d, p1, p2, saved)``; ``alone`` leaves hang below its last node.
    """
    nodes, places, values = [(0, 0, 0)], [0], [0]
    parts, size, before = [np.ones(1, bool)], 1, []
    for path, count in zip(paths, alone, strict=True):
        both = 0
        while both < min(len(path), len(before)) and path[both][:3] == before[both][:3]:
            # The savings of a node come with one of its paths.
            if path[both][3]:
                values[before[both][4]] += path[both][3]
            both += 1
        bits = np.zeros(len(before) - both + len(path) - both + 2 * count, bool)
        at = len(before) - both
        held = before[:both]
        for step in path[both:]:
            bits[at] = True
            held.append((*step[:3], 0, len(nodes)))
            nodes.append(step[:3])
            places.append(size + at)
            values.append(step[3])
            at += 1
        bits[at::2] = True
        parts.append(bits)
        size += len(bits)
        before = held
    parts.append(np.zeros(len(before) + 1, bool))
    sequence = Parentheses(np.concatenate(parts))
    opens = np.array(places)
    closes = sequence.find_close(opens)
    total = np.zeros(len(sequence.bits) + 1, np.int64)
    total[opens + 1] = values
    total = np.cumsum(total)
    return nodes, sequence.leaves(opens, closes), total[closes + 1] - total[opens], closes


def subtrees(paths: DataFrame, shards: int, shard: int = SHARD) -> DataFrame:
    """``d, p1, p2, n_leaves, saved_tokens`` of all nodes on ``path``s (``path``, ``alone``), by shards of sorted paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alone, size = [], [], 0

        def end() -> pa.RecordBatch:
            nodes, leaves, saved, _ = encoded(held, alone)
            key = np.array(nodes, np.int64).T
            return _batch({"d": key[0], "p1": key[1], "p2": key[2], "n_leaves": leaves, "saved_tokens": saved})

        for batch in batches:
            for path, count in zip(batch.column("path"), batch.column("alone").to_pylist(), strict=True):
                own = [(x["d"], x["p1"], x["p2"], x["saved"]) for x in path.as_py()]
                held.append(own)
                alone.append(count)
                size += 2 * (len(own) + count)
                if size >= shard:
                    yield end()
                    held, alone, size = [], [], 0
        if held:
            yield end()

    order = F.transform("path", lambda x: F.struct(x["p1"], x["p2"]))
    dealt = paths.withColumn("order", order).repartitionByRange(shards, "order").sortWithinPartitions("order").select("path", "alone")
    parts = dealt.mapInArrow(run, "d long, p1 long, p2 long, n_leaves long, saved_tokens long")
    return parts.groupBy(*_KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def joined_digests(ends: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """SHA-256 of the comma-joined sorted ``conv_id`` of each node.

    Ids are sorted in ranges that may cut a node and joined to segments there; only segments meet in the order of a
    node, and stream through its hash.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def leave(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names=[*_KEY, "first", "ids"])

        for batch in batches:
            rows = []
            for *own, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != key or len(ids) >= segment:
                    if ids:
                        rows.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = own, []
                ids.append(conv)
            if rows:
                yield leave(rows)
        if ids:
            yield leave([(*key, ids[0], ",".join(map(str, ids)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def leave(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*_KEY, "digest"])

        for batch in batches:
            rows = []
            for *own, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if rows:
                yield leave(rows)
        if key is not None:
            yield leave([(*key, state.hexdigest())])

    segments = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(write, "d long, p1 long, p2 long, first long, ids string")
    return segments.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "d long, p1 long, p2 long, digest string")


def trie(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    family: int = FAMILY,
    heads: int = HEADS,
    shard: int = SHARD,
) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations (see ``rebuilt``).

    Columns: ``conv_id`` (the smallest member's), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Turns are ordered by ``turn``, null first, then role and text. Nodes are told
    apart by 128-bit hashes.

    A null role or text is empty; turns without a conversation id take no part. Repeated turns count each. A conversation
    may have any number of turns: it is cut where others are dealt. The shared nodes of one conversation are held
    in a row (32 bytes each). An empty table gives no rows; other columns are ignored.
    """
    spark = conversations.sparkSession
    read = conversations.select(
        F.col(id_column).cast("long").alias("conv_id"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).where("conv_id is not null")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = stored(placed(stored(numbered(read, slices), "turns")), "placed")
    rows = stored(rebuilt(turns, family, heads), "members")
    nodes = stored(
        rows.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
            F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end_conv"),
        ),
        "nodes",
    )
    common = nodes.where("n_convs > 1")
    above = common.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv"))
    linked = stored(nodes.where("d > 0").join(above, ["d", "q1", "q2"], "left"), "linked").unionByName(nodes.where("d = 0").withColumn("parent_conv", F.lit(None).cast("long")))
    single = F.col("n_convs") == 1
    kids = linked.where("parent_conv is not null").groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(single).alias("alone"), F.min(F.when(single, F.col("conv_id"))).alias("alone_conv")
    )
    shared = linked.where("n_convs > 1").join(kids, _KEY, "left").fillna(0, ["n_children", "alone"])
    shared = stored(shared.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "shared")

    # Paths end at shared nodes that are leaves or have unshared children; one conversation stands for each.
    ending = shared.where("n_children = 0 or alone > 0").select(F.coalesce("alone_conv", "end_conv").alias("conv_id"), F.col("d").alias("to"), "alone")
    steps = stored(rows.where("d > 0").join(ending, "conv_id").where("d <= to").select("conv_id", *_KEY), "steps")
    # The savings of a node go with one of its paths.
    savings = steps.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id")).join(shared.select(*_KEY, "saved"), _KEY).select("conv_id", "d", "saved")
    drawn = steps.join(savings, ["conv_id", "d"], "left").fillna(0, ["saved"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("d", "p1", "p2", "saved"))).alias("path"))
    whole = ending.join(drawn, "conv_id", "left").withColumn("path", F.coalesce("path", F.array()))
    # Many unshared children are dealt over several rows of a path; its savings go with the first.
    parts = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("alone") - 1, F.lit(0)) / LEAVES))))
    parts = parts.select(
        F.when(F.col("part") == 0, F.col("path")).otherwise(F.transform("path", lambda x: x.withField("saved", F.lit(0).cast("long")))).alias("path"),
        F.least(F.col("alone") - F.col("part") * LEAVES, F.lit(LEAVES)).cast("long").alias("alone"),
    )
    parts = stored(parts, "paths")
    size = parts.agg(F.coalesce(F.sum(F.size("path") + F.col("alone")), F.lit(0))).first()[0]
    shards = max(1, -(-2 * size // shard), min(spark.sparkContext.defaultParallelism, size // 1_000))
    below = subtrees(parts, shards, shard)

    many = shared.where("n_ends > 1").select(*_KEY)
    digests = joined_digests(rows.where("ends").join(many, _KEY).select(*_KEY, "conv_id"))
    few = F.sha2(F.when(F.col("n_ends") == 1, F.col("end_conv").cast("string")).otherwise(""), 256)
    out = ["conv_id", F.col("d").alias("depth")]
    more = shared.join(below, _KEY, "left").join(digests, _KEY, "left").select(
        *out, F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", few).alias("ends_sha256")
    )
    once = linked.where(single).select(
        *out, F.when(F.col("d") > 0, F.coalesce("parent_conv", "conv_id")).alias("parent_conv_id"), "n_convs", (1 - F.col("n_ends")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), few.alias("ends_sha256"),
    )
    return more.unionByName(once)
