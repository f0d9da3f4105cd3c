"""Near duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified.

A register holds the smallest of exponentially distributed values of a set's elements, on a scale of powers of ``BASE``
and truncated to sixteen bits. Registers of a union are the larger ones of both sets, and the share of equal registers
grows with the similarity, so that sets with a band of equal registers are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored
from quarry.llm.jaccard_join import _ODD, _read, candidate_hubs, components, further_links, identity, mixed, sets_of, shingles, verified

REGISTERS = 256
BASE = 1.001
RATE = 20.0
LARGEST = (1 << 16) - 1
# Registers of a band; a link of similarity 0.85 meets in none of the 42 bands with probability 2e-9.
BAND = 6
# Candidates are dropped where their likelihood at the asked similarity is smaller by this much (natural logarithm).
DOUBT = 18.0
# Sets a task remembers, so that copies are sketched once.
KNOWN = 200_000


def sketch(own: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of a set of distinct 64-bit numbers.

    The ``j``-th value of an element is drawn from the ``j``-th of ``registers`` intervals, that of an exponential
    distribution cut into parts of equal probability, and goes to a register that the element has not yet had. No value of
    an interval is below those of the one before, so once all registers have a value they are final.
    """
    least = np.full(registers, np.inf)
    if len(own):
        start = mixed(own ^ _ODD[1])
        first, stride = start & np.uint64(registers - 1), (start >> np.uint64(20)) | np.uint64(1)
        steps = range(registers) if len(own) > 32 else [np.arange(registers, dtype=np.uint64)[None, :]]
        for step in steps:
            j = np.uint64(step) if isinstance(step, int) else step
            element, lead, jump = (x if isinstance(step, int) else x[:, None] for x in (own, first, stride))
            at = ((lead + j * jump) & np.uint64(registers - 1)).astype(np.int64)
            uniform = ((mixed(element + (j + np.uint64(1)) * _ODD[3]) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            k = np.float64(j) if isinstance(step, int) else j.astype(np.float64)
            value = (np.log(registers / (registers - k)) - np.log1p(-uniform / (registers - k))) / RATE
            if isinstance(step, int):
                open_ = np.flatnonzero(np.isinf(least[at]))
                order = open_[np.argsort(-value[open_], kind="stable")]
                # Of values for one register the smallest is written last.
                least[at[order]] = value[order]
                if not np.isinf(least).any():
                    break
            else:
                table = np.empty_like(value)
                np.put_along_axis(table, at, value, 1)
                least = table.min(0)
    with np.errstate(divide="ignore"):
        scaled = np.floor(1.0 - np.log(least) / np.log(BASE))
    return np.clip(scaled, 0, LARGEST).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def bands(sketched: np.ndarray, size: int = BAND) -> np.ndarray:
    """One key per band of registers, for each row of registers; registers that fill no band are left over."""
    count = sketched.shape[1] // size
    parts = sketched[:, : count * size].reshape(len(sketched), count, size).astype(np.uint64)
    key = np.tile(np.arange(1, count + 1, dtype=np.uint64) * _ODD[2], (len(sketched), 1))
    for i in range(size):
        key = mixed(key * _ODD[0] + parts[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def _part(x: np.ndarray) -> np.ndarray:
    """Probability that one register is larger, from the share ``x`` of elements that only its set has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(similarity: np.ndarray, nu: np.ndarray, nv: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Log likelihood of a similarity, given the sizes and how many registers of ``u`` are above, below and equal to those of ``v``."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    up, down = (_part(np.maximum(x, 1e-12)) for x in (u - v * similarity, v - u * similarity))
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def estimate(nu: np.ndarray, nv: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Similarity of the largest likelihood, by golden section: it has one maximum."""
    low, high = np.zeros(len(nu)), np.minimum(nu / nv, nv / nu)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left, nu, nv, above, below, equal) > likelihood(right, nu, nv, above, below, equal)
        low, high = np.where(better, low, left), np.where(better, right, high)
    return (low + high) / 2


def plausible(nu: np.ndarray, nv: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray, share: int) -> np.ndarray:
    """Whether a similarity of ``share`` percent is not ruled out by the sizes or much less likely than the estimate."""
    fits = np.minimum(nu, nv) * 100 >= share * np.maximum(nu, nv)
    best = estimate(nu, nv, above, below, equal)
    asked = likelihood(np.full(len(nu), share / 100), nu, nv, above, below, equal)
    return fits & ((best >= share / 100) | (likelihood(best, nu, nv, above, below, equal) - asked <= DOUBT))


def least_equal(share: int, registers: int = REGISTERS) -> int:
    """So many registers are equal at least in a plausible pair, with twice the doubt: a cheap test before the estimate."""
    e, s = np.arange(1, registers) / registers, share / 100
    against = registers * (e * np.log(e / s) + (1 - e) * np.log((1 - e) / (1 - s)))
    return int(np.flatnonzero((e < s) & (against > 2 * DOUBT)).max(initial=0))


def _matrix(points: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(points), np.uint16).reshape(len(points), -1)


def near_pairs(points: list[bytes], sizes: np.ndarray, class_of: np.ndarray, share: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different classes that are plausible links, row by row."""
    sketched, n = _matrix(points), sizes.astype(np.float64)
    least = least_equal(share, sketched.shape[1])
    for i in range(len(sketched) - 1):
        j = np.flatnonzero((class_of[i + 1 :] != class_of[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= share * np.maximum(n[i + 1 :], n[i]))) + i + 1
        j = j[np.count_nonzero(sketched[j] == sketched[i], axis=1) >= least]
        if not len(j):
            continue
        above, below = ((x).sum(1).astype(np.float64) for x in (sketched[i] > sketched[j], sketched[i] < sketched[j]))
        equal = sketched.shape[1] - above - below
        fits = plausible(np.full(len(j), n[i]), n[j], above, below, equal, share)
        yield from ((i, k) for k in j[fits][np.argsort(-equal[fits], kind="stable")].tolist())


def sketched_rows(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """``doc_id``, key of the text, size and number of its set, and its registers where the task meets the set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for batch in batches:
            sizes, nodes, points = [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column(2):
                    own = shingles(text.as_py(), words)
                    node = identity(own) if len(own) else None
                    sizes.append(len(own))
                    nodes.append(node)
                    points.append(None if node is None or node in known else sketch(own).tobytes())
                    if node is not None:
                        known.add(node)
            if len(known) > KNOWN:
                known.clear()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary())], names=["doc_id", "text_key", "n", "node", "point"])

    return _read(docs, id_column, text_column).mapInArrow(run, "doc_id long, text_key long, n long, node long, point binary")


def band_groups(sketches: DataFrame) -> DataFrame:
    """``key`` and ``node`` for every band that two sets or more have alike.

    Keys are counted with their smallest and largest set, combined before the shuffle; those with two sets are joined
    back, by a join that may split a key with many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                with np.errstate(over="ignore"):
                    keys = bands(_matrix(part.column("point").to_pylist()))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1]))], names=["key", "node"])

    keyed = sketches.select("node", "point").mapInArrow(run, "key long, node long")
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    return keyed.join(stored(several, "several"), "key")


def plausible_pairs(pairs: DataFrame, sketches: DataFrame, share: int) -> DataFrame:
    """The pairs (``u``, ``v``) that their registers do not rule out."""
    sides = [sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}")) for x in "uv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (_matrix(batch.column(c).to_pylist()) for c in ("pu", "pv"))
            nu, nv = (batch.column(c).to_numpy().astype(np.float64) for c in ("nu", "nv"))
            above, below = ((x).sum(1).astype(np.float64) for x in (u > v, u < v))
            fits = pa.array(plausible(nu, nv, above, below, u.shape[1] - above - below, share))
            yield pa.record_batch([batch.column("u").filter(fits), batch.column("v").filter(fits)], names=["u", "v"])

    return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "nu", "nv", "pu", "pv").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, share: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Documents are linked when their sets of ``words``-word shingles have at least ``share`` percent of their union in
    common; a component is named by its smallest document id, and the document of that id is kept. Equal sets are one set
    throughout. A set is first compared with its hub, the set under its band keys that shares most; sets under a
    key that are still apart are compared in tiles. Every link is verified on the whole sets (by 64-bit hashes of the
    shingles); a link is missed only if no band of registers is equal, with a probability of 2e-9 at 85 percent.

    A null or wordless text has no set, is linked with nothing and is its own component. Rows with a null id get the
    smallest id of their component, null if there is none. Repeated rows are each returned, of an id that is kept each
    one. An empty table gives no rows; other columns are ignored.
    """
    seen = stored(sketched_rows(docs, id_column, text_column, words), "sketched")
    sketches = stored(seen.where("point is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("point").alias("point")), "sketches")
    groups = stored(band_groups(sketches), "bands")
    args = (seen.drop("point"), docs, id_column, text_column, words)
    verify = lambda pairs: verified(pairs, *args, share)
    first = stored(verify(plausible_pairs(candidate_hubs(groups), sketches, share)), "links")
    label = components(first)
    more = further_links(groups, label, sketches, lambda *tile: near_pairs(*tile, share), verify, lambda nodes: sets_of(nodes, *args), share)
    more = stored(more, "links")
    if not more.isEmpty():
        label = components(first.unionByName(more))
    rooted = seen.drop("point").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.where("node is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    named = rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
