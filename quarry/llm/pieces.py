"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and lossless decoding."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import process_cache, whole_text

# Smoothing of the piece weights: 0 draws all segmentations alike, large values the best one.
ALPHA = 0.6
CACHED_SEGMENTS = 120_000
# Characters segmented together.
BATCH_CHARS = 600_000
CACHED_LENGTH = 64
SPACE = "▁"
# A run of blanks with what stands behind it, up to the next blank, or to where a Latin word meets
# one of these signs. No piece may cross either border.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?|#*$%&\n"
_SEGMENT = re.compile(f" *[{_LETTERS}]+(?=[{_SIGNS}])| *[^ ]+| +")
_CROSSING = re.compile(f"[{_LETTERS}][{_SIGNS}]|[^ ] ")


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


class Vocabulary:
    """Pieces of a model with weights, read once per worker.

    A vocabulary of merges has ranks for scores. Piece weights are taken from the rank r as
    -log(2 + r), the shape of a unigram distribution. Pieces are found by a polynomial hash of
    their code points, in step with that of their beginnings.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.weight = np.zeros(size)
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        pieces = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if _CROSSING.search(piece.replace(SPACE, " ")):
                    raise ValueError("a piece crosses a segment border")
                pieces.append((-model.get_score(i), i, piece.replace(SPACE, " ")))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        whole: dict[int, int] = {}
        beginnings = set()
        for rank, (_, i, piece) in enumerate(sorted(pieces)):
            self.weight[i] = -alpha * math.log(2.0 + rank)
            value = 0
            for point in _points(piece).tolist():
                value = (value * int(_BASE) + point) & 0xFFFFFFFFFFFFFFFF
                beginnings.add(value)
            whole[value] = i
        self.beginnings = np.array(sorted(beginnings), np.uint64)
        self.piece_at = np.array([whole.get(value, -1) for value in self.beginnings.tolist()], np.int32)
        # A byte piece is less likely than any other.
        self.byte_weight = -alpha * math.log(2.0 + len(pieces)) - 4.0


class Lattices:
    """Lattices of all segments met so far, laid out as one graph.

    Node k of a segment stands for its first k characters. The edges into a node carry one piece
    each and the probability, given by the forward sums, that a path through the node comes along
    them, as running sums of 31 bits. A character that no piece ends with has one edge; where it
    takes several bytes, the edge carries -1 - its code point.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}
        self.nodes = self.edges = 0
        # Where each node's edges end, and the edges: running sum, piece, node they come from.
        self.graph = [np.zeros(1 << 12, kind) for kind in (np.int64, np.uint32, np.int32, np.int32)]

    def add(self, segments: list[str]) -> None:
        """Forward filtering for new segments, all of one length step at a time."""
        if not segments:
            return
        v = self.vocabulary
        sizes = np.array([len(s) for s in segments], np.int64)
        stops = np.cumsum(sizes)
        points = _points("".join(segments))
        n = len(points)
        stop_of = np.repeat(stops, sizes)
        # Node of the place before character i of segment s is i + s.
        number = np.repeat(np.arange(len(segments)), sizes)
        start, value, size, parts = np.arange(n), np.zeros(n, np.uint64), 0, []
        while len(start):
            with np.errstate(over="ignore"):
                value = value * _BASE + points[start + size]
            size += 1
            at = np.minimum(np.searchsorted(v.beginnings, value), len(v.beginnings) - 1)
            begun = v.beginnings[at] == value
            start, value, at = start[begun], value[begun], at[begun]
            piece = v.piece_at[at]
            hit = piece >= 0
            parts.append((start[hit] + number[start[hit]], np.full(int(hit.sum()), size), piece[hit]))
            more = start + size < stop_of[start]
            start, value = start[more], value[more]
        source, length, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        target = source + length
        nodes = n + len(segments)
        reached = np.zeros(nodes, bool)
        reached[target] = True
        firsts = stops - sizes + np.arange(len(segments))
        reached[firsts] = True
        lone = np.flatnonzero(~reached)
        segment_of = np.searchsorted(firsts, lone, side="right") - 1
        sign = (points[lone - 1 - segment_of] - np.uint64(1)).astype(np.int64)
        written = np.where(sign < 128, v.byte_id[np.minimum(sign, 127)], -1 - sign).astype(np.int32)
        weight = np.concatenate([v.weight[piece], v.byte_weight * (1 + (sign > 127) + (sign > 2047) + (sign > 65535))])
        source, target, piece = np.concatenate([source, lone - 1]), np.concatenate([target, lone]), np.concatenate([piece, written])
        # Forward sums, by place in the segment.
        place = target - firsts[np.searchsorted(firsts, target, side="right") - 1]
        order = np.lexsort((source, target, place))
        source, target, piece, weight, place = (x[order] for x in (source, target, piece, weight, place))
        forward, share = np.zeros(nodes), np.empty(len(source))
        borders = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]) if len(place) else np.zeros(1, np.int64)
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            into = target[low:high]
            first = np.concatenate([[0], np.flatnonzero(np.diff(into)) + 1])
            log = forward[source[low:high]] + weight[low:high]
            most = np.maximum.reduceat(log, first)
            each = np.diff(np.concatenate([first, [high - low]]))
            part = np.exp(log - np.repeat(most, each))
            total = np.add.reduceat(part, first)
            share[low:high] = part / np.repeat(total, each)
            forward[into[first]] = most + np.log(total)
        order = np.argsort(target, kind="stable")
        source, target, piece, share = source[order], target[order], piece[order], share[order]
        degree = np.bincount(target, minlength=nodes)
        ends = np.cumsum(degree)
        # Running sums, one rank of edges at a time.
        sums, run, rank = np.zeros(len(source), np.uint32), np.zeros(nodes), 0
        with_edges = np.flatnonzero(degree)
        while len(with_edges):
            edge = ends[with_edges] - degree[with_edges] + rank
            run[with_edges] += share[edge]
            last = degree[with_edges] == rank + 1
            sums[edge] = np.where(last, 2.0**31, np.minimum(run[with_edges] * 2.0**31, 2.0**31)).astype(np.uint32)
            with_edges, rank = with_edges[~last], rank + 1
        for i, (new, done) in enumerate(((ends + self.edges, self.nodes), (sums, self.edges), (piece, self.edges), (source + self.nodes, self.edges))):
            if done + len(new) > len(self.graph[i]):
                larger = np.zeros(2 * (done + len(new)), self.graph[i].dtype)
                larger[:done] = self.graph[i][:done]
                self.graph[i] = larger
            self.graph[i][done : done + len(new)] = new
        self.last.update(zip(segments, (self.nodes + firsts + sizes).tolist(), strict=True))
        self.nodes += nodes
        self.edges += len(source)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sample(texts: list[str], keys: np.ndarray, lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and where each text's ids begin and end.

    Backward sampling over the lattices: all segments of all texts take one step back at a time.
    The random number of a step is a hash of the row key, the segment's place and the step, so a
    text's segmentation depends on nothing else. A blank goes before each text, as the vocabulary
    expects; a mark for blanks that stands in a text itself has no piece and is written as bytes.
    """
    segments = [_SEGMENT.findall(" " + text) if text else [] for text in texts]
    if len(lattices.last) > CACHED_SEGMENTS:
        lattices.clear()
    known = lattices.last
    every = list(chain.from_iterable(segments))
    missing = list(set(every).difference(known))
    lattices.add(missing)
    borders, sums, pieces, sources = lattices.graph
    counts = np.fromiter(map(len, segments), np.int64, len(segments))
    nodes = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
    for segment in missing:
        if len(segment) > CACHED_LENGTH:
            del known[segment]
    begin = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        place = (np.arange(len(nodes)) - np.repeat(begin[:-1], counts)).astype(np.uint64)
        seed = _mixed(np.repeat(keys.view(np.uint64), counts) ^ _mixed(place + np.uint64(1)))
    active = np.arange(len(nodes))
    path, length, step = [], np.zeros(len(nodes), np.int64), 0
    while len(active):
        step += 1
        at = nodes[active]
        edge = borders[at - 1]
        with np.errstate(over="ignore"):
            random = (_mixed(seed[active] + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.uint32)
        # Move on to the edge whose share holds the random number.
        open_ = np.arange(len(active))
        while len(open_ := open_[random[open_] >= sums[edge[open_]]]):
            edge[open_] += 1
        path.append((active, pieces[edge]))
        length[active] += 1
        at = sources[edge].astype(np.int64)
        nodes[active] = at
        # A first node has no edges: its border is that of the node before.
        active = active[(at > 0) & (borders[at] > borders[np.maximum(at - 1, 0)])]
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for back, (who, what) in enumerate(path):
        out[ends[who] - 1 - back] = what
    begin = np.concatenate([[0], ends])[begin]
    wide = np.flatnonzero(out < 0)
    if not len(wide):
        return out, begin
    # Characters of several bytes take as many places.
    written = [chr(-1 - code).encode("utf-8", "surrogatepass") for code in out[wide].tolist()]
    repeat = np.ones(len(out), np.int64)
    repeat[wide] = [len(w) for w in written]
    moved = np.concatenate([[0], np.cumsum(repeat)])
    out = np.repeat(out, repeat)
    out[out < 0] = lattices.vocabulary.byte_id[np.frombuffer(b"".join(written), np.uint8)]
    return out, moved[begin]


def lattices_of(path: str, alpha: float) -> Lattices:
    known = process_cache("piece_lattices", dict)
    if (path, alpha) not in known:
        known[path, alpha] = Lattices(Vocabulary(path, alpha))
    return known[path, alpha]


def segment(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, alpha: float = ALPHA
) -> DataFrame:
    """``doc_id``, ``text`` and ``pieces`` of every row, the pieces drawn with a key made of seed and id.

    A null text is empty and has no pieces; a null id is a key of its own. Repeated rows are
    segmented alike, whatever the partitioning. An empty table gives no rows; other columns are
    ignored. Texts of any length are segmented whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = np.cumsum(np.array(pc.utf8_length(batch.column(1)), np.int64)), 0
            while at < len(size):
                before = size[at - 1] if at else 0
                part = batch.slice(at, max(1, int(np.searchsorted(size, before + BATCH_CHARS)) - at))
                ids, ends = sample(part.column(1).to_pylist(), np.array(part.column(2), np.int64), lattices_of(path, alpha))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column(0), part.column(1), lists], names=["doc_id", "text", "pieces"])
                at += part.num_rows

    read = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"), F.xxhash64(F.lit(seed), F.col(id_column)).alias("key"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, text string, pieces array<int>")


def texts_of(lists: pa.Array, content: pa.Array) -> pa.Array:
    """Texts of lists of piece ids, whose bytes ``content`` has, without the character that goes before each text; null for null."""
    edges = np.concatenate([[0], np.cumsum(np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64))])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), content.take(lists.flatten())), b"")
    joined = pc.if_else(lists.is_valid(), joined, None)
    try:
        return pc.utf8_slice_codeunits(joined.cast(pa.string()), 1, None)
    except pa.ArrowInvalid:
        # Ids in an order that no text has.
        return pa.array([None if x is None else x.decode("utf-8", "replace")[1:] for x in joined.to_pylist()], pa.string())


def decode(pieces: DataFrame, path: str, column: str = "pieces", into: str = "decoded") -> DataFrame:
    """``pieces`` with the text of its piece ids, also of ids that hold bytes; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = pa.array(lattices_of(path, ALPHA).vocabulary.bytes_of, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.record_batch([*part.columns, texts_of(part.column(column), content)], names=[*part.schema.names, into])

    return pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField(into, T.StringType())]))
