"""Packing of tokenised documents into windows by multiway differencing."""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, given_back, process_cache, small_batches, tokenizer, whole_text

CAPACITY = 4096
# Windows balanced together, and tokens by which their mean stays below the
# capacity, so that near-equal windows fit.
WINDOWS = 64
SLACK = 16
# Longest piece that goes into a pool: short ones leave differencing room to level out.
PIECE = 384
# Longest piece of a task's last pool, where one window more costs most.
LAST_PIECE = 96
# Words that a worker keeps; beyond them it begins anew, as most of them come once.
CACHED_CHUNKS = 150_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

# A Latin word, and words encoded as one text.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
JOINED = 2_000
# Where the tokenizer parts a Latin letter from a sign behind it. Not where a special string has a sign.
_PARTED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?*#$%&])"
# What lower case before the tokenizer could change: special strings, and letters that compose with a mark in one case only.
_CASED = "<\\||[\u0300-\u036f]"


class _Words:
    """Ids of the words that a worker has met, one behind the other."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        # The last token of a word of letters is told by the vocabulary's suffix.
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def add(self, chunks: list[str]) -> None:
        """Put the ids of new ``chunks`` behind the others; a Latin word is looked up in lower case, as the tokenizer lowers it."""
        words, others = [], []
        for chunk in chunks:
            (words if _WORD.fullmatch(chunk) else others).append(chunk)
        ids, sizes, done = [self.ids], [self.size], words.copy()
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            # One text of many words takes less time than as many texts; each word is one pre-token.
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(part) and ends[-1] == len(found):
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:
                others += part
                gone = set(part)
                done = [w for w in done if w not in gone]
        for at in range(0, len(others), 20_000):
            each = [x.ids for x in self.tokenizer.encode_batch_fast(others[at : at + 20_000], add_special_tokens=False)]
            ids.append(np.array([i for own in each for i in own], "<u4"))
            sizes.append(np.array([len(own) for own in each], np.int64))
        self.number.update(zip(done + others, range(len(self.size), len(self.size) + len(chunks)), strict=True))
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)


def document_ids(texts: pa.Array, path: str, end_id: int) -> list[bytes]:
    """Token ids of whole texts with ``end_id`` behind, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it nor across a Latin letter and a sign behind it, so that what
    stands between these borders is encoded alone: once for all texts, from the worker's words or in one batch, and
    gathered by number.
    """
    known = process_cache("words_" + path, lambda: _Words(path))
    if len(known.number) > CACHED_CHUNKS:
        known.clear()
    texts = texts.cast(pa.large_string())
    for blank in "\n\t\r":
        texts = pc.replace_substring(texts, blank, " ")
    # Behind the replacements: Arrow lowers a slice of an array wrongly.
    texts = pc.if_else(pc.match_substring_regex(texts, _CASED), texts, pc.ascii_lower(texts))
    chunks = pc.split_pattern(pc.replace_substring_regex(texts, _PARTED, r"\1 \2"), " ")
    coded = chunks.values.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    known.add([w for w in words if w not in known.number])
    number = np.fromiter(map(known.number.__getitem__, words), np.int64, len(words))
    first = (np.cumsum(known.size) - known.size)[number]
    length = known.size[number][at]
    end = np.cumsum(length)
    gathered = known.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(first[at] - (end - length), length)]
    edges = np.concatenate([[0], end])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
    last = struct.pack("<I", end_id)
    return [gathered[low:high].tobytes() + last for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item by Karmarkar-Karp differencing into ``windows`` sets.

    A partial partition is a vector of sums, largest first, less their minimum. The two with the
    largest imbalance are merged, the largest sum of one with the smallest of the other, until
    one is left.
    """
    n = len(sizes)
    sums = np.zeros((n, windows), np.int64)
    sums[:, 0] = sizes
    # Node of each sum: an item, a merge of two nodes, or none.
    nodes = np.full((n, windows), -1, np.int64)
    nodes[:, 0] = np.arange(n)
    heap = [(-int(size), i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges, made = [], n
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[first] + sums[second][::-1]
        left, right = nodes[first], nodes[second][::-1]
        both = (left >= 0) & (right >= 0)
        joined = np.where(left >= 0, left, right)
        count = int(both.sum())
        if count:
            joined[both] = np.arange(made, made + count)
            merges.append((made, left[both], right[both]))
            made += count
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[first], nodes[first] = total - total[-1], joined[order]
        heapq.heappush(heap, (-int(sums[first][0]), first))
    window = np.zeros(made, np.int64)
    last = nodes[heap[0][1]]
    window[last[last >= 0]] = np.flatnonzero(last >= 0)
    for start, left, right in reversed(merges):
        window[left] = window[right] = window[start : start + len(left)]
    return window[:n]


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Near-equal windows of at most ``capacity``; one more window whenever a window exceeds it."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes, windows).max() <= capacity:
            return window
        windows += 1


class _Packer:
    """Pools the pieces of one task and turns full pools into sequences."""

    def __init__(self, task: int, capacity: int, windows: int, slack: int, keep_ids: bool):
        self.sequence, self.capacity, self.slack, self.keep_ids = task << 32, capacity, slack, keep_ids
        self.mean = capacity - slack
        self.block = windows * self.mean
        self.pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.pooled = 0
        self.out: list[list] = [[] for _ in range(8)]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, start = len(ids) // 4, 0
        while tokens - start >= self.capacity:
            self._sequence([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], tokens)])
            start += self.capacity
        self.pooled += tokens - start
        for at in range(start, tokens, PIECE):
            self.pool.append((doc_id, at, ids[4 * at : 4 * (at + PIECE)], tokens))
        while self.pooled >= self.block:
            self._balance(self._take(self.block))

    def end(self) -> None:
        """Pack what is left: whole windows, then lengths that are powers of two and need no padding."""
        if windows := self.pooled // self.mean:
            pieces = self._take(windows * self.mean)
            self._balance([(doc_id, start + at // 4, ids[at : at + 4 * LAST_PIECE], whole) for doc_id, start, ids, whole in pieces for at in range(0, len(ids), 4 * LAST_PIECE)])
        while self.pooled:
            self._sequence(self._take(1 << (self.pooled.bit_length() - 1)))

    def _take(self, tokens: int) -> list[tuple]:
        """The first pieces of the pool, the last one cut so that they have ``tokens`` tokens."""
        taken, at = [], 0
        self.pooled -= tokens
        while tokens:
            doc_id, start, ids, whole = self.pool[at]
            if len(ids) // 4 > tokens:
                taken.append((doc_id, start, ids[: 4 * tokens], whole))
                self.pool[at] = (doc_id, start + tokens, ids[4 * tokens :], whole)
                break
            taken.append(self.pool[at])
            tokens -= len(ids) // 4
            at += 1
        del self.pool[:at]
        return taken

    def _balance(self, pieces: list[tuple]) -> None:
        window = balanced(np.array([len(p[2]) // 4 for p in pieces], np.int64), self.capacity)
        order = np.argsort(window, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(window[order])) + 1):
            self._sequence([pieces[i] for i in part])

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, whole in pieces:
            row = (doc_id, start, len(ids) // 4, zlib.crc32(ids), whole, self.sequence, offset, ids if self.keep_ids else None)
            for column, value in zip(self.out, row, strict=True):
                column.append(value)
            offset += len(ids) // 4
        self.sequence += 1

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.out, schema, strict=True)], schema=schema)
        self.out = [[] for _ in range(8)]
        return batch


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    slack: int = SLACK,
    keep_ids: bool = True,
) -> DataFrame:
    """Sequences of at most ``capacity`` tokens, one row per piece of a document.

    Every task tokenises its documents, cuts full windows off long ones and pools the rest. A pool
    of ``windows`` windows' worth is balanced by multiway differencing and leaves the task's memory;
    nothing is shuffled. What remains at the end of a task goes into windows too, and the last part
    of a window into sequences whose lengths are powers of two.

    A null text is empty and a document without tokens is the end id alone. Repeated rows and
    repeated or null ids are packed each for itself. An empty table gives no rows. Other columns are
    ignored. A text of any length is cut; nothing is dropped. A sequence's number holds the number
    of the task, so a task that runs again gives the same numbers.
    """
    schema = pa.schema(
        [(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [("ids", pa.binary())]
    )

    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(TaskContext.get().partitionId(), capacity, windows, slack, keep_ids)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 500):
                part = ids[at : at + 500]
                for doc_id, own in zip(part, document_ids(texts.slice(at, 500), path, end_id), strict=True):
                    packer.add(doc_id, own)
                # Sequences of a part leave before the next: a worker never holds the ids of a whole batch.
                yield packer.rows(schema)
            give_back()
        packer.end()
        yield packer.rows(schema)

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return narrow.mapInArrow(run, PIECES)
