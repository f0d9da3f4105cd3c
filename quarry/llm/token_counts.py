"""Token counts of whole texts by a map-side two-tier lookup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import process_cache, tokenizer, whole_text

# Bounds of the table of frequent pre-tokens, of a worker's cache, of what a task counts at a time
# and leaves for the table, and of a pre-token's length there. They affect speed, never a count.
FREQUENT = 50_000
CACHED = 300_000
COUNTED = 400_000
HEAVY = 20_000
LONGEST = 64

# White space as the tokenizer's patterns know it.
_BLANK = "\t-\r \x85\xa0  -     　"
# Blanks and what follows up to the next blank: no pre-token crosses such a
# border, and what happens inside does not depend on the neighbours.
_CHUNK = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")


def _lengths(chunks: list[str], path: str) -> list[int]:
    """Tokens of each chunk by the tokenizer itself."""
    found = []
    for at in range(0, len(chunks), 20_000):
        found += [len(e) for e in tokenizer(path).encode_batch_fast(chunks[at : at + 20_000], add_special_tokens=False)]
    return found


def frequent_lengths(docs: DataFrame, path: str, text_column: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pre-tokens, counted over all whole texts.

    A task counts its pre-tokens and now and then drops the rarest, so that it holds a bounded number; it leaves
    its ``HEAVY`` most frequent ones with their counts. These short lists are added up, and the ``FREQUENT`` largest
    sums are collected; no other pre-token leaves its task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 500):
                for text in texts.slice(at, 500).to_pylist():
                    counted.update(_CHUNK.findall(text))
                if len(counted) > COUNTED:
                    counted = Counter(dict(counted.most_common(COUNTED // 4)))
        best = [(chunk, n) for chunk, n in counted.most_common(HEAVY) if len(chunk) <= LONGEST]
        yield pa.record_batch([pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.int64())], names=["chunk", "n"])

    heavy = docs.select(whole_text(text_column).alias("text")).mapInArrow(count, "chunk string, n long")
    best = heavy.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(FREQUENT).collect()
    chunks = [row["chunk"] for row in best]
    return dict(zip(chunks, _lengths(chunks, path), strict=True))


def count_tokens(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row, without a shuffle.

    A task looks each pre-token up in the broadcast table of frequent ones, then in its worker's
    cache; what is in neither is encoded in one batch. The counts are those of the library on the
    whole text, with its default handling of special strings.

    A null text is empty and has no tokens. Ids may be null or repeated, every row is counted for
    itself. An empty table gives no rows; other columns are ignored. A chunk of any length is
    encoded, long ones are not cached.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = frequent.value
        cache = process_cache("token_counts_" + path, dict)
        for batch in batches:
            texts, counts = batch.column(2), []
            for at in range(0, len(texts), 500):
                rows = [_CHUNK.findall(text) for text in texts.slice(at, 500).to_pylist()]
                missing = list({c for row in rows for c in row if c not in first and c not in cache})
                if len(cache) + len(missing) > CACHED:
                    cache.clear()
                    missing = list({c for row in rows for c in row if c not in first})
                cache.update(zip(missing, _lengths(missing, path), strict=True))
                counts += [sum([first[c] if c in first else cache[c] for c in row]) for row in rows]
                for chunk in missing:
                    if len(chunk) > LONGEST:
                        del cache[chunk]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.octet_length(whole_text(text_column)).cast("long").alias("n_bytes"),
        whole_text(text_column).alias("text"),
    )
    counted = narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
