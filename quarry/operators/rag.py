"""Question answering over a table of questions: gate, route, context, sources.

Model answers are an input column; nothing here calls a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.replies import context_block, says_no_info, user_message
from quarry.operators.ordered import look_back, slice_by_order

# Turns of history, gate and number of sources by default.
HISTORY_TURNS = 6
MIN_SCORE = 2.0
DEFAULT_SOURCES = 3


def history_window(turns: DataFrame, size: int = HISTORY_TURNS, slices: int | None = None) -> DataFrame:
    """Each turn with its rendered preceding turns, '' for the first one.

    A conversation of any length is spread over slices, see ``ordered``.
    """
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    keys, order = ["conv_id"], ["turn"]
    line = F.concat(speaker, F.coalesce("text", F.lit("")))
    sliced = slice_by_order(turns.withColumn("_line", line), keys, order, slices)
    seen = look_back(sliced, keys, order, F.col("_line"), size, "_history")
    rendered = F.array_join("_history", "\n")
    return seen.select(*turns.columns, rendered.alias("history"))


def threshold_gate(queries: DataFrame, hits: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    """Top score per question, 0 without hits, and whether it is refused."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    top = F.coalesce("_best", F.lit(0.0))
    return queries.join(best, "query_id", "left").select(
        *queries.columns, top.alias("top_score"), (top < threshold).alias("refused")
    )


def route_path(intent: Column, cache_hit: Column, refused: Column, answer: Column) -> Column:
    """Label of the path that serves a question."""
    return (
        F.when(intent.isNotNull(), "smalltalk")
        .when(cache_hit, "cache")
        .when(refused, "threshold_refused")
        .when(says_no_info(answer), "no_info")
        .otherwise("rag")
    )


def build_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """User message per question from its ranked hits (rank from 1)."""
    block = context_block(F.col("rank") - 1, F.col("title"), F.col("chunk_text"))
    blocks = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_blocks")
    )
    texts = F.transform("_blocks", lambda b: b["block"])
    return queries.join(blocks, "query_id", "left").select(
        *queries.columns, user_message(texts, F.col("question")).alias("user_content")
    )


def cite_sources(answers: DataFrame, hits: DataFrame, default: int = DEFAULT_SOURCES) -> DataFrame:
    """Cited hits per question: ``query_id, position, title, url, doc_id``.

    ``answers`` has ``query_id, answer, used`` (indices from 0, in the order
    of the reply). Refusals cite nothing, an empty list means the first hits,
    negative indices count from the end, and each url is cited once.
    """
    usable = answers.filter(~F.coalesce(says_no_info(F.col("answer")), F.lit(False)))
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    first = F.sequence(F.lit(0), F.lit(default - 1))
    used = F.when(F.size(F.coalesce("used", F.array().cast("array<int>"))) > 0, F.col("used")).otherwise(first)
    wanted = (
        usable.join(sizes, "query_id")
        .select("query_id", "_n", F.posexplode(used).alias("_order", "_at"))
        .select(
            "query_id", "_order",
            F.when(F.col("_at") < 0, F.col("_n") + F.col("_at")).otherwise(F.col("_at")).alias("_at"),
        )
    )
    cited = wanted.join(hits.withColumn("_at", F.col("rank") - 1), ["query_id", "_at"]).filter(
        F.coalesce("url", F.lit("")) != ""
    )
    once = W.partitionBy("query_id", "url").orderBy("_order")
    place = W.partitionBy("query_id").orderBy("_order")
    return (
        cited.withColumn("_n", F.row_number().over(once))
        .filter("_n = 1")
        .withColumn("position", F.row_number().over(place))
        .select("query_id", "position", "title", "url", "doc_id")
    )
