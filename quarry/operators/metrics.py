"""Request metrics: counts, cumulative histograms, quantiles and rates.

A request log has ``ts``, ``path``, ``latency_seconds`` and ``sources``. The
windowed functions take batch and streaming logs alike; a stream is given a
watermark and rows later than that are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the histograms; paths and window of the panels.
LATENCY_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)
SOURCES_BOUNDS = (0.0, 1.0, 2.0, 3.0, 5.0, 10.0)
ANSWERED = ("rag", "no_info")
REFUSED = ("no_info", "threshold_refused")
WINDOW = "5 minutes"
SLIDE = "1 minute"
WINDOW_SECONDS = 300
LATE = "10 minutes"


def requests_by_path(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("requests"))


def bucket_counts(value: Column, bounds: tuple[float, ...]) -> Column:
    """Array of cumulative counts, one per bound and a last one for +Inf."""
    return F.array(*[F.count_if(value <= bound) for bound in bounds], F.count(value))


def cumulative_histogram(log: DataFrame, value: str, bounds: tuple[float, ...], by: list[str]) -> DataFrame:
    """``by, le, cumulative, total_sum, total_count`` in one aggregation."""
    counted = log.groupBy(*by).agg(
        bucket_counts(F.col(value), bounds).alias("_counts"),
        F.sum(value).alias("total_sum"),
        F.count(value).alias("total_count"),
    )
    limits = F.array(*[F.lit(float(b)) for b in bounds], F.lit(math.inf))
    pairs = F.arrays_zip(limits.alias("le"), F.col("_counts").alias("cumulative"))
    return counted.select(*by, F.inline(pairs).alias("le", "cumulative"), "total_sum", "total_count")


def latency_histogram(log: DataFrame) -> DataFrame:
    return cumulative_histogram(log, "latency_seconds", LATENCY_BOUNDS, ["path"]).select("path", "le", "cumulative")


def sources_histogram(log: DataFrame) -> DataFrame:
    answered = log.filter(F.col("path").isin(*ANSWERED))
    return cumulative_histogram(answered, "sources", SOURCES_BOUNDS, [])


def quantile_from_counts(q: float, counts: Column, bounds: tuple[float, ...]) -> Column:
    """Quantile by linear interpolation inside the bucket that holds its rank.

    A rank in the +Inf bucket gives the largest finite bound; no observations
    give null.
    """
    total = F.element_at(counts, -1)
    rank = F.lit(q) * total
    result = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        upper, lower = float(bounds[i]), (float(bounds[i - 1]) if i else 0.0)
        here = F.element_at(counts, i + 1)
        below = F.element_at(counts, i) if i else F.lit(0)
        inside = here - below
        share = F.when(inside > 0, (rank - below) / inside).otherwise(1.0)
        value = F.lit(lower) + F.lit(upper - lower) * share if upper > 0 else F.lit(upper)
        result = F.when(here >= rank, value).otherwise(result)
    return F.when(total > 0, result)


def histogram_quantile(log: DataFrame, q: float = 0.95) -> DataFrame:
    counted = log.groupBy("path").agg(bucket_counts(F.col("latency_seconds"), LATENCY_BOUNDS).alias("_counts"))
    return counted.select("path", quantile_from_counts(q, F.col("_counts"), LATENCY_BOUNDS).alias("quantile"))


def _windowed(log: DataFrame, *by: str):
    if log.isStreaming:
        log = log.withWatermark("ts", LATE)
    return log.groupBy(F.window("ts", WINDOW, SLIDE).alias("_window"), *by)


def _bounds() -> tuple[Column, Column]:
    return F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end")


def request_rate_5m(log: DataFrame) -> DataFrame:
    rate = F.count(F.lit(1)) / F.lit(float(WINDOW_SECONDS))
    return _windowed(log, "path").agg(rate.alias("per_second")).select(*_bounds(), "path", "per_second")


def latency_p95_5m(log: DataFrame, q: float = 0.95) -> DataFrame:
    counted = _windowed(log, "path").agg(bucket_counts(F.col("latency_seconds"), LATENCY_BOUNDS).alias("_counts"))
    return counted.select(*_bounds(), "path", quantile_from_counts(q, F.col("_counts"), LATENCY_BOUNDS).alias("p95"))


def share_5m(log: DataFrame) -> DataFrame:
    """Shares of cached, small-talk and refused requests per window."""
    total = F.count(F.lit(1))
    return (
        _windowed(log)
        .agg(
            (F.count_if(F.col("path") == "cache") / total).alias("cache_share"),
            (F.count_if(F.col("path") == "smalltalk") / total).alias("smalltalk_share"),
            (F.count_if(F.col("path").isin(*REFUSED)) / total).alias("refusal_share"),
        )
        .select(*_bounds(), "cache_share", "smalltalk_share", "refusal_share")
    )


def avg_sources_5m(log: DataFrame) -> DataFrame:
    """Mean number of sources per answer; windows without answers are absent."""
    answered = log.filter(F.col("path").isin(*ANSWERED))
    return _windowed(answered).agg(F.avg("sources").alias("avg_sources")).select(*_bounds(), "avg_sources")
