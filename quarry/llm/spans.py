"""Places of pattern matches in whole texts, by SQL functions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import folded

SPAN = "array<struct<start:int,stop:int,value:string,before:string>>"
# Characters of context kept before a match, at most up to the match before it.
CONTEXT = 40


def found(text: Column, pattern: str, when: Column | None = None) -> Column:
    """All leftmost non-overlapping matches, whole; none where ``when`` does not hold."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return matches if when is None else F.when(when, matches).otherwise(F.array().cast("array<string>"))


def placed(text: Column, pattern: str, matches: Column) -> Column:
    """Start, end (exclusive) in code points, value and context of each of ``matches``.

    What stands between two matches gives the distance to the next one.
    """
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(between, matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("value")))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"))
        return F.struct(stop.alias("at"), F.concat(done["rows"], F.array(span)).alias("rows"))

    return folded(steps, F.lit(0), F.array().cast(SPAN), step)["rows"]


def with_spans(docs: DataFrame, text: str, patterns: Mapping[str, tuple[str, Column | None]]) -> DataFrame:
    """A column of spans for each named pattern; a pattern runs only where its condition holds."""
    for name, (pattern, when) in patterns.items():
        docs = docs.withColumn(f"_m_{name}", found(F.col(text), pattern, when))
    for name, (pattern, _) in patterns.items():
        docs = docs.withColumn(name, placed(F.col(text), pattern, F.col(f"_m_{name}")))
    return docs.drop(*[f"_m_{name}" for name in patterns])


def of_kind(spans: Column, kind: str, order: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """The spans with their kind, in the form that sorts by start, then kind as listed."""
    kept = F.filter(spans, keep) if keep else spans
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"),
            F.lit(kind).alias("kind"), s["value"].alias("value"),
        ),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
