"""Ordered scans that do not put a whole group into one task.

A window partitioned by a key sorts every row of that key in one task. Here
the rows are range-partitioned by key *and* order first, so a key that holds a
third of the data is spread over a third of the slices. Windows then run per
slice, and a table with one row per (key, slice) carries what has to cross the
slice borders: running totals, or the last few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import durable

SLICE = "slice_no"
_BEFORE = (W.unboundedPreceding, -1)
_MERGE = {"sum": F.sum, "max": F.max}


def slice_by_order(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """Number the range partitions of (keys, order) in column ``slice_no``.

    The order columns must be unique within a key, or rows with equal values
    stay together in one slice. The result is written to the checkpoint folder
    so that a retried task cannot see other range bounds.
    """
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys, *order)
    return durable(ranged.withColumn(SLICE, F.spark_partition_id()))


def look_back(
    sliced: DataFrame, keys: list[str], order: list[str], payload: Column, rows: int, name: str
) -> DataFrame:
    """Add array ``name`` with the payload of up to ``rows`` preceding rows."""
    local = W.partitionBy(SLICE, *keys).orderBy(*order)
    backwards = W.partitionBy(SLICE, *keys).orderBy(*[F.desc(c) for c in order])
    tails = (
        sliced.select(*keys, *order, SLICE, payload.alias("_payload"))
        .withColumn("_from_end", F.row_number().over(backwards))
        .filter(F.col("_from_end") <= rows)
        .groupBy(*keys, SLICE)
        .agg(F.collect_list(F.struct(F.col("_from_end"), F.col("_payload"))).alias("_tail"))
    )
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(-rows, -1)
    in_order = F.transform(F.reverse(F.array_sort("_tail")), lambda item: item["_payload"])
    borders = tails.select(
        *keys, SLICE, F.flatten(F.collect_list(in_order).over(earlier)).alias("_earlier")
    )
    here = sliced.withColumn("_here", F.collect_list(payload).over(local.rowsBetween(-rows, -1)))
    both = F.concat("_earlier", "_here")
    last = F.slice(both, F.greatest(F.size(both) - rows + 1, F.lit(1)), F.lit(rows))
    return _attach(here, borders, [*keys, SLICE]).select(*sliced.columns, last.alias(name))


def running(
    sliced: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Add running aggregates: ``{name: ("sum" | "max", column)}``."""
    values = sliced.select("*", *[value.alias(f"_v_{n}") for n, (_, value) in totals.items()])
    per_slice = values.groupBy(*keys, SLICE).agg(
        *[_MERGE[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in totals.items()]
    )
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(*_BEFORE)
    offsets = per_slice.select(
        *keys, SLICE, *[_MERGE[kind](f"_t_{n}").over(earlier).alias(f"_o_{n}") for n, (kind, _) in totals.items()]
    )
    local = W.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = values.select(
        *sliced.columns, *[_MERGE[kind](f"_v_{n}").over(local).alias(f"_l_{n}") for n, (kind, _) in totals.items()]
    )
    return _attach(here, offsets, [*keys, SLICE]).select(
        *sliced.columns, *[_combine(kind, F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n, (kind, _) in totals.items()]
    )


def _combine(kind: str, offset: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(offset, local)
    return F.when(offset.isNull(), local).otherwise(offset + F.coalesce(local, offset - offset))


def _attach(rows: DataFrame, per_slice: DataFrame, names: list[str]) -> DataFrame:
    """Left join on names that may be null, without keeping the right copies."""
    renamed = per_slice.withColumnsRenamed({n: f"_r_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return rows.join(renamed, condition, "left")
