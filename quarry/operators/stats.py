"""Corpus statistics over the chunk index and over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.normalize import valid_published
from quarry.operators.ordered import look_back, running, slice_by_order

# Bucket counts of the dashboard panels.
TOP_CATEGORIES = 20
TOP_DETAILS = 50
TOP_LONGEST = 10


def row_count() -> Column:
    return F.count(F.lit(1))


def total_chunks(index: DataFrame) -> DataFrame:
    return index.agg(row_count().alias("chunks"))


def unique_documents(index: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("doc_id") if approximate else F.count_distinct("doc_id")
    return index.agg(count.alias("documents"))


def chunks_by_category(index: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """Largest categories with their share of the chunks shown."""
    kept = (
        index.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(row_count().alias("chunks"))
        .orderBy(F.desc("chunks"), "category")
        .limit(top)
    )
    total = F.sum("chunks").over(W.partitionBy(F.lit(1)))
    return kept.withColumn("percent", F.round(F.col("chunks") * 100.0 / total, 6))


def document_details(index: DataFrame, top: int = TOP_DETAILS) -> DataFrame:
    """Largest documents and, within each, their largest categories.

    The pairs are counted first; what follows works on counts only.
    """
    pairs = (
        index.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "category").agg(row_count().alias("chunks"))
    )
    leading = (
        pairs.groupBy("doc_id")
        .agg(F.sum("chunks").alias("doc_chunks"))
        .orderBy(F.desc("doc_chunks"), "doc_id")
        .limit(top)
    )
    within = W.partitionBy("doc_id").orderBy(F.desc("chunks"), "category")
    return (
        pairs.filter(F.col("category").isNotNull())
        .join(F.broadcast(leading), "doc_id")  # at most `top` rows
        .withColumn("category_rank", F.row_number().over(within))
        .filter(F.col("category_rank") <= top)
    )


def documents_per_category(index: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    return (
        index.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count_distinct("doc_id").alias("documents"))
        .orderBy(F.desc("documents"), "category")
        .limit(top)
    )


def longest_documents(index: DataFrame, top: int = TOP_LONGEST) -> DataFrame:
    return (
        index.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(row_count().alias("chunks"))
        .orderBy(F.desc("chunks"), "doc_id")
        .limit(top)
    )


def avg_chunks_per_document(index: DataFrame) -> DataFrame:
    return index.agg((row_count() / F.count_distinct("doc_id")).alias("avg_chunks"))


def latest_articles(docs: DataFrame, top: int = 10, category: str | None = None) -> DataFrame:
    """Newest documents with a valid published date."""
    return valid_published(docs, category).orderBy(F.desc("published_date"), "id").limit(top)


def document_stats(docs: DataFrame) -> DataFrame:
    """Length statistics by category and type, with subtotals.

    The totals are one row each, so the percentile (which keeps a count per
    distinct length) is computed once per level and merged from partial maps.
    """
    length = F.col("length")
    narrow = docs.select("id", "category", "doc_type", F.length("content").alias("length"))
    return (
        narrow.rollup("category", "doc_type")
        .agg(
            F.grouping_id().alias("level"),
            row_count().alias("documents"),
            F.avg(length).alias("avg_length"),
            F.stddev_samp(length).alias("stddev_length"),
            F.percentile(length, 0.5).alias("median_length"),
            F.max_by("id", F.struct(length, F.col("id"))).alias("longest_id"),
        )
    )


def pivot_type_by_year(docs: DataFrame, years: list[int]) -> DataFrame:
    """Documents per type (rows) and year (columns); the years are given."""
    year = F.year(F.try_to_date(F.substring("published_date", 1, 10), "yyyy-MM-dd"))
    counts = docs.withColumn("year", year).groupBy("doc_type").pivot("year", years).count()
    return counts.na.fill(0, [str(y) for y in years])


def unpivot_type_by_year(pivoted: DataFrame) -> DataFrame:
    years = [c for c in pivoted.columns if c != "doc_type"]
    return pivoted.unpivot("doc_type", years, "year", "documents")


def document_rank_stats(docs: DataFrame, tiles: int = 4, frame: int = 3, slices: int | None = None) -> DataFrame:
    """Rank, dense rank, tile, previous length, running and moving length.

    Per category by published day, then id. Every column is exact for a
    category of any size, see ``ordered``.
    """
    keys, order = ["category"], ["day", "id"]
    rows = docs.select(
        "id", "category",
        F.substring("published_date", 1, 10).alias("day"),
        F.length("content").cast("long").alias("length"),
    )
    sliced = slice_by_order(rows, keys, order, slices)
    payload = F.struct("day", "length")
    known = look_back(sliced, keys, order, payload, max(frame - 1, 1), "_before")
    previous = F.try_element_at("_before", F.lit(-1))
    starts = (F.size("_before") == 0) | ~F.col("day").eqNullSafe(previous["day"])
    counted = running(
        known.withColumn("_starts", starts), keys, order,
        {
            "row_no": ("sum", F.lit(1)),
            "dense_rank": ("sum", F.col("_starts").cast("int")),
            "running_length": ("sum", F.col("length")),
        },
    )
    ranked = running(counted, keys, order, {"rank": ("max", F.when(F.col("_starts"), F.col("row_no")))})
    sizes = rows.groupBy(F.col("category").alias("_category")).agg(row_count().alias("_size"))
    sized = ranked.join(sizes, F.col("category").eqNullSafe(F.col("_category")), "left")
    small = F.floor(F.col("_size") / tiles)
    extra = F.col("_size") % tiles
    above = F.col("row_no") - 1
    in_large = above < (small + 1) * extra
    tile = F.when(in_large, F.floor(above / (small + 1))).otherwise(
        extra + F.floor((above - (small + 1) * extra) / F.greatest(small, F.lit(1)))
    )
    recent = F.slice("_before", F.greatest(F.size("_before") - frame + 2, F.lit(1)), F.lit(frame - 1))
    moving = F.aggregate(recent, F.col("length"), lambda acc, row: acc + row["length"])
    return sized.select(
        "id", "category", "day", "length", "row_no", "rank", "dense_rank",
        (tile + 1).cast("long").alias("tile"),
        F.when(F.size("_before") > 0, previous["length"]).alias("previous_length"),
        "running_length",
        (moving / (F.size(recent) + 1)).alias("moving_avg"),
    )
