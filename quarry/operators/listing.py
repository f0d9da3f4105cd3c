"""Listings of links: first occurrences, limits and stopping at known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.urls import category_from_url


def first_occurrence(links: DataFrame, url: str, order: list[str]) -> DataFrame:
    """The first row of each url in listing order."""
    ranked = links.withColumn("_n", F.row_number().over(W.partitionBy(url).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def limit_links(links: DataFrame, url: str, order: list[str], limit: int = 0) -> DataFrame:
    """The first ``limit`` distinct links in listing order, 0 for all."""
    unique = first_occurrence(links, url, order).orderBy(*order)
    return unique.limit(limit) if limit > 0 else unique


def new_until_seen(listing: DataFrame, seen: Column, stop_on_seen: bool = True) -> DataFrame:
    """Rows of each category above the first one that is indexed already.

    ``listing`` has ``category`` and ``position``, newest first. The smallest
    seen position per category is an ordinary aggregate, so no category has to
    be sorted in one task. Without ``stop_on_seen`` seen rows just drop out.
    """
    marked = listing.withColumn("_seen", seen)
    if not stop_on_seen:
        return marked.filter(~F.col("_seen")).drop("_seen")
    stops = (
        marked.filter("_seen")
        .groupBy(F.col("category").alias("_category"))
        .agg(F.min("position").alias("_stop"))
    )
    joined = marked.join(stops, F.col("category").eqNullSafe(F.col("_category")), "left")
    return joined.filter("_stop is null or position < _stop").drop("_seen", "_category", "_stop")


def sorted_categories(links: DataFrame, href: Column, **options) -> DataFrame:
    """Distinct category slugs behind the links, ascending."""
    slugs = links.select(category_from_url(href, **options).alias("category"))
    return slugs.filter(F.col("category").isNotNull()).distinct().orderBy("category")
