"""Publication dates and the year/month partition of a crawl time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"

# Shape and pattern of dates in page metadata. A zone offset is
# dropped, not converted, so it is cut off before parsing.
METADATA_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:Z|[+-]\d{2}:?\d{2})?$", "y-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
)
# Shape and pattern of dates shown on the page.
SHOWN_FORMATS = (
    (r"^\d{1,2}:\d{1,2}\s*\|\s*\d{1,2}/\d{1,2}/\d{4}$", "H:m|d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
)
# Fixed value: how a date in ISO form begins.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"
_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def _first_match(text: Column, formats: tuple) -> Column:
    compact = F.regexp_replace(text, r"\s+", "")
    return F.coalesce(
        *[
            F.date_format(
                F.when(text.rlike(shape), F.try_to_timestamp(compact, F.lit(pattern))), ISO_SECONDS
            )
            for shape, pattern in formats
        ]
    )


def published_in_metadata(html: Column) -> Column:
    """Raw ``datePublished`` value of the page, '' when absent."""
    return F.trim(F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1))


def parse_published_date(metadata: Column, shown: Column) -> Column:
    """ISO seconds from page metadata, else from the visible text, else ''."""
    local = F.when(metadata.contains("T"), F.regexp_replace(metadata, _OFFSET, "")).otherwise(metadata)
    return F.coalesce(
        _first_match(local, METADATA_FORMATS), _first_match(F.trim(shown), SHOWN_FORMATS), F.lit("")
    )


def has_iso_date(published: Column) -> Column:
    return F.coalesce(published, F.lit("")).rlike(ISO_DATE)


def crawled_partition(crawled_at: Column, fallback: Column) -> tuple[Column, Column]:
    """Year and month of an ISO time in its own offset.

    Anything that does not parse takes the ``fallback`` timestamp instead.
    """
    day = F.substring(crawled_at, 1, 10)
    time = F.regexp_extract(crawled_at, r"^.{11}(\d{2}:?\d{0,2}:?\d{0,2})", 1)
    padded = F.concat(time, F.substring(F.lit("00:00:00"), F.length(time) + 1, F.lit(8)))
    valid = (
        crawled_at.rlike(_ISO_SHAPE)
        & F.try_to_timestamp(F.concat_ws(" ", day, padded), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    )
    date = F.when(valid, F.try_to_date(day, "yyyy-MM-dd")).otherwise(F.to_date(fallback))
    return F.year(date), F.month(date)


def crawl_instant(crawled_at: Column) -> Column:
    """The moment of an ISO time with its offset, UTC without one; null for anything else."""
    return F.when(F.trim(crawled_at).rlike(_ISO_SHAPE), F.try_to_timestamp(F.trim(crawled_at)))
