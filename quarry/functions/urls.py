"""Links of crawled pages: ids, categories, absolute form and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Article links and the hub path below which categories live.
HUB = "hoi-dap-phap-luat"
ARTICLE_LINK = rf"/{HUB}/[^/]+-\d+\.html$"


def is_article_link(href: Column, pattern: str = ARTICLE_LINK) -> Column:
    return href.rlike(pattern)


def doc_id_from_url(url: Column) -> Column:
    """Digits before a closing ``.html``, '' when there are none."""
    return F.regexp_extract(url, r"-(\d+)\.html$", 1)


def category_from_url(url: Column, hub: str = HUB) -> Column:
    """Single path segment under the hub, null for anything else.

    Query and fragment are cut off first; pages ending in .html are articles.
    """
    clean = F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*$", ""), "/+$", "")
    slug = F.regexp_extract(clean, rf"^https?://[^/]+/{hub}/([^/]+)$", 1)
    return F.when((slug != "") & ~slug.endswith(".html"), slug)


def absolutize_url(href: Column, base: str | Column) -> Column:
    """Prefix the site to a rooted link; anything not http becomes null."""
    site = F.lit(base) if isinstance(base, str) else base
    full = F.when(href.startswith("/"), F.concat(site, href)).otherwise(href)
    return F.when(full.startswith("http"), full)


def join_list(items: Column) -> Column:
    return F.array_join(items, ";")
