"""HTML helpers: visible text, article extraction and page metadata.

Each is a small per-page parser behind an Arrow UDF; Spark spreads the pages.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import small_batches

# Elements whose text is not part of the visible text.
SILENT = {"script", "style", "template", "rt", "rp"}
# Elements without content.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "nextid", "spacer", "keygen",
}
# Elements that form an article block.
BLOCKS = ("h2", "h3", "p", "blockquote", "li")
# Selectors looked up for page metadata, first match wins.
AUTHOR_SELECTORS = (".author", ".post-author", ".author-name", ".post-meta .author")
REF_SELECTORS = (".legal-ref", ".ref-list", ".refs", ".post-meta .refs")
TAG_SELECTORS = (".tags a", ".tag-list a", ".post-tags a")
DATE_SELECTORS = ("span.small.text-muted.text-nowrap.ms-auto", "span.news-time")
VIEW_SELECTOR = ".views"


PAGE_META = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("legal_refs", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("views", T.StringType()),
        T.StructField("shown_date", T.StringType()),
    ]
)


class _Node:
    __slots__ = ("tag", "attrs", "parent", "texts")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.texts = []

    def classes(self):
        return set((self.attrs.get("class") or "").split())

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Page(HTMLParser):
    """Elements in document order, each with the text nodes below it.

    End tags close everything down to their start tag; elements are never
    closed by a sibling, so an unclosed ``p`` holds what follows it. With
    ``root_only`` texts go to the root alone, in time linear in the page.
    """

    def __init__(self, root_only: bool = False):
        super().__init__(convert_charrefs=False)
        self.root = _Node("", {}, None)
        self.root_only = root_only
        self.nodes = []
        self.open = [self.root]
        self.open_tags = Counter()
        self.pending = []

    @property
    def silent(self) -> bool:
        return any(self.open_tags[tag] for tag in SILENT)

    def handle_starttag(self, tag, attrs):
        self._text_done()
        node = _Node(tag, dict(attrs), self.open[-1])
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open_tags[self.open.pop().tag] -= 1

    def handle_endtag(self, tag):
        self._text_done()
        if not self.open_tags[tag]:
            return
        while True:
            closed = self.open.pop().tag
            self.open_tags[closed] -= 1
            if closed == tag:
                break

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        self.pending.append(entities.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        char = entities.entities.html5.get(name + ";")
        self.pending.append(char if char is not None else "&" + name)

    def handle_comment(self, data):
        self._text_done()

    def handle_decl(self, decl):
        self._text_done()

    def handle_pi(self, data):
        self._text_done()

    def unknown_decl(self, data):
        self._text_done()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[len("CDATA[") :])
            self._text_done()

    def _text_done(self):
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending = []
        if self.silent:
            return
        for node in self.open[:1] if self.root_only else self.open:
            node.texts.append(text)

    def within(self, root):
        return [n for n in self.nodes if root in n.ancestors()]


def _parse(markup: str, root_only: bool = False) -> _Page:
    page = _Page(root_only)
    page.feed(markup)
    page.close()
    page._text_done()
    return page


def _flat(node: _Node) -> str:
    return " ".join(" ".join(node.texts).split())


def visible_text(markup: str) -> str:
    """Text nodes joined by blanks, NFC, white space collapsed."""
    text = unicodedata.normalize("NFC", " ".join(_parse(markup, root_only=True).root.texts))
    return " ".join(text.split())


@F.pandas_udf(T.StringType())
def strip_markup_udf(markup: pd.Series) -> pd.Series:
    return markup.map(visible_text, na_action="ignore")


def article(markup: str, body_tag: str, body_id: str | None) -> tuple[str, list[str]]:
    page = _parse(markup)
    title = next((_flat(n) for n in page.nodes if n.tag == "h1"), "")
    body = next(
        (n for n in page.nodes if n.tag == body_tag and (body_id is None or n.attrs.get("id") == body_id)),
        None,
    )
    blocks = []
    for node in page.within(body) if body else []:
        if node.tag in BLOCKS:
            text = _flat(node)
            if text:
                blocks.append(text)
    return title, blocks


def extract_article(markup: Column, body_tag: str = "section", body_id: str | None = "news-content") -> Column:
    """``struct<title, blocks>`` of a page; the body element is a parameter.

    Blocks are headings, paragraphs, quotes and list items of the body in
    document order. Paragraphs that hold only an image have no text and drop.
    Pages come to the workers in batches of a bounded size.
    """
    small_batches(SparkSession.active())

    @F.pandas_udf("title string, blocks array<string>")
    def run(pages: pd.Series) -> pd.DataFrame:
        found = [article(p or "", body_tag, body_id) for p in pages]
        return pd.DataFrame({"title": [t for t, _ in found], "blocks": [b for _, b in found]})

    return run(markup)


def _fits(node: _Node, compound: str) -> bool:
    """Whether a node has the tag and all classes of a compound such as ``span.a.b``."""
    tag, *classes = compound.split(".")
    return tag in ("", node.tag) and set(classes) <= node.classes()


def _select(nodes: list[_Node], selector: str) -> list[_Node]:
    """Nodes that fit the last compound of a selector and lie below nodes that fit the others."""
    *outer, last = selector.split()
    return [n for n in nodes if _fits(n, last) and all(any(_fits(a, part) for a in n.ancestors()) for part in outer)]


def _lines(node: _Node) -> str:
    return " ".join(part.strip() for part in " ".join(node.texts).splitlines() if part.strip())


def page_meta(markup: str) -> dict:
    page = _parse(markup)
    first = next((n for n in page.nodes if n.tag == "article"), None)
    inner = page.within(first) if first else page.nodes

    def found(selector):
        return _select(inner, selector) or _select(page.nodes, selector)

    def first_text(selectors):
        return next((_lines(hits[0]) for hits in map(found, selectors) if hits), "")

    def all_texts(selectors):
        return [t for selector in selectors for t in map(_lines, found(selector)) if t]

    views = found(VIEW_SELECTOR)
    digits = re.search(r"\d[\d,]*", _lines(views[0])) if views else None
    shown = next((hits[0] for hits in (_select(page.nodes, s) for s in DATE_SELECTORS) if hits), None)
    return {
        "author": first_text(AUTHOR_SELECTORS),
        "legal_refs": all_texts(REF_SELECTORS),
        "tags": all_texts(TAG_SELECTORS),
        "views": digits.group().replace(",", "") if digits else "",
        "shown_date": _lines(shown) if shown else "",
    }


@F.pandas_udf(PAGE_META)
def _page_meta_udf(markup: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [page_meta(m or "") for m in markup],
        columns=PAGE_META.names,
    )


def extract_page_meta(markup: Column) -> Column:
    """``struct<author, legal_refs, tags, views, shown_date>`` of a page; batches as in ``extract_article``."""
    small_batches(SparkSession.active())
    return _page_meta_udf(markup)


def view_count(views: Column) -> Column:
    """Whole number of views, 0 when absent or out of range."""
    return F.coalesce(views.try_cast("int"), F.lit(0))
