"""Numbered manifests: which data folders make up a table.

A manifest is one small JSON file that names every live entry. A commit creates the next number, which only
one writer can; a writer that lost looks at what came in between and tries the next number. Readers take the
newest manifest once and see exactly its entries. Data folders are written before and never changed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

from quarry.sources.storage import child_names, create_text, read_text


@dataclass(frozen=True)
class Entry:
    """One folder of rows of a kind, written for a batch; ``number`` is that of the commit that brought it."""

    kind: str
    batch: str
    folder: str
    rows: int
    number: int = 0
    filters: str | None = None
    postings: str | None = None


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    entries: tuple[Entry, ...] = ()

    def of(self, kind: str) -> list[Entry]:
        return [e for e in self.entries if e.kind == kind]


def _path(root: str, number: int) -> str:
    return f"{root}/manifests/{number:012d}.json"


def read_manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest:
    """The newest manifest, or the one of a number; an empty one before the first commit."""
    if number is None:
        found = [int(name[:-5]) for name in child_names(spark, f"{root}/manifests") if name.endswith(".json") and not name.startswith(".")]
        if not found:
            return Manifest()
        number = max(found)
    return Manifest(number, tuple(Entry(**e) for e in json.loads(read_text(spark, _path(root, number)))["entries"]))


def commit(spark: SparkSession, root: str, change: Callable[[Manifest], list[Entry] | None]) -> Manifest:
    """Make the entries that ``change`` gives for the newest manifest the next one.

    ``change`` is called again whenever another writer was faster, and returns what is live afterwards; entries without a
    number are new. Without entries (None) nothing is committed.
    """
    while True:
        current = read_manifest(spark, root)
        entries = change(current)
        if entries is None:
            return current
        number = current.number + 1
        entries = [e if e.number else replace(e, number=number) for e in entries]
        if create_text(spark, _path(root, number), json.dumps({"entries": [asdict(e) for e in entries]})):
            return Manifest(number, tuple(entries))
