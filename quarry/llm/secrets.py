"""Secret scans with corpus-wide ownership frequency, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import folded, shielded, stored, whole_text
from quarry.llm.spans import listed, of_kind, with_spans
from quarry.session import broadcast_if_small

# A value that so many owners hold is a copied example.
COPIED_OWNERS = 3
# Or, with two owners, from so many repositories on.
COPIED_REPOSITORIES = 4

# The base kinds, in the order of their spans. Hex and access runs are maximal by their class.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
BASE = ("assign", "access", "hex")
# What the method looks for besides: shapes of issued tokens, key blocks and logins in addresses.
ADDED = {
    "forge": r"\bgh[pousr]_[A-Za-z0-9]{30,}+",
    "chat": r"\bxox[abprs]-[A-Za-z0-9-]{10,}+",
    "signed": r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "model": r"\bsk-[A-Za-z0-9_-]{20,}+",
    "block": r"-----BEGIN (?:[A-Z]{1,20} ){0,4}PRIVATE KEY-----",
    "login": r"://[A-Za-z0-9._%-]{1,64}:[^\x00-\x20/:@]{4,128}@",
}
_FIRST = {"forge": "gh", "chat": "xox", "signed": "eyJ", "model": "sk-", "block": "-----BEGIN ", "login": "://"}


def _long_value(span: Column) -> Column:
    return F.length(F.regexp_extract(span["value"], ASSIGN, 2)) >= 8


def _secret(span: Column) -> Column:
    """What is secret of a match: the value of an assignment, the password of a login, else all of it."""
    return (
        F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2))
        .when(span["kind"] == "login", F.regexp_extract(span["value"], r":([^:@]*)@$", 1))
        .otherwise(span["value"])
    )


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """One narrow row per document with its base and further candidate spans."""
    text = whole_text(text_column)
    read = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"),
        F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"),
    )
    text = F.col("text")
    patterns: dict = {
        "assign": (ASSIGN, text.contains("=") | text.contains(":")),
        "access": (ACCESS, text.contains("AKIA")),
        "hex": (HEX, None),
    }
    patterns |= {kind: (pattern, text.contains(_FIRST[kind])) for kind, pattern in ADDED.items()}
    seen = with_spans(read, "text", patterns).drop("text")
    base = F.concat(
        *[of_kind(F.col(kind), kind, order, _long_value if kind == "assign" else None) for order, kind in enumerate(BASE)]
    )
    more = F.concat(*[of_kind(F.col(kind), kind, len(BASE) + order) for order, kind in enumerate(ADDED)])

    def hidden(spans: Column) -> Column:
        """The spans with a hash in place of the value."""
        return F.transform(
            F.array_sort(spans),
            lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["stop"].alias("stop"), s["kind"].alias("kind"), F.sha2(_secret(s), 256).alias("hash")),
        )

    return seen.select("doc_id", "text_key", "owner", "repository", hidden(base).alias("base"), hidden(more).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate hash.

    Each step is combined before its shuffle, so a value that is everywhere costs one row per task
    and owner. A null owner or repository counts as one of that name.
    """
    each = found.select("owner", "repository", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["hash"]))).alias("hash"))
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: str = "source", repository: str = "lang", copied_owners: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """Base spans, further live-looking spans and verdict counts of every document.

    Values that ``copied_owners`` or more owners hold, or two owners in ``copied_repositories`` or more repositories, are copied
    examples; the others are owner-specific and look live. Base spans always stay; of the further candidates only live ones
    become spans. Columns: ``doc_id``, ``text_key`` (hash of the text, joins back to it), ``n_assign``,
    ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_live``, ``n_copied``, ``most_owners`` and
    ``most_repositories`` (the largest counts of the document's candidates) and ``marked``, the spans as an array.

    A null text is empty and has no spans. Repeated rows are each returned; ids may be null. An empty
    table gives no rows; other columns are ignored. Texts of any length are scanned whole.
    """
    found = stored(candidates(docs, id_column, text_column, owner, repository), "secrets")
    owned = stored(ownership(found), "ownership")
    copied = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= copied_repositories))
    each = found.where(F.size("base") + F.size("more") > 0).select("doc_id", "text_key", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["hash"]))).alias("hash"))
    spread = each.join(owned, "hash").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(copied, F.col("hash"))).alias("copied"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories")
    )
    left, right = found.alias("l"), spread.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key"))
    most = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("most_owners", "most_repositories")]
    joined = left.join(right, same, "left").select("l.*", F.coalesce("r.copied", F.array().cast("array<string>")).alias("copied"), *most)
    marked = F.array_sort(F.concat("base", F.filter("more", lambda s: ~F.array_contains("copied", s["hash"]))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_copied = F.size(F.filter(F.concat("base", "more"), lambda s: F.array_contains("copied", s["hash"])))
    return joined.select(
        "doc_id", "text_key", *[count(kind) for kind in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(marked).alias("spans"), (F.size("base") + F.size("more") - n_copied).cast("long").alias("n_live"),
        n_copied.cast("long").alias("n_copied"), "most_owners", "most_repositories", marked.alias("marked"),
    )


def redacted(text: Column, marked: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with its sorted spans masked; overlapping ones become one mask."""

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        kept = F.when(fresh, F.concat(done["rows"], F.array(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mask)))).otherwise(done["rows"])
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), kept.alias("rows"))

    done = folded(marked, F.lit(0), F.array().cast("array<string>"), step)
    whole = F.get(F.transform(F.array(done), lambda x: F.concat(F.array_join(x["rows"], ""), F.substring(text, x["at"] + 1, F.length(text)))), F.lit(0))
    return F.when(F.size(marked) > 0, whole).otherwise(text)


@shielded()
def mask_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """``docs`` with the text's secrets masked and ``n_chars``, where it exists, counted anew; no row is dropped.

    A null text stays null and an empty one empty. Texts of any length are masked whole; rows that repeat an id and a text are
    masked alike, ids may be null. An empty table gives no rows; other columns may have any name.
    """
    found = scan(docs, id_column, text_column, owner, repository).where(F.size("marked") > 0)
    spans = F.transform("marked", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    found = found.groupBy(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k")).agg(F.first(spans).alias("_spans"))
    same = F.col(id_column).eqNullSafe(F.col("_i")) & (F.xxhash64(whole_text(text_column)) == F.col("_k"))
    joined = docs.join(broadcast_if_small(found), same, "left")
    masked = F.when(F.col("_spans").isNotNull(), redacted(F.col(text_column), F.col("_spans"))).otherwise(F.col(text_column))
    changed = {text_column: masked}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_spans").isNotNull(), F.length(masked).cast("long")).otherwise(F.col("n_chars"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
