"""Language identification by Bayesian fusion of text, declared language, address and host."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import given_back, shielded, small_batches, stored, whole_text
from quarry.session import broadcast_if_small

# Bounds of the labelled sample that the text model is fitted on: rows of a language, rows of all languages
# together (a language has at least one) and characters of a row.
SAMPLE_ROWS = 400
ALL_ROWS = 25_600
# Trigrams of all languages that each language is smoothed with, so that one of few rows is a language like others.
BACKGROUND = 200.0
SAMPLE_CHARS = 4_000
# Trigrams are hashed into so many bins. A text counts as at most so many independent trigrams,
# every fourth of its own, since neighbours depend on one another.
BINS = 1 << 15
EVIDENCE = 100
THINNED = 4
# Weight of the parent in a host's prior, and of unseen values in the other tables.
PARENT_WEIGHT = 20.0
UNSEEN = 0.5
LEAST_PROBABILITY = 0.5
# What a text is called that no language's trigrams explain better than bins of equal frequency do.
OTHER = "other"

# Bytes as the model sees them: letters in lower case, everything else a blank.
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[128:] = np.arange(128, 256)
for _i in range(26):
    _FOLDED[65 + _i] = _FOLDED[97 + _i] = 97 + _i


def trigrams(text: str) -> np.ndarray:
    """Bins of the byte trigrams that hold a letter; blanks count once."""
    seen = _FOLDED[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    blank = seen == 32
    seen = seen[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    if len(seen) < 3:
        return np.zeros(0, np.uint32)
    return ((seen[:-2] * np.uint32(7919) + seen[1:-1] * np.uint32(211) + seen[2:]) * np.uint32(2654435761) >> np.uint32(17)).astype(np.uint32) % BINS


def fit(docs: DataFrame, text_column: str, declared: str, id_column: str) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of their trigrams, from a bounded sample of declared rows.

    Behind them comes ``OTHER``, under which all bins are equally likely. A sampled row that the other
    rows of its language explain less well than halfway from their usual level to ``OTHER`` is declared
    wrongly and left out, so that a text in no language does not become part of one.
    """
    rows = docs.where(F.col(declared).isNotNull()).groupBy(F.lower(declared).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    # As many languages as the sample has rows; the model has a column for each.
    known = rows.orderBy(F.desc("n"), "lang").limit(ALL_ROWS).collect()
    if not known:
        return [], np.zeros((BINS, 0), np.float32)
    each = max(1, min(SAMPLE_ROWS, ALL_ROWS // len(known)))
    every = F.create_map(*[F.lit(x) for r in known for x in (r["lang"], max(1, r["n"] // each))])
    picked = docs.select(F.lower(declared).alias("lang"), F.substring(whole_text(text_column), 1, SAMPLE_CHARS).alias("text"), F.xxhash64(id_column).alias("h"))
    picked = picked.where(F.pmod("h", every[F.col("lang")]) == 0).select("lang", "text").limit(2 * each * len(known))
    languages = sorted(r["lang"] for r in known)
    counts = np.full((BINS, len(languages)), 0.05)
    sample = {lang: [] for lang in languages}
    # Copies would speak for one another.
    for lang, text in sorted({(row["lang"], row["text"]) for row in picked.collect()}):
        sample[lang].append(text)
    for i, lang in enumerate(languages):
        for text in sample[lang]:
            np.add.at(counts[:, i], trigrams(text), 1.0)
        alone = np.array([explained(trigrams(text), counts[:, i]) for text in sample[lang]])
        usual = np.nanmedian(alone) if np.isfinite(alone).any() else -np.inf
        # Too little text to explain its own kind tells nothing about a row.
        least = (usual - np.log(BINS)) / 2 if usual > -np.log(BINS) else -np.inf
        for text in [text for text, own in zip(sample[lang], alone, strict=True) if own < least]:
            np.subtract.at(counts[:, i], trigrams(text), 1.0)
    whole = counts.sum(1) / counts.sum()
    counts += BACKGROUND * whole[:, None]
    table = np.column_stack([np.log(counts / counts.sum(0)), np.full(BINS, -np.log(BINS))])
    return [*languages, OTHER], table.astype(np.float32)


def explained(bins: np.ndarray, counts: np.ndarray) -> float:
    """Mean log probability of a text's trigrams by ``counts`` without its own; not a number for no trigram."""
    seen, own = np.unique(bins, return_counts=True)
    return float((own * np.log((counts[seen] - own) / (counts.sum() - len(bins)))).sum() / len(bins)) if len(bins) else np.nan


def scorer(table: np.ndarray, spark) -> Callable[[Column], Column]:
    """Log likelihood of a whole text in every language, null for texts without a letter."""
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("array<double>")
    @given_back
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            out = []
            for text in texts:
                bins = trigrams(text.as_py() or "")
                if not len(bins):
                    out.append(None)
                    continue
                total = np.zeros(model.shape[1])
                for at in range(0, len(bins), 1 << 16):
                    total += model[bins[at : at + (1 << 16)]].sum(0, dtype=np.float64)
                out.append(total / len(bins) * min(len(bins) / THINNED, EVIDENCE))
            yield pa.array(out, pa.list_(pa.float64()))

    return score


def host_levels(address: Column) -> dict[str, Column]:
    """Host, registered domain, top-level domain and language suffix of an address."""
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z]+://([^/:?#]+)", 1))
    host = F.when(host != "", host)
    section = F.lower(F.regexp_extract(address, r"^[A-Za-z]+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.regexp_extract(host, r"([^.]+)$", 1)
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "top": top, "suffix": F.concat_ws("/", top, F.when(section != "", section))}


@shielded("_language", "_probability", "_text_language", "_kept")
def identify(
    docs: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    declared: str = "lang",
    host: str | None = "source",
    address: str | None = None,
    least: float = LEAST_PROBABILITY,
) -> DataFrame:
    """``docs`` with ``_language``, ``_probability``, ``_text_language`` and ``_kept``.

    The text's likelihoods come from a trigram model. All rows, labelled by their text alone, are
    then counted by declared language, address suffix and host, domain and top-level domain; a
    level's prior is smoothed by the level above it and leaves the row's own label out. The posterior is
    the product. Besides the languages there is ``OTHER``, for texts in none of them. A row is kept if it
    has letters and its best label is a language that has at least ``least``.

    Null or empty texts and texts without letters are rejected, with null language. Without a
    declared language, address or host that evidence is left out. Repeated rows are judged each, ids
    may be null, an empty table gives no rows. Where no row declares a language
    nothing can be told: every text with letters is kept with a null language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    languages, table = fit(docs, text_column, declared, id_column)
    n = len(languages)
    if not n:
        letters = whole_text(text_column).rlike(r"\p{L}")
        return docs.withColumns({"_language": F.lit(None).cast("string"), "_probability": F.lit(None).cast("double"), "_text_language": F.lit(None).cast("string"), "_kept": letters})
    names = F.array(*map(F.lit, languages))
    keys = host_levels(F.col(address)) if address else {}
    if host:
        keys["host"] = F.col(host).cast("string")
    levels = [k for k in ("top", "domain", "host") if k in keys]
    tables = [*levels, *[k for k in ("suffix",) if k in keys], "declared"]
    keys["declared"] = F.lower(declared)
    seen = docs.withColumns({f"_k_{k}": keys[k] for k in tables} | {"_score": scorer(table, spark)(F.col(text_column))})
    best = F.array_position("_score", F.array_max("_score")).cast("int")
    seen = seen.withColumn("_best", best)
    # One row per distinct combination and label, combined before the shuffle.
    counted = seen.where(F.col("_best").isNotNull()).groupBy(*[f"_k_{k}" for k in tables], "_best").agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counted, "languages")
    by_label = {r["_best"]: r["n"] for r in counted.groupBy("_best").agg(F.sum("_n").alias("n")).collect()}
    totals = np.array([by_label.get(i + 1, 0) for i in range(n)], float)
    overall = (totals + 1.0) / (totals.sum() + n)
    doubles = lambda values: F.array(*[F.lit(float(x)) for x in values])
    per_label = lambda: F.array(*[F.sum(F.when(F.col("_best") == i + 1, F.col("_n")).otherwise(0)).cast("double") for i in range(n)])
    joined = seen
    for k in tables:
        own = counted.where(F.col(f"_k_{k}").isNotNull()).groupBy(F.col(f"_k_{k}").alias(f"_j_{k}")).agg(per_label().alias(f"_c_{k}"))
        joined = joined.join(broadcast_if_small(own), F.col(f"_k_{k}") == F.col(f"_j_{k}"), "left")
    mine = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == F.col("_best"), 1.0).otherwise(0.0))
    prior = doubles(overall)
    for k in levels:
        rest = F.zip_with(F.col(f"_c_{k}"), mine, lambda c, m: F.greatest(c - m, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x)
        smoothed = _divided(F.zip_with(rest, prior, lambda c, p: c + p * PARENT_WEIGHT), total + PARENT_WEIGHT)
        joined = joined.withColumn(f"_p_{k}", F.when(F.col(f"_c_{k}").isNotNull(), smoothed).otherwise(prior))
        prior = F.col(f"_p_{k}")
    log = F.zip_with("_score", prior, lambda s, p: s + F.log(p))
    for k in ("suffix", "declared"):
        if k in tables:
            # Share of the label's rows that carry the value, against an unseen value's.
            share = F.zip_with(F.zip_with(F.col(f"_c_{k}"), mine, lambda c, m: F.greatest(c - m, F.lit(0.0)) + UNSEEN), doubles(totals), lambda c, t: c / (t + UNSEEN * (n + 1)))
            log = F.when(F.col(f"_c_{k}").isNotNull(), F.zip_with(log, share, lambda a, b: a + F.log(b))).otherwise(log)
    joined = joined.withColumn("_log", log)
    top = F.array_max("_log")
    weight = F.aggregate("_log", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    joined = joined.withColumns(
        {
            "_label": F.array_position("_log", top).cast("int"),
            "_language": F.get(names, F.array_position("_log", top).cast("int") - 1),
            "_probability": 1.0 / weight,
            "_text_language": F.get(names, F.col("_best") - 1),
        }
    )
    helpers = [c for c in joined.columns if c[:3] in ("_k_", "_j_", "_c_", "_p_") or c in ("_score", "_best", "_log", "_label")]
    kept = (F.col("_probability") >= least) & (F.col("_label") < n)
    return joined.withColumn("_kept", F.coalesce(kept, F.lit(False))).drop(*helpers)


def _divided(values: Column, by: Column) -> Column:
    return F.transform(values, lambda x: x / by)
