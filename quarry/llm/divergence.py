"""Quality rules by distribution divergence, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.llm.common import shielded, stored, whole_text, words_of
from quarry.session import broadcast_if_small

# Base rules.
LEAST_WORDS = 50
REPEATED_PERCENT = 50
# A language has a reference from so many words of base-clean documents on, made of its most
# frequent words of at most so many letters. Shorter documents than these are not compared.
REFERENCE_WORDS = 5_000
COMMON_WORDS = 25
COMMON_LETTERS = 5
GUARD_CHARS = 200
GUARD_WORDS = 100
# Largest Jensen-Shannon distances (square root, base 2) to the language's references.
CHAR_DISTANCE = 0.30
WORD_DISTANCE = 0.45
# Largest share of the distance that a document without any common word would have. It widens where
# fewer common words are expected in a document than there are, as chance alone then moves it more.
WORD_SHARE = 0.75

VERDICT = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_char_distance", "_word_distance", "_kept")
# Classes are taken out one after the other, the most frequent first, so that each pass reads less.
CLASSES = {
    "lower": r"\p{Ll}",
    "blank": r"[\p{Z}\x09-\x0D]",
    "upper": r"\p{Lu}",
    "stop": r"[.,;:!?]",
    "digit": r"\p{N}",
    "letter": r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]",
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Bits of a window's number that hold its place; longer texts take the form without packing.
_PLACE = 20


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text, the first one included.

    Windows are sorted with their places, so that equal ones are neighbours. Hash and place share one
    number; where hashes are equal the words are compared. The places of repeated windows, sorted
    again, cover up to three words each.
    """
    n = F.size(words)
    first = F.slice(words, F.lit(1), n - 2)
    low = F.lit((1 << _PLACE) - 1)
    place = lambda x: x.bitwiseAND(low).cast("int")
    hashes = F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def same(x: Column, y: Column) -> Column:
        p, q = place(x), place(y)
        equal = F.shiftright(x, _PLACE) == F.shiftright(y, _PLACE)
        for k in range(3):
            equal = equal & (F.get(words, p + k) == F.get(words, q + k))
        return F.coalesce(equal, F.lit(False))

    def repeated(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, _PLACE).bitwiseOR(i.cast("long"))))
        found = _let(packed, lambda s: F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))), place))
        # Most texts repeat no window and need no sorting.
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(F.array().cast("array<int>"))

    short = _let(hashes, repeated)
    windows = F.array_sort(F.transform(first, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))

    def again(s: Column) -> Column:
        equal = lambda x, j: F.coalesce(x["w"] == F.get(s, j)["w"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: equal(x, i + 1) | equal(x, i - 1)), lambda x: x["i"])

    places = F.sort_array(F.when(n < 1 << _PLACE, short).otherwise(_let(windows, again)))

    def step(done: Column, at: Column) -> Column:
        return F.struct((done["n"] + F.least(F.lit(3), at + 3 - done["to"])).alias("n"), (at + 3).alias("to"))

    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("to")), step, lambda done: done["n"])
    return F.when(n >= 3, covered).otherwise(0)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``_words`` and the base measures of the whole text."""
    text = whole_text(text_column)
    measures = F.struct(
        F.size("_words").cast("long").alias("_n_words"), F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("_n_symbols"),
        duplicate_lines(text).cast("long").alias("_n_dup_lines"), repeated_words(F.col("_words")).cast("long").alias("_n_repeat_words"),
    )
    # Behind a generator each measure is computed once, however often it is used above.
    counted = docs.withColumn("_words", words_of(text)).select("*", F.inline(F.array(measures)))
    few, much = F.col("_n_words") < LEAST_WORDS, F.col("_n_repeat_words") * 100 > F.col("_n_words") * REPEATED_PERCENT
    return counted.withColumn("_base_failed", few | much)


def class_counts(text: Column) -> Column:
    """Code points of each character class, in the order of ``CLASSES``; then of all others."""

    def rest(left: Column, patterns: list[str], counts: list[Column]) -> Column:
        if not patterns:
            return F.array(*counts, F.length(left).cast("double"))
        size = F.length(left)
        return _let(
            F.regexp_replace(left, f"(?:{patterns[0]})++", ""),
            lambda after: rest(after, patterns[1:], [*counts, (size - F.length(after)).cast("double")]),
        )

    return rest(text, list(CLASSES.values()), [])


def occurrences(words: Column, asked: Column) -> Column:
    """How often each of ``asked`` is among ``words``, none of which holds a blank: by what its removal saves."""

    def line(most: Column) -> Column:
        # Longer words than the asked ones cannot be among them.
        return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: F.length(w) <= most), "  "), F.lit(" "))

    def count(text: Column) -> Column:
        saved = lambda w: F.octet_length(text) - F.octet_length(F.replace(text, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
        return F.transform(asked, lambda w: saved(w).cast("double") / (F.octet_length(w) + 2))

    return _let(_let(F.array_max(F.transform(asked, F.length)), line), count)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if either is empty."""
    total = lambda counts: F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)

    def shares(counts: Column) -> Column:
        return _let(F.struct(counts.alias("c"), total(counts).alias("n")), lambda x: F.transform(x["c"], lambda c: c / x["n"]))

    def part(a: Column, b: Column) -> Column:
        mean = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / mean)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / mean)).otherwise(0.0)

    def both(x: Column) -> Column:
        sums = total(F.zip_with(shares(x["p"]), shares(x["q"]), part))
        return F.when((total(x["p"]) > 0) & (total(x["q"]) > 0), F.sqrt(F.greatest(F.lit(0.0), sums / 2)))

    return _let(F.struct(p.alias("p"), q.alias("q")), both)


def letter_words(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.split(F.lower(text), r"[^\p{L}]++", -1)


def references(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """Per language: mean character classes and the frequencies of its most frequent short words.

    Both are counted over all documents with at least ``GUARD_WORDS`` words; each class share is the
    mean over documents, so that no long document weighs more. Counts are combined before the shuffle.
    """
    text = whole_text(text_column)
    read = docs.select(F.col(lang_column).alias("_lang"), text.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    read = read.where((F.size("_words") >= GUARD_WORDS) & (F.col("_lang").isNotNull()))
    counts = class_counts(F.col("_text"))
    shares = read.select("_lang", F.size("_words").alias("_n"), counts.alias("c")).select(
        "_lang", "_n", *[(F.col("c")[i] / F.aggregate("c", F.lit(0.0), lambda s, x: s + x)).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    )
    chars = shares.groupBy("_lang").agg(F.sum("_n").alias("_total"), F.array(*[F.avg(f"c{i}") for i in range(len(CLASSES) + 1)]).alias("_ref_chars"))
    short = F.filter(letter_words(F.col("_text")), lambda w: F.length(w).between(1, COMMON_LETTERS))
    # The outer form, as the plain one would have the array computed again in a filter below it.
    each = read.select("_lang", F.explode_outer(short).alias("w")).where("w is not null").groupBy("_lang", "w").agg(F.count(F.lit(1)).alias("n"))
    best = each.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "w"))).where(F.col("_rank") <= COMMON_WORDS)
    common = best.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("_best"))
    both = chars.where(F.col("_total") >= REFERENCE_WORDS).join(common, "_lang").select(
        "_lang", "_total", "_ref_chars", F.transform("_best", lambda x: x["w"]).alias("_common"), F.transform("_best", lambda x: x["n"].cast("double")).alias("_ref_words")
    )
    total = F.col("_total").cast("double")
    none = F.array_repeat(F.lit(0.0), F.size("_ref_words"))
    return both.withColumns({"_none_distance": distance(with_rest(none, total), with_rest(F.col("_ref_words"), total)), "_common_share": 1 - with_rest(F.col("_ref_words"), total)[F.size("_ref_words")] / total})


def with_rest(counts: Column, total: Column) -> Column:
    """``counts`` and, as the last bin, what is missing to ``total``."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)))


@shielded(*VERDICT)
def judge(
    docs: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    char_distance: float = CHAR_DISTANCE,
    word_distance: float = WORD_DISTANCE,
    word_share: float | None = WORD_SHARE,
) -> DataFrame:
    """``docs`` with the base measures, both distances and the verdict, in columns that begin with ``_``.

    ``_n_words``, ``_word_chars``, ``_n_symbols``, ``_n_dup_lines``, ``_n_repeat_words``, ``_base_failed``,
    ``_char_distance``, ``_word_distance`` and ``_kept``. A document is rejected if the base rules fail or
    either histogram is further from its language's reference than allowed. Distances are null, and
    reject nothing, for documents below the length guards and for languages without a reference or null.

    The common words' share of a language bounds how far a document can be from it, so their limit
    follows from the reference: ``word_share`` of the distance without any of them, ``word_distance`` at
    most. Without ``word_share`` it is ``word_distance`` alone.

    A null text has no words. Repeated rows are judged each; ids play no part. An empty table gives no
    rows. Texts of any length are measured whole.
    """
    # Written once: a row per language, read for its size and for the join.
    refs = broadcast_if_small(stored(references(docs, lang_column, text_column), "references"))
    scored = measured(docs, text_column).join(refs.withColumnRenamed("_lang", "_ref_lang"), F.col(lang_column) == F.col("_ref_lang"), "left")
    text = whole_text(text_column)
    chars = F.when((F.length(text) >= GUARD_CHARS) & F.col("_ref_lang").isNotNull() & ~F.col("_base_failed"), distance(class_counts(text), F.col("_ref_chars")))
    scored = scored.withColumn("_cores", F.when((F.col("_n_words") >= GUARD_WORDS) & F.col("_ref_lang").isNotNull() & ~F.col("_base_failed"), letter_words(text)))
    own = F.when(F.col("_cores").isNotNull(), occurrences(F.col("_cores"), F.col("_common")))
    # All other words make up the last bin of both histograms.
    scored = scored.withColumn("_own", own).withColumn("_char_distance", chars)
    words = distance(with_rest(F.col("_own"), F.size("_cores").cast("double")), with_rest(F.col("_ref_words"), F.col("_total").cast("double")))
    scored = scored.withColumn("_word_distance", F.when(F.col("_cores").isNotNull(), words))
    most = F.lit(word_distance)
    if word_share is not None:
        wider = F.sqrt(F.greatest(F.lit(1.0), F.size("_common") / (F.size("_cores") * F.col("_common_share"))))
        most = F.least(most, F.col("_none_distance") * word_share * wider)
    within = (F.coalesce("_char_distance", F.lit(0.0)) <= char_distance) & F.coalesce(F.col("_word_distance") <= most, F.lit(True))
    scored = scored.withColumn("_kept", ~F.col("_base_failed") & within)
    # A generator: a filter on the verdict stays above it, where all measures are computed once.
    verdict = F.inline(F.array(F.struct(*[F.col(name) for name in VERDICT])))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], verdict)
