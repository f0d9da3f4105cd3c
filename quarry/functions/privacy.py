"""Redaction of personal data and hashes of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and pattern, applied in this order. A ten-digit tax code
# that starts with 0 is therefore taken for a phone number.
PATTERNS = (
    ("[EMAIL]", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"),
    ("[PHONE]", r"\b(?:\+?84|0)(?:\d[\s.-]?){8,10}\b"),
    ("[TAX_ID]", r"\b\d{10}(?:-\d{3})?\b"),
    ("[ID]", r"\b\d{9}\b|\b\d{12}\b"),
)

CACHE_PREFIX = "chat:"


# What a text must contain for a pattern to match at all.
_EMAIL_SIGN = "@"
_NINE_DIGITS = r"(?U)(?:\d[\s.-]?){9}"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def redact_pii(text: Column) -> tuple[Column, Column]:
    """Redacted text and number of replacements over all patterns."""

    def apply(label: str, pattern: str) -> Callable[[Column], Column]:
        regex = F.lit("(?U)" + pattern)
        return lambda done: F.struct(
            F.regexp_replace(done["text"], regex, F.lit(label)).alias("text"),
            (done["n"] + F.regexp_count(done["text"], regex)).alias("n"),
        )

    def numbers(done: Column) -> Column:
        for label, pattern in PATTERNS[1:]:
            done = _bind(done, apply(label, pattern))
        return done

    untouched = F.struct(text.alias("text"), F.lit(0).alias("n"))
    mailed = F.when(F.contains(text, F.lit(_EMAIL_SIGN)), _bind(untouched, apply(*PATTERNS[0]))).otherwise(untouched)
    result = _bind(
        mailed, lambda done: F.when(done["text"].rlike(_NINE_DIGITS), numbers(done)).otherwise(done)
    )
    return result["text"], result["n"]


def question_hash(question: Column) -> Column:
    return F.sha2(question, 256)


def cache_key(question: Column) -> Column:
    return F.concat(F.lit(CACHE_PREFIX), question_hash(question))
