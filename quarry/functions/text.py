"""Cleaning, sentence splitting, chunking, chunk ids and token folding.

Everything here is a native Column expression except the HTML branch of
``clean_text``, whose Arrow UDF only receives the texts that need it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.html import strip_markup_udf

# Characters counted as white space, as a list and as a regex.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(point) for point in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"

# Below U+0300 every text is in NFC; the second class adds letters that are too.
# The first is tried first, as one range is much faster to match than several.
ABOVE_LATIN = r"[\u0300-\x{10FFFF}]"
NOT_NFC_SAFE = r"[^\x00-\u02FF\u1EA0-\u1EFF\u2010-\u2027]"

# Chunk size limits in characters.
MAX_LENGTH = 1000
OVERLAP = 100
SHORT_TEXT = 50


def strip_space(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(f"(?U){SPACE}"), F.btrim(text, F.lit(SPACE_CHARS))).otherwise(text)


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def needs_parser(text: Column) -> Column:
    """The text may hold markup, entity references or characters outside NFC."""
    ascii_only = F.length(text) == F.octet_length(text)
    entity = F.contains(text, F.lit("&")) & text.rlike("&[A-Za-z#]")
    not_nfc = ~ascii_only & text.rlike(ABOVE_LATIN) & text.rlike(NOT_NFC_SAFE)
    return F.contains(text, F.lit("<")) | entity | not_nfc


def clean_text(text: Column) -> Column:
    """Visible text of an HTML fragment, NFC, blanks collapsed; null gives ''."""
    plain = F.when(~needs_parser(text), collapse_space(text))
    parsed = strip_markup_udf(F.when(needs_parser(text), text))
    return F.coalesce(plain, parsed, F.lit(""))


def split_sentences(text: Column) -> Column:
    """Sentences end at white space after . ! ? or at a line break.

    The separator takes all white space around it, so only the whole text has
    to be trimmed.
    """
    after_mark = rf"(?U)(?<=[.!?]){SPACE}+"
    stripped = strip_space(text)
    pieces = F.when(
        F.contains(stripped, F.lit("\n")), F.split(stripped, rf"{after_mark}|{SPACE}*\n{SPACE}*")
    ).otherwise(F.split(stripped, after_mark))
    return F.filter(pieces, lambda s: s != "")


# Sentences packed before their chunks are set aside.
PIECE = 256


def chunk_text(text: Column, max_length: int = MAX_LENGTH, overlap: int = OVERLAP) -> Column:
    """Pack sentences into chunks of about ``max_length`` characters.

    A full chunk hands its last ``overlap`` characters to the next one, so a
    chunk may reach ``max_length + overlap + 1``. A sentence longer than
    ``max_length`` is cut into windows and breaks the overlap. With overlap 0
    the running length is one too high after a full chunk, which is kept.

    Chunks are gathered for ``PIECE`` sentences at a time, as an array that grows is copied
    at every step; so a text of any length takes time in proportion to it.
    """
    if overlap >= max_length:
        raise ValueError("overlap must be smaller than max_length")
    no_text = F.lit(None).cast("string")

    def windows(sentence: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(sentence), F.lit(max_length - overlap))
        return F.transform(starts, lambda at: F.btrim(F.substring(sentence, at, F.lit(max_length)), F.lit(SPACE_CHARS)))

    def flushed(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["open"]))
        )

    def carried(acc: Column, sentence: Column) -> Column:
        if overlap == 0:
            return sentence
        return F.concat_ws(" ", F.right(acc["open"], F.lit(overlap)), sentence)

    def add(acc: Column, sentence: Column) -> Column:
        length = F.length(sentence)
        joined = F.when(acc["open"].isNull(), length).otherwise(acc["size"] + 1 + length)
        tail = F.least(F.length(acc["open"]), F.lit(overlap))
        cut = F.struct(
            F.concat(flushed(acc), windows(sentence)).alias("done"),
            no_text.alias("open"),
            F.lit(0).alias("size"),
        )
        extended = F.struct(
            acc["done"].alias("done"),
            F.concat_ws(" ", acc["open"], sentence).alias("open"),
            joined.alias("size"),
        )
        rolled = F.struct(
            flushed(acc).alias("done"),
            carried(acc, sentence).alias("open"),
            (tail + 1 + length).alias("size"),
        )
        return (
            F.when(length > max_length, cut).when(joined <= max_length, extended).otherwise(rolled)
        )

    def piece(acc: Column, number: Column, sentences: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), acc["open"].alias("open"), acc["size"].alias("size"))
        part = F.aggregate(F.slice(sentences, number * PIECE + 1, F.lit(PIECE)), start, add)
        # Behind a transform the part is packed once, though it is used three times.
        return F.get(
            F.transform(
                F.array(part),
                lambda x: F.struct(
                    F.concat(acc["parts"], F.array(x["done"])).alias("parts"), x["open"].alias("open"), x["size"].alias("size")
                ),
            ),
            F.lit(0),
        )

    def whole(sentences: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.size(sentences), F.lit(1)) - 1) / PIECE).cast("int"))
        first = F.struct(
            F.array().cast("array<array<string>>").alias("parts"), no_text.alias("open"), F.lit(0).alias("size")
        )
        last = lambda acc: F.when(acc["open"].isNull(), F.array().cast("array<string>")).otherwise(F.array(acc["open"]))
        return F.aggregate(
            pieces, first, lambda acc, number: piece(acc, number, sentences), lambda acc: F.concat(F.flatten(acc["parts"]), last(acc))
        )

    packed = F.get(F.transform(F.array(split_sentences(text)), whole), F.lit(0))
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(F.length(text) < SHORT_TEXT, F.array(text))
        .otherwise(packed)
    )


def explode_chunks(
    docs: DataFrame,
    text_col: str = "clean_text",
    max_length: int = MAX_LENGTH,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per chunk with its position; documents without chunks vanish."""
    return docs.select(
        "*",
        F.posexplode(chunk_text(F.col(text_col), max_length, overlap)).alias("chunk_no", "chunk_text"),
    )


def chunk_id(doc_id: Column, chunk: Column) -> Column:
    """``<doc_id>_`` plus 12 hex digits over id and text; '' without an id."""
    digest = F.substring(F.md5(F.concat(doc_id, F.lit(":"), chunk)), 1, 12)
    return F.when(doc_id.isNull() | (doc_id == ""), F.lit("")).otherwise(
        F.concat(doc_id, F.lit("_"), digest)
    )


def normalize_lines(text: Column) -> Column:
    """Trim lines, drop blank ones, join the rest with a blank."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R|[\x1c-\x1e]"), strip_space)
    return F.array_join(F.filter(lines, lambda s: s != ""), " ")


def _folding() -> tuple[str, str]:
    """Pairs for ``translate``: single letters and digits to their plain form.

    The table follows from Unicode decomposition; marks have no partner and
    are therefore deleted.
    """
    # Letters that do not decompose.
    source, target = list("đøłıħŧ"), list("doliht")
    for point in [*range(0x00A0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000), *range(0xFF10, 0xFF5B)]:
        char = chr(point).lower()
        plain = "".join(c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c))
        if len(char) == 1 and len(plain) == 1 and plain != char and plain.isalnum() and char not in source:
            source.append(char)
            target.append(plain)
    marks = [chr(point) for point in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _folding()

# Letters that fold to two.
_DIGRAPHS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))


def fold(text: Column) -> Column:
    """Case- and accent-folded text."""
    lowered = F.lower(text)
    folded = lowered
    for letter, pair in _DIGRAPHS:
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    folded = F.translate(folded, _ACCENTED, _PLAIN)
    return F.when(lowered.rlike(r"[^\x00-\x7F]"), folded).otherwise(lowered)


def fold_tokens(text: Column) -> Column:
    """Search terms: maximal runs of letters and digits of the folded text."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
