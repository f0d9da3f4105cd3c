"""Prompt context and model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import strip_space
from quarry.schemas import MODEL_REPLY

# Texts around the context and the refusal.
NO_CONTEXT = "(Không có tài liệu liên quan)"
CONTEXT_HEAD = "Tài liệu tham khảo:\n"
QUESTION_HEAD = "\n\nCâu hỏi: "
NO_INFO_REPLY = "Xin lỗi, tôi không tìm thấy thông tin liên quan trong cơ sở dữ liệu."
NO_INFO_MARK = "không tìm thấy thông tin"


def context_block(position: Column, title: Column, text: Column) -> Column:
    """``[i] title`` and the chunk below it."""
    blank = F.lit("")
    return F.concat(
        F.lit("["), position.cast("string"), F.lit("] "),
        F.coalesce(title, blank), F.lit("\n"), F.coalesce(text, blank),
    )


def user_message(blocks: Column, question: Column) -> Column:
    """Context of the ranked blocks, or a fixed text, then the question."""
    has_blocks = F.coalesce(F.size(blocks), F.lit(0)) > 0
    context = F.when(has_blocks, F.array_join(blocks, "\n\n")).otherwise(NO_CONTEXT)
    return F.concat(F.lit(CONTEXT_HEAD), context, F.lit(QUESTION_HEAD), question)


def strip_outer_quotes(rewritten: Column, question: Column) -> Column:
    """Trim, drop one pair of matching quotes; an empty rewrite gives the question."""
    text = strip_space(F.coalesce(rewritten, F.lit("")))
    quoted = (text.startswith('"') & text.endswith('"')) | (text.startswith("'") & text.endswith("'"))
    inner = strip_space(F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0))))
    return F.coalesce(F.nullif(F.when(quoted, inner).otherwise(text), F.lit("")), question)


def parse_model_reply(raw: Column, hit_count: Column) -> Column:
    """``struct<answer, used>`` of a reply that should be JSON.

    A code fence around it is dropped. Entries of ``used_sources`` count only
    when they are numbers. A reply that is no JSON object is the answer as it
    stands, and uses every hit.
    """
    text = strip_space(raw)
    fenced = strip_space(F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*?)(?:```(?!.*```).*)?$", 1))
    body = F.when(text.startswith("```"), fenced).otherwise(text)
    is_object = F.try_parse_json(body).isNotNull() & body.startswith("{")
    parsed = F.from_json(F.when(is_object, body), MODEL_REPLY)
    numbers = F.filter(
        F.coalesce(parsed["used_sources"], F.array().cast(MODEL_REPLY["used_sources"].dataType)),
        lambda item: F.schema_of_variant(item).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"),
    )
    used = F.transform(
        numbers,
        lambda item: F.coalesce(
            F.try_variant_get(item, "$", "double"), F.try_variant_get(item, "$", "boolean").cast("double")
        ).cast("int"),
    )
    everything = F.when(hit_count > 0, F.sequence(F.lit(0), hit_count.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.struct(
        F.when(is_object, F.coalesce(parsed["answer"], raw)).otherwise(raw).alias("answer"),
        F.when(is_object, used).otherwise(everything).alias("used"),
    )


def says_no_info(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(NO_INFO_MARK))
