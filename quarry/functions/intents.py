"""Small-talk intents: whole-string patterns with canned replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import strip_space

# Canned reply of each intent.
REPLIES = {
    "greeting": (
        "Xin chào! Tôi là trợ lý tư vấn pháp luật Việt Nam. Bạn có thể hỏi tôi về luật dân sự, hình sự, "
        "đất đai, hôn nhân – gia đình, thừa kế, lao động, doanh nghiệp… và tôi sẽ tra cứu văn bản pháp "
        "luật để trả lời."
    ),
    "capabilities": (
        "Tôi có thể giúp bạn:\n"
        "1. Tra cứu văn bản pháp luật Việt Nam (luật, nghị định, thông tư, bộ luật).\n"
        "2. Trả lời câu hỏi pháp lý dựa trên nội dung văn bản thực tế, kèm trích dẫn nguồn.\n"
        "3. Tổng hợp các quy định liên quan đến vấn đề bạn quan tâm.\n\n"
        "Bạn có thể thử các câu hỏi sau:\n"
        "• Bao nhiêu tuổi thì được kết hôn?\n"
        "• Làm giấy khai sinh cho con cần giấy tờ gì?\n"
        "• Trẻ sơ sinh có quyền thừa kế không?\n"
        "• Hút shisha có bị phạt không?"
    ),
    "identity": (
        "Tôi là chatbot tư vấn pháp luật Việt Nam, hoạt động theo kiến trúc RAG (Retrieval-Augmented "
        "Generation): tra cứu văn bản pháp luật từ cơ sở dữ liệu rồi dùng mô hình ngôn ngữ để tổng hợp "
        "câu trả lời kèm trích dẫn nguồn."
    ),
    "thanks": "Rất vui được giúp bạn! Nếu còn câu hỏi pháp lý nào khác, hãy cứ hỏi nhé.",
    "goodbye": "Tạm biệt! Chúc bạn một ngày tốt lành.",
}

# What a question must consist of, checked in this order.
PATTERNS = {
    "greeting": r"xin\s*chào|chào(\s+(bạn|anh|chị|em))?|hello|hi|hey|halo",
    "capabilities": (
        r"bạn\s+(có\s+thể\s+)?(làm|giúp)\s+(được\s+)?(gì|j)(\s+nhiều)?"
        r"|chức\s+năng\s+của\s+bạn|what\s+can\s+you\s+do"
    ),
    "identity": r"bạn\s+là\s+(ai|gì)|bạn\s+tên\s+(là\s+)?gì|who\s+are\s+you|giới\s+thiệu\s+về\s+bạn",
    "thanks": r"cảm\s*ơn|cám\s*ơn|thanks?(\s+you)?|thank\s+u|tks|ty",
    "goodbye": r"tạm\s+biệt|chào\s+(tạm\s+biệt|bạn\s+nhé)|bye(\s+bye)?|goodbye",
}


def smalltalk_intent(question: Column) -> Column:
    """Name of the first intent the whole question matches, else null."""
    stripped = strip_space(question)
    intent = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        intent = F.when(stripped.rlike(rf"(?iuU)^({pattern})\W*$"), name).otherwise(intent)
    return intent


def smalltalk_reply(question: Column) -> Column:
    """Canned reply of the intent, null when the question is a real one."""
    intent = smalltalk_intent(question)
    reply = F.lit(None).cast("string")
    for name, text in REPLIES.items():
        reply = F.when(intent == name, text).otherwise(reply)
    return reply
