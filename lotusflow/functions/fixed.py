"""Fixed values that results depend on."""

#: Titles of sections that hold references.
REFERENCE_HEADINGS = [
    "tham khảo", "liên kết ngoài", "xem thêm", "chú thích", "tài liệu tham khảo", "nguồn tham khảo", "đọc thêm", "tham khảo thêm",
    "ghi chú", "chú giải", "trích dẫn", "references", "see also", "external links", "notes", "footnotes", "further reading", "bibliography",
]

#: Layout switches of wiki texts.
MAGIC_WORDS = ["__NOTOC__", "__NOEDITSECTION__", "__TOC__"]

#: Defaults of the pipeline.
MAX_TOKENS, OVERLAP_TOKENS, MIN_CHUNK, MAX_CHUNK = 300, 40, 20, 2000
BM25_K, BM25_B = 1.5, 0.75
LEG_TOP_K, RRF_K, FUSED_TOP_K, CONTEXT_CHUNKS = 25, 60, 20, 5
KEEP_TURNS, CHARS_PER_TOKEN, INPUT_CHARS, OUTPUT_TOKENS, SESSION_HOURS, CACHE_DAYS = 3, 3, 500, 800, 24, 30
FLUSH_CHARS, FLUSH_MS = 32, 10

#: Intents whose answers never come from sections of references.
FACTUAL_INTENTS = ["factual", "recommendation", "comparison", "list"]

#: Messages of the answer stream and marks in prompts.
STEPS = [
    ("rewrite", "Đang viết lại câu hỏi..."),
    ("retrieval", "Đang tìm kiếm thông tin..."),
    ("context", "Tìm thấy {n} đoạn văn bản"),
    ("generation", "Đang tạo câu trả lời..."),
]
TITLE_MARK, SUMMARY_MARK, CONTEXT_MARK = "Tiêu đề: ", "[TÓM TẮT LỊCH SỬ]: ", "NGỮ CẢNH:\n"
SYSTEM_PROMPT = (
    "Bạn là trợ lý du lịch Việt Nam. Hãy trả lời câu hỏi dựa vào ngữ cảnh được cung cấp.\n\n"
    "Yêu cầu:\n"
    "- Trả lời bằng tiếng Việt, ngắn gọn, rõ ràng\n"
    "- Chỉ dựa vào thông tin trong ngữ cảnh\n"
    '- Nếu không đủ thông tin, hãy nói "Tôi không có đủ thông tin để trả lời"'
)
EVAL_CATEGORIES = ["easy", "hard", "ambiguous", "missing", "out-of-scope"]

#: Requests to the writers of summaries and to the judge, written for this engine.
SUMMARY_REQUEST = "Tóm tắt cuộc trò chuyện dưới đây thật ngắn, giữ lại tên riêng, con số và điều người dùng muốn.\n\n"
SUMMARY_BEFORE, SUMMARY_TURNS = "Tóm tắt trước:\n", "Các lượt mới:\n"
JUDGE_REQUEST = "Chấm câu trả lời. Chỉ trả về JSON với correctness (1-5), relevance (1-5), hallucination, refusal_appropriate (yes, no, n/a), reasoning.\n\n"
REWRITE_REQUEST = "Viết lại câu hỏi để tìm kiếm. Chỉ trả về JSON với rewritten_query và intent.\n\n"
SUITE_REQUEST = "Soạn câu hỏi kiểm tra theo các loại easy, hard, out-of-scope, missing, ambiguous, mỗi loại 5 câu, dưới dạng mảng JSON.\n\n"
NO_KEYWORDS = "Không có"
