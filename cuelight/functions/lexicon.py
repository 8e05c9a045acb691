"""Fixed word lists, patterns and rule weights.

These are fixed values: results are only comparable when they are the same on
both sides, so they are stated as plain text.
"""

# The characters that count as white space at the ends of a text.
WHITE = " \t\n\r\f\x0b"

# Query stopwords.
STOPWORDS = [
    "là", "của", "và", "có", "trong", "được", "cho", "với", "các", "ở", "này", "đã", "để", "những", "khi", "ra",
    "đến", "về", "như", "tại", "từ", "vào", "bị", "bởi", "lại", "thì", "mà", "cũng", "đang", "sẽ", "phải", "qua",
    "sau", "trước", "theo", "gì", "ai", "nào", "đâu", "đây", "đó", "hãy", "một", "hai", "ba", "bốn", "năm", "sáu",
    "bảy", "tám", "chín", "mười", "nhiều", "rất", "quá", "lắm", "hơn", "nhất", "như_thế_nào", "tại_sao",
]

# Fallback dictionary, in the order in which matches are emitted.
PHRASE_DICTIONARY = [
    ("người", "person"), ("đàn ông", "man"), ("phụ nữ", "woman"), ("trẻ em", "child"),
    ("xe hơi", "car"), ("ô tô", "car"), ("xe máy", "motorcycle"), ("xe đạp", "bicycle"), ("xe buýt", "bus"),
    ("áo đỏ", "red shirt"), ("áo xanh", "blue shirt"), ("áo trắng", "white shirt"), ("áo đen", "black shirt"),
    ("váy", "dress"), ("mũ", "hat"), ("kính", "glasses"), ("hoa", "flower"), ("cây", "tree"),
    ("chó", "dog"), ("mèo", "cat"), ("chim", "bird"), ("bò", "cow"), ("ngựa", "horse"),
    ("máy tính", "laptop"), ("điện thoại", "phone"), ("ly", "cup"), ("bàn", "table"), ("ghế", "chair"),
    ("phát biểu", "speaking speech"), ("chạy", "running"), ("nhảy", "jumping"), ("bơi", "swimming"),
    ("nấu ăn", "cooking"), ("ăn", "eating"), ("uống", "drinking"), ("hát", "singing"),
    ("bữa tiệc", "party"), ("sân khấu", "stage"), ("ngoài trời", "outdoors"), ("trong nhà", "indoors"),
    ("họp báo", "press conference"), ("thời sự", "news broadcast"), ("trao giải", "award ceremony"),
    ("bóng đá", "football soccer"), ("nhảy cao", "high jump"), ("tiếp đất", "landing"),
    ("thủy lợi", "irrigation water dam"), ("đập", "dam"), ("kênh", "canal waterway"),
    ("ngăn mặn", "saltwater prevention gate"), ("chữa cháy", "firefighting fire rescue"),
]

# The five prompt templates; {} is the query.
PROMPT_TEMPLATES = [
    "{}", "a photo of {}", "a video frame showing {}", "a scene of {}", "{} in high quality",
]

# Boilerplate at the head of a query, stripped in this order.
QUERY_BOILERPLATE = [
    r"^(tìm\s+(đoạn\s+)?(video|clip|phim|cảnh)\s+(về|quay\s+cảnh)?\s*)",
    r"^(video|clip|đoạn\s+video|đoạn\s+clip|đoạn\s+phim)\s+(về|quay\s+cảnh)?\s*",
    r"^(hình\s+ảnh|cảnh\s+quay|cận\s+cảnh)\s+(về|quay)?\s*",
    r"^(trong\s+video(\s+quay\s+cảnh|\s+về)?\s*)",
    r"^(cho\s+tôi\s+xem\s+)",
    r"^(hãy\s+tìm\s+)",
    r"^(tìm\s+kiếm\s+)",
    r"^(tìm\s+)",
    r"^(cảnh\s+(?!(sát|báo|giác|quan|vật|sắc)\b))",
]

# Phrases that join two scenes, and parts that are no scene.
SCENE_CONNECTIVES = [
    "sau đó", "tiếp theo", "tiếp đến", "kế tiếp", "bắt đầu bằng", "rồi đến", "kết thúc bằng", "sau cùng",
    "then", "after that", "followed by", "next",
]
SCENE_STOP_PHRASES = [
    "đoạn phim", "video", "cảnh quay", "clip", "hình ảnh", "bộ phim", "đoạn video", "đoạn clip",
]

# Intent cues.
QUOTED = "[\"'«“][^\"'»“”]+[\"'»“”]"
OCR_CUES = (
    "chữ|biển hiệu|bảng hiệu|bảng tên|banner|tiêu đề|logo|khẩu hiệu|băng rôn|dòng chữ|tấm biển|tấm bảng|"
    "in chữ|viết chữ|ghi chữ|biển báo|số áo|áo in số"
)
SPEECH_CUES = (
    "nói|phát biểu|giọng|chia sẻ|kể về|lời thoại|bàn về|nhắc đến|hỏi|trả lời|phỏng vấn|giảng bài|tư vấn|"
    "bình luận|hát|lời bài hát|thuyết minh|tại sao|như thế nào|bao nhiêu|hướng dẫn|lời khuyên|giải thích"
)
VISUAL_CUES = (
    "mặc áo|màu|đang lái|đang chạy|nhảy|bơi|cười|ngủ|cảnh quay|khung cảnh|bầu trời|biển|núi|nhà|xe|đường phố|"
    "căn phòng|bếp|cây|hoa|con mèo|con chó|cắt|thái|nấu|xào|rán|luộc|trộn|rót|đổ|thìa|muỗng|đĩa|bát|thớt|dao"
)

# Fixed values: (category, label, w_dense, w_speech, w_ocr, confidence); the first rule that fires wins.
INTENTS = {
    "quoted": ("visual_entity_text_grounded", "OCR On-Screen Text", 0.25, 0.75, 0.60, 0.90),
    "ocr": ("visual_entity_text_grounded", "OCR On-Screen Text", 0.25, 0.75, 0.60, 0.80),
    "speech": ("speech_dialogue_grounded", "Spoken Dialogue (ASR)", 0.20, 0.80, 0.0, 0.85),
    "visual": ("visual_scene_object", "Visual Action & Scene", 0.85, 0.15, 0.0, 0.85),
    "balanced": ("balanced_multimodal", "Balanced Multimodal", 0.70, 0.30, 0.0, 0.60),
}

# Query modes by file-name marker and by prompt cue.
MODES = ["qa", "trake", "kis"]
MODE_PROMPT_CUES = {
    "qa": ["hỏi đáp", "câu hỏi", "bao nhiêu", "ở đâu", "ai là", "màu gì", "biển số"],
    "trake": ["chuỗi sự kiện", "mốc thời gian", "các phân cảnh từ lúc", "trake"],
}

# Prefixes that a generated query must not start with.
BANNED_PREFIXES = ["trong video", "hình ảnh", "đoạn phim", "cảnh quay"]

# Preambles that mark a generated transcript as chat, not as a transcript.
CHAT_PREAMBLES = [
    "here is", "dưới đây là", "bản ghi", "corrected transcript", "chắc chắn rồi", "tất nhiên",
    "refined transcript",
]

# The ten benchmark configurations (name, w_dense, w_speech, gate threshold).
BENCHMARK_CONFIGS = [
    ("dense_1.00", 1.00, 0.00, None),
    ("dense_0.85", 0.85, 0.15, None),
    ("dense_0.70", 0.70, 0.30, None),
    ("dense_0.50", 0.50, 0.50, None),
    ("dense_0.30", 0.30, 0.70, None),
    ("dense_0.00", 0.00, 1.00, None),
    ("gate_0.20", None, None, 0.20),
    ("gate_0.30", None, None, 0.30),
    ("gate_0.40", None, None, 0.40),
    ("gate_0.50", None, None, 0.50),
]

# A word boundary that both Java and RE2 read as "no letter, digit or underscore next to it".
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def whole_word(alternatives: str) -> str:
    return f"(^|{NOT_WORD})({alternatives})({NOT_WORD}|$)"
