"""Fixed values shared by the operators.

These must keep their exact values for results to agree with the published
product behaviour; every function that uses one also accepts it as an argument.
"""

# Official review categories, in display order.
OFFICIAL_CATEGORIES = (
    "Electronics",
    "Beauty_and_Personal_Care",
    "Cell_Phones_and_Accessories",
    "Home_and_Kitchen",
    "Sports_and_Outdoors",
    "Toys_and_Games",
    "Health_and_Household",
)

POLARITIES = ("positive", "negative", "neutral", "uncertain")

# Supported review time range: half-open, UTC.
FIRST_YEAR = 1990
END_YEAR = 2101

# Two-month comparison.
MIN_REVIEW_COUNT = 30
MIN_NEGATIVE_COUNT = 5
MIN_INCREASE_PP = 10.0
MAX_FAILURE_RATE = 0.05

# Anomaly radar.
RADAR_MIN_ANALYZED = 10
RADAR_MIN_NEGATIVE = 3
RADAR_MIN_INCREASE_PP = 10.0
RADAR_Q = 0.10
RADAR_WATCH_P = 0.05
RADAR_EVIDENCE = 5

# Three-month window selection.
WINDOW_MIN_PER_MONTH = 30
WINDOW_MIN_TOTAL = 150
WINDOW_MAX_TOTAL = 600
WINDOW_CENTER = 375
PRODUCTS_PER_CATEGORY = 8
PROFILE_TOP = 100

# Staged processing of a sample: prefix sizes before "everything".
STAGES = (20, 30, 50, 70, 100)

# Evidence rule.
MIN_EVIDENCE_WORDS = 2
SHORT_PART_WORDS = 4

# Answers.
STALE_RATIO = 0.05
STALE_MIN_COUNT = 2
MIN_ANALYZED_FOR_RATES = 30
PERCENT_TOLERANCE = 0.51
REPEAT_SIMILARITY = 0.85
PREVIOUS_ANSWER_CHARS = 200
QUESTION_KEY_CHARS = 600
FAQ_MATCH_SIMILARITY = 0.80
NEAREST_TOPICS = 2
TOPIC_EXAMPLES = 2
RELATED_REVIEWS = 4
RELATED_IN_DIGEST = 2
QUICK_EXCERPT_CHARS = 300
DIGEST_EXCERPT_CHARS = 100
SEARCH_LIMIT = 8
RELATED_LABEL = "related"
INTERNAL_TERMS = (
    "FACTS", "REVIEWS", "HISTORY", "review_id", "cited_review_ids", "[자료]",
)

# Regular expressions.
HARD_CASE_PATTERN = (
    r"\b(not|never|but|although|however|stopped|broken|broke|arrived|refund|stars?)\b"
)
NUMBER_PATTERN = r"\d+(?:\.\d+)?"
PERCENT_PATTERN = r"(\d+(?:\.\d+)?)\s*(?:%p|%|퍼센트|포인트)"
CITATION_PATTERN = r"\[(\d{1,2})\]"
QUESTION_TAIL_PATTERN = r"[\s?!.~。？！]+$"

# Frequently asked questions: (key, question).
FAQ_QUESTIONS = (
    ("summary", "이 상품 리뷰를 종합하면 어떤가요? 좋은 점과 아쉬운 점을 알려 주세요."),
    ("durability", "금방 고장 나거나 불량이 많은가요?"),
    ("shipping", "배송이나 포장 문제는 없나요?"),
    ("value", "가격 대비 괜찮은가요?"),
    ("usability", "사용하거나 설치하기 편한가요?"),
    ("safety", "안전 문제나 주의할 점은 없나요?"),
    ("quality", "재질이나 마감이 튼튼한가요?"),
    ("size", "크기나 사이즈가 설명과 맞나요?"),
    ("performance", "제 기능을 잘 하나요?"),
    ("top_complaint", "가장 많이 나오는 불만은 뭔가요?"),
    ("recent_change", "최근에 품질이 달라졌나요?"),
    ("fit_for", "어떤 사람에게 잘 맞나요?"),
)
CHANGES_IN_DIGEST = 2
