"""Results are only right when these equal the published ones.

Site keys, word lists, patterns, message texts, number limits and prompt
templates. Nothing here is logic.
"""

# --- sites and calendar -----------------------------------------------------
SITES = ("kakaomap", "myrealtrip", "tripdotcom")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# --- cleaning limits --------------------------------------------------------
RATING_MIN, RATING_MAX = 1, 5
DATE_MIN = "2022-01-01"
LENGTH_ABOVE, LENGTH_BELOW = 5, 250
TOKEN_LIMIT = 250
SOURCE_CAP = 500
INDEX_LENGTH_ABOVE = 10

# site, shortest and longest ordinary text, first ordinary day
OUTLIER_RULES = (
    ("kakaomap", 3, 125, "2022-07-01"),
    ("myrealtrip", 3, 58, "2022-01-01"),
    ("tripdotcom", 5, 240, "2022-01-01"),
)

# --- retrieval --------------------------------------------------------------
SEARCH_K, SCORE_MIN, KEEP_AT_LEAST, KEEP_AT_MOST = 10, 0.4, 3, 5
MMR_FETCH, MMR_KEEP = 25, 5
CONFIDENCE_LOW, CONFIDENCE_HIGH = 0.5, 0.7
HISTORY_TURNS = 5
DEFAULT_PLACE = "롯데월드"
INDEX_REQUIRED = ("content", "platform", "date", "rating")

# --- routing ----------------------------------------------------------------
ROUTES = ("chat", "subject_info", "rag_review")
REVIEW_WORDS = ("후기", "리뷰", "평가", "추천", "어때", "만족", "재밌", "별로", "좋아", "나빠", "요약")
INFO_WORDS = ("위치", "주소", "가격", "요금", "티켓", "운영시간", "시간", "어트랙션", "시설", "교통")

# --- subjects ---------------------------------------------------------------
CATEGORY_WORDS = (
    ("테마파크", ("테마파크", "놀이공원", "롯데월드", "어트랙션", "놀이기구", "어드벤처", "매직아일랜드")),
    ("관광지", ("관광지", "여행지", "명소")),
    ("레스토랑", ("레스토랑", "맛집", "음식점")),
    ("호텔", ("호텔", "숙박", "리조트")),
)
NO_CATEGORY = "general"
NAME_ENDINGS = ("에 대해", "에 대한", " 정보", " 알려", "는", "이", " 설명", " 소개")
NAME_STOPWORDS = ("에", "대해", "대한", "정보", "알려", "설명", "소개", "무엇", "어떤", "줘", "주세요")
AGE_LABELS = {"adult": "성인", "teen": "청소년", "child": "어린이"}

# --- dates on the third site ------------------------------------------------
DATE_LABEL = "작성일"
DATE_PATTERNS = ("yyyy.MM.dd", "yyyy.M.d.", "yyyy.M.d", "yyyy년 M월 d일")

# --- keyed changes ----------------------------------------------------------
MSG_NOT_FOUND = "User not Found."
MSG_MISMATCH = "Invalid ID/PW"
MSG_EXISTS = "User already Exists."
MSG_LOGIN = "Login Success."
MSG_REGISTERED = "User registeration success."
MSG_DELETED = "User Deletion Success"
MSG_UPDATED = "User password updated successfully."

# --- replies ----------------------------------------------------------------
REPLY_BLANK_QUESTION = "질문이 비어 있어요. 어떤 점이 궁금한가요?"
REPLY_NO_REVIEWS = "관련된 리뷰를 찾을 수 없어요. 다른 질문을 해보시겠어요?"
NO_REFERENCES = "   - (관련 후기 없음)"
REPLY_CHAT_FAILED = "롯데월드에 대해 궁금한 점이 있으시면 언제든 물어보세요!"
REPLY_REVIEW_FAILED = "리뷰 검색 중 오류가 발생했어요: {error}"
REPLY_SUBJECT_FAILED = "죄송합니다. {subject}에 대한 정보를 가져오는 중 오류가 발생했습니다. 다시 시도해 주세요."
NOTE_LOW = "\n\n💡 *검색된 리뷰와의 관련성이 다소 낮을 수 있습니다. 더 구체적인 질문을 해보시겠어요?*"
NOTE_HIGH = "\n\n✨ *매우 관련성이 높은 리뷰들을 찾았습니다!*"

# --- prompt templates -------------------------------------------------------
PROMPT_REVIEW = """
당신은 롯데월드 방문객 후기만 보고 답하는 어시스턴트입니다.

- 후기 내용을 바탕으로 친근하고 이해하기 쉽게 답해주세요.
- 긍정적인 점과 아쉬운 점을 골고루 전해 주세요.
- 개인정보나 부적절한 내용은 부드럽게 요약해 주세요.
- 관련 후기가 부족하면 솔직히 말씀드리고, 다른 질문을 권해 주세요.

출력 시 마크다운 문법 사용 가능하며, 읽기 쉽게 정리해 주세요.

아래는 관련 후기 내용입니다:
{context}

사용자 질문:
{question}

이 내용을 참고해 자연스럽고 간결하게 답변해 주세요.
"""

PROMPT_INTENT = """너는 분류기야. 다음 사용자 메시지를 세 라벨 중 하나로만 분류해서 JSON으로 답해.

라벨:
- "chat": 가벼운 인사/잡담/명확하지 않은 요청
- "subject_info": 위치·티켓(요금)·운영시간·편의시설 등 '기본정보' 성격  
- "rag_review": 후기·평판·장단점·혼잡/대기줄·비교 등 '리뷰 근거'가 필요한 성격

출력 형식(중요): {"intent":"chat"} 또는 {"intent":"subject_info"} 또는 {"intent":"rag_review"}
그 외 설명이나 텍스트를 절대 붙이지 마.

사용자 메시지:
\"\"\"{user_message}\"\"\"
"""

PROMPT_SUBJECT_SYSTEM = """당신은 롯데월드의 기본 정보를 제공하는 전문 어시스턴트입니다.

제공 가능한 정보:
- 위치 및 교통 정보
- 티켓 가격 및 할인 정보  
- 운영시간 및 휴무일
- 주요 시설 및 어트랙션
- 편의시설 정보
- 방문 팁

응답 스타일:
- 정확하고 구체적인 정보 제공
- 사용자가 요청한 특정 정보에 집중
- 추가로 도움이 될 만한 관련 정보 제안
- 친절하고 전문적인 톤

주어진 정보를 바탕으로 사용자의 질문에 정확하고 도움이 되는 답변을 제공해주세요."""

PROMPT_SUBJECT_FOUND = """{system}


다음은 '{name}'에 대한 정보입니다:

{details}

사용자 질문: {question}
"""

PROMPT_SUBJECT_MISSING = """{system}


'{name}'에 대한 정보를 요청받았지만, 저희 데이터베이스에서 해당 정보를 찾을 수 없습니다.

사용자 요청: {question}

현재 제공 가능한 정보는 롯데월드에 대한 기본 정보입니다.
"""

PROMPT_CHAT = """당신은 친근하고 자연스러운 대화를 나누는 챗봇입니다.

다음 규칙을 정확히 따르세요:
1. 답변은 정확히 두 문장으로 구성하세요
2. 두 번째 문장은 반드시 질문으로 끝내세요
3. 추가 설명이나 괄호, 별표 표시는 절대 하지 마세요
4. 답변만 출력하고 다른 내용은 포함하지 마세요

예시:
사용자: "안녕하세요"
답변: "안녕하세요! 오늘 기분은 어떠세요? 😊"

사용자: "날씨가 좋네요"  
답변: "정말 화창한 날씨네요! 이런 날엔 어디 나들이 가고 싶지 않으세요?"
"""
