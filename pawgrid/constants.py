"""Fixed values that must equal the behaviour being matched.

FIXED VALUES — labels, keywords, cut points, templates and defaults, stated plainly and in
natural order.  Every operator takes these as parameters; the values below are only the
defaults.
"""

# --- availability -------------------------------------------------------------------------
OPEN_STATE = "임보가능"
NATIONWIDE = "전국"

# --- null defaults of the raw listing (column -> default text) -------------------------------
RAW_DEFAULTS = {
    "addinfo01": "이름미정",
    "addinfo02": "구조위치미정",
    "addinfo03": "성별미정",
    "addinfo04": "중성화여부미정",
    "addinfo05": "나이정보없음",
    "addinfo08": "",
    "addinfo09": "",
    "addinfo10": "",
    "addinfo11": "",
    "addinfo16": "",
    "addinfo20": "",
    "state": "입양상태미정",
    "kind": "임보종류미정",
}

# --- defaults used by the embedding text when a column is absent ---------------------------
EMBED_DEFAULTS = {
    "addinfo01": "이름미정",
    "addinfo03": "성별미정",
    "addinfo07": "몸무게미정",
    "addinfo05": "나이미정",
    "addinfo04": "중성화미정",
    "state": "상태미정",
    "kind": "임보종류미정",
}

# --- size classes: (upper bound exclusive or inclusive, label) ------------------------------
# A: description text (7 / 20 kg, "<" bounds)
SIZE_A = [(7.0, "소형 (7kg 미만)"), (20.0, "중형 (7-20kg)")]
SIZE_A_ELSE = "대형 (20kg 이상)"
SIZE_A_NULL = "몸무게 정보 없음"
# B: embedding text (10 / 25 kg, "<" bounds; null or zero -> unknown)
SIZE_B = [(10.0, "소형"), (25.0, "중형")]
SIZE_B_ELSE = "대형"
SIZE_B_NULL = "크기미정"
# C: result statistics (5 kg "<", 15 kg "<=")
SIZE_C_SMALL = (5.0, "소형견")
SIZE_C_MEDIUM = (15.0, "중형견")
SIZE_C_ELSE = "대형견"
SIZE_C_NULL = "몸무게 불명"

# --- age buckets for statistics ("<=" bounds) ----------------------------------------------
AGE_BUCKETS = [(1.0, "1세 이하"), (3.0, "1-3세"), (7.0, "4-7세")]
AGE_BUCKET_ELSE = "8세 이상"
AGE_BUCKET_NULL = "나이 불명"

# --- age phrase from year tokens (first rule wins) -----------------------------------------
AGE_PHRASE_RULES = [
    (["2024", "2023"], "어린 동물 (1-2세 추정)"),
    (["2022", "2021", "2020"], "젊은 성체 (3-5세 추정)"),
    (["2019", "2018", "2017"], "중년 동물 (6-8세 추정)"),
    (["2016", "2015", "2014", "2013"], "고령 동물 (9세 이상 추정)"),
]
AGE_PHRASE_NULL = "나이 정보 없음"
AGE_PHRASE_OTHER_PREFIX = "나이 관련 정보: "
AGE_UNKNOWN_TEXT = "나이정보없음"

# --- age in months ---------------------------------------------------------------------------
ESTIMATE_MARK = "추정"
MONTHS_SUFFIX = "개월"
ESTIMATE_SUFFIX = "(추정)"

# --- preference slot rules: slot -> [(value, keywords)], first hit wins -----------------------
SLOT_RULES = {
    "size": [
        ("소형", ["소형견", "소형", "작은"]),
        ("중형", ["중형견", "중형", "중간"]),
        ("대형", ["대형견", "대형", "큰"]),
    ],
    "age": [
        ("어린", ["어린", "새끼", "젊은"]),
        ("고령", ["나이많은", "고령", "시니어"]),
    ],
    "gender": [
        ("남", ["수컷", "남자", "남"]),
        ("여", ["암컷", "여자", "여"]),
    ],
}
# hard filter cut points for the size slot (kg): small < 7 <= medium < 20 <= large
HARD_SIZE_CUTS = (7.0, 20.0)
# hard filter year patterns for the age slot
HARD_AGE_PATTERNS = {"어린": "2024|2023", "고령": "2013|2014|2015|2016"}

# --- candidate projection ---------------------------------------------------------------------
NO_LINK = "링크 없음"
CANDIDATE_DEFAULTS = {"age": "나이미정", "neuter": "중성화미정", "kind": "임보종류미정"}

# --- re-rank prompt and reply ------------------------------------------------------------------
PROMPT_HEAD = '사용자 쿼리:\n"{query}"\n\n아래는 추천 후보 동물 리스트입니다:'
PROMPT_ITEM = "\n{i}. 이름: {name}\n   설명: {description}\n   유사도 점수: {similarity}\n"
PROMPT_TAIL = (
    "\n\n위 정보와 사용자 쿼리를 바탕으로\n"
    "1) 가장 적합하다고 판단되는 5마리를 순서대로 추천해 주세요.\n"
    "2) 각 추천에 대해 이유를 2-3문장으로 작성해 주세요.\n"
    "3) 출력 형식은 아래와 같이 해주세요:\n\n"
    "추천 리스트:\n"
    "1. 이름: (이름)\n"
    "   이유: (이유)\n"
    "2. 이름: (이름)\n"
    "   이유: (이유)\n"
    "3. ...\n"
)
REPLY_NAME_MARK = "이름:"
REPLY_REASON_MARK = "이유:"
LOG_NO_NAME = "이름없음"
LOG_NO_REASON = "이유없음"
FALLBACK_PICKS = 5

# --- page extraction ----------------------------------------------------------------------------
PAGE_NOTICE_LABEL = "공고 번호 :"
PAGE_LIST_NOTICE_LABEL = "공고번호"
PAGE_KEY_NOTICE = "공고번호"
PAGE_KEY_TAGS = "해시태그"
PAGE_KEY_HOMES = "이런_집도_가능해요"
PAGE_KEY_TERMS = "책임자_제공_사항"
PAGE_SECTION_CARE = ("임보 조건", "임보조건_")
PAGE_SECTION_HEALTH = ("건강 정보", "건강정보_")
PAGE_SECTION_REFERENCE = ("참고용 정보", "참고용정보_")
PAGE_SECTION_TERMS = "책임자 제공 사항"
PAGE_ITEM_LINK = "상세링크"
PAGE_ITEM_NAME = "이름"
CRAWL_NO_NAMES = "N/A"

# --- enrichment (3-way join) column shaping ------------------------------------------------------
ENRICH_DROP = [
    "ordernum", "subject", "addinfo02", "inlocation", "mbuid", "d_regis",
    "name", "puid_x", "puid_y", "type", "addinfo01_y", "addinfo06", "addinfo20",
    "addinfo02_x", "kind", "steplast", "hit", "addinfo09", "addinfo23",
]
ENRICH_RENAME = {
    "uid": "Pk",
    "state": "상태",
    "addinfo01_x": "이름",
    "addinfo07": "몸무게",
    "addinfo03_x": "성별",
    "addinfo04": "중성화여부",
    "addinfo05": "출생",
    "addinfo08": "해시태그",
    "addinfo10": "성격및특징",
    "addinfo11": "건강_기타사항",
    "addinfo12": "임보가능_지역",
    "addinfo13": "addinfo13",
    "addinfo13sub01": "addinfo13sub01",
    "addinfo13sub02": "임보가능_기간",
    "addinfo14": "픽업",
    "addinfo15": "이런집도가능",
    "addinfo16": "필수조건",
    "addinfo17": "접종현황",
    "addinfo18": "검사현황",
    "addinfo19": "병력사항",
    "addinfo21": "책임자제공사항_검토필요",
    "addinfo22": "책임_기타사항",
    "s_pic01": "사진",
    "snsinfo": "sns",
    "addinfo03_y": "유의사항",
}
PERIOD_PARTS = ["addinfo13", "addinfo13sub01", "임보가능_기간"]
PERIOD_MERGED = "임보가능_기간_통합"
BIRTH_COL = "출생"
AGE_MONTHS_COL = "나이_개월수"
KEY_COL = "Pk"

# --- soft scoring --------------------------------------------------------------------------------
SCORE_THRESHOLD = 0.3
SLOT_WEIGHT_KEYS = {
    "region": "region",
    "age_preference": "age",
    "size_preference": "size",
    "personality_traits": "personality",
    "behavior_preferences": "behavior",
}

# --- interactive profile (fixed values) ----------------------------------------------------------
PROFILE_SIZE_ACCEPTABLE = {"min": 0, "max": 50}
PROFILE_WEIGHTS = {"age": 1.5, "size": 1.2, "personality": 1.8, "behavior": 1.3}

# --- sentence labels of the text builders (fixed values): column -> label --------------------------
DESCRIBE_LABELS = {
    "addinfo10": "성격 상세: ",
    "addinfo09": "구조 배경: ",
    "addinfo19": "건강 상태: ",
    "addinfo16": "특별 요구사항: ",
    "addinfo20": "일상 관리: ",
    "addinfo11": "추가 정보: ",
}
EMBED_LABELS = {
    "addinfo10": "성격 설명: ",
    "addinfo09": "구조 배경: ",
    "addinfo16": "특별 요구사항: ",
    "addinfo20": "일상 관리: ",
}
