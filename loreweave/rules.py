"""Rule packs: what topics, events and slots are called in a language's notes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RulePack:
    """Keyword rules of one language.

    ``topics``: (type, any of these words, key or None for the section's title).
    ``events``: (type, any of these words).  ``event_words``: (type of a record, groups
    of words, of each of which the text has one); the first that applies counts.
    ``mends``: whether headings broken over two lines are put together.
    """

    classes: tuple[str, ...] = ()
    world_patterns: tuple[str, ...] = ()
    world_stop_words: tuple[str, ...] = ()
    world_stop_suffix: str = ""
    topics: tuple[tuple[str, tuple[str, ...], str | None], ...] = ()
    events: tuple[tuple[str, tuple[str, ...]], ...] = ()
    strong_prefix: str = "class_change"
    event_words: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = ()
    open_words: tuple[tuple[str, ...], ...] = ()
    open_tag: str = "world_open"
    open_event: str = "world_open_event"
    history_types: frozenset[str] = frozenset()
    fallback: str = "system"
    hints: tuple[tuple[str, tuple[str, ...]], ...] = ()
    history_words: tuple[str, ...] = ()
    period_words: tuple[str, ...] = ()
    count_words: tuple[str, ...] = ()
    maintenance_word: str = ""
    spellings: tuple[tuple[str, str], ...] = ()
    markers: tuple[str, ...] = ()
    mends: bool = True
    top_endings: tuple[str, ...] = ()
    plain_ending: str = ""
    sub_words: tuple[str, ...] = ()
    answers: dict[str, str] = field(default_factory=dict)


# Words, patterns and formats of the Korean notes.
KOREAN_EVENTS = (
    ("class_change_return", ("클래스 체인지 리턴",)),
    ("class_change", ("클래스 체인지", "골드 클래스 체인지")),
    ("attendance_event", ("출석", "출석 이벤트")),
    ("boosting_event", ("부스팅", "올인원부스팅")),
    ("transfer_event", ("월드 이전", "서버 이전", "월드 이동", "서버 이동")),
    ("season_event", ("시즌", "인피니티 시즌")),
)
KOREAN = RulePack(
    classes=("아처", "메이지", "워리어", "어쌔신", "프리스트", "야만투사", "헌터", "환영검사"),
    world_patterns=(
        r"(?U)(?:신규|새로운)\s*(?:월드|서버)\s*[:：-]?\s*([가-힣A-Za-z][가-힣A-Za-z0-9]+)\s*(?:오픈|추가)",
        r"(?U)([가-힣A-Za-z][가-힣A-Za-z0-9]+)\s*(?:월드|서버)\s*(?:오픈|추가)(?!\s*후)",
        r"(?U)(?:월드|서버)\s*오픈\s*[:：-]\s*([가-힣A-Za-z][가-힣A-Za-z0-9]+)",
    ),
    world_stop_words=("전체", "기존", "신규", "통합", "일부", "특정", "안내", "이벤트", "기념", "일자", "입니다", "오픈"),
    world_stop_suffix="개",
    topics=(
        ("event", ("이벤트", "출석", "보상", "쿠폰", "기간 한정"), None),
        ("balance", ("밸런스", "상향", "하향", "조정", "너프", "버프"), "balance"),
        ("maintenance", ("점검", "긴급점검", "정기점검", "서버 작업"), "maintenance"),
        ("item", ("아이템", "장비", "드롭", "교환", "상자"), "item"),
        ("content", ("던전", "레이드", "퀘스트", "필드", "보스"), "content"),
        ("system", ("시스템", "이용 안내", "편의", "거래소", "우편", "UI"), "system"),
    ),
    events=KOREAN_EVENTS,
    event_words=(
        ("class_change_return", (("클래스 체인지 리턴",),)),
        ("class_change", (("클래스 체인지",), ("진행 기간", "계정당", "골드 클래스 체인지"))),
        ("attendance_event", (("출석",), ("기간",))),
        ("boosting_event", (("부스팅",), ("기간",))),
        ("transfer_event", (("이전", "이동"), ("월드", "서버"), ("기간",))),
        ("season_event", (("시즌",), ("기간",))),
    ),
    open_words=(("월드 오픈",), ("신규", "오픈")),
    history_types=frozenset(
        ("event", "class", "world_open", "balance", "class_change", "class_change_return", "attendance_event", "boosting_event", "transfer_event", "season_event")
    ),
    hints=(*KOREAN_EVENTS[:-1], ("season_event", ("시즌",)), ("world_open_event", ("월드 오픈", "신규 월드", "신규 서버"))),
    history_words=("언제", "기간", "역대", "모두", "정리", "몇 번"),
    period_words=("기간", "언제"),
    count_words=("몇 회", "몇 번"),
    maintenance_word="점검",
    spellings=(("백색증표", "백색 증표"), ("클래스체인지", "클래스 체인지"), ("부스팅월드", "부스팅 월드")),
    markers=("┃", "◾", "■", "[", "※"),
    top_endings=("업데이트", "안내", "변경사항", "패치노트"),
    plain_ending="드립니다.",
    sub_words=("변경", "정보", "안내"),
    answers={
        "none": "관련 패치노트를 찾지 못했습니다.",
        "history": "관련 이력 {n}건을 날짜순으로 정리했습니다.",
        "latest": "가장 관련 높은 최신 근거는 '{title}'입니다.",
    },
)

#: Event types of records, and topic keys that say nothing about a question.
EVENT_TYPES = ("class_change", "class_change_return", "attendance_event", "boosting_event", "transfer_event", "season_event", "world_open_event")
GENERIC_KEYS = ("event", "world", "balance", "maintenance", "item", "content", "system")

#: A pack for English prose, for corpora that are not Korean.
ENGLISH = RulePack(
    classes=("archer", "mage", "warrior"),
    topics=(
        ("event", ("event", "reward"), None),
        ("license", ("license", "rights reserved"), "license"),
        ("secret", ("token", "password", "secret"), "secret"),
        ("contact", ("@", "555-"), "contact"),
        ("markup", ("| ", "%%%", "$$$"), "markup"),
    ),
    events=(("season_event", ("season",)), ("boosting_event", ("boost",))),
    history_types=frozenset(("event", "class", "license", "season_event", "boosting_event")),
    hints=(("season_event", ("season",)), ("boosting_event", ("boost",))),
    history_words=("when", "history", "all of"),
    period_words=("when", "period"),
    count_words=("how often", "how many times"),
    maintenance_word="maintenance",
    spellings=(("patchnote", "patch note"),),
    markers=("#", "*", "-"),
    top_endings=("update", "notes"),
    plain_ending="thanks.",
    sub_words=("change", "info"),
    answers={"none": "Nothing related was found.", "history": "{n} related entries in order of date.", "latest": "The most related latest source is '{title}'."},
)
