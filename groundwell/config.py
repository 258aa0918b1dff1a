"""Settings and fixed values of the question-answering dataflow."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # Limits and thresholds.
    hits_per_source: int = 3
    total_hits: int = 9
    extra_api_hits: int = 2
    score_threshold: float = 0.30
    citation_threshold: float = 0.70
    context_chars: int = 8000
    correction_chars: int = 200
    preview_chars: int = 200
    judge_chars: int = 600
    dedup_chars: int = 100
    specificity_pass: int = 4
    max_reasks: int = 5
    followup_parse_chars: int = 15
    followup_loop_chars: int = 20
    variants: int = 10
    consistency_threshold: float = 0.75
    weights: dict = field(default_factory=lambda: {"token": 0.25, "embedding": 0.40, "judge": 0.35})
    judged_pairs: int = 5
    api_score: float = 0.80
    api_laws: int = 2
    api_articles: int = 3
    retrieve_api_articles: int = 2
    history_scan: int = 4
    history_user_turns: int = 2
    history_prompt: int = 6
    history_cap: int = 20
    reply_chars: int = 500


DEFAULT = Config()

# Expansion rules, in order.
EXPANSIONS = [
    (r"딥페이크|허위영상|합성물", "성폭력범죄의 처벌 등에 관한 특례법 제14조의2"),
    (r"불법촬영|몰카|카메라", "성폭력범죄의 처벌 등에 관한 특례법 제14조"),
    (r"사이버|온라인.*성희롱|통신.*음란", "성폭력범죄의 처벌 등에 관한 특례법 제13조"),
    (r"강제추행|추행|신체접촉", "형법 제298조 강제추행"),
    (r"성희롱|직장내.*성희롱", "남녀고용평등과 일·가정 양립 지원에 관한 법률 제12조"),
    (r"근로.*해고|부당해고|해고예고", "근로기준법 제23조 제26조 제28조"),
    (r"연장근로|야간근로|휴일근로|수당", "근로기준법 제56조"),
    (r"육아휴직|출산휴가|산전산후", "근로기준법 제74조"),
    (r"직장내.*괴롭힘|직장.*갑질", "근로기준법 제76조의2"),
    (r"임금.*체불|임금미지급", "근로기준법 제43조 제36조"),
    (r"아르바이트|알바|시급", "근로기준법 최저임금법"),
    (r"피해신고|신고방법|어디.*신고", "디지털성범죄피해자지원센터 1366 경찰"),
    (r"삭제.*지원|유포.*삭제", "디지털성범죄피해자지원센터 삭제지원"),
    (r"증거.*확보|증거.*보존", "증거 확보 방법 캡처 저장"),
]

# Re-ask templates by category.
UNCLEAR = "불명확"
REASKS = {
    "형사": [
        "가해자와 피해자의 관계(고용주/동료/타인/모르는 사람)가 어떻게 되나요? 관계에 따라 적용되는 법령이 달라집니다.",
        "신체 접촉이 있었나요, 아니면 언어적 성희롱이었나요? 물리적 접촉 여부에 따라 강제추행죄 또는 성희롱으로 구분됩니다.",
        "해당 행위가 발생한 장소와 상황(업무 중/회식/이동 중)을 알 수 있나요? 업무 관련성이 처벌 수위에 영향을 줍니다.",
        "사건 당시 또는 이후 증거(문자, 녹음, 목격자)가 있나요? 증거 유무가 고소 전략에 중요합니다.",
        "현재 원하시는 것이 형사 고소인가요, 민사 손해배상인가요, 아니면 두 가지 모두인가요?",
    ],
    "노동": [
        "고용 형태가 정규직인가요, 아르바이트(단시간근로자)인가요? 형태에 따라 적용되는 근로기준법 조항이 다릅니다.",
        "근로계약서를 작성하셨나요? 계약서 존재 여부가 법적 입증에 중요합니다.",
        "임금 체불이라면 미지급 기간과 금액이 얼마나 되나요? 금액에 따라 진정·고소 전략이 달라집니다.",
        "해고를 당하셨다면 사전에 해고 예고를 받으셨나요? 예고 없는 해고는 부당해고 가능성이 있습니다.",
        "재직 기간이 얼마나 되나요? 퇴직금 청구 가능 여부(1년 이상)와 관련이 있습니다.",
    ],
    "민사": [
        "금전 거래라면 차용증이나 이체 내역 등 채무 증거가 있나요?",
        "상대방과 합의를 시도한 적이 있나요? 합의 시도 여부가 소송 전략에 영향을 줍니다.",
        "청구하려는 금액이 얼마나 되나요? 금액에 따라 소액사건심판(3천만 원 이하) 또는 일반 민사소송으로 나뉩니다.",
    ],
    UNCLEAR: [
        "발생한 일이 신체적 피해인가요, 금전적 피해인가요, 아니면 명예 훼손 등 다른 유형인가요? 피해 유형에 따라 적용 법령이 완전히 달라집니다.",
        "가해자가 누구인지 알고 계신가요? (고용주/동료/타인) 관계에 따라 형사·민사·노동법 중 어떤 법률이 적용될지 달라집니다.",
    ],
}

# Texts and formats.
SEPARATOR = "\n\n---\n\n"
CUT = "\n\n[... 컨텍스트 일부 생략 ...]"
CORE_MARKERS = ["(4)", "(5)", "대처 방안", "유의사항", "본 답변은 참고용"]
CITATION = r"[가-힣]{2,25}(?:법률?|규칙|령|조례)?\s*제\d+조(?:의\d+)?(?:\s*제\d+항)?(?:\s*제\d+호)?"
PROMPT = ("[참고자료]\n", "\n\n---\n\n[상담 질문]\n", "\n\n위 참고자료를 바탕으로 지정된 답변 형식에 따라 답변해 주세요.")
NO_HITS_SINGLE = (
    "죄송합니다. 현재 데이터베이스에서 해당 질문과 관련된 법령·판례·지침을 찾지 못했습니다. "
    "법률구조공단(132) 또는 여성긴급전화(1366)에 문의하세요."
)
NO_HITS_PARALLEL = "죄송합니다. 관련 법령·판례를 찾지 못했습니다. 법률구조공단(132) 또는 여성긴급전화(1366)에 문의하세요."
NO_RESULT = "RAG 검색 결과가 없습니다. 법률구조공단(132)에 문의하세요."
REFUSAL = (
    "죄송합니다. 현재 해당 질문에 대해 신뢰할 수 있는 답변을 생성할 수 없습니다.\n"
    "정확한 법률 상담을 위해 법률구조공단(132) 또는 여성긴급전화(1366)에 문의하세요."
)
COMIC_WORDS = ["그림", "만화", "그려줘", "시각화"]
IMAGE_WORDS = ["그림", "그려줘", "묘사", "이미지", "상황", "어떤 모습", "어떤 상황"]
WAIT_COMIC = "AI가 상황을 분석하고 만화를 그리는 중입니다. 약 15초 정도 소요되니 잠시만 기다려주세요! 🎨"
WAIT_TEXT = "⚖️ 법률 질문을 분석하고 있어요. 잠시만 기다려 주세요 😊"
WAIT_ANSWER = "💬 답변을 생각하고 있습니다. 잠시만 기다려 주세요..."
EMPTY_UTTERANCE = "상담 내용을 입력해 주세요."
IMAGE_FAILED = "🎨 이미지 생성에 실패했습니다. 다시 시도해주세요."
IMAGE_ALT = "법률 상황 네컷만화"
STATUS_OK = "상태 확인 완료"
CARD = ("⚖️ 상황 묘사 및 법률 분석", "아래의 텍스트 답변을 확인해 주세요.")
IMAGE_URL = ("https://image.pollinations.ai/prompt/", "?width=800&height=400&nologo=true&seed=")
COMMANDS = {
    "quit": ["종료", "exit", "quit", "q"],
    "reset": ["초기화", "reset", "새대화"],
    "history": ["이력", "history", "대화이력"],
    "verbose": ["상세", "verbose"],
    "search": ["검색만", "search"],
    "help": ["도움말", "help", "?"],
}
PRECEDENT_FIELDS = [
    "판례일련번호", "사건명", "사건번호", "선고일자", "법원명", "사건종류명",
    "판결유형", "판시사항", "판결요지", "참조조문", "참조판례", "판례내용",
]
PRECEDENT_KEYS = {"판례일련번호": "판례정보일련번호"}
SUPREME_COURT = "대법원"
