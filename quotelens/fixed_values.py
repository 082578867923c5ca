"""Word lists, lookup tables, formats and limits.

Every list here must equal the published behaviour for results to match, so
each is stated as plain text and is never derived.
"""

# limits
MIN_AMOUNT = 1000
MIN_CONFIDENCE = 0.70
ANOMALY_PERCENT = 15
DEFAULT_DISCOUNT = 23.8
DEFAULT_CATEGORY = "설비"
LOCK_MARKER = "IRM protected"
MIN_SIMILARITY_LIST = 0.05
MIN_SIMILARITY_MATCH = 0.10
MIN_SIMILARITY_PERCENT = 20

# File selection
FILE_GLOB = "*.{xlsx,xls}"
TEMP_FILE_PREFIX = "~$"

# Layout detection
NUMBERED_SHEET = r"^\d{1,3}(-\d)?$"
ROLLUP_SHEET_WORDS = ["단 위별", "단위별"]
STANDARD_SHEET_WORDS = [
    "HVAC", "ASSY", "ASS", "조립기", "압입기", "도포기",
    "포밍기", "검사기", "이재", "컨베어", "OTHER", "VISION",
    "서브", "I-Pin", "U핀", "I핀", "코어", "절연", "인서팅",
    "확관", "트위스팅", "하부", "납품", "친수", "바이오", "코팅",
    "라인", "LINE", "COST", "단위장비",
]
COVER_SHEET = "갑지"
QUOTE_SHEET = "견적서"
PLAIN_SHEET = "Sheet1"

# Standard layout
STANDARD_SKIP_SHEETS = ["갑지", "견적서", "공통", "PALLET", "Sheet1", "차량별합계", "첨부"]
STANDARD_SKIP_SHEET_WORDS = ["합계", "총괄", "요약", "첨부", "조건"]
STANDARD_SKIP_ROW_WORDS = [
    "소계", "합계", "이윤", "관리비", "노무비", "경비", "철거",
    "설계", "제작", "조립", "설치", "시운전", "도장", "포장",
    "운송", "안전", "순번", "원가", "직접비", "GRAND TOTAL",
    "소 계", "합 계", "대당단가", "항공료",
]
STANDARD_HEADER_WORDS = ["품명", "규격", "수량", "단가", "금액", "단위", "품  명", "단 가", "금 액"]
MAKER_HEADER_WORDS = ["메이커", "제조사", "브랜드", "MAKER"]
UNIT_TITLE_WORD = "단위공사명"
BOX_MARK = "□"

# Assembly layout
ASSEMBLY_SKIP_SHEETS = ["견적서", "Sheet1", "공통"]
ASSEMBLY_SKIP_SHEET_WORDS = ["단 위별", "단위별", "요약", "합계", "총괄"]
ASSEMBLY_SKIP_ROW_WORDS = [
    "소계", "합계", "이윤", "관리비", "노무비", "경비", "합 계", "소 계",
    "GRAND TOTAL", "구분", "장치", "내 용", "내용",
]
ASSEMBLY_HEADER_WORDS = ["품명", "품 명", "규격", "수량", "단가", "금액"]
ASSEMBLY_NAME_FALLBACK_STOP = ["단위", "수량", "구분", "번호"]

# Cover-sheet labels
QUOTE_NO_LABELS = ["견적번호", "견적No", "견적NO"]
STANDARD_DATE_LABELS = ["견적일", "제출일", "작성일"]
ASSEMBLY_DATE_LABELS = ["견적일", "제출일"]
STANDARD_PROJECT_LABELS = ["공사명", "프로젝트명", "건명"]
ASSEMBLY_PROJECT_LABELS = ["공사명", "건명", "프로젝트"]
TOTAL_LABELS = ["견적금액", "총금액", "합계금액"]
VENDOR_LABELS = ["상호", "공급사", "회사명"]
FILE_NAME_VENDOR = r"[（(]([^)）]{2,20})[)）]"
DATE_TEXT = r"(\d{4})[-./년](\d{1,2})[-./월](\d{1,2})"

# Legacy positional parsers
LEGACY_SKIP_WORDS = [
    "소계", "합계", "이윤", "관리비", "노무비", "경비", "M/D", "철거", "양산",
    "설계", "제작", "조립", "설치", "시운전", "도장", "포장", "운송", "안전",
    "순번", "원가", "직접비", "표준안전", "이벤트", "티칭", "품확", "추가공사",
    "대당단가", "항공료", "일반구매품", "외주제작품", "자재비 소계", "GRAND TOTAL",
    "소 계", "합 계",
]
LEGACY_SHEET_WORDS = [
    "단위장비", "공사(라인)", "HVAC조립", "ASSY", "ASS",
    "성형기", "압입기", "도포기", "포밍기", "조립기", "검사기",
    "이재", "컨베어", "OTHER", "VISION", "서브", "I-Pin", "U핀", "I핀",
    "코어", "절연", "인서팅", "확관", "트위스팅", "하부", "납품",
    "친수", "바이오", "코팅",
]
LEGACY_ASSEMBLY_SKIP_SHEETS = [
    "견적서", "상세 견적_메인조립기", "상세 견적_헤드서브조립기", "Sheet1", "공통", "PALLET",
]
LEGACY_ASSEMBLY_SKIP_WORDS = ["소계", "GRAND TOTAL", "구분", "장치", "내 용"]
INSTALL_SHEET_WORD = "공사(라인)"
INSTALL_MIN_AMOUNT = 100
ATTACHMENT_MARK = "(첨부)"
FIXED_LAYOUT_MARKERS = ["단위공사명", "전기부문"]
BULLETS = "■□●○"

# Uploaded quotation parser
UPLOAD_ITEM_SHEET_WORDS = [
    "단위장비", "HVAC조립", "ASSY", "ASS", "성형기", "압입기", "도포기",
    "포밍기", "조립기", "검사기", "이재", "컨베어", "헤어핀", "코어",
    "절연", "인서팅", "확관", "트위스팅", "하부", "서브", "OTHER",
    "전기", "VISION", "포승", "U핀", "I핀",
]
UPLOAD_SUMMARY_SHEET_WORDS = ["갑지", "원가항목", "단위공사별"]
UPLOAD_SKIP_WORDS = [
    "소계", "합계", "이윤", "관리비", "노무비", "경비", "M/D",
    "철거", "양산", "설계", "제작", "조립", "설치", "시운전", "도장",
    "포장", "운송", "안전", "이윤", "순번", "구분", "원가", "합 계",
]

# Page (document) tables
PAGE_SKIP_WORDS = [
    "소계", "합계", "자재비", "소 계", "합 계",
    "설치/해체", "시운전 공사", "공사 관련",
    "일반관리", "이윤", "기계 소계", "전기 소계",
]
PAGE_SKIP_STARTS = ["■", "□", "※", "●", "○"]
PAGE_UNIT_NAME = r"(?m)(?:단위공사명\(전기제외\)|전기부문)\s*[:：]\s*(.+?)\s*(?:\(첨부\)|$)"
PAGE_META_DATE = r"견적일자\s+(\d{4}-\d{2}-\d{2})"
PAGE_META_NUMBER = r"(?U)견적번호\s+([\w\-/]+)"
PAGE_META_TOTAL = r"\\([\d,]+)\s*[）\)]"
PAGE_HEADER_WORDS = ["품 명", "단가(원)"]
PAGE_TABLE_WORDS = ["품 명", "단가"]
HTML_HEADER_WORDS = ["품명", "규격", "단위"]
HTML_PRICE = r"^\d{3,9}$"

# Unit normalisation
UNIT_NORMAL = {
    "ea": "EA", "개": "EA", "pcs": "EA", "pc": "EA", "개소": "EA",
    "set": "SET", "식": "SET", "세트": "SET",
    "m": "M", "미터": "M",
    "m2": "M2", "㎡": "M2",
    "kg": "KG", "킬로": "KG",
    "l": "L", "리터": "L",
}

# Repair rules
RULE_UNITS = {
    "식": "식", "EA": "EA", "SET": "SET", "M": "M",
    "LOT": "LOT", "AY": "AY", "MD": "M/D", "M/D": "M/D",
}
RULE_MAKERS = {
    "robostar": "Robostar", "thk외": "THK외", "omron": "OMRON", "apex": "APEX",
    "thk": "THK", "unicon": "Unicon", "keyence": "Keyence", "advantech": "Advantech",
    "misumi": "misumi", "festo": "FESTO", "닛다모아": "닛다모아", "smc": "SMC",
}
RULE_SPECS = [
    "19Ø(녹색)", "12Ø(흑색)", "16x12(녹색)", "12*8(적색)", "12*8(흑색)",
    "1G25(노랑)", "1G25(녹)", "1X2X0.64", "1X2X0.8",
    "4G 0.75", "4G 1", "25G 0.75", "15G 0.75", "12G 0.75", "4G 2.5",
    "7G 1", "3G 25", "1C*25SQ(G)", "1C*25SQ(BK)", "25G*0.75SQ", "7G*1.0SQ",
]
RULE_INVALID_NAMES = ["기계"]
RULE_CATEGORY_LABELS = ["구매품", "(유공압품외)", "DIVERTER", "TURNING POSITION"]
RULE_OP_LABEL = r"(?U)^\(OP[\w,\s]+\)$"
RULE_NSET = r"(?iU)^\(\d+SET\)$"
RULE_MATERIAL_NAME = "자재비"
RULE_MATERIAL_SPEC = "철자재"
RULE_CORRECTIONS = [
    ({"item_name": "MBC ASS'Y", "maker": "OIL JET VISION UNIT"},
     {"item_name": "OIL JET VISION UNIT", "spec": "MBC ASS'Y", "maker": ""}),
    ({"maker": "BED EQUIPMENT"}, {"spec": "BED EQUIPMENT", "maker": ""}),
    ({"item_name": "서버 전송 프로그램"}, {"unit": "식"}),
]
RULE_SET_FROM_PRICE = 1_000_000
RULE_LUMP_FROM_PRICE = 10_000_000

# Review wording
BASIS_QUOTE = "견적가 적용"
BASIS_STANDARD = "표준단가 적용"
BASIS_DISCOUNT = "할인율 적용"
BASIS_MARKET = "시장가 적용"
DIRECTION_LOWER = "↓ 견적보다 낮음"
DIRECTION_HIGHER = "↑ 견적보다 높음"
DIRECTION_NONE = "N/A"
VERDICT_NONE = "표준단가 없음"
VERDICT_ABNORMAL = "⚠️ 이상가 (%+.1f%%)"
VERDICT_CHEAP = "✅ 적정 (저렴 %.1f%%)"
VERDICT_FAIR = "✅ 적정 (%+.1f%%)"
MARK_YES = "✅"
MARK_NO = "❌"
REVIEW_SOURCE = "검토확정(%s)"

# Market categories (first matching group wins, codes in visit order)
MARKET_CATEGORIES = [
    (["cylinder", "실린더", "air", "에어", "pneumatic", "공압", "유압", "hydraulic", "solenoid",
      "솔레노이드", "valve", "밸브", "filter", "필터", "regulator", "레귤레이터"],
     ["10352111", "10352112", "10352103"]),
    (["bearing", "베어링", "chain", "체인", "belt", "벨트", "pulley", "풀리", "coupling", "커플링",
      "spring", "스프링", "gear", "기어", "감속기", "reducer", "jack", "잭"],
     ["10357608", "10357609", "10357610", "10357628", "10357624", "10357611", "10357621",
      "10357619", "10357602", "10357604", "10357631", "10357613", "10357612"]),
    (["motor", "모터", "servo", "서보", "encoder", "엔코더", "sensor", "센서", "inverter", "인버터",
      "panel", "판넬", "switch", "스위치", "relay", "릴레이", "cable", "케이블", "wire", "전선"],
     ["10451502", "10451503", "10451510", "10451511", "10451201"]),
    (["tool", "공구", "drill", "드릴", "torque", "토크", "gauge", "게이지", "measure", "계측",
      "caliper", "버니어", "micrometer", "마이크로미터"],
     ["10358106", "10358117", "10358123", "10358129", "10358130", "10358118", "10358131"]),
    (["robot", "로봇", "press", "프레스", "lathe", "선반", "cnc", "자동화", "automation",
      "conveyor", "컨베이어", "컨베어"],
     ["10355647", "10355625", "10355609", "10355646", "10353618"]),
    (["welding", "용접", "electrode", "용접봉"],
     ["10356102", "10356106", "10356103"]),
    (["crane", "크레인", "hoist", "호이스트", "forklift", "지게차", "winch", "윈치"],
     ["10354113", "10354107", "10354114", "10354105", "10354104"]),
]
MARKET_FALLBACK = [
    "10352111", "10352112", "10357608", "10357609", "10357610",
    "10357628", "10357611", "10355647", "10358106", "10358123",
]
