"""Fixed values that results depend on: patterns, word lists and limits.

The patterns follow Unicode classes and treat only a newline as line end, so
Java needs the flags (?U) and (?d).
"""

from __future__ import annotations

# Limits.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_LEAST = 700, 100, 4
VECTOR_CANDIDATES, KEYWORD_CANDIDATES, QUERY_TERMS = 20, 20, 32
RRF_K, RERANK_TOP, CONTEXTS = 60, 8, 6
SECTION_CHUNKS, SECTION_CHARS, CONTEXT_CHARS = 8, 3000, 12000
HEADING_RATIO, HEADING_CHARS, BODY_SAMPLE_CHARS, BREADCRUMB = 1.12, 90, 40, 3
MARGIN_RATIO, REPEATS = 0.07, 3
SNIPPET_CHARS, EMBED_CHARS, RERANK_CHARS, NER_SEGMENT = 300, 3000, 2000, 300

# Tokens.
ASCII_RUN = "[a-z0-9]+"
CJK_RUN = "[㐀-䶿一-鿿豈-﫿]+"

# Document structure.
SENTENCE_END = "(?<=[。！？!?；;\n])"
HEADING_STYLE = r"(?i)(?:heading|标题)\s*([1-9])"
CAPTION = r"(?iU)^\s*(figure|fig\.?|table|chart|图|表)\s*[\d一二三四五六七八九十]"
FIGURE_CAPTION = r"(?U)^\s*(图|表|图表|Figure|Fig\.?|Table)\s*[\d一二三四五六七八九十]+"

# Citations and placeholders.
CITATION = r"\[(\d{1,2})\]"
PLACEHOLDER = r"(?U)\[[^\W\d][\w·]{0,19}\d{1,4}\]"
#: The label and the whole number of a placeholder.
NUMBERED = r"(?U)^\[([^\W\d][\w·]*?)(\d+)\]$"
ILLEGAL_IN_NAMES = r'[\\/:*?"<>|\r\n\t]'

# Number-shaped personal data as (label, pattern, priority).
NUMBER_RULES = [
    ("身份证", r"(?<![0-9A-Za-z])\d{17}[\dXx](?![0-9A-Za-z])", 100),
    ("信用代码", r"(?<![0-9A-Za-z])[0-9A-HJ-NPQRTUWXY]{18}(?![0-9A-Za-z])", 95),
    ("邮箱", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?![A-Za-z])", 90),
    ("电话", r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d(?:[-\s]?\d{4}){2}(?!\d)", 86),
    ("电话", r"(?<!\d)(?:400|800)[-\s]?\d{3}[-\s]?\d{4}(?!\d)", 84),
    ("银行卡", r"(?<!\d)\d{16,19}(?!\d)", 82),
    ("银行卡", r"(?<!\d)\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{3,4}(?!\d)", 81),
    ("座机", r"(?<!\d)\(?0\d{2,3}\)?[-\s]?\d{7,8}(?!\d)", 70),
]

# Field names that announce personal data as (label, pattern, kind of check, priority).
FIELD_RULES = [
    ("姓名", r"(?:姓\s*名|投保人|被保险人|受益人|客户姓名|联系人|申请人|户主|业主|家长)", "person", 96),
    ("地址", r"(?:联系地址|通讯地址|通信地址|居住地址|家庭住址|户籍地址|送达地址|住\s*址|地\s*址|住所地|工作地址|现居地址)", "address", 96),
    ("机构", r"(?:保险人|投保单位|工作单位|单位名称|公司名称|开户行|开户银行|就诊医院|就读学校|学校名称|发卡银行)", "org", 96),
    ("编号", r"(?:合同编号|保单号|保单号码|保险单号|证件号码|证件号|身份证号|身份证号码|统一社会信用代码|纳税人识别号|社保号|医保号|员工编号|工\s*号|学\s*号)", "code", 96),
    ("日期", r"(?:出生日期|出生年月日|出生年月|生\s*日)", "birthday", 96),
]
FIELD_SEPARATOR = r"\s*(?:[（(][^）)]{0,12}[）)])?\s*[：:]\s*(?:指|为|系|是)?\s*"
FIELD_VALUE = r"(.{1,60}?)(?=\s*[一-龥A-Za-z]{2,10}\s*[：:]|[，,。；;、|｜\n\r]|$)"
CELL_BEFORE, CELL_BETWEEN, CELL_VALUE = r"\|\s*", r"\s*\|\s*", r"([^|\n\r]{1,60}?)\s*(?=\|)"

# Word lists of the checks.
ORG_WORDS = ["公司", "银行", "医院", "学校", "大学", "学院", "中心", "事务所", "委员会", "集团", "保险", "支行", "分行", "诊所", "药房", "研究院", "管理局", "合作社"]
REGION_WORDS = ["省", "市", "区", "县", "镇", "乡", "村", "路", "街", "道", "巷", "号", "栋", "幢", "楼", "室", "大厦", "花园", "小区", "广场", "公寓", "苑", "里", "弄"]
NAME_STOP = ["甲方", "乙方", "丙方", "本人", "其本人", "同一人", "上述", "投保人", "被保险人", "受益人", "以下简称", "无", "不详", "未填写", "身份证", "户口簿", "法定继承人", "继承人", "法定代理人", "代理人", "监护人", "配偶", "子女", "父母", "法定受益人", "指定受益人", "全体继承人", "其他", "其他人员"]
ROLE_ENDINGS = "[人者方们等]$"
HAN_NAME = r"^[一-龥·]{2,6}$"
CODE = r"^[A-Za-z0-9][A-Za-z0-9\-*/_]{5,39}$"
BIRTHDAY = r"(?U)^\d{4}\s*(?:年|[-/.])\s*\d{1,2}\s*(?:月|[-/.])\s*\d{1,2}\s*日?$"

# Placeholder labels of the entity types a recogniser gives.
ENTITY_LABELS = {"PER": "姓名", "PERSON": "姓名", "NAME": "姓名", "LOC": "地址", "LOCATION": "地址", "GPE": "地区", "ORG": "机构", "ORGANIZATION": "机构"}
NO_LABEL = "敏感信息"

# Texts of the prompt and the citation panel.
PROMPT_NONE = "（无）"
PROMPT_RULES = "给出结论，并在每条结论后用 [编号] 标注来源；若资料不足请直接说明。"
MISSING_SOURCE = "⚠️ 未找到原件，无法定位出处"
EMPTY_TEXT = "（空内容）"
SECTION_PREFIX, FIGURE_PREFIX = "章节：", "（图表内容）"

# The session of records from before there were sessions.
OLD_SESSION, OLD_TITLE = "history-default", "历史对话"
