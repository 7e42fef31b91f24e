"""Detection rules: what counts as a personal-data value.

Every pattern is written in the syntax that ``java.util.regex`` and Python's
``re`` (3.11+) share, so the Spark engine and the brute-force tests read the
same text.  Flags are kept beside the pattern, not inside it.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Fixed values.  These have to equal the published behaviour for the results
# to be right: entity names and their order, patterns, scores, word lists.
# --------------------------------------------------------------------------
ENTITY_ORDER = [
    "PERSON", "PHONE_NUMBER", "EMAIL", "HKID", "MACAU_ID", "ADDRESS",
    "CREDIT_CARD", "PASSPORT", "IP_ADDRESS", "LICENSE_PLATE",
]
EXTENDED_ENTITIES = ["BANK_ACCOUNT", "BIRTHDAY"]

LEFT = r"(?<![A-Za-z0-9])"
RIGHT = r"(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"

ZH_CHAR = r"[^\s，。、：；！？「」『』（）【】《》…,.;:!?(){}\[\]\"']"
ZH_STREET = "道|路|街|大道|徑|巷|里|圍"
ZH_BUILDING = "大廈|中心|花園|廣場|苑|邨|樓|村"
ZH_MACAU = "馬路|街|里|巷|圍|石級|斜路"

EN_WORD = r"(?:[A-ZÀ-Ý][a-zà-ÿ]+|[A-ZÀ-Ý]{2,})"
EN_SUFFIX = (
    "Rd|RD|St|ST|Ave|AVE|Drive|DRIVE|Dr|DR|Bldg|BLDG|Tower|TOWER|Centre|CENTRE|"
    "Plaza|PLAZA|Garden|GARDEN|Ct|CT|Cres|CRES|Terr|TERR|Ln|LN"
)

PT_STREET = (
    "Rua|Avenida|Av|Travessa|Tv|Estrada|Caminho|Calçada|Largo|Praça|Praceta|Beco|"
    "Pátio|Alameda|Rotunda|Bairro|Parque|Jardim|Adro|Azinhaga|Escadaria|Miradouro|"
    "Rampa|Istmo|Ponte|Túnel|Viaduto"
)
PT_BUILDING = (
    "Edifício|Centro Comercial|Centro|Jardins|Bloco|Torre|Urbanização|Condomínio|"
    "Vivenda|Quinta"
)
PT_PREPOSITION = "de|da|do|das|dos|DE|DA|DO|DAS|DOS"
PT_LETTER = "[A-ZÀ-Ýa-zà-ÿ]"

NAME_FIELDS = (
    "姓名|本人姓名|申請人|簽署|提交人|聯絡人|負責人|代表人|家長|監護人|子女|本人|"
    "投訴人|反映人|發件人|收件人"
)
NAME_ALL_CAPS = r"[A-ZÀ-Ý]{2,}(?:\s+[A-ZÀ-Ý]{2,}){1,5}"
NAME_TITLE_CASE = (
    r"[A-Z][a-zà-ÿ]+(?:\s+(?:de|da|do|das|dos)\s+[A-Z][a-zà-ÿ]+|\s+[A-Z][a-zà-ÿ]+){1,5}"
)
NAME_CJK = "[一-鿿]{2,4}"

DATE_LIKE = r"^(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])$"
CJK_OR_PUNCT = "[　-〿一-鿿]"
DIGITS_ONLY = r"^[\d\s\-\(\)]+$"
NAME_PUNCTUATION = "[()（）.,，。、；;：:！!？?「」『』\"'`]"
PT_PREFIX_NOT_NAME = (
    "Edif[ií]cio|Centro Comercial|Centro|Jardins?|Bloco|Torre|Urbaniza[çc][ãa]o|"
    r"Condom[ií]nio|Vivenda|Quinta|Rua|Avenida|Av\.?|Travessa|Tv\.?|Estrada|Caminho|"
    "Cal[çc]ada|Largo|Pra[çc]a|Praceta|Beco|P[áa]tio|Alameda|Rotunda|Bairro|Parque|"
    "Jardim|Adro|Azinhaga|Escadaria|Miradouro|Rampa|Istmo|Ponte|T[úu]nel|Viaduto"
)
NOT_A_NAME = (
    "for out but and nor yet so or in on at to of by with from into onto upon over "
    "under after before about above below between through during born been have has "
    "had was were will would could should shall may might can did does done made make "
    "makes get got put set let run ran email phone tel fax date time year month day "
    "version address name number code id no yes true false null user test demo sample "
    "example data file form page link url http https this that these those there here "
    "which what who whom whose where when why how all any some none both each every "
    "other another such same"
).split()

CONTEXT_TERMS = {
    "EMAIL": ["email", "mail", "contact", "reach", "電郵", "電子郵件"],
    "PHONE_NUMBER": ["phone", "tel", "mobile", "call", "fax", "聯絡", "電話", "手提",
                     "手機", "辦公", "國內"],
    "IP_ADDRESS": ["ip", "server", "address", "host", "伺服器"],
    "HKID": ["HKID", "身份證", "身份", "identity", "id card", "card no"],
    "MACAU_ID": ["macau", "澳門", "身份證", "bilhete", "id", "id no", "id number",
                 "證件號碼", "證件編號", "編號"],
    "PASSPORT": ["passport", "護照", "旅行證件", "travel"],
    "LICENSE_PLATE": ["plate", "車牌", "vehicle", "car", "license"],
    "CREDIT_CARD": ["card", "credit", "visa", "master", "amex", "jcb", "unionpay",
                    "銀聯", "信用卡", "卡號"],
    "ADDRESS": [
        "中環", "灣仔", "銅鑼灣", "上環", "金鐘", "北角", "鰂魚涌", "西環", "黃竹坑",
        "Central", "Wan Chai", "Causeway Bay", "Admiralty", "North Point",
        "尖沙咀", "旺角", "油麻地", "深水埗", "九龍城", "黃大仙", "觀塘", "土瓜灣",
        "Tsim Sha Tsui", "Mong Kok", "Kowloon",
        "沙田", "大埔", "荃灣", "葵涌", "青衣", "將軍澳", "屯門", "元朗", "天水圍",
        "澳門", "氹仔", "路環", "黑沙環", "新馬路", "高地", "Macau", "Taipa", "Cotai",
    ],
    "BANK_ACCOUNT": ["account", "bank", "銀行", "戶口", "帳號", "轉帳", "transfer",
                     "hsbc", "hang seng"],
    "BIRTHDAY": ["birth", "born", "dob", "生日", "出生", "birth date", "date of birth"],
}
CONTEXT_BOOST = 0.35
CONTEXT_FLOOR = 0.4
CONTEXT_TOKENS = 5
CARD_SCORE = 0.95
MODEL_SCORE = 0.85
DEFAULT_TTL_SECONDS = 3600

# rule id, entity, group, ignore case, score, pattern
_DIGIT_RULES = [
    ("D02", "PHONE_NUMBER", True, 0.95, r"(?:\+85[23])[\s-]?\d{4}[\s-]?\d{4}"),
    ("D03", "PHONE_NUMBER", True, 0.90, r"\+86[\s-]?1[3-9]\d{9}"),
    ("D04", "PHONE_NUMBER", True, 0.85, r"28\d{6}"),
    ("D05", "PHONE_NUMBER", True, 0.85, r"1[3-9]\d{9}"),
    ("D06", "PHONE_NUMBER", True, 0.40, r"6\d{3}[\s-]?\d{4}"),
    ("D07", "IP_ADDRESS", True, 0.90, rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"),
    ("D08", "HKID", True, 0.95, r"[A-Z]{1,2}\d{6}\([0-9A]\)"),
    ("D09", "MACAU_ID", True, 0.85, r"[157]\d{6}\(\d\)"),
    ("D10", "MACAU_ID", True, 0.85, r"1\d{7}"),
    ("D11", "MACAU_ID", True, 0.40, r"[57]\d{7}"),
    ("D12", "PASSPORT", True, 0.85, r"[HK]\d{8}"),
    ("D13", "LICENSE_PLATE", False, 0.70, r"[A-Z]{2}\s?\d{4}"),
    ("D14", "LICENSE_PLATE", False, 0.85, r"[A-Z]{2}-\d{2}-\d{2}"),
    ("D15", "CREDIT_CARD", True, 0.50, r"4(?:\d[ -]?){12,15}"),
    ("D16", "CREDIT_CARD", True, 0.50,
     r"(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)(?:\d[ -]?){12}"),
    ("D17", "CREDIT_CARD", True, 0.50, r"3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}"),
    ("D18", "CREDIT_CARD", True, 0.50, r"3(?:5[2-9]\d{2}|5[89]\d)(?:\d[ -]?){10,11}"),
    ("D19", "CREDIT_CARD", True, 0.50, r"62(?:\d[ -]?){14,17}"),
    ("D29", "BANK_ACCOUNT", True, 0.40, r"\d{9,12}"),
    ("D30a", "BIRTHDAY", True, 0.40, r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"),
    ("D30b", "BIRTHDAY", True, 0.40, r"\d{1,2}[-/]\d{1,2}[-/]\d{4}"),
]
# No right boundary on the two identity-card forms that end in a bracket.
_OPEN_ENDED = {"D08", "D09"}

# Surnames and Traditional -> Simplified pairs behind the opt-in name
# gazetteer.  A stand-in for a language model, not an equal of it.
COMPOUND_SURNAMES = "欧阳 司徒 司马 上官 诸葛 东方 皇甫 尉迟 公孙 令狐".split()
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董袁潘"
    "于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江"
    "尹薛阎段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤施"
)
TRADITIONAL = "張劉陳楊黃趙吳孫馬羅鄭謝許韓馮鄧蕭蔣葉蘇魏呂盧鐘鍾譚陸範賈韋鄒閻龍顧龔萬錢嚴湯賀歐陽東諸強偉華國軍麗傑賢鳳蘭禮義寶貴興榮銘鋒輝衛濤鵬"
SIMPLIFIED = "张刘陈杨黄赵吴孙马罗郑谢许韩冯邓萧蒋叶苏魏吕卢钟钟谭陆范贾韦邹阎龙顾龚万钱严汤贺欧阳东诸强伟华国军丽杰贤凤兰礼义宝贵兴荣铭锋辉卫涛鹏"
NAME_ENDS = "的 了 在 是 和 與 与 及 或 先生 女士 小姐 請 请 聯 联 絡 络 電 电 話 话 我 你 他 她 都 也 不 要".split()
# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One pattern.  ``family`` says which scan evaluates it."""

    rule_id: str
    entity_type: str
    family: str
    score: float
    pattern: str
    ignore_case: bool = False
    value_group: int = 0

    @property
    def inline(self) -> str:
        """The pattern with its flags, for ``java.util.regex``.

        Folding case costs most where it is tried most: in the boundaries, at
        every character.  There the letters that fold to ASCII (long s, Kelvin
        sign) are named instead, and the flags are off.
        """
        if not self.ignore_case:
            return f"(?U:{self.pattern})"
        folded = "[A-Za-z0-9\\u017f\\u212a]"
        body = self.pattern.replace(LEFT, f"(?-iU:(?<!{folded}))").replace(RIGHT, f"(?-iU:(?!{folded}))")
        return f"(?iU:{body})"


def _possessive_street_run(word: str, suffix: str) -> str:
    """``word (blank word)* blank suffix`` without a recursive group loop.

    The greedy form backs up to the last suffix in a run of words; on a run of
    thousands of words the Java matcher overflows its stack.  Here a word that
    opens with a suffix is consumed only while another suffix still follows, so
    the possessive loops stop on that same last suffix and never back up.
    """
    stop = rf"(?:{suffix}){RIGHT}"
    plain = rf"(?:\s++(?!{stop}){word})*+"
    passed = rf"\s++(?={stop}){word}(?={plain}\s++{stop})"
    return rf"{word}(?:{plain}{passed})*+{plain}\s++{stop}"


def _build() -> list[Rule]:
    rules = [
        Rule("D01", "EMAIL", "email", 0.95,
             rf"{LEFT}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{RIGHT}", True)
    ]
    for rule_id, entity, ignore_case, score, core in _DIGIT_RULES:
        right = "" if rule_id in _OPEN_ENDED else RIGHT
        rules.append(Rule(rule_id, entity, "digits", score, f"{LEFT}{core}{right}", ignore_case))

    zh = [
        ("D20", rf"{ZH_CHAR}{{2,10}}(?:{ZH_STREET})[\d]*號?"),
        ("D21", rf"{ZH_CHAR}{{2,10}}臺[\d]+號?"),
        ("D22", rf"{ZH_CHAR}{{2,10}}(?:{ZH_BUILDING})"),
        ("D23", rf"{ZH_CHAR}{{2,10}}(?:{ZH_MACAU})[\d]*號?"),
    ]
    rules += [Rule(i, "ADDRESS", "zh", 0.6, p) for i, p in zh]

    # The look-ahead on the first character is the quickest way past a non-match.
    street_run = _possessive_street_run(EN_WORD, EN_SUFFIX)
    rules += [
        Rule("D24", "ADDRESS", "en", 0.6, rf"(?=\d){LEFT}\d++\s++{street_run}"),
        Rule("D25", "ADDRESS", "en", 0.6, rf"(?=[A-ZÀ-Ý]){LEFT}{street_run}"),
    ]
    tail = rf"{PT_LETTER}+(?:\s++{PT_LETTER}++)*+"
    street = f"{PT_STREET}|{PT_STREET.upper()}"
    building = f"{PT_BUILDING}|{PT_BUILDING.upper()}"
    rules += [
        Rule("D26", "ADDRESS", "pt", 0.6,
             rf"(?=[A-Z]){LEFT}(?:{street})\.?\s+(?:(?:{PT_PREPOSITION})\s+)?{tail}"),
        Rule("D27", "ADDRESS", "pt", 0.6, rf"(?=[A-Z]){LEFT}(?:{building})\s+{tail}"),
    ]
    field = rf"(?:{NAME_FIELDS})(?:簽署)?\s*[：:]\s*"
    name = f"{NAME_ALL_CAPS}|{NAME_TITLE_CASE}|{NAME_CJK}"
    rules.append(Rule("D28", "PERSON", "form", 0.75, f"({field})({name})", value_group=2))
    return rules


RULES = _build()
RULE_BY_ID = {r.rule_id: r for r in RULES}


def rules_for(entities: list[str] | None = None, profile: str = "default") -> list[Rule]:
    """Rules behind the requested entity types; pruned when the plan is built."""
    allowed = list(ENTITY_ORDER)
    if profile == "extended":
        allowed += EXTENDED_ENTITIES
    elif profile != "default":
        raise ValueError(f"unknown profile {profile!r}")
    wanted = set(allowed if entities is None else entities)
    unknown = wanted - set(ENTITY_ORDER) - set(EXTENDED_ENTITIES)
    if unknown:
        raise ValueError(f"unknown entity types: {sorted(unknown)}")
    if entities is not None:
        allowed = [e for e in ENTITY_ORDER + EXTENDED_ENTITIES if e in wanted]
    return [r for r in RULES if r.entity_type in allowed]


def priority_of(entity_type: str) -> int:
    return (ENTITY_ORDER + EXTENDED_ENTITIES).index(entity_type)
