"""Texts with known content, derived from the given tables.

Every expression is plain SQL that Spark and DuckDB read alike, so the expected
answer comes from the columns a text was built from, not from a second detector.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from maskloom.session import spread

#: Rows of a table from which texts are made, in one task at most.
ROWS_PER_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table about to be searched for personal data."""
    return spread(table(spark, sf_dir, name))


def built_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows from which texts are made that are then searched."""
    return spread(table(spark, sf_dir, name), ROWS_PER_TASK)


def select_sql(columns: Mapping[str, str], source: str, where: str | None = None) -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"SELECT {body} FROM {source}" + (f" WHERE {where}" if where else "")


def select_df(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def text_of(number: str) -> str:
    return f"cast({number} as string)"


def digits(width: int, step: int = 7919, of: str = "k") -> str:
    """``width`` digits that vary with ``k``."""
    return f"lpad({text_of(f'({of} * {step} + {step}) % {10 ** width}')}, {width}, '0')"


def pick(options: list[str], by: str = "k") -> str:
    """One of several literals, by turns."""
    cases = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"(CASE ({by}) % {len(options)} {cases} END)"


# --- one fixture per detection rule, over the whole customer table -----------


@dataclass(frozen=True)
class RuleCase:
    """How texts for one rule are built; three in four hold a value it must find."""

    good: str
    bad: str
    before: tuple[str, ...] = ("no. ", "編號，", "x: ")
    after: tuple[str, ...] = ("", "。", ", end", ";5")

    def columns(self) -> dict[str, str]:
        """Columns over ``(k)``; ``wanted`` says whether the value must be found."""
        return {
            "doc_id": "k",
            "wanted": "(k % 4 <> 3)",
            "prefix": pick(list(self.before), "k"),
            "value": f"(CASE WHEN k % 4 <> 3 THEN {self.good} ELSE {self.bad} END)",
            "suffix": pick(list(self.after), "(k // 4)"),
        }


_SEP = pick(["", " ", "-"], "(k // 3)")


def _letter(step: int = 1, lower: bool = False) -> str:
    return f"chr(cast({97 if lower else 65} + (k * {step}) % 26 as int))"


def _digit(at: int) -> str:
    return f"cast(substring({digits(4)}, {at}, 1) as int)"


def _doubled(d: str) -> str:
    return f"(2 * {d} - (CASE WHEN {d} > 4 THEN 9 ELSE 0 END))"


def _card(lead: str, zeros: int, lead_sum: int, shift: int = 0) -> str:
    """A card number ending in four digits of ``k`` and a (shifted) check digit."""
    total = f"({lead_sum} + {_digit(1)} + {_doubled(_digit(2))} + {_digit(3)} + {_doubled(_digit(4))})"
    check = f"((10 - {total} % 10) % 10 + {shift}) % 10"
    return f"('{lead}{'0' * zeros}' || {digits(4)} || {text_of(check)})"


def _grouped(card: str) -> str:
    """A sixteen-digit card in one of the three usual spellings."""
    parts = [f"substring({card}, {i}, 4)" for i in (1, 5, 9, 13)]
    sep = pick(["", "-", " "], "(k // 3)")
    return "(" + f" || {sep} || ".join(parts) + ")"


_PLACE = pick(["北角", "新城", "黑沙環", "荷蘭園"], "(k // 5)")
_NUMBER = text_of("1 + k % 300")
_WORDS = pick(["Des Voeux", "Nathan", "MAIN", "Queen Mary"], "(k // 5)")
_SUFFIX = pick(["Rd", "ST", "Ave", "DRIVE", "Plaza"], "(k // 7)")
_PT_WORD = pick(["Exemplo", "Teste Grande", "São Paulo"], "(k // 5)")

RULE_CASES: dict[str, RuleCase] = {
    "D01": RuleCase(
        f"('user' || {text_of('k')} || {pick(['.a', '_b', '+c', ''], '(k // 5)')} || '@mail' || {text_of('k % 9')} || '.example.com')",
        f"('user' || {text_of('k')} || '@localhost')", before=("mail ", "電郵是", "to:"), after=("", "已收到", ", end", "。")),
    "D02": RuleCase(f"('+85' || {text_of('2 + k % 2')} || {_SEP} || {digits(4)} || {_SEP} || {digits(4, 104729)})",
                    f"('+854 ' || {digits(8)})"),
    "D03": RuleCase(f"('+86' || {_SEP} || '1' || {text_of('3 + k % 7')} || {digits(9)})",
                    f"('+86 12' || {digits(9)})"),
    "D04": RuleCase(f"('28' || {digits(6)})", f"('29' || {digits(6)})"),
    "D05": RuleCase(f"('1' || {text_of('3 + k % 7')} || {digits(9)})", f"('12' || {digits(9)})"),
    "D06": RuleCase(f"('6' || {digits(3)} || {_SEP} || {digits(4, 104729)})", f"('9' || {digits(7)})"),
    "D07": RuleCase(
        f"({text_of('k % 256')} || '.' || {text_of('(k * 7) % 256')} || '.' || {text_of('(k * 13) % 256')} || '.' || {text_of('(k * 29) % 256')})",
        f"({pick(['300.1.2.', '1.2.', '1.2.3.4'], '(k // 4)')} || {text_of('300 + k % 600')})", after=("", "。", " end", ";")),
    "D08": RuleCase(
        f"((CASE WHEN k % 2 = 0 THEN {_letter()} ELSE {_letter(3, True)} || {_letter(5)} END) || {digits(6)} || '(' || {pick(['7', 'A', '0'], '(k // 3)')} || ')')",
        f"({_letter()} || {digits(5)} || '(7)')", after=("", "。", "end", "8")),
    "D09": RuleCase(f"({pick(['1', '5', '7'], '(k // 3)')} || {digits(6)} || '(' || {text_of('k % 10')} || ')')",
                    f"('8' || {digits(6)} || '(3)')", after=("", "。", "end", "8")),
    "D10": RuleCase(f"('1' || {digits(7)})", f"('2' || {digits(7)})"),
    "D11": RuleCase(f"({pick(['5', '7'], '(k // 3)')} || {digits(7)})", f"('3' || {digits(7)})"),
    "D12": RuleCase(f"({pick(['H', 'K', 'h'], '(k // 3)')} || {digits(8)})", f"('J' || {digits(8)})"),
    "D13": RuleCase(f"({_letter()} || {_letter(3)} || {pick(['', ' '], '(k // 3)')} || {digits(4)})",
                    f"({_letter(1, True)} || {_letter(3, True)} || ' ' || {digits(4)})"),
    "D14": RuleCase(f"({_letter()} || {_letter(3)} || '-' || {digits(2)} || '-' || {digits(2, 104729)})",
                    f"({_letter(1, True)} || {_letter(3, True)} || '-00-' || {digits(2)})"),
    "D15": RuleCase(_grouped(_card("4", 10, 8)), _grouped(_card("4", 10, 8, 1))),
    "D16": RuleCase(_card("55", 9, 6), _card("55", 9, 6, 1)),
    "D17": RuleCase(_card("37", 8, 8), _card("37", 8, 8, 1)),
    "D18": RuleCase(_card("3566", 7, 20), _card("3566", 7, 20, 1)),
    "D19": RuleCase(_card("62", 9, 5), _card("62", 9, 5, 1)),
    "D20": RuleCase(f"({_PLACE} || {pick(['道', '街', '大道', '巷'], '(k // 3)')} || {_NUMBER} || '號')", f"({_PLACE} || '塔' || {_NUMBER})",
                    before=("住在，", "at ", "「"), after=("", "。", ", end", " ok")),
    "D21": RuleCase(f"({_PLACE} || '臺' || {_NUMBER} || {pick(['號', ''], '(k // 3)')})", f"({_PLACE} || '平臺')",
                    before=("住在，", "at ", "「"), after=("", "。", ", end", " ok")),
    "D22": RuleCase(f"({_PLACE} || {pick(['大廈', '中心', '花園', '邨'], '(k // 3)')})", f"({_PLACE} || '塔')",
                    before=("住在，", "at ", "「"), after=("", "。", ", end", " ok")),
    "D23": RuleCase(f"({_PLACE} || {pick(['馬路', '石級', '斜路'], '(k // 3)')} || {_NUMBER})", f"({_PLACE} || '橋' || {_NUMBER})",
                    before=("住在，", "at ", "「"), after=("", "。", ", end", " ok")),
    "D24": RuleCase(f"({_NUMBER} || ' ' || {_WORDS} || ' ' || {_SUFFIX})", f"({_NUMBER} || ' ' || {_WORDS} || ' rd')",
                    before=("at ", "在", "("), after=("", "。", ", end", " ok")),
    "D25": RuleCase(f"({_WORDS} || ' ' || {_SUFFIX})", f"('The ave of ' || {_WORDS})",
                    before=("at ", "在", "("), after=("", "。", ", end", " ok")),
    "D26": RuleCase(f"({pick(['Rua de', 'AVENIDA DA', 'Av. do', 'Praça'], '(k // 3)')} || ' ' || {_PT_WORD})", f"('rua ' || lower({_PT_WORD}))",
                    before=("at ", "住在", "("), after=("", "。", ", end", "; 5")),
    "D27": RuleCase(f"({pick(['Edifício', 'CENTRO COMERCIAL', 'Torre', 'Jardins'], '(k // 3)')} || ' ' || {_PT_WORD})", f"('torre ' || lower({_PT_WORD}))",
                    before=("at ", "住在", "("), after=("", "。", ", end", "; 5")),
    "D28": RuleCase(pick(["陳大文", "ALVES TESTE", "João da Silva Teste", "施例男", "TESTE SILVA"], "(k // 3)"),
                    pick(["12345678", "x"], "(k // 3)"),
                    before=("姓名：", "申請人簽署: ", "本人的子女：", "聯絡人 ： "), after=("", "。", ", end", "；5")),
    "D29": RuleCase(f"('9' || {digits(8)} || substring('123', 1, cast(k % 4 as int)))", f"('9' || {digits(7)})"),
    "D30a": RuleCase(f"({text_of('1950 + k % 70')} || {pick(['-', '/'], '(k // 3)')} || {text_of('1 + k % 12')} || '-' || {text_of('1 + k % 28')})",
                     f"({text_of('1950 + k % 70')} || '.1.' || {text_of('1 + k % 28')})"),
    "D30b": RuleCase(f"({text_of('1 + k % 28')} || {pick(['-', '/'], '(k // 3)')} || {text_of('1 + k % 12')} || '/' || {text_of('1950 + k % 70')})",
                     f"({text_of('1 + k % 28')} || '.1.' || {text_of('1950 + k % 70')})"),
}


def _spark_sql(expr: str) -> str:
    """The one spelling that differs: integer division."""
    return expr.replace("//", "DIV")


def rule_texts(spark: SparkSession, sf_dir: str, rule_id: str) -> DataFrame:
    keyed = built_texts(spark, sf_dir, "customer").selectExpr("c_custkey AS k")
    columns = {n: _spark_sql(e) for n, e in RULE_CASES[rule_id].columns().items()}
    built = select_df(keyed, columns)
    return built.selectExpr("doc_id", "prefix || value || suffix AS text", "wanted", "value", "length(prefix) AS at")


def rule_truth_sql(rule_id: str) -> str:
    built = select_sql(RULE_CASES[rule_id].columns(), "(SELECT c_custkey AS k FROM customer)")
    return (
        "SELECT doc_id, cast(length(prefix) as int) AS start, "
        "cast(length(prefix) + length(value) as int) AS \"end\", value "
        f"FROM ({built}) WHERE wanted"
    )


# --- calls, over the whole events table --------------------------------------

CALL_COLUMNS = {
    "system_id": f"'sys_' || {text_of('user_id % 3')}",
    "session_id": f"'u' || {text_of('user_id')}",
    "call_seq": "event_id",
    "ts": "ts",
    "has_pii": "(event_id % 5 <> 0)",
    "kind": "event_type",
    "phone": f"'6' || {digits(7, 7919, '(user_id + (event_id % 3) * 131)')}",
    "mail_a": f"'user' || {text_of('event_id % 7')} || '@mail' || {text_of('user_id % 5')} || '.example.com'",
    "mail_b": f"'desk' || {text_of('event_id % 4')} || '@corp.example.org'",
    "ip": f"'10.' || {text_of('user_id % 200')} || '.' || {text_of('event_id % 6')} || '.7'",
    "has_ip": "(event_id % 4 = 0)",
}


def _say(phone: str, mail_a: str, mail_b: str, ip: str) -> str:
    """The text of a call, given what stands for its four values."""
    return (
        f"CASE WHEN has_pii THEN 'Case ' || kind || ': tel ' || {phone} || ', write ' || {mail_a} || "
        f"' or ' || {mail_b} || CASE WHEN has_ip THEN ', host ' || {ip} ELSE '' END || '.' "
        "ELSE 'nothing to hide in ' || kind END"
    )


CALL_TEXT = _say("phone", "mail_a", "mail_b", "ip")
CALLS_CTE = (
    f"calls AS (SELECT *, {CALL_TEXT} AS text FROM ({select_sql(CALL_COLUMNS, 'events')}))"
)
# Every value of every call, in text order.
OCCURRENCES_CTE = (
    "occ AS ("
    "SELECT system_id, session_id, call_seq, ts, 'PHONE_NUMBER' AS entity_type, phone AS value, 1 AS pos FROM calls WHERE has_pii "
    "UNION ALL SELECT system_id, session_id, call_seq, ts, 'EMAIL', mail_a, 2 FROM calls WHERE has_pii "
    "UNION ALL SELECT system_id, session_id, call_seq, ts, 'EMAIL', mail_b, 3 FROM calls WHERE has_pii "
    "UNION ALL SELECT system_id, session_id, call_seq, ts, 'IP_ADDRESS', ip, 4 FROM calls WHERE has_pii AND has_ip)"
)


def call_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``calls`` with the columns they were built from."""
    base = select_df(built_texts(spark, sf_dir, "events"), CALL_COLUMNS)
    return base.selectExpr("*", f"{CALL_TEXT} AS text")


def masked_text_sql(keys: dict[str, str]) -> str:
    """A call's text with placeholder columns in place of its values."""
    return _say(*[keys[n] for n in ("phone", "mail_a", "mail_b", "ip")])


# --- hand-shaped spans, over the whole customer table ------------------------

_SHAPES = [(7, 5, 3), (11, 3, 8), (13, 7, 6), (17, 11, 4), (19, 2, 9), (23, 13, 5)]
SPAN_TEXT = "repeat('ab  c d ', 10)"
SPAN_TYPES = ["PHONE_NUMBER", "MACAU_ID", "EMAIL"]


def shaped_spans() -> list[dict[str, str]]:
    """Six spans per text that come out equal, nested, partial or apart."""
    out = []
    for i, (a, b, c) in enumerate(_SHAPES):
        start = f"((k * {a} + {i}) % 40)"
        end = f"({start} + 2 + (k * {b}) % {c})"
        out.append({
            "start": f"cast({start} as int)", "end": f"cast({end} as int)",
            "entity_type": pick(SPAN_TYPES, f"(k + {i * i})"),
            "score_milli": f"cast(400 + 100 * ((k + {a}) % 4) as int)",
            "rule": f"'S{i}'",
        })
    return out
