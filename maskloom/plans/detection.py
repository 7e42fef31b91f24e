"""Detection rules, span filters and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import checks
from maskloom.functions.rulebook import RULE_BY_ID
from maskloom.operators.detect import detect, score_milli, span_rows
from maskloom.operators.names import detect_with_gazetteer, detect_with_model, model_span_rows
from maskloom.plans.fixtures import (
    built_texts,
    RULE_CASES,
    digits,
    pick,
    rule_texts,
    rule_truth_sql,
    select_df,
    select_sql,
    table,
    text_of,
    texts,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_RULE_NAMES = {
    "D01": "email", "D02": "phone_hk_macau", "D03": "phone_mainland_code", "D04": "phone_landline",
    "D05": "phone_mainland", "D06": "phone_macau_mobile", "D07": "ip", "D08": "hkid",
    "D09": "macau_id_formal", "D10": "macau_id_bare_1", "D11": "macau_id_bare_57", "D12": "passport",
    "D13": "plate_hk", "D14": "plate_macau", "D15": "visa", "D16": "mastercard", "D17": "amex",
    "D18": "jcb", "D19": "unionpay", "D20": "address_zh_street", "D21": "address_zh_terrace",
    "D22": "address_zh_building", "D23": "address_macau", "D24": "address_en_numbered",
    "D25": "address_en_bare", "D26": "address_pt_street", "D27": "address_pt_building",
    "D28": "form_name", "D29": "bank_account", "D30a": "birthday_iso", "D30b": "birthday_dmy",
}


def _rule_query(rule_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entity = RULE_BY_ID[rule_id].entity_type
        built = rule_texts(spark, sf_dir, rule_id)
        found = detect(built, entities=[entity], context="none", resolve=False)
        rows = span_rows(found.select("doc_id", "spans"), ["doc_id"])
        return rows.filter(F.col("rule") == rule_id).select("doc_id", "start", "end", "value")

    return run


for _id, _name in _RULE_NAMES.items():
    _key = f"{_id.lower()}_{_name}"
    QUERIES[_key] = _rule_query(_id)
    ORACLES[_key] = rule_truth_sql(_id)


# --- rules over the given texts ----------------------------------------------

def _corpus_query(source: str, key: str, text: str, entity: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = texts(spark, sf_dir, source).select(F.col(key), F.col(text).alias("text"))
        found = detect(docs, entities=[entity], context="none", resolve=False)
        rows = span_rows(found.select(key, "spans"), [key])
        return rows.groupBy(key, F.expr("regexp_replace(value, '[ -]+$', '')").alias("value")).agg(
            F.count("*").alias("n"))

    return run


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL_RE = r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IP_RE = r"\b" + r"\.".join([_OCTET] * 4) + r"\b"


def _extract_sql(source: str, key: str, text: str, pattern: str, strip_underscore: bool = True) -> str:
    body = f"replace({text}, '_', ' ')" if strip_underscore else text
    return (
        f"SELECT {key}, value, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all({body}, "
        f"'{pattern}')) AS value FROM {source}) GROUP BY {key}, value"
    )


LUHN_SUM = (
    "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN "
    "(CASE WHEN cast(d[i] as int) > 4 THEN 2 * cast(d[i] as int) - 9 ELSE 2 * cast(d[i] as int) END) "
    "ELSE cast(d[i] as int) END))"
)
CARD_RES = [
    r"\b4(?:[0-9][ -]?){12,15}\b",
    r"\b(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)(?:[0-9][ -]?){12}\b",
    r"\b3[47][0-9]{2}[\s-]?[0-9]{6}[\s-]?[0-9]{5}\b",
    r"\b3(?:5[2-9][0-9]{2}|5[89][0-9])(?:[0-9][ -]?){10,11}\b",
    r"\b62(?:[0-9][ -]?){14,17}\b",
]


def _cards_sql(source: str, key: str, text: str) -> str:
    every = " UNION ALL ".join(
        f"SELECT {key}, unnest(regexp_extract_all(replace({text}, '_', ' '), '{p}')) AS raw FROM {source}"
        for p in CARD_RES)
    return (
        f"SELECT {key}, value, count(*) AS n FROM (SELECT {key}, regexp_replace(raw, '[ -]+$', '') AS value, "
        f"regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM ({every})) "
        f"WHERE {LUHN_SUM} % 10 = 0 GROUP BY {key}, value"
    )


for _source, _id_col, _text_col in (
    ("documents", "doc_id", "text"), ("pages", "page_id", "html"),
):
    for _entity, _sql in (
        ("EMAIL", _extract_sql(_source, _id_col, _text_col, EMAIL_RE, False)),
        ("IP_ADDRESS", _extract_sql(_source, _id_col, _text_col, IP_RE)),
        ("CREDIT_CARD", _cards_sql(_source, _id_col, _text_col)),
    ):
        _key = f"{_source}_{_entity.lower()}_values"
        QUERIES[_key] = _corpus_query(_source, _id_col, _text_col, _entity)
        ORACLES[_key] = _sql


def documents_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default rules over all documents, resolved, counted by type."""
    found = detect(texts(spark, sf_dir, "documents").select("doc_id", "text"), context="overlaps")
    return span_rows(found, ["doc_id"]).groupBy("entity_type").agg(
        F.count("*").alias("spans"), F.countDistinct("doc_id").alias("texts"))


QUERIES["d00_documents_entity_counts"] = documents_entity_counts

# --- validators ---------------------------------------------------------------

_LUHN_COLUMNS = {"o_orderkey": "o_orderkey", "d": f"'4' || {digits(15, 104729, 'o_orderkey')}"}


def v1_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = select_df(table(spark, sf_dir, "orders"), _LUHN_COLUMNS)
    return numbers.filter(F.expr(checks.luhn_ok("d"))).select("o_orderkey", F.col("d").alias("number"))


_DATE_COLUMNS = {"o_orderkey": "o_orderkey", "v": text_of("19000000 + (o_orderkey * 7919) % 2200000")}


def v2_date_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = select_df(table(spark, sf_dir, "orders"), _DATE_COLUMNS)
    return values.filter(F.expr(checks.date_like("v"))).select("o_orderkey", F.col("v").alias("value"))


QUERIES["v1_luhn"] = v1_luhn
ORACLES["v1_luhn"] = (
    f"SELECT o_orderkey, d AS number FROM ({select_sql(_LUHN_COLUMNS, 'orders')}) WHERE {LUHN_SUM} % 10 = 0"
)
QUERIES["v2_date_like"] = v2_date_like
ORACLES["v2_date_like"] = (
    f"SELECT o_orderkey, v AS value FROM ({select_sql(_DATE_COLUMNS, 'orders')}) "
    "WHERE cast(v[1:2] as int) IN (19, 20) AND cast(v[5:6] as int) BETWEEN 1 AND 12 "
    "AND cast(v[7:8] as int) BETWEEN 1 AND 31"
)

# Spans a language model might give: (value, language, filter that rejects it).
_MODEL_CASES = [
    ("John Smith", "en", None), ("陳大文", "en", "cjk"), ("Email", "en", "stop_word"),
    ("6611-1111", "en", "digits"), ("Edifício Teste", "en", "address"), ("João", "en", None),
    ("陳大文", "zh", None), ("張三(高級)", "zh", "punctuation"), ("for", "zh", "stop_word"),
    ("66111111", "zh", "digits"), ("Rua Nova", "zh", "address"), ("」", "en", "cjk"),
    ("Avelino", "en", None),
]
_MODEL_COLUMNS = {
    "doc_id": "c_custkey",
    "value": pick([c[0] for c in _MODEL_CASES], "c_custkey"),
    "lang": pick([c[1] for c in _MODEL_CASES], "c_custkey"),
    "rejected_by": pick([c[2] or "" for c in _MODEL_CASES], "c_custkey"),
    "name": "c_name",
}


def _model_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    built = select_df(built_texts(spark, sf_dir, "customer"), _MODEL_COLUMNS)
    docs = built.selectExpr("doc_id", "'Mr ' || value || ' called about ' || name AS text")
    spans = built.selectExpr("doc_id", "3 AS start", "3 + length(value) AS end", "lang")
    outside = built.selectExpr("doc_id", "500 AS start", "505 AS end", "lang")
    return docs, spans.unionByName(outside)


def v3_to_v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = _model_tables(spark, sf_dir)
    return model_span_rows(docs, spans, "doc_id").select("doc_id", "value", "lang", "rejected_by")


def _one_filter(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v3_to_v7(spark, sf_dir).filter(F.col("rejected_by") == name).select("doc_id", "value", "lang")

    return run


_MODEL_SQL = select_sql(_MODEL_COLUMNS, "customer")
for _key, _name in (("v3_cjk", "cjk"), ("v4_stop_word", "stop_word"), ("v5_digits_only", "digits"),
                    ("v6_address_prefix", "address"), ("v7_punctuation", "punctuation")):
    QUERIES[_key] = _one_filter(_name)
    ORACLES[_key] = f"SELECT doc_id, value, lang FROM ({_MODEL_SQL}) WHERE rejected_by = '{_name}'"


def d31_model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = _model_tables(spark, sf_dir)
    rows = span_rows(detect_with_model(docs, spans, "doc_id"), ["doc_id"])
    return rows.filter("entity_type = 'PERSON'").select("doc_id", "start", "end", "value", score_milli(F.col("score")))


def d31_names_by_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names with entities chosen and with a threshold; what a word before them boosts counts."""
    docs, spans = _model_tables(spark, sf_dir)
    phones = docs.selectExpr("doc_id", "text || '. tel 61234567, 61234568' AS text")

    def rows(case: str, **options) -> DataFrame:
        found = detect_with_model(phones, spans, "doc_id", **options)
        return span_rows(found, ["doc_id"]).groupBy("doc_id").agg(
            F.count_if(F.col("entity_type") == "PERSON").alias("names"),
            F.count_if(F.col("entity_type") == "PHONE_NUMBER").alias("phones")).withColumn("case", F.lit(case))

    return rows("no_names", entities=["PHONE_NUMBER"]).unionByName(rows("sure", entities=["PERSON", "PHONE_NUMBER"], threshold=0.7))


QUERIES["d31_names_by_option"] = d31_names_by_option
ORACLES["d31_names_by_option"] = (
    "SELECT doc_id, cast(0 as bigint) AS names, cast(2 + (value IN ('6611-1111', '66111111'))::int as bigint) AS phones, 'no_names' AS case "
    f"FROM ({_MODEL_SQL}) UNION ALL SELECT doc_id, cast((rejected_by = '')::int as bigint), 2, 'sure' FROM ({_MODEL_SQL})"
)
QUERIES["d31_model_names"] = d31_model_names
ORACLES["d31_model_names"] = (
    "SELECT doc_id, cast(3 as int) AS start, cast(3 + length(value) as int) AS \"end\", value, "
    f"cast(850 as int) AS score_milli FROM ({_MODEL_SQL}) WHERE rejected_by = ''"
)

_FORM_COLUMNS = {
    "doc_id": "c_custkey", "name": pick(["陳大文", "施例男", "黃志偉"], "c_custkey"), "has_model": "(c_custkey % 2 = 0)",
}


def v8_form_field_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form-field rule gives way to an overlapping Chinese model span."""
    built = select_df(built_texts(spark, sf_dir, "customer"), _FORM_COLUMNS)
    docs = built.selectExpr("doc_id", "'姓名：' || name || '。' AS text")
    spans = built.filter("has_model").selectExpr("doc_id", "3 AS start", "3 + length(name) AS end", "'zh' AS lang")
    rows = span_rows(detect_with_model(docs, spans, "doc_id"), ["doc_id"])
    return rows.select("doc_id", "rule", "value", score_milli(F.col("score")))


QUERIES["v8_form_field_yields"] = v8_form_field_yields
ORACLES["v8_form_field_yields"] = (
    "SELECT doc_id, CASE WHEN has_model THEN 'model_zh' ELSE 'D28' END AS rule, name AS value, "
    "cast(CASE WHEN has_model THEN 850 ELSE 750 END as int) AS score_milli "
    f"FROM ({select_sql(_FORM_COLUMNS, 'customer')})"
)

_BLANK_COLUMNS = {
    "doc_id": "c_custkey",
    "text": f"CASE c_custkey % 3 WHEN 0 THEN '   ' WHEN 1 THEN NULL ELSE 'tel 6' || {digits(7, 7919, 'c_custkey')} END",
}


def v9_blank_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = select_df(built_texts(spark, sf_dir, "customer"), _BLANK_COLUMNS)
    return detect(built).select("doc_id", F.size("spans").alias("n_spans"))


QUERIES["v9_blank_guard"] = v9_blank_guard
ORACLES["v9_blank_guard"] = (
    "SELECT doc_id, cast(CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE 1 END as int) AS n_spans "
    f"FROM ({select_sql(_BLANK_COLUMNS, 'customer')})"
)

_SURNAMES = ["陳", "黃", "張", "李", "王"]
_GIVEN = ["大文", "志偉", "強", "小明", "芳", "國強", "麗"]
_NAME_COLUMNS = {
    "doc_id": "c_custkey",
    "person": f"({pick(_SURNAMES, 'c_custkey')} || {pick(_GIVEN, 'c_custkey')})",
    "shape": "c_custkey % 4",
}
_NAME_TEXT = (
    "CASE shape WHEN 0 THEN '我是' || person || '，請聯絡我' WHEN 1 THEN '請聯絡' || person || '先生' "
    "WHEN 2 THEN person || '和同事都在' ELSE '今日天氣很好' END"
)


def d32_gazetteer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = select_df(built_texts(spark, sf_dir, "customer"), _NAME_COLUMNS)
    docs = built.selectExpr("doc_id", f"{_NAME_TEXT} AS text")
    rows = span_rows(detect_with_gazetteer(docs, entities=["PERSON"]), ["doc_id"])
    return rows.select("doc_id", "start", "value", score_milli(F.col("score")))


QUERIES["d32_gazetteer_names"] = d32_gazetteer_names
ORACLES["d32_gazetteer_names"] = (
    "SELECT doc_id, cast(CASE shape WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END as int) AS start, person AS value, "
    f"cast(600 as int) AS score_milli FROM ({select_sql(_NAME_COLUMNS, 'customer')}) WHERE shape < 3"
)

# --- scoring ------------------------------------------------------------------

_CONTEXT_COLUMNS = {
    "doc_id": "c_custkey", "gap": "cast(c_custkey % 9 as int)",
    "term": pick(["電話", "phone", "Call", "number"], "(c_custkey % 11)"),
    "value": f"'6' || {digits(7, 7919, 'c_custkey')}",
    "wide": "c_custkey % 4",
}
# Words and gaps may be longer than any window one might look through.
_CONTEXT_TEXT = (
    "term || repeat(CASE WHEN wide = 2 THEN ' ' || repeat('z', 700) ELSE ' zz' END, gap) || ' the ' || "
    "CASE WHEN wide = 1 THEN repeat(' ', 300) WHEN wide = 3 THEN repeat(' the', 1500) || ' ' ELSE '' END || value"
)


def _context_scores(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    built = select_df(built_texts(spark, sf_dir, "customer"), _CONTEXT_COLUMNS)
    docs = built.selectExpr("doc_id", f"{_CONTEXT_TEXT} AS text")
    rows = span_rows(detect(docs, entities=["PHONE_NUMBER"], threshold=threshold), ["doc_id"])
    return rows.select("doc_id", "value", score_milli(F.col("score")))


_CONTEXT_SQL = (
    "SELECT doc_id, value, cast(CASE WHEN term <> 'number' AND gap < 5 THEN 750 ELSE 400 END as int) AS score_milli "
    f"FROM ({select_sql(_CONTEXT_COLUMNS, 'customer')})"
)
QUERIES["c1_context"] = lambda spark, sf_dir: _context_scores(spark, sf_dir, 0.0)
ORACLES["c1_context"] = _CONTEXT_SQL
QUERIES["c2_threshold"] = lambda spark, sf_dir: _context_scores(spark, sf_dir, 0.5)
ORACLES["c2_threshold"] = f"SELECT * FROM ({_CONTEXT_SQL}) WHERE score_milli >= 500"
