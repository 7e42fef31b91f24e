"""Audit, quality and leak reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.rulebook import ENTITY_ORDER
from maskloom.operators import reports
from maskloom.operators.detect import detect, span_rows
from maskloom.operators.mask import mask_sessions
from maskloom.plans.fixtures import CALLS_CTE, OCCURRENCES_CTE, built_texts, call_table, digits, pick, select_df, select_sql
from maskloom.plans.sessions import _ALL_CTES, _MASKED, _calls, _keyed_calls
from maskloom.sources.corpus import CALL_KEY

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return detect(_calls(spark, sf_dir), **{"context": "overlaps", **options})


def a1_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audit(_found(spark, sf_dir))


def a1_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = span_rows(_found(spark, sf_dir), ["system_id"])
    return reports.audit_rollup(spans)


_ZERO = {"PHONE_NUMBER": "1", "EMAIL": "2", "IP_ADDRESS": "cast(has_ip as int)"}
_COUNTS = ", ".join(
    f"cast(sum(CASE WHEN has_pii THEN {_ZERO.get(t, '0')} ELSE 0 END) as bigint) AS n_{t.lower()}" for t in ENTITY_ORDER)
QUERIES |= {"a1_audit": a1_audit, "a1_rollup": a1_rollup}
ORACLES |= {
    "a1_audit": f"WITH {CALLS_CTE} SELECT system_id, session_id, count(*) AS calls, cast(sum(length(text)) as bigint) AS text_length, "
                f"{_COUNTS} FROM calls GROUP BY system_id, session_id",
    "a1_rollup": f"WITH {CALLS_CTE}, {OCCURRENCES_CTE} SELECT system_id, entity_type, count(*) AS n FROM occ GROUP BY ROLLUP (system_id, entity_type)",
}

# Labelled texts: some values are labelled that no rule finds (misses), some are
# found that no label names (false hits).
_LABELLED = {
    "case_id": "c_custkey", "shape": "c_custkey % 5",
    "phone": f"'6' || {digits(7, 7919, 'c_custkey')}", "odd_phone": f"'9' || {digits(7, 7919, 'c_custkey')}",
    "mail": "'u' || cast(c_custkey as string) || '@mail.example.com'",
    "plate": pick(["AB 1234", "MX-00-00"], "c_custkey"),
}
_LABELLED_TEXT = (
    "CASE shape WHEN 0 THEN 'tel ' || phone || ', again ' || phone WHEN 1 THEN 'tel ' || odd_phone || ', mail ' || mail "
    "WHEN 2 THEN 'plate ' || plate || ', mail ' || mail WHEN 3 THEN 'mail ' || mail ELSE 'nothing here' END"
)
# What a labeller wrote down: (shape, type, value).
_LABELS = [(0, "PHONE_NUMBER", "phone"), (1, "PHONE_NUMBER", "odd_phone"), (1, "EMAIL", "mail"),
           (2, "EMAIL", "mail"), (3, "EMAIL", "mail")]
# What the rules find.
_HITS = [(0, "PHONE_NUMBER", "phone"), (1, "EMAIL", "mail"), (2, "LICENSE_PLATE", "plate"),
         (2, "EMAIL", "mail"), (3, "EMAIL", "mail")]


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    built = select_df(built_texts(spark, sf_dir, "customer"), _LABELLED)
    wanted = None
    for shape, entity, column in _LABELS:
        part = built.filter(f"shape = {shape}").selectExpr("case_id", f"'{entity}' AS entity_type", f"{column} AS value")
        wanted = part if wanted is None else wanted.unionByName(part)
    labelled = built.selectExpr("case_id", f"{_LABELLED_TEXT} AS text")
    found = span_rows(detect(labelled, context="overlaps"), ["case_id"]).select("case_id", "entity_type", "value")
    return wanted, found


def _labelled_sql(rows: list[tuple[int, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT case_id, '{e}' AS entity_type, {c} AS value FROM built WHERE shape = {s}" for s, e, c in rows)


_BUILT_CTE = f"built AS ({select_sql(_LABELLED, 'customer')}), want AS ({_labelled_sql(_LABELS)}), got AS ({_labelled_sql(_HITS)})"
_JOINED = (
    "joined AS (SELECT coalesce(w.entity_type, g.entity_type) AS entity_type, coalesce(w.case_id, g.case_id) AS case_id, "
    "w.value AS wv, g.value AS gv FROM want w FULL JOIN got g ON w.case_id = g.case_id AND w.entity_type = g.entity_type AND w.value = g.value)"
)


def a2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, found = _labelled(spark, sf_dir)
    return reports.quality(wanted, found, ["case_id", "entity_type", "value"])


def a3_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, found = _labelled(spark, sf_dir)
    return reports.case_results(wanted, found, "case_id", ["entity_type", "value"])


QUERIES |= {"a2_quality": a2_quality, "a3_cases": a3_cases}
ORACLES |= {
    "a2_quality": f"WITH {_BUILT_CTE}, {_JOINED}, c AS (SELECT entity_type, count(*) FILTER (wv IS NOT NULL AND gv IS NOT NULL) AS tp, "
                  "count(*) FILTER (wv IS NULL) AS fp, count(*) FILTER (gv IS NULL) AS fn FROM joined GROUP BY entity_type) "
                  "SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, "
                  "CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM c",
    "a3_cases": f"WITH {_BUILT_CTE}, {_JOINED} SELECT case_id, bool_and(wv IS NOT NULL AND gv IS NOT NULL) AS passed FROM joined GROUP BY case_id",
}


def a4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values readable in masked texts, some of which were left in on purpose, and in the source texts."""
    calls = _calls(spark, sf_dir)
    done = mask_sessions(calls)
    left_in = call_table(spark, sf_dir).filter("has_pii AND kind = 'error'").select("call_seq", "phone")
    masked = done.texts.join(left_in, "call_seq", "left").withColumn(
        "masked_text", F.concat_ws("", "masked_text", F.concat(F.lit(" again:"), "phone")))
    known = reports.known_values(done.mapping)

    def counted(texts: DataFrame, name: str) -> DataFrame:
        return reports.leaks(texts, done.mapping, CALL_KEY, known).groupBy("system_id").agg(F.count("*").alias(name))

    source = counted(calls.withColumnRenamed("text", "masked_text"), "in_source")
    return source.join(counted(masked, "in_masked"), "system_id", "left").select(
        "system_id", "in_source", F.coalesce("in_masked", F.lit(0)).cast("long").alias("in_masked"))


def a4_glued_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks inside longer words: a value of the session with letters around it, one cut short, and a foreign one."""
    calls = _calls(spark, sf_dir)
    done = mask_sessions(calls)
    masked = done.texts.join(call_table(spark, sf_dir).select("call_seq", F.expr(_GLUED).alias("tail")), "call_seq").withColumn(
        "masked_text", F.concat("masked_text", "tail"))
    return reports.leaks(masked, done.mapping, CALL_KEY).groupBy("call_seq", "entity_type").agg(F.count("*").alias("n"))


_GLUED = (
    "CASE call_seq % 4 WHEN 0 THEN ' ref' || phone || 'x' WHEN 1 THEN 'z' || mail_b || '.net ' || ip "
    "WHEN 2 THEN ' ' || substring(phone, 1, 7) ELSE ' ' || reverse(phone) || mail_a END"
)


def a5_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = span_rows(_found(spark, sf_dir), ["system_id"])
    return reports.top_values(spans, 5).select("system_id", "entity_type", "value_hash", "n", "place")


def a6_rule_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = span_rows(_found(spark, sf_dir, context="none"), ["call_seq"])
    return reports.rule_profile(spans, {"all": 0.0, "kept": 0.5})


QUERIES |= {"a4_leaks": a4_leaks, "a4_glued_leaks": a4_glued_leaks, "a5_top_values": a5_top_values, "a6_rule_profile": a6_rule_profile}
_RULES_CTE = (
    f"WITH {CALLS_CTE}, {OCCURRENCES_CTE}, h AS (SELECT CASE entity_type WHEN 'PHONE_NUMBER' THEN 'D06' WHEN 'EMAIL' THEN 'D01' "
    "ELSE 'D07' END AS rule, count(*) AS hits FROM occ GROUP BY 1)"
)
ORACLES |= {
    "a4_leaks": f"WITH {CALLS_CTE}, {OCCURRENCES_CTE} SELECT system_id, count(*) AS in_source, "
                "(SELECT count(*) FROM calls c WHERE c.system_id = o.system_id AND has_pii AND kind = 'error') AS in_masked FROM "
                "(SELECT DISTINCT system_id, session_id, call_seq, entity_type, value FROM occ) o GROUP BY system_id",
    "a4_glued_leaks": f"{_ALL_CTES}, m AS ({_keyed_calls(f'system_id, session_id, call_seq, {_MASKED} || ({_GLUED}) AS t')}), "
                      "v AS (SELECT DISTINCT system_id, session_id, entity_type, value FROM occ) "
                      "SELECT call_seq, entity_type, count(*) AS n FROM m JOIN v USING (system_id, session_id) WHERE contains(t, value) GROUP BY ALL",
    "a5_top_values": f"WITH {CALLS_CTE}, {OCCURRENCES_CTE}, c AS (SELECT system_id, entity_type, sha256(value) AS value_hash, count(*) AS n "
                     "FROM occ GROUP BY ALL) SELECT system_id, entity_type, value_hash, n, cast(place as int) AS place FROM (SELECT *, row_number() OVER "
                     "(PARTITION BY system_id ORDER BY n DESC, entity_type, value_hash) AS place FROM c) WHERE place <= 5",
    "a6_rule_profile": f"{_RULES_CTE}, s AS (SELECT 'all' AS stage, * FROM h UNION ALL SELECT 'kept', * FROM h WHERE rule <> 'D06') "
                       "SELECT rule, hits, stage, round(hits / sum(hits) OVER (PARTITION BY stage), 4) AS share FROM s",
}
