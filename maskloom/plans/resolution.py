"""Overlap resolution on hand-shaped spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import resolve
from maskloom.functions.text import per_island, span
from maskloom.operators.detect import score_milli, span_rows
from maskloom.plans.fixtures import SPAN_TEXT, built_texts, shaped_spans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ", ".join(
        span(s["start"], s["end"], s["entity_type"], f"{s['score_milli']} / 1000D", s["rule"], "NULL")
        for s in shaped_spans())
    keyed = built_texts(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{SPAN_TEXT} AS text")
    valued = keyed.selectExpr("k AS doc_id", "text", f"array({items}) AS spans")
    filled = "transform(spans, s -> " + span(
        "s.start", "s.end", "s.entity_type", "s.score", "s.rule", "substring(text, s.start + 1, s.end - s.start)") + ")"
    return valued.withColumn("spans", F.expr(filled))


def _step(sql: str, *, value: bool = False, rule: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = _shaped(spark, sf_dir).select("doc_id", F.expr(sql).alias("spans"))
        columns = ["doc_id", "start", "end", "entity_type", score_milli(F.col("score"))]
        return span_rows(done, ["doc_id"]).select(
            *columns, *(["value"] if value else []), *(["rule"] if rule else []))

    return run


_SOURCE = " UNION ALL ".join(
    f"SELECT k AS doc_id, {s['start']} AS s, {s['end']} AS e, {s['entity_type']} AS t, "
    f"{s['score_milli']} AS sc, {s['rule']} AS r FROM (SELECT c_custkey AS k FROM customer)"
    for s in shaped_spans())
_BASE = f"WITH base AS ({_SOURCE})"
_OUT = 'doc_id, s AS start, e AS "end", t AS entity_type, sc AS score_milli'
_PRIORITY = "list_position(['PHONE_NUMBER', 'EMAIL', 'MACAU_ID'], {x}.t)"


def _r1(source: str) -> str:
    return (
        f"SELECT * FROM {source} x WHERE NOT EXISTS (SELECT 1 FROM {source} y WHERE y.doc_id = x.doc_id "
        "AND y.t = x.t AND y.s <= x.s AND y.e >= x.e AND (y.sc > x.sc OR (y.sc = x.sc AND "
        "(y.s < x.s OR y.e > x.e OR y.r < x.r))))"
    )


def _r2(source: str) -> str:
    """Gaps and islands per type: strict overlap joins, touching does not."""
    return (
        "SELECT doc_id, cast(min(s) as int) AS s, cast(max(e) as int) AS e, t, cast(max(sc) as int) AS sc, "
        "'' AS r FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY s, e, r) AS isle FROM ("
        "SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id, t ORDER BY s, e, r ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY doc_id, t, isle"
    )


def _r3(source: str) -> str:
    return (
        f"SELECT * FROM {source} x WHERE NOT EXISTS (SELECT 1 FROM {source} y WHERE y.doc_id = x.doc_id AND "
        f"((y.s = x.s AND y.e = x.e AND (y.sc > x.sc OR (y.sc = x.sc AND {_PRIORITY.format(x='y')} < "
        f"{_PRIORITY.format(x='x')}))) OR (y.s <= x.s AND y.e >= x.e AND (y.s < x.s OR y.e > x.e))))"
    )


_TEXT_SQL = f"(SELECT {SPAN_TEXT} AS text)"
_ORDERED = "(PARTITION BY doc_id ORDER BY s, e, t, sc, r)"


def _r6(source: str) -> str:
    """Islands of neighbours of one type with only spaces between."""
    gap = "substring(text, before_e + 1, s - before_e)"
    return (
        "SELECT doc_id, cast(min(s) as int) AS s, cast(max_by(e, n) as int) AS e, any_value(t) AS t, "
        "cast(max_by(sc, n) as int) AS sc, '' AS r FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) "
        f"AS isle FROM (SELECT *, CASE WHEN before_t = t AND s > before_e AND regexp_full_match({gap}, ' +') "
        "THEN 0 ELSE 1 END AS fresh FROM (SELECT *, lag(e) OVER w AS before_e, lag(t) OVER w AS before_t, "
        f"row_number() OVER w AS n FROM {source}, {_TEXT_SQL} WINDOW w AS {_ORDERED}))) GROUP BY doc_id, isle"
    )


def _r5(source: str) -> str:
    return (
        "SELECT doc_id, s, cast(least(e, coalesce(lead(s) OVER w, e)) as int) AS e, t, sc, r "
        f"FROM {source} WINDOW w AS {_ORDERED}"
    )


QUERIES["r1_same_type_dedupe"] = _step(per_island("spans", resolve.without_contained), rule=True)
ORACLES["r1_same_type_dedupe"] = f"{_BASE} SELECT {_OUT}, r AS rule FROM ({_r1('base')})"
QUERIES["r2_same_type_merge"] = _step(per_island("spans", lambda r: resolve.merged_same_type("text", r)), value=True)
ORACLES["r2_same_type_merge"] = (
    f"{_BASE} SELECT {_OUT}, substring(text, s + 1, e - s) AS value FROM ({_r2('base')}), {_TEXT_SQL}"
)
QUERIES["r3_r4_cross_type_conflict"] = _step(per_island("spans", resolve.without_conflicts), rule=True)
ORACLES["r3_r4_cross_type_conflict"] = f"{_BASE} SELECT {_OUT}, r AS rule FROM ({_r3('base')})"

_UPTO_R3 = f"{_BASE}, a AS ({_r1('base')}), b AS ({_r2('a')}), c AS ({_r3('b')})"
_r1_r2 = per_island(per_island("spans", resolve.without_contained), lambda r: resolve.merged_same_type("text", r))
_chain = per_island(_r1_r2, resolve.without_conflicts)
QUERIES["r5_partial_overlap_clip"] = _step(per_island(_chain, lambda r: resolve.clipped("text", r)), value=True)
ORACLES["r5_partial_overlap_clip"] = (
    f"{_UPTO_R3}, d AS ({_r5('c')}) SELECT {_OUT}, substring(text, s + 1, e - s) AS value FROM d, {_TEXT_SQL}"
)
QUERIES["r6_blank_merge"] = _step(resolve.merged_across_blanks("text", _chain), value=True)
ORACLES["r6_blank_merge"] = (
    f"{_UPTO_R3}, d AS ({_r6('c')}) SELECT {_OUT}, substring(text, s + 1, e - s) AS value FROM d, {_TEXT_SQL}"
)
QUERIES["r0_full_resolution"] = _step(resolve.resolved("text", "spans"), value=True)
ORACLES["r0_full_resolution"] = (
    f"{_UPTO_R3}, d AS ({_r6('c')}), f AS ({_r5('d')}) "
    f"SELECT {_OUT}, substring(text, s + 1, e - s) AS value FROM f, {_TEXT_SQL}"
)
