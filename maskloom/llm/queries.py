"""The registered queries of this package and the SQL that some of them must match."""

from __future__ import annotations

from maskloom.llm import (
    arc_convert,
    bpe,
    decontaminate,
    filter_audit,
    language_id,
    license_scan,
    line_frequency,
    minmax_dedup,
    substring_dedup,
    tag_paths,
    token_rollup,
    url_rules,
    vector_codes,
)
from maskloom.llm.common import table


def _over(run, name):
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


QUERIES = {
    "op1_line_frequency": _over(line_frequency.query, "documents"),
    "op2_decontaminate": lambda spark, sf_dir: decontaminate.query(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op3_minmax_dedup": _over(minmax_dedup.query, "documents"),
    "op4_token_rollup": lambda spark, sf_dir: token_rollup.query(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_tag_paths": _over(tag_paths.query, "pages"),
    "op6_language_id": _over(language_id.query, "documents"),
    "op7_url_rules": _over(url_rules.query, "pages"),
    "op8_arc_convert": _over(arc_convert.query, "pages"),
    "op9_substring_dedup": _over(substring_dedup.query, "documents"),
    "op10_bpe": _over(bpe.query, "documents"),
    "op11_license_scan": _over(license_scan.query, "documents"),
    "op12_filter_audit": lambda spark, sf_dir: filter_audit.query(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_vector_codes": _over(vector_codes.query, "embeddings"),
}

ORACLES: dict[str, str] = {
    "op1_line_frequency": line_frequency.ORACLE,
    "op4_token_rollup": token_rollup.ORACLE,
    "op7_url_rules": url_rules.ORACLE,
    "op8_arc_convert": arc_convert.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
