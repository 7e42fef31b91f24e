"""Who may call: key lists, lookup, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_tenants(settings: DataFrame, raw_col: str, keys: list[str] | None = None) -> DataFrame:
    """``system:key,system:key`` lists as ``(api_key, system_id)``.

    Blank items and items without a colon are skipped, the first colon splits,
    and a key given twice keeps the later system.  ``keys`` separates settings.
    """
    keys = keys or []
    items = settings.select(*keys, F.posexplode(F.split(raw_col, ",")).alias("pos", "item"))
    pairs = items.filter(F.contains("item", F.lit(":"))).select(
        *keys, "pos",
        _strip(F.substring_index("item", ":", 1)).alias("system_id"),
        _strip(F.regexp_replace("item", "^[^:]*:", "")).alias("api_key"),
    )
    return pairs.groupBy(*keys, "api_key").agg(F.max_by("system_id", "pos").alias("system_id"))


def resolve_callers(calls: DataFrame, tenants: DataFrame, key_col: str = "api_key") -> DataFrame:
    """Add ``system_id`` and ``status``: accepted, missing or invalid."""
    known = tenants.select(F.col("api_key").alias(key_col), F.col("system_id"))
    joined = calls.join(known, key_col, "left")
    no_key = F.col(key_col).isNull() | (F.col(key_col) == "")
    no_system = F.col("system_id").isNull() | (F.col("system_id") == "")
    return joined.withColumn(
        "status", F.when(no_key, "missing").when(no_system, "invalid").otherwise("accepted"))


def split_rejects(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted calls, and rejected ones for quarantine."""
    accepted = F.col("status") == "accepted"
    return resolved.filter(accepted), resolved.filter(~accepted)
