"""The mapping table: load, merge, forget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.rulebook import DEFAULT_TTL_SECONDS
from maskloom.sources.corpus import SESSION

ENTRY_KEY = [*SESSION, "epoch", "placeholder_key"]


def load_mapping(mapping: DataFrame, at: str, ttl: int = DEFAULT_TTL_SECONDS,
                 system: str | None = None, session: str | None = None) -> DataFrame:
    """Entries still alive at ``at``; none when a session is unknown or expired.

    Filters on ``system_id`` prune the folders of a stored mapping.
    """
    moment = F.to_timestamp(F.lit(at))
    alive = mapping.filter(
        (F.col("first_ts") <= moment)
        & (F.unix_micros("saved_ts") + ttl * 1_000_000 > F.unix_micros(moment))
    )
    if system is not None:
        alive = alive.filter(F.col("system_id") == system)
    if session is not None:
        alive = alive.filter(F.col("session_id") == session)
    return alive


def merge_mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` merged into ``old``: same key overwritten, others kept.

    Saving refreshes the whole session, so every entry of a session gets the
    latest save time.  Write the result to a new folder, never over ``old``.
    """
    columns = old.columns
    both = old.select("*", F.lit(0).alias("turn")).unionByName(new.select(*columns, F.lit(1).alias("turn")))
    rest = [c for c in columns if c not in ENTRY_KEY]
    latest = (
        both.groupBy(*ENTRY_KEY)
        .agg(F.max_by(F.struct(*rest), F.struct("saved_ts", "turn")).alias("kept"))
        .select(*ENTRY_KEY, "kept.*")
    )
    saves = both.groupBy(*SESSION, "epoch").agg(F.max("saved_ts").alias("saved_ts"))
    return latest.drop("saved_ts").join(saves, [*SESSION, "epoch"]).select(*columns)


def forget_sessions(mapping: DataFrame, sessions: DataFrame) -> DataFrame:
    """The mapping without the given sessions.  Spark broadcasts a small list."""
    return mapping.join(sessions.select(*SESSION), SESSION, "left_anti")


def purge_expired(mapping: DataFrame, at: str, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """The mapping without what expired by ``at``."""
    cutoff = F.unix_micros(F.to_timestamp(F.lit(at))) - ttl * 1_000_000
    return mapping.filter(F.unix_micros("saved_ts") > cutoff)
