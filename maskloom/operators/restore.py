"""Restoring: placeholders give way to the values they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.numbering import placeholders_in, restored
from maskloom.functions.rulebook import DEFAULT_TTL_SECONDS
from maskloom.operators.sessions import bucket_of, with_live_epoch
from maskloom.sources.corpus import SESSION

_MAP = "map<string,string>"


def placeholder_rows(replies: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per distinct placeholder of a reply, as ``placeholder_key``."""
    return replies.select(*keys, F.explode(F.expr(placeholders_in(f"`{text_col}`"))).alias("placeholder_key"))


def restore_own(df: DataFrame, text_col: str = "masked_text", mapping_col: str = "mapping",
                out: str = "restored_text") -> DataFrame:
    """Restore a text from the mapping on its own row."""
    return df.withColumn(out, F.expr(restored(f"`{text_col}`", f"`{mapping_col}`")))


def _fill(replies: DataFrame, answers: DataFrame, reply_key: list[str], text_col: str, out: str) -> DataFrame:
    """Put answers ``(reply_key, epoch, placeholder_key, value)`` into the replies.

    Replies without a placeholder skip the join, so their text is not shuffled.
    A reply gathers only its own few placeholders, never a session's mapping.
    """
    one = answers.groupBy(*reply_key, "placeholder_key").agg(F.max_by("value", F.struct("epoch", "value")).alias("value"))
    per_reply = one.groupBy(*reply_key).agg(
        F.map_from_entries(F.collect_list(F.struct("placeholder_key", "value"))).alias("__map"))
    holds = F.contains(F.col(text_col), F.lit("{{"))
    filled = restore_own(replies.filter(holds).join(per_reply, reply_key, "left"), text_col, "__map", out)
    plain = replies.filter(~F.coalesce(holds, F.lit(False))).withColumn(out, F.col(text_col))
    return filled.drop("__map").unionByName(plain)


def _answers(replies: DataFrame, mapping: DataFrame, keys: list[str], text_col: str, ts: str | None, ttl: int) -> DataFrame:
    """Values of the placeholders that replies hold, from the epoch of their session that is alive.

    With a time, that is the epoch that had begun by then and was last saved less than
    the TTL before, or is saved again later; epochs of a session lie at least the TTL
    apart, so there is one at most.  Without a time it is the session's newest epoch.  A
    reply finds its epoch before its placeholders are unfolded, and a placeholder then meets one entry.
    """
    asked = replies.select(*keys, F.expr(placeholders_in(f"`{text_col}`")).alias("__asked")).where(F.size("__asked") > 0)
    placed = with_live_epoch(asked, mapping, ts, ttl).select(*keys, "epoch", F.explode("__asked").alias("placeholder_key"))
    known = mapping.select(*SESSION, "epoch", "placeholder_key", "value", "first_ts", "saved_ts")
    met = placed.join(known, [*SESSION, "epoch", "placeholder_key"])
    if ts is None:
        return met
    fresh = F.unix_micros("saved_ts") + ttl * 1_000_000 > F.unix_micros(ts)
    return met.filter(F.coalesce(F.col("first_ts") <= F.col(ts), F.lit(True)) & F.coalesce(fresh, F.lit(True)))


def _timed(replies: DataFrame, ts_col: str) -> str | None:
    return ts_col if ts_col in replies.columns else None


def restore_sessions(replies: DataFrame, mapping: DataFrame, reply_key: list[str],
                     text_col: str = "text", out: str = "restored_text",
                     ttl: int = DEFAULT_TTL_SECONDS, ts_col: str = "ts") -> DataFrame:
    """Restore each reply from its session's stored mapping, as it stood at the reply's time.

    ``mapping`` may hold any number of epochs per session; expired ones do not
    count.  Replies without a ``ts_col`` take each session's newest epoch.  Unknown
    placeholders, and replies of unknown or other systems' sessions, stay as
    they are.
    """
    ts = _timed(replies, ts_col)
    keys = [*SESSION, *_extra(reply_key), *([ts] if ts and ts not in reply_key else [])]
    return _fill(replies, _answers(replies, mapping, keys, text_col, ts, ttl), reply_key, text_col, out)


def _extra(reply_key: list[str]) -> list[str]:
    return [c for c in reply_key if c not in SESSION]


def live_epoch(replies: DataFrame, ticks: DataFrame, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Add the epoch whose mapping is alive at a reply's ``ts`` (NULL if none).

    The last call before a reply lies in the reply's own TTL bucket or the one
    before; anything earlier has expired.  So the as-of search is two equi joins
    on (session, bucket), never a range join.
    """
    keyed = replies.withColumn("bucket", bucket_of("ts", ttl))
    own = ticks.select(*SESSION, "bucket", F.col("first_ts").alias("own_first"), F.col("epoch").alias("own_epoch"))
    before = ticks.select(
        *SESSION, (F.col("bucket") + 1).alias("bucket"),
        F.col("last_ts").alias("before_last"), F.col("epoch").alias("before_epoch"))
    joined = keyed.join(own, [*SESSION, "bucket"], "left").join(before, [*SESSION, "bucket"], "left")
    fresh = F.unix_micros("before_last") + ttl * 1_000_000 > F.unix_micros("ts")
    epoch = F.when(F.col("own_first") <= F.col("ts"), F.col("own_epoch")).when(fresh, F.col("before_epoch"))
    return joined.withColumn("epoch", epoch).drop(
        "bucket", "own_first", "own_epoch", "before_last", "before_epoch")


def restore_as_of(replies: DataFrame, mapping: DataFrame, ticks: DataFrame, reply_key: list[str],
                  ttl: int = DEFAULT_TTL_SECONDS, text_col: str = "text",
                  out: str = "restored_text") -> DataFrame:
    """Restore with the mapping as it stood when the reply came.

    Entries met after the reply, and epochs that had expired, do not count.
    """
    keys = [*SESSION, *_extra(reply_key)]
    asked = live_epoch(placeholder_rows(replies, [*keys, "ts"], text_col), ticks, ttl)
    known = mapping.select(*SESSION, "epoch", "placeholder_key", "value", "first_ts")
    answers = (
        asked.filter(F.col("epoch").isNotNull())
        .join(known, [*SESSION, "epoch", "placeholder_key"])
        .filter(F.col("first_ts") <= F.col("ts"))
    )
    return _fill(replies, answers, reply_key, text_col, out)


def unresolved(replies: DataFrame, mapping: DataFrame, reply_key: list[str], text_col: str = "text",
               ttl: int = DEFAULT_TTL_SECONDS, ts_col: str = "ts") -> DataFrame:
    """Placeholders of replies that the mapping, as it stood at the reply's time, does not know."""
    ts = _timed(replies, ts_col)
    keys = [*SESSION, *_extra(reply_key)]
    timed = [*keys, *([ts] if ts and ts not in keys else [])]
    known = _answers(replies, mapping, timed, text_col, ts, ttl).select(*keys, "placeholder_key")
    asked = placeholder_rows(replies, keys, text_col)
    return asked.join(known, [*keys, "placeholder_key"], "left_anti").select(*keys, "placeholder_key")
