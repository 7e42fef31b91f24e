"""Intake of texts and output of masked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL_SCHEMA = T.StructType([
    T.StructField("system_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("call_seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("mode", T.StringType()),
    T.StructField("text", T.StringType()),
])
CALL_KEY = ["system_id", "session_id", "call_seq"]
SESSION = ["system_id", "session_id"]


def _column(df: DataFrame, given: str | Column | None, kind: T.DataType) -> Column:
    if given is None:
        return F.lit(None).cast(kind)
    found = F.col(given) if isinstance(given, str) else given
    return found.cast(kind)


def as_calls(
    df: DataFrame,
    *,
    text: str | Column = "text",
    system: str | Column,
    session: str | Column | None = None,
    order: str | Column,
    ts: str | Column | None = None,
    mode: str | Column | None = None,
    call_id: str | Column | None = None,
) -> DataFrame:
    """Any table of texts as ``calls``.

    ``order`` numbers the calls of a session: unique there and rising with ``ts``.
    A mode that is not exactly ``stateless`` counts as stateful.  ``call_id`` tells
    calls without a session apart where number, time and text may be equal.
    """
    chosen = _column(df, mode, T.StringType())
    given = {
        "system_id": system, "session_id": session, "call_seq": order, "ts": ts, "text": text,
    }
    columns = {f.name: _column(df, given.get(f.name), f.dataType) for f in CALL_SCHEMA}
    columns["mode"] = F.when(chosen == "stateless", "stateless").otherwise("stateful")
    own = [] if call_id is None else [_column(df, call_id, T.StringType()).alias("call_id")]
    return df.select(*[columns[f.name].alias(f.name) for f in CALL_SCHEMA], *own)


def with_session_ids(calls: DataFrame) -> DataFrame:
    """A call without a session opens its own.  The id is a hash, so reruns agree.

    It is made from the call's id where there is one, else from number, time and text,
    so calls that only share a number stay apart.
    The call key takes part in joins, so none of it may be NULL: a missing system
    becomes the empty one, and a missing call number is an error.
    """
    missing = F.raise_error(F.lit("call_seq must not be NULL")).cast("long")
    calls = calls.withColumns({
        "system_id": F.coalesce("system_id", F.lit("")), "call_seq": F.coalesce("call_seq", missing)})
    content = F.concat_ws("|", F.col("call_seq").cast("string"), F.unix_micros("ts").cast("string"), "text")
    own = F.coalesce("call_id", content) if "call_id" in calls.columns else content
    made = F.sha2(F.concat_ws("|", "system_id", own), 256)
    return calls.withColumn("session_id", F.coalesce("session_id", F.left(made, F.lit(32))))


def write_masked(masked: DataFrame, mapping: DataFrame, text_path: str, mapping_path: str,
                 mode: str = "errorifexists") -> None:
    """Masked texts and the mapping go to two folders, each split by system.

    The mapping holds the original values, so it must never share a folder with
    the masked texts.
    """
    if text_path.rstrip("/") == mapping_path.rstrip("/"):
        raise ValueError("masked texts and their mapping need separate folders")
    masked.write.mode(mode).partitionBy("system_id").parquet(text_path)
    mapping.write.mode(mode).partitionBy("system_id").parquet(mapping_path)
