"""Streaming jobs, run over the whole events table to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.detect import detect
from maskloom.operators.mask import mask_sessions
from maskloom.operators.restore import restore_sessions
from maskloom.plans.fixtures import CALL_TEXT, CALLS_CTE, OCCURRENCES_CTE, CALL_COLUMNS, ROWS_PER_TASK, select_df, table
from maskloom.plans.sessions import (
    _ALL_CTES,
    _BY_REPLY,
    _MASKED_SQL,
    _OWN,
    _REPLY_COLUMNS,
    _REPLY_TEXT,
    _SEEN,
    _calls,
    _filled_replies,
    _reply_text,
    saved_in_turns,
)
from maskloom.session import shared_dir, tasks_for
from maskloom.sources.corpus import CALL_KEY, as_calls
from maskloom.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.repartition(tasks_for(events, ROWS_PER_TASK))


def _call_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = select_df(_event_stream(spark, sf_dir), CALL_COLUMNS).selectExpr("*", f"{CALL_TEXT} AS text")
    return as_calls(base, system="system_id", session="session_id", order="call_seq", ts="ts")


def _finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its whole output."""
    spark = stream.sparkSession
    place = _folder(spark)

    def save(batch: DataFrame, batch_id: int) -> None:
        target = "final" if mode == "complete" else f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{place}/out/{target}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{place}/out")


def st1_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = jobs.mask_stream(_call_stream(spark, sf_dir)).select("call_seq", "masked_text")
    return _finished(masked)


def st2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, jobs.STATE_STORE)
    try:
        done = _finished(jobs.mask_session_stream(_call_stream(spark, sf_dir)))
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return done.select(*CALL_KEY, "masked_text")


def st2_job_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful job's two folders: its texts restored from the mapping it stored."""
    place = _folder(spark)
    jobs.mask_session_job(_call_stream(spark, sf_dir), f"{place}/texts", f"{place}/mapping", f"{place}/checkpoint").awaitTermination()
    texts = spark.read.parquet(f"{place}/texts").drop("batch", "epoch").withColumnRenamed("masked_text", "reply")
    back = restore_sessions(texts, jobs.stored_mapping(spark, f"{place}/mapping"), CALL_KEY, "reply")
    return back.select("call_seq", F.col("restored_text").alias("text"), F.contains("reply", F.lit("{{")).alias("masked"))


def st3_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    mask_sessions(_calls(spark, sf_dir)).mapping.write.parquet(f"{place}/mapping")
    replies = select_df(_event_stream(spark, sf_dir), _REPLY_COLUMNS).selectExpr(
        "reply_id", "system_id", "session_id", f"{_REPLY_TEXT} AS text",
        "cast(ts + late * interval '1' second AS timestamp) AS ts")
    query = jobs.restore_stream(replies, f"{place}/mapping", f"{place}/out", f"{place}/checkpoint",
                                ["system_id", "session_id", "reply_id"])
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out").select("reply_id", "restored_text")


def st3_store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies met by the buckets of a mapping store that four saves have filled, of which three are merged."""
    place = _folder(spark)
    store = saved_in_turns(spark, sf_dir, f"{place}/mapping")
    replies = select_df(_event_stream(spark, sf_dir), _REPLY_COLUMNS).selectExpr(
        "reply_id", "system_id", "session_id", f"{_REPLY_TEXT} AS text",
        "cast(ts + late * interval '1' second AS timestamp) AS ts")
    jobs.restore_stream(replies, store, f"{place}/out", f"{place}/checkpoint",
                        ["system_id", "session_id", "reply_id"]).awaitTermination()
    return spark.read.parquet(f"{place}/out").select("reply_id", "restored_text")


def st4_once_per_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call delivered twice; one of each stays."""
    calls = _call_stream(spark, sf_dir)
    twice = calls.unionByName(calls)
    return _finished(jobs.once_per_call(twice, "40 days").select("call_seq", "text"))


#: Calls delivered after all others; the older ones of them are late.
_LAST = "call_seq % 7 = 3"


def st4_late_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that come too late are set apart and masked afterwards; all texts restored from the mapping stored."""
    place = _folder(spark)
    calls = _calls(spark, sf_dir)
    late = jobs.LateCalls(spark, f"{place}/late")
    for number, part in enumerate((f"NOT {_LAST}", _LAST)):
        calls.where(part).write.parquet(f"{place}/calls/part={number}")
        stream = spark.readStream.schema(calls.schema).option("recursiveFileLookup", "true").parquet(f"{place}/calls")
        jobs.mask_session_job(
            stream, f"{place}/texts", f"{place}/mapping", f"{place}/checkpoint", late=late).awaitTermination()
        jobs.mask_late(late, f"{place}/texts", f"{place}/mapping")
    texts = spark.read.parquet(f"{place}/texts").withColumnRenamed("masked_text", "reply")
    back = restore_sessions(texts.drop("epoch"), jobs.stored_mapping(spark, f"{place}/mapping"), CALL_KEY, "reply")
    return back.select("call_seq", F.col("restored_text").alias("text"), F.contains("reply", F.lit("{{")).alias("masked"),
                       (F.col("batch") < 0).alias("late"))


def st5_audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = jobs.audit_windows(detect(_call_stream(spark, sf_dir)), "1 hour")
    done = _finished(counts, "complete")
    return done.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "system_id", "entity_type", "n")


def st5_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows as they close: all that end before the watermark of the last call."""
    place = _folder(spark)
    jobs.audit_job(detect(_call_stream(spark, sf_dir)), f"{place}/out", f"{place}/checkpoint", "6 hours", "2 hours").awaitTermination()
    return spark.read.parquet(f"{place}/out").select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "system_id", "entity_type", "n")


def st5_session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _finished(jobs.session_activity(_call_stream(spark, sf_dir)), "complete")
    return done.groupBy("system_id", "session_id").agg(
        F.count("*").alias("sessions"), F.sum("calls").cast("long").alias("calls"), F.max("calls").alias("longest"))


QUERIES |= {
    "st1_stateless": st1_stateless, "st2_sessions": st2_sessions, "st2_job_round_trip": st2_job_round_trip, "st3_restore": st3_restore,
    "st3_store_restore": st3_store_restore,
    "st4_once_per_call": st4_once_per_call, "st4_late_calls": st4_late_calls, "st5_audit_windows": st5_audit_windows,
    "st5_sliding": st5_sliding, "st5_session_activity": st5_session_activity,
}
ORACLES |= {
    "st1_stateless": f"WITH {CALLS_CTE} SELECT call_seq, {_OWN} AS masked_text FROM calls",
    "st2_sessions": _MASKED_SQL,
    "st2_job_round_trip": f"WITH {CALLS_CTE} SELECT call_seq, text, has_pii AS masked FROM calls",
    "st3_restore": f"{_SEEN} SELECT reply_id, {_reply_text('got_phone', 'got_mail')} AS restored_text "
                   f"FROM ({_filled_replies('seen', 'r.system_id', _BY_REPLY)})",
    "st3_store_restore": f"{_SEEN} SELECT reply_id, {_reply_text('got_phone', 'got_mail')} AS restored_text "
                         f"FROM ({_filled_replies('seen', 'r.system_id', _BY_REPLY)})",
    "st4_once_per_call": f"WITH {CALLS_CTE} SELECT call_seq, text FROM calls",
    "st4_late_calls": f"WITH {CALLS_CTE} SELECT call_seq, text, has_pii AS masked, {_LAST} AND ts < (SELECT max(ts) FROM calls "
                      f"WHERE NOT {_LAST}) - interval 10 minute AS late FROM calls",
    "st5_audit_windows": f"WITH {CALLS_CTE}, {OCCURRENCES_CTE} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, system_id, "
                         "entity_type, count(*) AS n FROM occ GROUP BY ALL",
    "st5_sliding": f"WITH {CALLS_CTE}, {OCCURRENCES_CTE}, placed AS (SELECT unnest(range(0, 3)) AS back, * FROM occ), w AS ("
                   "SELECT to_timestamp((epoch_us(ts) // 7200000000 - back) * 7200) AT TIME ZONE 'UTC' AS start, system_id, entity_type FROM placed) "
                   "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, system_id, entity_type, count(*) AS n FROM w "
                   "WHERE start + interval 6 hour <= (SELECT max(ts) FROM calls WHERE has_pii) - interval 10 minute GROUP BY ALL",
    "st5_session_activity": f"{_ALL_CTES}, s AS (SELECT system_id, session_id, epoch, count(*) AS n FROM ep GROUP BY ALL) "
                            "SELECT system_id, session_id, count(*) AS sessions, cast(sum(n) as bigint) AS calls, max(n) AS longest FROM s GROUP BY system_id, session_id",
}
