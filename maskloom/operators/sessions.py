"""Session time: where a mapping expires and numbering starts again.

A mapping lives until ``ttl`` seconds pass without a call.  Calls are first
grouped into buckets one TTL wide.  Two calls in one bucket are always closer
than the TTL, so an expiry can only fall between buckets, and a session however
large shrinks to one row per bucket before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskloom.functions.rulebook import DEFAULT_TTL_SECONDS
from maskloom.session import join_hashed
from maskloom.sources.corpus import SESSION


def bucket_of(ts: str, ttl: int) -> Column:
    """Number of the TTL-wide bucket a time lies in, counted down before 1970 too.

    Calls without a time all share bucket 0, so they never expire.
    """
    return bucket_at(f"coalesce(unix_micros({ts}), 0L)", ttl)


def bucket_at(micros: str, ttl: int) -> Column:
    """The same for a number of microseconds, given in SQL."""
    width = ttl * 1_000_000
    return F.expr(f"(({micros}) - pmod({micros}, {width}L)) div {width}L")


def session_ticks(calls: DataFrame, ttl: int = DEFAULT_TTL_SECONDS,
                  history: DataFrame | None = None) -> DataFrame:
    """``(system, session, bucket, first_ts, last_ts, epoch, since)``.

    ``history`` is an earlier mapping; its last save opens the session.  A call from
    before that save comes late: it belongs to the epoch that is alive now, and
    ``since``, the time of that save, is when it counts as met.
    """
    rows = calls.select(*SESSION, "ts", F.lit(None).cast("int").alias("base"))
    if history is not None:
        past = history.groupBy(*SESSION).agg(
            F.max("saved_ts").alias("ts"), F.max("epoch").cast("int").alias("base"))
        rows = rows.unionByName(past)
    is_past = F.col("base").isNotNull()
    buckets = rows.groupBy(*SESSION, bucket_of("ts", ttl).alias("bucket")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("base").alias("base"),
        F.max(F.when(is_past, F.col("ts"))).alias("saved"))
    whole = W.partitionBy(*SESSION)
    ordered = whole.orderBy("bucket")
    gap = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(ordered))
    late = F.coalesce(F.col("bucket") <= F.max(F.when(is_past, F.col("bucket"))).over(whole), F.lit(False))
    fresh = F.when(late, 0).otherwise(F.coalesce((gap >= ttl * 1_000_000).cast("int"), F.lit(0)))
    return (
        buckets.withColumns({"fresh": fresh, "since": F.when(late, F.max("saved").over(whole))})
        .withColumn("epoch", (F.sum("fresh").over(ordered) + F.coalesce(F.max("base").over(whole), F.lit(0))).cast("int"))
        .select(*SESSION, "bucket", "first_ts", "last_ts", "epoch", "since")
    )


def with_epoch(rows: DataFrame, ticks: DataFrame, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """The rows with their epoch; ``ts`` of a late one is the save that it came after."""
    met = F.when(F.col("ts").isNotNull(), F.greatest("ts", "since"))
    known = ticks.select(*SESSION, "bucket", "epoch", "since")
    return join_hashed(rows.withColumn("bucket", bucket_of("ts", ttl)), known, [*SESSION, "bucket"]).withColumn(
        "ts", met).drop("bucket", "since")


def epoch_ends(ticks: DataFrame) -> DataFrame:
    """Last call per session and epoch: the time its mapping was last saved."""
    return ticks.groupBy(*SESSION, "epoch").agg(F.max("last_ts").alias("saved_ts"))


#: Buckets that no time lies in: epochs that are not bounded on both sides, and a session's newest epoch.
OPEN, NEWEST = -(2**62), -(2**62) - 1


def epoch_intervals(mapping: DataFrame, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """``(system, session, bucket, epoch, begin_us, end_us)``: when a stored mapping's epochs are alive.

    An epoch lives from its first entry until the TTL after its last save, and has a row for each
    TTL-wide bucket in between.  It holds a call at least every TTL, so these are
    no more rows than there were calls; and as epochs of a session never overlap, a
    bucket meets two of them at most.  An epoch with an entry or a save without time has
    one row, under ``OPEN``, and each session's newest epoch one more, under ``NEWEST``.
    """
    begin, end = F.unix_micros("begin"), F.unix_micros("saved") + ttl * 1_000_000
    epochs = (
        mapping.groupBy(*SESSION, "epoch")
        .agg(F.min("first_ts").alias("begin"), F.max("saved_ts").alias("saved"),
             F.bool_or(F.col("first_ts").isNull() | F.col("saved_ts").isNull()).alias("open"))
        .select(*SESSION, "epoch", begin.alias("begin_us"), end.alias("end_us"), "open")
    )
    bounded = epochs.where("NOT open AND end_us > begin_us").select(
        *SESSION, F.explode(F.sequence(bucket_at("begin_us", ttl), bucket_at("end_us - 1", ttl))).alias("bucket"),
        "epoch", "begin_us", "end_us")
    never = F.lit(None).cast("long")
    unbounded = epochs.where("open").select(
        *SESSION, F.lit(OPEN).alias("bucket"), "epoch", never.alias("begin_us"), never.alias("end_us"))
    newest = epochs.groupBy(*SESSION).agg(F.max("epoch").alias("epoch")).select(
        *SESSION, F.lit(NEWEST).alias("bucket"), "epoch", never.alias("begin_us"), never.alias("end_us"))
    return bounded.unionByName(unbounded).unionByName(newest)


def with_live_epoch(rows: DataFrame, mapping: DataFrame, ts: str | None, ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """The rows with the ``epoch`` of their session that was alive at ``ts``; rows that meet none are left out.

    An as-of search by equality alone: a row looks up the bucket of its time, so no row
    ever meets all the epochs of its session.  Rows without a time take the newest epoch.  A
    row comes twice only if its session also has an ``OPEN`` epoch.
    """
    if ts is None:
        newest = mapping.groupBy(*SESSION).agg(F.max("epoch").alias("epoch"))
        return rows.join(newest, SESSION)
    probes = F.when(F.col(ts).isNull(), F.array(F.lit(NEWEST))).otherwise(F.array(bucket_of(f"`{ts}`", ttl), F.lit(OPEN)))
    spans = epoch_intervals(mapping, ttl)
    at = F.unix_micros(F.col(ts))
    inside = F.coalesce(F.col("begin_us") <= at, F.lit(True)) & F.coalesce(at < F.col("end_us"), F.lit(True))
    return (
        rows.withColumn("bucket", F.explode(probes)).join(spans, [*SESSION, "bucket"])
        .where(inside).drop("bucket", "begin_us", "end_us")
    )
