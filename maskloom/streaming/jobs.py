"""The same work on streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from maskloom.files import Folder
from maskloom.functions.numbering import value_key
from maskloom.functions.rulebook import DEFAULT_TTL_SECONDS
from maskloom.functions.text import each, splice, with_lookup
from maskloom.operators.detect import detect
from maskloom.operators.mask import Masked, mask_sessions, mask_texts
from maskloom.operators.restore import restore_sessions
from maskloom.operators.store import BUCKETS, MappingStore
from maskloom.sources.corpus import CALL_KEY, SESSION, with_session_ids

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "struct<entity_type:string,idx:int,placeholder_key:string,value:string,first:boolean>"


def mask_stream(texts: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Stateless masking of a stream: narrow, append only, no state."""
    return mask_texts(texts, text_col, **options)


def once_per_call(calls: DataFrame, delay: str = "10 minutes", key: list[str] | None = None) -> DataFrame:
    """Drop calls delivered again within the watermark."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key or CALL_KEY)


class SessionNumbers(StatefulProcessor):
    """Numbers of one session: known values keep theirs, new ones follow on.

    All state goes when the session has been silent for the TTL in event time.  Nothing
    has to outlive that: an epoch's number is that of the TTL-wide bucket of its first call, and
    epochs of a session never begin in one bucket.  Rows from before the watermark
    never get here, so none can come back to a closed epoch.  Each session has one writer,
    so two calls can never claim the same number.

    State is asked over a socket, so a batch asks for a value it has not yet met only, and puts away
    what the epoch that is alive at its end has gained; epochs that begin and end within a batch never get there.
    """

    def __init__(self, ttl: int):
        self._ttl_us = ttl * 1_000_000

    def init(self, handle) -> None:
        self._handle = handle
        self._known = handle.getMapState("known", "k string", "idx int")
        self._counts = handle.getMapState("counts", "entity_type string", "n int")
        self._clock = handle.getValueState("clock", "last_us bigint, epoch int")

    def _forget(self) -> None:
        self._known.clear()
        self._counts.clear()
        self._clock.clear()

    def _ends(self, last_us: int) -> int:
        """Past the last moment that still belongs to the epoch, in whole milliseconds."""
        return (last_us + self._ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clock = self._clock.get()
        last_us, epoch = tuple(clock) if clock is not None else (None, None)
        if clock is not None:
            self._handle.deleteTimer(self._ends(last_us))
        # What this batch has met of the epoch, what it has added, and whether state knows more of it.
        known, counts, added, stored = {}, {}, [], clock is not None

        def number(k: str) -> int:
            """The value's number, or -1 less that number where it is new."""
            if k not in known and stored:
                held = self._known.getValue((k,))
                if held is not None:
                    known[k] = held[0]
            if k in known:
                return known[k]
            entity = k.split("\n", 1)[0]
            if entity not in counts:
                held = self._counts.getValue((entity,)) if stored else None
                counts[entity] = held[0] if held is not None else 0
            known[k] = counts[entity]
            counts[entity] += 1
            added.append(k)
            return -1 - known[k]

        # One session's rows of one micro-batch, which the trigger bounds.
        for row in sorted(rows, key=lambda r: r.call_seq):
            if last_us is None or row.ts_us - last_us >= self._ttl_us:
                if stored:
                    self._forget()
                known, counts, added, stored = {}, {}, [], False
                epoch, last_us = row.ts_us // self._ttl_us, row.ts_us
            last_us = max(last_us, row.ts_us)
            yield Row(system_id=key[0], session_id=key[1], call_seq=row.call_seq, ts_us=row.ts_us, epoch=epoch, text=row.text,
                      cuts=row.cuts, found_keys=row.found_keys, numbers=[number(k) for k in row.found_keys])
        for k in added:
            self._known.updateValue((k,), (known[k],))
        for entity in {k.split("\n", 1)[0] for k in added}:
            self._counts.updateValue((entity,), (counts[entity],))
        self._clock.update((last_us, epoch))
        self._handle.registerTimer(self._ends(last_us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


def mask_session_stream(calls: DataFrame, ttl: int = DEFAULT_TTL_SECONDS, delay: str = "10 minutes",
                        spans: str | None = None, **options) -> DataFrame:
    """Stateful masking of a stream of calls.  ``spans`` names a finished span column.

    Detection and rewriting stay in the JVM; the stateful step only hands out
    numbers.  Rows carry ``masked_text`` and ``found``, whose entries marked
    ``first`` are the additions to the mapping table.
    """
    numbered_keys = (
        f"array_distinct({each('transform', 'reverse(spans)', value_key)})"
    )
    known = with_session_ids(calls)
    found = known.withColumn("spans", F.col(spans)) if spans else detect(known, **{"context": "overlaps", **options})
    positions = "transform(found_keys, (k, i) -> named_struct('k', k, 'v', i))"
    cuts = with_lookup(positions, lambda get: "flatten(" + each(
        "transform", "spans", lambda s: f"array({s}.start, {s}.end, {get(value_key(s))})") + ")")
    ready = (
        found.withWatermark("ts", delay)
        .select(*CALL_KEY, "ts", F.unix_micros("ts").alias("ts_us"), "text", "spans",
                F.expr(numbered_keys).alias("found_keys"))
        .select(*CALL_KEY, "ts", "ts_us", "text", F.expr(cuts).alias("cuts"), "found_keys")
    )
    # Rows pass through Python, so spans go as three numbers each: start, end, and which of the keys.
    out = (
        "system_id string, session_id string, call_seq bigint, ts_us bigint, epoch int, text string, "
        "cuts array<int>, found_keys array<string>, numbers array<int>"
    )
    numbered = ready.groupBy(*SESSION).transformWithState(
        SessionNumbers(ttl), outputStructType=out, outputMode="Append", timeMode="EventTime")
    rows = numbered.select(
        *CALL_KEY, F.timestamp_micros("ts_us").alias("ts"), "epoch", "text",
        F.inline(F.array(F.struct(F.expr(_FOUND).alias("found"), F.expr(_PLACES).alias("places")))))
    return rows.select(*CALL_KEY, "ts", "epoch", "found", F.expr(splice(
        "text", "places", lambda s: f"concat('{{{{', found[{s}.nth].placeholder_key, '}}}}')")).alias("masked_text"))


_NUMBER = "CASE WHEN numbers[i] < 0 THEN -1 - numbers[i] ELSE numbers[i] END"
_FOUND = (
    f"CAST(transform(found_keys, (k, i) -> named_struct('entity_type', substring_index(k, '\n', 1), 'idx', {_NUMBER}, "
    f"'placeholder_key', concat(substring_index(k, '\n', 1), '_', {_NUMBER}), 'value', substring(k, locate('\n', k) + 1), "
    f"'first', numbers[i] < 0)) AS array<{_ENTRY}>)"
)
_PLACES = (
    "transform(CASE WHEN size(cuts) > 0 THEN sequence(0, size(cuts) - 3, 3) ELSE CAST(array() AS array<int>) END, "
    "i -> named_struct('start', cuts[i], 'end', cuts[i + 1], 'nth', cuts[i + 2]))"
)

_WRITER, _LATE_WRITER = "calls", "late calls"


class LateCalls:
    """Side output of `mask_session_job`: calls from before the watermark, for `mask_late` to take up.

    A micro-batch writes its late calls, with the watermark they missed, to a folder of its own
    and then a mark with the watermark after it, the latest time so far less ``delay``.  The next batch
    reads one mark, so a batch that runs again, or after a restart, sets the same calls
    apart.  Calls without a time are never late.
    """

    def __init__(self, spark: SparkSession, path: str, delay: str = "10 minutes") -> None:
        self.spark, self._path, self._delay = spark, path, delay
        self._marks, self._claims = Folder(spark, f"{path}/marks"), Folder(spark, f"{path}/claims")

    def _marked(self) -> list[int]:
        return sorted(int(n) for n in self._marks.names() if not n.startswith("."))

    def _mark(self, batch: int) -> dict:
        return json.loads(self._marks.read(str(batch)))

    def set_apart(self, calls: DataFrame, batch: int) -> DataFrame:
        """The calls that are in time; the late ones are written."""
        before = [n for n in self._marked() if n < batch]
        limit = self._mark(before[-1])["watermark"] if before else None
        late = F.coalesce(F.unix_micros("ts") < F.lit(limit).cast("long"), F.lit(False))
        seen = calls.agg(
            F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {self._delay}")).alias("reached"), F.count_if(late).alias("late")).first()
        if seen["late"]:
            (calls.where(late).withColumn("watermark", F.timestamp_micros(F.lit(limit)))
             .write.mode("overwrite").parquet(f"{self._path}/calls/batch={batch}"))
        reached = max((x for x in (limit, seen["reached"]) if x is not None), default=None)
        self._marks.publish(str(batch), json.dumps({"watermark": reached, "late": seen["late"]}))
        return calls.where(~late)

    def claim(self, first: int) -> tuple[int, list[str]]:
        """Last batch to take up from ``first`` on, and the folders that hold late calls.

        The range is written down before it is used: an attempt that follows a broken one takes the same.
        """
        waiting = [n for n in self._marked() if n >= first]
        if str(first) not in self._claims.names():
            if not any(self._mark(n)["late"] for n in waiting):
                return first - 1, []
            self._claims.publish(str(first), str(waiting[-1]))
        last = int(self._claims.read(str(first)))
        return last, [f"{self._path}/calls/batch={n}" for n in waiting if n <= last and self._mark(n)["late"]]


def _mask_into(store: MappingStore, calls: DataFrame, texts: str, writer: str, number: int, ttl: int, options: dict) -> None:
    """Mask ``calls`` as a batch that continues ``store``; text goes to a folder of its own, then the mapping is saved."""
    kept = with_session_ids(calls).persist()
    sessions, version = kept.select(*SESSION).distinct(), store.manifest().version or None
    reach = kept.agg(F.min("ts").alias("first"), F.bool_or(F.col("ts").isNull()).alias("untimed")).first()
    known = store.read(sessions, version)
    if reach["first"] is not None and not reach["untimed"]:
        earliest = F.unix_micros(F.lit(reach["first"])) - ttl * 1_000_000
        known = known.where(F.coalesce(F.unix_micros("saved_ts") > earliest, F.lit(True)))
    known = known.persist()
    done = mask_sessions(kept, ttl, known, history=store.epochs(sessions, version), added_only=True, **options)
    done.texts.write.mode("overwrite").parquet(texts)
    store.save(done.mapping, writer, number)
    store.compact()
    known.unpersist()
    kept.unpersist()


def mask_session_job(calls: DataFrame, text_path: str, mapping_path: str, checkpoint: str,
                     ttl: int = DEFAULT_TTL_SECONDS, trigger: dict | None = None, buckets: int = BUCKETS,
                     late: LateCalls | None = None, **options) -> StreamingQuery:
    """Mask a stream of calls in their sessions, into masked texts and a `MappingStore`.

    A micro-batch is masked as a batch that continues the stored mapping, of which it reads
    the buckets of its own sessions and the epochs it can reach.  Text never leaves
    the JVM, no state is held between batches, and no call is dropped: a late one joins
    the epoch that is alive when it comes, or goes to ``late`` if that is given.  A batch that
    runs again replaces its texts; its additions to the mapping are saved once, as the last
    thing it does.
    """
    store = MappingStore(calls.sparkSession, mapping_path, buckets)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if store.committed(_WRITER, batch_id):
            return
        if late is None:
            _mask_into(store, batch, f"{text_path}/batch={batch_id}", _WRITER, batch_id, ttl, options)
            return
        # What is late, and the calls in time, both come from the batch; it is read from the source once.
        read = batch.persist()
        _mask_into(store, late.set_apart(read, batch_id), f"{text_path}/batch={batch_id}", _WRITER, batch_id, ttl, options)
        read.unpersist()

    return (
        calls.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def mask_late(late: LateCalls, text_path: str, mapping_path: str, ttl: int = DEFAULT_TTL_SECONDS,
              buckets: int = BUCKETS, **options) -> int:
    """Mask the late calls that have been set apart since the last time; the number of folders read.

    Nothing else is read of the calls.  They continue the stored mapping as a batch does, each in the
    epoch that is alive then, and count once: their texts are a folder of the texts, under a
    number below zero, with the time they count as met, their session's last save; an attempt that broke off is done again over its remains.  A
    session has one writer, so run it while the job is between two runs.
    """
    store = MappingStore(late.spark, mapping_path, buckets)
    last, folders = late.claim(store.manifest().done.get(_LATE_WRITER, -1) + 1)
    if folders:
        found = with_session_ids(late.spark.read.parquet(*folders).drop("watermark"))
        saves = store.epochs(found.select(*SESSION).distinct()).groupBy(*SESSION).agg(F.max("saved_ts").alias("saved"))
        met = found.join(saves, SESSION, "left").withColumn("ts", F.greatest("ts", "saved")).drop("saved")
        _mask_into(store, met, f"{text_path}/batch={-1 - last}", _LATE_WRITER, last, ttl, options)
    return len(folders)


def stored_mapping(spark: SparkSession, mapping_path: str) -> DataFrame:
    """The mapping table that the batches of `mask_session_job` add up to."""
    return MappingStore(spark, mapping_path).read()


def mask_missed(calls: DataFrame, texts: DataFrame, mapping: DataFrame, ttl: int = DEFAULT_TTL_SECONDS,
                **options) -> Masked:
    """Mask, as a batch that continues ``mapping``, the calls whose text the stream has not put out."""
    missed = with_session_ids(calls).join(texts.select(*CALL_KEY), CALL_KEY, "left_anti")
    return mask_sessions(missed, ttl, mapping, **options)


def restore_stream(replies: DataFrame, mapping: str | MappingStore, out_path: str, checkpoint: str,
                   reply_key: list[str], ttl: int = DEFAULT_TTL_SECONDS, **trigger) -> StreamingQuery:
    """Restore a stream of replies against the mapping as stored at each batch.

    Each reply takes the epoch that is alive at its ``ts``; expired sessions stay
    masked.  A batch writes its own folder, so one that runs again replaces its output.
    Of a `MappingStore` a batch reads the buckets of the sessions whose placeholders it
    holds; a path is a plain mapping table, read whole.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # Asked, filled and plain replies all come from the batch; it is read from the source once.
        kept = batch.persist()
        if isinstance(mapping, MappingStore):
            known = mapping.read(kept.where(F.contains("text", F.lit("{{"))).select(*SESSION).distinct())
        else:
            known = batch.sparkSession.read.parquet(mapping)
        back = restore_sessions(kept, known, reply_key, ttl=ttl)
        back.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        kept.unpersist()

    return (
        replies.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def audit_windows(detected: DataFrame, width: str = "1 hour", slide: str | None = None,
                  delay: str = "10 minutes") -> DataFrame:
    """Spans per window, system and type; late rows count within the watermark.

    In append mode a window comes out once, when the watermark has passed its end, and its state goes then.
    """
    spans = detected.withWatermark("ts", delay).select("ts", "system_id", F.explode("spans").alias("s"))
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return spans.groupBy(window.alias("w"), "system_id", F.col("s.entity_type").alias("entity_type")).agg(
        F.count("*").alias("n"))


def audit_job(detected: DataFrame, path: str, checkpoint: str, width: str = "1 hour", slide: str | None = None,
              delay: str = "10 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Run `audit_windows` into a folder; it holds the windows that are closed.

    State is what the open windows need.  Spans that come after all their windows have closed are in no
    window; `late_spans` says how many.
    """
    return (
        audit_windows(detected, width, slide, delay)
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "system_id", "entity_type", "n")
        .writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def late_spans(query: StreamingQuery) -> int:
    """Counts that a running or finished `audit_job` has left out as too late, one for each window of a batch's partial count."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def session_activity(calls: DataFrame, ttl: int = DEFAULT_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Calls per session between silences of the TTL."""
    return (
        calls.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{ttl} seconds").alias("w"), *SESSION)
        .agg(F.count("*").alias("calls"))
    )
