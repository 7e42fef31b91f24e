"""Streams over several micro-batches and a restart, against one batch run."""

import datetime as dt
import random

import pytest

from maskloom.operators.detect import detect
from maskloom.operators.mask import mask_sessions
from maskloom.operators.restore import restore_sessions
from maskloom.sources.corpus import CALL_KEY, CALL_SCHEMA
from maskloom.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, jobs.STATE_STORE)
    yield
    spark.conf.unset(name)


def _rows():
    rng, at, out = random.Random(9), 0, []
    for i in range(60):
        at += rng.choice([5, 60, 900, 4000])
        mail = f"u{rng.randrange(6)}@mail.com"
        out.append(("a", f"s{rng.randrange(3)}", i, START + dt.timedelta(seconds=at), "stateful",
                    f"write {mail} or x{i % 4}@corp.org" if i % 5 else "nothing"))
    return out


def _entries(mapping):
    return sorted(tuple(r) for r in mapping.select(
        "session_id", "epoch", "placeholder_key", "value", "first_seq", "saved_ts").collect())


def test_batches_and_a_restart_equal_one_run(spark, rocks, tmp_path):
    rows, source = _rows(), str(tmp_path / "calls")
    every = spark.createDataFrame(rows, CALL_SCHEMA)
    want = mask_sessions(every)

    def deliver(number, some):
        spark.createDataFrame(some, CALL_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        calls = spark.readStream.schema(CALL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.mask_session_job(calls, str(tmp_path / "texts"), str(tmp_path / "mapping"),
                              str(tmp_path / "checkpoint")).awaitTermination()

    for n in range(2):
        deliver(n, rows[n * 15 : n * 15 + 15])
    run()
    for n in (2, 3):
        deliver(n, rows[n * 15 : n * 15 + 15])
    run()
    texts = spark.read.parquet(str(tmp_path / "texts"))
    assert texts.select("batch").distinct().count() >= 4
    got = {r["call_seq"]: r["masked_text"] for r in texts.collect()}
    assert got == {r["call_seq"]: r["masked_text"] for r in want.texts.collect()}
    mapping = jobs.stored_mapping(spark, str(tmp_path / "mapping"))
    assert _entries(mapping) == _entries(want.mapping)
    assert mapping.select("epoch").distinct().count() > 1
    back = restore_sessions(texts.drop("batch", "epoch"), mapping, CALL_KEY, "masked_text")
    assert {r["call_seq"]: r["restored_text"] for r in back.collect()} == {r[2]: r[5] for r in rows}


def test_missed_calls_are_masked_later(spark):
    rows = _rows()
    every = spark.createDataFrame(rows, CALL_SCHEMA)
    seen = mask_sessions(every.where("call_seq < 50"))
    late = jobs.mask_missed(every, seen.texts, seen.mapping)
    want = {r["call_seq"]: r["masked_text"] for r in mask_sessions(every).texts.collect() if r["call_seq"] >= 50}
    assert {r["call_seq"]: r["masked_text"] for r in late.texts.collect()} == want


def test_late_calls_are_set_apart_and_masked_once(spark, tmp_path, monkeypatch):
    """Late calls come between batches; the catch-up reads only these, and an attempt that breaks off counts once."""
    rows, place = _rows(), lambda name: str(tmp_path / name)
    late = jobs.LateCalls(spark, place("late"), "30 seconds")
    held_back = [r for r in rows if r[2] in (4, 6, 17, 31)]
    in_time = [r for r in rows if r not in held_back]

    def deliver(some):
        spark.createDataFrame(some, CALL_SCHEMA).coalesce(1).write.mode("append").parquet(place("calls"))
        stream = spark.readStream.schema(CALL_SCHEMA).parquet(place("calls"))
        jobs.mask_session_job(stream, place("texts"), place("mapping"), place("checkpoint"), late=late).awaitTermination()

    def catch_up():
        return jobs.mask_late(late, place("texts"), place("mapping"))

    def apart():
        return spark.read.parquet(place("late/calls"))

    untimed = ("a", "s9", 100, None, "stateful", "write u0@mail.com")
    deliver(in_time[:20])
    assert catch_up() == 0
    deliver(held_back[:2] + in_time[20:30] + [untimed])
    assert {r["call_seq"] for r in apart().collect()} == {4, 6}
    assert {r["watermark"] for r in apart().collect()} == {max(r[3] for r in in_time[:20]) - dt.timedelta(seconds=30)}

    # The first attempt breaks off after its texts are written; the second is made when more has come.
    with monkeypatch.context() as broken:
        def save(*_):
            raise RuntimeError("lost")

        broken.setattr(jobs.MappingStore, "save", save)
        with pytest.raises(RuntimeError):
            catch_up()
    deliver(in_time[30:] + held_back[2:3])
    assert catch_up() == 1 and catch_up() == 1 and catch_up() == 0
    # A batch of late calls alone.
    deliver(held_back[3:])
    assert catch_up() == 1 and catch_up() == 0

    texts = spark.read.parquet(place("texts"))
    every = [*rows, untimed]
    assert sorted(r["call_seq"] for r in texts.collect()) == sorted(r[2] for r in every)
    assert {r["call_seq"] for r in texts.where("batch < 0").collect()} == {4, 6, 17, 31}
    assert texts.where("contains(masked_text, '@')").count() == 0
    mapping = jobs.stored_mapping(spark, place("mapping"))
    keys = ["session_id", "epoch", "placeholder_key"]
    assert mapping.groupBy(*keys).count().where("count > 1").count() == 0
    assert mapping.groupBy("session_id", "epoch", "entity_type", "value").count().where("count > 1").count() == 0
    back = restore_sessions(texts.drop("batch", "epoch"), mapping, CALL_KEY, "masked_text")
    assert {r["call_seq"]: r["restored_text"] for r in back.collect()} == {r[2]: r[5] for r in every}


def test_closed_windows_leave_the_state(spark, tmp_path):
    """Windows come out once and go from the state; what comes too late is counted apart."""
    def deliver(rows):
        spark.createDataFrame(rows, CALL_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))

    def call(n, seconds):
        return ("a", f"s{n % 3}", n, START + dt.timedelta(seconds=seconds), "stateful", "write x@corp.org or 10.0.0.7")

    for day in range(6):
        deliver([call(100 * day + i, 86_400 * day + 600 * i) for i in range(40)])
    deliver([call(900, 86_400 * 2), call(901, 86_400 * 2 + 60), call(902, 86_400 * 6)])
    calls = spark.readStream.schema(CALL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    query = jobs.audit_job(detect(calls), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "2 hours", "1 hour")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # A day has 8 overlapping windows of two types; the day before is gone by the next batch but one.
    assert max(held) <= 2 * 8 * 2 and held[-1] <= 4
    # Two late calls of two types, each in two windows; Spark adds the two up before it drops them.
    assert jobs.late_spans(query) == 4
    got = {(r["start"], r["entity_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for day in range(6):
        for i in range(40):
            hour = (600 * i) // 3600
            for back in (0, 1):
                for entity in ("EMAIL", "IP_ADDRESS"):
                    key = (START + dt.timedelta(days=day, hours=hour - back), entity)
                    want[key] = want.get(key, 0) + 1
    assert got == want


class _Asked:
    """State of one key in memory that counts how often it is asked."""

    def __init__(self):
        self.maps, self.value, self.timers, self.asked = {}, None, set(), 0

    def getMapState(self, name, *_):
        own, outer = self.maps.setdefault(name, {}), self

        class Map:
            def getValue(self, key):
                outer.asked += 1
                return own.get(key)

            def updateValue(self, key, value):
                outer.asked += 1
                own[key] = value

            def clear(self):
                outer.asked += 1
                own.clear()

        return Map()

    def getValueState(self, *_):
        outer = self

        class Value:
            def get(self):
                outer.asked += 1
                return outer.value

            def update(self, value):
                outer.asked += 1
                outer.value = value

            def clear(self):
                outer.asked += 1
                outer.value = None

        return Value()

    def listTimers(self):
        self.asked += 1
        return list(self.timers)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.discard(at)

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)


def _numbered(batches, ttl):
    from pyspark.sql import Row

    handle, out, asked = _Asked(), [], []
    numbers = jobs.SessionNumbers(ttl)
    numbers.init(handle)
    for batch in batches:
        before = handle.asked
        rows = [Row(call_seq=n, ts_us=ts * 1_000_000, text="", spans=[], cuts=[], found_keys=keys) for n, ts, keys in batch]
        out += [(r.call_seq, r.epoch, r.numbers) for r in numbers.handleInputRows(("a", "s"), iter(rows), None)]
        asked.append(handle.asked - before)
        assert len(handle.timers) == 1
    return out, asked


def test_state_is_asked_for_what_outlives_a_batch():
    calls = [(n, 100 * n, [f"EMAIL\nx{n % 3}", f"EMAIL\ny{n}", f"IP_ADDRESS\nz{n % 2}"]) for n in range(400)]
    # Silences of the TTL between all calls: epochs that end within the batch need no state.
    out, asked = _numbered([calls], 100)
    assert [n for _, _, n in out] == [[-1, -2, -1]] * 400 and asked[0] < 20
    # One epoch over two batches: known values keep their numbers, others follow on.
    whole, _ = _numbered([calls], 3600)
    parts, _ = _numbered([calls[:11], calls[11:]], 3600)
    assert whole == parts
    short = [(n, n, [f"EMAIL\nx{n % 3}"]) for n in range(400)]
    _, asked = _numbered([short[:200], short[200:]], 3600)
    assert max(asked) < 20
