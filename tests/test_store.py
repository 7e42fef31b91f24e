"""The mapping store: levels, versions, look-ups by session, and jobs that use it."""

import datetime as dt
import os
import random

import pytest

from maskloom.operators.mapping import forget_sessions, merge_mapping, purge_expired
from maskloom.operators.mask import mask_sessions
from maskloom.operators.store import _SCHEMA, Manifest, MappingStore
from maskloom.sources.corpus import CALL_SCHEMA
from maskloom.streaming import jobs

START = dt.datetime(2024, 1, 1)


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def _entries(spark, rows):
    """``(session, epoch, number or None, value, seconds)`` as rows of a mapping."""
    full = [("a", s, e, None if n is None else "EMAIL", n, None if n is None else f"EMAIL_{n}", v, 0, _at(t), _at(t)) for s, e, n, v, t in rows]
    return spark.createDataFrame(full, _SCHEMA)


def _shown(df):
    return sorted((r["session_id"], r["epoch"], r["placeholder_key"], r["value"], r["saved_ts"]) for r in df.collect())


def _saves(rng, n, sessions=12):
    """Saves that overwrite some keys and only refresh other sessions."""
    out = []
    for turn in range(n):
        # One row for each key of a save, as a save has no order inside.
        keys = {(f"s{rng.randrange(sessions)}", rng.randrange(2), rng.choice([None, 0, 1, 2])) for _ in range(6)}
        out.append([(s, e, k, None if k is None else f"v{turn}.{i}", turn * 10) for i, (s, e, k) in enumerate(sorted(keys, key=str))])
    return out


def _expected(saves):
    entries, last = {}, {}
    for rows in saves:
        for s, e, n, v, t in rows:
            last[s, e] = max(last.get((s, e), START), _at(t))
            if n is not None:
                entries[s, e, f"EMAIL_{n}"] = v
    return sorted((s, e, k, v, last[s, e]) for (s, e, k), v in entries.items())


def test_saves_merges_and_versions_agree(spark, tmp_path):
    saves = _saves(random.Random(3), 9)
    store = MappingStore(spark, str(tmp_path), buckets=4, fanout=3)
    assert store.read().count() == 0 and store.load([("a", "s1")], "2024-01-01").count() == 0
    for n, rows in enumerate(saves):
        assert store.save(_entries(spark, rows), "w", n)
        assert not store.save(_entries(spark, [("s1", 0, 0, "again", 10_000)]), "w", n)
        if n == 4:
            early, version = store.read(), store.manifest().version
        store.compact()
        assert _shown(store.read()) == _expected(saves[: n + 1])
    levels = store.manifest().levels
    assert len(levels) < 5 and max(lv.tier for lv in levels) >= 1
    # A reader keeps the version it began with, and an old version can be asked for.
    assert _shown(early) == _shown(store.read(version=version)) == _expected(saves[:5])
    store.rewrite()
    assert len(store.manifest().levels) == 1 and _shown(store.read()) == _expected(saves)
    assert not store.save(_entries(spark, []))


def test_broken_off_work_is_invisible(spark, tmp_path):
    saves = _saves(random.Random(4), 3)
    store = MappingStore(spark, str(tmp_path), buckets=4, fanout=2)
    for n, rows in enumerate(saves):
        store.save(_entries(spark, rows), "w", n)
    before = store.manifest()
    # Files of a save and of a merge, but no manifest that names them; and a draft of one.
    store._write(_entries(spark, [("s1", 0, 0, "lost", 99_999)]), before.buckets, 0)
    (tmp_path / "manifest" / ".draft").write_text("{")
    assert store.manifest() == before and _shown(store.read()) == _expected(saves)
    assert store.save(_entries(spark, [("s1", 0, 0, "kept", 100_000)]), "w", 3)


def test_writers_at_the_same_time(spark, tmp_path):
    """A version is published once; the slower writer builds on it."""
    one, other = (MappingStore(spark, str(tmp_path), buckets=4, fanout=2) for _ in range(2))
    one.save(_entries(spark, [("s1", 0, 0, "a", 1)]))
    seen, calls = one.manifest, []

    def stale(version=None):
        now = seen(version)
        if not calls:
            calls.append(1)
            other.save(_entries(spark, [("s2", 0, 0, "b", 2)]))
        return now

    one.manifest = stale
    one.save(_entries(spark, [("s3", 0, 0, "c", 3)]))
    assert [r[0] for r in _shown(other.read())] == ["s1", "s2", "s3"]
    # A merge whose levels another merge has replaced changes nothing.
    gone = other.manifest().levels
    other.compact()
    after = other.manifest()
    other._replace(gone, 1)
    assert other.manifest() == after
    assert not other._folder.publish(f"{after.version:012d}.json", Manifest(0, 1).to_json())


def test_forgetting_and_purging_in_a_store(spark, tmp_path):
    saves = _saves(random.Random(5), 4)
    store = MappingStore(spark, str(tmp_path), buckets=4)
    for rows in saves:
        store.save(_entries(spark, rows))
    gone = spark.createDataFrame([("a", "s1"), ("a", "s2")], "system_id string, session_id string")
    store.rewrite(lambda mapping: purge_expired(forget_sessions(mapping, gone), str(_at(35)), 20))
    assert _shown(store.read()) == [r for r in _expected(saves) if r[0] not in ("s1", "s2") and r[4] > _at(15)]


def test_a_store_equals_the_merged_table(spark, tmp_path):
    saves = _saves(random.Random(6), 2)
    store, tables = MappingStore(spark, str(tmp_path), buckets=4), []
    for rows in saves:
        rows = [r for r in rows if r[2] is not None]
        store.save(_entries(spark, rows))
        tables.append(_entries(spark, rows))
    assert _shown(store.read()) == _shown(merge_mapping(*tables))


def _files(folder):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(folder) for f in names)


def test_one_session_reads_few_files(spark, tmp_path):
    store = MappingStore(spark, str(tmp_path), buckets=32, fanout=100)
    for n in range(3):
        store.save(_entries(spark, [(f"s{i}", 0, n, "v", n) for i in range(200)]))
    found = store.read([("a", "s17")])
    assert _files(tmp_path) >= 96 and len(found.inputFiles()) <= 3 * 2
    assert len(found.collect()) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,s17)" in plan and "EqualTo(system_id,a)" in plan
    # A batch of sessions reads their buckets, not the table.
    some = spark.createDataFrame([("a", "s3"), ("a", "s4"), ("b", "none")], "system_id string, session_id string")
    assert len(store.read(some).inputFiles()) <= 3 * 3 * 2 and store.read(some).count() == 6
    assert len(store.load([("a", "s5")], str(_at(5))).collect()) == 3


# --- jobs ---------------------------------------------------------------------


def _calls(rng, n):
    at, out = 0, []
    for i in range(n):
        at += rng.choice([5, 60, 900, 4000])
        out.append(("a", f"s{rng.randrange(3)}", i, _at(at), "stateful", f"write u{rng.randrange(6)}@mail.com or x{i % 4}@corp.org" if i % 5 else "nothing"))
    return out


def _job(spark, tmp_path, checkpoint="checkpoint", **options):
    calls = spark.readStream.schema(CALL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    jobs.mask_session_job(calls, str(tmp_path / "texts"), str(tmp_path / "mapping"), str(tmp_path / checkpoint), **options).awaitTermination()


def _deliver(spark, tmp_path, rows):
    spark.createDataFrame(rows, CALL_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = _calls(random.Random(8), 40)
    for part in (rows[:20], rows[20:]):
        _deliver(spark, tmp_path, part)
    _job(spark, tmp_path, buckets=4)
    texts = {r["call_seq"]: r["masked_text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect()}
    mapping = _shown(jobs.stored_mapping(spark, str(tmp_path / "mapping")))
    # A checkpoint that lost its commits: every batch is handed over a second time.
    _job(spark, tmp_path, "another", buckets=4)
    assert texts == {r["call_seq"]: r["masked_text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect()}
    assert mapping == _shown(jobs.stored_mapping(spark, str(tmp_path / "mapping")))
    want = mask_sessions(spark.createDataFrame(rows, CALL_SCHEMA))
    assert texts == {r["call_seq"]: r["masked_text"] for r in want.texts.collect()}


def test_a_batch_broken_off_before_its_mapping_is_done_again(spark, tmp_path):
    rows = _calls(random.Random(9), 30)
    _deliver(spark, tmp_path, rows)
    # Texts of a first try lie there; the mapping was not saved.
    spark.createDataFrame([("a", "s0", 0, _at(0), "half-written")], "system_id string, session_id string, call_seq bigint, ts timestamp, masked_text string").write.parquet(str(tmp_path / "texts" / "batch=0"))
    _job(spark, tmp_path, buckets=4)
    want = mask_sessions(spark.createDataFrame(rows, CALL_SCHEMA))
    got = {r["call_seq"]: r["masked_text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect()}
    assert got == {r["call_seq"]: r["masked_text"] for r in want.texts.collect()}


def test_late_calls_join_the_epoch_that_is_alive(spark, tmp_path):
    first = [("a", "s", 1, _at(0), "stateful", "a@b.com"), ("a", "s", 2, _at(10_000), "stateful", "c@d.com")]
    late = [("a", "s", 3, _at(20), "stateful", "a@b.com and c@d.com and e@f.com"), ("a", "s", 4, _at(10_010), "stateful", "e@f.com"),
            ("a", "t", 5, _at(20), "stateful", "a@b.com")]
    for part in (first, late):
        _deliver(spark, tmp_path, part)
    _job(spark, tmp_path, buckets=4)
    got = {r["call_seq"]: r["masked_text"] for r in spark.read.parquet(str(tmp_path / "texts")).collect()}
    assert got[1] == got[2] == "{{EMAIL_0}}"
    # Epoch 1 holds c@d.com as 0; the late call adds what it does not know, from the right.
    assert got[3] == "{{EMAIL_2}} and {{EMAIL_0}} and {{EMAIL_1}}" and got[4] == "{{EMAIL_1}}" and got[5] == "{{EMAIL_0}}"
    mapping = jobs.stored_mapping(spark, str(tmp_path / "mapping"))
    assert mapping.where("session_id = 's' AND epoch = 1").count() == 3
    # Met after the save before it, whatever its own time says.
    assert mapping.where("value = 'a@b.com' AND epoch = 1").first()["first_ts"] == _at(10_000)


def test_restore_stream_reads_the_buckets_of_its_sessions(spark, tmp_path):
    store = MappingStore(spark, str(tmp_path / "store"), buckets=32)
    store.save(_entries(spark, [(f"s{i}", 0, 0, f"v{i}", 0) for i in range(200)]))
    replies = [("a", f"s{i}", i, _at(5), "{{EMAIL_0}}" if i < 4 else "plain") for i in range(40)]
    schema = "system_id string, session_id string, reply_id bigint, ts timestamp, text string"
    spark.createDataFrame(replies, schema).coalesce(1).write.parquet(str(tmp_path / "replies"))
    reads, plain = [], store.read

    def watched(sessions=None, version=None):
        found = plain(sessions, version)
        reads.append(len(found.inputFiles()))
        return found

    store.read = watched
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "replies"))
    jobs.restore_stream(stream, store, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["reply_id"]).awaitTermination()
    got = {r["reply_id"]: r["restored_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: f"v{i}" if i < 4 else "plain" for i in range(40)}
    assert reads and max(reads) <= 4 * 2 < _files(tmp_path / "store")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, jobs.STATE_STORE)
    yield
    spark.conf.unset(name)


def test_state_goes_after_the_ttl(spark, rocks, tmp_path):
    """Only sessions that may still continue are held, and what the stream says equals one batch run."""
    batches = [[("a", f"s{i}", n * 40 + i, _at(n * 300 + i), "stateful", f"write u{n}@mail.com or x{i}@corp.org") for i in range(40)] for n in range(3)]
    batches += [[("a", "s1", 500 + n, _at(86_400 * (n + 1)), "stateful", f"write u{n}@mail.com")] for n in range(2)]
    for part in batches:
        _deliver(spark, tmp_path, part)
    calls = spark.readStream.schema(CALL_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    rows = []
    query = (
        jobs.mask_session_stream(calls).writeStream.foreachBatch(lambda df, n: rows.extend(df.collect()))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # Two values, a count and a clock for each session at first; for the one that came last in the end.
    assert max(held) >= 40 * 3 and held[-1] <= 6
    want = mask_sessions(spark.createDataFrame([r for part in batches for r in part], CALL_SCHEMA))
    assert {r["call_seq"]: r["masked_text"] for r in rows} == {r["call_seq"]: r["masked_text"] for r in want.texts.collect()}
    epochs = {(r["session_id"], r["epoch"]) for r in rows}
    assert len(epochs) == 40 + 2
