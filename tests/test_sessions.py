"""Numbering, expiry, restoring and the mapping table."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskloom.operators.mapping import forget_sessions, load_mapping, merge_mapping, purge_expired
from maskloom.operators.mask import mask_calls, mask_sessions, mask_texts
from maskloom.operators.numbering import first_met, number_values
from maskloom.operators.restore import restore_as_of, restore_own, restore_sessions, unresolved
from maskloom.operators.sessions import session_ticks, with_epoch
from maskloom.operators.tenancy import parse_tenants, resolve_callers
from maskloom.session import join_hashed
from maskloom.sources.corpus import CALL_KEY, as_calls, write_masked

START = dt.datetime(2024, 1, 1)
CALLS = "system_id string, session_id string, call_seq bigint, ts timestamp, mode string, text string"
MAPPING = "system_id string, session_id string, epoch int, placeholder_key string, value string, first_ts timestamp, saved_ts timestamp"


def _at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def _calls(spark, rows):
    """``(system, session, seq, seconds, text[, mode])`` as calls."""
    full = [(a, b, c, _at(d), (m[0] if m else "stateful"), t) for a, b, c, d, t, *m in rows]
    return spark.createDataFrame(full, CALLS)


def _texts(masked):
    return {r.call_seq: r.masked_text for r in masked.collect()}


def test_stateless(spark):
    texts = ["Email john@test.com twice: john@test.com", "a@b.com, c@d.com", "Hello world", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {r.id: r for r in restore_own(mask_texts(df)).collect()}
    assert rows[0].masked_text == "Email {{EMAIL_0}} twice: {{EMAIL_0}}"
    assert rows[0].mapping == {"EMAIL_0": "john@test.com"}
    assert rows[1].masked_text == "{{EMAIL_1}}, {{EMAIL_0}}"
    assert rows[2].masked_text == "Hello world" and rows[2].mapping is None
    assert all(rows[i].restored_text == t for i, t in enumerate(texts))


def test_partial_overlap_restores_exactly(spark):
    """A street run that swallows the head of another value comes back whole."""
    texts = ["住在Rua Nova 6123-4567 ok", "Av. Central 5 Nathan Rd a@b.com c@d.com", "新城道6123456761234567"]
    back = restore_own(mask_texts(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert all(r.text == r.restored_text for r in back.collect())


def test_multi_turn_and_isolation(spark):
    done = mask_sessions(_calls(spark, [
        ("a", "s", 1, 0, "Email: john@test.com"), ("a", "s", 2, 10, "Also john@test.com and new@test.com"),
        ("b", "s", 1, 0, "Email: other@test.com"), ("a", "t", 3, 0, "nothing"),
    ]))
    got = {(r.system_id, r.session_id, r.call_seq): r.masked_text for r in done.texts.collect()}
    assert got[("a", "s", 1)] == "Email: {{EMAIL_0}}"
    assert got[("a", "s", 2)] == "Also {{EMAIL_0}} and {{EMAIL_1}}"
    assert got[("b", "s", 1)] == "Email: {{EMAIL_0}}"
    assert got[("a", "t", 3)] == "nothing"
    kept = {(r.system_id, r.placeholder_key): r.value for r in done.mapping.collect()}
    assert kept == {("a", "EMAIL_0"): "john@test.com", ("a", "EMAIL_1"): "new@test.com", ("b", "EMAIL_0"): "other@test.com"}


def test_expiry_is_exact(spark):
    """A gap of exactly the TTL expires; one microsecond less does not."""
    calls = _calls(spark, [
        ("a", "s", 1, 0, "x"), ("a", "s", 2, 3599.999999, "x"), ("a", "s", 3, 7199.999999, "x"), ("a", "s", 4, 7200, "x"),
    ])
    got = {r.call_seq: r.epoch for r in with_epoch(calls, session_ticks(calls)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def _simulate(calls, ttl):
    """The store as a dict, one call after another."""
    state, out = {}, {}
    for system, session, seq, at, values in calls:
        held = state.get((system, session))
        if held is None or at - held["at"] >= ttl:
            held = state[(system, session)] = {"at": at, "known": {}}
        held["at"] = at
        names = {}
        for v in reversed(values):
            names[v] = held["known"].setdefault(v, len(held["known"]))
        out[(system, session, seq)] = [names[v] for v in values]
    return out


@pytest.mark.parametrize("split", [False, True])
def test_batch_equals_sequential(spark, split):
    rng = random.Random(3)
    plan, seq = [], 0
    clock = {}
    for _ in range(400):
        key = (rng.choice("ab"), rng.choice("st"))
        seq += 1
        clock[key] = clock.get(key, 0) + rng.choice([1, 50, 99, 100, 101, 250])
        plan.append((*key, seq, clock[key], [f"u{rng.randrange(12)}@t.com" for _ in range(rng.randint(0, 3))]))
    want = {k: ", ".join(f"{{{{EMAIL_{i}}}}}" for i in v) or "none" for k, v in _simulate(plan, 100).items()}
    rows = [(a, b, c, d, ", ".join(v) or "none") for a, b, c, d, v in plan]
    calls = _calls(spark, rows)
    if split:
        early, late = calls.filter("call_seq <= 200"), calls.filter("call_seq > 200")
        first = mask_sessions(early, ttl=100)
        second = mask_sessions(late, ttl=100, old=first.mapping)
        texts = first.texts.unionByName(second.texts)
    else:
        texts = mask_sessions(calls, ttl=100).texts
    assert {(r.system_id, r.session_id, r.call_seq): r.masked_text for r in texts.collect()} == want


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_chunks_do_not_change_numbers(spark, chunk):
    rows = [("a", "s", 0, "EMAIL", f"v{i % 17}", i // 3, i % 3, _at(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "system_id string, session_id string, epoch int, entity_type string, value string, call_seq bigint, place int, ts timestamp")
    got = {r.value: r.idx for r in number_values(first_met(df), chunk_calls=chunk).collect()}
    first = {}
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        first.setdefault(r[4], len(first))
    assert got == first


def test_modes(spark):
    calls = _calls(spark, [
        ("a", "s", 1, 0, "a@b.com", "stateless"), ("a", "s", 2, 1, "c@d.com", "stateful"),
        ("a", "s", 3, 2, "c@d.com, a@b.com", "anything"),
    ])
    calls = as_calls(calls, system="system_id", session="session_id", order="call_seq", ts="ts", mode="mode")
    done = mask_calls(calls)
    rows = {r.call_seq: r for r in done.texts.collect()}
    assert rows[1].session_id is None and rows[1].mapping == {"EMAIL_0": "a@b.com"}
    assert rows[2].mapping is None and rows[3].masked_text == "{{EMAIL_0}}, {{EMAIL_1}}"
    assert {r.value for r in done.mapping.collect()} == {"c@d.com", "a@b.com"}


def test_stateful_needs_a_store(spark):
    calls = _calls(spark, [("a", "s", 1, 0, "a@b.com", "stateless")])
    assert mask_calls(calls, store=False).texts.first().masked_text == "{{EMAIL_0}}"
    with pytest.raises(PySparkException, match="mapping store"):
        mask_calls(_calls(spark, [("a", "s", 1, 0, "a@b.com")]), store=False).texts.collect()


def test_missing_session_gets_one(spark):
    calls = _calls(spark, [("a", None, 1, 0, "a@b.com"), ("a", None, 2, 0, "c@d.com")])
    ids = [r.session_id for r in mask_sessions(calls).texts.collect()]
    again = [r.session_id for r in mask_sessions(calls).texts.collect()]
    assert len(set(ids)) == 2 and None not in ids and sorted(ids) == sorted(again)


def test_missing_time_and_system(spark):
    """Calls without a time or a system are neither lost nor left unmasked."""
    rows = [("a", "s", 1, None, "stateful", "a@b.com"), ("a", "s", 2, None, "stateful", "c@d.com, a@b.com"),
            (None, "s", 3, _at(0), "stateful", "e@f.com"), ("a", "s", 4, None, "stateful", None)]
    got = _texts(mask_sessions(spark.createDataFrame(rows, CALLS)).texts)
    assert got == {1: "{{EMAIL_0}}", 2: "{{EMAIL_1}}, {{EMAIL_0}}", 3: "{{EMAIL_0}}", 4: None}
    with pytest.raises(PySparkException, match="call_seq"):
        mask_sessions(spark.createDataFrame([("a", "s", None, _at(0), "stateful", "a@b.com")], CALLS))


def _mapping(spark, rows):
    return spark.createDataFrame([(a, b, 0, k, v, _at(f), _at(s)) for a, b, k, v, f, s in rows], MAPPING)


def test_restore(spark):
    mapping = _mapping(spark, [
        ("a", "s", "NAME_0", "陳大文", 0, 0), ("a", "s", "PHONE_NUMBER_0", "$1\\98765432", 0, 0), ("b", "s", "NAME_0", "Bob", 0, 0),
    ])
    cases = [
        ("a", "s", 1, "{{NAME_0}}的電話是{{PHONE_NUMBER_0}}", "陳大文的電話是$1\\98765432"),
        ("a", "s", 2, "{{NAME_0}} said {{NAME_0}} and {{UNKNOWN_0}} {{NAME_00}}", "陳大文 said 陳大文 and {{UNKNOWN_0}} {{NAME_00}}"),
        ("a", "s", 3, "No placeholders here", "No placeholders here"),
        ("a", "nonexistent", 4, "{{NAME_0}} is here", "{{NAME_0}} is here"),
        ("b", "s", 5, "{{NAME_0}}", "Bob"),
        ("c", "s", 6, "{{NAME_0}} {{name_0}} {{{NAME_0}}}", "{{NAME_0}} {{name_0}} {{{NAME_0}}}"),
        ("a", "s", 7, None, None),
    ]
    replies = spark.createDataFrame([c[:4] for c in cases], "system_id string, session_id string, id int, text string")
    key = ["system_id", "session_id", "id"]
    got = {r.id: r.restored_text for r in restore_sessions(replies, mapping, key).collect()}
    assert got == {c[2]: c[4] for c in cases}
    missing = {(r.id, r.placeholder_key) for r in unresolved(replies, mapping, key).collect()}
    assert missing == {(2, "UNKNOWN_0"), (2, "NAME_00"), (4, "NAME_0"), (6, "NAME_0")}


def test_restore_as_of(spark):
    calls = _calls(spark, [("a", "s", 1, 0, "a@b.com"), ("a", "s", 2, 3000, "c@d.com"), ("a", "s", 3, 9000, "e@f.com")])
    done = mask_sessions(calls)
    when = {1: -1, 2: 10, 3: 3000, 4: 6599, 5: 6600, 6: 8999, 7: 9000, 8: 12599, 9: 12600}
    replies = spark.createDataFrame([("a", "s", i, _at(t), "{{EMAIL_0}} {{EMAIL_1}}") for i, t in when.items()],
                                    "system_id string, session_id string, id int, ts timestamp, text string")
    back = restore_as_of(replies, done.mapping, session_ticks(calls), ["system_id", "session_id", "id"])
    nothing, early, both, late = "{{EMAIL_0}} {{EMAIL_1}}", "a@b.com {{EMAIL_1}}", "a@b.com c@d.com", "e@f.com {{EMAIL_1}}"
    assert {r.id: r.restored_text for r in back.collect()} == {
        1: nothing, 2: early, 3: both, 4: both, 5: nothing, 6: nothing, 7: late, 8: late, 9: nothing}


def test_mapping_table(spark, tmp_path):
    old = _mapping(spark, [("a", "s", "NAME_0", "Alice", 0, 0), ("b", "s", "NAME_0", "Eve", 0, 0)])
    new = _mapping(spark, [("a", "s", "NAME_0", "Bob", 0, 50), ("a", "s", "PHONE_0", "98765432", 50, 50)])
    merged = merge_mapping(old, new)
    assert {(r.system_id, r.placeholder_key, r.value, r.saved_ts) for r in merged.collect()} == {
        ("a", "NAME_0", "Bob", _at(50)), ("a", "PHONE_0", "98765432", _at(50)), ("b", "NAME_0", "Eve", _at(0))}
    assert merge_mapping(old, new.limit(0)).count() == 2
    alive = load_mapping(merged, str(_at(3620)), system="a", session="s")
    assert {r.placeholder_key for r in alive.collect()} == {"NAME_0", "PHONE_0"}
    assert load_mapping(merged, str(_at(3650)), system="a").count() == 0
    assert purge_expired(merged, str(_at(3600))).filter("system_id = 'b'").count() == 0
    gone = spark.createDataFrame([("a", "s")], "system_id string, session_id string")
    assert {r.system_id for r in forget_sessions(merged, gone).collect()} == {"b"}
    texts = spark.createDataFrame([("a", "x")], "system_id string, masked_text string")
    write_masked(texts, merged, f"{tmp_path}/t", f"{tmp_path}/m")
    pruned = spark.read.parquet(f"{tmp_path}/m").filter("system_id = 'a'")
    assert "PartitionFilters: [isnotnull(system_id" in pruned._jdf.queryExecution().executedPlan().toString() and pruned.count() == 2
    with pytest.raises(ValueError):
        write_masked(texts, merged, f"{tmp_path}/t", f"{tmp_path}/t/")


def test_tenants(spark):
    raw = spark.createDataFrame([(" a:k1 , ,nocolon,b:k:2,c:k1,:k3",)], "raw string")
    tenants = parse_tenants(raw, "raw")
    assert {(r.api_key, r.system_id) for r in tenants.collect()} == {("k1", "c"), ("k:2", "b"), ("k3", "")}
    callers = spark.createDataFrame([(1, "k1"), (2, None), (3, ""), (4, "zz"), (5, "k3")], "id int, api_key string")
    assert {r.id: r.status for r in resolve_callers(callers, tenants).collect()} == {
        1: "accepted", 2: "missing", 3: "missing", 4: "invalid", 5: "invalid"}


def test_round_trip_key(spark):
    calls = _calls(spark, [("a", "s", i, i, f"tel 6{i:07d}, x{i}@y.com") for i in range(50)])
    done = mask_sessions(calls)
    back = restore_sessions(done.texts.withColumnRenamed("masked_text", "text"), done.mapping, CALL_KEY)
    both = back.select(*CALL_KEY, "restored_text").join(calls, CALL_KEY)
    assert both.filter(F.col("restored_text") != F.col("text")).count() == 0 and both.count() == 50


def test_made_texts_are_dealt_by_rows(spark, tmp_path):
    """A file of short rows is few splits, however long the work on them is."""
    from maskloom.plans import fixtures
    from maskloom.session import spread

    spark.range(3000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = spread(spark.read.parquet(f"{tmp_path}/customer.parquet"), 100)
    assert made.rdd.getNumPartitions() == 30 and made.count() == 3000
    assert max(len(p) for p in made.rdd.glom().collect()) <= 200
    assert fixtures.built_texts(spark, str(tmp_path), "customer").count() == 3000


def test_results_read_finished_tables(spark):
    """Session times, values and numbers are worked out once: neither result ranks or unfolds anything again."""
    done = mask_sessions(_calls(spark, [("a", "s", n, 1000 * n, f"a{n}@b.com and 1{n}@b.com") for n in range(4)]))
    for result in (done.mapping, done.texts):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan


def test_calls_that_share_their_key(spark):
    """Each is filled with the numbers of its own epoch, though one value has two."""
    done = mask_sessions(_calls(spark, [
        ("a", "s", 1, 0, "a@b.com"), ("a", "s", 1, 7200, "c@d.com, a@b.com, z@y.com"), ("a", "s", 1, 10, "a@b.com!")]))
    assert sorted(r.masked_text for r in done.texts.collect()) == [
        "{{EMAIL_0}}", "{{EMAIL_0}}!", "{{EMAIL_2}}, {{EMAIL_1}}, {{EMAIL_0}}"]


@pytest.mark.parametrize("n", [1, 16, 17, 600])
@pytest.mark.parametrize("order", ["right_to_left", "left_to_right"])
def test_many_values_in_a_call(spark, n, order):
    mails = [f"u{i}@b.com" for i in range(n)]
    done = mask_sessions(_calls(spark, [("a", "s", 1, 0, "見 " + "; ".join(mails + mails[:2]) + " 完")]), order=order)
    # From the right, the repeated ones are met first.
    met = list(dict.fromkeys(reversed(mails + mails[:2]))) if order == "right_to_left" else mails
    marks = [f"{{{{EMAIL_{met.index(m)}}}}}" for m in mails + mails[:2]]
    assert done.texts.first().masked_text == "見 " + "; ".join(marks) + " 完"


def test_a_number_twice_is_an_error(spark):
    """A stored mapping that gives a value two numbers can't be continued; one that repeats a row can."""
    calls = _calls(spark, [("a", "s", 1, 0, "a@b.com, c@d.com")])
    old = mask_sessions(calls).mapping
    again = _calls(spark, [("a", "s", 2, 5, "to a@b.com, c@d.com")])
    assert mask_sessions(again, old=old.unionByName(old)).texts.first().masked_text == "to {{EMAIL_1}}, {{EMAIL_0}}"
    twice = old.unionByName(old.withColumn("idx", F.col("idx") + 7))
    with pytest.raises(PySparkException):
        mask_sessions(again, old=twice).texts.collect()


def test_keys_of_two_widths_meet(spark):
    """A join by hash compares values, not their width."""
    left, right = spark.range(5).selectExpr("id AS k", "'x' AS s"), spark.range(3).selectExpr("cast(id AS int) AS k", "'x' AS s", "id AS v")
    assert sorted(r.v for r in join_hashed(left, right, ["k", "s"]).collect()) == [0, 1, 2]
