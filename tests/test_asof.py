"""As-of restore from a stored mapping, against the rule applied entry by entry."""

import datetime as dt
import random

import pytest

from maskloom.operators.restore import _answers, restore_sessions, unresolved
from maskloom.operators.sessions import epoch_intervals

START = dt.datetime(2024, 1, 1)
MAPPING = "system_id string, session_id string, epoch int, placeholder_key string, value string, first_ts timestamp, saved_ts timestamp"
REPLIES = "system_id string, session_id string, reply_id bigint, ts timestamp, text string"
TTL = 100
KEYS = ["system_id", "session_id", "reply_id"]


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def _mapping(rng, untimed):
    """Sessions of up to 300 epochs, each at least the TTL after the one before."""
    rows = []
    for session, epochs in (("many", 300), ("few", 3), ("one", 1)):
        at = 0
        for epoch in range(epochs):
            begin = at + TTL + rng.choice([0, 0.000001, 50, 5000])
            saved = begin + rng.choice([0, 1, TTL - 1, 950])
            for n in range(rng.randrange(1, 5)):
                first = begin if n == 0 else rng.uniform(begin, saved)
                rows.append(("a", session, epoch, f"EMAIL_{n}", f"{session}{epoch}.{n}", _at(first), _at(saved)))
            at = saved
    if untimed:
        rows += [("a", "never", 0, "EMAIL_0", "always", None, None), ("a", "few", 9, "EMAIL_7", "always too", None, None),
                 ("a", "half", 0, "EMAIL_0", "until", None, _at(50)), ("a", "half", 1, "EMAIL_0", "from", _at(500), None)]
    return rows


def _wanted(rows, reply, key):
    """The value from the newest epoch whose entry is alive; without a time, from the newest epoch of all."""
    system, session, _, ts, _ = reply
    own = [r for r in rows if r[:2] == (system, session)]
    if ts is None:
        own = [r for r in own if r[2] == max(x[2] for x in own)]
    alive = [r for r in own if r[3] == key and (ts is None or (
        (r[5] is None or r[5] <= ts) and (r[6] is None or ts < r[6] + dt.timedelta(seconds=TTL))))]
    return max(alive, key=lambda r: r[2])[4] if alive else None


@pytest.mark.parametrize("untimed", [False, True])
def test_as_of_equals_the_rule(spark, untimed):
    rng = random.Random(5)
    rows = _mapping(rng, untimed)
    times = [r[5] for r in rows if r[5]] + [r[6] + dt.timedelta(seconds=s) for r in rows if r[6] for s in (TTL, TTL - 0.000001)]
    replies = [
        ("a" if i % 11 else "b", rng.choice(["many", "many", "few", "one", "never", "half", "unknown", None]), i,
         rng.choice([*rng.choices(times, k=5), None]), "x {{EMAIL_0}} {{EMAIL_1}} {{EMAIL_3}} {{EMAIL_0}} {{EMAIL_7}}" if i % 13 else "plain")
        for i in range(1500)]
    mapping, asked = spark.createDataFrame(rows, MAPPING), spark.createDataFrame(replies, REPLIES)
    got = {r["reply_id"]: r["restored_text"] for r in restore_sessions(asked, mapping, KEYS, ttl=TTL).collect()}
    missing = {}
    for r in unresolved(asked, mapping, KEYS, ttl=TTL).collect():
        missing.setdefault(r["reply_id"], set()).add(r["placeholder_key"])
    found = 0
    for reply in replies:
        text, none = reply[4], set()
        for key in ("EMAIL_0", "EMAIL_1", "EMAIL_3", "EMAIL_7"):
            value = _wanted(rows, reply, key)
            if value is not None:
                text, found = text.replace(f"{{{{{key}}}}}", value), found + 1
            elif key in text:
                none.add(key)
        assert got[reply[2]] == text
        assert reply[1] is None or missing.get(reply[2], set()) == none
    assert found > 500


def test_a_placeholder_meets_one_entry(spark):
    """However many epochs a session has."""
    rows = _mapping(random.Random(6), False)
    replies = [("a", "many", i, r[5], "{{EMAIL_0}} {{EMAIL_1}}") for i, r in enumerate(rows) if r[1] == "many"]
    mapping, asked = spark.createDataFrame(rows, MAPPING), spark.createDataFrame(replies, REPLIES)
    answers = _answers(asked, mapping, [*KEYS, "ts"], "text", "ts", TTL)
    assert len(replies) < answers.count() <= 2 * len(replies)
    assert answers.groupBy(*KEYS, "placeholder_key").count().where("count > 1").count() == 0
    meets = epoch_intervals(mapping, TTL).where("bucket > -4e18").groupBy("system_id", "session_id", "bucket").count()
    assert meets.agg({"count": "max"}).first()[0] <= 2


def test_empty_mapping(spark):
    none, asked = spark.createDataFrame([], MAPPING), spark.createDataFrame([("a", "s", 1, _at(5), "{{EMAIL_0}}")], REPLIES)
    assert [r["restored_text"] for r in restore_sessions(asked, none, KEYS).collect()] == ["{{EMAIL_0}}"]
    assert unresolved(asked, none, KEYS).count() == 1
