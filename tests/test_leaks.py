"""Leaks anywhere in a text, against every value looked for in every text of its session."""

import random

import pytest

from maskloom.operators.reports import leaks

TEXTS = "system_id string, session_id string, call_seq bigint, masked_text string"
VALUES = "system_id string, session_id string, entity_type string, value string"


def _brute(texts, values):
    return sorted((*t[:3], v[2]) for t in texts for v in set(values) if t[:2] == v[:2] and v[3] and t[3] is not None and v[3] in t[3])


def _got(spark, texts, values):
    found = leaks(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(values, VALUES), ["system_id", "session_id", "call_seq"])
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("letters", ["ab", "a陳\U00020bb7\U0001f600 é", "a.*$\n({1"])
def test_leaks_equal_brute_force(spark, letters):
    rng = random.Random(letters)

    def some(most):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))

    texts = [(rng.choice("xy"), f"s{rng.randrange(3)}", i, rng.choice([some(40), some(6), None])) for i in range(60)]
    values = [(rng.choice("xy"), f"s{rng.randrange(3)}", rng.choice(["EMAIL", "PERSON"]), some(9)) for _ in range(60)]
    values += [(t[0], t[1], "ADDRESS", t[3][2:9]) for t in texts[:20] if t[3]] + values[:5]
    assert _got(spark, texts, values) == _brute(texts, values) != []


def test_glued_short_and_foreign_values(spark):
    texts = [("a", "s", 1, "xjohn@mail.comy and 陳大文先生"), ("a", "s", 2, "{{EMAIL_0}} joh n@mail.com"), ("a", "t", 3, "john@mail.com")]
    values = [("a", "s", "EMAIL", "john@mail.com"), ("a", "s", "PERSON", "陳大"), ("a", "s", "PERSON", "大先"), ("a", "s", "ADDRESS", "x"), ("a", "s", "PHONE_NUMBER", "")]
    assert _got(spark, texts, values) == [("a", "s", 1, "ADDRESS"), ("a", "s", 1, "EMAIL"), ("a", "s", 1, "PERSON")]


def test_no_values_and_no_texts(spark):
    assert _got(spark, [("a", "s", 1, "x")], []) == [] == _got(spark, [], [("a", "s", "EMAIL", "x")])


def test_texts_of_many_blocks_and_repeated_calls(spark):
    texts = [("a", "s", i, f"call {i} of john{i % 40}@mail.com and 612{i % 7}") for i in range(300)]
    values = [("a", "s", "EMAIL", f"john{i}@mail.com") for i in range(60)] + [("a", "s", "PHONE_NUMBER", f"612{i}") for i in range(9)]
    assert _got(spark, texts, values) == _brute(texts, values) != []
    # Two calls of one key count once for each other, as they always have.
    assert _got(spark, [texts[0], texts[0]], values) == sorted(_brute(texts[:1], values) * 4)


def test_no_side_is_broadcast_by_the_size_of_its_files(spark, capsys):
    texts = [("a", f"s{i % 9}", i, f"call {i} of john{i}@mail.com") for i in range(200)]
    values = [("a", f"s{i % 9}", "EMAIL", f"john{i}@mail.com") for i in range(200)]
    found = leaks(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(values, VALUES), ["system_id", "session_id", "call_seq"])
    found.explain()
    plan = capsys.readouterr().out
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3


def _by(spark, few, texts, values):
    key = ["system_id", "session_id", "call_seq"]
    found = leaks(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(values, VALUES), key, few=few)
    return sorted(tuple(r) for r in found.collect())


def test_sessions_of_few_and_of_many_values_find_the_same(spark):
    rng = random.Random("few")

    def some(most):
        return "".join(rng.choice("ab陳 ") for _ in range(rng.randrange(most)))

    texts = [("x", f"s{rng.randrange(4)}", i, some(30)) for i in range(60)] + [("x", None, 70, "abab"), ("x", "s1", None, "abab"), ("x", "s1", 71, None)]
    values = [("x", f"s{min(rng.randrange(8), 4)}", rng.choice(["EMAIL", "PERSON"]), some(6)) for _ in range(60)] + [("x", None, "EMAIL", "ab")]
    wanted = _brute([t for t in texts if None not in t[:3]], [v for v in values if None not in v])
    assert _by(spark, 0, texts, values) == _by(spark, 7, texts, values) == _by(spark, 1024, texts, values) == wanted != []


def test_calls_of_one_key_count_alike_in_lists_and_by_pieces(spark):
    same, other = ("a", "s", 1, "john@mail.com or 6123"), ("a", "t", 1, "john@mail.com")
    texts = [same, same, same, ("a", "s", 2, "6123"), other, other, ("a", "t", 2, "no john"), ("a", "u", 1, "6123, 6124"), ("a", "u", 1, "none"), ("a", "u", 2, "6123")]
    values = [("a", s, "EMAIL", "john@mail.com") for s in "st"] + [("a", s, "PHONE_NUMBER", "6123") for s in "su"]
    wanted = [("a", "s", 1, "EMAIL")] * 9 + [("a", "s", 1, "PHONE_NUMBER")] * 9 + [("a", "s", 2, "PHONE_NUMBER")] + [("a", "t", 1, "EMAIL")] * 4
    wanted += [("a", "u", 1, "PHONE_NUMBER"), ("a", "u", 2, "PHONE_NUMBER")]
    assert _by(spark, 0, texts, values) == _by(spark, 1, texts, values) == _by(spark, 1024, texts, values) == wanted


def test_texts_are_cut_up_only_for_sessions_of_many_values(spark, capsys):
    texts = spark.createDataFrame([("a", "s", i, f"call {i} of john{i}@mail.com") for i in range(20)], TEXTS)
    values = spark.createDataFrame([("a", "s", "EMAIL", f"john{i}@mail.com") for i in range(20)], VALUES)
    for few, cut in ((1024, False), (20, False), (19, True)):
        leaks(texts, values, ["system_id", "session_id", "call_seq"], **({"few": few} if few < 1024 else {})).explain()
        assert ("regexp_extract_all" in capsys.readouterr().out) is cut
