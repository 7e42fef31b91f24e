"""The Spark plans against plain Python on small random inputs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskloom.functions import resolve
from maskloom.functions import rulebook as book
from maskloom.functions.resolve import plain
from maskloom.functions.text import MARK, SPAN_TYPE, marked_values
from maskloom.operators.detect import detect

_PARTS = (
    "61234567 6123-4567 +852 98765432 +86 13800138000 28512345 11234567 A123456(7) AB654321(A) 1234567(8) "
    "H12345678 AB 1234 MX-00-00 4111-1111-1111-1111 4111111111111111 378282246310005 6200000000000005 10.0.0.1 "
    "256.1.1.1 a@b.co x.y@z-w.org Des Voeux Rd MAIN ST Big Stà Stéphane Nathan 12 Rua de Av. Torre Nova 中環德輔道 "
    "富裕臺8號 太古城中心 姓名： 陳大文 João da Silva ALVES TESTE 1990-01-15 １２ , 。 ( ) - + . _ k é \n 　"
).split(" ")


def _texts(n: int) -> list[str]:
    rng = random.Random(7)
    return [
        "".join(rng.choice(_PARTS) + rng.choice(["", " ", " ", "  ", "-"]) for _ in range(rng.randint(1, 12)))
        for _ in range(n)
    ]


def _plain_patterns() -> dict[str, tuple[str, int]]:
    """Rules as they read before any of them was reworked for Java."""
    run = rf"{book.EN_WORD}(?:\s+{book.EN_WORD})*\s+(?:{book.EN_SUFFIX}){book.RIGHT}"
    plain = {r.rule_id: (r.pattern, r.value_group) for r in book.RULES}
    plain["D24"] = (rf"{book.LEFT}\d+\s+{run}", 0)
    plain["D25"] = (rf"{book.LEFT}{run}", 0)
    return plain


def _luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [(d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return len(digits) >= 13 and sum(doubled) % 10 == 0


def _python_spans(text: str) -> set[tuple]:
    out, cards = set(), []
    for rule in book.RULES:
        pattern, group = _plain_patterns()[rule.rule_id]
        flags = re.M | re.S | (re.I if rule.ignore_case else 0)
        for m in re.finditer(pattern, text, flags) if text.strip() else []:
            hit = (m.start(group), m.end(group), rule.rule_id)
            if rule.entity_type == "CREDIT_CARD":
                cards.append(hit)
            elif not (rule.entity_type == "PHONE_NUMBER" and re.match(book.DATE_LIKE, m.group())):
                out.add(hit)
    for s, e, r in cards:
        inside = any(a <= s and b >= e and (a < s or b > e or q < r) for a, b, q in cards)
        if not inside and _luhn(text[s:e]):
            out.add((s, e, r))
    return out


def test_spans_equal_python(spark):
    texts = _texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    every = book.ENTITY_ORDER + book.EXTENDED_ENTITIES
    found = detect(df, entities=every, context="none", resolve=False)
    for row in found.collect():
        got = {(s.start, s.end, s.rule) for s in row.spans}
        assert got == _python_spans(row.text), row.text


def _resolve(text: str, spans: list[tuple]) -> list[tuple]:
    """The resolution steps, one after another, as loops."""
    order = {t: i for i, t in enumerate(book.ENTITY_ORDER)}
    kept = []
    for s in sorted(spans, key=lambda x: (-x[3], x[0], -(x[1] - x[0]), x[4])):
        if not any(k[2] == s[2] and k[0] <= s[0] and k[1] >= s[1] for k in kept):
            kept.append(s)
    merged: list[list] = []
    for s in sorted(kept, key=lambda x: (x[2], x[0], x[1])):
        if merged and merged[-1][2] == s[2] and s[0] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
            merged[-1][3] = max(merged[-1][3], s[3])
        else:
            merged.append(list(s))

    def beaten(x, y):
        if (x[0], x[1]) == (y[0], y[1]):
            return y[3] > x[3] or (y[3] == x[3] and order[y[2]] < order[x[2]])
        return y[0] <= x[0] and y[1] >= x[1]

    left = sorted(s for s in merged if not any(y is not s and beaten(s, y) for y in merged))
    joined: list[list] = []
    for s in left:
        if joined and joined[-1][2] == s[2] and re.search("^( )+$", text[joined[-1][1]:s[0]]):
            joined[-1] = [joined[-1][0], *s[1:]]
        else:
            joined.append(s)
    ends = [s[0] for s in joined[1:]] + [10**9]
    return [(s[0], min(s[1], e), s[2]) for s, e in zip(joined, ends)]


@pytest.mark.parametrize("most", [9, 60])
def test_resolution_equals_loops(spark, most):
    """Up to a few spans, which are compared with each other, and many, which are swept."""
    rng = random.Random(11)
    text = "ab  c d   ef " * 8
    rows = []
    for i in range(800):
        spans = []
        for j in range(rng.randint(1, most)):
            start = rng.randrange(60)
            end = start + rng.randint(1, 14)
            spans.append((start, end, rng.choice(["EMAIL", "PERSON", "HKID"]), rng.choice([0.4, 0.75, 0.95]), f"r{j}", text[start:end]))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"id int, text string, spans {SPAN_TYPE}")
    out = df.select("id", F.expr(resolve.resolved("text", "spans")).alias("done"))
    want = {i: _resolve(t, s) for i, t, s in rows}
    for row in out.collect():
        assert [(s.start, s.end, s.entity_type) for s in row.done] == want[row.id]
        assert all(text[s.start:s.end] == s.value for s in row.done)


@pytest.mark.parametrize("step", ["contained", "merged", "conflicts"])
def test_sweeps_equal_comparisons(spark, step):
    """Each step on a run with ties of every kind."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        spans = []
        for _ in range(rng.randint(1, 14)):
            start = rng.randrange(8)
            end = start + rng.randint(1, 6)
            spans.append((start, end, rng.choice(["EMAIL", "PERSON"]), rng.choice([0.4, 0.75]), f"r{rng.randrange(3)}", "abcdefghijklmnop"[start:end]))
        rows.append((i, "abcdefghijklmnop", spans))
    df = spark.createDataFrame(rows, f"id int, text string, spans {SPAN_TYPE}")
    one, other = {
        "contained": (resolve.without_contained("spans"), resolve.without_contained_swept("spans")),
        "merged": (resolve.merged_same_type("text", "spans"), resolve.merged_same_type_swept("spans")),
        "conflicts": (resolve.without_conflicts("spans"), resolve.without_conflicts_swept("spans")),
    }[step]
    for r in df.select(F.expr(f"array_sort({one})").alias("a"), F.expr(f"array_sort({other})").alias("b")).collect():
        assert r["a"] == r["b"]


def test_a_run_of_very_many_spans(spark):
    """Twenty thousand spans that all overlap a neighbour, in about four times the time of five thousand."""
    def spans(n):
        return [(3 * i, 3 * i + 5, ["EMAIL", "PERSON", "HKID"][i % 3], [0.4, 0.75][i % 2], f"r{i % 5}", "abcde") for i in range(n)]

    def seconds(n):
        df = spark.createDataFrame([("abc" * n + "de", spans(n))], f"text string, spans {SPAN_TYPE}")
        begun = time.perf_counter()
        done = df.select(F.expr(resolve.resolved("text", "spans")).alias("done")).collect()[0]["done"]
        took = time.perf_counter() - begun
        assert len(done) == n and all(a.end <= b.start for a, b in zip(done, done[1:]))
        return took

    seconds(50)
    few = seconds(5_000)
    assert seconds(20_000) < 8 * few + 2


def test_starts_of_few_and_many_pieces(spark):
    """Offsets of marked values, on both sides of the size up to which pieces are measured anew."""
    texts = ["é".join(f"𝒳{MARK}v{i}{MARK}" for i in range(n)) + "." for n in range(1, 8)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.expr(marked_values("text")).alias("got"))
    for r in rows.collect():
        bare = r.text.replace(MARK, "")
        assert len(r.got) == r.text.count(MARK) // 2
        assert all(bare[g.start:g.start + len(g.value)] == g.value for g in r.got)


def test_plain_spans_pass_the_steps(spark):
    """Few spans apart are seen as such; overlapping ones, lone ones, many, and those with blanks between are not."""
    kind = "id int, x array<struct<start int, end int, entity_type string, score double, rule string, value string>>"
    text = "abcdefghij  klmnopq" * 20
    def at(*spans):
        return [(a, b, t, 0.5, "D01", text[a:b]) for a, b, t in spans]
    cases = [at((0, 3, "E"), (5, 8, "E")), at((0, 6, "E"), (5, 8, "P")), at((0, 3, "E")), at((0, 10, "E"), (12, 15, "E")),
             at((0, 10, "E"), (12, 15, "P")), at(*[(5 * i, 5 * i + 2, "E") for i in range(17)])]
    df = spark.createDataFrame(list(enumerate(cases)), kind).withColumn("text", F.lit(text))
    got = {r.id: r.p for r in df.select("id", F.expr(plain("text", "x")).alias("p")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False}
