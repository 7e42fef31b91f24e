"""Context of many values in one text: block by block it must be what each value sees by itself."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskloom.functions import context
from maskloom.functions import rulebook as book
from maskloom.functions.text import SPAN_TYPE

_PIECES = ["tel", "phone", "the", "of", "a", ",", "  ", "電話", "Email", "word", "x_y", ".", "mail", "to", "accounts", "Telefon", "ip", "address"]


def test_blocks_equal_single_values(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        text = "".join(rng.choice(_PIECES) + rng.choice([" ", "", ". ", " "]) for _ in range(rng.randrange(50, 500)))
        starts = sorted({rng.randrange(len(text)) for _ in range(rng.choice([5, 70, 130, 200]))})
        rows.append((i, text, [(a, min(a + 3, len(text)), rng.choice(["EMAIL", "PHONE_NUMBER", "IP_ADDRESS"]), 0.4, "r", text[a:a + 3]) for a in starts]))
    df = spark.createDataFrame(rows, f"id int, text string, spans {SPAN_TYPE}")
    blocks = context.boosted("text", "spans", book.ENTITY_ORDER)
    monkeypatch.setattr(context, "_FEW", 10**9)
    single = context.boosted("text", "spans", book.ENTITY_ORDER)
    done = df.select(F.expr(blocks).alias("a"), F.expr(single).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in done)
    scores = [s["score"] for r in done for s in r["a"]]
    assert 0.2 < sum(x > 0.4 for x in scores) / len(scores) < 0.98


@pytest.mark.parametrize("filler", ["of the   "])
def test_no_context_in_a_long_text(spark, filler):
    """Nothing but stop words and blanks before thousands of values."""
    def seconds(n):
        text = filler * (n * 4)
        step = len(text) // n
        df = spark.createDataFrame([(text, [(i * step, i * step + 3, "EMAIL", 0.4, "r", "abc") for i in range(n)])], f"text string, spans {SPAN_TYPE}")
        begun = time.perf_counter()
        done = df.select(F.expr(context.boosted("text", "spans", ["EMAIL"])).alias("a")).collect()[0]["a"]
        assert len(done) == n and {s["score"] for s in done} == {0.4}
        return time.perf_counter() - begun

    seconds(100)
    few = seconds(2_500)
    assert seconds(10_000) < 8 * few + 2
