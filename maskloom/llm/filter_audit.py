"""How filters overlap: what each removes, in every order, by truth-table survival words.

A document fails some of up to five filters.  Its survival word has a bit for each of the 32
subsets of filters, set if the document passes every filter of the subset.  The sums of
the words' bits, taken position by position, say how many documents survive each subset;
every figure of every order follows from these sums.  The words of a task are added up
by carry-save adders: three words of one weight become one of that weight and one of
twice the weight, for all 32 positions at once.

The sums go by part and by label.  A task sends 32 numbers for each part and label it has
seen, so neither a large part nor a group of copies is ever gathered; of a document
only its id, a digest of its text and its failures are shuffled.

Results for odd input: a null text is an empty one (it has no words and equals other
empty ones); a null part is the empty string; a row without an id has no
label, is never a copy and never makes another row one; rows that repeat an id are
counted each, and neither is the copy of the other; labels that repeat an id count
once, as soon as one of them is 1; labels of unknown ids are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import arrow_map, words_of
from maskloom.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Per cent of the words that have to be different ones.
DISTINCT = 50
#: Per cent of the characters that may be capitals.
CAPITALS = 3
#: Fixed value: characters that no text may hold.
FORBIDDEN = "#$%&*|"
_NOT_CAPITAL = bytes(i for i in range(256) if not 65 <= i <= 90)
_COPY = FILTERS.index("E")


def own_failures(text: str | None) -> int:
    """The filters, as bits, that a text fails by itself: A, B, C and D."""
    text = text or ""
    words = words_of(text)
    capitals = len(text.encode("utf-8", "surrogatepass").translate(None, _NOT_CAPITAL))
    fails = (
        len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT * len(words),
        100 * capitals > CAPITALS * len(text), any(c in text for c in FORBIDDEN))
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def survival_words(n_filters: int = len(FILTERS)) -> np.ndarray:
    """For each set of failed filters the word whose bit S is set if no filter of S fails."""
    sets = np.arange(1 << n_filters, dtype=np.uint64)
    passes = (sets[:, None] & sets[None, :]) == 0
    return (passes.astype(np.uint64) << sets[None, :]).sum(1).astype(np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each bit set, by carry-save addition."""
    totals, weight, level = np.zeros(32, np.int64), 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) >= 3:
            third = len(level) // 3
            a, b, c = level[: 3 * third].reshape(3, third)
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate((half ^ c, level[3 * third :]))
        # Two words of this weight are left at most.
        totals += weight * ((level[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(0, dtype=np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return totals


def subset_survivors(rows: DataFrame, labels: list[str], part: str = "part", fails: str = "fails") -> DataFrame:
    """``part``, ``label``, ``subset``, ``n``: documents of a part that survive each subset of filters.

    ``fails`` holds a row's failed filters as bits; ``labels`` are boolean columns, besides
    which the label ``all`` counts every row.
    """
    table = survival_words()
    kind = rows.schema[part].dataType.simpleString()

    def run(batch):
        words = table[batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)]
        parts = batch.column(0).dictionary_encode()
        which, names = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary
        kept = {"all": np.ones(len(words), bool)} | {
            name: batch.column(2 + i).to_numpy(zero_copy_only=False).astype(bool) for i, name in enumerate(labels)}
        out = {"part": [], "label": [], "n": []}
        for i, name in enumerate(names):
            for label, rows_of in kept.items():
                out["part"].append(name.as_py())
                out["label"].append(label)
                out["n"].append(positional_counts(words[(which == i) & rows_of]))
        return out

    counted = arrow_map(rows.select(part, fails, *labels), f"part {kind}, label string, n array<long>", run, rows=1 << 20)
    return counted.select("part", "label", F.posexplode("n").alias("subset", "n")).groupBy(
        "part", "label", "subset").agg(F.sum("n").alias("n"))


def _orders(names: str) -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter, filters before it, filters up to it) of every order."""
    out = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, which in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, which, before, before | 1 << which))
            before |= 1 << which
    return out


def order_report(survivors: DataFrame, names: str = FILTERS, good: str = "good", toxic: str = "toxic") -> DataFrame:
    """The figures of every part, order and step from the survivors of all subsets."""
    every = (1 << len(names)) - 1
    wide = survivors.groupBy("part").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("label") == label, F.struct("subset", "n")))).alias(alias)
        for label, alias in (("all", "n"), (good, "g"), (toxic, "t"))])
    count = "coalesce(element_at({0}, {1}), 0L)".format
    # Each order has the filters before a step in |S|! orders and those after it in (rest)!.
    shares = []
    for i in range(len(names)):
        terms = [f"{factorial(s.bit_count()) * factorial(len(names) - 1 - s.bit_count())}L * "
                 f"({count('n', s)} - {count('n', s | 1 << i)})" for s in range(every + 1) if not s >> i & 1]
        shares.append(" + ".join(terms))
    known = wide.select("*", F.expr(f"array({', '.join(shares)})").alias("shares"))
    steps = ", ".join(f"struct('{o}', {step}, {which}, {b}, {a})" for o, step, which, b, a in _orders(names))
    rows = known.select("*", F.expr(f"inline(array({steps}))").alias("filter_order", "step", "which", "before", "after"))

    def lost(column: str) -> Column:
        return F.expr(f"{count(column, 'before')} - {count(column, 'after')}")

    alone = "shiftleft(1, which)"
    return rows.select(
        "part", "filter_order", "step", F.expr(count("n", "after")).alias("kept"), lost("n").alias("removed"),
        F.expr(f"{count('n', 0)} - {count('n', alone)} - ({count('n', 'before')} - {count('n', 'after')})").alias("redundant"),
        F.expr(f"{count('n', f'{every} - {alone}')} - {count('n', every)}").alias("unique_fails"),
        lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), F.expr("shares[which]").alias("shapley"))


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Id, ``part`` and ``fails`` (bits in the order of ``FILTERS``) of every row.

    A row fails E if a row with a smaller id has its text.  The first id of each text
    is found by one aggregate; it then meets its own row on text and id, so copies never share a key.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(text).alias("text"))

    def run(batch):
        texts = [t or "" for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "part": batch.column(1), "own": [own_failures(t) for t in texts],
                "digest": [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]}

    measured = cut_lineage(arrow_map(rows, f"doc_id {kind}, part string, own int, digest binary", run))
    firsts = measured.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = measured.where("doc_id IS NOT NULL").join(
        firsts.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    return known.select("doc_id", "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(1 << _COPY)).alias("fails")).unionByName(
        measured.where("doc_id IS NULL").select("doc_id", "part", F.col("own").alias("fails")))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    def is_one(column: str) -> Column:
        return F.max(F.coalesce(F.col(column) == 1, F.lit(False)))

    failed = failures(docs)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    with_id = failed.where("doc_id IS NOT NULL").join(known.where("good OR toxic"), "doc_id", "left")
    no = F.lit(False)
    rows = with_id.select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).unionByName(
        failed.where("doc_id IS NULL").select("part", "fails", no.alias("good"), no.alias("toxic")))
    return order_report(subset_survivors(rows, ["good", "toxic"]))


_WORD = r"[^\x20\x09-\x0D]+"
#: The same in SQL by the first filter that a document fails in an order.
ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
marks AS (
  SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < {MIN_WORDS}, 100 * len(list_distinct(w)) < {DISTINCT} * len(w),
          100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITALS} * length(t),
          regexp_matches(t, '[{FORBIDDEN}]'), coalesce(doc_id > first, false)] AS f
  FROM docs LEFT JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
kinds AS (SELECT part, f, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM failed GROUP BY part, f),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
named AS (SELECT o, substr('{FILTERS}', o[1], 1) || substr('{FILTERS}', o[2], 1) || substr('{FILTERS}', o[3], 1)
                    || substr('{FILTERS}', o[4], 1) || substr('{FILTERS}', o[5], 1) AS filter_order FROM orders),
gone AS (
  SELECT part, f, n, g, x, o, filter_order,
         CASE WHEN f[o[1]] THEN 1 WHEN f[o[2]] THEN 2 WHEN f[o[3]] THEN 3 WHEN f[o[4]] THEN 4 WHEN f[o[5]] THEN 5 ELSE 6 END AS lost_at
  FROM kinds, named),
figures AS (
  SELECT part, filter_order, i AS step, o[i] AS which,
         sum(CASE WHEN lost_at > i THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN lost_at = i THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f[o[i]] AND lost_at < i THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f[o[i]] AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN lost_at = i THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN lost_at = i THEN x ELSE 0 END) AS toxic_lost
  FROM gone, letters GROUP BY part, filter_order, i, o[i])
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, which))::BIGINT AS shapley
FROM figures
"""
