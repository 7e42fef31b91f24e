"""Quality rules by the frequency of lines across documents.

Lines are normalised (words joined by one space, ASCII letters in lower case) and
hashed; for each host, the distinct documents that hold a line are counted.  A line is
above the limit of its host if more than ``share`` of the host's documents hold it, and more than ``min_docs``,
which only keeps a host of a few documents from losing what some of them happen to share.  Such lines are removed, and a document that loses more than
``depleted`` of its words is rejected.  Base rules on a document's own text come first.

Counts are summed on the map side, and a line that a third of all documents hold is
joined as two plain exchanges, which Spark splits.

Results for odd input: a null or empty text has no words and fails the base rules; a null
host is a host of its own; repeated rows are documents of their own; null ids are kept;
ties do not matter, as a line is above the limit or it is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import WordHashes, arrow_map, slices, words_of
from maskloom.session import cut_lineage

MIN_DOCS = 5
SHARE = 0.05
DEPLETED = 0.5
MIN_WORDS = 50
#: Per cent of the words that may stand in repeated 3-word windows.
REPEATED = 50
#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes], known: WordHashes, size: int = 3) -> int:
    """Words in windows of ``size`` that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashes = known.of(words)
    window = np.zeros(n, np.uint64)
    for i in range(size):
        window = (window ^ (window >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + n] |= twice
    return int(covered.sum())


def line_hash(line: str) -> int | None:
    """Hash of a normalised line; None without a word."""
    words = words_of(line)
    if not words:
        return None
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words).lower())).view(np.int64))


def _row_key(key: str, text: str, host: str) -> Column:
    """Hash of a row's id, text and host; it tells a null from the value beside it."""
    return F.xxhash64(*[c for name in (key, text, host) for c in (F.col(name).isNull(), F.col(name))])


def _measured(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, host)}
    rows = docs.select(_row_key(key, text, host).alias("_rk"), F.col(key).alias("doc_id"), F.col(host).alias("host"), text)
    known = WordHashes()

    def run(batch):
        out = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words")}
        for t in batch.column(3).to_pylist():
            t = t or ""
            words = words_of(t)
            out["n_words"].append(len(words))
            out["word_chars"].append(len(t) - sum(map(t.count, " \t\n\v\f\r")))
            out["n_symbols"].append(sum(map(t.count, SYMBOLS)))
            out["n_repeat_words"].append(repeated_words(words, known))
            full = [(line, line_hash(line)) for line in t.split("\n")]
            full = [(line, h) for line, h in full if h is not None]
            out["n_dup_lines"].append(len(full) - len({line for line, _ in full}))
            sizes: dict[int, int] = {}
            for line, h in full:
                sizes[h] = sizes.get(h, 0) + len(words_of(line))
            out["lines"].append(list(sizes))
            out["line_words"].append(list(sizes.values()))
        return {"_rk": batch.column(0), "doc_id": batch.column(1), "host": batch.column(2)} | out

    return arrow_map(
        rows, f"_rk long, doc_id {kinds[key]}, host {kinds[host]}, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>", run)


def _above_limit(measured: DataFrame, min_docs: int, share: float) -> DataFrame:
    """``host``, ``line``: hashes of the lines above their host's limit."""
    host = F.xxhash64(F.col("host").isNull(), "host").alias("host")
    sizes = cut_lineage(measured.groupBy(host).agg(F.count("*").alias("n_docs")))
    counts = (
        measured.select(host, F.explode("lines").alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    )
    return cut_lineage(counts.join(sizes, "host").where(F.col("n") > F.col("n_docs") * share).select("host", "line"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
           share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Measures and verdict of every row, with its row key ``_rk`` and ``removed`` (hashes of lines above the limit)."""
    measured = cut_lineage(_measured(docs, key, text, host))
    frequent = _above_limit(measured, min_docs, share)
    held = (
        measured.dropDuplicates(["_rk"])
        .select("_rk", F.xxhash64(F.col("host").isNull(), "host").alias("host"),
                F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
        .select("_rk", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("line_words"))
    )
    lost = held.join(frequent, ["host", "line"]).groupBy("_rk").agg(
        F.sum("line_words").alias("lost"), F.collect_set("line").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    lost_words = F.coalesce("lost", F.lit(0))
    return measured.join(lost, "_rk", "left").select(
        "_rk", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (lost_words <= F.col("n_words") * depleted)).alias("kept"),
        lost_words.cast("long").alias("n_words_removed"), "removed")


def query(docs: DataFrame) -> DataFrame:
    return judged(docs).drop("_rk", "removed")


def without_frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                           **limits) -> DataFrame:
    """The rows that are kept, all columns as they were but for the lines taken out of ``text``."""
    names, schema, at = docs.columns, docs.schema, docs.columns.index(text)
    # The row travels as one value, so its own columns may be called anything.
    said = judged(docs, key, text, host, **limits).where("kept").select("_rk", "removed").dropDuplicates(["_rk"])
    rows = docs.select(_row_key(key, text, host).alias("_rk"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")).join(said, "_rk")
    flat = rows.select(*[F.col("row").getField(n).alias(f"c{i}") for i, n in enumerate(names)], "removed")

    def run(batches):
        for batch in slices(batches, 256):
            texts = []
            for t, removed in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if removed:
                    gone = set(removed)
                    t = "\n".join(line for line in t.split("\n") if line_hash(line) not in gone)
                texts.append(t)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return flat.mapInArrow(run, schema)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

#: The same in SQL: lines and windows as text instead of hashes.
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lines AS (
  SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM docs),
full_lines AS (
  SELECT r, source, line, translate(array_to_string(regexp_extract_all(line, '{_WORD}'), ' '), '{_UPPER}', '{_LOWER}') AS norm,
         len(regexp_extract_all(line, '{_WORD}')) AS n FROM lines WHERE regexp_matches(line, '{_WORD}')),
sizes AS (SELECT source, count(*) AS n_docs FROM docs GROUP BY source),
frequent AS (
  SELECT l.source, norm FROM (SELECT source, norm, count(DISTINCT r) AS n FROM full_lines GROUP BY source, norm) l
  JOIN sizes s ON l.source IS NOT DISTINCT FROM s.source WHERE n > {MIN_DOCS} AND n > n_docs * {SHARE}),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY r),
lost AS (
  SELECT r, sum(n)::BIGINT AS lost FROM full_lines l JOIN frequent f
  ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY r),
places AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (
  SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) s(d) WHERE n > 1 GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(lost, 0)::BIGINT AS n_words_removed
  FROM docs LEFT JOIN dup USING (r) LEFT JOIN lost USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words)
         AND n_words_removed <= n_words * {DEPLETED} AS kept,
       n_words_removed
FROM measured
"""
