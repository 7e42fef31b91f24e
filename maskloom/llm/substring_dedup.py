"""Removal of every word that lies in a repeated window of fixed length.

Each window of ``width`` words gets a Rabin-Karp hash (a polynomial over 64-bit word
hashes, modulo 2**64).  Windows that can't repeat are left out before the shuffle:
equal windows have equal minimizers (the least hash of the ``_ANCHOR``-word runs in
them) at equal offsets, so a window whose minimizer occurs at one place only is
unique.  Spark counts the minimizers, then the hashes of the windows that remain,
and the repeated windows of a document merge into maximal removal intervals.

Of exact copies one stands for all when windows are counted; all words of a copy
with at least one window are removed, as each of its windows starts in the others too.

Results for odd input: null, empty and short texts (fewer than ``width`` words) lose
nothing; repeated rows are documents of their own, so each is a copy of the other;
rows with a null id are
treated like others (rows are told apart by a hash of all their columns); very long texts are hashed in whole.
Equal hashes are taken as equal windows (64 bits, and the 8 words of the minimizer
have to agree in a further 64 bits before a window is counted at all).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskloom.llm.common import WordHashes, arrow_map, slices, words_of
from maskloom.session import cut_lineage

WIDTH = 35
_ANCHOR = 8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Windows of one task are merged in portions of about this many before they are shuffled.
_PORTION = 1_500_000


class _Powers:
    """Powers of the base and of its inverse, extended as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_BASE, size, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(_INVERSE, size, 1 << 64))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` words."""
    n = len(hashes)
    powers.to(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers.up[:n], dtype=np.uint64)))
    return _mixed((total[width:] - total[:-width]) * powers.down[: n - width + 1])


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each run of ``width``."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        size += step
    return at


class Windows:
    """Window hashes and minimizers of one text."""

    def __init__(self, width: int) -> None:
        self.width, self.anchor = width, min(_ANCHOR, width)
        self.words, self.powers = WordHashes(), _Powers()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window hash, minimizer hash and minimizer position, for each window."""
        hashes = self.words.of(words)
        inner = rolling(hashes, self.anchor, self.powers)
        at = minimizers(inner, self.width - self.anchor + 1)
        return rolling(hashes, self.width, self.powers), inner[at], at


def _whole(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def removal_intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals [first, end) of the words under repeated windows."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    breaks = np.flatnonzero(np.diff(starts) > width)
    first = starts[np.append(0, breaks + 1)]
    last = starts[np.append(breaks, len(starts) - 1)]
    return list(zip(first.tolist(), (last + width).tolist()))


def _marked(docs: DataFrame, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by their key ``_rk``, and what each loses: window starts, or all of a copy."""
    spark = docs.sparkSession
    keyed = docs.withColumn("_rk", F.xxhash64(*[F.col(c) for c in _hashable(docs)]))

    def anchors(batch):
        work, keys, found, sizes, whole = Windows(width), [], [], [], []
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(t)
            if len(words) < width:
                continue
            _, anchor, at = work.of(words)
            got, n = np.unique(anchor[np.append(True, at[1:] != at[:-1])], return_counts=True)
            keys.append(np.full(len(got) + 1, key, np.int64))
            found.append(_signed(np.append(got, np.uint64(_whole(words)))))
            sizes.append(np.append(n, 1))
            whole.append(np.append(np.zeros(len(got), bool), True))
        if keys:
            return {"_rk": np.concatenate(keys), "anchor": np.concatenate(found), "n": np.concatenate(sizes),
                    "whole": np.concatenate(whole)}

    every = cut_lineage(
        arrow_map(keyed.select("_rk", text), "_rk long, anchor long, n int, whole boolean", anchors, 4096))
    # A table, so that the join below has two plain exchanges and Spark can split a frequent anchor.
    again = cut_lineage(
        every.groupBy("anchor", "whole").agg(F.sum("n").alias("places"), F.min("_rk").alias("stands"))
        .where("places > 1").drop("places"))
    of_row = cut_lineage(
        every.join(again, ["anchor", "whole"])
        .groupBy("_rk")
        .agg(F.collect_set(F.when(~F.col("whole"), F.col("anchor"))).alias("_anchors"),
             F.max("whole").alias("_copy"),
             F.max(F.when(F.col("whole"), F.col("_rk") == F.col("stands"))).alias("_stands"))
    )
    # One exchange of the rows serves both this join and the last one, so both read the same columns.
    dealt = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_rk")
    asked = dealt.join(of_row.where("NOT _copy OR _stands"), "_rk")
    asked = asked.select("_rk", "_anchors", *docs.columns)
    at = 2 + docs.columns.index(text)

    def windows(batches):
        work, portion, size = Windows(width), [], 0

        def merged():
            """Equal windows of the portion are repeated whatever the others hold; one of them tells the rest."""
            hashes = np.concatenate([h for _, h, _ in portion])
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            later = np.append(False, hashes[1:] == hashes[:-1])
            again = later | np.append(later[1:], False)
            place = np.where(later, _mixed(hashes + np.arange(len(hashes)).astype(np.uint64)), hashes)
            keys = np.repeat(np.array([k for k, _, _ in portion], np.int64), [len(h) for _, h, _ in portion])
            starts = np.concatenate([s for *_, s in portion]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(place)), pa.array(keys[order]), pa.array(starts[order]), pa.array(again)],
                names=["place", "_rk", "start", "again"])

        for batch in slices(batches, 128):
            keys, lists, texts = (batch.column(i) for i in (0, 1, at))
            for key, t, asked_for in zip(keys.to_pylist(), texts.to_pylist(), lists):
                hashes, anchor, _ = work.of(words_of(t))
                starts = np.flatnonzero(np.isin(_signed(anchor), asked_for.values.to_numpy()))
                portion.append((key, hashes[starts], starts))
                size += len(starts)
                if size >= _PORTION:
                    yield merged()
                    portion, size = [], 0
        if size:
            yield merged()

    seen = asked.mapInArrow(windows, "place long, _rk long, start int, again boolean")
    # A place has at most one row of each portion, so no window of text makes a hot group.
    starts = (
        seen.withColumn("n", F.count("*").over(Window.partitionBy("place")))
        .where("again OR n > 1").groupBy("_rk").agg(F.collect_list("start").alias("_starts"))
    )
    lost = of_row.where("_copy").select("_rk", "_copy")
    return dealt, dealt.join(starts, "_rk", "left").join(lost, "_rk", "left")


def _hashable(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]


def remove_repeated(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """All columns of ``docs``, with ``_kept`` (kept words joined by one space), ``_n_words``, ``_n_removed``
    and ``_intervals`` (maximal removal intervals of word numbers, end excluded) added."""
    _, rows = _marked(docs, text, width)
    rows = rows.select(*[F.col(c) for c in docs.columns], "_starts", "_copy")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("_kept", T.StringType()),
                           T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()),
                           T.StructField("_intervals", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def cut(batches):
        for batch in slices(batches, 256):
            n = len(docs_columns)
            kept, sizes, removed, intervals = [], [], [], []
            for t, starts, copy in zip(*(batch.column(i).to_pylist() for i in (at, n, n + 1))):
                words = words_of(t)
                if copy:
                    gone = [(0, len(words))]
                else:
                    gone = removal_intervals(np.array(starts or [], np.int64), width)
                rest, end = [], 0
                for a, b in gone:
                    rest += words[end:a]
                    end = b
                rest += words[end:]
                kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
                sizes.append(len(words))
                removed.append(len(words) - len(rest))
                intervals.append([list(g) for g in gone])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(intervals, pa.list_(pa.list_(pa.int32())))],
                names=[*docs_columns, "_kept", "_n_words", "_n_removed", "_intervals"])

    docs_columns = docs.columns
    return rows.mapInArrow(cut, schema)


def query(docs: DataFrame) -> DataFrame:
    done = remove_repeated(docs.select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows, all columns as they were, with repeated passages cut out of ``text``.

    A text that loses nothing stays as it is, white space included.  A row left
    without a word goes, if it had one before.  Columns may have any name.
    """
    names = docs.columns
    # All but the text travels as one value, so that no column can clash with those added on the way.
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]
    packed = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*others, F.lit(0).alias("last")).alias("row"))
    done = remove_repeated(packed, "text", width).where("_n_words = 0 OR _n_removed < _n_words")
    new = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    return done.select(*[(new if c == text else F.col("row").getField(f"c{i}")).alias(c) for i, c in enumerate(names)])
