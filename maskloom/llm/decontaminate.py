"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case, as words joined by single spaces.  An
item of m characters may differ by k = m * ``error_rate`` edits, so of its k + 1 equal
pieces at least one occurs unchanged.  One automaton finds all pieces of a block of items
in a pass over each text, and Myers' bit-parallel distance verifies the place around a
hit.  Items come in blocks of bounded size, each broadcast on its own; documents are read
where they are and never shuffled.

Results for odd input: null and empty texts match nothing, as do items without a letter
or digit; repeated items are each reported, repeated rows each judged; null ids are kept.
An item too short for an edit (k = 0) has to occur exactly, as whole words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import arrow_map, slices

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: Bytes of items in one block, about; that is what is broadcast at a time.
BLOCK_BYTES = 4_000_000
_words = regex.compile(r"[\p{L}\p{N}\p{M}]+").findall


def normalised(text: str | None) -> str:
    return " ".join(_words(text.lower())) if text else ""


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    return int(length * error_rate)


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their offsets."""
    ends = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


class Pattern:
    """Bit masks of an item for Myers' distance between it and the parts of a text."""

    def __init__(self, item: str) -> None:
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """Least distance to any part of ``text``, and the first end where it is reached."""
        every, high = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = every, 0, self.size
        least, end = score, 0
        for i, c in enumerate(text, 1):
            eq = self.masks.get(c, 0)
            vertical = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (every & ~(across | plus)), plus & across
            score += bool(up & high) - bool(down & high)
            up, down = up << 1 & every, down << 1 & every
            plus, minus = down | (every & ~(vertical | up)), up & vertical
            if score < least:
                least, end = score, i
        return least, end


class Finder:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items, where = [], {}
        for item_id, text in items:
            errors = budget(len(text), error_rate)
            number = len(self.items)
            self.items.append((item_id, text, errors))
            for offset, piece in pieces_of(text, errors):
                where.setdefault(piece, []).append((number, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, tuple(places))
        if where:
            self.automaton.make_automaton()
        self.patterns = functools.lru_cache(maxsize=4096)(
            lambda n: (Pattern(self.items[n][1]), Pattern(self.items[n][1][::-1])))

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, first and end character of the normalised text, distance) for each item found."""
        text = normalised(text)
        if not text or not len(self.automaton):
            return []
        found: dict[int, tuple[int, int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, places in self.automaton.iter(text):
            for number, offset, length in places:
                if number in found:
                    continue
                item_id, item, errors = self.items[number]
                first = last + 1 - length - offset
                if errors == 0:
                    end = first + len(item)
                    if (first == 0 or text[first - 1] == " ") and (end == len(text) or text[end] == " "):
                        found[number] = (item_id, first, end, 0)
                    continue
                # Places that differ by few characters are seen in the same window.
                cell = first // (errors + 1)
                if (number, cell) in tried:
                    continue
                tried.add((number, cell))
                start = max(0, cell * (errors + 1) - errors)
                window = text[start : first - first % (errors + 1) + len(item) + 2 * errors + 1]
                forward, backward = self.patterns(number)
                distance, end = forward.best(window)
                if distance <= errors:
                    _, size = backward.best(window[:end][::-1])
                    found[number] = (item_id, start + end - size, start + end, distance)
        return list(found.values())


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, one bounded block after the other."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for number in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == number).collect() if size else []
        block = [(r["k"], normalised(r["t"])) for r in block]
        yield sorted(((k, t) for k, t in block if t), key=lambda x: (x[0] is None, x[0], x[1]))


def _shared(docs: DataFrame, block, error_rate):
    """The block, broadcast; each worker builds its automaton once."""
    return docs.sparkSession.sparkContext.broadcast((tuple(block), error_rate))


@functools.lru_cache(maxsize=1)
def _finder(items: tuple, error_rate: float) -> Finder:
    return Finder(list(items), error_rate)


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
               error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key``, ``item_id``, ``first``, ``end`` (characters of the normalised text), ``distance``: items in texts."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text)
    out = None
    for block in item_blocks(items, block_bytes=block_bytes):
        shared = _shared(docs, block, error_rate)

        def run(batch, shared=shared):
            finder = _finder(*shared.value)
            got = [(k, *f) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in finder.find(t)]
            return {n: [g[i] for g in got] for i, n in enumerate((key, "item_id", "first", "end", "distance"))}

        found = arrow_map(rows, f"`{key}` {kind}, item_id long, first int, end int, distance int", run)
        out = found if out is None else out.unionByName(found)
    return out


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", error_rate: float = ERROR_RATE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, all columns as they were, whose text holds no item."""
    at = docs.columns.index(text)
    for block in item_blocks(items, block_bytes=block_bytes):
        shared = _shared(docs, block, error_rate)

        def run(batches, shared=shared):
            finder = _finder(*shared.value)
            for batch in slices(batches):
                yield batch.filter(pa.array([not finder.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_items(docs, items)
