"""License scans by an exact set-similarity join of text blocks with license templates.

A text is a sequence of words; a template is a set of words.  Blocks overlap by half: a
block of width 2h begins every h words, so every passage of up to h + 1 words lies whole in
the block in which it begins.  Each template meets the blocks of the least width that
leaves it a quarter of room.  A block matches if it holds at least
``ceil(threshold * |template|)`` of the template's words.

The join is exact.  All words of templates are ordered by how many documents hold them,
rarest first, counted over the whole corpus; other words can't take part in an overlap
and are left out of the blocks.  With the overlap a template needs, only its first
``|T| - needed + 1`` words and a block's first ``|B| - needed + 1`` words have to be
compared (prefix filter); a block with fewer than ``needed`` words is passed over (length
filter); and a common word counts only if what follows it on both sides can
still make up the rest (positional filter).  What is left is confirmed on the full sets.

Templates are few, documents many: the index over the templates' rare prefix words is
broadcast, a group of templates of bounded size at a time, and texts are read
where they are.  Only one count for each template word and task is shuffled.

Results for odd input: a null or empty text has no words and matches nothing; an
empty template matches nothing; repeated rows are judged each; null ids are kept; a label
found several times is named once; an empty table gives no rows; extra columns are not
read, whatever their names.  A text is never cut, however long.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import arrow_map

#: Share of a template's words that a block has to hold.
THRESHOLD = 0.9
#: Least half width of a block, in words.
LEAST_HALF = 8
#: Characters of templates that one group holds, about; that is what is broadcast at a time.
GROUP_CHARS = 2_000_000
_ASCII = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Fixed value: phrases that count wherever their words stand consecutively.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Fixed value: customary license lines and notices.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions "
     "of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def scan_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_ASCII).split() if text else []


@dataclass(frozen=True)
class Template:
    """``phrase``: the words have to stand consecutively, all of them."""

    text: str
    label: str
    phrase: bool = False

    @functools.cached_property
    def words(self) -> list[bytes]:
        return scan_words(self.text)

    def needed(self, threshold: float) -> int:
        size = len(set(self.words))
        # A tiny slack, as 0.9 * 10 and the like are not exact.
        return size if self.phrase else math.ceil(threshold * size - 1e-9)

    @property
    def half(self) -> int:
        """Half the width of its blocks: a power of two that leaves a quarter of room."""
        return max(LEAST_HALF, 1 << (len(self.words) * 5 // 4 - 1).bit_length()) if self.words else LEAST_HALF


def default_templates() -> list[Template]:
    return [Template(t, label, True) for t, label in PHRASES] + [Template(t, label) for t, label in NOTICES]


def template_groups(templates: list[Template], group_chars: int = GROUP_CHARS) -> Iterator[list[Template]]:
    """The templates in groups of about ``group_chars`` characters; one group at least."""
    group, size = [], 0
    for template in templates:
        if group and size + len(template.text) > group_chars:
            yield group
            group, size = [], 0
        group.append(template)
        size += len(template.text)
    yield group


def document_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of ``vocabulary`` stands; one number for each word comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        totals: dict[bytes, int] = defaultdict(int)
        known = shared.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for word in known.intersection(scan_words(t)):
                    totals[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


class Index:
    """The templates of one group, their words numbered from the rarest to the most frequent."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], threshold: float) -> None:
        words = {w for t in templates for w in t.words}
        self.number = {w: i for i, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}
        self.templates = templates
        self.sets = [np.array(sorted({self.number[w] for w in t.words}), np.int64) for t in templates]
        self.sequences = [np.array([self.number[w] for w in t.words], np.int64) for t in templates]
        self.needed = [t.needed(threshold) for t in templates]
        #: Half width -> word -> (template, position in it) for the words of the templates' prefixes.
        self.prefixes: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, (template, own, needed) in enumerate(zip(templates, self.sets, self.needed)):
            for i in range(len(own) - needed + 1 if needed else 0):
                self.prefixes[template.half][int(own[i])].append((t, i))
        self.prefixes = {half: dict(words) for half, words in self.prefixes.items()}
        self.rare = {half: np.isin(np.arange(len(self.number)), list(words)) for half, words in self.prefixes.items()}

    def candidates(self, block: np.ndarray, half: int) -> list[int]:
        """Templates that pass the prefix, length and positional filters with ``block`` (sorted distinct numbers)."""
        met: dict[int, int] = {}
        size = len(block)
        index = self.prefixes[half]
        for j, word in enumerate(block.tolist()):
            for t, i in index.get(word, ()):
                needed = self.needed[t]
                if size < needed or j > size - needed:
                    continue
                common = met.get(t, 0)
                if common >= 0 and common + 1 + min(len(self.sets[t]) - i - 1, size - j - 1) >= needed:
                    met[t] = common + 1
                else:
                    met[t] = -1
        return [t for t, common in met.items() if common > 0]

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word of the block, half its width, words in common) of every block that matches."""
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(numbers >= 0)
        known = numbers[places]
        for half, rare in self.rare.items():
            at = places[rare[known]] // half
            for block in np.unique(np.concatenate((at, at - 1))).tolist():
                if block < 0:
                    continue
                low, high = np.searchsorted(places, (block * half, (block + 2) * half))
                inside = np.unique(known[low:high])
                for t in self.candidates(inside, half):
                    common = len(np.intersect1d(inside, self.sets[t], assume_unique=True))
                    if common >= self.needed[t]:
                        yield t, block * half, half, common

    def starts(self, words: list[bytes], template: int, first: int, half: int) -> list[int]:
        """Where a phrase begins in the first half of a block."""
        own = self.templates[template].words
        size = len(own)
        ends = min(first + half, len(words) - size + 1)
        return [i for i in range(first, ends) if words[i] == own[0] and words[i : i + size] == own]


@functools.lru_cache(maxsize=2)
def _index(templates: tuple[Template, ...], counts: tuple, threshold: float) -> Index:
    return Index(list(templates), dict(counts), threshold)


def scanned(docs: DataFrame, templates: list[Template] | None = None, key: str = "doc_id", text: str = "text",
            threshold: float = THRESHOLD, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``key``, ``n_words`` and ``found`` of every row.

    ``found`` holds for each match the ``label``, whether it is a ``phrase``, the words it
    ``first`` and last (``last``, exclusive) covers, and the ``containment``.  A phrase is one match
    for each place where its words stand consecutively; another template is one for each
    block that holds enough of its words, and covers that block.  Beyond ``group_chars`` of templates there is
    one more pass, and a row for each pass, so add them up by key.
    """
    templates = default_templates() if templates is None else templates
    kind = docs.schema[key].dataType.simpleString()
    rows, out = docs.select(key, text), None
    for group in template_groups(templates, group_chars):
        counts = document_counts(docs, text, {w for t in group for w in t.words})
        shared = docs.sparkSession.sparkContext.broadcast((tuple(group), tuple(counts.items()), threshold))

        def run(batch, shared=shared):
            index = _index(*shared.value)
            sizes, found = [], []
            for t in batch.column(1).to_pylist():
                words = scan_words(t)
                sizes.append(len(words))
                here = []
                for n, first, half, common in index.matches(words):
                    template = index.templates[n]
                    if template.phrase:
                        here += [(template.label, True, i, i + len(template.words), 1.0) for i in index.starts(words, n, first, half)]
                    else:
                        share = common / len(index.sets[n])
                        here.append((template.label, False, first, min(first + 2 * half, len(words)), share))
                found.append([dict(zip(("label", "phrase", "first", "last", "containment"), h)) for h in sorted(here)])
            return {key: batch.column(0), "n_words": sizes, "found": found}

        part = arrow_map(rows, f"`{key}` {kind}, n_words long, found array<struct<label:string,phrase:boolean,first:long,"
                               "last:long,containment:double>>", run)
        out = part if out is None else out.unionByName(part)
    return out


def query(docs: DataFrame) -> DataFrame:
    def joined(matches: str) -> str:
        return f"array_join(array_sort(array_distinct(transform({matches}, m -> m.label))), ',')"

    base = "filter(found, m -> m.phrase)"
    return scanned(docs).selectExpr(
        "doc_id", "n_words", f"cast(size({base}) as long) AS n_base",
        f"array_min(transform({base}, m -> m.first)) AS first_word",
        f"array_max(transform({base}, m -> m.first)) AS last_word",
        f"{joined(base)} AS base_labels", f"{joined('found')} AS labels",
        "coalesce(array_max(transform(found, m -> m.containment)), 0D) AS score")


def _oracle() -> str:
    phrases = ", ".join(f"({i}, '{label}', {[w.decode() for w in scan_words(t)]})" for i, (t, label) in enumerate(PHRASES))
    sets = ", ".join(
        f"({i}, '{t.label}', {t.half}, {t.needed(THRESHOLD)}, {sorted(w.decode() for w in set(t.words))})"
        for i, t in enumerate(Template(text, label) for text, label in NOTICES))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
placed AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
phrases AS (SELECT * FROM (VALUES {phrases}) p(t, label, ws)),
starts AS (
  SELECT p.r, p.i, f.label FROM placed p JOIN phrases f ON p.word = f.ws[1] JOIN docs d USING (r)
  WHERE list_slice(d.w, p.i + 1, p.i + len(f.ws)) = f.ws),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM starts GROUP BY r),
notices AS (SELECT * FROM (VALUES {sets}) n(t, label, half, needed, ws)),
listed AS (SELECT t, label, half, needed, len(ws) AS n, unnest(ws) AS word FROM notices),
held AS (
  SELECT r, t, label, needed, n, b, count(DISTINCT word) AS common FROM (
    SELECT p.r, l.t, l.label, l.needed, l.n, p.word, unnest([p.i // l.half, p.i // l.half - 1]) AS b
    FROM placed p JOIN listed l USING (word)) s WHERE b >= 0 GROUP BY r, t, label, needed, n, b),
matched AS (SELECT r, label, common / n AS share FROM held WHERE common >= needed),
every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT r, label, share FROM matched UNION ALL SELECT r, label, 1.0::DOUBLE FROM starts) s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""


#: The same in SQL: all words of all templates in all blocks, counted.
ORACLE = _oracle()
