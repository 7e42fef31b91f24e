"""Short codes for vectors: one codebook for each part, searched by equal averages.

Components become integers, ``floor(scale * x)``, and a vector is cut into equal
consecutive parts.  Each part's codebook starts as that part of the first vectors by
id; a round assigns every part to its nearest entry and then replaces each entry by
the floored mean of its parts.  Everything is integer arithmetic, so results do not
depend on how rows are dealt.

The nearest entry is found by an equal-average search.  Entries are sorted by their
component sum.  As the squared gap of two sums over the dimension is at most the squared
distance, a part looks outward from its own sum, on both sides, until that bound
strictly exceeds the best distance; so an equal distance is still seen, and the
lower index wins.

A round reads the vectors where they are and sends one row of sums for each entry and
task; codebooks hold ``entries`` vectors, whatever the input, and are all that
reaches the driver or is broadcast.

Results for odd input: a row whose vector is null or holds a null, NaN or infinite
component is dropped; rows that repeat an id are coded each, and the codebooks take
them in order of id, then vector, rows without an id last; fewer rows than
entries give fewer entries; an entry without parts stays; errors of rows without a
label are summed together; an empty table gives no rows; extra columns are not read.
Vectors of unequal length, of a length that the parts don't divide, and numbers so
large that a squared distance could pass 64 bits are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


@dataclass(frozen=True)
class Codebook:
    """Entries of one part, and the same sorted by component sum."""

    entries: np.ndarray
    order: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        sums = entries.sum(1)
        order = np.argsort(sums, kind="stable")
        return cls(entries, order, sums[order])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each of ``parts``, and its squared distance."""
        n, width = parts.shape
        own = parts.sum(1)
        right = np.searchsorted(self.sums, own)
        best = np.full(n, np.iinfo(np.int64).max, np.int64)
        index = np.full(n, len(self.order), np.int64)
        for at, step in ((right, 1), (right - 1, -1)):
            at, going = at.copy(), np.arange(n)
            while True:
                inside = (at[going] >= 0) & (at[going] < len(self.order))
                going = going[inside]
                gap = self.sums[at[going]] - own[going]
                # gap² / width > best, in integers: a gap beyond that ends this side.
                going = going[gap * gap <= _times(best[going], width)]
                if not len(going):
                    break
                entry = self.order[at[going]]
                apart = parts[going] - self.entries[entry]
                distance = (apart * apart).sum(1)
                closer = (distance < best[going]) | ((distance == best[going]) & (entry < index[going]))
                found = going[closer]
                best[found], index[found] = distance[closer], entry[closer]
                at[going] += step
        return index, best


def _times(best: np.ndarray, width: int) -> np.ndarray:
    """``best * width``, or the largest number where nothing was found yet."""
    most = np.iinfo(np.int64).max
    return np.where(best > most // width, most, best * width)


def _whole_rows(column: pa.ListArray) -> np.ndarray:
    """Which lists are there and hold finite numbers only."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ends = column.offsets.to_numpy()
    return column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])


def _integers(column: pa.ListArray, parts: int, scale: int, width: int | None = None) -> np.ndarray:
    """The (finite) vectors as integers, one row each."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or (width is not None and lengths.size and lengths[0] != width):
        raise ValueError(f"vectors of several lengths: {sorted({*lengths.tolist(), *([width] if width else [])})}")
    size = int(lengths[0]) if lengths.size else 0
    if size % parts:
        raise ValueError(f"{parts} parts don't divide vectors of length {size}")
    floored = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if floored.size and (size * 2 * float(np.abs(floored).max())) ** 2 >= 2.0**62:
        raise ValueError("numbers too large: their squared distances pass 64 bits")
    return floored.astype(np.int64).reshape(len(column), size)


def _codebooks(vectors: np.ndarray, parts: int) -> list[Codebook]:
    return [Codebook.of(block) for block in np.split(vectors, parts, axis=1)]


def first_codebooks(vectors: DataFrame, key: str, column: str, parts: int = PARTS, entries: int = ENTRIES,
                    scale: int = SCALE) -> list[Codebook]:
    """Codebooks of the first ``entries`` vectors by id; none for an empty table."""
    whole = F.expr(f"`{column}` IS NOT NULL AND forall(`{column}`, x -> coalesce(x - x = 0, false))")
    rows = (
        vectors.where(whole).select(F.col(key).alias("k"), F.col(column).alias("v"))
        .orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect())
    if not rows:
        return []
    return _codebooks(_integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), parts, scale), parts)


def _assigned(batch: pa.ListArray, books: list[Codebook], scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as (row, part, component), entry of each part, squared distance of each part."""
    parts, width = len(books), books[0].entries.shape[1]
    vectors = _integers(batch, parts, scale, parts * width).reshape(len(batch), parts, width)
    found = [book.nearest(vectors[:, p]) for p, book in enumerate(books)]
    return vectors, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def improved(vectors: DataFrame, column: str, books: list[Codebook], scale: int = SCALE) -> list[Codebook]:
    """One round: every part goes to its nearest entry, every entry to the floored mean of its parts."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, (entries, width) = len(books), books[0].entries.shape
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            held = batch.column(0).filter(pa.array(_whole_rows(batch.column(0))))
            if len(held):
                found, index, _ = _assigned(held, books, scale)
                for p in range(parts):
                    np.add.at(sums[p], index[:, p], found[:, p])
                    counts[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    width = books[0].entries.shape[1]
    partial = vectors.select(column).mapInArrow(run, "part int, entry int, n long, total array<long>")
    used = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]).collect()
    shared.unpersist()
    entries = [book.entries.copy() for book in books]
    for row in used:
        entries[row["part"]][row["entry"]] = [row[f"t{i}"] // row["n"] for i in range(width)]
    return [Codebook.of(e) for e in entries]


def trained(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = PARTS,
            entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[Codebook]:
    """Codebooks after ``rounds`` rounds over all vectors; none for an empty table."""
    books = first_codebooks(vectors, key, column, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = improved(vectors, column, books, scale)
    return books


def encoded(vectors: DataFrame, books: list[Codebook], column: str = "embedding", code: str = "code",
            error: str = "error", scale: int = SCALE) -> DataFrame:
    """The rows with whole vectors, with ``code`` (index in each part's codebook, two hex digits each) and ``error``.

    Columns of these names are replaced, all others stay as they are.
    """
    kept = vectors.drop(code, error)
    if not books:
        return kept.where("false").withColumns({code: F.lit("").cast("string"), error: F.lit(0).cast("long")})
    if max(len(book.entries) for book in books) > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    shared, at, names = vectors.sparkSession.sparkContext.broadcast(books), kept.columns.index(column), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_whole_rows(batch.column(at))))
            if batch.num_rows:
                _, index, apart = _assigned(batch.column(at), shared.value, scale)
                codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(codes, pa.string()), pa.array(apart.sum(1))], names=[*names, code, error])

    fields = kept.select("*", F.lit("").alias(code), F.lit(0).cast("long").alias(error)).schema
    return kept.mapInArrow(run, fields)


def decoded(codes: str, books: list[Codebook]) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([book.entries[i] for i, book in zip(bytes.fromhex(codes), books)])


def codebooks_digest(books: list[Codebook]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.entries.ravel()).encode()).hexdigest()


def query(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("vec_id", "embedding", "label")
    books = trained(rows)
    coded = cut_lineage(encoded(rows, books).drop("embedding"))
    # One row for each label and task is shuffled; the rows themselves only if there are too many labels to broadcast.
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    near = (
        "near{n} AS (SELECT rid, p, x, min(d * 1000 + i) AS di FROM (SELECT v.rid, v.p, v.x, e.i, "
        "list_sum(list_transform(list_zip(v.x, e.x), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS d "
        "FROM cut v JOIN book{n} e ON v.p = e.p) s GROUP BY rid, p, x)"
    )
    means = (
        "long{m} AS (SELECT p, i, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT p, di % 1000 AS i, "
        "unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM near{n}) s GROUP BY p, i, j), "
        "book{m} AS (SELECT b.p, b.i, coalesce(a.x, b.x) AS x FROM book{n} b LEFT JOIN "
        "(SELECT p, i, list(m ORDER BY j) AS x FROM long{m} GROUP BY p, i) a ON a.p = b.p AND a.i = b.i)"
    )
    rounds = ", ".join(f"{near.format(n=n)}, {means.format(n=n, m=n + 1)}" for n in range(ROUNDS))
    return f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
parts AS (SELECT unnest(range(0, {PARTS})) AS p),
cut AS (
  SELECT rid, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM whole, parts),
book0 AS (SELECT p, rid AS i, x FROM cut WHERE rid < {ENTRIES}),
{rounds}, {near.format(n=ROUNDS)},
flat AS (SELECT p, i, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM book{ROUNDS}),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM flat),
coded AS (
  SELECT rid, string_agg(printf('%02x', di % 1000), '' ORDER BY p) AS code, sum(di // 1000)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM whole JOIN coded USING (rid), digest
"""


#: The same in SQL, every part against every entry.
ORACLE = _oracle()
