"""Near duplicates by min-max hashing.

A document is its set of distinct 5-word shingles.  Under each of ``PERMUTATIONS``
hash functions both the least and the greatest value are kept, so half as many
evaluations give a signature of the same length, each half unbiased for the Jaccard
similarity.  ``BANDS`` bands of ``ROWS`` values bucket the documents; at a similarity
of 0.85 a pair shares no bucket with a probability below one in a million, of 0.8 in
ten thousand.  Pairs that share one are compared on the full sets unless their signatures
agree less than a pair at the threshold does by 7.5 standard deviations.

Documents with equal sets are one class and go on as one.  Candidates are confirmed
on the full sets.  No bucket is expanded into all its pairs: first each class meets the
first class of its buckets; what then is still in several components meets in blocks of
bounded number and bytes, pairs of one component are skipped, and each block returns at most one
link per merge.  Every pair that shares a bucket and could join two components is
tested, so no link is lost.

Results for odd input: a text that is null, empty or without words has an empty set
and is linked with nothing; shorter texts than five words are one shingle; repeated
rows share a class (``kept`` is true for each row with the smallest id, `one_of_each`
keeps one row); rows with a null id take part in links but are never a
component's id, and get their component like others, or null when nobody has an id.
Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.llm.common import WordHashes, arrow_map
from maskloom.llm.components import components
from maskloom.session import cut_lineage

SHINGLE = 5
PERMUTATIONS = 60
BANDS, ROWS = 24, 5
#: Links need 100 * |A and B| >= similarity * |A or B|; this is the default.
SIMILARITY = 85
#: A block of a bucket holds about 256 units; a class is one, and one more for each 64 KB of its set.
_BLOCK = 256
_UNIT = 8192


def shingles(text: str | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; ASCII letters in lower case."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = words.of(found)
    size = min(size, len(hashes))
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - size + 1 + i]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(total ^ (total >> np.uint64(32)))


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fixed = np.random.default_rng(20240229)
    mult = fixed.integers(1, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
    add = fixed.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
    return mult[:, None], add[:, None], fixed.permutation(2 * PERMUTATIONS)[: BANDS * ROWS]


def min_max(values: np.ndarray) -> np.ndarray:
    """Least and greatest value under each function."""
    mult, add, _ = _functions()
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(values), 2048):
        part = mult * values[None, start : start + 2048] + add
        low, high = np.minimum(low, part.min(1)), np.maximum(high, part.max(1))
    return np.concatenate((low, high))


def bands_of(signature: np.ndarray) -> np.ndarray:
    rows = signature[_functions()[2]].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + rows[:, i]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _sketch(signature: np.ndarray) -> bytes:
    """One byte of each value, to estimate similarities with."""
    x = (signature ^ (signature >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(56)).astype(np.uint8).tobytes()


def _node(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def least_agreeing(similarity: int) -> int:
    """How many values of a signature agree at least in a pair as similar as this."""
    n, p = 2 * PERMUTATIONS, similarity / 100
    return max(0, int(n * p - 7.5 * (n * p * (1 - p)) ** 0.5))


def _row_key(key: str, text: str) -> Column:
    """Hash of a row's id and text; it tells a null from the value beside it."""
    return F.xxhash64(*[c for name in (key, text) for c in (F.col(name).isNull(), F.col(name))])


def _signed_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_rk``, id, set size, class and, for its buckets, bands and sketch of each row."""
    rows = docs.select(_row_key(key, text).alias("_rk"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    words = WordHashes()

    def sign(batch):
        sizes, nodes, bands, sketches = [], [], [], []
        for t in batch.column(2).to_pylist():
            values = shingles(t, words)
            sizes.append(len(values))
            signature = min_max(values) if len(values) else None
            nodes.append(_node(values) if len(values) else None)
            bands.append(bands_of(signature) if len(values) else None)
            sketches.append(_sketch(signature) if len(values) else None)
        return {"_rk": batch.column(0), "doc_id": batch.column(1), "n_shingles": sizes, "node": nodes,
                "bands": bands, "sketch": sketches}

    return arrow_map(rows, f"_rk long, doc_id {kind}, n_shingles long, node long, bands array<long>, sketch binary", sign)


def _agreeing(one: pa.Array, other: pa.Array) -> np.ndarray:
    width = 2 * PERMUTATIONS
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, width) for x in (one, other))
    return (a == b).sum(1)


def linked(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < similarity * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _likely(pairs: DataFrame, similarity: int) -> DataFrame:
    least = least_agreeing(similarity)

    def run(batch):
        ok = _agreeing(batch.column(2), batch.column(3)) >= least if batch.num_rows else []
        kept = batch.filter(pa.array(ok, pa.bool_()))
        return {"a": kept.column(0), "b": kept.column(1)}

    return arrow_map(pairs.select("a", "b", "a_sketch", "b_sketch"), "a long, b long", run, 4096)


def _confirmed(pairs: DataFrame, similarity: int) -> DataFrame:
    def run(batch):
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity)
              for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        kept = batch.filter(pa.array(ok, pa.bool_()))
        return {"a": kept.column(0), "b": kept.column(1)}

    return arrow_map(pairs.select("a", "b", "a_set", "b_set"), "a long, b long", run, 256)


def _with(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col(what).alias(f"{side}_{what}")), side)
    return pairs


def _merging_links(left: list[dict], right: list[dict] | None, similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """Links between members of different components, at most one per merge; the likeliest pairs first."""
    members = left + (right or [])
    sketch = [np.frombuffer(m["sketch"], np.uint8) for m in members]
    comps = np.unique([m["comp"] for m in members], return_inverse=True)[1]
    n, least = len(left), least_agreeing(similarity)
    split = range(n) if right else range(1, n)
    found_a, found_b, found_n = [], [], []
    table = np.stack(sketch)
    for i in split:
        others = np.arange(n, len(members)) if right else np.arange(i)
        agreeing = (table[others] == table[i]).sum(1)
        ok = (agreeing >= least) & (comps[others] != comps[i])
        found_a.append(np.full(ok.sum(), i))
        found_b.append(others[ok])
        found_n.append(agreeing[ok])
    if not found_a:
        return []
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    parent = list(range(comps.max() + 1))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, np.ndarray] = {}

    def values(i):
        if i not in sets:
            sets[i] = np.frombuffer(members[i]["set"], np.uint64)
        return sets[i]

    out = []
    for k in np.argsort(-np.concatenate(found_n), kind="stable"):
        i, j = int(a[k]), int(b[k])
        x, y = root(comps[i]), root(comps[j])
        if x != y and linked(values(i), values(j), similarity):
            parent[x] = y
            out.append((members[i]["node"], members[j]["node"]))
    return out


def _links_in_blocks(open_rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between components inside the buckets of ``open_rows`` (band, node, comp, units)."""
    sizes = open_rows.groupBy("band", "comp").agg(F.sum("units").alias("n"))
    small = sizes.where(F.col("n") < _BLOCK).groupBy("band").agg(F.sum("n").alias("n_small"))
    # A large component has blocks of its own, so that pairs inside it need no task at all.
    block = F.when(
        F.col("n") >= _BLOCK,
        F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / _BLOCK))),
    ).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("n_small") / _BLOCK)))
    dealt = (
        open_rows.join(sizes, ["band", "comp"]).join(small, "band", "left")
        .select("band", "node", "comp", block.alias("block"))
    )
    full = (
        dealt.join(sets, "node").groupBy("band", "block")
        .agg(F.collect_list(F.struct("node", "comp", "sketch", "set")).alias("members"),
             F.min("comp").alias("low"), F.max("comp").alias("high"))
    )
    heads = dealt.groupBy("band", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    ahead = heads.select("band", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meetings = (
        heads.join(ahead, "band").where("block < block2 AND NOT (low = high AND low2 = high2 AND low = low2)")
        .select("band", "block", "block2")
    )
    other = full.select("band", F.col("block").alias("block2"), F.col("members").alias("others"))
    across = meetings.join(full, ["band", "block"]).join(other, ["band", "block2"]).select("members", "others")
    alone = full.where("low <> high").select("members", F.lit(None).cast(full.schema["members"].dataType).alias("others"))

    def run(batch):
        out = []
        for left, right in zip(batch.column(0), batch.column(1)):
            out += _merging_links(left.as_py(), right.as_py(), similarity)
        return {"a": [a for a, _ in out], "b": [b for _, b in out]}

    return arrow_map(alone.unionByName(across), "a long, b long", run, 4)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``_rk`` (row key), ``doc_id``, ``n_shingles``, ``component_id``, ``node`` and ``component`` (label) of every row.

    ``similarity`` is the least one of a link, in hundredths.
    """
    signed = cut_lineage(_signed_rows(docs, key, text))
    classes = cut_lineage(
        signed.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("first_id"), F.min("_rk").alias("_rk"), F.count("*").alias("copies"),
             F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
             (1 + F.floor(F.first("n_shingles") / _UNIT)).alias("units"))
    )
    buckets = classes.select("node", "units", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(buckets.join(shared, "band").select("band", "leader", "node", "n", "units"))

    words = WordHashes()

    def full_sets(batch):
        return {"node": batch.column(0), "sketch": batch.column(1),
                "set": [shingles(t, words).tobytes() for t in batch.column(2).to_pylist()]}

    asked = members.select("node").distinct().join(classes.select("node", "_rk", "sketch"), "node")
    # Repeated rows have one row key and one set.
    sets = cut_lineage(arrow_map(
        docs.select(_row_key(key, text).alias("_rk"), F.col(text).alias("text")).join(asked, "_rk")
        .select("node", "sketch", "text"),
        "node long, sketch binary, set binary", full_sets).dropDuplicates(["node"]))

    pairs = members.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = cut_lineage(_confirmed(_with(_likely(_with(pairs, sets, "sketch"), similarity), sets, "set"), similarity))
    labels = components(links)
    # A bucket of two has been decided by its only pair.
    rows = members.where("n > 2").join(labels, "node", "left").select(
        "band", "node", "units", F.coalesce("component", "node").alias("comp"))
    # Two independent hashes of a bucket's classes, 128 bits that don't depend on their order.
    content = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"h{i}") for i in (1, 2)]
    several = (
        rows.groupBy("band")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), *content)
        # Buckets of the same classes need one look.
        .where("low <> high").groupBy("n", "h1", "h2").agg(F.min("band").alias("band"))
    )
    open_rows = cut_lineage(rows.join(several.select("band"), "band"))
    more = cut_lineage(_links_in_blocks(open_rows, sets, similarity))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    ids = (
        classes.select("node", "first_id", "copies").join(labels, "node", "left")
        .where("copies > 1 OR component IS NOT NULL")
        .select("node", "first_id", F.coalesce("component", "node").alias("component"))
    )
    smallest = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = ids.join(smallest, "component").select("node", "component", "component_id")
    return (
        signed.select("_rk", "doc_id", "n_shingles", "node").join(found, "node", "left")
        .select("_rk", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node",
                F.coalesce("component", "node").alias("component"))
    )


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The rows, all columns as they were, of one document per group: that with the smallest id."""
    # All rows with the smallest id, or all without one if nobody has an id; empty sets are linked with nothing and stay.
    found = near_duplicates(docs, key, text, similarity).where("doc_id <=> component_id")
    empty = F.when(F.col("n_shingles") == 0, F.col("_rk"))
    kept = found.groupBy("component", empty.alias("e")).agg(F.min("_rk").alias("_rk")).select(
        "_rk", F.col("e").isNotNull().alias("_empty"))
    # Rows meet by their key already, so numbering those that repeat needs no further exchange.
    again = F.row_number().over(Window.partitionBy("_rk").orderBy("_rk"))
    # The row travels as one value, so its own columns may be called anything.
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    rows = docs.select(_row_key(key, text).alias("_rk"), whole.alias("row")).join(kept, "_rk").withColumn("_n", again)
    return rows.where("_n = 1 OR _empty").select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(names)])
