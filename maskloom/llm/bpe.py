"""Byte-level BPE by a table of distinct words, and decoding by an id-to-piece join.

Spark tasks split the texts into the tokenizer's words and deal them into blocks.  A
block keeps its texts as numbers of its own distinct words; the words go, sorted by
their hash, to the tasks that encode each distinct word of the corpus once and send the
ids back to the blocks, where they are joined by position.  Only distinct words and
compressed word numbers are shuffled, not tokens.  Decoding joins ids with the table of
pieces, which the vocabulary bounds, so that table is broadcast.

Results for odd input: a null text is taken as empty and has no id; special tokens in a
text become their ids, as the library does by default; repeated rows and null keys are
encoded like others; a very long text makes a block of its own; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from maskloom.llm.common import arrow_map, slices
from maskloom.session import shared_dir

#: Fixed value: the word pattern of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text in one block, about.
BLOCK_CHARS = 8_000_000
#: Parts that the distinct words are dealt into, for each shuffle partition.
PARTS_EACH = 2
_CACHED_WORDS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _library(model: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(model)
    found.no_truncation()
    found.no_padding()
    return found


def load(path: str | None = None) -> str:
    """The tokenizer file as text, checked to be one whose words can be encoded on their own."""
    with open(path or default_path(), encoding="utf-8") as f:
        model = f.read()
    said = json.loads(model)
    before = said["pre_tokenizer"] or {}
    plain = (
        said["normalizer"] is None and said["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"])
    )
    if not plain:
        raise ValueError("only byte-level BPE without normalizer or added blanks is supported")
    return model


def pieces(model: str) -> list[bytes]:
    """Bytes of each id, in order of ids."""
    said = json.loads(model)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    # Bytes that do not print are written as the characters from 256 on.
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = dict(said["model"]["vocab"]) | {t["content"]: t["id"] for t in said["added_tokens"]}
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        known = all(c in byte_of for c in token)
        out[i] = bytes(byte_of[c] for c in token) if known else token.encode()
    return out


@functools.cache
def _young() -> np.ndarray:
    """Code points that Unicode 3.2 does not know; of older ones all libraries know the kind."""
    old = unicodedata.ucd_3_2_0.category
    return np.fromiter((old(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


class _Numbers(dict):
    """Each new word gets the next number."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


class Splitter:
    """Cuts a text into the tokenizer's words; joined, they are the text again."""

    def __init__(self, model: str) -> None:
        self._model = model
        special = [t["content"] for t in json.loads(model)["added_tokens"]]
        special.sort(key=len, reverse=True)
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._plain = regex.compile(PATTERN).findall
        # Libraries differ in what they know of younger characters; texts with those go to the tokenizer's own.
        self._common = re.compile("[^\x00-\u021f\u2010-\u2027]").search

    def _words(self, text: str) -> list[str]:
        if not self._common(text) or not _young()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return self._plain(text)
        return [text[a:b] for _, (a, b) in _library(self._model).pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self._special is None or not self._special.search(text):
            return self._words(text)
        out = []
        for i, part in enumerate(self._special.split(text)):
            if part:
                out += [part] if i % 2 else self._words(part)
        return out


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, byte plane by byte plane, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint32)
        wide = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = a.view(np.uint8).reshape(-1, 4)[:, :wide].T.tobytes()
        out.append(struct.pack("<IB", len(a), wide) + planes)
    return zstandard.compress(b"".join(out), 3)


def _unpacked(body: bytes) -> list[np.ndarray]:
    body, at, out = zstandard.decompress(body), 0, []
    while at < len(body):
        n, wide = struct.unpack_from("<IB", body, at)
        at += 5
        planes = np.frombuffer(body, np.uint8, n * wide, at).reshape(wide, n)
        full = np.zeros((n, 4), np.uint8)
        full[:, :wide] = planes.T
        out.append(full.view(np.uint32).reshape(-1))
        at += n * wide
    return out


def _words_body(words: list[str]) -> bytes:
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return zstandard.compress(struct.pack("<I", len(raw)) + np.array([len(w) for w in raw], np.uint32).tobytes()
                              + b"".join(raw), 3)


def _words_from(body: bytes) -> list[bytes]:
    body = zstandard.decompress(body)
    n = struct.unpack_from("<I", body)[0]
    ends = np.cumsum(np.frombuffer(body, np.uint32, n, 4)).tolist()
    at = 4 + 4 * n
    return [body[at + a : at + b] for a, b in zip([0, *ends], ends)]


def _to_blocks(docs: DataFrame, key: str, text: str, model, parts: int) -> DataFrame:
    """Blocks: a row with keys and word numbers, and a row for each part of the block's distinct words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        split, made = Splitter(model.value), 0
        task = TaskContext.get().partitionId()
        codes = _Numbers()
        keys, numbers, sizes, chars = [], [], [], 0

        def block():
            nonlocal made
            number = (task << 32) | made
            made += 1
            used = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
            # Frequent words get small numbers, which pack well.
            order = np.argsort(-np.bincount(used, minlength=len(codes)), kind="stable")
            rank = np.empty(len(codes), np.int64)
            rank[order] = np.arange(len(codes))
            words = list(codes)
            part_of = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % parts for w in words],
                               np.int64)
            yield number, -1, list(keys), _packed(rank[used], np.array(sizes)), None, None
            by_part = np.argsort(part_of, kind="stable")
            starts = np.flatnonzero(np.diff(part_of[by_part], prepend=-1)) if words else []
            for chosen in np.split(by_part, starts[1:]) if len(starts) else []:
                chosen = chosen[np.argsort(rank[chosen])]
                yield (number, int(part_of[chosen[0]]), None, None, _packed(np.diff(rank[chosen], prepend=0)),
                       _words_body([words[i] for i in chosen.tolist()]))

        def rows():
            for n, part, ks, *bodies in block():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n]), pa.array([part], pa.int32()), pa.array([ks], pa.list_(key_type)),
                     *(pa.array([b], pa.binary()) for b in bodies)],
                    names=["block", "part", "keys", "texts", "numbers", "words"])

        for batch in slices(batches, 64):
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(map(codes.__getitem__, split(t)))
                keys.append(k)
                sizes.append(len(found))
                numbers.append(np.array(found, np.int64).astype(np.int32))
                chars += len(t or "")
                if chars >= BLOCK_CHARS:
                    yield from rows()
                    codes, keys, numbers, sizes, chars = _Numbers(), [], [], [], 0
        if keys:
            yield from rows()

    return docs.select(key, text).mapInArrow(
        run, f"block long, part int, keys array<{kind}>, texts binary, numbers binary, words binary")


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """``blocks`` written once to the shared folder, in buckets by block.

    A task writes few blocks, so few files, and reading them back by block needs no
    exchange.  The catalog's entry goes at once; the frame keeps what it needs.
    """
    spark, name = blocks.sparkSession, f"maskloom_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _encoded_words(words: DataFrame, model) -> DataFrame:
    """For each block and part: numbers and ids of its words.  A part comes to one task."""
    known: dict[bytes, tuple[int, ...]] = {}

    def run(batch):
        library, bodies = _library(model.value), []
        for body in batch.column(3).to_pylist():
            asked = _words_from(body)
            new = [w for w in asked if w not in known]
            if len(known) + len(new) > _CACHED_WORDS:
                known.clear()
                new = asked
            for w, e in zip(new, library.encode_batch([w.decode("utf-8", "surrogatepass") for w in new],
                                                      add_special_tokens=False)):
                known[w] = tuple(e.ids)
            ids = [known[w] for w in asked]
            bodies.append(_packed(np.array([len(i) for i in ids]), np.array([x for i in ids for x in i], np.uint32)))
        return {"block": batch.column(0), "numbers": batch.column(2), "ids": bodies}

    return arrow_map(words.select("block", "part", "numbers", "words"), "block long, numbers binary, ids binary", run, 16)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           parts: int | None = None, decoded: bool = False) -> DataFrame:
    """``key`` and ``ids`` (little-endian unsigned 32-bit integers) of every row.

    With ``decoded`` the text of the ids too, by the join of `decode`, in the same pass.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load(path))
    table = spark.sparkContext.broadcast(pieces(model.value)) if decoded else None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _bucketed(_to_blocks(docs, key, text, model, parts or max(64, PARTS_EACH * tasks)), tasks)
    words = blocks.where("part >= 0").select("block", "part", "numbers", "words").repartition("part")
    # A block has at most so many rows here as there are parts.
    back = _encoded_words(words, model).groupBy("block").agg(F.collect_list(F.struct("numbers", "ids")).alias("table"))
    joined = blocks.where("part < 0").select("block", "keys", "texts").join(back, "block", "left")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 1):
            numbers, sizes = _unpacked(batch.column(2)[0].as_py())
            length = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, np.int64)
            start = np.zeros_like(length)
            flat, at = [], 0
            for part in batch.column(3)[0].as_py() or []:
                (which,), (long, ids) = _unpacked(part["numbers"]), _unpacked(part["ids"])
                which = np.cumsum(which.astype(np.int64))
                length[which] = long
                start[which] = at + np.cumsum(long.astype(np.int64)) - long
                flat.append(ids)
                at += len(ids)
            flat = np.concatenate(flat) if flat else np.empty(0, np.uint32)
            keys, ends = batch.column(1).flatten(), np.cumsum(sizes.astype(np.int64))
            out, first, weight = [], 0, 0
            for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                mine = numbers[a:b]
                long = length[mine]
                # Position of each id: its word's start, and on from there.
                place = np.repeat(start[mine] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
                out.append(flat[place].astype("<u4").tobytes())
                weight += len(out[-1])
                if weight > 4_000_000 or i == len(sizes) - 1:
                    columns = [keys.slice(first, len(out)), pa.array(out, pa.binary())]
                    if table is not None:
                        columns.append(pa.array([_text_of(b, table.value) for b in out], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])
                    first, out, weight = i + 1, [], 0

    return joined.mapInArrow(run, f"`{key}` {kind}, ids binary" + (", decoded string" if decoded else ""))


def _text_of(ids: bytes | None, table: list[bytes]) -> str | None:
    """Join of ids with the table of pieces; what is no UTF-8 becomes the replacement character."""
    if ids is None:
        return None
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ids; special tokens stay.

    The id-to-piece table has one row per id of the vocabulary and is broadcast.
    """
    table = encoded.sparkSession.sparkContext.broadcast(pieces(load(path)))
    at, names = encoded.columns.index(ids), encoded.columns

    def run(batches):
        for batch in slices(batches, 64):
            texts = [_text_of(body, table.value) for body in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
