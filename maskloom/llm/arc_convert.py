"""Converter from legacy ARC archives to WARC.

An ARC file begins with a version block that names the fields of its header lines: version
1 has five, version 2 ten, the last always the declared length of what follows.  The
parser follows these lengths, and the converter makes the WARC record of each: an
identifier from the record's key and digest (so a rerun gives the same), an ISO date from the
14-digit timestamp, the type, and digests of block and payload.  Of records with equal
payloads of at least ``min_bytes`` bytes, that with the largest key is the response and the
others become revisits that refer to it.

Archives are written and read by Spark's own sources (text writer with bytes as they
are, binary files), so they can be in any store.  A file is full at ``file_bytes`` bytes
before compression, whatever the number of its records; a record is never split, so only one that
is longer by itself makes a longer file.  A worker holds a file of each version at most.

Results for odd input: a null payload is empty; a null url leaves out the target; records
with a null key never are what others refer to unless all keys are null, and then all
stay responses; repeated rows with the largest key are all responses; an empty table gives
archives without records and no rows; blanks and control characters in a url, and what
a header line can't hold in a key of text, are escaped.  Keys may be of any type that casts to a
string and back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from maskloom.llm.common import slices
from maskloom.session import cut_lineage, shared_dir

MIN_BYTES = 1000
FILE_BYTES = 32 << 20
#: Field names in the version block of each ARC version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_DATE = "20240101000000"
_ARC_GAP, _WARC_GAP = b"\n", b"\r\n\r\n"
_KEY_HEADER = "X-Page-Id"
#: A revisit names the key of its response beside the record's identifier.
_REFERS_TO_KEY = "X-Refers-To-Page-Id"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _escaped(url: str | None) -> str:
    if not url:
        return "-"
    return "%2D" if url == "-" else quote(url, safe="".join(map(chr, range(33, 127))))


def _key_line(key: str) -> str:
    return quote(key, safe="".join(c for c in map(chr, range(33, 127)) if c != "%"))


def _http(key: str | None, payload: bytes) -> bytes:
    named = "" if key is None else f"{_KEY_HEADER}: {_key_line(key)}\r\n"
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            f"{named}\r\n").encode() + payload


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 maskloom\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {_DATE} text/plain {extra}{len(body)}\n".encode() + body


def arc_record(version: int, url: str | None, block: bytes, offset: int, name: str) -> bytes:
    extra = "" if version == 1 else f"200 {hashlib.sha1(block).hexdigest()} - {offset} {name} "
    return f"{_escaped(url)} 0.0.0.0 {_DATE} text/html {extra}{len(block)}\n".encode() + block


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    block: bytes


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, by the header fields that its version block names and the declared lengths."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, fields = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        size = int(line[-1])
        block = content[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"a record of {size} bytes ends after {len(block)}")
        at = end + 1 + size
        if line[0].startswith("filedesc:"):
            # The second line of the block names the fields, whatever the version number says.
            fields = block.decode().split("\n")[1].split(" ")
            continue
        if fields is None or len(line) != len(fields):
            raise ValueError(f"a header line of {len(line)} fields where {fields and len(fields)} are named")
        said = dict(zip(fields, line))
        yield ArcRecord(said["URL"], said["IP-address"], said["Archive-date"], said["Content-type"], block)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers in lower case, the head as it stands, and the payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return {}, b"", block
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + gap, payload


def key_of(headers: dict[str, str], name: str = _KEY_HEADER) -> str | None:
    """The key that a record's headers state."""
    said = headers.get(name.lower())
    return None if said is None else unquote(said)


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {digest}')}>"


def _sha1(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def warc_record(arc: ArcRecord, refers_to: str | None = None) -> bytes:
    """The WARC record; a revisit of ``refers_to`` (key of the response) keeps the head only."""
    headers, head, payload = http_parts(arc.block)
    key, digest = key_of(headers), _sha1(payload)
    key = f"{arc.url} {arc.date}" if key is None else key
    block = arc.block if refers_to is None else head
    d = arc.date
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", None if arc.url == "-" else arc.url),
        ("WARC-IP-Address", arc.ip),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Profile", _PROFILE if refers_to is not None else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if refers_to is not None else None),
        (_REFERS_TO_KEY, _key_line(refers_to) if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response" if head else arc.kind),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block


def warc_info() -> bytes:
    body = b"software: maskloom\r\nformat: WARC File Format 1.0\r\n"
    return (f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'maskloom')}>\r\n"
            f"WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError("no WARC record where one should begin")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"a record of {size} bytes ends after {len(block)}")
        yield fields, block
        at = end + 4 + size + 4


class _File:
    """A file being filled; it goes out as one row."""

    def __init__(self, between: bytes, head: bytes) -> None:
        self._between, self._records, self.size = between, [head], len(head) + len(between)

    def add(self, record: bytes) -> None:
        self._records.append(record)
        self.size += len(record) + len(self._between)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self._between.join(self._records)], pa.binary())], names=["file"])


def _write(files: DataFrame, path: str, between: bytes) -> None:
    # The text writer puts out a string's bytes as they are; each row is a file.
    (files.select(F.col("file").cast("string")).write.option("lineSep", between.decode())
     .option("maxRecordsPerFile", 1).option("compression", "gzip").text(path))


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
              file_bytes: int = FILE_BYTES) -> None:
    """ARC files of the pages; the hash of its key says if a page goes to a file of version 1 or 2."""

    def run(batches):
        # Version -> number, name and content of its open file.
        files, made = {}, 0
        for batch in slices(batches, 64):
            for k, u, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                version = 1 + zlib.crc32(str(k).encode("utf-8", "surrogatepass")) % 2
                if version not in files:
                    name, made = f"pages-{made}.arc", made + 1
                    files[version] = name, _File(_ARC_GAP, arc_version_block(version, name))
                name, file = files[version]
                file.add(arc_record(version, u, _http(k, (h or "").encode("utf-8", "surrogatepass")), file.size, name))
                if file.size >= file_bytes:
                    yield files.pop(version)[1].batch()
        for _, file in files.values():
            yield file.batch()

    rows = pages.select(F.col(key).cast("string"), url, html)
    _write(rows.mapInArrow(run, "file binary"), path, _ARC_GAP)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _parsed(spark: SparkSession, path: str, parse: Callable, schema: str, weight: Callable) -> DataFrame:
    """Rows that ``parse`` makes of each file, handed on some megabytes at a time."""
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in slices(batches, 1):
            found, held = [], 0
            for row in parse(batch.column(0)[0].as_py()):
                found.append(row)
                held += weight(row)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kinds)], names=kinds.names)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kinds)], names=kinds.names)

    return _files(spark, path).mapInArrow(run, schema)


def arc_digests(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``digest`` and ``bytes`` of each record's payload."""

    def parse(content):
        for arc in parse_arc(content):
            headers, _, payload = http_parts(arc.block)
            yield key_of(headers), hashlib.sha1(payload).digest(), len(payload)

    return _parsed(spark, path, parse, "key string, digest binary, bytes long", lambda row: 100)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES,
            key_kind: str = "long") -> None:
    """WARC files of the ARC files, equal payloads as revisits; keys are compared as ``key_kind``."""
    several = cut_lineage(
        arc_digests(spark, arc_path).where(F.col("bytes") >= min_bytes)
        .groupBy("digest").agg(F.max(F.col("key").cast(key_kind)).alias("response"), F.count("*").alias("n"))
        .where("n > 1 AND response IS NOT NULL").select("digest", F.col("response").cast("string").alias("response")))

    def parse(content):
        for arc in parse_arc(content):
            headers, _, payload = http_parts(arc.block)
            yield key_of(headers), hashlib.sha1(payload).digest(), arc.url, arc.ip, arc.date, arc.kind, arc.block

    parsed = _parsed(
        spark, arc_path, parse, "key string, digest binary, url string, ip string, date string, kind string, block binary",
        lambda row: 200 + len(row[-1]))
    joined = parsed.join(several, "digest", "left").select(
        F.when(~F.col("key").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"),
        "url", "ip", "date", "kind", "block")

    def warc(batches):
        file = None
        for batch in slices(batches, 64):
            for refers_to, *arc in zip(*(c.to_pylist() for c in batch.columns)):
                file = file or _File(_WARC_GAP, warc_info())
                file.add(warc_record(ArcRecord(*arc), refers_to))
                if file.size >= file_bytes:
                    yield file.batch()
                    file = None
        if file:
            yield file.batch()

    _write(joined.mapInArrow(warc, "file binary"), warc_path, _WARC_GAP)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record but for the warcinfo ones; payload sizes and digests of revisits are those they state.

    A record that refers to another by key must do so by the identifier that follows from it.
    """

    def parse(content):
        for fields, block in parse_warc(content):
            if fields["warc-type"] == "warcinfo":
                continue
            headers, _, payload = http_parts(block)
            refers_to = key_of(fields, _REFERS_TO_KEY)
            if fields["warc-type"] == "response":
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            else:
                size, stated = int(headers["content-length"]), fields["warc-payload-digest"]
                digest = base64.b32decode(stated.removeprefix("sha1:")).hex()
                if refers_to is not None and fields["warc-refers-to"] != record_id(refers_to, stated):
                    raise ValueError(f"{fields['warc-record-id']} refers to another record than that of {refers_to}")
            yield (key_of(headers), size, digest, fields["warc-type"], fields["warc-record-id"], refers_to,
                   fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields["warc-date"])

    return _parsed(
        spark, path, parse, "key string, payload_bytes long, payload_digest string, record_type string, record_id string, "
        "refers_to string, refers_to_id string, url string, date string", lambda row: 500)


def query(pages: DataFrame) -> DataFrame:
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    place = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{place}/arc")
    convert(spark, f"{place}/arc", f"{place}/warc", key_kind=kind)
    # A revisit states what it refers to, so nothing has to be joined.
    return read_warc(spark, f"{place}/warc").select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
best AS (SELECT d, max(page_id) AS best FROM p WHERE n >= {MIN_BYTES} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_BYTES} AND page_id IS DISTINCT FROM best AND best IS NOT NULL THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN n >= {MIN_BYTES} AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM p LEFT JOIN best USING (d)
"""
