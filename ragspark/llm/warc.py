"""Content-addressed WARC archive.

Two Parquet tables in the shared folder: ``records`` keeps each record's exact header bytes and its payload's
digest, ``payloads`` the bytes of each distinct payload once, compressed, by SHA-256 over the plain bytes. Original records are
rebuilt by joining the two, the digest verified on the bytes read, and parsed from their own bytes. Which page holds a payload is decided on
narrow rows (digest, page_id), with partial aggregation, so groups of equal pages of any size stay spread.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import Workspace, sliced

#: Equal payloads from this size on are stored as one response and revisits.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: Of compression.
LEVEL = 3


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"


def _header(kind: Column, record: Column, target: Column, sha1: Column, length: Column, holder: Column) -> Column:
    """WARC and HTTP header blocks of a record, up to where its payload begins."""
    clean = F.trim(F.regexp_replace(F.coalesce(target, F.lit("")), r"[\r\n]", " "))
    http = F.lit(_HTTP)
    body = F.when(kind == "response", length).otherwise(F.lit(0)) + F.length(http)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), record, F.lit(">\r\nWARC-Date: " + DATE),
        F.lit("\r\nWARC-Target-URI: "), F.when(clean == "", F.concat(F.lit("urn:page:"), record)).otherwise(clean),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:"), sha1,
        F.lit("\r\nWARC-Payload-Length: "), length.cast("string"),
        F.when(kind == "revisit", F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), holder, F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), body.cast("string"), F.lit("\r\n\r\n"), http,
    )


def write_archive(spark: SparkSession, pages: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The tables records (page_id, kind, key, header) and payloads (key, z: the bytes by zstd) of ``pages`` (page_id, url, html), written and
    reread.

    Null html is the empty payload. Of equal payloads of REVISIT_BYTES and more, the largest page_id is the
    response and the others revisit it; when rows repeat that page_id too, each of them is a response. A row
    without page_id is always a response of its own. Record ids are the page_id and a number of the row, so rows that
    repeat a page_id have ids of their own; a null or blank url is named by the record id. Very long pages are kept
    whole. Other columns are ignored."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.select("page_id", "url", F.sha2("body", 256).alias("key"), F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("number"))
    rows = ws.put(rows, "rows")
    groups = rows.where((F.col("bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("key").agg(F.max(F.struct("page_id", "number")).alias("holder"), F.count("*").alias("c")).where("c > 1")
    rows = rows.join(groups.drop("c"), "key", "left")
    kind = F.when(F.col("page_id") < F.col("holder.page_id"), "revisit").otherwise("response")
    record = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("number").cast("string"))
    header = _header(kind, record, F.col("url"), F.col("sha1"), F.col("bytes"), F.concat(F.col("holder.page_id").cast("string"), F.lit(":"), F.col("holder.number").cast("string")))
    records = ws.put(rows.select("page_id", kind.alias("kind"), "key", header.cast("binary").alias("header")), "records")

    # the bytes of a digest come from any of its rows; equal bytes leave once per task and meet by digest
    once = pages.select(body.alias("body")).select(F.sha2("body", 256).alias("key"), "body")
    payloads = ws.put(_first_seen(once).dropDuplicates(["key"]), "payloads", codec="none")
    ws.drop("rows")
    return records, payloads


def _first_seen(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """(key, z) without payloads whose digest this task has met already (the last ``most`` digests are remembered). Payloads
    are compressed before they are moved."""

    def run(batches):
        seen: set[str] = set()
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for b in sliced(batches):
            keys, packed = [], []
            for k, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k in seen:
                    continue
                if len(seen) >= most:
                    seen.clear()
                seen.add(k)
                keys.append(k)
                packed.append(pack.compress(body.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(packed, pa.binary())], ["key", "z"])

    return rows.mapInArrow(run, "key string, z binary")


def _rebuilt(batches) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """page_ids and whole records of batches (page_id, kind, header, key, z)."""
    unpack = zstandard.ZstdDecompressor()
    for b in sliced(batches):
        made = []
        for kind, header, key, z in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            body = b""
            if kind == "response":
                body = b"" if z is None else unpack.decompress(z)
                if z is None or hashlib.sha256(body).hexdigest() != key:
                    raise ValueError(f"stored payload does not match its digest {key}")
            made.append(header + body + _END)
        yield b.column(0), made


def _joined(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Responses with the payload of their digest, and revisits, which have none in their record. Many responses of one
    small payload are a skewed join, which Spark splits; the other side is a single row."""
    columns = ["page_id", "kind", "header", "key", "z"]
    whole = records.where("kind = 'response'").join(payloads, "key", "left").select(*columns)
    return whole.unionByName(records.where("kind = 'revisit'").withColumn("z", F.lit(None).cast("binary")).select(*columns))


def original_records(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record): each record's bytes as they were written: a response's header and the payload of its digest, which is
    verified on the bytes read; a revisit's header alone. A byte of difference, or a missing payload, fails the job."""

    def run(batches):
        for ids, made in _rebuilt(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], ["page_id", "record"])

    return _joined(records, payloads).mapInArrow(run, "page_id long, record binary")


_FIELD = {name: re.compile(rb"\r\n" + name.encode() + rb": ([^\r]*)\r\n") for name in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "WARC-Payload-Length", "WARC-Refers-To", "Content-Length")}


def parsed(record: bytes) -> tuple[str, str, str | None, str, int]:
    """(kind, id, id of the record referred to, SHA-1 and length of the payload) of one record. A response's digest and length
    come from its own bytes and must be those of its header; a revisit's are what its header says."""
    cut = record.index(b"\r\n\r\n") + 4
    head = record[:cut]
    kind, name, digest, length, refers, size = (m[1].decode() if (m := f.search(head)) else None for f in _FIELD.values())
    block, tail = record[cut : cut + int(size)], record[cut + int(size) :]
    if tail != _END or not block.startswith(_HTTP.encode()):
        raise ValueError(f"record {name} is not as long as it says")
    if kind == "response":
        payload = memoryview(block)[len(_HTTP) :]
        if f"sha1:{hashlib.sha1(payload).hexdigest()}" != digest or len(payload) != int(length):
            raise ValueError(f"the header of record {name} does not match its payload")
    return kind, name, refers, digest.removeprefix("sha1:"), int(length)


def read_archive(records: DataFrame, payloads: DataFrame, ws: Workspace) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), parsed from the rebuilt records. A revisit's payload is
    that of the record it refers to; the two must agree."""

    def parse(batches):
        for ids, made in _rebuilt(batches):
            rows = [parsed(r) for r in made]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *cols], ["page_id", "record_type", "id", "refers", "payload_digest", "payload_bytes"])

    # :func:`original_records`, parsed in the worker that rebuilds them
    found = _joined(records, payloads).mapInArrow(parse, "page_id long, record_type string, id string, refers string, payload_digest string, payload_bytes long")
    found = ws.put(found, "found")
    held = found.where("record_type = 'response'").select(F.col("id").alias("refers"), F.struct("page_id", "payload_digest", "payload_bytes").alias("held"))
    revisits = found.where("record_type = 'revisit'").join(held, "refers", "left")
    same = (F.col("held.payload_digest") == F.col("payload_digest")) & (F.col("held.payload_bytes") == F.col("payload_bytes"))
    refers = F.when(same, F.col("held.page_id")).otherwise(F.raise_error(F.concat(F.lit("the record referred to does not match: "), "refers")).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return found.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*columns, refers.alias("refers_to")))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as an archive and reads it back; see :func:`write_archive` and :func:`read_archive`.
    An empty table gives no rows."""
    ws = Workspace(spark, "warc")
    return read_archive(*write_archive(spark, pages, ws), ws)
