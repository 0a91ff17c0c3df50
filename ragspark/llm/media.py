"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash of its last 64 bytes has zero high bits, between MIN and MAX bytes.
Chunks are compressed and stored once by SHA-256: a task forgets repeats, and copies from several tasks meet
by digest. A document keeps an ordered chunk list. Payloads are rebuilt from stored chunks, each verified against
its digest; payloads of several chunks stream through a task in order, so none is ever held as a whole.

The stored form of a payload is its stored (zstd) chunks in order, then its trailer: each chunk's digest and length, the
chunk count, the payload's length and "CDC1". The trailer is what the table of lists holds of each document, and the
chunks are found through it. The form is hashed as it streams; a trailer made anew from the chunks read must equal the
stored one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import Workspace, sliced

MIN, MAX, CUT_BITS = 4096, 65536, 14
UNIT = 64
LEVEL = 9
#: Bytes whose rolling hash is computed at a time.
HASHED = 1 << 20
#: Bytes of a chunk, and of what follows all chunks, in a trailer.
ENTRY, FOOT = 36, 16
#: Digests that a task remembers to send a chunk once.
REMEMBERED = 200_000
_GEAR = np.random.Generator(np.random.PCG64(29)).integers(0, 1 << 64, 256, np.uint64)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its payload: UTF-8, zeros up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8")
    return len(data), data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the last 64 bytes' table values, each shifted left by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    return h


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(payload)
    if n <= MIN:
        return [n]
    data, found = np.frombuffer(payload, np.uint8), []
    for i in range(0, n, HASHED):  # the 63 bytes before a block reach into its first hashes
        before = min(i, 63)
        found.append(np.flatnonzero(gear(data[i - before : i + HASHED])[before:] >> np.uint64(64 - CUT_BITS) == 0) + (i + 1))
    spots = np.concatenate(found)
    out, begin = [], 0
    while n - begin > MIN:
        i = int(np.searchsorted(spots, begin + MIN))
        end = int(spots[i]) if i < len(spots) else n
        begin = min(end, begin + MAX, n)
        out.append(begin)
    if begin < n:
        out.append(n)
    return out


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def trailer(listed: list[tuple[bytes, int]]) -> bytes:
    """Of (digest, length) of a payload's chunks in order."""
    return b"".join(d + struct.pack("<I", n) for d, n in listed) + struct.pack("<IQ", len(listed), sum(n for _, n in listed)) + b"CDC1"


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload, trailer) of each row; payload is the digest of the whole, null where the only
    chunk's digest, which the trailer has, is that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = []
            for text in b.column(1):
                n, payload = payload_of(text.as_py())
                listed = [(hashlib.sha256(p).digest(), len(p)) for p in chunks(payload)]
                made.append((n, len(payload), hashlib.sha256(payload).digest() if len(listed) > 1 else None, trailer(listed)))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            cols = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload", "trailer"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload binary, trailer binary")


def stored_chunks(docs: DataFrame) -> DataFrame:
    """(digest, z, multi): every distinct chunk once; multi says that some payload has it beside others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        seen: set[bytes] = set()
        for b in sliced(batches):
            keys, packed, multi = [], [], []
            for text in b.column(1):
                parts = chunks(payload_of(text.as_py())[1])
                for p in parts:
                    key = hashlib.sha256(p).digest()
                    if (mark := key + (b"m" if len(parts) > 1 else b"s")) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                    keys.append(key)
                    packed.append(pack.compress(p))
                    multi.append(len(parts) > 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), pa.array(multi, pa.bool_())], ["digest", "z", "multi"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in sliced(batches):
            keep = []
            for key in b.column(0).to_pylist():
                keep.append(key != last)
                last = key
            yield b.filter(pa.array(keep))

    schema = "digest binary, z binary, multi boolean"
    met = docs.mapInArrow(cut, schema).repartition("digest").sortWithinPartitions("digest", F.col("multi").desc())
    return met.mapInArrow(once, schema)


class Rebuilt:
    """Running features of one payload, chunk by chunk."""

    def __init__(self):
        self.sha, self.tail, self.n, self.counts, self.crossings, self.above = hashlib.sha256(), b"", 0, np.zeros(256, np.int64), 0, None
        self.listed, self.form, self.size = [], hashlib.sha256(), 0

    def add(self, chunk: bytes, z: bytes, digest: bytes) -> None:
        self.sha.update(chunk)
        self.tail, self.n = (self.tail + chunk)[-UNIT:], self.n + len(chunk)
        samples = np.frombuffer(chunk, np.uint8)
        self.counts += np.bincount(samples, minlength=256)
        above = samples >= 128
        self.crossings += int(np.count_nonzero(above[1:] != above[:-1])) + int(self.above is not None and self.above != bool(above[0]))
        self.above = bool(above[-1])
        self.listed.append((digest, len(chunk)))
        self.form.update(z)
        self.size += len(z)

    def row(self, payload: bytes) -> tuple:
        end = trailer(self.listed)
        self.form.update(end)
        v = np.arange(256)
        total, square = int((self.counts * v).sum()), int((self.counts * v * v).sum())
        used = np.flatnonzero(self.counts)
        feature = f"mean={total / self.n:.6f};power={square / self.n:.6f};low={used[0]};high={used[-1]};values={len(used)};crossings={self.crossings}"
        if self.sha.digest() != payload:
            raise ValueError(f"rebuilt payload does not match its digest {payload.hex()}")
        return payload, zlib.crc32(self.tail), self.size + len(end), self.form.digest(), feature, hashlib.sha256(end).digest()[:8]


#: Digests are kept as bytes; again: the first bytes of the digest of the trailer made from the chunks read.
_BACK = "payload binary, tail_crc32 long, media_bytes long, media binary, feature string, again binary"


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["payload", "tail_crc32", "media_bytes", "media", "feature", "again"])


def _unpacked(unpack: zstandard.ZstdDecompressor, z: bytes, digest: bytes) -> bytes:
    chunk = unpack.decompress(z, max_output_size=MAX)
    if hashlib.sha256(chunk).digest() != digest:
        raise ValueError(f"stored chunk does not match its digest {digest.hex()}")
    return chunk


def several():
    """Whether a trailer lists more than one chunk."""
    return F.length("trailer") > ENTRY + FOOT


def rebuilt(listed: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_BACK`` from the stored chunks: one for each chunk taken as a payload, one for each payload of several."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in sliced(batches):
            rows = []
            for digest, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                media = Rebuilt()
                media.add(_unpacked(unpack, z, digest), z, digest)
                rows.append(media.row(digest))
            yield _columns(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, media = zstandard.ZstdDecompressor(), None, None
        for b in sliced(batches):
            rows = []
            for payload, digest, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if payload != now:
                    if media:
                        rows.append(media.row(now))
                    now, media = payload, Rebuilt()
                media.add(_unpacked(unpack, z, digest), z, digest)
            if rows:
                yield _columns(rows)
        if media:
            yield _columns([media.row(now)])

    one = store.select("digest", "z").mapInArrow(alone, _BACK)
    lists = listed.where(several()).groupBy("payload").agg(F.min("trailer").alias("trailer"))
    count = ((F.length("trailer") - FOOT) / ENTRY).cast("int")
    refs = lists.select("payload", "trailer", F.explode(F.sequence(F.lit(0), count - 1)).alias("place"))
    refs = refs.select("payload", "place", F.substring("trailer", F.col("place") * ENTRY + 1, F.lit(32)).alias("digest"))
    parts = refs.join(store.where("multi").select("digest", "z"), "digest")
    many = parts.repartition("payload").sortWithinPartitions("payload", "place").select("payload", "digest", "z").mapInArrow(joined, _BACK)
    return one, many


def store_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row
    of ``docs`` (doc_id, text, ...), read back from the chunk store.

    Null and empty texts are a payload of UNIT zeros. Equal texts give equal values; repeated rows give equal
    rows; doc_id may be null. Very long texts are hashed, cut and rebuilt in parts. Other columns are ignored; an empty table
    gives no rows."""
    ws = Workspace(spark, "media")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = ws.put(manifests(rows), "lists")
    store = ws.put(stored_chunks(rows), "chunks", codec="none")
    one, many = rebuilt(listed, store)
    one, many = ws.put(one, "one"), ws.put(many, "many")
    # a payload of one chunk has that chunk's digest; a chunk that is no payload of its own matches no list
    alone = listed.where(~several()).withColumn("payload", F.substring("trailer", 1, 32))
    whole = alone.join(one, "payload", "left").unionByName(listed.where(several()).join(many, "payload", "left"))
    same = F.coalesce(F.substring(F.sha2("trailer", 256), 1, 16) == F.lower(F.hex("again")), F.lit(False))
    checked = F.when(same, F.lower(F.hex("media"))).otherwise(F.raise_error(F.concat(F.lit("stored list does not match its chunks: "), F.hex("payload"))))
    return whole.select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload")).alias("payload_sha256"), "tail_crc32", "media_bytes", checked.alias("media_sha256"), "feature")
