"""Token-id files with Re-Pair grammars.

Documents lie in ascending doc_id order in shards of bounded size. A shard's grammar is made by repeatedly replacing
frequent pairs of symbols by nonterminals, commoner pairs before rarer ones where they overlap, until no pair is left that
pays for its rule. The file keeps the shard's alphabet, the rules, each nonterminal's expansion length, the compressed
sequence and the documents' places, so any range of ids is decoded alone; documents are read back that way.

A block: magic, seven unsigned 32-bit counts (alphabet, rounds, rules, symbols, ids, documents, symbol width), then the ids
of the alphabet, the rules of each round, rules as pairs of 32-bit symbols, their expansion lengths, symbols, whether each
doc_id is known, doc_ids (64-bit), starts and lengths. Symbols count from the alphabet's first id on; rules follow it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import TEXT_ROWS, loaded, read_spec
from .workspace import Workspace, sliced

MAGIC = b"RPG2"
#: A shard is closed once it holds so many ids.
SHARD_IDS = 1 << 18
#: A rule takes twelve bytes and each use of it spares two: it pays from this number of uses on.
LEAST = 7
END_ID = 1


def _pairs(seq: np.ndarray, least: int, salt: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places, slots, counts, keys, all): places of pairs that occur ``least`` times or more without overlapping themselves,
    each with a slot, and counts and keys by slot. Counts by hash leave only pairs that may be frequent. While these are
    many, pairs whose slot another one has wait for a later round's hash (all is False); few, or all on demand, are told
    apart exactly."""
    bits = min(18, max(10, len(seq).bit_length() + 1))  # tables of counts and keys that a core's cache holds
    slot = ((((seq[:-1] * np.uint32(salt)) ^ (seq[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits)).astype(np.intp)
    at = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= least)[slot])
    key = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    every = exact or len(at) < max(len(seq) // 4, 1024)
    if every:
        keys, slots = np.unique(key, return_inverse=True)
    else:
        slots, keys = slot[at], np.zeros(1 << bits, np.uint64)
        keys[slots] = key
        mine = np.flatnonzero(keys[slots] == key)
        at, slots = at[mine], slots[mine]
    # in a run of a pair that overlaps itself the first, third, ... count
    run = np.append(True, (np.diff(at) != 1) | (slots[1:] != slots[:-1]))[: len(at)]
    lead = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else at
    free = (np.arange(len(at)) - lead) % 2 == 0
    at, slots = at[free], slots[free]
    counts = np.bincount(slots, minlength=len(keys))
    often = counts[slots] >= least
    return at[often], slots[often], counts, keys, every


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """(symbols, rules, rules of each round, alphabet). A round replaces all frequent pairs, commonest first: of two that
    overlap, the place of the commoner one is taken. Pairs whose places left are fewer than ``least`` get no rule in this
    round. Rounds end when no pair occurs ``least`` times."""
    known = np.zeros(int(ids.max(initial=0)) + 1, bool)
    known[ids] = True
    alphabet = np.flatnonzero(known)
    seq = (np.cumsum(known) - 1).astype(np.uint32)[ids]
    made, salt, exact = len(alphabet), 0x9E3779B1, False
    rules: list[np.ndarray] = []
    while len(seq) > 1:  # a round replaces the commonest pair at least
        at, slots, counts, keys, every = _pairs(seq, least, salt, exact)
        salt = (salt * 0x01000193 + 0x811C9DC4) & 0xFFFFFFFF | 1
        if not len(at):
            if every:
                break
            exact = True
            continue
        rank = np.zeros(len(seq) + 2, np.int64)  # rank[i + 1] is that of place i
        left = at + 1
        rank[left] = counts[slots].astype(np.int64) << np.int64(32) | slots
        taken = np.zeros(len(seq) + 2, bool)
        while len(left):
            now = left[(rank[left] > rank[left - 1]) & (rank[left] >= rank[left + 1])]
            taken[now] = True
            rank[now] = rank[now - 1] = rank[now + 1] = 0
            left = left[rank[left] > 0]
        hit = taken[at + 1]
        at, slots = at[hit], slots[hit]
        used = np.bincount(slots, minlength=len(keys))
        good = np.flatnonzero(used >= least)
        good = good[np.argsort(-used[good], kind="stable")]
        name = np.zeros(len(keys), np.uint32)
        name[good] = made + np.arange(len(good))
        fine = used[slots] >= least
        at, slots = at[fine], slots[fine]
        rules.append(np.stack([keys[good] >> np.uint64(32), keys[good] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        seq[at] = name[slots]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, made, exact = seq[keep], made + len(good), False
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), [len(r) for r in rules], alphabet


def _copied(sizes: np.ndarray, source: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from each source on, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(source - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Grammar:
    """The expansions of all symbols of a shard in one flat table, made round by round."""

    def __init__(self, rules: np.ndarray, rounds: list[int], alphabet: np.ndarray, lengths: np.ndarray | None = None):
        self.rules, self.rounds, self.alphabet = rules.astype(np.int64), rounds, alphabet
        n = len(alphabet)
        sizes = np.ones(n + len(rules), np.int64)
        if lengths is not None:
            sizes[n:] = lengths
        else:
            for a, z in self._spans():
                sizes[n + a : n + z] = sizes[self.rules[a:z]].sum(axis=1)
        self.sizes, self.flat = sizes, None

    def _spans(self) -> Iterator[tuple[int, int]]:
        ends = np.cumsum([0, *self.rounds]).tolist()
        return zip(ends, ends[1:])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols."""
        if self.flat is None:
            self.at = np.cumsum(self.sizes) - self.sizes
            flat = self.alphabet.astype(np.uint32)
            for a, z in self._spans():
                parts = self.rules[a:z].ravel()
                flat = np.concatenate([flat, _copied(self.sizes[parts], self.at[parts], flat)])
            self.flat = flat
        return _copied(self.sizes[symbols], self.at[symbols], self.flat)


def write_block(doc_ids: list, parts: list[np.ndarray], least: int = LEAST) -> bytes:
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    symbols, rules, rounds, alphabet = compress(ids, least)
    sizes = np.array([len(p) for p in parts], np.int64)
    grammar = Grammar(rules, rounds, alphabet)
    width = 2 if len(alphabet) + len(rules) <= 1 << 16 else 4
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, struct.pack("<7I", len(alphabet), len(rounds), len(rules), len(symbols), len(ids), len(parts), width),
        alphabet.astype("<u4").tobytes(), np.array(rounds, "<u4").tobytes(), rules.astype("<u4").tobytes(), grammar.sizes[len(alphabet) :].astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
        known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), (np.cumsum(sizes) - sizes).astype("<u4").tobytes(), sizes.astype("<u4").tobytes(),
    ])


class Block:
    """A block read back; ``range(a, b)`` decodes ids a to b only."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a block")
        letters, rounds, rules, symbols, self.n, docs, width = struct.unpack_from("<7I", raw, 4)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        alphabet, spans = take("<u4", letters), take("<u4", rounds).tolist()
        pairs = take("<u4", 2 * rules).reshape(-1, 2)
        self.grammar = Grammar(pairs, spans, alphabet, take("<u4", rules))
        self.symbols = take(f"<u{width}", symbols).astype(np.int64)
        known, ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids, strict=True)]
        self.starts, self.lengths = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.ends = np.cumsum(self.grammar.sizes[self.symbols])

    def all(self) -> np.ndarray:
        return self.range(0, self.n)

    def range(self, a: int, b: int) -> np.ndarray:
        """Only the symbols that reach into the range are expanded."""
        i, j = np.searchsorted(self.ends, (a, b), "right")
        before = int(self.ends[i - 1]) if i else 0
        return self.grammar.expand(self.symbols[i : j + 1])[a - before : b - before]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i] + self.lengths[i]))


def write_files(spark: SparkSession, docs: DataFrame, tokenizer: str, ws: Workspace) -> DataFrame:
    """The shards (part, before, n_ids, block) of ``docs``, written and reread. part numbers ranges of ascending doc_id
    (null first), before counts the ids of the part's earlier shards. Spark samples the ranges, so their number
    follows its shuffle settings and each holds about as many documents."""
    content = spark.sparkContext.broadcast(read_spec(tokenizer))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = loaded(content.value)
        part, before, n = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list] = ([], [])
        end = np.array([END_ID], encoder.kind).tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal held, before, n
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([write_block(*held)], pa.binary())], ["part", "before", "n_ids", "block"])
            held, before, n = ([], []), before + n, 0
            return out

        for b in sliced(batches, TEXT_ROWS):
            for doc, raw in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, encoder.kind)
                held[0].append(doc)
                held[1].append(ids)
                n += len(ids)
                if n >= SHARD_IDS:
                    yield flush()
        if held[0]:
            yield flush()

    return ws.put(rows.mapInArrow(run, "part int, before long, n_ids long, block binary"), "shards", codec="none")


def read_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, each decoded by its place in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for part, before, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block(raw)
                n = len(block.doc_ids)
                crc = [zlib.crc32(block.document(i).astype("<u4")) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(before + block.starts), pa.array(block.lengths), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "before", "block").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range
    earlier = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return rows.join(earlier, "part").select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes ``docs`` (doc_id, text, ...), appends END_ID to each document, writes the files and reads them back.

    Null and empty texts are the end id alone; a very long text is a shard of its own at most. Rows of one doc_id follow
    each other in the order of their texts; rows without doc_id come first. Other columns are ignored; an empty table gives no rows."""
    return read_files(write_files(spark, docs, tokenizer, Workspace(spark, "tokens")))
