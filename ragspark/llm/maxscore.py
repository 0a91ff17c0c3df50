"""Exact top-k by integer inner product with MaxScore.

Dimensions are the query's terms. Candidates lie in shards of bounded size. A candidate is in a term's postings where
its value is not the term's most common one, the resting value; the largest step away from rest bounds what a term adds
to the score of a candidate at rest. Terms are taken by descending bound. Candidates pass in blocks of ascending id; before
each block, the terms whose bounds together cannot lift a candidate at rest to the k-th best score so far become
non-essential. A block's candidates come from the essential postings alone; the other terms are probed only for those that
still compete. Groups of query blocks meet groups of shards in the cells of a grid, by an equi-join; within a cell a query's k
best go with it from shard to shard, and only what a shard adds to them goes on to the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .workspace import Workspace, sliced

SHARD = 4096
QUERIES = 256
#: Candidates between two looks at the k-th best score, and terms between two looks at what can still compete.
BLOCK, PROBES = 256, 8
#: Cells a core, over which groups of shards and of query blocks are dealt.
SLOTS = 4
#: Sums below this stay exact in doubles; scores end at 64 bits.
EXACT, LOWEST, HIGHEST = 2.0**52, -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as double. Vectors that are null, or hold a
    null, a NaN or an infinity, are left out, as are rows without vec_id."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` vectors: ids, a matrix in row order, its width. Short vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vecs: list[list[int]] = []

        def flush(n: int) -> pa.RecordBatch:
            width = max([1, *map(len, vecs[:n])])
            m = np.zeros((n, width), np.int64)
            for i, v in enumerate(vecs[:n]):
                m[i, : len(v)] = v
            key = np.array(ids[:n], np.int64)
            del ids[:n], vecs[:n]
            return pa.RecordBatch.from_arrays([pa.array([width]), pa.array([key.tobytes()]), pa.array([m.astype("<i8").tobytes()])], ["width", "ids", "matrix"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            vecs += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield flush(size)
        if ids:
            yield flush(len(ids))

    return rows.mapInArrow(run, "width long, ids binary, matrix binary").withColumn(name, F.monotonically_increasing_id())


def _matrix(raw: bytes, width: int, wide: int) -> np.ndarray:
    m = np.frombuffer(raw, "<i8").reshape(-1, width)
    return m if width == wide else np.pad(m, ((0, 0), (0, wide - width)))


def _exact(m: np.ndarray, exact: bool):
    """Doubles while every sum stays exact in them, else Python's integers."""
    return m.astype(np.float64) if exact else m.astype(object)


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Scores beyond 64 bits as the nearest 64-bit number; only Python's integers can be."""
    return np.minimum(np.maximum(scores, LOWEST), HIGHEST) if scores.dtype == object else scores


class Found(NamedTuple):
    """The best so far of a query, best first, and which of them the last search added."""

    scores: np.ndarray
    ids: np.ndarray
    new: np.ndarray


NOTHING = Found(np.empty(0), np.empty(0, np.int64), np.empty(0, bool))


def _best(found: Found, scores: np.ndarray, ids: np.ndarray, k: int) -> Found:
    scores, ids, new = np.append(found.scores, scores), np.append(found.ids, ids), np.append(found.new, np.ones(len(ids), bool))
    if len(scores) > 4 * k and scores.dtype != object:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids, new = scores[keep], ids[keep], new[keep]
    order = sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k]
    return Found(scores[order], ids[order], new[order])


class MaxScore:
    """One shard. A term (dimension) has a resting value, its most common one, and postings: the candidates, by ascending id,
    that have another, with a bitmap of them and the largest and smallest step away from rest.

    ``search`` returns the k best (scores, ids) of a query, ties to the smaller id; ``improved`` those among the shard's
    candidates and what is ``found`` in other shards, whose k-th best is the first threshold. ``seen`` counts, over all searches, candidates that
    essential postings led to, those skipped without a look, and probes made and spared."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, columns = ids[order], matrix[order].T
        self.rest = np.array([_most_common(c) for c in columns], matrix.dtype)
        self.steps = np.ascontiguousarray(columns - self.rest[:, None])
        self.posted = self.steps != 0
        self.dense = self.posted.all(axis=1)
        self.low, self.high = np.minimum(self.steps.min(axis=1), 0), np.maximum(self.steps.max(axis=1), 0)
        self.seen = {"traversed": 0, "skipped": 0, "probed": 0, "spared": 0, "essential": 0, "nonessential": 0}

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.improved(query_id, query, k, NOTHING)[:2]

    def improved(self, query_id: int, query: np.ndarray, k: int, found: Found) -> Found:
        bound = np.maximum(query * self.low, query * self.high)  # a term adds at most so much to a candidate at rest
        terms = np.argsort(-bound.astype(np.float64), kind="stable")
        base, count = query @ self.rest, len(terms)
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what the terms from a place on add at most
        found = Found(found.scores.astype(self.steps.dtype), found.ids, np.zeros(len(found.ids), bool))
        for begin in range(0, len(self.ids), BLOCK):
            rows = np.arange(begin, min(begin + BLOCK, len(self.ids)))
            full = len(found.ids) == k
            # essential: up to the first place from which all bounds together cannot lift a candidate to the k-th best
            split = int(np.count_nonzero(_clipped(base + left[:-1]) >= found.scores[-1])) if full else count
            if full and not split:
                self.seen["skipped"] += len(rows)
                continue
            essential = terms[:split]
            self.seen["essential"] += split
            self.seen["nonessential"] += count - split
            if not self.dense[essential].any():
                met = self.posted[essential, begin : begin + BLOCK].any(axis=0) if full else np.ones(len(rows), bool)
                self.seen["skipped"] += int(len(rows) - met.sum())
                rows = rows[met]
            rows = rows[self.ids[rows] != query_id]
            self.seen["traversed"] += len(rows)
            whole = len(rows) == min(BLOCK, len(self.ids) - begin)
            score = base + query[essential] @ (self.steps[essential, begin : begin + BLOCK] if whole else self.steps[np.ix_(essential, rows)])
            for at in range(split, count, PROBES):
                live = _clipped(score + left[at]) >= found.scores[-1]
                self.seen["spared"] += int(len(rows) - live.sum()) * (count - at)
                rows, score = rows[live], score[live]
                if not len(rows):
                    break
                part = terms[at : at + PROBES]
                self.seen["probed"] += len(rows) * len(part)
                score = score + query[part] @ self.steps[np.ix_(part, rows)]
            if len(rows):
                found = _best(found, _clipped(score), self.ids[rows], k)
        return found


def _most_common(values: np.ndarray):
    found, n = np.unique(values, return_counts=True)
    return found[np.argmax(n)]


def cells(slots: int, shards: int, blocks: int) -> tuple[int, int]:
    """(groups of shards, groups of query blocks): near ``slots`` cells, in each of which a group of shards meets a group of
    blocks. Shards are copied to as many cells as there are groups of blocks and the other way round, so the copies of
    both grow with the square root of the slots and take the same bytes."""
    ratio = (shards * SHARD) / max(1, blocks * QUERIES)
    across = max(1, min(shards, slots, round((slots * ratio) ** 0.5)))
    return across, max(1, min(blocks, slots // across))


def top_k(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query (vec_id, embedding), its own vec_id
    excluded, by descending score and ascending vec_id; all, if fewer.

    Null, broken and id-less vectors take no part; vectors of unequal length, however long, count as ended by zeros, and one
    of which the others are far shorter costs a shard of its width. Repeated rows are candidates of their own; a query id
    that repeats is one query (its smallest vector). Components and scores beyond 64 bits count as the nearest 64-bit number.
    Empty tables give no rows; other columns are ignored."""
    ws = Workspace(spark, "maxscore")
    shards = ws.put(_packed(quantised(candidates, scale), SHARD, "shard"), "shards")
    asked = quantised(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = ws.put(_packed(asked, QUERIES, "block"), "blocks")
    count = lambda rows, name: rows.agg(F.count("*").alias("n"), F.max(F.shiftright(name, 33)).alias("last")).first()
    held, sent = count(shards, "shard"), count(blocks, "block")
    across, down = cells(SLOTS * spark.sparkContext.defaultParallelism, held["n"], sent["n"])

    def group(name: str, known, groups: int):
        """Blocks, numbered a partition, are dealt to groups in turn, so groups hold equal numbers of them."""
        number = F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) * F.lit((known["last"] or 0) + 1) + F.shiftright(name, 33)
        return F.pmod(number, F.lit(groups)).cast("int")

    every = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    placed = shards.select(group("shard", held, across).alias("across"), "shard", F.col("width").alias("w"), F.col("ids").alias("ids_c"), F.col("matrix").alias("m_c")).withColumn("down", every(down))
    asked = blocks.select(group("block", sent, down).alias("down"), "block", "width", "ids", "matrix").withColumn("across", every(across))
    met = placed.join(asked.hint("merge"), ["down", "across"]).select("down", "across", "shard", "w", "ids_c", "m_c", "block", "width", "ids", "matrix")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, last, shard = None, None, None
        best: dict[int, list[Found]] = {}  # of the slot's queries, by block
        for batch in sliced(frames, 1):
            for y, x, number, w, ids_c, m_c, block, width, ids, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (y, x) != slot:
                    slot, best = (y, x), {}
                wide = max(w, width)
                m, q = _matrix(m_c, w, wide), _matrix(matrix, width, wide)
                query_ids = np.frombuffer(ids, np.int64)
                known = best.get(block) or [NOTHING] * len(query_ids)
                # twice the largest value: steps away from rest
                top = 2 * float(np.abs(m.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
                exact = top * wide < EXACT and all(f.scores.dtype != object for f in known)
                if last != (number, wide, exact):
                    last, shard = (number, wide, exact), MaxScore(np.frombuffer(ids_c, np.int64), _exact(m, exact))
                asked_ = _exact(q, exact)
                best[block] = [shard.improved(i, asked_[j], k, known[j]) for j, i in enumerate(query_ids.tolist())]
                out: tuple[list, list, list] = ([], [], [])
                for i, f in zip(query_ids.tolist(), best[block], strict=True):
                    out[0].extend([i] * int(f.new.sum()))
                    out[1].extend(f.ids[f.new].tolist())
                    out[2].extend(int(v) for v in f.scores[f.new])
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
