"""Embedding and vector operators: offline model, exact and approximate neighbours, drift, anomalies, caches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ragspark.functions import text as T
from ragspark.functions.vector import cosine
from ragspark.sources.shared import bounded_batches

DIMENSIONS = 256
SPARSE_DIMENSIONS = 1_000_000
# fixed values: task prefixes (query, document)
PROMPTS = {"none": ("", ""), "nomic": ("search_query: ", "search_document: "), "mxbai": ("Represent this sentence for searching relevant passages: ", "")}
#: Vectors in one block of the neighbour search, and digits that decide ties. Scores that a meeting of two blocks holds at a time,
#: and words whose buckets a worker keeps.
BLOCK_ROWS, QUERY_ROWS, DIGITS = 4096, 512, 9
SCORES, KNOWN = 1 << 18, 100_000


def prompted(text: Column, model: str, query: bool = False) -> Column:
    return F.concat(F.lit(PROMPTS[model][0 if query else 1]), text)


def hashed_words(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, bucket, weight): L2-normalised counts of tokens hashed by FNV-1a, without a shuffle."""
    rows = bow_vectors(docs, "doc_id", dimensions).select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return rows.where("weight > 0").withColumn("bucket", F.col("bucket").cast("long"))


class _Buckets(dict):
    """Words to buckets, for as many words as stay in memory."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = T.FNV_BASIS
        for c in word.encode():
            h = (h ^ c) * T.FNV_PRIME & T.U32
        self[word] = h % self.dimensions
        return self[word]


def _bow(words: pd.Series, known: _Buckets) -> np.ndarray:
    """Normalised counts, a row a list of words; none is empty."""
    n = np.empty((len(words), known.dimensions))
    for row, w in zip(n, words, strict=True):
        row[:] = np.bincount([known[t] for t in w], minlength=known.dimensions)
    n /= np.sqrt(np.einsum("ij,ij->i", n, n))[:, None]  # sums of whole numbers
    return n


def bow_vectors(rows: DataFrame, key: str, dimensions: int = DIMENSIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, embedding array<double>): :func:`hashed_words` as dense vectors, made in one pass without a shuffle. Words are
    cut by Spark's expression; rows without words are left out. Columns to ``keep`` stay beside the vector, so nothing has to be joined
    to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Buckets(dimensions)
        for f in frames:
            f = f[f.w.map(len) > 0]
            yield f[[key, *keep]].assign(embedding=list(_bow(f.w, known)) if len(f) else [])

    bounded_batches(rows.sparkSession)
    words = rows.select(F.col(key).cast("long").alias(key), *keep, T.bow_tokens("text").alias("w"))
    kept = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return words.mapInPandas(run, f"{key} long, {kept}embedding array<double>")


def bow_blocks(rows: DataFrame, key: str, dimensions: int = DIMENSIONS, size: int = 4096) -> DataFrame:
    """:func:`bow_vectors` as the blocks (width, ids, matrix) that :func:`neighbours` multiplies, without rows of arrays between."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Buckets(dimensions)
        for f in frames:
            f = f[f.w.map(len) > 0]
            for i in range(0, len(f), size):
                part = f.iloc[i : i + size]
                yield pd.DataFrame({"width": [dimensions], "ids": [part[key].to_numpy(np.int64).tobytes()], "matrix": [_bow(part.w, known).tobytes()]})

    bounded_batches(rows.sparkSession)
    words = rows.select(F.col(key).cast("long").alias(key), T.bow_tokens("text").alias("w"))
    return words.mapInPandas(run, "width int, ids binary, matrix binary")


def sparse_counts(rows: DataFrame, key: str, dimensions: int = SPARSE_DIMENSIONS) -> DataFrame:
    """(key, slot, n): term frequencies at FNV-1a of the term; colliding terms add up."""
    words = rows.select(key, F.explode(T.bow_tokens("text")).alias("token"))
    return words.groupBy(key, F.pmod(T.fnv1a(F.col("token")), F.lit(dimensions)).alias("slot")).agg(F.count("*").alias("n"))


def _packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Blocks of ids and row-major doubles. Vectors of another width than a block's first open a new block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, g in f.groupby(f[vector].map(len), sort=True):
                for i in range(0, len(g), size):
                    part = g.iloc[i : i + size]
                    yield pd.DataFrame({"width": [width], "ids": [part[key].to_numpy(np.int64).tobytes()], "matrix": [np.array(part[vector].tolist(), np.float64).tobytes()]})

    bounded_batches(rows.sparkSession)
    return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, "width int, ids binary, matrix binary")


def grid(slots: int, ratio: float) -> tuple[int, int]:
    """(groups of queries, groups of candidates) whose product is near ``slots``: each block of queries is copied to each
    group of candidates and the other way round, so with ``ratio`` bytes of candidates to a byte of queries both cost the same."""
    columns = min(slots, max(1, round((slots * ratio) ** 0.5)))
    return max(1, slots // columns), columns


def plan_bytes(rows: DataFrame) -> int:
    """Spark's own estimate; of files, it knows their size."""
    return max(1, int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def met_blocks(asked: DataFrame, blocks: DataFrame, slots: int, ratio: float) -> DataFrame:
    """Pairs of blocks of queries (q_*) and of candidates (c_*), both with ``width``: every block of one meets every
    block of the other of its width once, dealt over the cells of a grid. Blocks are numbered in turn, so groups are even."""
    bounded_batches(blocks.sparkSession)
    rows, columns = grid(slots, ratio)
    turn = lambda n: F.pmod(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.spark_partition_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_row", turn(rows)).withColumn("_column", every(columns))
    right = blocks.withColumn("_column", turn(columns)).withColumn("_row", every(rows))
    return right.join(left, ["_row", "_column", "width"]).drop("_row", "_column")


def neighbours(queries: DataFrame, corpus: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k nearest by cosine, exact. queries (query_id, embedding), corpus
    (chunk_id, embedding), either also as blocks (width, ids, matrix). Zero vectors score 0; ties, at DIGITS digits, go to the
    smaller chunk_id.

    Blocks of queries meet blocks of the corpus in the cells of a grid; each meeting is one matrix product whose k
    best survive, so the shuffle to the final ranking holds k rows a query and block."""
    named = lambda blocks, by: blocks.select("width", F.col("ids").alias(f"{by}_ids"), F.col("matrix").alias(f"{by}_m"))
    packed = lambda rows, key, size: rows if "matrix" in rows.columns else _packed(rows, key, "embedding", size)
    dealt, asked = named(packed(corpus, "chunk_id", BLOCK_ROWS), "c"), named(packed(queries, "query_id", QUERY_ROWS), "q")
    slots = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, ids_c, m_c, ids, m in zip(f.width, f.c_ids, f.c_m, f.q_ids, f.q_m, strict=True):
                c, every = (np.frombuffer(x, np.float64).reshape(-1, width) for x in (m_c, m))
                norm, cid, qid = np.linalg.norm(c, axis=1)[None, :], np.frombuffer(ids_c, np.int64), np.frombuffer(ids, np.int64)
                step = max(1, SCORES // max(1, len(c)))
                for i in range(0, len(every), step):
                    q = every[i : i + step]
                    size = np.linalg.norm(q, axis=1)[:, None] * norm
                    score = np.round(np.divide(q @ c.T, size, out=np.zeros(size.shape), where=size > 0), DIGITS)
                    yield _nearest_of(qid[i : i + step], cid, score, k)

    found = met_blocks(asked, dealt, slots, plan_bytes(corpus) / plan_bytes(queries)).mapInPandas(run, "query_id long, chunk_id long, score double")
    if least is not None:
        found = found.where(F.col("score") >= least)
    return ranked(found, k)


def _nearest_of(qid: np.ndarray, cid: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each row of ``score``, ties to the smaller of ``cid``."""
    order = np.argsort(cid, kind="stable")
    best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
    return pd.DataFrame({"query_id": np.repeat(qid, best.shape[1]), "chunk_id": cid[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})


def postfiltered(queries: DataFrame, corpus: DataFrame, k: int, keep: Column, times: int = 4) -> DataFrame:
    """The mode for filters that a store cannot take: ``times * k`` neighbours, then the filter over the corpus's columns,
    then the first k. Fewer than k may be left."""
    wide = neighbours(queries, corpus, times * k).join(corpus.where(keep).select("chunk_id"), "chunk_id", "left_semi")
    return ranked(wide, k)


def ranked(hits: DataFrame, k: int, key: str = "chunk_id", order: list[str] | None = None) -> DataFrame:
    """The k first by ``order``, columns that stay, then by score and key."""
    by = Window.partitionBy("query_id").orderBy(*(order or []), F.col("score").desc(), key)
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", key, "score", *(order or []))


#: Largest code, and columns whose products of codes stay exact in single precision (127 * 127 * 1024 < 2 ** 24).
TOP_CODE, EXACT_COLUMNS = 127, 1024


def quantised(rows: DataFrame, key: str, vector: str = "embedding", size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (width, ids, scales, codes) of one-byte codes: a vector's largest value becomes 127, its scale is that value / 127.
    Written as they are, codes take an eighth of the vectors' bytes as doubles and go into the product unchanged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, g in f.groupby(f[vector].map(len), sort=True):
                for i in range(0, len(g), size):
                    x = np.array(g[vector].iloc[i : i + size].tolist(), np.float64)
                    scale = np.abs(x).max(axis=1, initial=0) / TOP_CODE
                    codes = np.floor(x / np.where(scale > 0, scale, 1)[:, None] + 0.5).astype(np.int8)
                    yield pd.DataFrame({"width": [width], "ids": [g[key].iloc[i : i + size].to_numpy(np.int64).tobytes()], "scales": [scale.astype(np.float32).tobytes()], "codes": [codes.tobytes()]})

    bounded_batches(rows.sparkSession)
    return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, "width int, ids binary, scales binary, codes binary")


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of one-byte codes, as exact 32-bit integers."""
    total = np.zeros((len(a), len(b)), np.int32)
    for i in range(0, a.shape[1], EXACT_COLUMNS):
        total += (a[:, i : i + EXACT_COLUMNS].astype(np.float32) @ b[:, i : i + EXACT_COLUMNS].astype(np.float32).T).astype(np.int32)
    return total


def dequantised(blocks: DataFrame, key: str) -> DataFrame:
    """(key, embedding): codes times scales."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, ids, scales, codes in zip(f.width, f.ids, f.scales, f.codes, strict=True):
                x = np.frombuffer(codes, np.int8).reshape(-1, width) * np.frombuffer(scales, np.float32)[:, None]
                yield pd.DataFrame({key: np.frombuffer(ids, np.int64), "embedding": list(x.astype(np.float32))})

    return blocks.mapInPandas(run, f"{key} long, embedding array<float>")


def quantised_neighbours(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k nearest by the cosine of codes, both sides blocks of :func:`quantised`. Products
    and squared norms are integers; a vector's scale cancels out of its cosines."""
    slots = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = lambda b, by: b.select("width", F.col("ids").alias(f"{by}_ids"), F.col("codes").alias(f"{by}_m"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, ids_c, m_c, ids, m in zip(f.width, f.c_ids, f.c_m, f.q_ids, f.q_m, strict=True):
                c, q = (np.frombuffer(x, np.int8).reshape(-1, width) for x in (m_c, m))
                norms = [np.einsum("ij,ij->i", x, x, dtype=np.int64).astype(np.float64) for x in (q, c)]
                size = np.sqrt(norms[0][:, None] * norms[1][None, :])
                score = np.round(np.divide(integer_products(q, c), size, out=np.zeros(size.shape), where=size > 0), DIGITS)
                yield _nearest_of(np.frombuffer(ids, np.int64), np.frombuffer(ids_c, np.int64), score, k)

    ratio = plan_bytes(blocks) / plan_bytes(asked)
    return ranked(met_blocks(named(asked, "q"), named(blocks, "c"), slots, ratio).mapInPandas(run, "query_id long, chunk_id long, score double"), k)


def quantised_search(queries: DataFrame, corpus: DataFrame, k: int, wider: int = 4, blocks: DataFrame | None = None) -> DataFrame:
    """The ``wider * k`` nearest by one-byte codes, rescored with the stored vectors. ``blocks`` are the corpus's codes as
    :func:`quantised` wrote them; without them they are made here."""
    blocks = quantised(corpus, "chunk_id") if blocks is None else blocks
    wide = quantised_neighbours(quantised(queries, "query_id", size=QUERY_ROWS), blocks, wider * k).select("query_id", "chunk_id")
    exact = wide.join(corpus.select("chunk_id", F.col("embedding").alias("v")), "chunk_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return ranked(exact.select("query_id", "chunk_id", F.round(cosine("q", "v"), DIGITS).alias("score")), k)


def centroid(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Element-wise mean of ``embedding``: partial sums an element, then one row a group."""
    by = by or []
    means = rows.select(*by, F.posexplode("embedding").alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def anomalies(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """``rows`` with similarity to the common centroid and whether it is under ``least``."""
    centre = centroid(rows)  # one row of one vector, whatever the input
    near = F.round(cosine("embedding", "centroid"), 6)
    return rows.crossJoin(F.broadcast(centre)).withColumn("similarity", near).withColumn("anomalous", near < least).drop("centroid")


def cache_plan(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of texts against a cache keyed by SHA-256; each missing text is embedded once."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    hits = keyed.join(cache, "key")
    return hits, keyed.join(cache.select("key"), "key", "left_anti").select("key", "text").distinct()


class DriftAdapter:
    """The rotation that best maps new vectors onto old ones, by the singular value decomposition of their
    cross-covariance (d x d sums, made on the executors)."""

    def __init__(self, rotation: np.ndarray):
        self.rotation = rotation

    @classmethod
    def fit(cls, pairs: DataFrame, width: int) -> DriftAdapter:
        """pairs: (old, new) arrays of ``width`` elements."""

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width, width))
            for f in frames:
                if len(f):
                    total += np.array(f.new.tolist(), np.float64).T @ np.array(f.old.tolist(), np.float64)
            yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

        sums = pairs.select("old", "new").mapInPandas(part, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
        c = np.zeros((width, width))
        for r in sums.collect():  # width^2 numbers
            c[r["i"], r["j"]] = r["x"]
        u, _, vt = np.linalg.svd(c)
        return cls(u @ vt)

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, embedding) with rotated, normalised embeddings."""
        rotation = self.rotation

        @F.pandas_udf("array<double>")
        def turn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                m = np.array(s.tolist(), np.float64) @ rotation if len(s) else np.zeros((0, len(rotation)))
                size = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.Series(list(np.where(size > 1e-12, m / np.where(size > 1e-12, size, 1), m)))

        return rows.withColumn("embedding", turn("embedding"))


def embedded(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", attempts: int = 3, backoff_s: float = 0.2, in_flight: int | None = None) -> DataFrame:
    """Adds ``embedding`` by a model called once an Arrow batch. A call that fails is made again after ``backoff_s`` seconds, twice as
    many each time, ``attempts`` times in all. No more than ``in_flight`` calls run at once. Order is not relied on."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for i in range(attempts):
                try:
                    got = model(s.fillna("").tolist())
                    break
                except Exception:
                    if i + 1 == attempts:
                        raise
                    time.sleep(backoff_s * 2**i)
            if len(got) != len(s):
                raise ValueError("the model returned another number of vectors")
            yield pd.Series(got)

    return (rows if in_flight is None else rows.coalesce(in_flight)).withColumn("embedding", run(text))
