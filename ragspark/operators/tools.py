"""The tools that agents may call, over batches of calls: search, search with reranking, chunks by id, and a queue of texts to ingest.

Every reading tool answers within the caller's clearance, decided after the search, on the chunks' own metadata: fewer than k rows
may be left, and a chunk out of reach looks as one that does not exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ragspark.functions import text as T
from ragspark.operators import filters, fusion
from ragspark.sources.tables import append_json

# fixed values: most rows of a search, candidates of a reranked one, what a lookup says, the state of a new ticket
MOST, CANDIDATES = 25, 20
OK, DENIED, QUEUED = "ok", "not-found-or-denied", "queued"


class BoundaryTools:
    """``retrieve(asked, k)`` gives hits (query_id, rank, chunk_id, score) of asked (query_id, text); chunks: chunk_id, text and the
    metadata that a clearance is decided on (confidentiality; office and silo, if the caller is held to one)."""

    def __init__(self, retrieve: Callable[[DataFrame, int], DataFrame], chunks: DataFrame, clearance: str, office: str | None = None, silo: str | None = None):
        self.retrieve, self.chunks = retrieve, chunks
        self.visible = filters.within_clearance(clearance, office, silo)

    def _scoped(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.chunks.where(self.visible).select("chunk_id"), "chunk_id", "left_semi").select("query_id", "rank", "chunk_id", "score")

    def search(self, asked: DataFrame, k: int = 5) -> DataFrame:
        """Blank questions have no answer; k is held to 1..25."""
        return self._scoped(self.retrieve(asked.where(F.trim("text") != ""), max(1, min(MOST, k))))

    def search_and_rerank(self, asked: DataFrame, k: int = 5, candidates: int = CANDIDATES) -> DataFrame:
        """The best k by shared words among ``candidates``, at least k of them."""
        asked, k = asked.where(F.trim("text") != ""), max(1, min(MOST, k))
        pool = self.retrieve(asked, max(candidates, k))
        words = lambda rows, key, name: rows.select(key, F.array_distinct(T.word_tokens("text")).alias(name))
        pairs = pool.select("query_id", "chunk_id").join(words(asked, "query_id", "query_words"), "query_id").join(words(self.chunks, "chunk_id", "chunk_words"), "chunk_id")
        return self._scoped(fusion.reranked(pool, fusion.overlap_scores(pairs).select("query_id", "chunk_id", "score"), k))

    def get_chunk(self, ids: DataFrame) -> DataFrame:
        """(chunk_id, found, text, reason) of each of ``ids``; one that is out of reach and one that does not exist look alike."""
        seen = self.chunks.where(self.visible).select("chunk_id", "text", F.lit(True).alias("found"))
        rows = ids.select("chunk_id").distinct().join(seen, "chunk_id", "left")
        return rows.select("chunk_id", F.coalesce("found", F.lit(False)).alias("found"), "text", F.when(F.col("found"), OK).otherwise(DENIED).alias("reason"))

    @staticmethod
    def ingest(items: DataFrame, queue: str) -> DataFrame:
        """(tracking_id, silo, status) of items (content, silo), which are appended to the queue, a folder of JSON lines, as they are
        told. Blank contents and silos are refused: they have no ticket."""
        rows = items.where((F.trim("content") != "") & (F.trim("silo") != "")).select(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12).alias("tracking_id"), "silo", F.lit(QUEUED).alias("status"), "content")
        before = f"{queue}/batch-{items.sparkSession.range(1).select(F.expr('uuid()')).head()[0]}"
        append_json(rows, before)
        return items.sparkSession.read.schema(rows.schema).json(before).select("tracking_id", "silo", "status")
