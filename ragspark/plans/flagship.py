"""The whole path of a question: retrieve by two legs, fuse, rerank, pack, answer, cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragspark.functions import text as T
from ragspark.operators import chunking, fusion, generation, retrieval
from ragspark.plans.common import bow_vectors, questions, table

#: Room for a document's chunks in a chunk's number: texts of up to 400 million characters, ids below 9e12 (beyond, ANSI raises).
CHUNKS = 1_000_000


def ask(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """(query_id, prompt, answer, sources): questions without context abstain."""
    q = questions(spark, sf_dir)
    pieces = chunking.fixed_size(table(spark, sf_dir, "documents"))
    c = pieces.select((F.col("doc_id") * CHUNKS + F.col("chunk_index")).alias("chunk_id"), "text")
    hits = retrieval.hybrid(q, c, bow_vectors(q, "query_id"), bow_vectors(c, "chunk_id"), max(20, k))
    # texts join late, on the ids of the fused lists only
    texts = hits.join(c, "chunk_id")
    words = lambda rows, key, name: rows.select(key, F.array_distinct(T.word_tokens("text")).alias(name))
    pairs = texts.select("query_id", "chunk_id", F.array_distinct(T.word_tokens("text")).alias("chunk_words")).join(words(q, "query_id", "query_words"), "query_id")
    best = fusion.reranked(hits, fusion.overlap_scores(pairs).select("query_id", "chunk_id", "score"), k)
    out = generation.answered(generation.prompts(q, best.join(c, "chunk_id").select("query_id", "rank", "chunk_id", "text")))
    return out.select("query_id", "prompt", "answer", F.transform("sources", lambda s: s["chunk_id"]).alias("sources"))
