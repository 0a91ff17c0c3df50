"""Inputs and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragspark.operators import embedding, lexical
from ragspark.operators.embedding import bow_vectors
from ragspark.sources.tables import CORPUS_SQL, corpus, table

K = 10
__all__ = ["CORPUS_SQL", "bow_vectors", "corpus", "table"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of vector searches: ids divisible by 20, against all rows."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


def nearest(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return embedding.neighbours(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), k)


def dense(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return embedding.neighbours(embedding.bow_blocks(questions(spark, sf_dir), "query_id"), embedding.bow_blocks(chunks(spark, sf_dir), "chunk_id"), k)


def sparse(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return lexical.bm25(questions(spark, sf_dir), chunks(spark, sf_dir), k)


def shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def nearest_sql(k: int = K, where: str = "true") -> str:
    return f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  near0 AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 9) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND {where}),
  near AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM near0 QUALIFY rank <= {k})"""


FNV = "list_reduce(list_transform(string_split({t}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"


def bow_sql(name: str, source: str, key: str, dims: int = 256) -> str:
    return f"""{name}_t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-]+')) AS t FROM {source}),
  {name}_h AS (SELECT t, {FNV.format(t="t")} % {dims} AS bucket FROM (SELECT DISTINCT t FROM {name}_t)),
  {name}_c AS (SELECT id, bucket, count(*) AS n FROM {name}_t JOIN {name}_h USING (t) GROUP BY ALL),
  {name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_c)"""


def dense_sql(k: int = K, name: str = "dense") -> str:
    return f"""{bow_sql("bd", "documents", "doc_id")}, {bow_sql("bq", "benchmark", "item_id")},
  {name}0 AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.w * d.w) AS s FROM bq q JOIN bd d USING (bucket) GROUP BY ALL),
  {name}1 AS (SELECT q.id AS query_id, d.id AS chunk_id, round(coalesce(s, 0), 9) AS score FROM (SELECT DISTINCT id FROM bq) q CROSS JOIN (SELECT DISTINCT id FROM bd) d LEFT JOIN {name}0 z ON z.query_id = q.id AND z.chunk_id = d.id),
  {name} AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM {name}1 QUALIFY rank <= {k})"""


WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\d_]+')"
POSTINGS_SQL = f"""dw AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents),
  dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM dw),
  tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM dt GROUP BY doc_id, term),
  st AS (SELECT count(*) AS docs, greatest(avg(len(w)), 1.0) AS mean FROM dw),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def sparse_sql(k: int = K, name: str = "sparse", source: str = "(SELECT item_id AS query_id, text FROM benchmark)") -> str:
    """Needs POSTINGS_SQL before it."""
    return f"""{name}_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({WORDS.format(t="text")}) AS term FROM {source}) GROUP BY ALL),
  {name}_s AS (SELECT query_id, doc_id AS chunk_id, round(sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1) * 2.5 * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * n / mean))), 9) AS score
    FROM {name}_q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL HAVING score > 0),
  {name} AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM {name}_s QUALIFY rank <= {k})"""


def rrf_sql(a: str, b: str, k: int, name: str) -> str:
    return f"""{name}_0 AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, x.rank AS ra, y.rank AS rb,
      round(coalesce(1.0 / (60 + x.rank), 0) + coalesce(1.0 / (60 + y.rank), 0), 9) AS score FROM {a} x FULL JOIN {b} y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id),
  {name} AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM {name}_0 QUALIFY rank <= {k})"""


def hits_sql(name: str) -> str:
    return f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM {name}"
