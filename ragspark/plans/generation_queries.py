"""Queries over prompts, answers, their audit records, what a run's stages counted, table functions, the stored index and the tools of agents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragspark.operators import chunking, code, generation, inverted, lexical, ports, tools
from ragspark.plans import corpus_queries as C, extension_queries as E, retrieval_queries as R
from ragspark.plans.common import CORPUS_SQL, POSTINGS_SQL, chunks, corpus, hits_sql, questions, shown, sparse, sparse_sql, table
from ragspark.sources.shared import shared_folder
from ragspark.sources.tables import append_json

QUERIES, SQL = {}, {}
K = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# fixed values, as the SQL side states them: the prompts
_BEFORE = """'You are a helpful assistant for the Contoso Intelligent Systems knowledge base.' || chr(10) || 'Answer the question using ONLY the context below. If the answer is not in the' || chr(10)
  || 'context, reply exactly: "I don''t know based on the available sources."' || chr(10) || 'When you reference a fact, cite the source like [Source N].' || chr(10) || chr(10) || 'Context:' || chr(10)"""
_PROMPTS = f"""{POSTINGS_SQL}, {sparse_sql(K)},
asked AS (SELECT item_id AS query_id, text AS question, 4000 - CAST(ceil((length({_BEFORE} || chr(10) || 'Question: ') + length(text)) / 4) AS BIGINT) AS room FROM benchmark),
lines AS (SELECT query_id, rank, chunk_id, text, '[Source ' || rank || '] ' || text || chr(10) AS line FROM sparse JOIN documents ON doc_id = chunk_id),
fit AS (SELECT *, sum(CAST(ceil(length(line) / 4) AS BIGINT)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM lines),
taken AS (SELECT query_id, question, count(rank) AS hits, room, coalesce(string_agg(line, '' ORDER BY rank) FILTER (WHERE used <= room), '') AS context, count(*) FILTER (WHERE used <= room) AS n,
  list(chunk_id ORDER BY rank) FILTER (WHERE used <= room) AS ids, list(text ORDER BY rank) FILTER (WHERE used <= room) AS texts FROM asked LEFT JOIN fit USING (query_id) GROUP BY ALL),
prompted AS (SELECT query_id, CASE WHEN hits > 0 AND room > 0 THEN {_BEFORE} || context || chr(10) || 'Question: ' || question
  ELSE 'Reply exactly: "I don''t know based on the available sources."' || chr(10) || chr(10) || '(No retrieved context was available for the question: ' || question || ')' END AS prompt, n, coalesce(ids, []) AS ids, coalesce(texts, []) AS texts FROM taken)"""


def _prompts(spark: SparkSession, sf_dir: str, stages: generation.Stages | None = None) -> DataFrame:
    hits = sparse(spark, sf_dir, K)
    if stages:
        hits = stages.watch("retrieve", hits, hits=F.count("*"), score=F.round(F.sum("score"), 6))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    out = generation.prompts(questions(spark, sf_dir), hits.join(texts, "chunk_id").select("query_id", "rank", "chunk_id", "text"))
    return stages.watch("augment", out, prompts=F.count("*"), sources=F.sum(F.size("sources")), characters=F.sum(F.length("prompt"))) if stages else out


@query(f"WITH {_PROMPTS} SELECT query_id, prompt, n AS used, array_to_string(ids, ',') AS chunk_ids FROM prompted")
def rag_prompts(spark, sf_dir):
    out = _prompts(spark, sf_dir)
    return out.select("query_id", "prompt", F.size("sources").cast("long").alias("used"), F.array_join(F.transform("sources", lambda s: s["chunk_id"].cast("string")), ",").alias("chunk_ids"))


@query(f"WITH {_PROMPTS} SELECT query_id, n AS sources, least(n, 2) AS cited, array_to_string(ids[1:2], ',') AS cited_ids, 'reader' AS user_id FROM prompted")
def rag_audit(spark, sf_dir):
    """The records as they were written and read back, one JSON line an answer."""
    at = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    records = generation.audit_records(generation.answered(_prompts(spark, sf_dir)), F.lit("reader"), F.current_timestamp())
    append_json(records, at)
    back = spark.read.schema(records.schema).json(at)
    ids = F.array_join(F.transform("citations", lambda c: c["chunk_id"].cast("string")), ",")
    return back.select("query_id", F.size("retrieved_chunk_ids").cast("long").alias("sources"), F.size("citations").cast("long").alias("cited"), ids.alias("cited_ids"), "user_id")


@query(f"""WITH {_PROMPTS} SELECT 'retrieve' AS stage, 'hits' AS metric, CAST(count(*) AS DOUBLE) AS value FROM sparse UNION ALL SELECT 'retrieve', 'score', round(sum(score), 6) FROM sparse
UNION ALL SELECT 'augment', 'prompts', count(*) FROM prompted UNION ALL SELECT 'augment', 'sources', sum(n) FROM prompted UNION ALL SELECT 'augment', 'characters', sum(length(prompt)) FROM prompted
UNION ALL SELECT 'generate', 'answers', count(*) FROM prompted UNION ALL SELECT 'generate', 'abstained', count(*) FILTER (WHERE n = 0) FROM prompted""")
def rag_stages(spark, sf_dir):
    """What the stages of a run counted while its answers were written."""
    stages = generation.Stages()
    answers = generation.answered(_prompts(spark, sf_dir, stages))
    answers = stages.watch("generate", answers, answers=F.count("*"), abstained=F.count_if(F.col("answer") == generation.ABSTENTION))
    answers.write.parquet(f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}")
    return stages.told(spark)


# chunkers as table functions, called by LATERAL


def _recursive(text: str, longest: int) -> list[tuple[int, int, str]]:
    return [(a, z, text[a:z].strip()) for a, z in chunking.recursive_spans(text, longest) if text[a:z].strip()]


@query(C.SQL["chunk_recursive"])
def chunk_recursive_lateral(spark, sf_dir):
    ports.register(spark, chunk_recursive=ports.chunker(_recursive))
    return spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_recursive(d.text, 800) c", docs=table(spark, sf_dir, "documents")).withColumn("chunk_id", chunking.chunk_id())


@query(E.SQL["chunk_code_strings"])
def chunk_code_lateral(spark, sf_dir):
    ports.register(spark, chunk_code=ports.chunker(code.spans))
    return spark.sql("SELECT f.doc_id, c.chunk_index, c.text FROM {files} f, LATERAL chunk_code(f.text) c", files=E.tricky_sources(spark, sf_dir))


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, chunk_index, text, length(text) AS n FROM ({C.SQL["chunk_fixed"]})),
g AS (SELECT doc_id, chunk_index, CAST(0 AS INTEGER) AS piece, n AS used FROM c WHERE chunk_index = 0 UNION ALL
  SELECT c.doc_id, c.chunk_index, CASE WHEN used + n <= 1700 THEN piece ELSE piece + 1 END, CASE WHEN used + n <= 1700 THEN used + n ELSE n END FROM g JOIN c ON c.doc_id = g.doc_id AND c.chunk_index = g.chunk_index + 1)
SELECT doc_id, piece, CAST(count(*) AS INTEGER) AS chunks, md5(string_agg(text, '' ORDER BY chunk_index)) AS digest FROM g JOIN c USING (doc_id, chunk_index) GROUP BY doc_id, piece""")
def chunk_pack_lateral(spark, sf_dir):
    """Chunks of a document packed anew by a table function that partitions its table."""
    ports.register(spark, pack_chunks=ports.packer(len, "doc_id", "chunk_index"))
    rows = spark.sql("SELECT * FROM pack_chunks(TABLE(SELECT doc_id, chunk_index, text FROM {chunks}), 1700)", chunks=chunking.fixed_size(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "piece", "chunks", F.md5("text").alias("digest"))


# the stored index


def _stored(spark: SparkSession, sf_dir: str) -> inverted.InvertedIndex:
    """The index of all documents: a tenth came with other words first, some that are no documents came and went."""
    docs, late = chunks(spark, sf_dir), F.col("chunk_id") % 10 == 4
    index = inverted.InvertedIndex(spark, f"{shared_folder(spark)}/inverted-{uuid.uuid4().hex}", shards=inverted.shards_for(docs))
    strays = docs.where(late).select((-1 - F.col("chunk_id")).alias("chunk_id"), "text")
    index.write(docs.withColumn("text", F.when(late, F.concat(F.lit("old words "), "text")).otherwise(F.col("text"))).unionByName(strays))
    index.vacuum()
    index.write(docs.where(late), removed=strays.select("chunk_id"))
    index.vacuum()
    return index


@query(f"WITH {POSTINGS_SQL}, {sparse_sql(10)} {hits_sql('sparse')}")
def bm25_stored(spark, sf_dir):
    """BM25 from the stored index after changes; texts are not read by the search."""
    return shown(_stored(spark, sf_dir).search(questions(spark, sf_dir), 10)[0])


# tools behind the clearance of their caller


def _tools(spark: SparkSession, sf_dir: str) -> tools.BoundaryTools:
    known = corpus(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")
    docs = chunks(spark, sf_dir)
    return tools.BoundaryTools(lambda asked, k: lexical.bm25(asked, docs, k), known, "Internal")


_SEEN = f"(SELECT doc_id FROM {CORPUS_SQL} c WHERE confidentiality IN ('Public', 'Internal'))"


@query(f"WITH {POSTINGS_SQL}, {sparse_sql(25)} SELECT * FROM ({hits_sql('sparse')}) WHERE chunk_id IN {_SEEN}")
def tool_search(spark, sf_dir):
    """Forty hits are asked for, 25 looked at, those in reach told."""
    return shown(_tools(spark, sf_dir).search(questions(spark, sf_dir), 40))


@query(f"SELECT * FROM ({R.SQL['rerank_overlap'].replace(' WHERE score >= 0.3', '')}) WHERE chunk_id IN {_SEEN}")
def tool_rerank(spark, sf_dir):
    return shown(_tools(spark, sf_dir).search_and_rerank(questions(spark, sf_dir)))


@query(f"""WITH i AS (SELECT doc_id AS chunk_id FROM labels UNION SELECT -1 - doc_id FROM labels)
SELECT chunk_id, s.doc_id IS NOT NULL AS found, md5(d.text) AS digest, CASE WHEN s.doc_id IS NULL THEN 'not-found-or-denied' ELSE 'ok' END AS reason
FROM i LEFT JOIN {_SEEN} s ON s.doc_id = chunk_id LEFT JOIN documents d ON d.doc_id = s.doc_id""")
def tool_get_chunk(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.explode(F.array("doc_id", -1 - F.col("doc_id"))).alias("chunk_id"))
    return _tools(spark, sf_dir).get_chunk(ids).select("chunk_id", "found", F.md5("text").alias("digest"), "reason")


@query("SELECT source AS silo, 'queued' AS status, count(*) AS tickets FROM documents WHERE trim(text, ' ') <> '' GROUP BY source")
def tool_ingest(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("source").alias("silo"))
    told = tools.BoundaryTools.ingest(items, f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}")
    return told.groupBy("silo", "status").agg(F.count_distinct("tracking_id").alias("tickets"))
