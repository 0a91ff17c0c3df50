"""Queries over tables that take changes: re-ingestion from a change stream, migration to another model, audit segments, erasure
receipts, the summary cache, and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragspark.operators import chunking, graph, operations, routing, security
from ragspark.operators.embedding import bow_vectors
from ragspark.operators.migration import Reindex
from ragspark.plans import retrieval_queries as R
from ragspark.plans.common import bow_sql, questions, table
from ragspark.plans.operations_queries import _gold
from ragspark.sources.keyed import KeyedTable, reingest
from ragspark.sources.shared import shared_folder
from ragspark.streaming import state

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH v AS (SELECT user_id AS doc_id, max(event_id) AS version FROM events GROUP BY user_id)
SELECT d.doc_id || '#' || i AS chunk_id, CAST(d.doc_id AS VARCHAR) AS document_id, coalesce(version, 0) AS version, sha256(substr(text, CAST(i * 500 + 1 AS BIGINT), 500)) AS hash
FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id, range(2) r(i) WHERE i = 0 OR version IS NOT NULL""")
def reingest_stream(spark, sf_dir):
    """Documents are chunked anew as the version guard passes their changes on, in two starts of the stream."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    pieces = lambda rows, n: rows.select(F.concat_ws("#", "document_id", "i").alias("chunk_id"), "document_id", "version", F.sha2(F.substring("text", F.col("i") * 500 + 1, F.lit(500)), 256).alias("hash"))
    numbered = lambda rows, n: rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    root = _root(spark, "reingest")
    store = KeyedTable(spark, f"{root}/table", "chunk_id string, document_id string, version long, hash string")
    store.replace_documents(docs, pieces(numbered(docs.withColumn("version", F.lit(0).cast("long")), 1), 1))
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("version"))
    for part in (events.where("version % 3 > 0"), events.where("version % 3 = 0")):
        part.write.mode("append").parquet(f"{root}/feed")
        changes = state.guarded_versions(spark.readStream.schema(events.schema).parquet(f"{root}/feed"))
        apply = reingest(store, lambda changed: pieces(numbered(docs.join(changed, "document_id"), 2), 2))
        changes.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()
    return store.read()


# bag-of-words models of 32 and 256 dimensions; the questions are the benchmark's passages, their documents those that hold them
def _hits_sql(name: str, dims: int) -> str:
    return f"""{bow_sql(f"d{name}", "documents", "doc_id", dims)}, {bow_sql(f"q{name}", "benchmark", "item_id", dims)},
  {name}0 AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS s FROM q{name} q JOIN d{name} d USING (bucket) GROUP BY ALL),
  {name}1 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM {name}0),
  {name} AS (SELECT count(DISTINCT query_id) AS hits FROM {name}1 JOIN gold USING (query_id, doc_id) WHERE rank <= 10)"""


_GOLD_SQL = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
MODELS = {"coarse": 32, "fine": 256}


def _migration(spark: SparkSession, sf_dir: str, first: str) -> tuple[Reindex, DataFrame, DataFrame, DataFrame]:
    def embed(rows: DataFrame, model: str) -> DataFrame:
        return bow_vectors(rows.withColumn("number", F.col("document_id").cast("long")), "number", MODELS[model], keep=tuple(rows.columns)).drop("number")

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "text")
    gold = _gold(spark, sf_dir).select("query_id", F.explode(F.col("expected").cast("array<string>")).alias("document_id"))
    return Reindex(spark, _root(spark, "reindex"), embed, first, number=F.col("document_id").cast("long")), docs, questions(spark, sf_dir), gold


@query(f"""WITH {_GOLD_SQL}, {_hits_sql("coarse", 32)}, {_hits_sql("fine", 256)}, n AS (SELECT count(*) AS n FROM benchmark),
ok AS (SELECT fine.hits >= coarse.hits AS ok FROM coarse, fine)
SELECT count(*) AS chunks, CASE WHEN ok THEN 'fine' ELSE 'coarse' END AS serving, CASE WHEN ok THEN 'coarse' END AS previous, ok AS cut_over, round(any_value(coarse.hits / n), 6) AS live_rate, round(any_value(fine.hits / n), 6) AS shadow_rate
FROM documents, ok, coarse, fine, n WHERE regexp_matches(lower(text), '[a-z0-9][a-z0-9\\-]+') GROUP BY ok""")
def reindex_cutover(spark, sf_dir):
    """A shadow on the finer model is filled while documents still arrive, its backfill is cut off and goes on, and it serves once
    its measured hit rate is not below the live one's."""
    move, docs, asked, gold = _migration(spark, sf_dir, "coarse")
    late = F.pmod(F.col("document_id").cast("long"), F.lit(10)) == 3
    move.write(docs.where(~late))
    move.begin("fine")
    move.backfill(3, stop_after=1)
    move.write(docs.where(late))
    move.backfill(2)
    done, live, shadow = move.cut_over(asked, gold)
    state_ = move.state()
    shown = move.serving().agg(F.count("*").alias("chunks"))
    return shown.select("chunks", F.lit(state_["serving"]).alias("serving"), F.lit(state_["previous"]).alias("previous"), F.lit(done).alias("cut_over"), F.lit(round(live, 6)).alias("live_rate"), F.lit(round(shadow, 6)).alias("shadow_rate"))


@query(f"""WITH {_GOLD_SQL}, {_hits_sql("coarse", 32)}, {_hits_sql("fine", 256)}
SELECT count(*) AS chunks, 'fine' AS serving, coarse.hits < fine.hits AS refused FROM documents, coarse, fine WHERE regexp_matches(lower(text), '[a-z0-9][a-z0-9\\-]+') GROUP BY ALL""")
def reindex_rollback(spark, sf_dir):
    """A coarser shadow is refused by its hit rate; forced to serve, it is rolled back with what was written meanwhile."""
    move, docs, asked, gold = _migration(spark, sf_dir, "fine")
    late = F.pmod(F.col("document_id").cast("long"), F.lit(10)) == 3
    move.write(docs.where(~late))
    move.begin("coarse")
    move.backfill()
    done, _, _ = move.cut_over(asked, gold)
    if not done:
        move.cut_over(asked, gold, slack=1.0)
    move.write(docs.where(late))  # the coarse table serves
    move.roll_back()
    return move.serving().agg(F.count("*").alias("chunks")).select("chunks", F.lit(move.state()["serving"]).alias("serving"), F.lit(not done).alias("refused"))


# chains of events are cut into segments of 256 records, each hashed from its own beginning
_SEGMENTS = """WITH RECURSIVE r AS (SELECT event_type AS chain, event_id, event_id || '|' || user_id || '|' || coalesce(props, '') AS record, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events),
p AS (SELECT chain, pos // 256 AS segment, pos % 256 AS i, record FROM r),
h AS (SELECT chain, segment, i, sha256(sha256(chain || '|' || segment) || record) AS hash FROM p WHERE i = 0
  UNION ALL SELECT p.chain, p.segment, p.i, sha256(h.hash || p.record) FROM h JOIN p ON p.chain = h.chain AND p.segment = h.segment AND p.i = h.i + 1)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.coalesce("props", F.lit("")))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.col("event_id").alias("seq"), record.alias("record"))


@query(_SEGMENTS + "SELECT chain, segment, max(i) + 1 AS entries, arg_max(hash, i) AS hash FROM h GROUP BY ALL")
def audit_segments(spark, sf_dir):
    made = security.segmented(_records(spark, sf_dir), 256)
    return security.heads(made, b"key").select("chain", "segment", "entries", "hash")


@query("""WITH c AS (SELECT event_type AS chain, count(*) AS n FROM events GROUP BY event_type), k AS (SELECT *, row_number() OVER (ORDER BY chain) % 5 AS k FROM c)
SELECT chain, CASE k WHEN 1 THEN n - 1 WHEN 2 THEN n - (n - 1) % 256 - 1 WHEN 4 THEN n - 1 ELSE n END AS entries, CASE k WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS broken, k = 0 AS whole FROM k""")
def audit_truncated(spark, sf_dir):
    """Of five chains, one loses its last record, one its last segment with its head, one has a record altered, one a record
    taken out inside; no head is known from elsewhere."""
    made = security.segmented(_records(spark, sf_dir), 256)
    heads = security.heads(made, b"key")
    tips = security.tips(heads, b"key")
    names = tips.select("chain").collect()  # a row a chain
    kind = F.lit(0)
    for i, r in enumerate(sorted(names), 1):
        kind = F.when(F.col("chain") == r.chain, i % 5).otherwise(kind)
    top = tips.select("chain", F.col("segments") - 1, F.col("entries") - 1).toDF("chain", "last_segment", "last_pos")
    rows = made.join(F.broadcast(top), "chain").withColumn("kind", kind)
    rows = rows.where(~((F.col("kind") == 1) & (F.col("pos") == F.col("last_pos"))) & ~((F.col("kind") == 2) & (F.col("segment") == F.col("last_segment"))) & ~((F.col("kind") == 4) & (F.col("pos") == 1)))
    rows = rows.withColumn("record", F.when((F.col("kind") == 3) & (F.col("pos") == 1), "altered").otherwise(F.col("record"))).select(*made.columns)
    kept = heads.join(F.broadcast(top), "chain").where(~((kind == 2) & (F.col("segment") == F.col("last_segment")))).select(*heads.columns)
    return security.verified_segments(rows, kept, tips, b"key")


# receipts, summaries, reports


@query("""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS s, CAST(len(generate_series(0, greatest(length(text) - 101, 0), 400)) AS INTEGER) AS n FROM documents WHERE length(text) > 0),
r AS (SELECT CAST(doc_id AS VARCHAR) AS s, doc_id % 3 AS e, doc_id % 5 AS x, strftime(DATE '2024-01-01' + CAST(doc_id % 45 AS INTEGER), '%Y-%m-%d') || 'T00:00:00+00:00' AS done, doc_id % 45 <= 30 AS met FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)),
b AS (SELECT 'r' || s AS request_id, s AS subject_id, met AS sla_met, '{"requestId":"r' || s || '","subjectId":"' || s || '","receivedAt":"2024-01-01T00:00:00+00:00","completedAt":"' || done || '","slaMet":' || met || ',"stores":[{"name":"vector-store","recordsErased":' || coalesce(n, 0) || ',"completedAt":"' || done
  || '"},{"name":"graph-store","recordsErased":' || e || ',"completedAt":"' || done || '"}' || CASE WHEN x > 0 THEN ',{"name":"audit-log","recordsRedacted":' || x || ',"completedAt":"' || done || '"}' ELSE '' END || '],"signature":""}' AS receipt FROM r LEFT JOIN c USING (s))
SELECT *, true AS verified FROM b""")
def erasure_receipts(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    subject = F.col("doc_id").cast("string").alias("subject_id")
    start = F.lit("2024-01-01").cast("timestamp")
    requests = ids.select(F.concat(F.lit("r"), "doc_id").alias("request_id"), subject, start.alias("received_at"), (start + F.expr("make_dt_interval(CAST(doc_id % 45 AS INT))")).alias("completed_at"))
    chunks = chunking.fixed_size(table(spark, sf_dir, "documents")).select(subject, "chunk_index")
    entities = ids.where("doc_id % 3 > 0").select(subject, F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 3)).alias("entity"))
    out = operations.erasure_receipts(requests, chunks, entities, ids.select(subject, (F.col("doc_id") % 5).alias("records")), b"key")
    again = security.T.hmac_sha256(F.col("receipt"), b"key")
    return out.select("request_id", "subject_id", "sla_met", "receipt", (F.col("signature") == again).alias("verified"))


@query("""WITH g AS (SELECT s_nationkey AS n, list_sort(list(DISTINCT 's' || s_suppkey)) AS ids FROM supplier GROUP BY 1)
SELECT n AS query_id, sha256(array_to_string(ids, chr(0))) AS key, n % 3 = 1 AS hit, CASE WHEN n % 3 = 1 THEN 'kept ' ELSE 'made ' END || n AS summary FROM g""")
def summary_cache(spark, sf_dir):
    """Summaries of the suppliers of nations: a third is cached, a third has expired, a third is new; the rest is made and stored."""
    asked = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("query_id")).agg(F.collect_list(F.concat(F.lit("s"), "s_suppkey")).alias("ids"))
    now = F.lit("2024-02-01").cast("timestamp")
    cache = asked.where("query_id % 3 > 0").select(graph.summary_key(F.col("ids")).alias("key"), "ids", F.concat(F.lit("kept "), "query_id").alias("summary"), F.when(F.col("query_id") % 3 == 1, F.lit("2024-02-02")).otherwise(F.lit("2024-02-01")).cast("timestamp").alias("expires_at"))
    hits, misses = graph.looked_up(asked, cache, now)
    after = graph.refreshed(cache, misses.select("ids", F.concat(F.lit("made "), "query_id").alias("summary")), now)
    both = hits.select("query_id", "key", F.lit(True).alias("hit")).unionByName(misses.select("query_id", "key", F.lit(False).alias("hit")))
    return both.join(after.select("key", "summary"), "key").select("query_id", "key", "hit", "summary")


@query(f"WITH {R._RULES_SQL}, x AS (SELECT unnest(silos) AS silo, CAST(least(floor(greatest(CAST(confidence AS DOUBLE), 0) * 10), 9) AS INTEGER) AS bin FROM rules) SELECT silo, 'rules' AS strategy, bin, bin / 10 AS low, count(*) AS decisions FROM x GROUP BY silo, bin")
def routing_histogram(spark, sf_dir):
    return routing.confidences(R._rules(spark, sf_dir), "rules")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS place, event_id AS incident_id, event_type AS severity FROM events WHERE NOT (value < 50)")
def incident_open_list(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("incident_id"), F.col("event_type").alias("severity"), (F.col("value") < 50).alias("resolved"), F.col("ts").alias("detected_at"))
    return operations.open_incidents(rows).select("place", "incident_id", "severity")
