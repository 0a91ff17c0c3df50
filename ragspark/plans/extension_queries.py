"""Queries over enhancements, answer streams, memory, model replies and the compliance documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragspark.operators import chunking, embedding, fusion, graph, lexical, memory, operations, retrieval, routing, security, structure
from ragspark.plans import operations_queries as O, retrieval_queries as R
from ragspark.plans.common import POSTINGS_SQL, asked_vectors, bow_sql, bow_vectors, chunks, corpus, dense, dense_sql, hits_sql, nearest_sql, questions, rrf_sql, shown, sparse, sparse_sql, table, vectors
from ragspark.sources.shared import cut
from ragspark.sources.tables import CORPUS_SQL, front_matter, spread

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# enhancements, modes and hybrids


@query("SELECT 'hyde' AS enhancement, * FROM (" + R.SQL["hyde_topk"] + ") UNION ALL SELECT 'stepback', * FROM (" + R.SQL["stepback_fuse"] + ") UNION ALL SELECT 'crag', * FROM (" + R.SQL["crag_filter"].replace("QUALIFY rank <= 10", "QUALIFY rank <= 5") + ")")
def enhancements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the enhancements by their names around the lexical retriever; rag_fusion_fold has the fourth."""
    q, replies = R._halves(spark, sf_dir)
    part = lambda i: replies.select("query_id", F.substring_index("reply", "\n", i).alias("reply"))
    c = chunks(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    # one index of all words: the halves have no words but those of the questions and their pieces
    index = lexical.Index(q.unionByName(part(-1).union(part(1)).toDF("query_id", "text")), c)
    inner = index.search
    grades = inner(q, 5).join(labels, "chunk_id", "left").select("query_id", "chunk_id", F.when(F.col("quality") == 1, "CORRECT").otherwise("INCORRECT").alias("grade"))
    made = {"HyDE": retrieval.enhanced(" HyDE", inner, part(-1)), "stepback": retrieval.enhanced("StepBack", inner, part(1)), "crag": retrieval.enhanced("crag", inner, grades, lambda asked, k: dense(spark, sf_dir, k))}
    rows = [shown(r(q, 5)).select(F.lit(n.lower()).alias("enhancement"), "query_id", "rank", "chunk_id", "score") for n, r in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH {dense_sql(10)}, {POSTINGS_SQL}, {sparse_sql(10)}, {rrf_sql('dense', 'sparse', 5, 'f')} SELECT 'hybrid' AS mode, * FROM ({hits_sql('f')}) UNION ALL SELECT 'dense', * FROM ({hits_sql('dense')} WHERE rank <= 5) UNION ALL SELECT 'sparse', * FROM ({hits_sql('sparse')} WHERE rank <= 5)""")
def retriever_modes(spark, sf_dir):
    most = retrieval.candidate_count(5)
    lists = [cut(find(spark, sf_dir, most)) for find in (dense, sparse)]  # shorter lists are their heads
    first = [lambda _, k, hits=hits: hits.where(F.col("rank") <= k) for hits in lists]
    made = {m: retrieval.by_mode(f" {m.upper()}", *first)(None, 5) for m in retrieval.MODES}
    rows = [shown(hits).select(F.lit(m).alias("mode"), "query_id", "rank", "chunk_id", "score") for m, hits in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_REGIONS = "(SELECT r_regionkey AS item_id, 'What lies in ' || lower(r_name) || '?' AS text FROM region)"


@query(f"""WITH {R._EDGES}, {bow_sql('bd', 'documents', 'doc_id')}, {bow_sql('bq', _REGIONS, 'item_id')},
d0 AS (SELECT q.id AS query_id, d.id AS chunk_id, round(coalesce((SELECT sum(x.w * y.w) FROM bq x JOIN bd y ON x.bucket = y.bucket AND x.id = q.id AND y.id = d.id), 0), 9) AS score FROM (SELECT DISTINCT id FROM bq) q, (SELECT DISTINCT id FROM bd) d),
d AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, CAST(chunk_id AS VARCHAR) AS chunk_id, score FROM d0 QUALIFY rank <= 10),
h AS (SELECT r_regionkey AS query_id, b AS chunk_id FROM region JOIN u ON a = 'r' || r_regionkey),
g AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS rank, chunk_id, 1.0 AS score FROM h QUALIFY rank <= 10),
{rrf_sql('d', 'g', 5, 'f')} {hits_sql('f')}""")
def vector_graph_hybrid(spark, sf_dir):
    vertices, edges = graph.built(R._entities(spark, sf_dir), R._relations(spark, sf_dir))
    asked = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("What lies in "), F.lower("r_name"), F.lit("?")).alias("text"))
    reached = graph.graph_hits(graph.k_hop(graph.seeds_in(asked, vertices), edges, 1), vertices)
    near = embedding.neighbours(bow_vectors(asked, "query_id"), bow_vectors(chunks(spark, sf_dir), "chunk_id"), 10)
    return shown(retrieval.vector_graph(near, reached, 5))


@query(f"""WITH {nearest_sql(40)} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM near JOIN v ON vec_id = chunk_id WHERE label < 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""")
def knn_postfilter(spark, sf_dir):
    return shown(embedding.postfiltered(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 10, F.col("label") < 3))


@query(f"WITH {R._EDGES} SELECT 'r' || r_regionkey AS id, 'Region' AS type, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier")
def graph_vertices(spark, sf_dir):
    return graph.built(R._entities(spark, sf_dir), R._relations(spark, sf_dir))[0].select("id", "type", "name")


# answers


_STREAMS_SQL = "(SELECT conv_id * 100000 + turn AS query_id, text, CASE turn % 7 WHEN 1 THEN 'generate' WHEN 3 THEN 'prepare' END AS fault FROM conversations WHERE role = 'assistant')"


def _streams(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    fault = F.when(F.col("turn") % 7 == 1, "generate").when(F.col("turn") % 7 == 3, "prepare")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), F.array(F.col("turn"), F.col("conv_id")).alias("sources"), F.split("text", " ").alias("tokens"), fault.alias("fault"), "text")


@query(f"""WITH a AS {_STREAMS_SQL}, t AS (SELECT query_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS token, generate_subscripts(list_filter(string_split(text, ' '), lambda x: x <> ''), 1) AS i FROM a WHERE fault IS DISTINCT FROM 'prepare'),
n AS (SELECT a.query_id, fault, count(token) AS n FROM a LEFT JOIN t USING (query_id) GROUP BY ALL)
SELECT query_id, CAST(0 AS INTEGER) AS seq, 'Sources' AS kind, CAST(NULL AS VARCHAR) AS token FROM n WHERE fault IS DISTINCT FROM 'prepare' UNION ALL SELECT query_id, CAST(i AS INTEGER), 'Token', token FROM t
UNION ALL SELECT query_id, CAST(CASE WHEN fault = 'prepare' THEN 0 ELSE n + 1 END AS INTEGER), CASE WHEN fault IS NULL THEN 'Done' ELSE 'Error' END, CASE WHEN fault IS NOT NULL THEN 'The answer could not be generated. Please try again.' END FROM n""")
def answer_events(spark, sf_dir):
    return retrieval.events(_streams(spark, sf_dir)).select("query_id", "seq", "kind", "token")


@query(f"""WITH a AS {_STREAMS_SQL}, c AS (SELECT query_id, 'resp:' || lower(trim(text)) AS key, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), '') AS answer FROM a WHERE fault IS NULL),
x AS (SELECT query_id, 'resp:' || lower(trim(text)) AS key FROM a)
SELECT x.query_id, x.key IN (SELECT key FROM c) AS hit, (SELECT min(answer) FROM c WHERE c.key = x.key) AS token FROM x""")
def response_cache(spark, sf_dir):
    """Streams without a fault are stored by their text as a question; every text is then asked again."""
    rows = _streams(spark, sf_dir)
    asked = rows.select("query_id", "text")
    cache = retrieval.stored(retrieval.events(rows), asked, 600).groupBy("key").agg(F.min("answer").alias("answer"), F.min("sources").alias("sources"), F.max("expires_at").alias("expires_at"))
    replay, missing = retrieval.replayed(asked, cache, 100)
    return replay.where("kind = 'Token'").select("query_id", F.lit(True).alias("hit"), "token").unionByName(missing.select("query_id", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("token")))


# memory


_FNV = "list_reduce(list_transform(string_split({t}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"


@query(rf"""WITH t AS (SELECT conv_id % 5 AS user_id, text AS answer, CASE WHEN turn % 3 = 0 THEN '- likes ' || turn || chr(10) || chr(10) || ' * lives in ' || conv_id || chr(10) || 'c' || chr(10) || 'd' ELSE ' ' END AS reply FROM conversations WHERE role = 'assistant'),
f AS (SELECT DISTINCT user_id, unnest(CASE WHEN trim(reply) = '' THEN [trim(answer)] ELSE list_slice(list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[-*] ', ''))), lambda x: x <> ''), 1, 3) END) AS text FROM t WHERE trim(answer) <> '')
SELECT user_id, 'user-memory#' || user_id || '#' || {_FNV.format(t='text')} AS chunk_id, text FROM f""")
def memory_facts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    told = F.concat(F.lit("- likes "), "turn", F.lit("\n\n * lives in "), "conv_id", F.lit("\nc\nd"))
    return memory.facts(c.select((F.col("conv_id") % 5).alias("user_id"), F.col("text").alias("answer"), F.when(F.col("turn") % 3 == 0, told).otherwise(" ").alias("reply")))


@query(f"""WITH {nearest_sql(24)}, o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY near.rank) AS r, chunk_id FROM near JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = chunk_id WHERE a.label = b.label)
SELECT query_id, CAST(r AS INTEGER) AS rank, chunk_id AS memory_id FROM o WHERE r <= 3""")
def memory_recall(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    memories = rows.select(F.col("chunk_id").alias("memory_id"), F.col("label").alias("user_id"), "embedding")
    asked = rows.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.col("label").alias("user_id"), "embedding")
    return memory.recalled(asked, memories, 3)


# model replies


@query("""SELECT n_nationkey AS chunk_id, 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation' ELSE 'Unknown' END AS type, n_name AS name, CAST(0 AS INTEGER) AS pos FROM nation""")
def entity_extraction(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    kind = F.when(F.col("n_nationkey") % 2 == 0, F.lit('"type":"Nation",')).otherwise(F.lit(""))
    reply = F.concat(F.lit('Found: {"entities":[{"id":"n'), "n_nationkey", F.lit('",'), kind, F.lit('"name":"'), "n_name", F.lit('"},{"id":"x","name":" "}],"relations":[{"from":"n'), "n_nationkey", F.lit('"}]} end'))
    return graph.extracted(n.select(F.col("n_nationkey").alias("chunk_id"), reply.alias("reply")))[0].select("chunk_id", "id", "type", "name", "pos")


@query(f"""WITH RECURSIVE {R._EDGES}, v AS (SELECT a AS id FROM u UNION SELECT 'r' || r_regionkey FROM region), w AS (SELECT id, id AS r FROM v UNION SELECT w.id, u.b FROM w JOIN u ON w.r = u.a),
c AS (SELECT id, min(r) AS component FROM w GROUP BY id), x AS (SELECT 'r' || r_regionkey AS id, 'Region: ' || r_name AS t FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation: ' || n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'Supplier: ' || s_name FROM supplier),
g AS (SELECT component, string_agg(t, ', ' ORDER BY id) AS m FROM c JOIN x USING (id) GROUP BY component), n AS (SELECT 'community-' || (row_number() OVER (ORDER BY component) - 1) AS chunk_id, m FROM g)
SELECT chunk_id, 'About ' || chunk_id || chr(10) || chr(10) || 'Members: ' || m AS text FROM n""")
def community_summaries(spark, sf_dir):
    vertices, edges = graph.built(R._entities(spark, sf_dir), R._relations(spark, sf_dir))
    groups = graph.communities(vertices.select("id"), edges)
    return graph.summary_chunks(groups, vertices, groups.select("community", F.concat(F.lit("About "), "community").alias("summary")))


@query("""WITH p AS (SELECT n_regionkey AS query_id, n_nationkey AS place, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS r FROM nation) SELECT query_id, CAST(r AS INTEGER) AS rank, 'Art' || place AS node_id, round(1.0 / r, 6) AS score FROM p WHERE r <= 2""")
def section_picks(spark, sf_dir):
    """A model's reply names each region's sections by their places, the last first, with noise between them."""
    n = table(spark, sf_dir, "nation")
    reply = n.groupBy(F.col("n_regionkey").alias("query_id")).agg(F.concat(F.lit("none, "), F.array_join(F.sort_array(F.collect_list("n_nationkey"), asc=False), ", ")).alias("reply"))
    return shown(structure.chosen_sections(reply, n.select(F.col("n_nationkey").alias("place"), F.concat(F.lit("Art"), "n_nationkey").alias("node_id")), 2))


@query("""SELECT n_nationkey AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'hr-policies' ELSE '' END AS silos, CASE n_nationkey % 3 WHEN 0 THEN 1.0 ELSE 0.0 END AS confidence, n_nationkey % 2 = 0 AS retrieves FROM nation""")
def reply_routing(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"))
    said = F.element_at(F.array(F.lit('sure {"silos":["hr-policies","made-up"],"confidence":3}'), F.lit('{"silos":["made-up"],"confidence":0.9}'), F.lit("no idea")), (F.col("query_id") % 3 + 1).cast("int"))
    gate = F.when(F.col("query_id") % 2 == 1, F.lit('{"retrieve": false}')).otherwise(F.lit("retrieve? yes"))
    rows = routing.by_reply(n.withColumn("reply", said)).join(n.select("query_id", routing.should_retrieve(gate).alias("retrieves")), "query_id")
    return rows.select("query_id", F.array_join("silos", ",").alias("silos"), "confidence", "retrieves")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.0 END AS score FROM documents""")
def judged_scores(spark, sf_dir):
    said = F.element_at(F.array(F.lit("none"), F.lit("Score: 7 of 10"), F.lit("0.25"), F.lit("-3 sorry")), (F.col("doc_id") % 4 + 1).cast("int"))
    return fusion.judged_scores(table(spark, sf_dir, "documents").select("doc_id", said.alias("reply"))).select("doc_id", "score")


@query("SELECT doc_id, round(1 / (1 + exp(-(length(text) % 7 - 3.0))), 6) AS score FROM documents")
def cross_encoder(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.lit("q").alias("query"), "text")
    return fusion.cross_encoded(pairs, lambda rows: [len(t) % 7 - 3.0 for _, t in rows]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, length(text) AS chars, CAST(1 AS BIGINT) AS parts FROM documents")
def embedding_batches(spark, sf_dir):
    made = embedding.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda texts: [[float(len(t)), 1.0] for t in texts])
    return made.select("doc_id", F.element_at("embedding", 1).cast("long").alias("chars"), F.element_at("embedding", 2).cast("long").alias("parts"))


@query("SELECT doc_id, 'D-' || doc_id AS id, source AS silo, CASE WHEN doc_id % 2 = 0 THEN CAST(2000 + doc_id % 50 AS INTEGER) END AS fiscal_year, length(text) AS chars FROM documents")
def front_matter_documents(spark, sf_dir):
    year = F.when(F.col("doc_id") % 2 == 0, (2000 + F.col("doc_id") % 50).cast("string")).otherwise("soon")
    content = F.concat(F.lit('---\nid: "D-'), "doc_id", F.lit('"\nsilo: '), "source", F.lit("\nfiscal_year: "), year, F.lit("\n---\n\n#"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("content")).select("doc_id", *front_matter(F.col("content")))
    return rows.select("doc_id", "id", "silo", "fiscal_year", (F.length("body") - 1).cast("long").alias("chars"))


# code




@query(f"""WITH p AS (SELECT p_partkey AS doc_id, 'using A;' || chr(10) || 'namespace N;' AS h, 'class C' || p_partkey AS c, 'int F' || p_size || '(int x) {{ return x; }}' AS f, 'void G() {{ if (a) {{ }} }}' AS g FROM part)
SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, h || chr(10) || c || ' {{ ' || f || ' ' || g || ' }}' AS text FROM p UNION ALL SELECT doc_id, 1, h || chr(10) || c || chr(10) || f FROM p UNION ALL SELECT doc_id, 2, h || chr(10) || c || chr(10) || g FROM p""".replace("{{", "{").replace("}}", "}"))
def chunk_code_members(spark, sf_dir):
    source = F.concat(F.lit("using A;\nnamespace N;\nclass C"), "p_partkey", F.lit(" { int F"), "p_size", F.lit("(int x) { return x; } void G() { if (a) { } } }"))
    return chunking.code_aware(spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("doc_id"), source.alias("text")), between="\n").select("doc_id", "chunk_index", "text")


def tricky_sources(spark, sf_dir):
    piece = lambda *x: F.concat(*[F.col(v[1:]).cast("string") if v.startswith("$p_") else F.lit(v) for v in x])
    source = piece(
        "using A;\nnamespace N\n{\n// } ", "$p_brand", " {\npublic class C", "$p_partkey", ' { string s = "}{ ', "$p_type", '"; char c = \'{\'; int F', "$p_size",
        '(int x) { var t = $"{x} {{ {G("}")}"; return x; } /* } */ string G(string a) => @"""{', "$p_name", '"; enum E { A, B } }\n}\n')
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    return spread(parts).select(F.col("p_partkey").alias("doc_id"), source.alias("text"))


@query(r'''WITH p AS (SELECT p_partkey AS k, 'using A;' || chr(10) || 'namespace N;' || chr(10) AS h, 'public class C' || p_partkey AS c, '// } ' || p_brand || ' {' || chr(10) AS note,
  'string s = "}{ ' || p_type || '"; char c = ''{'';' AS field, 'int F' || p_size || '(int x) { var t = $"{x} {{ {G("}")}"; return x; }' AS f, 'string G(string a) => @"""{' || p_name || '";' AS g, 'enum E { A, B }' AS e FROM part)
SELECT k AS doc_id, CAST(0 AS INTEGER) AS chunk_index, h || chr(10) || note || c || ' { ' || field || ' ' || f || ' /* } */ ' || g || ' ' || e || ' }' AS text FROM p
UNION ALL SELECT k, 1, h || c || chr(10) || chr(10) || f || ' /* } */' FROM p UNION ALL SELECT k, 2, h || c || chr(10) || chr(10) || g FROM p UNION ALL SELECT k, 3, h || c || chr(10) || chr(10) || e FROM p''')
def chunk_code_strings(spark, sf_dir):
    """Members of sources with braces in strings, characters and comments."""
    return chunking.code_aware(tricky_sources(spark, sf_dir)).select("doc_id", "chunk_index", "text")


# audit, compliance, migrations


@query("SELECT event_type AS chain, count(*) AS entries, count(*) FILTER (WHERE event_id % 100 = 7) AS broken, count(*) FILTER (WHERE event_id % 100 = 7) = 0 AND event_type <> (SELECT max(event_type) FROM events) AS whole FROM events GROUP BY event_type")
def audit_tampered(spark, sf_dir):
    """Chains with altered records, and one whose tip is another than was signed."""
    e = table(spark, sf_dir, "events")
    made = security.segmented(e.select(F.col("event_type").alias("chain"), F.col("event_id").alias("seq"), F.to_json(F.struct("event_id", "user_id", "props")).alias("record")), 256)
    last = F.lit(e.agg(F.max("event_type")).first()[0])
    heads = security.heads(made, b"key")
    tips = security.tips(heads, b"key").withColumn("signature", F.when(F.col("chain") == last, "other").otherwise(F.col("signature")))
    return security.verified_segments(made.withColumn("record", F.when(F.col("seq") % 100 == 7, F.concat("record", F.lit(" "))).otherwise(F.col("record"))), heads, tips, b"key")


@query("""WITH m AS (SELECT avg(least(1.0, value / 100)) AS f, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS r, count(*) FILTER (WHERE event_type = 'error') AS x, count(DISTINCT user_id) AS p FROM events),
s AS (SELECT *, rtrim(rtrim(printf('%.3f', f), '0'), '.') AS ft, rtrim(rtrim(printf('%.2f', 100 * r), '0'), '.') || '%' AS rt FROM m)
SELECT 'Faithfulness (today)' AS title, ft AS value, '7-day ' || ft AS detail, 'faithfulness/samples' AS link FROM s UNION ALL SELECT 'PII redaction rate', rt, NULL, 'redaction/events' FROM s UNION ALL SELECT 'Tenant leaks prevented', CAST(x AS VARCHAR), NULL, 'tenant-guard/blocks' FROM s
UNION ALL SELECT 'Active erasure requests', '3', NULL, 'gdpr/requests' UNION ALL SELECT 'Consent coverage', '100%', p || '/' || p || ' (search)', 'consent/coverage' FROM s UNION ALL SELECT 'Open incidents', '0', NULL, 'incidents/open'""")
def dashboard_tiles(spark, sf_dir):
    e, share = table(spark, sf_dir, "events"), F.avg(F.least(F.lit(1.0), F.col("value") / 100))
    metrics = e.agg(
        share.alias("faithfulness_today"), share.alias("faithfulness_7_day"), F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).alias("redaction_rate"), F.count_if(F.col("event_type") == "error").alias("leaks_prevented"),
        F.lit(3).alias("erasures"), F.lit(1.0).alias("coverage"), F.countDistinct("user_id").alias("covered"), F.countDistinct("user_id").alias("people"), F.lit("search").alias("scope"), F.lit(0).alias("open_incidents"))
    return operations.dashboard(metrics)


@query(rf"""WITH i AS (SELECT silo, confidentiality, count(*) AS n FROM {CORPUS_SQL} c GROUP BY ALL), s AS (SELECT string_agg('| ' || silo || ' | ' || n || ' | ' || confidentiality || ' |' || chr(10), '' ORDER BY silo, confidentiality) AS t FROM i),
m AS (SELECT 
  '# Model Card: Answers v1.2' || chr(10) || chr(10) || '_Generated 2024-01-31 00:00:00Z_' || chr(10) || chr(10) || '## Intended Use' || chr(10) || chr(10) || 'Questions' || chr(10) || chr(10) || '## Models' || chr(10) || chr(10) || '| Role | Name | Version |' || chr(10) || '|---|---|---|' || chr(10) || '| chat | c | 1 |' || chr(10) || '| embed | e | 2 |' || chr(10) || chr(10) || '## Data Sources' || chr(10) || chr(10) || '| Silo | Documents | Confidentiality |' || chr(10) || '|---|---|---|' || chr(10) || t || 
  chr(10) || '## Performance Metrics' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|---|---|' || chr(10) || '| hit-rate | 0.917 |' || chr(10) || '| faithfulness | 1 |' || chr(10) || chr(10) || '## Known Failure Modes' || chr(10) || chr(10) || '- stale' || chr(10) || chr(10) || '## Operational Controls' || chr(10) || chr(10) || '- gate' || chr(10) || '- audit' || chr(10) AS markdown FROM s)
SELECT markdown, sha256({O._pad(0x5C)} || unhex(sha256({O._pad(0x36)} || encode(markdown)))) AS signature FROM m""")
def model_card(spark, sf_dir):
    profile = spark.range(1).select(
        F.lit("Answers").alias("system"), F.lit("1.2").alias("version"), F.lit("2024-01-31 00:00:00Z").alias("generated_at"), F.lit("Questions").alias("intended_use"),
        F.expr("array(named_struct('role', 'chat', 'name', 'c', 'version', '1'), named_struct('role', 'embed', 'name', 'e', 'version', '2'))").alias("models"),
        F.expr("array(named_struct('name', 'hit-rate', 'value', 0.9167D), named_struct('name', 'faithfulness', 'value', 1.0D))").alias("metrics"),
        F.array(F.lit("stale")).alias("failures"), F.array(F.lit("gate"), F.lit("audit")).alias("controls"))
    inventory = corpus(spark, sf_dir).groupBy("silo", "confidentiality").agg(F.count("*").alias("documents"))
    return operations.model_card(profile, inventory, O.KEY)


@query("""SELECT event_id, 'Confidence=' || rtrim(rtrim(printf('%.2f', (event_id % 4) * 0.25), '0'), '.') || ';Sources=2;Model=m' AS chips, event_type = 'error' AS full_panel, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS cited, CASE WHEN event_type = 'error' THEN 'm 1' END AS model, CASE WHEN event_type = 'error' THEN 'request-human-review' END AS action FROM events""")
def explanation_panels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "High").otherwise("Low").alias("risk"), ((F.col("event_id") % 4) * 0.25).alias("confidence"), F.array("event_id", "user_id").alias("citations"),
        F.array(F.lit("a")).alias("reasoning"), F.lit("m").alias("model_name"), F.lit("1").alias("model_version"))
    return operations.explanations(rows).select("event_id", "chips", "full_panel", F.size("cited").alias("cited"), "model", "action")


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS longest, count(value) AS samples, event_type FROM events GROUP BY event_type")
def load_report(spark, sf_dir):
    return operations.load_report(table(spark, sf_dir, "events"), "value", ("event_type",))


@query("SELECT doc_id || '#0' AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'old' ELSE 'new' END AS embedding_model FROM documents")
def backfill_schedules(spark, sf_dir):
    """Three paced batches over the chunks that no earlier run has done; what was done keeps its row."""
    rows = O._chunks(spark, sf_dir)
    done = table(spark, sf_dir, "labels").select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"))
    for upserts, _ in operations.backfilled(O._chunks(spark, sf_dir), done, "new", lambda c: c, "trickle", 3):
        rows = rows.join(upserts.select("chunk_id"), "chunk_id", "left_anti").unionByName(upserts)
    return rows.select("chunk_id", "embedding_model")


@query("SELECT count(*) + 1 AS chunks, 'new' AS serving, 'old' AS rollback, true AS cut_over FROM documents")
def reindex(spark, sf_dir):
    live = O._chunks(spark, sf_dir)
    late = live.limit(1).withColumn("chunk_id", F.lit("late#0"))
    serving, rollback, ready = operations.reindexed(live, late, "new", lambda c: c, lambda c: c.where("hash is not null").count())
    return serving.agg(F.count("*").alias("chunks"), F.min("embedding_model").alias("serving")).crossJoin(rollback.agg(F.max("embedding_model").alias("rollback"))).withColumn("cut_over", F.lit(ready))
