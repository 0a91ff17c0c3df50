"""Queries over ranking, fusion, retrieval, graphs, structure and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ragspark.functions import text as T
from ragspark.operators import embedding, fusion, graph, lexical, retrieval, routing, structure
from ragspark.operators.filters import within_clearance
from ragspark.plans.common import CORPUS_SQL, POSTINGS_SQL, WORDS, asked_vectors, chunks, corpus, dense, dense_sql, hits_sql, nearest_sql, questions, rrf_sql, shown, sparse, sparse_sql, table, vectors

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {POSTINGS_SQL}, {sparse_sql()} {hits_sql('sparse')}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(sparse(spark, sf_dir))


_TURNS = "(SELECT conv_id * 100000 + turn AS query_id, text FROM conversations WHERE role = 'user')"


@query(f"WITH {POSTINGS_SQL}, {sparse_sql(3, source=_TURNS)} {hits_sql('sparse')}")
def bm25_batch(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), "text")
    return shown(lexical.bm25(asked, chunks(spark, sf_dir), 3))


@query(f"WITH {dense_sql()} {hits_sql('dense')}")
def dense_bow_topk(spark, sf_dir):
    return shown(dense(spark, sf_dir))


_BOTH = f"WITH {dense_sql()}, {POSTINGS_SQL}, {sparse_sql()}"


@query(f"{_BOTH}, {rrf_sql('dense', 'sparse', 10, 'f')} {hits_sql('f')}")
def rrf_merge(spark, sf_dir):
    return shown(fusion.rrf(dense(spark, sf_dir), sparse(spark, sf_dir), 10))


def _scaled_sql(name: str) -> str:
    return f"{name}_x AS (SELECT *, (score - min(score) OVER (PARTITION BY query_id)) / greatest(max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id), 1e-9) AS s FROM {name})"


@query(f"""{_BOTH}, {_scaled_sql('dense')}, {_scaled_sql('sparse')},
f0 AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, x.rank AS ra, y.rank AS rb, round(0.6 * coalesce(x.s, 0) + 0.4 * coalesce(y.s, 0), 9) AS score
  FROM dense_x x FULL JOIN sparse_x y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id),
f AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM f0 QUALIFY rank <= 10) {hits_sql('f')}""")
def fuse_weighted(spark, sf_dir):
    return shown(fusion.weighted(dense(spark, sf_dir), sparse(spark, sf_dir), 0.6, 0.4, 10))


@query(f"""{_BOTH}, s5 AS (SELECT * FROM sparse WHERE score >= 12), {rrf_sql('s5', 'dense', 10, 'f')},
n AS (SELECT query_id FROM s5 GROUP BY query_id HAVING count(*) >= 3)
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM s5 WHERE query_id IN (SELECT query_id FROM n)
UNION ALL SELECT query_id, rank, chunk_id, round(score, 6) FROM f WHERE query_id NOT IN (SELECT query_id FROM n)""")
def fuse_cascade(spark, sf_dir):
    return shown(fusion.cascade(sparse(spark, sf_dir).where("score >= 12"), dense(spark, sf_dir), 10))


@query(f"WITH {POSTINGS_SQL}, {sparse_sql()}, n AS (SELECT *, rank - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM sparse) SELECT query_id, rank, chunk_id, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS BIGINT) AS position FROM n")
def interleave(spark, sf_dir):
    return fusion.interleaved(sparse(spark, sf_dir)).select("query_id", "rank", "chunk_id", "position")


_LINE = "CAST(ceil(length('[Source ' || rank || '] ' || text || chr(10)) / 4.0) AS BIGINT)"


@query(f"WITH {POSTINGS_SQL}, {sparse_sql()}, t AS (SELECT query_id, rank, chunk_id, sum({_LINE}) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM sparse JOIN documents ON doc_id = chunk_id) SELECT query_id, rank, chunk_id, CAST(used AS BIGINT) AS used FROM t WHERE used <= 3000")
def context_pack(spark, sf_dir):
    line = F.concat(F.lit("[Source "), "rank", F.lit("] "), "text", F.lit("\n"))
    hits = sparse(spark, sf_dir).join(chunks(spark, sf_dir), "chunk_id").select("query_id", "rank", "chunk_id", T.tokens_estimated(line).alias("tokens"))
    return fusion.packed(hits, budget=3000).select("query_id", "rank", "chunk_id", "used")


# each step picks, a query, the candidate of the best balance of relevance and likeness to those already picked
@query(f"""WITH RECURSIVE {nearest_sql(20)}, c AS (SELECT query_id, list({{'id': chunk_id, 'r': score, 'e': list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))}} ORDER BY score DESC, chunk_id) AS c FROM near JOIN v ON vec_id = chunk_id GROUP BY query_id),
s AS (SELECT query_id, 0 AS k, CAST([] AS BIGINT[]) AS chosen FROM c UNION ALL
  SELECT query_id, k + 1, list_append(chosen, list_aggregate(list_transform(list_filter(generate_series(1, len(c)), lambda i: NOT list_contains(chosen, i)),
    lambda i: {{'g': -round(0.5 * c[i].r - 0.5 * greatest(0, coalesce(list_max(list_transform(chosen, lambda j: list_inner_product(c[i].e, c[j].e))), 0)), 12), 'i': i}}), 'min').i) FROM s JOIN c USING (query_id) WHERE k < 5 AND k < len(c))
SELECT query_id, CAST(j AS INTEGER) AS rank, c[chosen[j]].id AS chunk_id, round(c[chosen[j]].r, 6) AS score FROM (SELECT * FROM s JOIN c USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1), generate_series(1, 5) g(j) WHERE j <= len(chosen)""")
def mmr_select(spark, sf_dir):
    hits = embedding.neighbours(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 20)
    candidates = hits.join(vectors(spark, sf_dir), "chunk_id").select("query_id", "chunk_id", F.col("score").alias("relevance"), "embedding")
    return shown(fusion.mmr(candidates, 5))


_OVERLAP = "round(len(list_intersect(q.w, d.w)) / len(q.w), 9)"


@query(f"""WITH {POSTINGS_SQL}, {sparse_sql(20)}, q AS (SELECT item_id AS id, list_distinct({WORDS.format(t='text')}) AS w FROM benchmark), d AS (SELECT doc_id AS id, list_distinct({WORDS.format(t='text')}) AS w FROM documents),
s AS (SELECT query_id, chunk_id, rank AS old, {_OVERLAP} AS score FROM sparse JOIN q ON q.id = query_id JOIN d ON d.id = chunk_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM s QUALIFY rank <= 5) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE score >= 0.3""")
def rerank_overlap(spark, sf_dir):
    hits = sparse(spark, sf_dir, 20)
    words = lambda rows, key, name: rows.select(key, F.array_distinct(T.word_tokens("text")).alias(name))
    pairs = hits.join(words(questions(spark, sf_dir), "query_id", "query_words"), "query_id").join(words(chunks(spark, sf_dir), "chunk_id", "chunk_words"), "chunk_id").drop("score")
    return shown(fusion.reranked(hits, fusion.overlap_scores(pairs).select("query_id", "chunk_id", "score"), 5, 0.3))


@query(f"WITH {dense_sql(15)}, {POSTINGS_SQL}, {sparse_sql(15)}, {rrf_sql('dense', 'sparse', 5, 'f')} {hits_sql('f')}")
def hybrid_rrf(spark, sf_dir):
    q, c = questions(spark, sf_dir), chunks(spark, sf_dir)
    return shown(retrieval.hybrid(q, c, embedding.bow_blocks(q, "query_id"), embedding.bow_blocks(c, "chunk_id"), 5, times=3))


_HALF = "length(text) // 2"
_V1 = f"(SELECT item_id AS query_id, trim(substring(text, 1, {_HALF})) AS text FROM benchmark WHERE trim(substring(text, 1, {_HALF})) <> '')"
_V2 = f"(SELECT item_id AS query_id, trim(substring(text, {_HALF} + 1)) AS text FROM benchmark WHERE trim(substring(text, {_HALF} + 1)) <> '')"


def _halves(spark, sf_dir):
    q = questions(spark, sf_dir)
    flat = F.regexp_replace("text", "\n", " ")
    half = F.floor(F.length(flat) / 2).cast("int")
    return q, q.select("query_id", F.concat(F.substring(flat, F.lit(1), half), F.lit("\n"), F.substring(flat, half + 1, F.length(flat))).alias("reply"))


@query(f"""WITH {POSTINGS_SQL}, {sparse_sql(10, 'v0')}, {sparse_sql(10, 'v1', _V1)}, {sparse_sql(10, 'v2', _V2)},
{rrf_sql('v0', 'v1', 10, 'f1')}, {rrf_sql('f1', 'v2', 10, 'f2')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM f2 WHERE rank <= 5""")
def rag_fusion_fold(spark, sf_dir):
    q, replies = _halves(spark, sf_dir)
    asked = retrieval.variants(q, replies)
    return shown(retrieval.rag_fusion(lexical.Index(asked, chunks(spark, sf_dir)).search, asked, 5, most=2, together=True))


@query(f"""WITH {POSTINGS_SQL}, {sparse_sql(10, 'v0')}, {sparse_sql(10, 'v1', _V1)}, {rrf_sql('v0', 'v1', 5, 'f')} {hits_sql('f')}""")
def stepback_fuse(spark, sf_dir):
    q, replies = _halves(spark, sf_dir)
    broader = replies.select("query_id", F.substring_index("reply", "\n", 1).alias("reply"))
    index = lexical.Index(q.unionByName(broader.withColumnRenamed("reply", "text")), chunks(spark, sf_dir))
    return shown(retrieval.step_back(index.search, q, broader, 5))


@query(f"WITH {POSTINGS_SQL}, {sparse_sql(5, 'v1', _V2)} {hits_sql('v1')}")
def hyde_topk(spark, sf_dir):
    q, replies = _halves(spark, sf_dir)
    passages = replies.select("query_id", F.substring_index("reply", "\n", -1).alias("reply"))
    return shown(lexical.bm25(retrieval.hyde(q, passages), chunks(spark, sf_dir), 5))


@query(f"""WITH {dense_sql(5)}, {POSTINGS_SQL}, {sparse_sql(10)},
g AS (SELECT s.* FROM sparse s LEFT JOIN labels ON doc_id = chunk_id WHERE coalesce(quality, -1) = 1),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM g),
u AS (SELECT * FROM k UNION ALL SELECT * FROM dense WHERE query_id NOT IN (SELECT query_id FROM k) AND query_id IN (SELECT query_id FROM sparse)) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM u WHERE rank <= 5""")
def crag_filter(spark, sf_dir):
    hits = sparse(spark, sf_dir, 10)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    grades = hits.join(labels, "chunk_id", "left").select("query_id", "chunk_id", F.when(F.col("quality") == 1, "CORRECT").otherwise("INCORRECT").alias("grade"))
    return shown(retrieval.corrective(hits, grades, dense(spark, sf_dir, 5), 5))


@query(f"""WITH {POSTINGS_SQL}, {sparse_sql(1_000_000_000)}, c AS (SELECT query_id, chunk_id, score, CASE WHEN confidentiality IS DISTINCT FROM 'Internal' THEN 4 WHEN silo <> 'src3' THEN 3 WHEN office <> 'en' THEN 2 WHEN fiscal_year <= 2020 THEN 1 ELSE 0 END AS level
  FROM sparse JOIN {CORPUS_SQL} d ON d.doc_id = chunk_id WHERE confidentiality IN ('Public', 'Internal', 'Restricted')),
b AS (SELECT *, min(level) OVER (PARTITION BY query_id) AS best FROM c)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score, level FROM b WHERE level = best QUALIFY rank <= 5""")
def self_query_relax(spark, sf_dir):
    asked, rows = questions(spark, sf_dir), corpus(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")
    constraints = [F.col("confidentiality") == "Internal", F.col("silo") == "src3", F.col("office") == "en", F.col("fiscal_year") > 2020]
    levels = rows.where(within_clearance("Restricted")).select("chunk_id", retrieval.relaxation(constraints).alias("level"))
    return shown(retrieval.least_level(lexical.Index(asked, chunks(spark, sf_dir)).search(asked, 5, levels=levels), 5))


# questions by id, and the route that each must take
_ROUTED = (
    ("Article {}", "structural"), ("what does section {}.1 say about leave days", "vector"), ("what does § {}.1b say about leave days", "both"), ("article {}", "vector"),
    ("please show me §{}", "structural"), ("please kindly show me RFC {}", "structural"), ("now please kindly show me RFC {}", "both"), ("leave days", "vector"),
)
_ROUTE_CASES = " ".join(f"WHEN {i} THEN '{route}'" for i, (_, route) in enumerate(_ROUTED))


@query(f"SELECT doc_id AS query_id, CASE doc_id % {len(_ROUTED)} {_ROUTE_CASES} END AS route FROM documents")
def structural_route(spark, sf_dir):
    texts = F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("doc_id").cast("string")) for t, _ in _ROUTED])
    text = F.element_at(texts, (F.col("doc_id") % len(_ROUTED) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), retrieval.structural_route(text).alias("route"))


@query(f"""WITH {POSTINGS_SQL}, {sparse_sql(5)}, c AS (SELECT 'retr:5:' || lower(trim(text)) AS key, chunk_id FROM sparse JOIN benchmark ON item_id = query_id),
gone AS (SELECT DISTINCT key FROM c JOIN labels ON doc_id = chunk_id WHERE quality = 0)
SELECT DISTINCT key, key NOT IN (SELECT key FROM gone) AS kept FROM c""")
def cache_invalidation(spark, sf_dir):
    cited = sparse(spark, sf_dir, 5).join(questions(spark, sf_dir), "query_id").select(retrieval.cache_key("text", 5).alias("key"), F.concat("chunk_id", F.lit("#0")).alias("chunk_id"))
    changed = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("document_id"))
    kept, removed = retrieval.invalidated(cited.select("key").distinct(), cited, changed)
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False)))


def _entities(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.lit(0).alias("chunk_id"), F.col("r_regionkey").alias("pos"), F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit("Region").alias("type"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.lit(1).alias("chunk_id"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.lit(2).alias("chunk_id"), F.col("s_suppkey").cast("int").alias("pos"), F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit("Supplier").alias("type"), F.col("s_name").alias("name"))
    again = r.withColumn("chunk_id", F.lit(3)).withColumn("id", F.concat(F.lit("X"), "id")).withColumn("name", F.upper("name"))
    return r.unionByName(n).unionByName(s).unionByName(again).withColumn("properties", F.create_map(F.lit("kind"), F.col("type")))


def _relations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("from_id"), F.concat(F.lit("R"), "n_regionkey").alias("to_id"), F.lit("IN").alias("type"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("from_id"), F.concat(F.lit("N"), "s_nationkey").alias("to_id"), F.lit("IN").alias("type"))
    dangling = table(spark, sf_dir, "region").select(F.concat(F.lit("XR"), "r_regionkey").alias("from_id"), F.concat(F.lit("R"), "r_regionkey").alias("to_id"), F.lit("SAME").alias("type"))
    return n.unionByName(s).unionByName(dangling)


_EDGES = "e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


@query(f"WITH {_EDGES} SELECT a AS from_id, b AS to_id FROM e")
def graph_build(spark, sf_dir):
    return graph.built(_entities(spark, sf_dir), _relations(spark, sf_dir))[1].select("from_id", "to_id")


@query(f"""WITH {_EDGES}, h1 AS (SELECT DISTINCT 'r' || r_regionkey AS q, b AS id FROM region JOIN u ON a = 'r' || r_regionkey),
h2 AS (SELECT DISTINCT q, u.b AS id FROM h1 JOIN u ON u.a = h1.id WHERE u.b <> q)
SELECT q AS query_id, id, CAST(1 AS INTEGER) AS depth FROM h1 UNION ALL SELECT q, id, 2 FROM h2 WHERE (q, id) NOT IN (SELECT q, id FROM h1)""")
def k_hop(spark, sf_dir):
    vertices, edges = graph.built(_entities(spark, sf_dir), _relations(spark, sf_dir))
    seeds = vertices.where("type = 'Region'").select(F.col("id").alias("query_id"), "id")
    return graph.k_hop(seeds, edges)


@query(f"""WITH {_EDGES}, h AS (SELECT 'r' || r_regionkey AS q, b AS id FROM region JOIN u ON a = 'r' || r_regionkey)
SELECT q AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY id) AS INTEGER) AS rank, id, 'Nation: ' || n_name || ' (kind=Nation)' AS text, round(1.0 / row_number() OVER (PARTITION BY q ORDER BY id), 6) AS score FROM h JOIN nation ON id = 'n' || n_nationkey""")
def graph_retrieve(spark, sf_dir):
    vertices, edges = graph.built(_entities(spark, sf_dir), _relations(spark, sf_dir))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("query_id"), F.concat(F.lit("What lies in "), F.lower("r_name"), F.lit("?")).alias("text"))
    return shown(graph.graph_hits(graph.k_hop(graph.seeds_in(regions, vertices), edges, 1), vertices))


@query(f"""WITH RECURSIVE {_EDGES}, v AS (SELECT a AS id FROM u UNION SELECT 'r' || r_regionkey FROM region), w AS (SELECT id, id AS r FROM v UNION SELECT w.id, u.b FROM w JOIN u ON w.r = u.a),
c AS (SELECT id, min(r) AS component FROM w GROUP BY id), g AS (SELECT component, string_agg(id, ',' ORDER BY id) AS members FROM c GROUP BY component)
SELECT 'community-' || (row_number() OVER (ORDER BY component) - 1) AS community, members FROM g""")
def communities(spark, sf_dir):
    vertices, edges = graph.built(_entities(spark, sf_dir), _relations(spark, sf_dir))
    return graph.communities(vertices.select("id"), edges).select("community", F.array_join("members", ",").alias("members"))


@query("SELECT s_nationkey AS nation, sha256(string_agg(DISTINCT 's' || s_suppkey, chr(0) ORDER BY 's' || s_suppkey)) AS key FROM supplier GROUP BY s_nationkey")
def summary_key(spark, sf_dir):
    ids = F.collect_list(F.concat(F.lit("s"), "s_suppkey"))
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(graph.summary_key(ids).alias("key"))


def _handbook(spark, sf_dir):
    """A Markdown document a region, with an article a nation that refers to the next one."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(F.lit("## Article "), "n_nationkey", F.lit("\n"), "n_name", F.lit(" refers to Article "), F.col("n_nationkey") + 1, F.lit(" and article "), F.col("n_nationkey") + 2)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("t")))), lambda s: s["t"]), "\n")
    return n.groupBy("r_regionkey", "r_name").agg(body.alias("b")).select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("Hand Book").alias("title"), F.concat(F.lit("About\n# "), "r_name", F.lit("\nPreface\n"), "b").alias("text"))


@query("""WITH r AS (SELECT CAST(r_regionkey AS BIGINT) AS doc_id, r_name, regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g') AS slug FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation))
SELECT doc_id, 'hand-book' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'Hand Book' AS path, CAST(0 AS INTEGER) AS level, 'About' AS text FROM r
UNION ALL SELECT doc_id, 'hand-book-' || slug, 'hand-book', 'Hand Book/' || r_name, 1, 'Preface' FROM r
UNION ALL SELECT n_regionkey, 'Art' || n_nationkey, 'hand-book-' || slug, 'Hand Book/' || r_name || '/Article ' || n_nationkey, 2, n_name || ' refers to Article ' || (n_nationkey + 1) || ' and article ' || (n_nationkey + 2) FROM nation JOIN r ON n_regionkey = doc_id""")
def heading_tree(spark, sf_dir):
    return structure.nodes(_handbook(spark, sf_dir))[0].select("doc_id", "node_id", "parent_id", "path", "level", "text")


@query("""WITH RECURSIVE l AS (SELECT CAST(a.n_regionkey AS BIGINT) AS doc_id, 'Art' || a.n_nationkey AS a, 'Art' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 1),
w AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, 'Art' || n_nationkey AS start, 'Art' || n_nationkey AS node_id, 0 AS depth FROM nation UNION ALL SELECT w.doc_id, start, b, depth + 1 FROM w JOIN l ON w.doc_id = l.doc_id AND w.node_id = l.a WHERE depth < 3)
SELECT doc_id, start, node_id, CAST(depth AS INTEGER) AS depth FROM w""")
def xref_walk(spark, sf_dir):
    sections = structure.nodes(_handbook(spark, sf_dir))[0]
    return structure.walked(sections.where("level = 2").select("doc_id", "node_id"), structure.references(sections), 3)


@query("""SELECT CAST(a.n_regionkey AS BIGINT) AS doc_id, 'Art' || a.n_nationkey AS node_id, 'Art' || b.n_nationkey AS sibling FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def section_siblings(spark, sf_dir):
    return structure.siblings(structure.nodes(_handbook(spark, sf_dir))[0])


# every other question names no article and takes what the fallback finds
@query(f"""WITH {POSTINGS_SQL}, q AS (SELECT n_nationkey AS query_id, n_regionkey AS r, n_name FROM nation WHERE n_nationkey % 2 = 0), {sparse_sql(3, 'f', "(SELECT n_nationkey AS query_id, 'about the ' || n_name || ' and the rest' AS text FROM nation WHERE n_nationkey % 2 = 1)")},
h AS (SELECT query_id, query_id AS n, r, 0 AS depth FROM q UNION ALL SELECT q.query_id, b.n_nationkey, r, 1 FROM q JOIN nation b ON b.n_regionkey = r AND b.n_nationkey = query_id + 1),
t AS (SELECT query_id, depth, 'Art' || n AS chunk_id, '/Hand Book/' || r_name || '/Article ' || n || chr(10) || chr(10) || n_name || ' refers to Article ' || (n + 1) || ' and article ' || (n + 2) AS text FROM h JOIN nation ON n_nationkey = n JOIN region ON r_regionkey = r)
SELECT query_id, CAST(depth + 1 AS INTEGER) AS rank, chunk_id, text, round(1.0 / (depth + 1), 6) AS score FROM t
UNION ALL SELECT query_id, rank, CAST(chunk_id AS VARCHAR), text, round(score, 6) FROM f JOIN documents ON doc_id = chunk_id""")
def structural_retrieve(spark, sf_dir):
    named = F.col("n_nationkey") % 2 == 0
    text = F.when(named, F.concat(F.lit("Show Article "), "n_nationkey")).otherwise(F.concat(F.lit("about the "), "n_name", F.lit(" and the rest")))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), text.alias("text"))
    c = chunks(spark, sf_dir)
    fallback = lexical.bm25(asked.where(~F.contains("text", F.lit("Article"))), c, 3).join(c, "chunk_id")
    return shown(structure.structural_retrieve(asked, structure.nodes(_handbook(spark, sf_dir))[0], 3, fallback))


# fixed values, as the SQL side states them: the keywords of each silo
_KEYWORDS_SQL = """k(silo, word) AS (VALUES
  ('hr-policies', 'policy'), ('hr-policies', 'leave'), ('hr-policies', 'vacation'), ('hr-policies', 'sick'), ('hr-policies', 'remote'), ('hr-policies', 'parental'), ('hr-policies', 'salary'), ('hr-policies', 'probation'), ('hr-policies', 'onboarding'),
  ('technical-docs', 'api'), ('technical-docs', 'endpoint'), ('technical-docs', 'deploy'), ('technical-docs', 'service'), ('technical-docs', 'runbook'), ('technical-docs', 'adr'), ('technical-docs', 'architecture'), ('technical-docs', 'rate limit'),
  ('financial-reports', 'revenue'), ('financial-reports', 'q1'), ('financial-reports', 'q2'), ('financial-reports', 'q3'), ('financial-reports', 'q4'), ('financial-reports', 'budget'), ('financial-reports', 'forecast'), ('financial-reports', 'fiscal'), ('financial-reports', 'operating margin'),
  ('legal-contracts', 'contract'), ('legal-contracts', 'nda'), ('legal-contracts', 'sow'), ('legal-contracts', 'clause'), ('legal-contracts', 'terminate'), ('legal-contracts', 'termination'), ('legal-contracts', 'agreement'), ('legal-contracts', 'license'),
  ('product-catalog', 'pricing'), ('product-catalog', 'tier'), ('product-catalog', 'feature'), ('product-catalog', 'starter'), ('product-catalog', 'team'), ('product-catalog', 'business'), ('product-catalog', 'enterprise'), ('product-catalog', 'specification'),
  ('release-notes-tickets', 'release notes'), ('release-notes-tickets', 'release'), ('release-notes-tickets', 'ticket'), ('release-notes-tickets', 'regression'), ('release-notes-tickets', 'hotfix'), ('release-notes-tickets', 'support ticket'))"""
# what stands behind every passage by its id
_TAILS = ("How much parental leave?", "Deploy the API service by the runbook", "Q3 budget and fiscal forecast", "Terminate the NDA", "Pricing of the enterprise tier", "Which hotfix closed the support ticket?", "policy and contract", "")
_TAILED_SQL = "(SELECT item_id, text || ' ' || [" + ", ".join(f"'{t}'" for t in _TAILS) + f"][CAST(item_id % {len(_TAILS)} + 1 AS INTEGER)] AS text FROM benchmark)"
_RULES_SQL = f"""{_KEYWORDS_SQL}, h AS (SELECT item_id AS query_id, silo, count(*) AS n FROM {_TAILED_SQL} JOIN k ON contains(lower(text), word) GROUP BY ALL),
rules AS (SELECT query_id, list(silo ORDER BY silo) AS silos, least(1.0, 0.25 * max(n)) AS confidence FROM (SELECT *, max(n) OVER (PARTITION BY query_id) AS top FROM h) WHERE n = top GROUP BY query_id)"""


def _rules(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("query_id") % len(_TAILS) + 1).cast("int"))
    return routing.by_rules(questions(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), tail)))


@query(f"WITH {_RULES_SQL} SELECT item_id AS query_id, coalesce(array_to_string(silos, ','), '') AS silos, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence FROM benchmark LEFT JOIN rules ON item_id = query_id")
def route_rules(spark, sf_dir):
    return _rules(spark, sf_dir).select("query_id", F.array_join("silos", ",").alias("silos"), "confidence")


_MEANING_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(e[i]) AS x FROM v, generate_series(1, 64) g(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id AS query_id, 's' || c.label AS silo, round(greatest(0, list_cosine_similarity(e, c)), 9) AS s FROM v, c WHERE vec_id % 20 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, silo) AS p FROM s),
m AS (SELECT query_id, string_agg(silo, ',' ORDER BY silo) AS silos, max(s) AS confidence FROM p WHERE s >= 0.35 OR p = 1 GROUP BY query_id)"""


def _meaning(spark, sf_dir):
    exemplars = embedding.centroid(vectors(spark, sf_dir), ["label"]).select(F.concat(F.lit("s"), "label").alias("silo"), F.col("centroid").alias("embedding"))
    return routing.by_meaning(asked_vectors(spark, sf_dir), exemplars)


@query(f"WITH {_MEANING_SQL} SELECT query_id, silos, round(confidence, 6) AS confidence FROM m")
def route_semantic(spark, sf_dir):
    return _meaning(spark, sf_dir).select("query_id", F.array_join("silos", ",").alias("silos"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_RULES_SQL}, {_MEANING_SQL}, r AS (SELECT item_id AS query_id, coalesce(silos, []) AS silos, coalesce(confidence, 0) AS confidence FROM benchmark LEFT JOIN rules ON item_id = query_id)
SELECT r.query_id, CASE WHEN r.confidence >= 0.5 THEN array_to_string(r.silos, ',') ELSE array_to_string(list_sort(list_distinct(list_concat(r.silos, coalesce(string_split(m.silos, ','), [])))), ',') END AS silos,
round(CAST(CASE WHEN r.confidence >= 0.5 THEN r.confidence ELSE greatest(r.confidence, coalesce(m.confidence, 0)) END AS DOUBLE), 6) AS confidence, r.confidence < 0.5 AS escalated FROM r LEFT JOIN m USING (query_id)""")
def route_multi(spark, sf_dir):
    return routing.merged(_rules(spark, sf_dir), _meaning(spark, sf_dir)).select("query_id", F.array_join("silos", ",").alias("silos"), F.round("confidence", 6).alias("confidence"), "escalated")


@query(f"WITH {_RULES_SQL}, x AS (SELECT unnest(silos) AS silo, confidence FROM rules) SELECT silo, 'rules' AS strategy, count(*) AS decisions, round(CAST(avg(confidence) AS DOUBLE), 6) AS mean_confidence, CAST(sum(CASE WHEN confidence < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS escalations FROM x GROUP BY silo")
def routing_metrics(spark, sf_dir):
    return routing.metrics(_rules(spark, sf_dir).withColumn("escalated", F.col("confidence") < 0.5), "rules")


@query("""WITH h AS (SELECT conv_id, turn, role, text, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS h FROM conversations)
SELECT conv_id, turn, CASE WHEN h IS NULL THEN text ELSE h || chr(10) || 'Question: ' || text END AS prompt FROM h WHERE role = 'user'""")
def rewrite_prompt(spark, sf_dir):
    return routing.rewrite_prompts(table(spark, sf_dir, "conversations"))


@query("SELECT doc_id, 'HR' AS department, CAST(NULL AS VARCHAR) AS office, CASE WHEN 1900 + doc_id % 300 BETWEEN 2000 AND 2100 THEN CAST(1900 + doc_id % 300 AS INTEGER) END AS fiscal_year FROM labels")
def nl_filter(spark, sf_dir):
    year = (1900 + F.col("doc_id") % 300).cast("string")
    reply = F.concat(F.lit('Here: {"department": "HR", "office": "Atlantis", "fiscalYear": '), year, F.lit("} done"))
    f = routing.extracted_filter(reply)
    return table(spark, sf_dir, "labels").select("doc_id", f.alias("f")).select("doc_id", "f.department", "f.office", "f.fiscal_year")


