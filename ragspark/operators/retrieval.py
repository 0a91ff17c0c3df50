"""Retrievers composed of rankings: hybrid, corrective, self-query with relaxation, structural routing, caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragspark.operators import fusion
from ragspark.operators.embedding import neighbours
from ragspark.operators.lexical import bm25
from ragspark.sources.shared import cut

MODES = ("dense", "sparse", "hybrid")
# fixed values: what a failed stream says
FAILED = "The answer could not be generated. Please try again."
Retriever = Callable[[DataFrame, int], DataFrame]


def candidate_count(k: int) -> int:
    return max(2 * k, k + 5)


def hybrid(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int, times: int | None = None) -> DataFrame:
    """Dense and BM25 candidates (max(2k, k + 5), or ``times`` k), fused by rank."""
    wide = times * k if times else candidate_count(k)
    return fusion.rrf(neighbours(query_vectors, vectors, wide), bm25(queries, docs, wide), k)


def by_mode(mode: str, dense: Retriever, sparse: Retriever) -> Retriever:
    """The retriever of a mode name, trimmed and in any case."""
    name = mode.strip().lower()
    if name not in MODES:
        raise ValueError(f"unknown retriever mode {mode!r}")
    both = lambda q, k: fusion.rrf(dense(q, candidate_count(k)), sparse(q, candidate_count(k)), k)
    return {"dense": dense, "sparse": sparse, "hybrid": both}[name]


def hyde(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Queries (query_id, text) with a hypothetical passage (query_id, reply) in their place, unless it is blank."""
    reply = F.when(F.trim("reply") != "", F.col("reply"))
    return queries.join(passages, "query_id", "left").select("query_id", F.coalesce(reply, "text").alias("text"))


def variants(queries: DataFrame, replies: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, variant, text): the query itself as variant 0 and up to ``most`` non-blank lines of the reply."""
    lines = F.slice(F.filter(F.transform(F.split("reply", "\n"), lambda t: F.trim(t)), lambda t: t != ""), 1, most)
    more = replies.select("query_id", F.posexplode(lines).alias("i", "text")).select("query_id", (F.col("i") + 1).alias("variant"), "text")
    return queries.select("query_id", F.lit(0).alias("variant"), "text").unionByName(more)


def rag_fusion(retrieve: Retriever, asked: DataFrame, k: int, most: int = 3, together: bool = False) -> DataFrame:
    """Retrieves each variant and folds the lists from the left. ``together``: in one search, for retrievers that take any
    kind of query_id."""
    if together:
        found = cut(retrieve(asked.select(F.struct("query_id", "variant").alias("query_id"), "text"), 2 * k))
        lists = [found.where(F.col("query_id.variant") == i).withColumn("query_id", F.col("query_id.query_id")) for i in range(most + 1)]
    else:
        lists = [retrieve(asked.where(F.col("variant") == i).select("query_id", "text"), 2 * k) for i in range(most + 1)]
    return fusion.rag_fusion(lists, k)


ENHANCEMENTS = ("hyde", "rag-fusion", "crag", "stepback")


def enhanced(name: str, inner: Retriever, replies: DataFrame, fallback: Retriever | None = None) -> Retriever:
    """``inner`` with an enhancement, by its name in any case. ``replies`` are a model's answers: (query_id, reply) as passage,
    variants or broader question, or (query_id, chunk_id, grade) for crag, which asks ``fallback`` where nothing is left."""
    kind = name.strip().lower()
    if kind == "hyde":
        return lambda q, k: inner(hyde(q, replies), k)
    if kind == "rag-fusion":
        return lambda q, k: rag_fusion(inner, variants(q, replies), k)
    if kind == "stepback":
        return lambda q, k: step_back(inner, q, replies, k)
    if kind == "crag":
        other = fallback or (lambda q, k: inner(q, k).where("false"))
        return lambda q, k: corrective(inner(q, k), replies, other(q, k), k)
    raise ValueError(f"unknown enhancement {name!r}: not one of {ENHANCEMENTS}")


def vector_graph(dense: DataFrame, graph: DataFrame, k: int, how: str = "rrf") -> DataFrame:
    """Fuses dense hits and graph hits (max(2k, k + 5) of each). Graph hits carry entity ids; both go by string ids."""
    wide = candidate_count(k)
    ids = lambda hits, key: hits.where(F.col("rank") <= wide).select("query_id", "rank", F.col(key).cast("string").alias("chunk_id"), "score")
    return fusion.fused(ids(dense, "chunk_id"), ids(graph, "id" if "id" in graph.columns else "chunk_id"), how, k)


def response_key(text) -> Column:
    return F.concat(F.lit("resp:"), F.lower(F.trim(text)))


def events(answers: DataFrame) -> DataFrame:
    """(query_id, seq, kind, token, sources) of answers (query_id, sources, tokens array<string>, fault): Sources, a Token
    each that is not empty, Done. A fault "prepare" gives one Error alone, a fault "generate" one Error behind the tokens;
    no other detail of a fault is shown."""
    source = F.array(F.struct(F.lit("Sources").alias("kind"), F.lit(None).cast("string").alias("token"), F.col("sources")))
    none = F.lit(None).cast(answers.schema["sources"].dataType)
    tokens = F.transform(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t != ""), lambda t: F.struct(F.lit("Token").alias("kind"), t.alias("token"), none.alias("sources")))
    end = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(text).cast("string").alias("token"), none.alias("sources")))
    failed = end("Error", FAILED)
    rows = F.when(F.col("fault") == "prepare", failed).when(F.col("fault").isNotNull(), F.concat(source, tokens, failed)).otherwise(F.concat(source, tokens, end("Done", None)))
    return answers.select("query_id", F.posexplode(rows).alias("seq", "e")).select("query_id", "seq", "e.*")


def replayed(queries: DataFrame, cache: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(events, missing): queries whose response (key, answer, sources, expires_at) is alive replay as Sources, one Token and
    Done; the others are to be answered."""
    keyed = queries.withColumn("key", response_key("text"))
    live = cache.where(F.col("expires_at") > F.lit(now))
    hits = keyed.join(live, "key").select("query_id", "sources", F.array("answer").alias("tokens"), F.lit(None).cast("string").alias("fault"))
    return events(hits), keyed.join(live.select("key"), "key", "left_anti")


def stored(streamed: DataFrame, queries: DataFrame, expires_at) -> DataFrame:
    """Cache rows (key, answer, sources, expires_at) of streams of events that ended without an Error."""
    rows = streamed.groupBy("query_id").agg(
        F.bool_or(F.col("kind") == "Error").alias("failed"), F.max(F.when(F.col("kind") == "Sources", F.col("sources"))).alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "Token", F.struct("seq", "token")))), lambda s: s["token"]), "").alias("answer"),
    )
    return rows.where("not failed").join(queries, "query_id").select(response_key("text").alias("key"), "answer", "sources", F.lit(expires_at).alias("expires_at"))


def step_back(retrieve: Retriever, queries: DataFrame, broader: DataFrame, k: int) -> DataFrame:
    """Fuses with a broader query (query_id, reply); a blank one, or the query again in any case, changes nothing."""
    joined = queries.join(broader, "query_id", "left")
    useful = (F.trim(F.coalesce("reply", F.lit(""))) != "") & (F.lower(F.trim("reply")) != F.lower(F.trim("text")))
    wide = joined.where(useful).select("query_id", F.col("reply").alias("text"))
    first = retrieve(queries, candidate_count(k))
    both = fusion.rrf(first.join(wide.select("query_id"), "query_id", "left_semi"), retrieve(wide, candidate_count(k)), k)
    return first.join(wide.select("query_id"), "query_id", "left_anti").where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score").unionByName(both)


def corrective(hits: DataFrame, grades: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """Drops hits graded INCORRECT (query_id, chunk_id, grade); queries left without any take the fallback's hits."""
    graded = hits.join(grades, ["query_id", "chunk_id"], "left").where(F.coalesce(F.col("grade"), F.lit("AMBIGUOUS")) != "INCORRECT").drop("grade")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    survivors = graded.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "chunk_id", "score")
    empty = hits.select("query_id").distinct().join(survivors.select("query_id").distinct(), "query_id", "left_anti")
    rest = fallback.join(empty, "query_id", "left_semi").select("query_id", "rank", "chunk_id", "score")
    return survivors.unionByName(rest).where(F.col("rank") <= k)


def relaxation(constraints: list[Column]) -> Column:
    """A row's level: the number of constraints that must be dropped for it to pass. They come in order, the last is dropped first."""
    n = len(constraints)
    need = F.lit(0)
    for i, c in enumerate(constraints):
        need = F.when(~F.coalesce(c, F.lit(False)), F.greatest(need, F.lit(n - i))).otherwise(need)
    return need


def least_level(rows: DataFrame, k: int) -> DataFrame:
    """Ranks scored rows with a level by it and score; each query keeps those of the k first that are of its least level."""
    order = Window.partitionBy("query_id").orderBy("level", F.col("score").desc(), "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    least = F.min("level").over(Window.partitionBy("query_id"))
    return rows.withColumn("least", least).where("level = least").select("query_id", "rank", "chunk_id", "score", "level")


def relaxed(candidates: DataFrame, constraints: list[Column], security: Column, k: int) -> DataFrame:
    """Self-query with relaxation in one pass. ``candidates`` are scored rows (query_id, chunk_id, score, ...);
    constraints are dropped from the last, security never. Each query keeps the rows of its least level and ranks them. All rows
    take part: the k first by level and score hold the k best of the least level, so no more than k a query and partition are
    moved."""
    return least_level(candidates.where(security).withColumn("level", relaxation(constraints)), k)


# fixed values: references that select structural lookup, words, and how many other words make a topic
REFERENCE = r"§\s*\d+(?:\.\d+)*[a-z]?|Article\s+\d+|RFC\s+\d+"
TOPIC_WORD = r"[\p{L}\d]+"
TOPIC_WORDS = 4


def structural_route(text) -> Column:
    """vector without a reference, both with more than TOPIC_WORDS other words, else structural."""
    has = F.regexp_like(text, F.lit(REFERENCE))
    rest = F.regexp_count(F.regexp_replace(text, REFERENCE, " "), F.lit(TOPIC_WORD))
    return F.when(~has, "vector").when(rest > TOPIC_WORDS, "both").otherwise("structural")


def cache_key(text, k: int, prefix: str = "retr") -> Column:
    return F.concat(F.lit(f"{prefix}:{k}:"), F.lower(F.trim(text)))


def cached(queries: DataFrame, cache: DataFrame, k: int, now) -> tuple[DataFrame, DataFrame]:
    """(answered, missing): queries whose key is in the cache (key, ..., expires_at) and alive at ``now``."""
    keyed = queries.withColumn("key", cache_key("text", k))
    live = cache.where(F.col("expires_at") > F.lit(now))
    return keyed.join(live, "key"), keyed.join(live.select("key"), "key", "left_anti")


def invalidated(cache: DataFrame, cited: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining, removed) cache rows (key, ...). cited: (key, chunk_id); changed: (document_id). A chunk belongs to
    the document named before its first #."""
    hit = cited.withColumn("document_id", F.substring_index("chunk_id", "#", 1)).join(changed.select("document_id").distinct(), "document_id", "left_semi").select("key").distinct()
    return cache.join(hit, "key", "left_anti"), cache.join(hit, "key", "left_semi")
