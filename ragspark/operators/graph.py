"""Entity graphs: building, traversal, communities, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragspark.operators.numbering import numbered
from ragspark.sources.shared import cut

EXTRACTION = "entities array<struct<id string, type string, name string, properties map<string,string>>>, relations array<struct<`from` string, `to` string, type string, properties map<string,string>>>"


def extracted(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of model replies (chunk_id, reply): the JSON between the first { and the last }.
    Types default to Unknown and RELATED_TO, entities without a name and relations without an end are skipped."""
    parsed = replies.select("chunk_id", F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), EXTRACTION).alias("r"))
    e = parsed.select("chunk_id", F.posexplode("r.entities").alias("pos", "e")).select("chunk_id", "pos", "e.*").where(F.trim(F.coalesce("name", F.lit(""))) != "")
    entities = e.select("chunk_id", "pos", F.coalesce("id", "name").alias("id"), F.coalesce("type", F.lit("Unknown")).alias("type"), "name", "properties")
    r = parsed.select("chunk_id", F.explode("r.relations").alias("r")).select("chunk_id", "r.*").where("`from` is not null and `to` is not null")
    relations = r.select("chunk_id", F.col("from").alias("from_id"), F.col("to").alias("to_id"), F.coalesce("type", F.lit("RELATED_TO")).alias("type"), "properties")
    return entities, relations


def built(entities: DataFrame, relations: DataFrame, remap: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges). Of entities with one name, in any case, the first (chunk_id, pos) is kept. Edges need both
    ends among the vertices; with ``remap`` the ends of dropped entities move to the one that was kept."""
    first = entities.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("id", "type", "name", "properties"), F.struct("chunk_id", "pos")).alias("v"))
    vertices = first.select("v.*").withColumn("id", F.lower("id")).dropDuplicates(["id"])
    edges = relations.select(F.lower("from_id").alias("from_id"), F.lower("to_id").alias("to_id"), "type")
    if remap:
        names = entities.select(F.lower("id").alias("old"), F.lower("name").alias("key")).distinct().join(first.select("key", F.lower("v.id").alias("new")), "key").select("old", "new").distinct()
        for end in ("from_id", "to_id"):
            edges = edges.join(names.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    ids = vertices.select("id")
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return vertices, edges.select("from_id", "to_id", "type").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(edges.select("to_id", "from_id")).where("a <> b").distinct()


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(query_id, id, depth) of what each query's seeds (query_id, id) reach in 1 to ``hops`` undirected steps; a node
    has its least depth, seeds themselves are left out unless reached."""
    both = undirected(edges)
    front = seeds.select("query_id", "id").distinct()
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        front = front.join(both, F.col("id") == F.col("a")).select("query_id", F.col("b").alias("id")).distinct().join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def graph_hits(reached: DataFrame, vertices: DataFrame) -> DataFrame:
    """Ranks reached entities by depth and id, scored 1 / (place from 1), with a text of type, name and properties."""

    props = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    shown = F.when(F.coalesce(F.size("properties"), F.lit(0)) > 0, F.concat(F.lit(" ("), props, F.lit(")"))).otherwise("")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "id"))
    return reached.join(vertices, "id").withColumn("rank", rank).select("query_id", "rank", "id", F.concat("type", F.lit(": "), "name", shown).alias("text"), (1 / F.col("rank")).alias("score"))


def seeds_in(queries: DataFrame, vertices: DataFrame) -> DataFrame:
    """Entities all of whose name's words stand in the query: word index instead of a scan of all pairs."""
    from ragspark.functions import text as T

    names = vertices.select("id", F.array_distinct(T.word_tokens("name")).alias("w")).where(F.size("w") > 0).select("id", F.size("w").alias("n"), F.explode("w").alias("term"))
    asked = queries.select("query_id", F.explode(F.array_distinct(T.word_tokens("text"))).alias("term"))
    return asked.join(names, "term").groupBy("query_id", "id", "n").agg(F.count("*").alias("c")).where("c = n").select("query_id", "id")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each vertex reaches, by min-label steps that also jump to the label's own
    label. Each round is a written table; they end when no label changes, which a label's descent makes sure of."""
    both = cut(undirected(edges))
    state = cut(vertices.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(state, F.col("a") == F.col("id")).groupBy("b").agg(F.min("component").alias("m"))
        step = state.join(near, F.col("id") == F.col("b"), "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("low"))
        jump = step.join(state.select(F.col("id").alias("l"), F.col("component").alias("further")), F.col("low") == F.col("l"), "left")
        new = cut(jump.select("id", F.least("low", F.coalesce("further", "low")).alias("component"), F.col("component").alias("old")))
        state = new.select("id", "component")
        if not new.where("component <> old").take(1):
            return state


def memberships(vertices: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(community, id), a row a vertex: components numbered by their smallest id. A component without a known entity is left out
    and still uses up its number."""
    found = components(vertices, edges)
    places = numbered(found.select("component").distinct(), [], ["component"]).select("component", F.concat(F.lit("community-"), "pos").alias("community"))
    if known is not None:
        real = found.join(known.select("id"), "id", "left_semi").select("component").distinct()
        places = places.join(real, "component", "left_semi")
    return found.join(places, "component").select("community", "id")


def communities(vertices: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(community, members): :func:`memberships` as sorted lists, for communities whose members fit a row."""
    return memberships(vertices, edges, known).groupBy("community").agg(F.array_sort(F.collect_set("id")).alias("members"))


def summary_chunks(groups: DataFrame, vertices: DataFrame, summaries: DataFrame) -> DataFrame:
    """(chunk_id, text): a community's summary (community, summary) and the list of its members."""
    named = groups.select("community", F.explode("members").alias("id")).join(vertices, "id")
    members = named.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat("type", F.lit(": "), "name").alias("t")))), lambda s: s["t"]), ", ").alias("m"))
    return members.join(summaries, "community").select(F.col("community").alias("chunk_id"), F.concat("summary", F.lit("\n\nMembers: "), "m").alias("text"))


def summary_key(ids: Column) -> Column:
    """SHA-256 over the sorted distinct ids with NUL between them."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "\u0000"), 256)


def evicted(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached summaries (key, ids, ...) without those that hold a changed entity (id)."""
    stale = cache.select("key", F.explode("ids").alias("id")).join(changed, "id", "left_semi").select("key").distinct()
    return cache.join(stale, "key", "left_anti")


def looked_up(asked: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of asked (query_id, ids) in a cache (key, ids, summary, expires_at): hits (query_id, key, summary) are alive after
    ``now``, misses (query_id, key, ids) are to be made; an expired entry is a miss. Questions over the same entities share a key."""
    keyed = asked.select("query_id", "ids", summary_key(F.col("ids")).alias("key"))
    alive = cache.where(F.col("expires_at") > now).select("key", "summary")
    return keyed.join(alive, "key").select("query_id", "key", "summary"), keyed.join(alive.select("key"), "key", "left_anti").select("query_id", "key", "ids")


def refreshed(cache: DataFrame, made: DataFrame, now: Column, ttl: str = "7 days") -> DataFrame:
    """The cache after summaries (ids, summary) were made: a key's new entry lives ``ttl`` from ``now``; expired ones are gone."""
    new = made.select(summary_key(F.col("ids")).alias("key"), F.array_sort(F.array_distinct("ids")).alias("ids"), "summary", (now + F.expr(f"interval {ttl}")).alias("expires_at"))
    new = new.groupBy("key").agg(F.first("ids").alias("ids"), F.min("summary").alias("summary"), F.first("expires_at").alias("expires_at"))
    return cache.where(F.col("expires_at") > now).join(new.select("key"), "key", "left_anti").select("key", "ids", "summary", "expires_at").unionByName(new)
