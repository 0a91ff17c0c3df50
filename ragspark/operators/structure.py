"""Headings, sections and cross references of Markdown documents, and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ragspark.sources.shared import cut

HEADING = r"^(#{1,6})\s+(.*)$"
# fixed values: formal ids of headings and references, and how they are written as ids
FORMAL = r"§\s*\d+(?:\.\d+)*[a-z]?|Article\s+\d+|RFC\s+\d+"
LEVELS = 6


def _formal(text):
    """§ 17.2a is S17.2a, Article 17 is Art17, RFC 7807 is RFC7807; null without any."""
    found = F.regexp_extract(text, FORMAL, 0)
    short = F.regexp_replace(F.regexp_replace(found, r"\s+", ""), "^Article", "Art")
    return F.when(found != "", F.regexp_replace(short, "^§", "S"))


def slug(text):
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(made == "", "node").otherwise(made)


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, title, text, parent_line): each heading with the lines up to the next one. The parent is
    the nearest earlier heading of a lower level. With a column ``title`` each document has a root of level 0 (line -1)
    above all others, which holds the lines before the first heading."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    rooted = "title" in docs.columns
    level = F.length(F.regexp_extract("t", HEADING, 1))
    order = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.withColumn("level", F.when(level > 0, level)).withColumn("g", F.sum(F.when(level > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = rows.where("level is null" if rooted else "level is null and g > 0").groupBy("doc_id", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("text"))
    heads = rows.where("level is not null").withColumn("title", F.trim(F.regexp_extract("t", HEADING, 2)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the latest earlier line of each level; a deeper level's line counts only after the last lower one
    last = [F.max(F.when(F.col("level") == i, F.col("line"))).over(before) for i in range(1, LEVELS + 1)]
    parent = F.lit(None).cast("int")
    for i in range(2, LEVELS + 1):
        parent = F.when(F.col("level") == i, F.greatest(*last[: i - 1]) if i > 2 else last[0]).otherwise(parent)
    heads = heads.withColumn("parent_line", F.coalesce(parent, F.lit(-1 if rooted else None).cast("int")))
    if rooted:
        heads = heads.select("doc_id", "line", "g", "level", "title", "parent_line").unionByName(docs.select("doc_id", F.lit(-1).alias("line"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("level"), "title", F.lit(None).cast("int").alias("parent_line")))
    return heads.join(body, ["doc_id", "g"], "left").select("doc_id", "line", F.col("level").cast("int").alias("level"), "title", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "parent_line")


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, duplicates). nodes: (doc_id, node_id, parent_id, path, level, title, text, line). The id is the title's
    formal id or the slug of the path; ids that repeat keep their first node, the others are reported."""
    heads = headings(docs)
    path = heads.select("doc_id", "line", "parent_line", F.col("title").alias("path"))
    for _ in range(LEVELS):  # a path has at most LEVELS parts and the root
        up = heads.select("doc_id", F.col("line").alias("parent_line"), F.col("title").alias("above"), F.col("parent_line").alias("next"))
        path = path.join(up, ["doc_id", "parent_line"], "left").select("doc_id", "line", F.col("next").alias("parent_line"), F.when(F.col("above").isNotNull(), F.concat("above", F.lit("/"), "path")).otherwise(F.col("path")).alias("path"))
    named = heads.join(path.select("doc_id", "line", "path"), ["doc_id", "line"]).withColumn("node_id", F.coalesce(_formal(F.col("title")), slug(F.col("path"))))
    ids = named.select("doc_id", F.col("line").alias("parent_line"), F.col("node_id").alias("parent_id"))
    rows = named.join(ids, ["doc_id", "parent_line"], "left")
    first = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("line"))
    # walks join this table again and again: its plan is cut here
    rows = cut(rows.withColumn("_n", first).select("doc_id", "node_id", "parent_id", "path", "level", "title", "text", "line", "_n"))
    return rows.where("_n = 1").drop("_n"), rows.where("_n > 1").select("doc_id", "node_id", "line")


def references(sections: DataFrame) -> DataFrame:
    """(doc_id, node_id, target, pos): formal ids named in a section's text that are sections of the document, not itself,
    and the place where each is named first."""
    words = F.regexp_extract_all("text", F.lit(FORMAL), F.lit(0))
    found = sections.select("doc_id", "node_id", F.posexplode(words).alias("pos", "w")).groupBy("doc_id", "node_id", _formal(F.col("w")).alias("target")).agg(F.min("pos").alias("pos"))
    ids = sections.select("doc_id", F.col("node_id").alias("target"))
    return found.join(ids, ["doc_id", "target"], "left_semi").where("target <> node_id").select("doc_id", "node_id", "target", "pos")


def walked(starts: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(start, node_id, depth) over directed links (doc_id, node_id, target); the start is at depth 0, visited nodes are
    not entered again."""
    links = links.select("doc_id", "node_id", "target")
    front = starts.select("doc_id", F.col("node_id").alias("start"), "node_id")
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = front.join(links, ["doc_id", "node_id"]).select("doc_id", "start", F.col("target").alias("node_id")).distinct().join(seen.select("doc_id", "start", "node_id"), ["doc_id", "start", "node_id"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen


def descendants(starts: DataFrame, sections: DataFrame) -> DataFrame:
    down = sections.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("target"))
    return walked(starts, down, LEVELS)


def ancestors(starts: DataFrame, sections: DataFrame) -> DataFrame:
    up = sections.where("parent_id is not null").select("doc_id", "node_id", F.col("parent_id").alias("target"))
    return walked(starts, up, LEVELS)


def siblings(sections: DataFrame) -> DataFrame:
    """(doc_id, node_id, sibling): other sections under the same parent; a parent's list of children is read once."""
    groups = sections.groupBy("doc_id", "parent_id").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    return groups.select("doc_id", F.explode("ids").alias("node_id"), "ids").select("doc_id", "node_id", F.explode(F.array_remove("ids", F.col("node_id"))).alias("sibling"))


def structural_hits(queries: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections that a query (query_id, text) names by formal id, and those they refer to, scored 1 / (rank from 1)."""
    named = queries.select("query_id", _formal(F.col("text")).alias("node_id")).where("node_id is not null").join(sections.select("doc_id", "node_id"), "node_id")
    # the named section, then what it refers to in the order of its text
    reached = references(sections).select("doc_id", F.col("node_id").alias("start"), F.col("target").alias("node_id"), F.lit(1).alias("depth"), "pos")
    starts = named.select("query_id", "doc_id", F.col("node_id").alias("start"))
    rows = starts.select("query_id", "doc_id", F.col("start").alias("node_id"), F.lit(0).alias("depth"), F.lit(-1).alias("pos"))
    rows = rows.unionByName(starts.join(reached, ["doc_id", "start"]).select(*rows.columns))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "doc_id", "pos", "node_id"))
    return rows.withColumn("rank", rank).select("query_id", "rank", "doc_id", "node_id", "depth", (1 / F.col("rank")).alias("score"))


def structural_retrieve(queries: DataFrame, sections: DataFrame, k: int, fallback: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, text, score): :func:`structural_hits` with path and text. Queries that name no known
    section take the hits of ``fallback`` (same columns), or none."""
    hits = structural_hits(queries, sections).where(F.col("rank") <= k)
    told = hits.join(sections.select("doc_id", "node_id", F.concat(F.lit("/"), "path", F.lit("\n\n"), "text").alias("text")), ["doc_id", "node_id"])
    told = told.select("query_id", "rank", F.col("node_id").alias("chunk_id"), "text", "score")
    if fallback is None:
        return told
    rest = fallback.where(F.col("rank") <= k).join(told.select("query_id").distinct(), "query_id", "left_anti")
    return told.unionByName(rest.select("query_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "text", "score"))


def chosen_sections(replies: DataFrame, sections: DataFrame, k: int) -> DataFrame:
    """Sections picked by a model's reply (query_id, reply) of comma-separated places in (place, node_id)."""
    picks = F.array_distinct(F.filter(F.transform(F.split("reply", ","), lambda t: F.trim(t).try_cast("int")), lambda i: i.isNotNull()))
    rows = replies.select("query_id", F.posexplode(picks).alias("pos", "place")).join(sections.select("place", "node_id"), "place")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "node_id", (1 / F.col("rank")).alias("score"))
