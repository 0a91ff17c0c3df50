"""Merkle manifest of a dataset: a tree of every language's documents, their roots a tree of their own.

Built bottom-up: eight neighbours become a parent's row, which keeps their digests; every level is a written table. Proofs
go top-down: a level's nodes join their parents by place, and each puts its siblings before the proof that its parent
inherited. A level has an eighth of the rows below it, and no task holds a language: rows are numbered by counts of
the ranges they are sorted into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .workspace import Workspace

# fixed values: children a node, fields of a leaf
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, tampered): tree orders as its language does, null first; tampered is null where nothing is."""
    values = {c: F.col(c) for c in FIELDS}
    tampered = digest(*[field(F.translate("text", UPPER, LOWER) if c == "text" else v) for c, v in values.items()])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), digest(*[field(v) for v in values.values()]).alias("digest"), F.when(chosen, tampered).alias("tampered"))


def placed(ws: Workspace, nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (tree, digest, ...) of a written table with ``pos``, from 0 a tree in ``order``, and ``n``, the tree's nodes.

    Rows are sorted into ranges and written with numbers that rise within each; a range's offset is the count of the tree's
    rows in the ranges before. Rows that are alike in all of ``order`` are told apart by where they were read, so a key
    that many rows share is split over ranges."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_read")]
    ranges = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    laid = nodes.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    laid = ws.put(laid.drop("_read").withColumn("_seq", F.monotonically_increasing_id()), f"{name}-laid")
    part = F.shiftrightunsigned("_seq", 33)
    counts = laid.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_seq").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_c").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ws.put(counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(tree).alias("n")), f"{name}-offsets")
    return laid.withColumn("_part", part).join(offsets, ["tree", "_part"]).withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def built(ws: Workspace, nodes: DataFrame, name: str) -> list[DataFrame]:
    """Levels of (tree, pos, n, digest, kids), the given nodes first. A tree ends at the level where it has one node."""
    levels, most = [nodes], nodes.agg(F.max("n")).head()[0] or 0
    while most > 1:
        below, most = levels[-1], -(-most // ARITY)
        kids = F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"]  # at most ARITY
        up = below.where("n > 1").groupBy("tree", F.floor(F.col("pos") / ARITY).alias("pos")).agg(F.first("n").alias("n"), kids.alias("kids"))
        up = up.select("tree", "pos", F.ceil(F.col("n") / ARITY).alias("n"), digest(F.array_join("kids", "")).alias("digest"), "kids")
        levels.append(ws.put(up, f"{name}-{len(levels)}"))
    return levels


def pushed(ws: Workspace, levels: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The lowest level with what ``tops`` (tree, steps, ...) says of its tree, steps led by those on the way up: (left,
    right), the digests of the siblings before and after."""
    carried = [c for c in tops.columns if c not in ("tree", "steps")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        here = nodes.where("n = 1").join(tops, "tree")
        if above is not None:
            parents = above.select("tree", F.col("pos").alias("_parent"), F.col("kids").alias("_kids"), F.col("steps").alias("_above"), *carried)
            at = (F.col("pos") % ARITY).cast("int")
            side = lambda start, length: F.array_join(F.slice("_kids", start, length), "")
            step = F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(ARITY)).alias("right"))
            below = nodes.where("n > 1").withColumn("_parent", F.floor(F.col("pos") / ARITY)).join(parents, ["tree", "_parent"])
            below = below.withColumn("steps", F.concat(F.array(step), F.col("_above")))
            here = here.unionByName(below.select(*here.columns))
        above = ws.put(here, f"{name}-proof-{k}") if k else here
    return above


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs`` (doc_id, source, lang,
    n_chars, text; others are ignored). Null fields are '-', empty texts '0:'; very long texts are hashed whole. Rows of one
    language and id are ordered by their leaves, null ids come first, whole copies are leaves of their own; null languages
    are a tree, the first. Rows without an id are never tampered with. An empty table gives no rows."""
    ws = Workspace(spark, "merkle")
    low = built(ws, placed(ws, ws.put(leaves(docs), "leaves"), ["doc_id", "digest"], "low"), "low")
    ends = [level.where("n = 1").select("tree", "digest") for level in low]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    subroots = ws.put(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "subroots")
    high = built(ws, placed(ws, subroots, ["of"], "high"), "high")
    root = high[-1].where("n = 1").select("tree", F.col("digest").alias("root"))
    tops = root.withColumn("steps", F.expr("cast(array() as array<struct<left: string, right: string>>)"))
    tops = ws.put(pushed(ws, high, tops, "high").select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "steps"), "tops")
    out = pushed(ws, low, tops, "low")
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("steps", F.coalesce("tampered", "digest"), lambda a, s: digest(s["left"], a, s["right"]))
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
