"""Long-term memory: facts of completed turns, kept a user, and recalled by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragspark.functions import text as T
from ragspark.operators.embedding import neighbours

# fixed values: document of all memories, most facts a turn, how many more hits than wanted are fetched, the message
DOCUMENT = "user-memory"
MOST_FACTS, WIDER = 3, 8
REMEMBERED = "What you remember about this user from earlier conversations:\n"


def _bare(line: Column) -> Column:
    """A line without blanks around it and without one leading bullet."""
    t = F.trim(line)
    return F.when(t.startswith("- ") | t.startswith("* "), F.trim(F.substr(t, F.lit(3)))).otherwise(t)


def facts(turns: DataFrame) -> DataFrame:
    """(user_id, chunk_id, text) of turns (user_id, answer, reply): up to three lines of the model's reply, or the answer
    itself where the reply has none. Turns without a user or an answer leave nothing; a user's equal facts are one, by
    an FNV-1a id over the text."""
    some = turns.where(F.col("user_id").isNotNull() & (F.trim(F.coalesce("answer", F.lit(""))) != ""))
    lines = F.filter(F.transform(F.split(F.coalesce("reply", F.lit("")), "\n"), _bare), lambda t: t != "")
    kept = F.when(F.size(lines) > 0, F.slice(lines, 1, MOST_FACTS)).otherwise(F.array(F.trim("answer")))
    rows = some.select("user_id", F.explode(kept).alias("text")).distinct()
    return rows.select("user_id", F.concat_ws("#", F.lit(DOCUMENT), "user_id", T.fnv1a(F.col("text"))).alias("chunk_id"), "text")


def recalled(queries: DataFrame, memories: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, memory_id): of the WIDER * k memories (memory_id, user_id, embedding) nearest to each query
    (query_id, user_id, embedding), the user's own first k. Others' memories are never shown; with many users fewer than k
    may be left, as the search does not know users."""
    near = neighbours(queries, memories.withColumnRenamed("memory_id", "chunk_id"), WIDER * k)
    owned = near.join(queries.select("query_id", "user_id"), "query_id").join(memories.select(F.col("memory_id").alias("chunk_id"), "user_id"), ["chunk_id", "user_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return owned.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("chunk_id").alias("memory_id"))


def message(found: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, message): the system message of recalled memories (query_id, rank, memory_id)."""
    rows = found.join(memories.select("memory_id", "text"), "memory_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("f"))
    return rows.select("query_id", F.concat(F.lit(REMEMBERED), F.array_join(F.transform("f", lambda s: F.concat(F.lit("- "), s["text"])), "\n")).alias("message"))
