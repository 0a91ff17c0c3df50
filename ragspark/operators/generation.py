"""Grounded answers: prompts from retrieved context within a token budget, a model port, and the record of every answer.

Stages tell what passed them: counts are taken while the rows flow (DataFrame.observe), so watching a run costs no second one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ragspark.functions import text as T
from ragspark.operators import evaluation, security

# fixed values: the prompt around context and question, the prompt without context, the abstention, the tokens of context
SHELL_BEFORE = """You are a helpful assistant for the Contoso Intelligent Systems knowledge base.
Answer the question using ONLY the context below. If the answer is not in the
context, reply exactly: "I don't know based on the available sources."
When you reference a fact, cite the source like [Source N].

Context:
"""
SHELL_BETWEEN = "\nQuestion: "
ABSTENTION = "I don't know based on the available sources."
NO_CONTEXT_BEFORE, NO_CONTEXT_AFTER = 'Reply exactly: "I don\'t know based on the available sources."\n\n(No retrieved context was available for the question: ', ")"
BUDGET = 4000


def shell(question: Column, context: Column) -> Column:
    return F.concat(F.lit(SHELL_BEFORE), context, F.lit(SHELL_BETWEEN), question)


def prompts(asked: DataFrame, hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, question, prompt, grounded, sources array<struct<rank, chunk_id, text>>) of asked (query_id, text) and hits (query_id,
    rank, chunk_id, text): numbered lines of context by rank until one no longer fits; later ones that would are not taken. Without
    hits, or with a question that takes the whole budget, the prompt asks for the abstention."""
    left = (F.lit(budget) - T.tokens_estimated(shell(F.col("text"), F.lit("")))).alias("left")
    rows = asked.select("query_id", F.col("text").alias("question"), left)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    line = F.concat(F.lit("[Source "), F.col("number").cast("string"), F.lit("] "), "text", F.lit("\n"))
    lines = hits.withColumn("number", number).withColumn("line", line)
    used = F.sum(T.tokens_estimated(F.col("line"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fits = lines.withColumn("used", used).join(rows.select("query_id", "left"), "query_id").withColumn("fits", F.col("used") <= F.col("left"))
    one = F.struct(F.col("number").alias("rank"), "chunk_id", F.when(F.col("fits"), F.col("text")).alias("text"), F.when(F.col("fits"), F.col("line")).alias("line"), "fits")
    context = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("all"))  # as many as the retriever's k
    rows = rows.join(context, "query_id", "left")
    taken = F.filter(F.coalesce("all", F.array().cast(context.schema["all"].dataType)), lambda s: s["fits"])
    rows = rows.withColumn("taken", taken).withColumn("grounded", F.col("all").isNotNull() & (F.col("left") > 0))
    nothing = F.concat(F.lit(NO_CONTEXT_BEFORE), "question", F.lit(NO_CONTEXT_AFTER))
    text = F.when(F.col("grounded"), shell(F.col("question"), F.array_join(F.transform("taken", lambda s: s["line"]), ""))).otherwise(nothing)
    sources = F.transform("taken", lambda s: F.struct(s["rank"].alias("rank"), s["chunk_id"].alias("chunk_id"), s["text"].alias("text")))
    return rows.select("query_id", "question", text.alias("prompt"), "grounded", sources.alias("sources"))


def extractive(prompted: DataFrame) -> Column:
    """A stand-in for a model: the first sentence of each of the first two sources, cited; else the abstention."""
    first = lambda s: F.concat(F.rtrim(F.trim(F.element_at(F.split(s["text"], T.SUBCHUNK_GAP, 2), 1)), F.lit(".!?")), F.lit(" [Source "), s["rank"].cast("string"), F.lit("]."))
    return F.when(F.size("sources") > 0, F.array_join(F.transform(F.slice("sources", 1, 2), first), " ")).otherwise(F.lit(ABSTENTION))


def answered(prompted: DataFrame, model: Callable[[DataFrame], Column] = extractive) -> DataFrame:
    """``prompted`` with ``answer``. A model maps the rows to a column: an expression, or a Pandas UDF over ``prompt``."""
    return prompted.withColumn("answer", model(prompted))


def audit_records(answers: DataFrame, user: Column, at: Column) -> DataFrame:
    """(timestamp, query_id, query, retrieved_chunk_ids, response, citations array<struct<rank, chunk_id, claim>>, faithfulness, user_id): a
    row an answer, as it is kept. Citations are those of marks that name a source; faithfulness is the deterministic judge's."""
    rows = answers.withColumns({"answer_id": F.col("query_id"), "_user": user, "_at": at})
    shown = rows.select("answer_id", F.explode("sources").alias("s")).select("answer_id", "s.rank", "s.chunk_id")
    cited = security.citations(rows.select("answer_id", F.col("answer").alias("text")), shown)
    listed = cited.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank", "chunk_id", "claim"))), lambda c: F.struct(c["rank"].alias("rank"), c["chunk_id"].alias("chunk_id"), c["claim"].alias("claim"))).alias("citations"))
    context = F.array_join(F.transform("sources", lambda s: s["text"]), "\n")
    scores = evaluation.faithfulness(rows.select("answer_id", F.col("answer").alias("text"), context.alias("context"))).select("answer_id", F.col("score").alias("faithfulness"))
    met = rows.join(listed, "answer_id", "left").join(scores, "answer_id", "left")
    return met.select(F.col("_at").alias("timestamp"), "query_id", F.col("question").alias("query"), F.transform("sources", lambda s: s["chunk_id"]).alias("retrieved_chunk_ids"), F.col("answer").alias("response"), F.coalesce("citations", F.array().cast(listed.schema["citations"].dataType)).alias("citations"), "faithfulness", F.col("_user").alias("user_id"))


class Stages:
    """Metrics of the stages of one run, known once a job has run over them. A stage's rows may be read by one job only."""

    def __init__(self):
        self.watched: dict[str, Observation] = {}

    def watch(self, name: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        """``rows`` unchanged; ``metrics`` are aggregates over them."""
        self.watched[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return rows.observe(self.watched[name], *[m.alias(k) for k, m in metrics.items()])

    def told(self, spark: SparkSession) -> DataFrame:
        """(stage, metric, value): what was counted. Waits for the job."""
        rows = [(s, m, float(v)) for s, o in self.watched.items() for m, v in o.get.items() if v is not None]
        return spark.createDataFrame(rows, "stage string, metric string, value double")
