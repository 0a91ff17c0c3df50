"""Query routing and rewriting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ragspark.functions.vector import cosine
from ragspark.operators.filters import DEPARTMENTS, DOCUMENT_TYPES, OFFICES, SILOS, cleaned, cleaned_year

# fixed values: keywords of each silo
KEYWORDS = {
    "hr-policies": ("policy", "leave", "vacation", "sick", "remote", "parental", "salary", "probation", "onboarding"),
    "technical-docs": ("api", "endpoint", "deploy", "service", "runbook", "adr", "architecture", "rate limit"),
    "financial-reports": ("revenue", "q1", "q2", "q3", "q4", "budget", "forecast", "fiscal", "operating margin"),
    "legal-contracts": ("contract", "nda", "sow", "clause", "terminate", "termination", "agreement", "license"),
    "product-catalog": ("pricing", "tier", "feature", "starter", "team", "business", "enterprise", "specification"),
    "release-notes-tickets": ("release notes", "release", "ticket", "regression", "hotfix", "support ticket"),
}
THRESHOLD, RULES_ENOUGH, PER_HIT = 0.35, 0.5, 0.25
TURNS = 8


def by_rules(queries: DataFrame, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> DataFrame:
    """(query_id, silos, confidence). A silo's keywords count where the lower-cased query contains them; all silos at the
    highest count are chosen. The vocabulary is part of the plan: rows are neither joined nor moved."""
    low = F.lower(F.coalesce("text", F.lit("")))
    counts = [F.struct(F.lit(silo).alias("silo"), sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n")) for silo, words in keywords.items()]
    rows = queries.select("query_id", F.array(*counts).alias("c"))
    rows = rows.withColumn("top", F.array_max(F.transform("c", lambda x: x["n"])))
    silos = F.array_sort(F.transform(F.filter("c", lambda x: (x["n"] > 0) & (x["n"] == F.col("top"))), lambda x: x["silo"]))
    return rows.select("query_id", silos.alias("silos"), F.least(F.lit(1.0), PER_HIT * F.col("top")).cast("double").alias("confidence"))


def by_meaning(queries: DataFrame, exemplars: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """As :func:`by_rules` by the highest cosine with a silo's exemplars (silo, embedding), at least 0: every silo at
    ``least`` or more, else the single best. Exemplars are a handful a silo; Spark copies them to every task only where it
    knows that they are small."""
    near = F.round(F.greatest(F.lit(0.0), cosine("embedding", "e")), 9)
    scores = queries.crossJoin(exemplars.select("silo", F.col("embedding").alias("e"))).select("query_id", "silo", near.alias("s")).groupBy("query_id", "silo").agg(F.max("s").alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "silo"))
    rows = scores.withColumn("place", place).where((F.col("s") >= least) | (F.col("place") == 1))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("silo")).alias("silos"), F.max("s").alias("confidence"))


def by_reply(replies: DataFrame, silos: tuple[str, ...] = SILOS) -> DataFrame:
    """As :func:`by_rules` from a model's JSON reply: unknown silos are dropped, confidence held to 0..1, failures 0."""
    parsed = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "silos array<string>, confidence double, reasoning string")
    rows = replies.select("query_id", parsed.alias("r"))
    known = F.array_intersect(F.coalesce("r.silos", F.array().cast("array<string>")), F.array(*map(F.lit, silos)))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.0))))
    return rows.select("query_id", known.alias("silos"), F.when(F.size(known) > 0, sure).otherwise(0.0).alias("confidence"), F.lit(True).alias("escalated"))


def merged(rules: DataFrame, fallback: DataFrame, enough: float = RULES_ENOUGH) -> DataFrame:
    """The rules' choice where they are sure, else the union with the fallback's and the higher confidence."""
    other = fallback.select("query_id", F.col("silos").alias("s2"), F.col("confidence").alias("c2"))
    sure = F.col("confidence") >= enough
    rows = rules.join(other, "query_id", "left")
    both = F.array_sort(F.array_union("silos", F.coalesce("s2", F.array().cast("array<string>"))))
    return rows.select("query_id", F.when(sure, F.col("silos")).otherwise(both).alias("silos"), F.when(sure, F.col("confidence")).otherwise(F.greatest("confidence", F.coalesce("c2", F.lit(0.0)))).alias("confidence"), (~sure).alias("escalated"))


def metrics(decisions: DataFrame, strategy: str) -> DataFrame:
    """(silo, strategy, decisions, mean_confidence, escalations)."""
    rows = decisions.select(F.explode("silos").alias("silo"), "confidence", F.col("escalated").cast("long").alias("e"))
    return rows.groupBy("silo").agg(F.count("*").alias("decisions"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum("e").alias("escalations")).withColumn("strategy", F.lit(strategy))


def confidences(decisions: DataFrame, strategy: str, bins: int = 10) -> DataFrame:
    """(silo, strategy, bin, low, decisions): a histogram of confidence in equal bins of 0 to 1, the last with its upper end."""
    rows = decisions.select(F.explode("silos").alias("silo"), F.least(F.floor(F.greatest(F.col("confidence").cast("double"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    return rows.groupBy("silo", "bin").agg(F.count("*").alias("decisions")).select("silo", F.lit(strategy).alias("strategy"), "bin", (F.col("bin") / bins).alias("low"), "decisions")


def rewrite_prompts(turns: DataFrame, last: int = TURNS) -> DataFrame:
    """(conv_id, turn, prompt) of user turns: up to ``last`` turns before as ``role: text`` lines, then the question.
    Without history the prompt is the question."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = F.collect_list(F.concat("role", F.lit(": "), "text")).over(w.rowsBetween(-last, -1))
    rows = turns.withColumn("h", lines).where(F.col("role") == "user")
    prompt = F.when(F.size("h") == 0, F.col("text")).otherwise(F.concat(F.array_join("h", "\n"), F.lit("\nQuestion: "), "text"))
    return rows.select("conv_id", "turn", prompt.alias("prompt"))


def rewritten(text: Column, reply: Column) -> Column:
    """A model's rewriting without surrounding quotes; a blank one leaves the question."""
    bare = F.trim(F.regexp_replace(F.trim(reply), "^[\"']+|[\"']+$", ""))
    return F.when(F.coalesce(bare, F.lit("")) == "", text).otherwise(bare)


def should_retrieve(reply: Column) -> Column:
    """A model's decision {"retrieve": ...}; anything else retrieves."""
    return F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "retrieve boolean")["retrieve"], F.lit(True))


def extracted_filter(reply: Column) -> Column:
    """A model's filter as a struct of vocabulary members; what is unknown, or malformed, is null."""
    kind = "freeTextQuery string, department string, office string, silo string, documentType string, fiscalYear int"
    r = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), kind)
    return F.struct(r["freeTextQuery"].alias("free_text"), cleaned(r["department"], DEPARTMENTS).alias("department"), cleaned(r["office"], OFFICES).alias("office"), cleaned(r["silo"], SILOS).alias("silo"), cleaned(r["documentType"], DOCUMENT_TYPES).alias("document_type"), cleaned_year(r["fiscalYear"]).alias("fiscal_year"))
