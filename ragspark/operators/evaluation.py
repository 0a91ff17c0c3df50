"""Retrieval and answer quality, and their significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ragspark.functions.stats import mcnemar, wilson

# fixed values: words without content, separators of words, the prompt whose words count as context, verdict thresholds,
# gate tolerances
STOP_WORDS = ("the", "a", "an", "of", "to", "and", "or", "for", "in", "on", "is", "are", "you", "your", "per", "up", "at", "i", "do")
SEPARATORS = r"[ .,\n\r\[\]'\"]+"
JUDGE_PROMPT = "Grade the claim against the context. Reply EXACTLY one token: SUPPORTED, PARTIALLY_SUPPORTED, or NOT_SUPPORTED.\n\nContext:\n"
SUPPORTED, UNSUPPORTED = 0.6, 0.2
HIT_TOLERANCE, FAITH_TOLERANCE = 0.02, 0.03
ITERATIONS = 2000
GOLD_WORD = r"[^\x00-\x2f]+"


def holders(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, expected array) of passages (query_id, text): the doc_ids of docs (doc_id, text) that hold the passage as it
    stands. A word inside a passage, not its first or last, is a whole word of every text that holds it: texts meet the passages by
    the longest one. Passages without such a word are looked for in every text."""
    words = lambda text: F.regexp_extract_all(text, F.lit(GOLD_WORD), F.lit(0))
    inner = passages.select("query_id", F.col("text").alias("passage"), words("text").alias("w")).withColumn("inner", F.when(F.size("w") > 2, F.slice("w", 2, F.size("w") - 2)))
    longest = F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = inner.select("query_id", "passage", longest.alias("word"))
    # explode_outer: after explode, Spark would cut every text a second time to see whether it is empty
    rows = docs.select("doc_id", F.col("text").alias("t"), F.explode_outer(F.array_distinct(words("text"))).alias("word"))
    met = rows.join(asked.where("word is not null"), "word").where(F.contains("t", F.col("passage"))).select("query_id", "doc_id")
    short = asked.where("word is null").select("query_id", "passage")
    if short.take(1):
        met = met.unionByName(docs.select("doc_id", F.col("text").alias("t")).join(short, F.contains("t", F.col("passage"))).select("query_id", "doc_id"))
    found = met.groupBy("query_id").agg(F.collect_set("doc_id").alias("expected"))
    return passages.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("expected", F.array().cast("array<bigint>")).alias("expected"))


def per_query(hits: DataFrame, gold: DataFrame, k: int, dedup_docs: bool = False) -> DataFrame:
    """(query_id, recall, precision, rr, ndcg) over the k best hits (query_id, rank, doc_id) against gold (query_id,
    expected array). Repeated documents add to precision and gain, so ndcg can exceed 1; ``dedup_docs`` counts them once."""
    top = hits.where(F.col("rank") <= k)
    if dedup_docs:
        top = top.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    sets = gold.select("query_id", F.array_distinct("expected").alias("expected"))
    good = top.join(sets.select("query_id", F.explode("expected").alias("doc_id")), ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.countDistinct("doc_id").alias("found"), F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size("expected"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.size("expected") > 0
    rows = sets.join(good, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("query_id", zero(F.when(some, F.col("found") / F.size("expected"))).alias("recall"), zero(F.col("n") / F.lit(k)).alias("precision"), zero(1 / F.col("first")).alias("rr"), zero(F.when(some, F.col("gain") / ideal)).alias("ndcg"))


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int, dedup_docs: bool = False) -> DataFrame:
    """One row of means over queries; zeros without queries."""
    rows = per_query(hits, gold, k, dedup_docs)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return rows.agg(*map(mean, ("recall", "precision", "rr", "ndcg")), F.lit(k).alias("k"), F.count("*").alias("queries"))


def content_words(column):
    """Distinct lower-cased words of three characters and more that are not stop words."""
    words = F.array_distinct(F.split(F.lower(column), SEPARATORS))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def faithfulness(answers: DataFrame) -> DataFrame:
    """(answer_id, sentences, score) of (answer_id, text, context): each sentence of more than three characters is
    SUPPORTED, PARTIAL or NOT by the share of its content words in the judge's prompt and context; 1, 0.5 and 0 points. A
    sentence without content words is PARTIAL; 1.0 without sentences."""
    parts = F.filter(F.transform(F.split("text", "[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 3)
    rows = answers.select("answer_id", content_words(F.concat(F.lit(JUDGE_PROMPT), "context")).alias("c"), F.explode_outer(parts).alias("s"))
    rows = rows.select("answer_id", "c", "s", content_words("s").alias("w"))
    share = F.when(F.size("w") > 0, F.size(F.array_intersect("w", "c")) / F.size("w")).otherwise(0.5)
    points = F.when(F.col("s").isNull(), None).when(share >= SUPPORTED, 1.0).when(share <= UNSUPPORTED, 0.0).otherwise(0.5)
    return rows.select("answer_id", points.alias("p")).groupBy("answer_id").agg(F.count("p").alias("sentences"), F.round(F.coalesce(F.avg("p"), F.lit(1.0)), 6).alias("score"))


def proportion(rows: DataFrame, flag: str) -> DataFrame:
    """One row: hits, n, low, high of a boolean column."""
    sums = rows.agg(F.count_if(flag).alias("hits"), F.count(flag).alias("n"))
    return sums.select("hits", "n", wilson("hits", "n").alias("w")).select("hits", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def flips(pairs: DataFrame) -> DataFrame:
    """McNemar's test over (before boolean, after boolean): one row b, c, statistic, p, significant."""
    sums = pairs.agg(F.count_if(F.col("before") & ~F.col("after")).alias("b"), F.count_if(~F.col("before") & F.col("after")).alias("c"))
    return sums.select("b", "c", mcnemar(F.col("b"), F.col("c")).alias("m")).select("b", "c", F.round("m.statistic", 6).alias("statistic"), F.round("m.p", 6).alias("p"), (F.col("m.p") < 0.05).alias("significant"))


def bootstrap(samples: DataFrame, iterations: int = ITERATIONS, seed: int = 7) -> DataFrame:
    """95 % percentile interval of the mean of (i, value), i from 0 without gaps; values are the metric of a gold set,
    one a query. Draws come from a digest of (seed, iteration, place), so they do not hang on partitions."""
    n = samples.count()
    if not n:
        return samples.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], "mean double, low double, high double")
    spark = samples.sparkSession
    draws = spark.range(iterations).select(F.col("id").alias("it"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "it", "j")), 1, 8), 16, 10).cast("long")
    means = draws.select("it", (digest % n).alias("i")).join(samples, "i").groupBy("it").agg(F.avg("value").alias("m"))
    ends = means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    return samples.agg(F.avg("value").alias("mean")).crossJoin(ends).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def gate(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """One row: delta of faithfulness with its interval, hit-rate drop, and whether to block. (i, faithfulness, hit) of
    both runs over the same queries. Without a baseline nothing blocks."""
    if baseline is None:
        return current.agg(F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.lit(False).alias("blocked"))
    both = current.join(baseline.select("i", F.col("faithfulness").alias("f0"), F.col("hit").alias("h0")), "i")
    delta = bootstrap(both.select("i", (F.col("faithfulness") - F.col("f0")).alias("value")))
    drops = both.agg(F.round(F.avg(F.col("h0").cast("double") - F.col("hit").cast("double")), 6).alias("hit_drop"), F.round(F.avg(F.col("f0") - F.col("faithfulness")), 6).alias("faith_drop"))
    bad = (F.col("high") < 0) | (F.col("hit_drop") > HIT_TOLERANCE) | (F.col("faith_drop") > FAITH_TOLERANCE)
    return delta.crossJoin(drops).select("mean", "low", "high", "hit_drop", "faith_drop", bad.alias("blocked"))
