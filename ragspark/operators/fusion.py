"""Fusing, diversifying, ordering and packing ranked lists: hits are (query_id, rank, chunk_id, score)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60
LAMBDA = 0.5
DIGITS = 9


def _numbered(rows: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select("query_id", "rank", "chunk_id", "score")


def rrf(a: DataFrame, b: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Sum of 1 / (constant + rank) over two lists; ties go to the better place in ``a``, then in ``b``. A chunk that
    repeats inside ``a`` counts at its last place only, inside ``b`` at each of its places."""
    left = a.groupBy("query_id", "chunk_id").agg(F.max("rank").alias("last"), F.min("rank").alias("ra"))
    right = b.groupBy("query_id", "chunk_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("sb"), F.min("rank").alias("rb"))
    both = left.join(right, ["query_id", "chunk_id"], "full")
    score = F.coalesce(1 / (constant + F.col("last")), F.lit(0.0)) + F.coalesce("sb", F.lit(0.0))
    rows = both.select("query_id", "chunk_id", F.round(score, DIGITS).alias("score"), "ra", "rb")
    return _numbered(rows, [F.col("score").desc(), F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last(), F.col("chunk_id")], k)


def _scaled(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.select("query_id", "chunk_id", "rank", ((F.col("score") - low) / F.greatest(high - low, F.lit(1e-9))).alias("s"))


def weighted(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5, k: int | None = None) -> DataFrame:
    """Min-max scaled scores, summed with weights; a constant list scales to 0."""
    left, right = _scaled(a).select("query_id", "chunk_id", F.col("s").alias("sa"), F.col("rank").alias("ra")), _scaled(b).select("query_id", "chunk_id", F.col("s").alias("sb"), F.col("rank").alias("rb"))
    both = left.join(right, ["query_id", "chunk_id"], "full")
    score = F.round(wa * F.coalesce("sa", F.lit(0.0)) + wb * F.coalesce("sb", F.lit(0.0)), DIGITS)
    return _numbered(both.select("query_id", "chunk_id", score.alias("score"), "ra", "rb"), [F.col("score").desc(), F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last(), F.col("chunk_id")], k)


def cascade(a: DataFrame, b: DataFrame, k: int, enough: int = 3) -> DataFrame:
    """The first list where it has ``enough`` hits, else the fusion of both."""
    full = a.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("query_id")
    first = a.join(full, "query_id", "left_semi").where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
    return first.unionByName(rrf(a, b, k).join(full, "query_id", "left_anti").select("query_id", "rank", "chunk_id", "score"))


def fused(a: DataFrame, b: DataFrame, how: str, k: int) -> DataFrame:
    return {"rrf": rrf, "weighted": lambda x, y, n: weighted(x, y, k=n), "cascade": cascade}[how.strip().lower()](a, b, k)


def rag_fusion(lists: list[DataFrame], k: int) -> DataFrame:
    """Left fold of pairwise fusion over a query's variants, each step cut to 2k, the last to k."""
    out = lists[0]
    for nxt in lists[1:]:
        out = rrf(out, nxt, 2 * k)
    return out.where(F.col("rank") <= k)


def mmr(candidates: DataFrame, k: int, weight: float = LAMBDA) -> DataFrame:
    """Greedy maximal marginal relevance over (query_id, chunk_id, relevance, embedding), at most a bounded candidate
    list a query. The penalty starts at 0, so unlike candidates earn nothing; ties go to the earlier candidate by
    descending relevance and chunk_id. Scores stay the relevances."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["relevance", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        m = np.array(f.embedding.tolist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        penalty, left, out = np.zeros(len(f)), np.ones(len(f), bool), []
        for _ in range(min(k, len(f))):
            gain = np.where(left, np.round(weight * f.relevance.to_numpy() - (1 - weight) * penalty, 12), -np.inf)
            best = int(np.argmax(gain))
            out.append(best)
            left[best] = False
            penalty = np.maximum(penalty, m @ m[best])
        got = f.iloc[out]
        return pd.DataFrame({"query_id": got.query_id, "rank": np.arange(1, len(out) + 1), "chunk_id": got.chunk_id, "score": got.relevance})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, rank int, chunk_id long, score double")


def interleaved(hits: DataFrame) -> DataFrame:
    """Even places to the front, odd ones to the back: 1, 3, 5, 4, 2. Adds ``position`` from 0."""
    i, n = F.col("rank") - 1, F.count("*").over(Window.partitionBy("query_id"))
    return hits.withColumn("position", F.when(i % 2 == 0, i / 2).otherwise(n - 1 - (i - 1) / 2).cast("long"))


def packed(hits: DataFrame, tokens: str = "tokens", budget: int = 4000) -> DataFrame:
    """The longest prefix of each query's lines within the budget: later lines that would fit are not taken. Token
    counts are never negative, so the running sum decides."""
    used = F.sum(tokens).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).where(F.col("used") <= budget)


def overlap_scores(pairs: DataFrame) -> DataFrame:
    """Offline cross-encoder: share of the query's distinct words that the chunk has. (query_words, chunk_words)."""
    return pairs.withColumn("score", F.when(F.size("query_words") > 0, F.round(F.size(F.array_intersect("query_words", "chunk_words")) / F.size("query_words"), DIGITS)).otherwise(0.0))


def cross_encoded(pairs: DataFrame, model, batch: int = 16) -> DataFrame:
    """Scores (query, text) by a model that maps lists of pairs to logits, in batches, through a sigmoid."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            rows = list(zip(q, t, strict=True))
            logits = [x for i in range(0, len(rows), batch) for x in model(rows[i : i + batch])]
            yield pd.Series(1 / (1 + np.exp(-np.array(logits, np.float64))))

    return pairs.withColumn("score", run("query", "text"))


def judged_scores(replies: DataFrame) -> DataFrame:
    """The first number of a model's reply, held to 0..1; 0.5 without one."""
    number = F.regexp_extract("reply", r"(-?\d+(?:\.\d+)?)", 1)
    value = F.nullif(number, F.lit("")).try_cast("double")  # least and greatest would skip its null
    return replies.withColumn("score", F.when(value.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))


def reranked(hits: DataFrame, scores: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The best max(20, k) hits by new scores (query_id, chunk_id, score), cut to k, then to the floor."""
    wide = hits.where(F.col("rank") <= max(20, k)).select("query_id", "chunk_id", F.col("rank").alias("old"))
    rows = wide.join(scores, ["query_id", "chunk_id"])
    out = _numbered(rows, [F.col("score").desc(), F.col("old"), F.col("chunk_id")], k)
    return out.where(F.col("score") >= least) if least > 0 else out
