"""Order-dependent near-duplicate removal over chunks by MinHash estimates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ragspark.functions import text as T
from ragspark.operators.graph import components
from ragspark.sources.shared import cut

PERMUTATIONS, THRESHOLD = 64, 0.85
U32 = (1 << 32) - 1


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(a, b) of each permutation h -> (a h + b) mod 2^32, a odd, both under 2^31; a fixed linear congruence."""
    out, x = [], 42
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        a, x = x | 1, (x * 1103515245 + 12345) % (1 << 31)
        out.append((a, x))
    return out


def signatures(docs: DataFrame, n: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, signature array<long>) over the distinct lower-cased words; 2^32 - 1 everywhere for a blank text.
    Words are cut by Spark's expression, so both engines see the same ones; numpy takes the minima."""
    pairs = np.array(coefficients(n), np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for f in frames:
            rows = []
            for words in f.words:
                if len(known) > 500_000:
                    known.clear()
                h = np.empty(len(words), np.uint64)
                for i, w in enumerate(words):
                    if w not in known:
                        known[w] = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "little")
                    h[i] = known[w]
                low = np.full(n, U32, np.uint64)
                for i in range(0, len(h), 8192):
                    low = np.minimum(low, ((pairs[:, :1] * h[None, i : i + 8192] + pairs[:, 1:]) & np.uint64(U32)).min(axis=1))
                rows.append(low.astype(np.int64).tolist())
            yield pd.DataFrame({"doc_id": f.doc_id, "signature": rows})

    words = docs.select("doc_id", F.array_distinct(T.word_tokens("text")).alias("words"))
    return words.mapInPandas(run, "doc_id long, signature array<long>")


def bands(n: int = PERMUTATIONS, threshold: float = THRESHOLD) -> int:
    """With this many bands, two signatures that agree in threshold * n places agree in a whole band."""
    return n - int(np.ceil(threshold * n)) + 1


def classes(signed: DataFrame) -> DataFrame:
    """(signature, rep, members): equal signatures, named by the smallest doc_id."""
    return signed.groupBy("signature").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))


def similar_pairs(signed: DataFrame, threshold: float = THRESHOLD, n: int = PERMUTATIONS) -> DataFrame:
    """(a, b, similarity): class representatives a < b whose signatures agree in ``threshold`` of their places."""
    reps = classes(signed).select("rep", "signature")
    count = bands(n, threshold)
    edges = [i * n // count for i in range(count + 1)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", a + 1, z - a)) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False))])
    posted = reps.select("rep", F.explode(keys).alias("key"))
    pairs = posted.select("key", F.col("rep").alias("a")).join(posted.select("key", F.col("rep").alias("b")), "key").where("a < b").select("a", "b").distinct()
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = pairs.join(reps.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    return met.select("a", "b", (same / F.lit(n)).alias("similarity")).where(F.col("similarity") >= threshold)


def kept(signed: DataFrame, threshold: float = THRESHOLD, most_rounds: int = 100) -> DataFrame:
    """(doc_id, kept) as if documents came by ascending doc_id and each stayed iff no earlier kept one is similar.

    A representative is settled once no earlier similar one is unsettled. Each round is a table in the
    shared folder; what ``most_rounds`` leave open (long chains) goes through one ordered pass a component."""
    signed = cut(signed)
    pairs = cut(similar_pairs(signed, threshold).select("a", "b"))
    reps = classes(signed)
    state = cut(reps.select(F.col("rep").alias("doc_id"), F.lit(None).cast("boolean").alias("kept")))
    for _ in range(most_rounds):
        seen = pairs.join(state.select(F.col("doc_id").alias("a"), F.col("kept").alias("ka")), "a").groupBy("b").agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("beaten"), F.bool_or(F.col("ka").isNull()).alias("open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = cut(state.join(seen.withColumnRenamed("b", "doc_id"), "doc_id", "left").select("doc_id", new.alias("kept")))
        if not state.where("kept is null").take(1):
            break
    else:
        state = finished(state, pairs)
    return signed.select("doc_id").join(state, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def finished(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """``state`` (doc_id, kept) with its nulls settled in order of doc_id, by components of unsettled similar ones."""
    open_ = cut(state.where("kept is null").select("doc_id"))
    met = pairs.join(state.select(F.col("doc_id").alias("a"), F.col("kept").alias("ka")), "a").join(open_.withColumnRenamed("doc_id", "b"), "b")
    links = cut(met.where("ka is null").select(F.col("a").alias("from_id"), F.col("b").alias("to_id")))
    groups = components(open_.withColumnRenamed("doc_id", "id"), links).withColumnRenamed("id", "doc_id")
    earlier = met.groupBy(F.col("b").alias("doc_id")).agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("beaten"), F.collect_list(F.when(F.col("ka").isNull(), F.col("a"))).alias("earlier"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f, stay = f.sort_values("doc_id"), set()
        for i, beaten, before in zip(f.doc_id, f.beaten, f.earlier, strict=True):
            if not beaten and stay.isdisjoint(before):
                stay.add(i)
        return pd.DataFrame({"doc_id": f.doc_id, "kept": f.doc_id.isin(stay)})

    kind = state.schema["doc_id"].dataType.simpleString()
    settled = groups.join(earlier, "doc_id").groupBy("component").applyInPandas(run, f"doc_id {kind}, kept boolean")
    return cut(state.where("kept is not null").unionByName(settled))
