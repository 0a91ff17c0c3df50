"""Ingest gate, redaction, provenance, citations, audit chains and rate limits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ragspark.functions import text as T
from ragspark.operators.numbering import numbered

QUARANTINE = 0.8
GENESIS = "0" * 64


def scanned(rows: DataFrame) -> DataFrame:
    """Adds findings, flags, score and safe to rows with text. The visible text is a column of its own, made once."""
    rows = rows.withColumn("_clean", T.visible("text"))
    rows = rows.withColumns({"findings": T.findings("text", F.col("_clean")), "flags": T.output_flags("text"), "safe_text": F.substring("_clean", 1, T.MOST_CHARS)}).drop("_clean")
    hard = T.is_hard(F.concat("findings", "flags"))
    return rows.withColumns({"safe": T.is_safe(F.col("findings")), "score": F.when(hard, 1.0).otherwise(0.0)})


def detected(prompts: DataFrame) -> DataFrame:
    """Adds findings and detected to (prompt, documents array<string>): the prompt's and each retrieved document's
    telltales, named by where they stand (prompt:..., document[i]:...)."""
    named = lambda found, where: F.transform(found, lambda f: F.concat(where, f))
    documents = F.transform("documents", lambda d, i: named(T.telltales(d), F.concat(F.lit("document["), i.cast("string"), F.lit("]:"))))
    rows = prompts.withColumn("findings", F.concat(named(T.telltales("prompt"), F.lit("prompt:")), F.coalesce(F.flatten(documents), F.array().cast("array<string>"))))
    bare = F.transform("findings", lambda f: F.regexp_replace(f, r"^(prompt|document\[\d+\]):", ""))
    return rows.withColumn("detected", T.is_hard(bare))


def gated(chunks: DataFrame, key: bytes, least: float = QUARANTINE) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): chunks scoring ``least`` or more are set apart, the others signed (provenance)."""
    rows = chunks.withColumn("score", T.injection_score("text"))
    return signed(rows.where(F.col("score") < least).drop("score"), key), rows.where(F.col("score") >= least)


def signed(chunks: DataFrame, key: bytes) -> DataFrame:
    """Adds ``provenance``: HMAC over chunk_id|document_id|text."""
    return chunks.withColumn("provenance", T.hmac_sha256(F.concat_ws("|", "chunk_id", "document_id", "text"), key))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, place, rank, chunk_id, claim) of each [Source n] whose n is a source's rank. The claim is the text
    between the nearest full stops or line ends around the mark, trimmed."""
    # one sentence may cite several sources
    marks = answers.select("answer_id", F.posexplode(F.split("text", r"[.\n]")).alias("sentence", "claim"))
    rows = marks.select("answer_id", "sentence", F.trim("claim").alias("claim"), F.posexplode(F.regexp_extract_all("claim", F.lit(T.SOURCE_MARK), 1)).alias("i", "n"))
    rows = rows.select("answer_id", "sentence", "i", "claim", F.col("n").try_cast("int").alias("rank")).join(sources.select("answer_id", "rank", "chunk_id"), ["answer_id", "rank"])
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("sentence", "i"))
    return rows.select("answer_id", place.alias("place"), "rank", "chunk_id", "claim")


def audited_citations(cited: DataFrame, chunks: DataFrame, key: bytes) -> DataFrame:
    """(answer_id, chunk_id, verdict): missing, altered or valid, by the chunk's recomputed provenance."""
    known = chunks.select("chunk_id", "provenance", T.hmac_sha256(F.concat_ws("|", "chunk_id", "document_id", "text"), key).alias("again"))
    verdict = F.when(F.col("again").isNull(), "missing").when(F.col("again") == F.col("provenance"), "valid").otherwise("altered")
    return cited.join(known, "chunk_id", "left").select("answer_id", "chunk_id", verdict.alias("verdict"))


def chained(records: DataFrame) -> DataFrame:
    """(chain, seq, record, prev_hash, hash): each hash covers the one before and the record's JSON. Chains are folded
    in order, streaming; a chain's records pass through one task, as its definition asks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, prev = None, GENESIS
        for f in batches:
            out = []
            for chain, seq, record in zip(f.chain, f.seq, f.record, strict=True):
                if chain != now:
                    now, prev = chain, GENESIS
                h = hashlib.sha256((prev + record).encode()).hexdigest()
                out.append((chain, seq, record, prev, h))
                prev = h
            yield pd.DataFrame(out, columns=["chain", "seq", "record", "prev_hash", "hash"])

    rows = records.select("chain", F.col("seq").cast("long").alias("seq"), "record").repartition("chain").sortWithinPartitions("chain", "seq")
    return rows.mapInPandas(run, "chain string, seq long, record string, prev_hash string, hash string")


def verified(chain: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(chain, entries, broken, whole). broken counts entries whose link or hash is wrong; with ``heads`` (chain,
    entries, hash) a chain cut short is found as well."""
    w = Window.partitionBy("chain").orderBy("seq")
    linked = F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))
    right = F.col("hash") == F.sha2(F.concat("prev_hash", "record"), 256)
    out = chain.select("chain", "seq", "hash", (linked & right).alias("good")).groupBy("chain").agg(F.count("*").alias("entries"), F.count_if(~F.col("good")).alias("broken"), F.max_by("hash", "seq").alias("last"))
    if heads is None:
        return out.select("chain", "entries", "broken", (F.col("broken") == 0).alias("whole"))
    told = heads.select("chain", F.col("entries").alias("n"), F.col("hash").alias("h"))
    same = (F.col("broken") == 0) & (F.col("entries") == F.col("n")) & (F.col("last") == F.col("h"))
    return out.join(told, "chain", "full").select("chain", "entries", "broken", F.coalesce(same, F.lit(False)).alias("whole"))


#: Records of a segment of an audit chain.
SEGMENT = 10_000


def segmented(records: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(chain, seq, record, pos, segment, prev_hash, hash) of records (chain, seq, record): a chain is cut into segments of ``size``
    records, each a hash chain that starts from its own name, so segments are hashed apart and no task holds a chain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, prev = None, ""
        for f in batches:
            out = []
            for chain, seq, record, pos, segment in zip(f.chain, f.seq, f.record, f.pos, f.segment, strict=True):
                if (chain, segment) != now:
                    now, prev = (chain, segment), hashlib.sha256(f"{chain}|{segment}".encode()).hexdigest()
                h = hashlib.sha256((prev + record).encode()).hexdigest()
                out.append((chain, seq, record, pos, segment, prev, h))
                prev = h
            yield pd.DataFrame(out, columns=["chain", "seq", "record", "pos", "segment", "prev_hash", "hash"])

    rows = numbered(records.select(F.coalesce("chain", F.lit("")).alias("chain"), F.col("seq").cast("long").alias("seq"), "record"), ["chain"], ["seq", "record"])
    rows = rows.select("chain", "seq", "record", "pos", F.floor(F.col("pos") / size).alias("segment")).repartition("chain", "segment").sortWithinPartitions("chain", "segment", "pos")
    return rows.mapInPandas(run, "chain string, seq long, record string, pos long, segment long, prev_hash string, hash string")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain", "segment").agg(F.count("*").alias("entries"), F.max_by("hash", "pos").alias("hash"))


def _head_of(key: bytes) -> Column:
    """What a head's signature covers: its place, its records and the hash that the segment before ends with."""
    return T.hmac_sha256(F.concat_ws("|", "chain", F.col("segment").cast("string"), F.col("entries").cast("string"), "hash", "before"), key)


def _linked(heads: DataFrame) -> DataFrame:
    """Adds ``before``, the hash of the segment before; an equi-join, so a chain's heads are not one task's."""
    last = heads.select("chain", (F.col("segment") + 1).alias("segment"), F.col("hash").alias("before"))
    return heads.join(last, ["chain", "segment"], "left").withColumn("before", F.coalesce("before", F.lit(GENESIS)))


def heads(rows: DataFrame, key: bytes) -> DataFrame:
    """(chain, segment, entries, hash, before, signature): a row a segment of :func:`segmented`."""
    return _linked(_summed(rows)).withColumn("signature", _head_of(key))


def _tip_of(key: bytes) -> Column:
    return T.hmac_sha256(F.concat_ws("|", "chain", F.col("segments").cast("string"), F.col("entries").cast("string"), "last"), key)


def tips(heads: DataFrame, key: bytes) -> DataFrame:
    """(chain, segments, entries, last, signature): how long each chain is, signed and kept with it."""
    rows = heads.groupBy("chain").agg(F.count("*").alias("segments"), F.sum("entries").alias("entries"), F.max_by("signature", "segment").alias("last"))
    return rows.withColumn("signature", _tip_of(key))


def verified_segments(rows: DataFrame, heads: DataFrame, tips: DataFrame, key: bytes) -> DataFrame:
    """(chain, entries, broken, whole) of the records of :func:`segmented` with their heads and tips. broken counts records whose
    link or hash is wrong. A chain is whole if none is and every segment is as long and ends as its signed head says, links to
    the one before, and the heads are as many as the signed tip says: an end cut off shows, with or without its heads."""
    w = Window.partitionBy("chain", "segment").orderBy("pos")
    begin = F.sha2(F.concat_ws("|", "chain", F.col("segment").cast("string")), 256)
    good = (F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), begin)) & (F.col("hash") == F.sha2(F.concat("prev_hash", "record"), 256))
    found = rows.select("chain", "segment", "pos", "hash", good.alias("good")).groupBy("chain", "segment").agg(F.count("*").alias("n"), F.count_if(~F.col("good")).alias("broken"), F.max_by("hash", "pos").alias("ends"))
    signed = heads.drop("before").transform(_linked).withColumn("right", F.col("signature") == _head_of(key))
    met = found.join(signed, ["chain", "segment"], "full")
    right = F.coalesce(F.col("right") & (F.col("n") == F.col("entries")) & (F.col("ends") == F.col("hash")), F.lit(False))
    each = met.groupBy("chain").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"), F.min(right).alias("right"), F.count("*").alias("count"), F.max("segment").alias("top"), F.max_by("signature", "segment").alias("ends"))
    told = tips.withColumn("sealed", F.col("signature") == _tip_of(key)).select("chain", "segments", F.col("entries").alias("told"), "last", "sealed")
    whole = F.col("right") & F.col("sealed") & (F.col("broken") == 0) & (F.col("count") == F.col("segments")) & (F.col("top") == F.col("segments") - 1) & (F.col("n") == F.col("told")) & (F.col("ends") == F.col("last"))
    out = each.join(told, "chain", "full")
    return out.select("chain", F.coalesce("n", F.lit(0)).alias("entries"), F.coalesce("broken", F.lit(0)).alias("broken"), F.coalesce(whole, F.lit(False)).alias("whole"))


def rate_limited(requests: DataFrame, most: int, window_s: float) -> DataFrame:
    """Adds ``allowed`` to (tenant, user_id, ts, request_id): at most ``most`` allowed requests in any window of
    ``window_s`` seconds; refused ones take no room, so each decision rests on those before it. Users stream through
    tasks in order of time; no more than ``most`` times are held."""
    from collections import deque

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for f in batches:
            out = []
            for who, t in zip(zip(f.tenant, f.user_id, strict=True), f.us, strict=True):
                if who != now:
                    now, held = who, deque()
                while held and held[0] <= t - window_s * 1_000_000:
                    held.popleft()
                out.append(len(held) < most)
                if out[-1]:
                    held.append(t)
            yield f.assign(allowed=out)

    rows = requests.select("tenant", "user_id", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("tenant", "user_id").sortWithinPartitions("tenant", "user_id", "us", "request_id")
    return rows.mapInPandas(run, rows.select("*").schema.add("allowed", "boolean"))
