"""A training corpus from ``documents``: each stage is one operator of ragspark.llm over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragspark.llm import bpe, mixing, near_dedup, quality
from ragspark.llm.workspace import Workspace

TOKENIZER = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(spark, docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality classifier", good_quality), ("MinHash near-dedup", near_dedup_stage), ("mixing sources", mix_sources), ("BPE encoding and decoding", encode)]

#: The classifier's model and the tilted rates are beyond SQL; tests hold each stage's rows to its operator's own decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), str(i), codec="snappy")
        if i:
            ws.drop(str(i - 1))
    return docs
