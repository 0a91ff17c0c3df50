"""The registered queries at the smallest scale: DuckDB's rows where SQL can express them, brute force elsewhere."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import connection, rows

from ragspark.llm import queries

WITH_SQL = sorted(queries.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query(spark, data, name):
    assert rows(queries.queries()[name](spark, data).toPandas()) == rows(connection(data).execute(queries.oracle_sql()[name]).fetchdf())


@pytest.fixture(scope="module")
def texts(data):
    import pyarrow.parquet as pq

    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    return ids, {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_op2_against_the_library(spark, data, encoded):
    out = queries.queries()["op2_bpe_round_trip"](spark, data).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {tuple(r) for r in out} == {(i, len(x), sha(raw(x)), sha(encoded[1][i].encode())) for i, x in encoded[0].items()} and len(out) == len(encoded[0])


def test_op6_against_the_library(spark, data, encoded):
    at, want = 0, set()
    for i in sorted(encoded[0]):
        ids = [*encoded[0][i], 1]
        want.add((i, at, len(ids), zlib.crc32(raw(ids))))
        at += len(ids)
    assert {tuple(r) for r in queries.queries()["op6_token_files"](spark, data).collect()} == want


def test_op7_gives_every_page(spark, data):
    out = queries.queries()["op7_html_main_text"](spark, data).collect()
    assert len(out) == spark.read.parquet(f"{data}/pages.parquet").count() and all(r.text and r.n_chars == len(r.text) for r in out)


def test_op8_reads_back_every_payload(spark, data, texts):
    out = {r.doc_id: r for r in queries.queries()["op8_media_chunks"](spark, data).collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        payload = t.encode() + b"\0" * (-len(t.encode()) % 64 or 64 * (not t))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op9_holds_out_and_separates(spark, data, texts):
    out = {r.doc_id: r for r in queries.queries()["op9_quality_classifier"](spark, data).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert set(out) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in out.items())
    held = [i for i in labels if out[i].held_out]
    assert sum(out[i].predicted == labels[i] for i in held) >= 0.9 * len(held)


def test_op10_against_plain_sums(spark, data):
    import re

    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    total = {}
    for r in docs:
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e12  # the level at which the targets, filled up to twice their source, share 150 % of all words
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * total[s], mid * weight[s]) for s in order) < 1.5 * sum(total.values()) else (lo, mid)
    out = queries.queries()["op10_entropy_mixing"](spark, data).collect()
    source = {r.doc_id: r.source for r in docs}
    taken = dict.fromkeys(order, 0)
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - min(2 * total[s], lo * weight[s])) <= 1e-6 * r.target
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - min(2 * total[s], lo * weight[s])) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    assert len(out) == len(docs)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, a clashing column; and an empty table."""
    import corpus_pipeline

    words = [" ".join(f"w{j * i % 911}" for j in range(1, 60)) for i in range(1, 40)]
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(words)] + [(3, words[3], "en", "s", "clash"), (None, words[4], None, None, None), (None, None, None, None, None), (90, "", "en", "s", "x"), (91, "long " * 200_000, "en", None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    for name, frame in (("odd", d), ("empty", d.where("false"))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == d.columns
            out.write.parquet(f"{folder}/{i}")
            docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
        assert set(docs.columns) >= {"doc_id", "n_tokens"} and (docs.count() == 0) == (name == "empty")


def test_pipeline_against_its_parts(spark, data):
    """Each stage's decision, made again from the operators' own results over the stage's input."""
    import corpus_pipeline
    from ragspark.llm import mixing, near_dedup, quality

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.quality_scores(spark, docs, labels).where("predicted = 1").collect()}
    left = docs.where(docs.doc_id.isin(list(good)))
    kept = {r.doc_id for r in near_dedup.near_duplicates(spark, left, 80).where("kept").collect()}
    left = left.where(left.doc_id.isin(list(kept)))
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(spark, left).where("size > 0").collect()}
    out = corpus_pipeline.run(spark, data)
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {k: v for k, v in copies.items() if v} == got
    labelled = labels.where("quality = 1 and toxic = 0").select("doc_id")
    assert labelled.where(labelled.doc_id.isin(list(good))).count() >= 0.97 * labelled.count()
