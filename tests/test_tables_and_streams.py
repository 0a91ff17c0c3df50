"""Keyed tables, migrations, segmented audit chains, places in an order, streams with state, prompts and audit records."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import generation, operations, security
from ragspark.operators.embedding import bow_vectors
from ragspark.operators.migration import Reindex
from ragspark.operators.numbering import numbered
from ragspark.sources.keyed import Conflict, KeyedTable, reingest
from ragspark.streaming import stateful

SCHEMA = "document_id string, chunk_id string, v long"


def rows_of(frame):
    return sorted(map(tuple, frame.select("document_id", "chunk_id", "v").collect()))


@pytest.fixture
def store(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, buckets=16)
    t.upsert(spark.createDataFrame([(f"d{i}", f"d{i}#{j}", 0) for i in range(40) for j in range(3)], SCHEMA))
    return t


def test_changes_rewrite_touched_buckets_alone(spark, store):
    before = store.manifest()
    store.replace_documents(spark.createDataFrame([("d3",), ("gone",)], "document_id string"), spark.createDataFrame([("d3", "d3#0", 9)], SCHEMA))
    after = store.manifest()
    same = [b for b in before["buckets"] if before["buckets"][b] == after["buckets"].get(b)]
    assert store.stats["touched"] <= 2 and store.stats["read"] <= 2 and len(same) >= len(before["buckets"]) - 2
    got = rows_of(store.read())
    assert [r for r in got if r[0] == "d3"] == [("d3", "d3#0", 9)] and len(got) == 40 * 3 - 2
    assert rows_of(store.read(before["version"])) == sorted((f"d{i}", f"d{i}#{j}", 0) for i in range(40) for j in range(3))


def test_upsert_delete_and_epochs(spark, store):
    one = spark.createDataFrame([("d1", "d1#1", 5), ("new", "new#0", 6)], SCHEMA)
    store.upsert(one, epoch=3, writer="w")
    version = store.version()
    assert store.upsert(one.withColumn("v", F.lit(7).cast("long")), epoch=3, writer="w") == version and store.stats["read"] == 0
    assert ("d1", "d1#1", 5) in rows_of(store.read()) and ("d1", "d1#0", 0) in rows_of(store.read())
    store.delete(spark.createDataFrame([("d1", "d1#1")], "document_id string, chunk_id string"))
    store.delete(spark.createDataFrame([("d2",)], "document_id string"))
    left = rows_of(store.read())
    assert len([r for r in left if r[0] == "d1"]) == 2 and not [r for r in left if r[0] == "d2"]
    store.rollback(version)
    assert ("d1", "d1#1", 5) in rows_of(store.read())
    assert store.vacuum(keep=1) > 0 and ("new", "new#0", 6) in rows_of(store.read())


def test_an_empty_table_and_one_emptied(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/e", SCHEMA)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(None, "x", 1), ("a", "a#0", 2)], SCHEMA))
    assert t.read().count() == 2
    t.delete(spark.createDataFrame([("a",)], "document_id string"))
    assert rows_of(t.read()) == [(None, "x", 1)]
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/none")


def test_of_two_writers_one_fails(spark, store):
    row = spark.createDataFrame([("d5", "d5#0", 1)], SCHEMA)

    def slow(old):
        store_b.upsert(row)  # another writer commits first
        return old

    store_b = KeyedTable(spark, store.root)
    with pytest.raises(Conflict):
        store._change(row, slow, None, "")
    assert ("d5", "d5#0", 1) in rows_of(store.read())


def test_rows_of_other_documents_are_refused(spark, store):
    with pytest.raises(ValueError):
        store._change(spark.createDataFrame([("d5",)], "document_id string"), lambda old: old.unionByName(spark.createDataFrame([(f"x{i}", "c", 1) for i in range(50)], SCHEMA)), None, "")
    assert len(rows_of(store.read())) == 120


def test_a_batch_run_again_changes_nothing(spark, store):
    apply = reingest(store, lambda changed: changed.select("document_id", F.concat("document_id", F.lit("#0")).alias("chunk_id"), F.lit(4).cast("long").alias("v")))
    changed = spark.createDataFrame([("d7",)], "document_id string")
    apply(changed, 0)
    version = store.version()
    apply(changed, 0)
    assert store.version() == version and [r for r in rows_of(store.read()) if r[0] == "d7"] == [("d7", "d7#0", 4)]


def test_migration_goes_on_after_a_crash_and_back(spark, tmp_path):
    dims = {"a": 16, "b": 64}

    def embed(rows, model):
        made = bow_vectors(rows.withColumn("n", F.col("document_id").cast("long")), "n", dims[model])
        return rows.join(made.select(F.col("n").cast("string").alias("document_id"), "embedding"), "document_id")

    texts = [(str(i), f"{i}#0", f"word{i} word{i % 7} common text number{i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "document_id string, chunk_id string, text string")
    asked = spark.createDataFrame([(i, f"word{i} number{i}") for i in range(20)], "query_id long, text string")
    gold = spark.createDataFrame([(i, str(i)) for i in range(20)], "query_id long, document_id string")
    move = Reindex(spark, f"file://{tmp_path}/m", embed, "a", buckets=4)
    move.write(docs.where("document_id <> '59'"))
    move.begin("b")
    assert move.backfill(4, stop_after=2) == 2 and 0 < move.due().count() < 59
    assert move.cut_over(asked, gold)[0] is False and move.state()["serving"] == "a"  # it still misses chunks
    again = Reindex(spark, f"file://{tmp_path}/m", embed)  # another driver goes on
    again.write(docs.where("document_id = '59'"))
    again.backfill()
    done, live, shadow = again.cut_over(asked, gold)
    assert done and shadow >= live and again.state() == {"serving": "b", "previous": "a", "shadow": None}
    assert again.serving().count() == 60 and again.serving().where("embedding_model = 'b' and size(embedding) = 64").count() == 60
    again.write(spark.createDataFrame([("70", "70#0", "late text here")], docs.schema))
    again.roll_back()
    assert again.state()["serving"] == "a" and again.serving().count() == 61 and again.serving().where("size(embedding) = 16").count() == 61


def test_places_in_an_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), "same") for _ in range(500)]
    got = numbered(spark.createDataFrame(rows, "g string, k int, s string").repartition(5), ["g"], ["k", "s"]).collect()
    for g in ("a", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        keys = [(r.k is not None, r.k or 0) for r in own]
        assert keys == sorted(keys)


def test_segments_show_what_was_cut_or_changed(spark):
    records = spark.createDataFrame([(c, i, f"r{i}") for c in "ab" for i in range(25)], "chain string, seq long, record string")
    made = security.segmented(records, 10)
    heads = security.heads(made, b"k")
    tips = security.tips(heads, b"k")
    check = lambda r, h=heads, t=tips, key=b"k": {x.chain: (x.entries, x.broken, x.whole) for x in security.verified_segments(r, h, t, key).collect()}
    assert [(r.segment, r.entries) for r in heads.where("chain = 'a'").orderBy("segment").collect()] == [(0, 10), (1, 10), (2, 5)]
    whole = (25, 0, True)
    assert check(made) == {"a": whole, "b": whole}
    not_a = lambda cond: made.where(f"chain <> 'a' or not ({cond})")
    assert check(not_a("seq = 24")) == {"a": (24, 0, False), "b": whole}
    short = heads.where("chain <> 'a' or segment < 2")
    assert check(not_a("seq >= 20"), short) == {"a": (20, 0, False), "b": whole}
    assert check(not_a("seq >= 20"), short, security.tips(short, b"forged")) == {"a": (20, 0, False), "b": (25, 0, False)}  # a tip of another key
    assert check(not_a("true"), heads.where("chain = 'b'")) == {"a": (0, 0, False), "b": whole}
    assert check(made.withColumn("record", F.when((F.col("chain") == "a") & (F.col("seq") == 4), "x").otherwise(F.col("record")))) == {"a": (25, 1, False), "b": whole}
    swapped = heads.withColumn("segment", F.when(F.col("chain") == "a", 1 - F.col("segment") % 2).otherwise(F.col("segment"))).where("chain = 'b' or entries = 10")
    assert check(made, swapped)["a"][2] is False and check(made, key=b"other")["a"] == (25, 0, False)


def test_streams_with_late_rows_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    at = datetime.datetime(2024, 1, 1)
    rows = [(f"t{rng.randrange(2)}", rng.randrange(3), i, at + datetime.timedelta(minutes=rng.randrange(3000)), rng.choice([0.0, 2.0, 5.0, None])) for i in range(300)]
    schema = "tenant string, user_id long, request_id long, ts timestamp, usd double"
    data = spark.createDataFrame(rows, schema)
    ahead = spark.createDataFrame([("-", -1, -1, at + datetime.timedelta(days=30), 0.0), (None, None, None, None, None)], schema)
    first = F.col("ts") + F.expr("make_dt_interval(0, 0, CAST(request_id % 50 AS INT) * 10)") < F.lit(at + datetime.timedelta(minutes=1500))
    slices = [data.where(first), data.where(~first).unionByName(ahead)]
    rate = lambda r: stateful.rate_limits(r, 3, 3600.0, "12 hours")
    got = stateful.in_slices(data, f"file://{tmp_path}/rate", slices, rate).where("request_id >= 0")
    want = security.rate_limited(data, 3, 3600.0)
    assert sorted((r.request_id, r.allowed) for r in got.collect()) == sorted((r.request_id, r.allowed) for r in want.collect())
    assert got.select("epoch").distinct().count() > 1
    budget = (4, 3600.0, 20.0, 7200.0, 1800.0)
    got = stateful.in_slices(data, f"file://{tmp_path}/budget", slices, lambda r: stateful.budgets(r, *budget, late="12 hours")).where("request_id >= 0")
    want = operations.budget_admission(data.fillna(0.0, ["usd"]), *budget)
    assert sorted((r.request_id, r.outcome) for r in got.collect()) == sorted((r.request_id, r.outcome) for r in want.collect())


def test_prompts_within_the_budget(spark):
    asked = spark.createDataFrame([(1, "What?"), (2, "Nothing found?"), (3, "q" * 17_000)], "query_id long, text string")
    hits = spark.createDataFrame([(1, 1, 10, "First text."), (1, 2, 11, "x" * 20_000), (1, 3, 12, "Small."), (3, 1, 10, "First text.")], "query_id long, rank int, chunk_id long, text string")
    got = {r.query_id: r for r in generation.answered(generation.prompts(asked, hits)).collect()}
    assert got[1].prompt == generation.SHELL_BEFORE + "[Source 1] First text.\n\nQuestion: What?" and [s.chunk_id for s in got[1].sources] == [10]
    assert got[1].answer == "First text [Source 1]."
    for i, q in ((2, "Nothing found?"), (3, "q" * 17_000)):
        assert got[i].prompt == f'Reply exactly: "I don\'t know based on the available sources."\n\n(No retrieved context was available for the question: {q})'
        assert got[i].answer == generation.ABSTENTION and got[i].sources == []
    records = {r.query_id: r for r in generation.audit_records(generation.answered(generation.prompts(asked, hits)), F.lit("u"), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert records[1].retrieved_chunk_ids == [10] and [(c.rank, c.chunk_id, c.claim) for c in records[1].citations] == [(1, 10, "First text [Source 1]")] and records[2].citations == []


def test_stages_count_what_passes(spark):
    stages = generation.Stages()
    rows = stages.watch("read", spark.range(10), n=F.count("*"), top=F.max("id"))
    rows = stages.watch("kept", rows.where("id > 6"), n=F.count("*"))
    assert rows.count() == 3
    assert {(r.stage, r.metric): r.value for r in stages.told(spark).collect()} == {("read", "n"): 10.0, ("read", "top"): 9.0, ("kept", "n"): 3.0}


def test_token_estimates(spark):
    assert [r[0] for r in spark.createDataFrame([("",), ("abcd",), ("abcde",)], "t string").select(T.tokens_estimated(F.col("t"))).collect()] == [0, 1, 2]


def test_stored_index_skips_windows_and_takes_changes(spark, tmp_path):
    from ragspark.operators import inverted, lexical

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randrange(3, 60)))) for i in range(700)] + [(1000, None), (1001, ""), (-7, "w1 rare w2 rare")]
    rows = [(i, f"{t} rare rare rare" if i in (5, 400) else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "rare w3"), (2, "w0 w0 w59"), (3, "unknown"), (4, "")], "query_id long, text string")
    index = inverted.InvertedIndex(spark, f"file://{tmp_path}/i", shards=2)
    index.write(docs.where("chunk_id % 7 <> 2").unionByName(spark.createDataFrame([(9, "rare rare rare rare"), (5000, "rare w3")], docs.schema)))
    index.write(docs.where("chunk_id % 7 = 2 or chunk_id = 9"), removed=spark.createDataFrame([(5000,)], "chunk_id long"))
    hits, opened = index.search(asked, 3)
    want = lexical.bm25(asked, docs, 3)
    key = lambda f: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 7)) for r in f.collect())
    assert key(hits) == key(want) and len(key(hits)) == 6
    one = {r.query_id: (r.opened, r.windows) for r in opened.collect()}
    assert one[1][0] < one[1][1] and set(one) == {1, 2}
    assert inverted.InvertedIndex(spark, f"file://{tmp_path}/i", shards=2).search(asked, 3)[0].count() == 6  # opened again
    none = inverted.InvertedIndex(spark, f"file://{tmp_path}/none", shards=2)
    none.write(docs.where("false"))
    assert none.search(asked, 3)[0].count() == 0


def test_table_functions(spark):
    from ragspark.operators import ports

    ports.register(spark, halves=ports.chunker(lambda text, n=2: [(i, min(i + n, len(text)), text[i : i + n]) for i in range(0, len(text), n)]), packed=ports.packer(len, "k", "i"))
    d = spark.createDataFrame([(1, "abcde"), (2, None), (3, "")], "k long, text string")
    got = spark.sql("SELECT k, c.* FROM {d}, LATERAL halves(text, 2) c", d=d).collect()
    assert sorted((r.k, r.chunk_index, r.text, r.start_offset, r.end_offset) for r in got) == [(1, 0, "ab", 0, 2), (1, 1, "cd", 2, 4), (1, 2, "e", 4, 5)]
    rows = spark.createDataFrame([("a", i, "x" * n) for i, n in enumerate((3, 3, 9, 1, 1))] + [("b", 0, "yy")], "k string, i int, text string").repartition(3)
    got = spark.sql("SELECT * FROM packed(TABLE({rows}), 6)", rows=rows).collect()
    assert sorted((r.k, r.piece, len(r.text), r.chunks) for r in got) == [("a", 0, 6, 2), ("a", 1, 9, 1), ("a", 2, 2, 2), ("b", 0, 2, 1)]
    with pytest.raises(Exception, match="not a string"):
        spark.sql("SELECT * FROM halves(5)").collect()


def test_tables_of_a_scope_go_with_it(spark):
    from ragspark.sources.shared import cut, hadoop_path, scope

    with scope(spark):
        inner = cut(spark.range(5))
        path = inner.inputFiles()[0]
        assert inner.count() == 5
    made, system = hadoop_path(spark, path)
    assert not system.exists(made)
    outer = cut(spark.range(3))
    assert outer.count() == 3


def test_sentences_keep_every_character(spark):
    from ragspark.operators import chunking

    d = spark.createDataFrame([(1, "One\u0001two. Three\u0001!  Four?\nFive. Six"), (2, "."), (3, " "), (4, None), (5, "No end"), (6, "A. B. C."), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.text) for r in chunking.sentences(d).collect())
    assert got == [(1, 0, "One\u0001two. Three\u0001!  Four?"), (1, 1, "Five. Six"), (2, 0, "."), (5, 0, "No end"), (6, 0, "A. B. C.")]


def test_tools_answer_within_the_clearance(spark, tmp_path):
    from ragspark.operators import lexical, tools

    rows = [(1, "apple pie recipe", "Public"), (2, "apple tart", "Internal"), (3, "apple secret apple", "Restricted"), (4, None, "Public"), (5, "pear", None)]
    chunks = spark.createDataFrame([(i, t, c, "en", "s") for i, t, c in rows], "chunk_id long, text string, confidentiality string, office string, silo string")
    asked = spark.createDataFrame([(1, "apple"), (2, " "), (3, "pear")], "query_id long, text string")
    docs = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    box = tools.BoundaryTools(lambda q, k: lexical.bm25(q, docs, k), chunks, "Internal")
    assert sorted((r.query_id, r.chunk_id) for r in box.search(asked, 100).collect()) == [(1, 1), (1, 2)]
    assert {r.chunk_id for r in box.search(asked, 0).collect()} == set()  # one hit, and it is out of reach
    assert {r.chunk_id for r in box.search_and_rerank(asked, 2).collect()} <= {1, 2}
    got = {r.chunk_id: (r.found, r.text, r.reason) for r in box.get_chunk(spark.createDataFrame([(1,), (3,), (5,), (99,)], "chunk_id long")).collect()}
    assert got == {1: (True, "apple pie recipe", "ok"), **dict.fromkeys((3, 5, 99), (False, None, "not-found-or-denied"))}
    items = spark.createDataFrame([("text", "hr"), (" ", "hr"), ("more", ""), (None, "hr")], "content string, silo string")
    told = box.ingest(items, f"file://{tmp_path}/q").collect()
    assert [(r.silo, r.status, len(r.tracking_id)) for r in told] == [("hr", "queued", 12)]
    assert spark.read.option("recursiveFileLookup", "true").json(f"file://{tmp_path}/q").count() == 1


def test_a_failing_model_is_called_again_later_and_not_too_often_at_once(spark, tmp_path):
    import os
    import time

    from ragspark.operators import embedding

    def model(texts):
        calls = sorted(os.listdir(tmp_path))
        open(f"{tmp_path}/{time.time_ns()}", "w").close()
        if len(calls) < 2:
            raise OSError("busy")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(8)] + [(9, None)], "i int, text string").repartition(4)
    got = embedding.embedded(rows, model, backoff_s=0.3, in_flight=1)
    assert {r.i: r.embedding[0] for r in got.collect()} == {**{i: float(i) for i in range(8)}, 9: 0.0} and got.rdd.getNumPartitions() == 1
    calls = [int(c) for c in sorted(os.listdir(tmp_path))]
    assert calls[1] - calls[0] >= 0.3e9 and calls[2] - calls[1] >= 0.6e9
    with pytest.raises(Exception, match="busy"):
        embedding.embedded(rows, lambda texts: (_ for _ in ()).throw(OSError("busy")), attempts=2, backoff_s=0.0).collect()
