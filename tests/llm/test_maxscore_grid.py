"""The grid in which queries meet candidates, thresholds that go from shard to shard, and values beyond 64 bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ragspark.llm import maxscore


def brute(rows, k, clip=lambda v: v):
    q = {i: [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(256 * c)))) for c in e] for i, e in rows}
    out = {}
    for i in q:
        if i % 50 == 0:
            s = sorted(((clip(sum(a * b for a, b in zip(q[i], q[j]))), -j) for j in q if j != i), reverse=True)[:k]
            out[i] = [(-j, t) for t, j in s]
    return out


def top(spark, rows, k=5):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in maxscore.top_k(spark, v.where("vec_id % 50 = 0"), v, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_copies_grow_with_the_square_root_of_the_slots():
    assert maxscore.cells(64, 1, 1) == (1, 1)
    across, down = maxscore.cells(16_000, 10_000, 3_200)  # one query for fifty candidates
    assert across * down <= 16_000 and across < 8 * 16_000**0.5 and down < 16_000**0.5
    a4, d4 = maxscore.cells(64_000, 40_000, 12_800)
    assert abs(a4 / across - 2) < 0.05 and abs(d4 / down - 2) < 0.2
    assert maxscore.cells(16, 100, 1) == (16, 1)


def test_many_shards_and_blocks_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 16)
    monkeypatch.setattr(maxscore, "QUERIES", 3)
    monkeypatch.setattr(maxscore, "SLOTS", 64)
    rng = np.random.default_rng(8)
    rows = [(i, np.round(rng.normal(size=6), 1).tolist()) for i in range(1200)]
    assert maxscore.cells(maxscore.SLOTS * spark.sparkContext.defaultParallelism, 75, 8)[1] > 1
    assert top(spark, rows) == brute(rows, 5)


def test_thresholds_go_from_shard_to_shard():
    rng = np.random.default_rng(5)
    x = np.where(rng.random((4000, 40)) < 0.1, rng.integers(1, 40, (4000, 40)), 0).astype(np.float64)
    x[1000:] *= 0.1
    found, looked = maxscore.NOTHING, []
    for a in range(0, 4000, 1000):
        shard = maxscore.MaxScore(np.arange(a, a + 1000), np.floor(x[a : a + 1000]))
        found = shard.improved(-1, x[7], 5, found)
        looked.append(shard.seen["traversed"])
    score = np.floor(x) @ x[7]
    best = np.lexsort((np.arange(4000), -score))[:5]
    assert found.ids.tolist() == best.tolist() and found.scores.tolist() == score[best].tolist()
    alone = maxscore.MaxScore(np.arange(3000, 4000), np.floor(x[3000:]))
    alone.search(-1, x[7], 5)
    assert looked[3] < alone.seen["traversed"]


def test_values_beyond_64_bits(spark):
    rows = [(i, [1e8 * (i % 7 - 3), 1e9, -1e7 * i]) for i in range(0, 200, 2)] + [(1, [1e300, 1.0, 1.0]), (3, [-1e300, 1.0, 1.0]), (5, [1.0, 1.0])]
    end = (1 << 63) - 1
    assert top(spark, rows) == brute(rows, 5, lambda v: max(-end - 1, min(end, v)))
