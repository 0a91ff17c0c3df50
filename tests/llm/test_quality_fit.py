"""The classifier's fit against a plain solver of the same problem, and rows that repeat, conflict or are very long."""

from __future__ import annotations

import numpy as np
import pytest

from ragspark.llm import quality


def objective(x, y, w, cost):
    return 0.5 * w @ w + cost * np.maximum(0, 1 - y * (x @ w)).sum()


@pytest.mark.parametrize("seed,noise", [(1, 0.0), (2, 0.2)])
def test_fit_against_a_plain_solver(seed, noise):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(120) < 0.5, 1, -1)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 8) + (0 if (label > 0) ^ (rng.random() < noise) else 25), rng.integers(0, 70, 4)])).astype(np.int32) for label in y]
    model = quality.fit(rows, y, epochs=300)
    p, q = (np.ones(quality.FEATURES) for _ in "pq")
    for f, label in zip(rows, y):
        (p if label > 0 else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = np.zeros((len(y), 71))
    x[:, 70] = 1  # the bias
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt(len(f))
    gram, dual = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(len(y))
    step = 1 / np.linalg.norm(gram, 2)
    for _ in range(60_000):  # projected gradient of the dual
        dual = np.clip(dual + step * (1 - gram @ dual), 0, quality.COST)
    best = objective(x, y, x.T @ (dual * y), quality.COST)
    fitted = np.append(np.divide(model.weights[:70], ratio[:70], out=np.zeros(70), where=ratio[:70] != 0), model.bias)
    assert best <= objective(x, y, fitted, quality.COST) + 1e-9 <= best * 1.001 + 1e-6
    for f, label in zip(rows[:20], y):
        assert model.margin(f) == pytest.approx(x[[i for i, r in enumerate(rows) if r is f][0]] @ fitted, abs=1e-9)


def test_repeated_and_very_long_rows_are_one_row_an_id(spark, monkeypatch):
    good, bad = "plain words of a calm text with some sense in it", "$$$ ### buy %%% now && click *** here"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(2, 1), (None, 1), (4, None)], "doc_id long, quality int")  # 2 is labelled both ways
    once = quality.train(spark, spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = spark.createDataFrame(rows + rows * 3 + [rows[7]] * 500, "doc_id long, text string")
    again = quality.train(spark, many, labels)
    assert np.array_equal(once.weights, again.weights) and once.bias == again.bias
    long = spark.createDataFrame(rows + [(1001, " ".join(f"w{i}" for i in range(300_000)))], "doc_id long, text string")
    labels = labels.unionByName(spark.createDataFrame([(1001, 1)], "doc_id long, quality int"))
    monkeypatch.setattr(quality, "FIT_BYTES", 4_000)
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda features, y: sizes.extend(len(f) * 4 for f in features) or "model")
    quality.train(spark, long, labels)
    assert sum(sizes) < 4_000_000 and len(sizes) < 130


def test_words_at_the_seam_of_their_length():
    for n in (63, 64, 65, 66):
        a, b = quality.features("x" * n), quality.features("x" * n + " tail")
        assert len(a) and len(np.intersect1d(a, b)) >= 2
    assert len(np.intersect1d(quality.features("ab" * 32), quality.features("ab" * 33))) > 0
