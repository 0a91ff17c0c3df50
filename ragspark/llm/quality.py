"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators of a linear support vector machine.

A text's features are the 1- to 3-grams of its word shapes (runs of letters, digits and signs; a mark where a word
repeats the one before or a line repeats an earlier one) and the 1- and 2-grams of its words. Long words are cut into
pieces, so every character of a text without spaces counts. Indicators are multiplied by the class log-count ratio of
their n-gram and divided by the square root of their number; dual coordinate descent fits the hinge loss, and a
logistic curve turns margins into scores. Labels, ids, languages and sources are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import Workspace, sliced

BITS, WORD_BITS = 18, 20
FEATURES = (1 << BITS) + (1 << WORD_BITS)
#: Symbols of a piece of a shape; characters of a word that is one piece, and of a run in longer ones.
PIECE, LONG, RUN = 12, 64, 16
#: Labelled rows that are fitted at most (about; drawn by hash). Bounds the driver's memory, not the rows scored.
FIT_ROWS = 20_000
#: Bytes of their features at most; beyond, fewer rows are drawn.
FIT_BYTES = 256 << 20
EPOCHS, COST = 15, 1.0
_CODES: dict[str, tuple[list[int], list[int]]] = {}
_SHAPES: dict[str, list[int]] = {}
_KEPT = 100_000
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_AGAIN, _LINE_AGAIN, _END = 3, 7, 5


class _Kinds(dict):
    """Character codes to kinds, for str.translate."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        kind = "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c
        self[n] = kind
        return kind


_KINDS = _Kinds()
_RUNS = re.compile(r"(.)\1+", re.S)
#: What a long word is cut into: single letters without case, runs of other kinds.
_CUTS = re.compile(rf"a|(.)\1{{0,{RUN - 1}}}", re.S)


def _code(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass"))


def codes_of(word: str) -> tuple[list[int], list[int]]:
    """Codes of the shape and of the characters of a whole word; long words and shapes give several in order."""
    kinds = word.translate(_KINDS)
    shapes = _SHAPES.get(kinds)
    if shapes is None:
        shape = _RUNS.sub(r"\1\1", kinds)
        shapes = [_code(shape[i : i + PIECE]) for i in range(0, len(shape), PIECE)]
        if len(word) <= LONG:
            if len(_SHAPES) >= _KEPT:
                _SHAPES.clear()
            _SHAPES[kinds] = shapes
    if len(word) <= LONG:
        return shapes, [_code(word)]
    return shapes, [_code(word[m.start() : m.end()]) for m in _CUTS.finditer(kinds)]


def _grams(codes: list[int], most: int, bits: int) -> np.ndarray:
    """Numbers under 2^bits of the 1- to ``most``-grams of ``codes``."""
    a = np.array(codes, np.uint64)
    grams = [a * _GOLD]
    for n in range(1, most):
        last = grams[-1]
        grams.append((last[: len(a) - n] * np.uint64(31) + a[n:] + np.uint64(n)) * _GOLD if len(a) > n else a[:0])
    f = np.concatenate(grams)
    f ^= f >> np.uint64(29)
    return ((f * _MIX) >> np.uint64(64 - bits)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of the whole text: shapes' from 0, words' from 2^BITS."""
    codes: list[int] = []
    words: list[int] = []
    seen: set[int] = set()
    prev = None
    for line in (text or "").split("\n"):
        mark = hash(line)
        if mark in seen:
            codes.append(_LINE_AGAIN)
        seen.add(mark)
        for w in line.split():
            if w == prev:
                codes.append(_AGAIN)
                continue
            got = _CODES.get(w)
            if got is None:
                got = codes_of(w)
                if len(w) <= LONG:
                    if len(_CODES) >= _KEPT:
                        _CODES.clear()
                    _CODES[w] = got
            codes += got[0]
            words += got[1]
            prev = w
        codes.append(_END)
    return np.unique(np.concatenate([_grams(codes, 3, BITS), _grams(words, 2, WORD_BITS) + np.int32(1 << BITS)]))


class Model:
    """weights holds ratio * weight of each feature; score = logistic(slope * margin + shift)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float64), bias, slope, shift

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum()) / max(1.0, float(np.sqrt(len(f)))) + self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -500, 500))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """labels are 1 and -1. Without both classes every score is their share."""
    y = labels.astype(np.float64)
    positive = y > 0
    if not len(y) or positive.all() or not positive.any():
        share = (positive.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    p, q = np.ones(FEATURES), np.ones(FEATURES)
    for f, yes in zip(rows, positive, strict=True):
        (p if yes else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    value = lambda f: ratio[f] / max(1.0, np.sqrt(len(f)))  # noqa: E731  # made anew each time: rows are many and long
    square = np.array([(v := value(f)) @ v + 1 for f in rows])
    weights, bias, dual, rng = np.zeros(FEATURES), 0.0, np.zeros(len(y)), np.random.Generator(np.random.PCG64(3))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            v = value(rows[i])
            slope = y[i] * (weights[rows[i]] @ v + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            if (step := (new - dual[i]) * y[i]) != 0:
                weights[rows[i]] += step * v
                bias, dual[i], moved = bias + step, new, max(moved, abs(step))
        if moved < 1e-4:
            break
    margin = np.array([weights[f] @ value(f) + bias for f in rows])
    goal = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        w = s * (1 - s) + 1e-9
        g = np.array([((s - goal) * margin).sum() + 1e-3 * a, (s - goal).sum()])
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-8:
            break
    return Model(ratio * weights, bias, max(a, 1e-6), b)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, label: str = "quality") -> Model:
    """Fits on about ``most`` labelled rows that are not held out, one an id (of several texts, the one whose features are first as
    bytes), and on FIT_BYTES of features at most. The draw goes by a hash of doc_id, before texts move. Rows without doc_id
    or label, and ids labelled both ways, are not used."""
    ws = Workspace(spark, "quality")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")).where("y = other").select("doc_id", "y").where(~held_out("doc_id"))
    n = known.count()
    part = min(1.0, most / n) if n else 1.0
    drawn = lambda: F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(part * (1 << 30))  # noqa: E731  # reads ``part`` as it is then
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(drawn()).join(known.where(drawn()), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "y", "f"])

    made = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, f binary")
    made = ws.put(made.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("f").alias("f")), "features")
    size = made.agg(F.sum(F.octet_length("f"))).head()[0] or 0
    if size > FIT_BYTES:
        part *= FIT_BYTES / size
        made = made.where(drawn())
    # a partition at a time: the driver holds the rows' features once, in Python
    got = sorted((r["doc_id"], bytes(r["f"]), r["y"]) for r in made.toLocalIterator())
    return fit([np.frombuffer(f, np.int32) for _, f, _ in got], np.array([1 if y == 1 else -1 for _, _, y in got]))


def scored(spark: SparkSession, docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """Columns ``columns`` of ``docs`` and _score, from whole texts; a null text scores as an empty one."""
    shared = spark.sparkContext.broadcast(model)  # FEATURES weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            s = [m.score(features(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*columns, "_score"])

    return docs.select(*columns, F.col("text").alias("_whole_text")).mapInArrow(run, docs.select(*columns).schema.add("_score", "double"))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text, ...).

    Repeated rows give equal rows. Very long texts count whole. With no labelled rows every score is 0.5. Other columns are
    ignored; an empty table gives no rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(spark, ids, train(spark, docs, labels), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more."""
    model = train(spark, docs, labels)
    columns = docs.columns
    shared = spark.sparkContext.broadcast(model)
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            yield b.filter(pa.array([m.score(features(t)) >= 0.5 for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
