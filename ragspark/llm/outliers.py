"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Five statistics of a text are transformed to a vector. Of every language and source, the minimum-covariance-determinant
estimate gives a centre and a scatter that up to half of its documents cannot move; a document goes if its squared
Mahalanobis distance passes a quantile of chi-square.

Estimates are fitted on a histogram: vectors are rounded to a grid, so that rows of an iteration are cells, not documents.
A concentration step is one job: cells meet their group's estimate, sums of values and products are taken a group and bin
of distance, map-side first, and the bins that hold the nearer half are the next estimate. Two starts (medians with
deviations, and plain moments) run side by side and the smaller determinant stays. A reweighting step over all within the
97.5 % quantile ends the fit. A least deviation a statistic, added to the scatter, keeps it regular where most
documents have the same value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .workspace import Workspace

WORD, SYMBOL, SPAN = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]", 8
#: The vector: logarithms of words, of characters a word, of 1 + symbols in ten words, of 1 + repeated lines, of 1 + ten times
#: the share of repeated words; and the least deviation of each.
LEAST_DEVIATION = (0.25, 0.06, 0.1, 0.4, 0.4)
P = len(LEAST_DEVIATION)
#: Steps of the grid in a unit, bins of distance in a doubling of it, the most concentration steps.
GRID, BINS, MOST_STEPS = 64, 16, 8
#: Change of all logarithms of determinants at which the steps end.
STILL = 1e-3
#: Documents that an estimate needs. Smaller groups of a language are one group, and if still too small, those of all languages.
LEAST_GROUP = 10 * P
INLIERS, VERDICT = 0.975, 0.99999


def _chi(x: float, degrees: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = degrees / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= z / (a + i)
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if x > 0 else 0.0


def quantile(share: float, degrees: int = P) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi(mid, degrees) < share else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of normal vectors is multiplied by to be that of all."""
    return share / _chi(quantile(share), P + 2)


def statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    Hashes of windows show which texts repeat none; in the others the windows themselves are sorted, and neighbours that
    are equal give the windows found twice."""
    rest = lambda a, by: F.slice(a, F.lit(by + 1), F.size(a))
    rows = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(*columns, F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"), lines.alias("_l"))
    rows = rows.select(*columns, "_w", "n_symbols", F.size("_w").alias("_n"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
    known = [*columns, "_w", "n_symbols", "_n", "word_chars", "n_dup_lines"]
    windows = F.greatest(F.col("_n") - (SPAN - 1), F.lit(0))
    rows = rows.select(*known, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    for by in (1, 2, 4):  # hashes of 2, 4 and 8 words
        rows = rows.select(*known, F.zip_with("_h", rest(F.col("_h"), by), lambda a, b: F.xxhash64(a, b)).alias("_h"))
    rows = rows.select(*known, F.slice("_h", F.lit(1), windows).alias("_h"))
    rows = rows.select(*known, (F.size(F.array_distinct("_h")) < windows).alias("_again"))
    rows = rows.select(*known, F.when(F.col("_again"), F.col("_w")).alias("_s"))
    for by in (1, 2, 4):  # the windows themselves
        rows = rows.select(*known, F.zip_with("_s", rest(F.col("_s"), by), lambda a, b: F.concat(a, F.lit(" "), b)).alias("_s"))
    placed = F.zip_with(F.slice("_s", F.lit(1), windows), F.sequence(F.lit(0), F.greatest(windows - 1, F.lit(0))), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.select(*known, F.sort_array(placed).alias("_s"))
    twice = F.zip_with("_s", rest(F.col("_s"), 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    rows = rows.select(*known, F.sort_array(F.array_distinct(F.flatten(twice))).alias("_s"))
    covered = F.aggregate(F.zip_with("_s", rest(F.col("_s"), 1), lambda a, b: F.least(b - a, F.lit(SPAN))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*columns, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: The vector; its words are counted as one at least, so that it is defined for texts without any.
VECTOR = [
    "ln(greatest(n_words, 1))", "ln(greatest(word_chars, 1) / greatest(n_words, 1))", "ln(1 + 10 * n_symbols / greatest(n_words, 1))",
    "ln(1 + n_dup_lines)", "ln(1 + 10 * n_repeat_words / greatest(n_words, 1))",
]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def _below(i: int, j: int) -> int:
    return i * (i + 1) // 2 + j


def _total(terms) -> str:
    return " + ".join(terms) or "0D"


def _solved(rows: DataFrame) -> DataFrame:
    """Adds ``inverse``, that of the Cholesky factor of the scatter in ``cov`` (rows of the lower triangle), and the
    determinant's logarithm. Each expression names earlier ones of the same selection."""
    made = []
    for i, j in LOWER:
        left = f"(cov[{_below(i, j)}] - ({_total(f'l{i}{k} * l{j}{k}' for k in range(j))}))"
        made.append(f"sqrt(greatest({left}, 1e-12D)) AS l{i}{j}" if i == j else f"{left} / l{j}{j} AS l{i}{j}")
    for i, j in LOWER:
        made.append(f"{'1D' if i == j else '-(' + _total(f'l{i}{k} * m{k}{j}' for k in range(j, i)) + ')'} / l{i}{i} AS m{i}{j}")
    made += [f"array({', '.join(f'm{i}{j}' for i, j in LOWER)}) AS inverse", f"2 * ({_total(f'ln(l{i}{i})' for i in range(P))}) AS logdet"]
    return rows.selectExpr("*", *made).select(*rows.columns, "inverse", "logdet")


def distance(x: list[str]) -> str:
    """Squared, of ``x`` from ``mean`` by ``inverse``."""
    sides = [_total(f"inverse[{_below(i, j)}] * ({x[j]} - mean[{j}])" for j in range(i + 1)) for i in range(P)]
    return _total(f"power({side}, 2)" for side in sides)


SUMS = [f"s{i}" for i in range(P)] + [f"p{i}{j}" for i, j in LOWER]


def _moments(rows: DataFrame, x: list[str], keys: list[str]) -> DataFrame:
    """(keys, total, mean, m, s0.., p00..): weight and sums of ``x`` less ``mean``, and of its products."""
    off = [f"({c} - mean[{i}])" for i, c in enumerate(x)]
    terms = [f"n * {off[i]}" for i in range(P)] + [f"n * {off[i]} * {off[j]}" for i, j in LOWER]
    return rows.groupBy(*keys).agg(F.first("total").alias("total"), F.first("mean").alias("mean"), F.sum("n").alias("m"), *[F.expr(f"sum({t}) AS {name}") for t, name in zip(terms, SUMS)])


def _estimate(sums: DataFrame, factor: float, *keys: str) -> DataFrame:
    """(keys, total, mean, cov, inverse, logdet) from sums about the mean before."""
    mean = ", ".join(f"mean[{i}] + s{i} / m" for i in range(P))
    cov = ", ".join(f"{factor!r}D * (p{i}{j} / m - s{i} / m * s{j} / m) + {LEAST_DEVIATION[i] ** 2 if i == j else 0.0!r}D" for i, j in LOWER)
    return _solved(sums.selectExpr(*keys, "total", f"array({mean}) AS mean", f"array({cov}) AS cov"))


def _starts(cells: DataFrame, x: list[str], ws: Workspace) -> DataFrame:
    """(g, start, total, mean, cov, inverse, logdet): from medians and deviations, and from plain moments. A percentile holds a
    count for each step of the grid that occurs."""
    medians = ", ".join(f"percentile({c}, 0.5D, n)" for c in x)
    centre = ws.put(cells.groupBy("g").agg(F.expr(f"array({medians}) AS mean"), F.sum("n").alias("total")), "centre")
    about = cells.join(centre, "g")
    spread = ", ".join(f"percentile(abs({c} - mean[{i}]), 0.5D, n)" for i, c in enumerate(x))
    robust = about.groupBy("g").agg(F.first("total").alias("total"), F.first("mean").alias("mean"), F.expr(f"array({spread}) AS mad"))
    cov = ", ".join(f"power(1.4826D * mad[{i}], 2) + {LEAST_DEVIATION[i] ** 2!r}D" if i == j else "0D" for i, j in LOWER)
    robust = _solved(robust.selectExpr("g", "total", "mean", f"array({cov}) AS cov"))
    plain = _estimate(_moments(about, x, ["g"]), 1.0, "g")
    return ws.put(robust.withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1))), "state-0")


def estimates(cells: DataFrame, ws: Workspace) -> DataFrame:
    """(g, mean, inverse) from the written ``cells`` (g, q0.., n)."""
    x = [f"q{i} / {GRID}D" for i in range(P)]
    state, place = _starts(cells, x, ws), Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for step in range(1, MOST_STEPS + 1):
        met = cells.join(state, "g").withColumn("bin", F.expr(f"floor(log2({distance(x)} + 1e-9D) * {BINS})"))
        bins = _moments(met, x, ["g", "start", "bin"]).withColumn("before", F.sum("m").over(place) - F.col("m"))
        near = bins.where(F.col("before") < F.floor((F.col("total") + P + 1) / 2))
        sums = near.groupBy("g", "start").agg(F.first("total").alias("total"), F.first("mean").alias("mean"), *[F.sum(c).alias(c) for c in ("m", *SUMS)])
        last, state = state, ws.put(_estimate(sums, consistency(0.5), "g", "start").select(*state.columns), f"state-{step}")
        moved = state.join(last.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).head()[0]
        ws.drop(f"state-{step - 1}")
        if moved is None or moved < STILL:
            break
    best = state.groupBy("g").agg(F.min_by(F.struct("total", "mean", "inverse"), F.struct("logdet", "start")).alias("b")).select("g", "b.*")
    inside = cells.join(ws.put(best, "best"), "g").where(f"{distance(x)} <= {quantile(INLIERS)!r}D")
    return ws.put(_estimate(_moments(inside, x, ["g"]), consistency(INLIERS), "g").select("g", "mean", "inverse"), "estimates")


def grouped(rows: DataFrame) -> DataFrame:
    """(lang, source, g) of the written statistics: a language's source, its small sources together, or all small ones. g is
    null where even these are too few for an estimate; their documents are kept."""
    sizes = rows.where("not base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST_GROUP).groupBy("_lang").agg(F.sum("n").alias("of_lang"))
    rest = small.where(F.col("of_lang") < LEAST_GROUP).groupBy(F.lit("").alias("_all")).agg(F.sum("of_lang").alias("of_all"))
    sizes = sizes.join(small, "_lang", "left").withColumn("_all", F.lit("")).join(F.broadcast(rest), "_all", "left")  # one row
    key = F.when(F.col("n") >= LEAST_GROUP, F.to_json(F.array("_lang", "_source"))).when(F.col("of_lang") >= LEAST_GROUP, F.to_json(F.array("_lang")))
    return sizes.select("_lang", "_source", key.when(F.col("of_all") >= LEAST_GROUP, F.lit("[]")).alias("g"))


def quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row of ``docs``
    (doc_id, text, lang, source; others are ignored).

    Null and empty texts have no words and fail the base rules; very long ones are read whole. A null language or source is a
    value of its own. Rows that repeat count each. Documents of groups too small for an estimate are kept if the base rules
    pass. An empty table gives no rows."""
    ws = Workspace(spark, "outliers")
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(f"_{c}")
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), told("lang"), told("source"), "text"), "doc_id", "_lang", "_source")
    rows = ws.put(rows.withColumn("base_failed", base_failed()), "statistics")
    rows = rows.join(ws.put(grouped(rows), "groups"), ["_lang", "_source"], "left")
    grid = [F.expr(f"CAST(round({v} * {GRID}) AS INT) AS q{i}") for i, v in enumerate(VECTOR)]
    cells = ws.put(rows.where("not base_failed and g is not null").groupBy("g", *grid).agg(F.count("*").alias("n")), "cells")
    far = rows.join(estimates(cells, ws), "g", "left").withColumn("_far", F.expr(f"{distance(VECTOR)} > {quantile(VERDICT)!r}D"))
    return far.select("doc_id", *stats, "base_failed", (~F.col("base_failed") & ~F.coalesce("_far", F.lit(False))).alias("kept"))
