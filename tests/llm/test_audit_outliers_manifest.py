"""Filter audit, outlier rules and manifest against plain versions, with rows of every odd kind."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import filter_audit, merkle, outliers, queries

LONG = " ".join(f"word{i % 977} Été{i}" for i in range(30_000))
ODD = [
    (1, None, "s0", "en"), (2, "", "s0", None), (3, " \n\t", None, "en"), (4, "a", "", "de"), (5, "a b c d", "s1", "de"), (5, "a b c d", "s1", "de"),
    (6, "AB b C d #", "s1", "fr"), (7, LONG, "s0", "en"), (8, LONG, "s1", "en"), (None, "no id at all", "s0", "en"), (None, "no id at all", "s0", "en"),
    (None, "a b c d", None, None), (9, "x" * 70_000, "s0", "en"), (5, "other text of that id", "s2", "en"), (-3, "a b c d", "s2", "de"), (10, "line one\nline two\nline one\n\n\nline two", "s1", "en"),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    d = spark.createDataFrame([(i, t, s, g, None if t is None else len(t)) for i, t, s, g in rows], "doc_id long, text string, source string, lang string, n_chars long")
    for c in ("part", "digest", "n", "pos", "tree", "good", "g", "kept", "mean", "_h", "step", "_lang"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def invented(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice("alpha beta gamma Delta EPSILON zeta eta theta$ iota".split()) + str(rng.randrange(rng.choice((3, 400)))) for _ in range(rng.randrange(0, 90))]
        out.append((rng.randrange(n), " ".join(words) if i % 5 else f"copy {i % 3}", rng.choice(("s0", "s1", None)), rng.choice(("en", "de", None))))
    return out


def audited(rows, labels):
    out = {}
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    masks = []
    for i, text, source, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)}
        masks.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        total = {}
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                removed = [m for m in own if f in m[1] and not m[1] & set(order[: step - 1])]
                total[f] = total.get(f, 0) + len(removed)
                out[part, "".join(order), step] = [
                    sum(not m[1] & set(order[:step]) for m in own), len(removed), sum(f in m[1] for m in own) - len(removed), sum(m[1] == {f} for m in own), sum(m[2] for m in removed), sum(m[3] for m in removed), f]
        for k, v in out.items():
            if k[0] == part:
                v[6] = total[v[6]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("rows", [ODD, invented(1, 90)])
def test_audit_against_every_order(spark, rows):
    labels = [(2, 1, 0), (5, 1, 1), (5, None, None), (7, 0, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)] + [(i, i % 2, i % 3 == 0) for i in range(20, 60)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = filter_audit.audit(spark, documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audited(rows, labels) and len(got) == 600 * len({s or "" for _, _, s, _ in rows})


def test_parity_sums_invert_exactly(spark):
    rng = random.Random(4)
    counts = [rng.choice((0, 1, 7, 10**15)) for _ in range(32)]
    sums = filter_audit.parity_sums(spark.createDataFrame([("p", 0, 0, m, n) for m, n in enumerate(counts) if n], "part string, good int, toxic int, mask int, n long"))
    r = sums.head()
    assert r.sums == [sum(n * (-1) ** bin(k & m).count("1") for m, n in enumerate(counts)) for k in range(32)]
    assert filter_audit.cells(sums).head().everyone == counts


def test_shapley_shares_out_all_that_is_removed(spark, data):
    rows = queries.queries()["op11_filter_audit"](spark, data)
    whole = rows.groupBy("part", "filter_order").agg(F.sum("removed").alias("r"), F.sum("shapley").alias("s"))
    assert whole.where("120 * r <> s").count() == 0


def test_empty_tables(spark):
    none = documents(spark, ODD).where("false")
    assert filter_audit.audit(spark, none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert outliers.quality_rules(spark, none).count() == 0
    assert merkle.manifest(spark, none).count() == 0


def plain_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    seen, twice = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            twice.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def test_statistics_against_plain_counts(spark):
    rng = random.Random(9)
    texts = [t for _, t, _, _ in ODD] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)] + ["one two three four five six seven eight " * 2, "long " * 3000]
    texts += ["\n".join(rng.choice(["a b", "a b ", "", " ", "c | d"]) for _ in range(9)) for _ in range(20)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in outliers.statistics(d, "doc_id").collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(texts)}


def vectors(stats):
    n, chars, symbols, lines, again = stats.T
    n1 = np.maximum(n, 1)
    return np.stack([np.log(n1), np.log(np.maximum(chars, 1) / n1), np.log1p(10 * symbols / n1), np.log1p(lines), np.log1p(10 * again / n1)], 1)


def plain_estimate(x, rng):
    """Many random starts, exact halves."""
    floor, h, best = np.diag(np.square(outliers.LEAST_DEVIATION)), (len(x) + outliers.P + 1) // 2, None
    for _ in range(60):
        own = x[rng.choice(len(x), outliers.P + 1, replace=False)]
        for _ in range(12):
            mean, cov = own.mean(0), np.cov(own.T, bias=True) * outliers.consistency(0.5) + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d, kind="stable")[:h]]
        det = np.linalg.slogdet(np.cov(own.T, bias=True) * outliers.consistency(0.5) + floor)[1]
        if best is None or det < best[0]:
            best = (det, d)
    own = x[best[1] <= outliers.quantile(outliers.INLIERS)]
    return own.mean(0), np.cov(own.T, bias=True) * outliers.consistency(outliers.INLIERS) + floor


def test_verdicts_against_a_plain_estimate(spark):
    """Three groups, a quarter to two fifths of each far off; one source is too small for an estimate of its own."""
    rng = random.Random(3)
    rows = []
    for i in range(420):
        bad = rng.random() < (0.25, 0.4, 0.3)[i % 3]
        words = ["".join(rng.choice("abcdefgh") for _ in range(max(1, round(rng.gauss(5, 1.5))))) + ("$$$" if bad else "") for _ in range(round(np.exp(rng.gauss(5, 0.5))) + 20)]
        rows.append((i, " ".join(words), ("s0", "s1", "s2")[i % 3] if i > 20 else f"few{i}", "en"))
    got = {r.doc_id: r for r in outliers.quality_rules(spark, documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for s in ("s0", "s1", "s2"):
        ids = [i for i, _, source, _ in rows if source == s and not got[i].base_failed]
        x = vectors(np.array([plain_statistics(rows[i][1]) for i in ids], float))
        mean, cov = plain_estimate(x, np.random.Generator(np.random.PCG64(1)))
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        cut = outliers.quantile(outliers.VERDICT)
        assert [got[i].kept for i, far in zip(ids, d) if abs(far - cut) > 0.15 * cut] == [bool(far <= cut) for far in d if abs(far - cut) > 0.15 * cut]
        assert {got[i].kept for i in ids if "$" in rows[i][1]} == {False} and all(got[i].kept for i in ids if "$" not in rows[i][1])


def test_rules_of_odd_rows(spark):
    out = outliers.quality_rules(spark, documents(spark, ODD)).collect()
    assert len(out) == len(ODD) and sorted(((r.doc_id or 0), r.n_words) for r in out) == sorted(((i or 0), len(WORD.findall(t or ""))) for i, t, _, _ in ODD)
    assert all(r.kept == (not r.base_failed) for r in out)  # no group is large enough for an estimate


def test_chi_square():
    assert abs(outliers.quantile(0.95, 5) - 11.0705) < 1e-3 and abs(outliers.quantile(0.975, 2) - 7.3778) < 1e-3 and outliers.consistency(1 - 1e-12) == pytest.approx(1, abs=1e-6)


def test_rules_keep_clean_documents(spark, data):
    got = queries.queries()["op12_quality_rules"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count() and bad.where("kept").count() <= 0.2 * bad.count()


def tree(nodes):
    """Root of ``nodes`` and each one's levels of (siblings before, siblings after)."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    way, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(way)):
            run = nodes[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            way[i].append(("".join(run[: at[i] % 8]), "".join(run[at[i] % 8 + 1 :])))
            at[i] //= 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], way


def plain_manifest(rows):
    H = lambda x: hashlib.sha256(x.encode()).hexdigest()
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    made = [(i, g, H(f(i) + f(s) + f(g) + f(None if t is None else len(t)) + f(t)), H(f(i) + f(s) + f(g) + f(None if t is None else len(t)) + f(low(t)))) for i, t, s, g in rows]
    langs = sorted({m[1] for m in made}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted((m for m in made if m[1] == g), key=lambda m: (m[0] is not None, m[0] or 0, m[2])) for g in langs}
    subs = {g: tree([m[2] for m in own[g]]) for g in langs}
    root, upper = tree([subs[g][0] for g in langs])
    out = []
    for g, ways in zip(langs, upper):
        for m, way in zip(own[g], subs[g][1]):
            acc = m[3] if m[0] is not None and zlib.crc32(str(m[0]).encode()) % 3 == 0 else m[2]
            for a, b in way + ways:
                acc = H(a + acc + b)
            out.append((m[0], m[2], subs[g][0], root, H("".join(a + b for a, b in way + ways)), acc, acc == root))
    return out


@pytest.mark.parametrize("rows", [ODD, invented(2, 700), [(3, "Alone", "s", "en")], [(i, f"T{i}", None, f"l{i}") for i in range(70)], [(4, "Same", "s", "en")] * 65])
def test_manifest_against_a_plain_tree(spark, rows):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, merkle.manifest(spark, documents(spark, rows)).collect()), key=key) == sorted(plain_manifest(rows), key=key)
