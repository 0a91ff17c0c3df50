"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Words are runs of anything but ASCII white space after A-Z are lower-cased; a document's set holds its distinct
five-word shingles (all its words as one shingle when it has fewer). Two permutations make every signature
coordinate: the first scatters shingles over a circle of 2^20 places, the second is one table that is read at a
place shifted by k for coordinate k. Bands of coordinates give candidates; links are confirmed on full sets.

How groups of thousands of copies stay linear in rows:
* equal sets meet in one representative before any candidate is made;
* a shingle that occurs in one candidate only cannot be shared, so with u such shingles a set of n has
  similarity of at most (n - u) / n with anything, and two sets of at most t / (t + u1 + u2),
  t = min(n1 - u1, n2 - u2). This exact bound removes the far members of a group;
* the rest of each bucket is compared with one pivot, not with each other: the member with the most others in its buckets, so
  that a group's buckets share it and a pair of them is made once. Members of buckets that then still have
  several components are measured against one of the bucket: sets that share i1 and i2 shingles with it share
  min(i1, i2) + min(n1 - i1 - u1, n2 - i2 - u2) at most. Members that fail this bound even against the best partner that
  the bucket's extremes allow are done. The others meet new pivots, four times as many each round, which are then done as
  well, until every bucket has one component or no members. No link is lost: a pair that is never compared is in
  one component or fails a bound;
* what a set lacks of the measured one, and what it has beyond it, is kept as bits by hash. A bit that one set has and the
  other has not is a shingle at least that they do not share, so such bits lower the two minima of the bound pair by pair.
  Few members that only resemble each other through the measured one are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import Workspace, sliced

PLACES = 1 << 20
SHINGLE = 5
MAX_COORDINATES = 192
MISS = 1e-6
#: Copies of a pivot's set at most, over which its pairs are dealt.
SALTS = 32
#: Columns of 64 bits for the shingles that a set lacks of the one it is measured against, and as many for those beyond it.
BIT_WORDS = 4
_BITS = [f"{kind}{i}" for kind in ("lost", "gained") for i in range(BIT_WORDS)]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(MAX_COORDINATES)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; empty for null, empty and all-white texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, SHINGLE)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s += mix(w[i : n - k + 1 + i] + _POWERS[i]) * _POWERS[i]
    return np.unique(mix(s))


def bands_and_rows(percent: int) -> tuple[int, int]:
    """The most rows a band for which a pair at the threshold is missed with probability MISS at most."""
    s = percent / 100
    for rows in range(8, 0, -1):
        bands = int(np.ceil(np.log(MISS) / np.log1p(-(s**rows))))
        if bands * rows <= MAX_COORDINATES:
            return bands, rows
    return MAX_COORDINATES, 1


class CirculantMinHash:
    """Signatures from two permutations: sigma is a bijective hash onto the circle, pi one shuffled table."""

    def __init__(self, coordinates: int, seed: int = 11):
        pi = np.random.Generator(np.random.PCG64(seed)).permutation(PLACES).astype(np.uint32)
        self.k, self.seed = coordinates, np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (mix(shingles ^ self.seed) >> np.uint64(44)).astype(np.int64)
        low = np.full(self.k, PLACES, np.uint32)
        for i in range(0, len(places), 4096):
            np.minimum(low, self.windows[places[i : i + 4096]].min(axis=0), out=low)
        return low


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = mix(signature[: bands * rows].astype(np.uint64).reshape(bands, rows) + _POWERS[:rows]) * _POWERS[:rows]
    return mix(parts.sum(axis=1) + np.arange(1, bands + 1, dtype=np.uint64) * _M2).view(np.int64)


def _list(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def signed_rows(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, digest, keys) of each row; digest is null and keys empty for an empty set."""
    bands, rows = bands_and_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = CirculantMinHash(bands * rows)
        for batch in sliced(batches):
            n, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(made.signature(s), bands, rows) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _list(keys, pa.int64())],
                ["doc_id", "n", "digest", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, digest binary, keys array<long>"
    )


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _list([s.view(np.int64) for s in sets], pa.int64())],
                ["doc_id", "n", "shingles"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, shingles array<long>")


def components(ws: Workspace, links: DataFrame, tag: str) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named by its smallest node.

    Alternates two star operations, which keep components and shorten paths, until nothing changes, as they do after a
    number of rounds that grows with the logarithm of the longest path; all rows stay on the executors and each round is a
    written table."""
    edges = ws.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-0")
    state, i = None, 0
    while True:
        i += 1
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = ws.put(small.union(low.select("a", "m")).where("a <> b").distinct(), f"{tag}-{i}")
        ws.drop(f"{tag}-{i - 1}")
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def _may_link(percent: int, n1: str, only1, n2: str, only2):
    """only1, only2: columns that bound from below what each set has beyond the other."""
    t = F.least(F.col(n1) - only1, F.col(n2) - only2)
    return 100 * t >= percent * (t + only1 + only2)


def _bits(shingles: F.Column, name: str) -> list[F.Column]:
    """BIT_WORDS columns with the bits that the shingles' hashes set."""

    def word(i: int) -> F.Column:
        bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(e, 8).bitwiseAND(F.lit(63)).cast("int"))
        mine = lambda e: F.pmod(e, F.lit(BIT_WORDS)) == i
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda got, e: F.when(mine(e), got.bitwiseOR(bit(e))).otherwise(got))

    return [word(i).alias(f"{name}{i}") for i in range(BIT_WORDS)]


def _shared(pairs: DataFrame, sets: DataFrame, *more: F.Column) -> DataFrame:
    """Written pairs (a, b) with na, nb and both: the sizes of the sets and of their intersection, and more columns over the
    sets sa and sb. b may be a pivot that stands in many pairs: its set is copied to as many salts, SALTS at most, as its
    pairs have."""
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt")
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    right = pairs.select("b", salt).distinct().join(right, "b")
    return pairs.select("a", "b", salt).join(left, "a").join(right, ["b", "salt"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"), *more)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written pairs (a, b) whose full sets are similar enough."""
    met = _shared(pairs, sets)
    return met.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct()


def _able(percent: int, one: str, two: str) -> F.Column:
    """Whether sets that were measured against the same one may be similar; the columns of the second end in ``two``."""
    x, y = (lambda c: F.col(f"{c}{one}")), (lambda c: F.col(f"{c}{two}"))
    most = F.least(F.least(x("high"), y("high")) + F.least(x("beyond"), y("beyond")), x("own"), y("own"))
    return 100 * most >= percent * (x("least") + y("least") - most)


def _sharply(percent: int, two: str) -> F.Column:
    """As :func:`_able`, with the bits: what one set lacks of the measured one and the other does not lack is not shared, nor is
    what one has beyond it and the other has not. A doc_id with several sets (``several``) has no bits to go by."""
    x, y = F.col, (lambda c: F.col(f"{c}{two}"))

    def alone(kind: str, one, other) -> F.Column:
        return sum((F.bit_count(one(f"{kind}{i}").bitwiseAND(F.bitwise_not(other(f"{kind}{i}")))) for i in range(1, BIT_WORDS)), F.bit_count(one(f"{kind}0").bitwiseAND(F.bitwise_not(other(f"{kind}0")))))

    within = F.least(x("high") - alone("lost", y, x), y("high") - alone("lost", x, y))
    outside = F.least(x("beyond"), y("beyond"), x("least") - x("high") - alone("gained", x, y), y("least") - y("high") - alone("gained", y, x))
    most = F.least(within + outside, x("own"), y("own"))
    return x("several") | y("several") | (100 * most >= percent * (x("least") + y("least") - most))


def _rest(ws: Workspace, left: DataFrame, links: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components (node, component) after all pairs of ``left`` are decided: (key, doc_id, component, least, own, high,
    beyond, several, bits), members of buckets with several components, measured against one of the bucket."""
    ends, columns = "_2", ["doc_id", "component", "least", "own", "high", "beyond", "several", *_BITS]
    wide, step = 4, 0
    while True:
        extremes = left.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y"), *[(F.min if c == "least" else F.max)(c).alias(f"{c}{ends}") for c in ("least", "own", "high", "beyond")])
        open_ = left.join(extremes, "key").where((F.col("x") != F.col("y")) & _able(percent, "", ends)).drop("x", "y", *[f"{c}{ends}" for c in ("least", "own", "high", "beyond")])
        open_ = ws.put(open_, f"open-{step}")
        ws.drop(f"left-{step}")
        if not open_.take(1):
            ws.drop(f"open-{step}")
            return found
        # the first member by hash, and others by chance: about ``wide`` a bucket
        turn = F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 30))
        drawn = open_.withColumn("turn", turn)
        least = drawn.groupBy("key").agg(F.min("turn").alias("first"))
        pivot = (F.col("turn") == F.col("first")) | (F.col("turn") * F.col("c") < F.lit(wide << 30))
        drawn = drawn.join(least, "key").withColumn("pivot", pivot).drop("turn", "first")
        pivots = drawn.where("pivot").select("key", *[F.col(c).alias(f"{c}{ends}") for c in columns])
        # two pivots meet once
        once = ~F.col("pivot") | (F.col("doc_id") < F.col(f"doc_id{ends}"))
        met = drawn.join(pivots, "key").where(once & (F.col("component") != F.col(f"component{ends}")) & _able(percent, "", ends) & _sharply(percent, ends))
        pairs = ws.put(met.select(F.col("doc_id").alias("a"), F.col(f"doc_id{ends}").alias("b")).distinct(), f"pairs-{step}")
        more = ws.put(_confirmed(pairs, sets, percent), f"more-{step}")
        left = drawn.where("not pivot").drop("pivot", "c")
        if more.take(1):
            links = links.union(more)
            found = ws.put(components(ws, links, f"cc-{step}"), f"found-{step}")
            left = left.drop("component").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        step, wide = step + 1, wide * 4
        left = ws.put(left.select("key", *columns), f"left-{step}")
        ws.drop(f"open-{step - 1}", f"pairs-{step - 1}")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, ...).

    Links sets with 100 * intersection >= percent * union. component_id is the smallest doc_id reachable, kept
    says that it is the row's own. Null and empty texts have no shingles and no links; very long ones count with all their
    shingles. Rows that repeat a doc_id are linked each by its own text, and sets under one doc_id count as one node. A row
    without doc_id takes no part: its component_id is null and it is kept. Ties go to the smallest doc_id; other columns are
    ignored; an empty table gives no rows."""
    ws = Workspace(spark, "near-dedup")
    rows = ws.put(signed_rows(docs, percent), "rows")
    named = rows.where("n > 0 and doc_id is not null")
    equal = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    equal = ws.put(equal, "equal")
    reps = named.join(equal.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    posted = ws.put(reps.select("doc_id", F.explode("keys").alias("key")).distinct(), "posted")
    shared = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    posted = ws.put(posted.join(shared, "key"), "candidates")
    # members of a doc_id's buckets: the middle of a group of near copies has the most
    weights = posted.groupBy("doc_id").agg(F.sum("c").alias("w"))
    # candidates grow with the data: their texts are always met by a shuffle, without a sort, not by a broadcast at some sizes
    ids = posted.select("doc_id").distinct().hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = ws.put(_sets(texts), "sets", codec="none")
    ws.drop("posted")

    alone = (
        sets.select("doc_id", F.explode("shingles").alias("s"))
        .groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).where("doc_id = other")
        .groupBy("doc_id").agg(F.count("*").alias("u"))
    )
    mark = F.xxhash64("shingles")
    sizes = sets.groupBy("doc_id").agg(F.min("n").alias("n"), F.max("n").alias("top"), (F.min(mark) == F.max(mark)).alias("one"))
    # a doc_id with rows of several sets is not bounded by u
    near = sizes.join(weights, "doc_id").join(alone, "doc_id", "left").select("doc_id", "w", F.col("n").alias("least"), F.col("top").alias("n"), F.when(F.col("one"), F.coalesce("u", F.lit(0))).otherwise(0).alias("u"))
    near = ws.put(near.where(f"100 * (n - u) >= {percent} * n"), "near")
    posted = ws.put(posted.drop("c").join(near, "doc_id"), "near-posted")
    ws.drop("candidates")

    me = F.struct((-F.col("w")).alias("far"), "doc_id", "n", "u")
    pivots = posted.groupBy("key").agg(F.count("*").alias("c"), F.min(me).alias("p")).where("c > 1")
    pairs = posted.join(pivots.select("key", F.col("p.doc_id").alias("b"), F.col("p.n").alias("pn"), F.col("p.u").alias("pu")).distinct(), "key")
    pairs = pairs.where((F.col("doc_id") != F.col("b")) & _may_link(percent, "n", F.col("u"), "pn", F.col("pu")))
    pairs = ws.put(pairs.select(F.col("doc_id").alias("a"), "b").distinct(), "pairs")
    links = ws.put(_confirmed(pairs, sets, percent), "links")
    found = ws.put(components(ws, links, "cc"), "found")
    ws.drop("pairs")

    placed = posted.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    left = placed.join(mixed, "key").select("key", "doc_id", "n", "least", "u", "w", "component")
    left = ws.put(left.join(left.groupBy("key").agg(F.min(me).alias("p")).select("key", F.col("p.doc_id").alias("pivot")), "key"), "mixed")
    ws.drop("near-posted", "near")
    pairs = ws.put(left.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct(), "measures")
    bits = [*_bits(F.array_except("sb", "sa"), "lost"), *_bits(F.array_except("sa", "sb"), "gained")]
    met = _shared(pairs, sets, *bits).groupBy(F.col("a").alias("doc_id"), F.col("b").alias("pivot"))
    met = met.agg(F.min("both").alias("low"), F.max("both").alias("high"), (F.count("*") > 1).alias("several"), *[F.max(c).alias(c) for c in _BITS])
    left = left.join(met, ["doc_id", "pivot"])
    # at most: shared with the pivot, and what each has beyond it and beyond its own shingles
    left = left.withColumns({"beyond": F.greatest(F.col("n") - F.col("low") - F.col("u"), F.lit(0)), "own": F.col("n") - F.col("u")})
    left = ws.put(left.select("key", "doc_id", "component", "least", "own", "high", "beyond", "several", *_BITS), "left-0")
    found = _rest(ws, left, links, found, sets, percent)
    ws.drop("sets", "mixed", "measures")

    named_reps = equal.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named_reps = named_reps.where("copies > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("component"))
    # rows of one doc_id with several sets share the smallest component
    out = rows.drop("keys").join(named_reps, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that another document of their group stands for. Rows that repeat the
    doc_id of a document that stays all stay, as do rows without doc_id."""
    gone = near_duplicates(spark, docs, percent).where("not kept").select("doc_id").distinct()
    gone = Workspace(spark, "near-dedup-gone").put(gone, "gone")
    return docs.join(gone, "doc_id", "left_anti")
