"""Mixing sources to target token counts by entropy balancing, in DataFrame operations only.

Rates of documents minimise the relative entropy to taking each once, subject to each source's words meeting its
target: the solution tilts a document's rate exponentially in its size, exp(lambda * size / mean), held at 2. The
convex dual has one unknown a source. Each Newton iteration is a job: the histogram of sizes (source, size, count; a
written table) meets the unknowns, value and slope of the dual's gradient are summed a source, map-side first, and the
next unknowns are written. A bracket guards each step; iterations end when all sources meet their targets.

Rates become copies by a threshold on hash(document) - fraction(rate), chosen a source so that the words taken
come nearest to the target. The threshold is a weighted quantile, found by two histograms of 4096 bins: partial
sums only, no sort, and no task that holds a source. One document a source, the nearest in size to what is then
over or under, is taken once more or once less.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .workspace import Workspace

# fixed values: weights by place of the source, share of all words, most copies
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BINS = 4096
CLOSE, NARROW = 1e-10, 1e-13
SEED = 71


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place() -> Column:
    """A document's place in [0, 1), from its columns _key and _ordinal."""
    return F.shiftrightunsigned(F.xxhash64("_key", "_ordinal", F.lit(SEED)), 11) / F.lit(float(1 << 53))


def _keyed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns``, doc_id, _source, _size, and what rows are told apart by: _key, and where a row was read, _part and _seq."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return docs.select(*columns, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"), words().alias("_size"), key.alias("_key"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"))


def _repeated(keyed: DataFrame) -> DataFrame:
    """(_key) of rows that are not alone."""
    return keyed.groupBy("_key").agg(F.count("*").alias("c")).where("c > 1").select("_key")


def _numbered(keyed: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``keyed`` with _ordinal in place of _part and _seq: rows of one key count from 0, whatever row gets which number. They
    are counted a key and partition and numbered inside it, so no task holds a key."""
    if repeated is None:
        return keyed.drop("_part", "_seq").withColumn("_ordinal", F.lit(0).cast("long"))
    alone = keyed.join(repeated, "_key", "left_anti").drop("_part", "_seq").withColumn("_ordinal", F.lit(0).cast("long"))
    rows = keyed.join(repeated, "_key", "left_semi")
    counts = rows.groupBy("_key", "_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_seq")) - 1
    rows = rows.withColumn("_inside", inside).join(counts.select("_key", "_part", before.alias("_before")), ["_key", "_part"])
    return alone.unionByName(rows.withColumn("_ordinal", F.col("_before") + F.col("_inside")).drop("_part", "_seq", "_inside", "_before"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (_source, _words, ...): water is filled in up to MOST times each source's words, at one level
    a unit of weight. The windows run over sources, not documents."""
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    rows = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")))
    rows = rows.withColumn("_full", F.lit(float(MOST)) * F.col("_words") / F.col("_weight"))
    order = Window.orderBy("_full", F.col("_source").asc_nulls_last())
    whole = Window.partitionBy()
    total = F.lit(SHARE) * F.sum("_words").over(whole)
    before = F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(MOST)
    rest = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (total - before) / rest).withColumn("_k", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_k", "_level"))).over(whole)
    level = F.coalesce(first["_level"], F.lit(float("inf")))
    return rows.withColumn("target", F.least(F.lit(float(MOST)) * F.col("_words"), level * F.col("_weight"))).drop("_full", "_level", "_k")


def _tilted(sizes: DataFrame, aimed: DataFrame, ws: Workspace) -> DataFrame:
    """``aimed`` (one row a source: _source, _words, _docs, target) with _lambda, by Newton iterations over ``sizes``
    (_source, _size, _n)."""
    start = {"lo": -1e4, "hi": 1e4, "x": 0.0}
    state = ws.put(aimed.withColumns({c: F.lit(v) for c, v in start.items()} | {"done": F.col("target") >= F.lit(MOST * (1 - 1e-12)) * F.col("_words")}), "newton-0")
    top, step = math.log(MOST), 0
    while state.where("not done").take(1):
        step += 1
        z = F.col("_size") / F.greatest(F.col("_words") / F.col("_docs"), F.lit(1e-9))
        raw = F.col("x") * z
        mass = F.col("_n") * F.col("_size") * F.exp(F.least(raw, F.lit(top)))
        now = F.struct("_words", "_docs", "target", "lo", "hi", "x").alias("s")
        sums = _with(sizes, state.where("not done")).groupBy("_source").agg(F.sum(mass).alias("sum"), F.sum(F.when(raw < top, mass * z).otherwise(0.0)).alias("d"), F.first(now).alias("s"))
        f = F.col("sum") - F.col("s.target")
        rows = sums.select("_source", "s.*", f.alias("f"), "d")
        lo, hi = F.when(F.col("f") > 0, F.col("lo")).otherwise(F.col("x")), F.when(F.col("f") > 0, F.col("x")).otherwise(F.col("hi"))
        rows = rows.withColumns({"lo": lo, "hi": hi, "to": F.when(F.col("d") > 0, F.col("x") - F.col("f") / F.col("d"))})
        done = (F.abs("f") <= CLOSE * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("hi") - F.col("lo") <= NARROW * F.greatest(F.abs("x"), F.lit(1.0)))
        inside = (F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi"))
        x = F.when(done, F.col("x")).when(inside, F.col("to")).otherwise((F.col("lo") + F.col("hi")) / 2)
        rows = rows.withColumns({"done": done, "x": x}).select(*state.columns)
        state = ws.put(state.where("done").unionByName(rows), f"newton-{step}")
        ws.drop(f"newton-{step - 1}")
    return state.withColumnRenamed("x", "_lambda").drop("lo", "hi", "done")


def _rated(rows: DataFrame) -> DataFrame:
    """Adds _base (whole copies) and _v (place less the rate's fraction; null where the rate is whole)."""
    raw = F.col("_lambda") * F.col("_size") / F.greatest(F.col("_words") / F.col("_docs"), F.lit(1e-9))
    full = F.col("target") >= F.lit(MOST * (1 - 1e-12)) * F.col("_words")
    rate = F.when(full, F.lit(float(MOST))).otherwise(F.exp(F.least(raw, F.lit(math.log(MOST)))))
    rows = rows.withColumn("_rate", F.least(rate, F.lit(float(MOST)))).withColumn("_base", F.floor("_rate").cast("long"))
    fine = F.when(F.col("_rate") > F.col("_base"), (place() - (F.col("_rate") - F.col("_base")) + 1) * (BINS // 2))
    rows = rows.withColumn("_v", fine).withColumn("_bin", F.floor("_v").cast("long"))
    return rows.withColumn("_fine", F.floor((F.col("_v") - F.col("_bin")) * BINS).cast("long"))


def _crossing(bins: DataFrame, by: str, left: str) -> DataFrame:
    """Of each source, the bin in which the sum of words passes what is left, and what is then still left."""
    run = F.sum("_sum").over(Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    found = bins.withColumn("_run", run).where(F.col("_run") > F.col(left))
    return found.groupBy("_source").agg(F.min(F.struct(F.col(by).alias("at"), (F.col(left) - F.col("_run") + F.col("_sum")).alias("left"), F.col("_sum").alias("sum"))).alias("hit"))


def plan(spark: SparkSession, sized: DataFrame, ws: Workspace) -> DataFrame:
    """One row a source: _source, _words, _docs, target, _lambda and the threshold (_b1, _b2, _in).
    sized: (doc_id, _source, _size, _key, _ordinal), one row a document, already written."""
    sizes = ws.put(sized.groupBy("_source", "_size").agg(F.count("*").alias("_n")), "sizes")
    sources = sizes.groupBy("_source").agg(F.sum(F.col("_n") * F.col("_size")).alias("_words"), F.sum("_n").alias("_docs"))
    rates = _tilted(sizes, targets(sources).drop("_weight"), ws)

    rated = _rated(_with(sized, rates))
    bins = rated.groupBy("_source", "_bin").agg(F.sum("_size").alias("_sum"), F.sum(F.col("_size") * F.col("_base")).alias("_whole"), F.first("target").alias("target"))
    left = F.first("target").over(Window.partitionBy("_source")) - F.sum("_whole").over(Window.partitionBy("_source"))
    bins = ws.put(bins.withColumn("_left", left), "bins")
    first = _crossing(bins.where("_bin is not null"), "_bin", "_left").select("_source", F.col("hit.at").alias("_b1"), F.col("hit.left").alias("_left"))
    first = ws.put(_with(rates, first, "left"), "first")
    inner = _rated(_with(sized, first)).where("_bin = _b1").groupBy("_source", "_fine").agg(F.sum("_size").alias("_sum"), F.first("_left").alias("_left"))
    second = _crossing(inner, "_fine", "_left").select("_source", F.col("hit.at").alias("_b2"), (F.col("hit.left") * 2 >= F.col("hit.sum")).alias("_in"))
    cut = ws.put(_with(first, second, "left").withColumns({"_at": F.lit(None).cast("double"), "_of": F.lit(None).cast("long"), "_by": F.lit(0).cast("long")}), "cut")

    # what the threshold leaves over or under is met best by one document more or less, the one nearest to it in size
    taken = copies(sized, cut)
    short = taken.groupBy("_source").agg((F.first("target") - F.sum(F.col("_copies") * F.col("_size"))).alias("_short"))
    short = ws.put(short, "short")
    gap = F.abs(F.abs("_short") - F.col("_size"))
    able = (F.col("_size") > 0) & (gap < F.abs("_short")) & F.when(F.col("_short") > 0, F.col("_copies") < MOST).otherwise(F.col("_copies") > 0)
    best = _with(taken, short).where(able).groupBy("_source").agg(F.min(F.struct(gap.alias("gap"), place().alias("at"), F.col("_size").alias("of"), F.signum("_short").cast("long").alias("by"))).alias("b"))
    best = best.select("_source", F.col("b.at").alias("_at"), F.col("b.of").alias("_of"), F.col("b.by").alias("_by"))
    return ws.put(_with(cut.drop("_at", "_of", "_by"), best, "left"), "plan")


def _with(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a written table of one row a source; Spark broadcasts it if its files are small."""
    table = table.withColumnRenamed("_source", "_s")
    return rows.join(table, F.col("_source").eqNullSafe(F.col("_s")), how).drop("_s")


def copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` (doc_id, _source, _size, ...) with _copies, _words and target."""
    rated = _rated(_with(rows, planned))
    # a source without a crossing has room for every fraction
    below = F.col("_b1").isNull() | (F.col("_bin") < F.col("_b1"))
    inside = (F.col("_bin") == F.col("_b1")) & (F.col("_b2").isNull() | (F.col("_fine") < F.col("_b2")) | ((F.col("_fine") == F.col("_b2")) & F.col("_in")))
    more = F.col("_v").isNotNull() & (below | inside)
    last = F.when((place() == F.col("_at")) & (F.col("_size") == F.col("_of")), F.col("_by")).otherwise(0)
    return rated.withColumn("_copies", F.col("_base") + F.coalesce(more, F.lit(False)).cast("long") + last).drop("_at", "_of", "_by", "_rate", "_base", "_v", "_bin", "_fine", "_b1", "_b2", "_in", "_left", "_lambda", "_docs")


def _prepared(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """The written table (doc_id, _source, _size, _key, _ordinal), and the keys of rows that repeat, if there are any."""
    keyed = ws.put(_keyed(docs), "keyed")
    repeated = ws.put(_repeated(keyed), "repeated")
    repeated = repeated if repeated.take(1) else None
    return (_numbered(keyed, None) if repeated is None else ws.put(_numbered(keyed, repeated), "sized")), repeated


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source, ...).

    Null texts have size 0, very long ones are counted whole; a null source is a source of its own, the last. Documents
    without words are in the mix once and add nothing. Rows that repeat, in whole or by their id, null or not, are documents
    of their own. Reruns agree. Other columns are ignored; an empty table gives no rows."""
    ws = Workspace(spark, "mixing")
    sized, _ = _prepared(docs, ws)
    out = copies(sized, plan(spark, sized, ws))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_words").alias("source_size"), "target", (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    ws = Workspace(spark, "mixing")
    sized, repeated = _prepared(docs, ws)
    planned = plan(spark, sized, ws)
    rows = _numbered(_keyed(docs, F.struct(*docs.columns).alias("_row")), repeated)
    out = copies(rows, planned).where("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")
