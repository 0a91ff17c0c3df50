"""How filters that run one after another share what they remove: an audit of all their orders from one pass over texts.

A document's failures are a mask of 5 bits. Per part and label, 32 signed parity sums are taken, S[k] = the sum over
documents of (-1) ** |mask & k|; the Walsh-Hadamard transform is its own inverse but for a factor of 32, so the counts of
all masks follow exactly. What any order of the filters keeps, removes and repeats is a sum over masks, and a filter's
Shapley value over all 120 orders is the sum of 120 / |mask| over the masks that hold it: of the filters that a document
fails, each is the first in an equal share of the orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# fixed values: the filters, in the order of their bits
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORD = r"[^\x20\x09-\x0D]+"
#: Ways in which rows without an id, which match no label, are dealt where labels are joined.
SALTS = 1024


def _parity(mask: Column, k: int) -> Column:
    return F.lit(1) - F.bit_count(mask.bitwiseAND(k)).cast("int").bitwiseAND(1) * 2


def own_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, bits): bits 1, 2, 4 and 8 of a document failing A to D, and its text's SHA-256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    fails = [n < 50, 100 * F.size(F.array_distinct("words")) < 65 * n, 100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits"))


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row an id: labelled so by any of its rows."""
    hit = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(hit("quality").alias("good"), hit("toxic").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): counts of documents, summed before they are moved; a text's copies and an id's rows
    collapse first. E is decided a text: all of its documents fail it but those with its smallest id and those without one."""
    rows = own_failures(docs).groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("long")
    rows = rows.withColumn("salt", salt).join(marked(labels).withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    label = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "part", "bits", *label).agg(
        F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("loose"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("spared", F.col("loose") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("bits").alias("mask"), F.col("spared").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))
    return texts.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")


def parity_sums(counted: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 signed sums of a part and label."""
    sums = counted.groupBy("part", "good", "toxic").agg(*[F.sum(F.col("n") * _parity(F.col("mask"), k)).alias(f"s{k}") for k in range(MASKS)])
    return sums.select("part", "good", "toxic", F.array(*[f"s{k}" for k in range(MASKS)]).alias("sums"))


def inverted(sums: Column) -> Column:
    """Counts of the masks 0 to 31. The sum over k is 32 times a count, so the division is exact."""
    cell = lambda m: F.aggregate(F.transform(sums, lambda s, k: s * (1 - F.bit_count(k.bitwiseAND(m)).cast("long").bitwiseAND(1) * 2)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(cell(m), 5))


def cells(sums: DataFrame) -> DataFrame:
    """(part, everyone, good, toxic): counts of the 32 masks, one row a part."""
    found = sums.withColumn("cells", inverted(F.col("sums"))).select("part", "good", "toxic", F.posexplode("cells").alias("m", "n"))
    of = [F.sum(F.col("n") * w).alias(name) for name, w in (("everyone", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    masks_ = found.groupBy("part", "m").agg(*of)
    row = F.sort_array(F.collect_list(F.struct("m", "everyone", "good", "toxic")))  # 32 entries
    return masks_.groupBy("part").agg(row.alias("row")).select("part", *[F.col(f"row.{c}").alias(c) for c in ("everyone", "good", "toxic")])


def orders(found: DataFrame) -> DataFrame:
    """Every order and step of each part, from its cells."""
    steps = found.select("*", F.explode(F.lit(ORDERS)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))
    letters = F.split("filter_order", "")
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit_of(x))
    steps = steps.withColumns({"bit": bit_of(F.element_at(letters, F.col("step"))), "before": before})

    def total(of: str, holds) -> Column:
        kept = F.filter(F.col(of), lambda _, m: holds(m))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x)

    fails, earlier = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    share = F.transform("everyone", lambda n, m: F.when(fails(m), n * len(ORDERS) / F.bit_count(m)).otherwise(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total("everyone", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total("everyone", removed).alias("removed"), total("everyone", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("everyone", lambda m: m == F.col("bit")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. A null text is empty and equal to
    empty ones; a null source is the part ''. Rows that repeat count each. Of equal texts, those with the smallest id pass E,
    all of them if the id repeats; rows without an id pass E, fail nobody else by it and have no label. An id is good or toxic
    if any of its labels says so. Very long texts are read whole; an empty table gives no rows."""
    return orders(cells(parity_sums(masks(docs, labels))))
