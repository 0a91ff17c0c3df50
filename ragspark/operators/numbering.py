"""Places of rows in an order, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ragspark.sources.shared import cut


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 in each group of ``by`` in ``order`` (nulls first), and ``n``, the group's rows.

    Rows are sorted into ranges and written with numbers that rise within each; a range's offset is the count of the group's
    rows in the ranges before it, one row a group and range. Ties are told apart by where they were read."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order, "_read")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = cut(rows).withColumn("_read", F.monotonically_increasing_id())
    laid = cut(read.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_read").withColumn("_seq", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_seq", 33)
    counts = laid.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_seq").alias("_first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_c").over(group).alias("n")))
    same = part == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return laid.join(offsets, same).withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_shift", "_of", *[f"_by_{c}" for c in by])
