"""Written intermediate tables in the folder that the whole cluster shares, and batches of bounded size."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ragspark.sources.shared import gone_at_exit, hadoop_path, shared_folder

#: Rows of whole texts that a Python worker works on at once, and bytes of the batches that Spark sends to it.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def bounded(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, unless they are smaller already: results run after the function that
    makes them has returned, so the setting stays. Rows a batch are left as they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


class Workspace:
    """Cuts lineage: ``put`` writes a DataFrame as Parquet and returns it reread, so lost executors cost
    one stage at most and Spark knows the table's true size when it chooses a join. Tables that are not dropped
    are deleted when the driver ends, as results may read them until then."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        bounded(spark)
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.known = False

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        if not self.known:
            gone_at_exit(self.spark, self.root)
            self.known = True
        del df
        self.release()
        return self.get(name, schema)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of finished steps now, not at the driver's next full GC, so that
        the disk in use stays bounded by a few steps."""
        gc.collect()
        self.spark._jvm.System.gc()

    def get(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            made, system = hadoop_path(self.spark, self.path(name))
            system.delete(made, True)
