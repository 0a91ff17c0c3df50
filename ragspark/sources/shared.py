"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder, in local mode only: executors of a
    cluster would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ragspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system in the JVM."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """The folder is deleted when the driver ends: tables that a returned DataFrame still reads live as long as it can."""
    made, system = hadoop_path(spark, path)
    system.deleteOnExit(made)


#: Bytes of an Arrow batch that a Python worker takes.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, unless they are smaller already: ten thousand rows of texts or blocks are
    more than a worker's memory. Results run after the function that makes them has returned, so the setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut` writes inside are deleted when it ends, not when the driver does: for long sessions. What is
    made inside has to be collected or written inside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            made, system = hadoop_path(spark, path)
            system.delete(made, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet and returns it reread, so Spark knows the table's true size when it plans,
    and lost executors cost one stage at most."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(schema).parquet(path)
