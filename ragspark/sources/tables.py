"""Driver tables, Markdown corpora, keyed tables, JSON-lines logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FRONT_MATTER = ("id", "silo", "department", "office", "confidentiality", "document_type", "fiscal_year", "author", "last_modified", "title")


#: Tables up to this size are dealt over all cores: one small file, however many rows it has, is one task otherwise.
DEALT_BYTES = 64 << 20
#: Tables of texts, whose rows cost far more than their bytes.
TEXTS = ("documents", "pages")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of a small table over all cores. The shuffle is bounded by DEALT_BYTES; larger tables stay as their files are
    split. Filters and projections still reach the scan."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= DEALT_BYTES else rows


def spread(rows: DataFrame, times: int = 4) -> DataFrame:
    """Narrow rows of any size over ``times`` tasks a core, for work that costs a row far more than moving it."""
    return rows.repartition(times * rows.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name in TEXTS else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with the flat metadata that filters read: silo, office, confidentiality, fiscal_year."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    level = F.when(F.col("toxic") == 1, "Restricted").when(F.col("quality") == 0, "Confidential").when(F.col("quality") == 1, "Internal").otherwise("Public")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select("doc_id", "text", "n_chars", F.col("source").alias("silo"), F.col("lang").alias("office"), level.alias("confidentiality"), (1990 + F.col("n_chars") % 120).cast("int").alias("fiscal_year"))


CORPUS_SQL = """(SELECT d.doc_id, text, n_chars, source AS silo, lang AS office,
  CASE WHEN toxic = 1 THEN 'Restricted' WHEN quality = 0 THEN 'Confidential' WHEN quality = 1 THEN 'Internal' ELSE 'Public' END AS confidentiality,
  CAST(1990 + n_chars % 120 AS INTEGER) AS fiscal_year
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def read_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """(source_path, content) of each file below ``path`` with one of the suffixes."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("source_path"), F.col("value").alias("content"))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("source_path").endswith(s)
    return rows.where(wanted)


def front_matter(content: Column) -> list[Column]:
    """Columns of a Markdown document whose header, between two lines of ---, holds ``key: value`` lines."""
    head = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ ]*\"?(.*?)\"?$", 1)), F.lit(""))
    kinds = {"fiscal_year": "int", "last_modified": "date"}
    fields = [field(k).try_cast(kinds[k]).alias(k) if k in kinds else field(k).alias(k) for k in FRONT_MATTER]
    return [*fields, F.regexp_replace(content, r"(?s)\A---\n.*?\n---\n\s*", "").alias("body")]


def upserted(table_: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``table_`` with rows of ``changes`` in place of those with the same key."""
    return table_.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def deleted(table_: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return table_.join(keys.select(key).distinct(), key, "left_anti")


def append_json(rows: DataFrame, path: str) -> None:
    """One JSON line a row, after those already there."""
    rows.write.mode("append").json(path)


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of binaryFile rows, in byte order of the path."""
    return files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")
