"""Extension ports as table functions: a chunker or index strategy of one's own is a Python function, called from SQL by LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_CHUNK = T.StructType().add("chunk_index", "integer").add("text", "string").add("start_offset", "integer").add("end_offset", "integer")


def chunker(split: Callable[..., Iterable[tuple[int, int, str]]], most_options: int = 4):
    """A table function of (text, options...) with rows (chunk_index, text, start_offset, end_offset), from a function of a text that gives
    its chunks as (start, end, chunk). Null and empty texts have no chunks."""

    class Chunks:
        @staticmethod
        def analyze(text: AnalyzeArgument, *options: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, (T.StringType, T.NullType)):
                raise ValueError(f"the text is a {text.dataType.simpleString()}, not a string")
            if len(options) > most_options or not all(o.isConstantExpression for o in options):
                raise ValueError("options are constants")
            return AnalyzeResult(_CHUNK)

        def eval(self, text, *options):
            for i, (start, end, chunk) in enumerate(split(text, *options) if text else ()):
                yield i, chunk, start, end

    return udtf(Chunks, useArrow=True)


def packer(count: Callable[[str], int], key: str, order: str, text: str = "text"):
    """A table function of (TABLE(chunks), most): consecutive chunks of a key joined while their counts add up to ``most`` at most, rows
    (key, piece, text, chunks). It partitions by ``key`` and sorts by ``order`` by itself; the key's type is that of the table."""

    class Pack:
        @staticmethod
        def analyze(chunks: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
            if not chunks.isTable:
                raise ValueError("the first argument is a table")
            kind = next((f.dataType for f in chunks.dataType.fields if f.name == key), None)
            if kind is None:
                raise ValueError(f"no column {key}")
            schema = T.StructType().add(key, kind).add("piece", "integer").add("text", "string").add("chunks", "integer")
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(order)])

        def __init__(self):
            self.held, self.used, self.piece, self.key = [], 0, 0, None

        def _out(self):
            row = (self.key, self.piece, "".join(self.held), len(self.held))
            self.held, self.used, self.piece = [], 0, self.piece + 1
            return row

        def eval(self, row, most):
            n = count(row[text])
            if self.held and self.used + n > most:
                yield self._out()
            self.key = row[key]
            self.held.append(row[text])
            self.used += n

        def terminate(self):
            if self.held:
                yield self._out()

    return udtf(Pack, useArrow=False)  # with Arrow, the rows that each input row gives are a batch of their own


def register(spark: SparkSession, **functions) -> None:
    """Names table functions for SQL."""
    for name, function in functions.items():
        spark.udtf.register(name, function)
