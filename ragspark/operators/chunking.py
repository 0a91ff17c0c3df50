"""Chunking: one document row to many chunk rows (doc_id, chunk_index, text, start_offset, end_offset, chunk_id)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ragspark.functions import text as T
from ragspark.functions.vector import cosine
from ragspark.operators import code

# fixed values: sizes, and the separators of recursive splitting in order
SIZE, OVERLAP = 500, 100
SENTENCES = 3
LONGEST = 800
SEPARATORS = ("\n## ", "\n# ", "\n\n", "\n", ". ", " ")
MOST_TOKENS = 512
_SCHEMA = "doc_id long, chunk_index int, text string, start_offset int, end_offset int"


def chunk_id(doc: Column | str = "doc_id", index: Column | str = "chunk_index") -> Column:
    return F.concat_ws("#", F.col(doc) if isinstance(doc, str) else doc, F.col(index) if isinstance(index, str) else index)


def fixed_size(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` characters each ``size - overlap``; the last ends the text. Empty texts give no rows."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step, n = size - overlap, F.length("text")
    rows = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).alias("start_offset"))
    return rows.select("doc_id", (F.col("start_offset") / step).cast("int").alias("chunk_index"), F.substring("text", F.col("start_offset") + 1, F.lit(size)).alias("text"), "start_offset", F.least(F.col("start_offset") + size, n).alias("end_offset"))


def sentences(docs: DataFrame, n: int = SENTENCES) -> DataFrame:
    """Groups of ``n`` consecutive sentences, trimmed; blank ones are dropped before they are numbered."""
    # a sentence with the white space after it, so that a group is a slice of the text
    marked = F.regexp_extract_all("text", F.lit(f"(?s).+?(?:{T.SENTENCE_GAP}|\\z)"), F.lit(0))
    rows = docs.select("doc_id", marked.alias("s")).where(F.size("s") > 0)  # a column, so that no group cuts the text again
    groups = F.sequence(F.lit(0), F.ceil(F.size("s") / n).cast("int") - 1)
    joined = F.transform(groups, lambda i: F.trim(F.regexp_replace(F.array_join(F.slice("s", i * n + 1, n), ""), r"\A\s+|\s+\z", "")))
    return rows.select("doc_id", F.posexplode(F.filter(joined, lambda t: t != "")).alias("chunk_index", "text"))


def _mapped(docs: DataFrame, split: Callable[[str], list[tuple[int, int, str]]]) -> DataFrame:
    """Runs ``split`` (text to (start, end, chunk)) on whole texts in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, t, a, z) for d, text in zip(f.doc_id, f.text, strict=True) for i, (a, z, t) in enumerate(split(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "start_offset", "end_offset"])

    return docs.select("doc_id", "text").mapInPandas(run, _SCHEMA)


def recursive_spans(text: str, longest: int = LONGEST, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans of pieces of at most ``longest`` characters. A separator stays with the piece before it; a piece is cut
    by the next separator only while it is too long, at last by length; pieces are never joined again."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, z, depth = todo.pop()
        if z - a <= longest:
            out.append((a, z))
        elif depth == len(separators):
            out += [(i, min(i + longest, z)) for i in range(a, z, longest)]
        else:
            mark, cut, parts = separators[depth], a, []
            while (at := text.find(mark, cut, z)) >= 0:
                parts.append((cut, at + len(mark), depth + 1))
                cut = at + len(mark)
            if cut < z:
                parts.append((cut, z, depth + 1))
            todo += reversed(parts)
    return sorted(out)


def recursive(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Trimmed pieces with their untrimmed spans; blank pieces are dropped before they are numbered."""
    return _mapped(docs, lambda text: [(a, z, text[a:z].strip()) for a, z in recursive_spans(text, longest) if text[a:z].strip()])


def packed_words(text: str, most: int, count: Callable[[str], int]) -> list[tuple[int, int, str]]:
    """Greedy packing of words to at most ``most`` tokens; a word that is longer stays alone."""
    if count(text) <= most:
        return [(0, len(text), text)]
    out, begin, end, used = [], None, 0, 0
    for m in re.finditer(r"\S+", text):
        n = count(m[0])
        if begin is not None and used + n > most:
            out.append((begin, end, text[begin:end]))
            begin, used = None, 0
        begin, end, used = m.start() if begin is None else begin, m.end(), used + n
    return [*out, (begin, end, text[begin:end])] if begin is not None else out


def token_aware(chunks: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Cuts chunks of over ``most`` tokens (a quarter of the characters, rounded up) at words and numbers them anew."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, i, text, start, end in zip(f.doc_id, f.chunk_index, f.text, f.start_offset, f.end_offset, strict=True):
                span = end - start
                rows += [(d, i, j, t, start + min(a, span), start + min(z, span)) for j, (a, z, t) in enumerate(packed_words(text, most, lambda s: -(-len(s) // 4)))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "piece", "text", "start_offset", "end_offset"])

    cut = chunks.select("doc_id", "chunk_index", "text", "start_offset", "end_offset").mapInPandas(run, "doc_id long, part int, piece int, text string, start_offset int, end_offset int")
    order = Window.partitionBy("doc_id").orderBy("part", "piece")
    return cut.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "text", "start_offset", "end_offset")


code_spans = code.spans


def blank(text: Column | str = "text") -> Column:
    """Whether a text is null or white space alone, as Python's strip sees it."""
    return F.coalesce(~F.regexp_like(text, F.lit(r"[^\s\p{Z}\x{1C}-\x{1F}\x{85}]")), F.lit(True))


def code_aware(files: DataFrame, between: str = "\n\n") -> DataFrame:
    """Chunks along types and members of C# sources (doc_id, text). Offsets are those of the members in the file. Where ``files``
    has a source_path, a file of another suffix than .cs is one chunk."""
    if "source_path" not in files.columns:
        return _mapped(files, lambda s: code.spans(s, between))
    is_code = F.lower("source_path").endswith(".cs")
    whole = files.where(~F.coalesce(is_code, F.lit(False)) & ~blank()).select("doc_id", F.lit(0).alias("chunk_index"), "text", F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"))
    return _mapped(files.where(is_code), lambda s: code.spans(s, between)).unionByName(whole)


def semantic(chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """Joins consecutive one-sentence chunks (doc_id, chunk_index, text, embedding) until the cosine of two neighbours
    falls below ``least``."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    cut = (cosine("embedding", F.lag("embedding").over(order)) < least).cast("int")
    rows = chunks.withColumn("_cut", F.when(F.lag("chunk_index").over(order).isNull(), 0).otherwise(cut)).withColumn("_group", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", F.col("_group").cast("int").alias("chunk_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda s: s["text"]), " ").alias("text"))


def contextual(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """Puts a chunk's situating sentence (chunk_id, context) before its text; a blank one changes nothing."""
    joined = chunks.join(contexts, "chunk_id", "left")
    blank = F.trim(F.coalesce("context", F.lit(""))) == ""
    return joined.withColumn("text", F.when(blank, F.col("text")).otherwise(F.concat("context", F.lit("\n\n"), "text"))).drop("context")


def with_assets(chunks: DataFrame, images: DataFrame, tables: DataFrame, page: int = 1) -> DataFrame:
    """Appends the captions of a document's images and the Markdown of its tables on ``page`` to each of its chunks.
    images: (doc_id, page, image_id, caption), blank captions skipped; tables: (doc_id, page, table_id, markdown)."""
    shown = images.where((F.col("page") == page) & (F.trim("caption") != "")).select("doc_id", F.lit(0).alias("k"), F.col("image_id").alias("i"), F.concat(F.lit("\n\n[Figure "), "image_id", F.lit("] "), "caption").alias("t"))
    told = tables.where(F.col("page") == page).select("doc_id", F.lit(1).alias("k"), F.col("table_id").alias("i"), F.concat(F.lit("\n\n[Table "), "table_id", F.lit("]\n"), "markdown").alias("t"))
    added = shown.unionByName(told).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "i", "t"))), lambda s: s["t"]), "").alias("_more"))
    return chunks.join(added, "doc_id", "left").withColumn("text", F.concat("text", F.coalesce("_more", F.lit("")))).drop("_more")


def index_items(chunks: DataFrame, how: str, generated: DataFrame | None = None) -> DataFrame:
    """(item_id, embed_text, chunk_id). how: chunk (the text), sub-chunk (its first sentence; blank gives none), query
    (each non-blank line of the generated reply) or summary (the reply). generated: (chunk_id, reply)."""
    if how == "chunk":
        rows = chunks.select("chunk_id", F.lit(0).alias("i"), F.col("text").alias("embed_text"))
    elif how == "sub-chunk":
        first = F.trim(F.element_at(F.split("text", T.SUBCHUNK_GAP, 2), 1))
        rows = chunks.select("chunk_id", F.lit(0).alias("i"), first.alias("embed_text")).where("embed_text <> ''")
    elif how in ("query", "summary") and generated is not None:
        reply = generated.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        if how == "summary":
            rows = reply.select("chunk_id", F.lit(0).alias("i"), F.col("reply").alias("embed_text"))
        else:
            rows = reply.select("chunk_id", F.posexplode(F.filter(F.transform(F.split("reply", "\n"), lambda t: F.trim(t)), lambda t: t != "")).alias("i", "embed_text"))
    else:
        raise ValueError(f"unknown indexing strategy {how!r}")
    return rows.select(F.concat_ws("/", "chunk_id", F.lit(how), "i").alias("item_id"), "embed_text", "chunk_id")


def indexed_by_suffix(files: DataFrame, how: dict[str, str], default: str = "chunk") -> DataFrame:
    """Index items of chunks with a source_path, each suffix by its own strategy (chunk or sub-chunk)."""
    suffix = F.lower(F.regexp_extract("source_path", r"(\.[^./]+)$", 1))
    strategy = F.lit(default)
    for s, h in how.items():
        strategy = F.when(suffix == s, h).otherwise(strategy)
    rows = files.withColumn("_how", strategy)
    out = index_items(rows.where(F.col("_how") == "chunk"), "chunk")
    return out.unionByName(index_items(rows.where(F.col("_how") == "sub-chunk"), "sub-chunk"))
