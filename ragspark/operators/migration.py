"""Moving an index to another embedding model while it serves: two keyed tables and a pointer that says which one serves.

The pointer is a numbered file created like a table's manifest, so a switch is one rename. What a backfill has finished is what
the shadow table holds: a chunk's write and its mark are one commit, and a run that was cut off goes on with what is missing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ragspark.operators.embedding import neighbours
from ragspark.operators.operations import cutover
from ragspark.sources.keyed import KeyedTable, create_text, read_text
from ragspark.sources.shared import cut, hadoop_path

SCHEMA = "document_id string, chunk_id string, text string, embedding array<double>, embedding_model string"


class Reindex:
    """Tables below ``root``, one a model. ``embed(rows, model)`` adds embedding to rows with document_id, chunk_id and text; ``number``
    is a chunk's number, which decides ties."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame, str], DataFrame], model: str | None = None, buckets: int = 16, number: Column | None = None):
        self.spark, self.root, self.embed, self.buckets = spark, root.rstrip("/"), embed, buckets
        self.number = F.xxhash64("chunk_id") if number is None else number
        if self._last() is None:
            if model is None:
                raise ValueError("the first model has to be named")
            self._point(0, {"serving": model, "previous": None, "shadow": None})

    def _last(self) -> int | None:
        at, system = hadoop_path(self.spark, f"{self.root}/pointer")
        if not system.exists(at):
            return None
        return max((int(f.getPath().getName()[:-5]) for f in system.listStatus(at) if f.getPath().getName().endswith(".json")), default=None)

    def _point(self, number: int, state: dict) -> None:
        create_text(self.spark, f"{self.root}/pointer/{number:08d}.json", json.dumps(state))

    def state(self) -> dict:
        """serving, previous (kept for a rollback) and shadow (being filled), by model."""
        return json.loads(read_text(self.spark, f"{self.root}/pointer/{self._last():08d}.json"))

    def _move(self, **changes) -> dict:
        state = self.state() | changes
        self._point(self._last() + 1, state)
        return state

    def table(self, model: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/tables/{model}", SCHEMA, self.buckets)

    def serving(self) -> DataFrame:
        return self.table(self.state()["serving"]).read()

    def _made(self, rows: DataFrame, model: str) -> DataFrame:
        return self.embed(rows.select("document_id", "chunk_id", "text"), model).withColumn("embedding_model", F.lit(model))

    def write(self, rows: DataFrame) -> None:
        """Chunks (document_id, chunk_id, text) into the serving table and, while one is filled, the shadow."""
        state = self.state()
        for model in filter(None, (state["serving"], state["shadow"])):
            self.table(model).upsert(self._made(rows, model))

    def begin(self, model: str) -> None:
        self._move(shadow=model)
        self.table(model)

    def due(self) -> DataFrame:
        """Chunks of the serving table that the shadow does not hold."""
        return self.serving().join(self.table(self.state()["shadow"]).read().select("document_id", "chunk_id"), ["document_id", "chunk_id"], "left_anti")

    def backfill(self, steps: int = 1, stop_after: int | None = None) -> int:
        """Embeds what is due in ``steps`` batches of whole documents, each committed by itself. Returns the batches made;
        ``stop_after`` ends early, as a crash between two batches would."""
        due, model, made = cut(self.due().select("document_id", "chunk_id", "text")), self.state()["shadow"], 0
        for i in range(steps):
            if made == stop_after:
                break
            part = due.where(F.pmod(F.xxhash64("document_id"), F.lit(steps)) == i)
            self.table(model).upsert(self._made(part, model))
            made += 1
        return made

    def hit_rate(self, model: str, questions: DataFrame, gold: DataFrame, k: int = 10) -> float:
        """Share of the questions (query_id, text) for which exact search in the model's table has one of the expected
        documents (query_id, document_id) among the first k."""
        rows = self.table(model).read()
        ids = rows.select("document_id", "chunk_id", "embedding").withColumn("number", self.number)
        asked = self.embed(questions.select(F.col("query_id").cast("string").alias("document_id"), F.col("query_id").cast("string").alias("chunk_id"), "text"), model)
        hits = neighbours(asked.select(F.col("chunk_id").cast("long").alias("query_id"), "embedding"), ids.select(F.col("number").alias("chunk_id"), "embedding"), k)
        found = hits.join(ids.select(F.col("number").alias("chunk_id"), "document_id"), "chunk_id").join(gold, ["query_id", "document_id"], "left_semi")
        asked_count = questions.select("query_id").distinct().count()
        return found.select("query_id").distinct().count() / asked_count if asked_count else 0.0

    def cut_over(self, questions: DataFrame, gold: DataFrame, k: int = 10, slack: float = 1e-4) -> tuple[bool, float, float]:
        """(whether the shadow serves now, the live hit rate, the shadow's). It does if it misses nothing and its rate is not below."""
        state = self.state()
        live, shadow = (self.hit_rate(state[w], questions, gold, k) for w in ("serving", "shadow"))
        ready = not self.due().take(1) and cutover(live, shadow, slack)
        if ready:
            self._move(serving=state["shadow"], previous=state["serving"], shadow=None)
        return ready, live, shadow

    def roll_back(self) -> None:
        """The table that served before serves again; the other is filled as a shadow, so that nothing written since is lost."""
        state = self.state()
        if state["previous"] is None:
            raise ValueError("nothing to roll back to")
        held = lambda model: self.table(model).read().withColumn("digest", F.sha2("text", 256))
        same = ["document_id", "chunk_id", "digest"]
        late = held(state["serving"]).select(*same, "text").join(held(state["previous"]).select(*same), same, "left_anti")
        self.table(state["previous"]).upsert(self._made(cut(late), state["previous"]))
        self._move(serving=state["previous"], previous=state["serving"])
