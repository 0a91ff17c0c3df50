"""Change feeds and keyed state as streams. The same functions on batches give the same final tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def guarded_versions(events: DataFrame, tenant: str | None = None) -> DataFrame:
    """A stream of (document_id, version): of each micro-batch a document's highest version, if above all that were
    passed on before; duplicates and late lower versions are dropped. One long of state a document."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = max((int(f.version.max()) for f in frames if len(f)), default=None)
        old = state.get[0] if state.exists else None
        if top is not None and (old is None or top > old):
            state.update((top,))
            yield pd.DataFrame({"document_id": [key[0]], "version": [top]})

    rows = events if tenant is None else events.where(F.col("tenant_id") == tenant)
    return rows.groupBy("document_id").applyInPandasWithState(run, "document_id string, version long", "version long", "update", GroupStateTimeout.NoTimeout)


def reingest_batches(rechunk, read_table, write_table):
    """A foreachBatch function: rebuilds the chunk table with the changed documents' chunks replaced.

    rechunk(changed) gives fresh chunks, read_table() the table, write_table(df, epoch) replaces it at once; a batch that
    is run again gives the same table, so a failure needs no special care."""
    from ragspark.operators.operations import reingested

    def run(changed: DataFrame, epoch: int) -> None:
        changed = changed.select("document_id").distinct()
        write_table(reingested(read_table(), changed, rechunk(changed)), epoch)

    return run


def rolling_quality(samples: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding event-time means of (ts, score), with a watermark."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def counted(events: DataFrame, width: str, late: str) -> DataFrame:
    """Tumbling event-time counts and sums by event_type, with a watermark (an extension for late data)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def expiring_state(updates: DataFrame, ttl_ms: int) -> DataFrame:
    """A stream of (id, blob): the latest blob of each conversation, forgotten ``ttl_ms`` after its last write."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        blob = str(rows.sort_values("written_at").blob.iloc[-1])
        state.update((blob,))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"id": [key[0]], "blob": [blob]})

    return updates.groupBy("id").applyInPandasWithState(run, "id string, blob string", "blob string", "update", GroupStateTimeout.ProcessingTimeTimeout)
