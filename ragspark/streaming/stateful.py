"""Rules that rest on earlier decisions, as streams with arbitrary state: rate limits, budgets with a breaker, expiring conversations.

Rows wait in list state until the watermark has passed them and are then decided in order of time, so rows that come late
within the watermark's delay change nothing: the stream's rows are those of the batch functions over the same data. A call of the
state or of a timer costs far more than a row, so keys share state in buckets by their hash: a bucket's waiting rows are one value a batch,
what its keys hold is one value. A timer at the earliest waiting row wakes a bucket. State lies in RocksDB; a restart goes on from
the checkpoint."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ragspark.operators.operations import charged

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Buckets of keys. A checkpoint holds for one number of them.
BUCKETS = 512


class _InOrder(StatefulProcessor):
    """Waits for the watermark and passes a key's rows to ``decide`` in order. KEYS names the key, WAITS what a row brings: its time in
    microseconds, its id and what else the rule reads. What a key holds is a list of values that JSON knows."""

    KEYS: tuple[str, ...] = ()
    WAITS: tuple[str, ...] = ("us", "request_id")
    OUT = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.held = handle.getValueState("held", "keys string")
        self.names = [*self.KEYS, *self.WAITS]
        self.told = [f.split()[0] for f in self.OUT.split(", ")]

    def decide(self, key: tuple, rows: list[list], held: list | None) -> tuple[list, list[tuple]]:
        """What the key holds after ``rows``, and the rows told."""
        raise NotImplementedError

    def passed(self, key: tuple, held: list, mark_ms: int) -> tuple[list | None, list[tuple]]:
        """What the time itself decides, once the watermark is at ``mark_ms``: what the key still holds, if anything, and rows told."""
        return held, []

    def wakes(self, held: list) -> int | None:
        """When the time decides something about a key, in microseconds."""
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, us = None, len(self.KEYS)
        for f in rows:
            new = [[None if x != x else x for x in r] for r in f[self.names].itertuples(index=False, name=None)]
            if new:
                self.waiting.appendValue((json.dumps(new),))
                first = min([*([] if first is None else [first]), *(r[us] for r in new)])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, n = timerValues.getCurrentWatermarkInMs(), len(self.KEYS)
        rows = [r for part in self.waiting.get() for r in json.loads(part[0])]
        ready, left = [r for r in rows if r[n] // 1000 < mark], [r for r in rows if r[n] // 1000 >= mark]
        before = self.held.get()[0] if self.held.exists() else "[]"
        held, out = {tuple(k): h for k, h in json.loads(before)}, []
        if ready:
            self.waiting.put([(json.dumps(left),)]) if left else self.waiting.clear()
        ready.sort(key=lambda r: r[: n + 2])
        for k, own in groupby(ready, key=lambda r: tuple(r[:n])):
            held[k], told = self.decide(k, [r[n:] for r in own], held.get(k))
            out += told
        kept, wake = [], [r[n] for r in left]
        for k, h in held.items():
            h, told = self.passed(k, h, mark)
            out += told
            if h is not None:
                kept.append((k, h))
                wake += [] if (at := self.wakes(h)) is None else [at]
        after = json.dumps(kept)
        if not kept:
            self.held.clear()
        elif after != before:
            self.held.update((after,))
        if wake:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=self.told)

    def close(self) -> None:
        pass


class RateLimit(_InOrder):
    """At most ``most`` allowed requests a key in any ``window_s`` seconds; refused ones take no room. A key holds ``most`` times."""

    KEYS = ("tenant", "user_id")
    OUT = "tenant string, user_id long, request_id long, allowed boolean"

    def __init__(self, most: int, window_s: float):
        self.most, self.window = most, window_s * 1e6

    def decide(self, key: tuple, rows: list[list], held: list | None) -> tuple[list, list[tuple]]:
        held, out = held or [], []
        for us, request in rows:
            held = [h for h in held if h > us - self.window]
            out.append((*key, request, len(held) < self.most))
            if out[-1][-1]:
                held.append(us)
        return held, out

    def passed(self, key: tuple, held: list, mark_ms: int) -> tuple[list | None, list[tuple]]:
        """Times that no later row counts are forgotten."""
        held = [h for h in held if h > mark_ms * 1000 - self.window]
        return held or None, []


class Budget(_InOrder):
    """Breaker, rate and quota of a tenant, tested in this order; as the batch function of operations. A tenant holds used slots,
    charges and the end of the open breaker."""

    KEYS = ("tenant",)
    WAITS = ("us", "request_id", "usd")
    OUT = "tenant string, request_id long, outcome string"

    def __init__(self, most: int, rate_s: float, quota: float, quota_s: float, cooldown_s: float):
        self.most, self.rate, self.quota, self.quota_span, self.cooldown = most, rate_s * 1e6, quota, quota_s * 1e6, cooldown_s * 1e6

    def decide(self, key: tuple, rows: list[list], held: list | None) -> tuple[list, list[tuple]]:
        slots, spent, shut = held or ([], [], -1.0)
        out = []
        for us, request, usd in rows:
            slots = [s for s in slots if s > us - self.rate]
            spent = [s for s in spent if s[0] > us - self.quota_span]
            if us < shut:
                outcome = "breaker"
            elif len(slots) >= self.most:
                outcome = "rate"
            else:
                slots.append(us)
                if charged(spent) >= self.quota:
                    shut = us + self.cooldown
                    outcome = "quota"
                else:
                    outcome = "admitted"
                    if usd is not None and usd > 0:
                        spent.append([us, usd])
            out.append((*key, request, outcome))
        return [slots, spent, shut], out

    def passed(self, key: tuple, held: list, mark_ms: int) -> tuple[list | None, list[tuple]]:
        """What no later row counts is forgotten."""
        us, (slots, spent, shut) = mark_ms * 1000, held
        slots, spent = [s for s in slots if s > us - self.rate], [s for s in spent if s[0] > us - self.quota_span]
        return [slots, spent, shut] if slots or spent or shut > us else None, []


class Conversation(_InOrder):
    """The latest value of each slot of a conversation, forgotten ``ttl_us`` of event time after the last write. Every change is
    told: a slot's new value, or that the conversation has expired."""

    KEYS = ("id",)
    WAITS = ("us", "seq", "slot", "blob")
    OUT = "id long, slot string, blob string, expired boolean"

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def decide(self, key: tuple, rows: list[list], held: list | None) -> tuple[list, list[tuple]]:
        until, slots = held or (None, [])
        latest, out = {k: v for k, v in slots}, []  # a slot may be null
        for us, _, slot, blob in rows:
            if until is not None and us >= until:
                latest.clear()
                out.append((*key, None, None, True))
            latest[slot] = blob
            until = us + self.ttl
            out.append((*key, slot, blob, False))
        return [until, list(latest.items())], out

    def passed(self, key: tuple, held: list, mark_ms: int) -> tuple[list | None, list[tuple]]:
        return (None, [(*key, None, None, True)]) if held[0] // 1000 < mark_ms else (held, [])

    def wakes(self, held: list) -> int | None:
        return held[0]


def _decided(rows: DataFrame, rule: _InOrder, late: str) -> DataFrame:
    """Rows without a key, a time or an id take no part. (A null in a batch would also turn its whole numbers into floats on
    their way to Python.)"""
    timed = rows.dropna(subset=[*rule.KEYS, "ts", rule.WAITS[1]]).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    bucket = F.pmod(F.xxhash64(*rule.KEYS), F.lit(BUCKETS)).cast("int")
    return timed.select(bucket.alias("bucket"), *rule.KEYS, *rule.WAITS, "ts").groupBy("bucket").transformWithStateInPandas(rule, rule.OUT, "Append", "EventTime")


def rate_limits(requests: DataFrame, most: int, window_s: float, late: str = "1 day") -> DataFrame:
    """A stream of (tenant, user_id, request_id, allowed) from one of (tenant, user_id, request_id, ts)."""
    return _decided(requests, RateLimit(most, window_s), late)


def budgets(requests: DataFrame, most: int, rate_s: float, quota: float, quota_s: float, cooldown_s: float, late: str = "1 day") -> DataFrame:
    """A stream of (tenant, request_id, outcome) from one of (tenant, request_id, ts, usd)."""
    return _decided(requests, Budget(most, rate_s, quota, quota_s, cooldown_s), late)


def conversations(updates: DataFrame, ttl_s: float, late: str = "1 day") -> DataFrame:
    """A stream of changes (id, slot, blob, expired) from one of (id, slot, blob, seq, ts)."""
    return _decided(updates, Conversation(int(ttl_s * 1e6)), late)


def run_to_end(stream: DataFrame, root: str, name: str = "out") -> DataFrame:
    """Runs a stream over all its source holds, from where its checkpoint below ``root`` ends, and returns all rows it has written
    so far with their epoch. A batch that is run again overwrites its own rows."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")

    try:
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/{name}-state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE[0], before) if before else spark.conf.unset(_STORE[0])
    schema = stream.schema.add("epoch", "integer")
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def in_slices(rows: DataFrame, root: str, slices: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feeds ``slices`` of rows to the stream that ``make`` builds, one after another: each is appended to the source's folder and
    the stream is started again from its checkpoint."""
    spark: SparkSession = rows.sparkSession
    source, out = f"{root}/source-{uuid.uuid4().hex}", None
    for part in slices:
        part.write.mode("append").parquet(source)
        out = run_to_end(make(spark.readStream.schema(rows.schema).parquet(source)), root)
    return out
