"""Operating a corpus: freshness, consent, incidents, sampling, telemetry, spend, budgets, erasure, backfill, reviews."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ragspark.functions import text as T
from ragspark.operators.numbering import numbered

SAMPLE_RATE, ALERT = 0.005, 0.82


def _shown(number, pattern: str):
    """A number by a decimal pattern, such as 0.### or 0.##%."""
    return F.call_function("format_number", F.col(number) if isinstance(number, str) else number, F.lit(pattern))


def nearest_rank(rows: DataFrame, column: str, share: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """The nearest-rank percentile of a column; nulls are ignored."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({share}) within group (order by {column})").alias(f"p{round(share * 100)}"), F.count(column).alias("samples"))


def freshness(events: DataFrame) -> DataFrame:
    """One row: p95 of index lag and of cache lag in seconds over (changed_at, indexed_at, served_at); negative lags are
    left out, a missing served_at has no cache lag."""
    lag = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    rows = events.select(lag(F.col("changed_at"), F.col("indexed_at")).alias("i"), lag(F.col("changed_at"), F.col("served_at")).alias("c"))
    rows = rows.select(F.when(F.col("i") >= 0, F.col("i")).alias("i"), F.when(F.col("c") >= 0, F.col("c")).alias("c"))
    return rows.agg(F.expr("percentile_disc(0.95) within group (order by i)").alias("index_p95"), F.expr("percentile_disc(0.95) within group (order by c)").alias("cache_p95"), F.count("i").alias("samples"))


def consent_coverage(grants: DataFrame, population: DataFrame, scope: str) -> DataFrame:
    """One row: covered, people, coverage by each user's latest grant of the scope (user_id, scope, granted, version,
    updated_at); 1.0 without people."""
    latest = grants.where(F.col("scope") == scope).groupBy("user_id").agg(F.max_by("granted", F.struct("updated_at", "version")).alias("granted"))
    rows = population.select("user_id").distinct().join(latest, "user_id", "left")
    out = rows.agg(F.count_if(F.coalesce("granted", F.lit(False))).alias("covered"), F.count("*").alias("people"))
    return out.select("covered", "people", F.round(F.when(F.col("people") > 0, F.col("covered") / F.col("people")).otherwise(1.0), 6).alias("coverage"))


def load_report(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """p50, p95 and p99 by nearest rank, the largest value and the number of samples; nulls are ignored."""
    parts = [F.expr(f"percentile_disc({s}) within group (order by {column})").alias(f"p{round(s * 100)}") for s in (0.5, 0.95, 0.99)]
    return rows.groupBy(*by).agg(*parts, F.max(column).alias("longest"), F.count(column).alias("samples"))


def incident_report(incidents: DataFrame) -> DataFrame:
    """(severity, incidents, open, first_detected)."""
    return incidents.groupBy("severity").agg(F.count("*").alias("incidents"), F.count_if(~F.col("resolved")).alias("open"), F.min("detected_at").alias("first_detected"))


def open_incidents(incidents: DataFrame) -> DataFrame:
    """(place, incident_id, severity, detected_at) of those not resolved, in order of detection."""
    rows = incidents.where(~F.col("resolved")).select("incident_id", "severity", "detected_at")
    return numbered(rows, [], ["detected_at", "incident_id"]).select(F.col("pos").alias("place"), "incident_id", "severity", "detected_at")


def sampled(rows: DataFrame, key: str, rate: float = SAMPLE_RATE) -> DataFrame:
    """Rows drawn by a digest of their key: the same on every run."""
    return rows.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 1_000_000 < int(rate * 1_000_000))


def rolling_mean(daily: DataFrame, days: int = 7, alert: float = ALERT) -> DataFrame:
    """(day, mean, alert) over the ``days`` days that end with each day; (day, n, total) are daily sums, so the window runs
    over days and not over samples."""
    w = Window.orderBy("number").rangeBetween(-(days - 1), 0)
    rows = daily.withColumn("number", F.datediff("day", F.lit("1970-01-01").cast("date")))
    mean = F.round(F.sum("total").over(w) / F.sum("n").over(w), 6)
    return rows.withColumn("mean", mean).select("day", "mean", (F.col("mean") < alert).alias("alert"))


def latency(requests: DataFrame, width: str) -> DataFrame:
    """(bin, name, requests, p50, p95, errors, mean) a tumbling window of ``width``."""
    rows = requests.groupBy(F.window("ts", width).start.alias("bin"), "name")
    return rows.agg(F.count("*").alias("requests"), F.round(F.expr("percentile(duration, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(duration, 0.95)"), 6).alias("p95"), F.count_if(~F.col("success")).alias("errors"), F.round(F.avg("duration"), 6).alias("mean"))


def failures(requests: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(name, requests, failed, exceptions, rate): requests left-joined with exceptions by operation."""
    known = exceptions.groupBy("operation_id").agg(F.count("*").alias("x"))
    rows = requests.join(known, "operation_id", "left").groupBy("name").agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("x"), F.lit(0)).alias("exceptions"))
    return rows.withColumn("rate", F.round(F.col("failed") / F.col("requests"), 6))


def rolling_spend(charges: DataFrame, window_s: int) -> DataFrame:
    """Adds ``spent``: a tenant's positive charges (tenant, ts, usd) in the ``window_s`` seconds up to and including ts."""
    w = Window.partitionBy("tenant").orderBy("us").rangeBetween(-(window_s * 1_000_000 - 1), 0)
    rows = charges.where("usd > 0").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.withColumn("spent", F.round(F.sum("usd").over(w), 4)).drop("us")


def costs(usage: DataFrame, input_price: float, output_price: float, embedding_price: float = 0.0) -> DataFrame:
    """(tenant, usd) of token counts at prices a thousand tokens."""
    cost = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price + F.coalesce("embedding_tokens", F.lit(0)) * embedding_price) / 1000
    return usage.groupBy("tenant").agg(F.round(F.sum(cost), 6).alias("usd"))


def charged(spent) -> float:
    """The sum of charges (time, usd) in order of time. A running total from which old charges are taken, or Python's corrected sum,
    differs in the last digits, and budgets are met to the cent."""
    total = 0.0
    for _, usd in spent:
        total += usd
    return total


def budget_admission(requests: DataFrame, most: int, rate_s: float, quota: float, quota_s: float, cooldown_s: float) -> DataFrame:
    """Adds ``outcome`` to (tenant, request_id, ts, usd): breaker, rate, quota or admitted, tested in this order. A quota
    breach opens the tenant's breaker for the cooldown; a rate slot is used even if the quota then refuses; only
    admitted requests spend. Tenants stream through tasks in order of time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        times, spent, shut = deque(), deque(), -1
        for f in batches:
            out = []
            for who, t, usd in zip(f.tenant, f.us, f.usd, strict=True):
                if who != now:
                    now, times, spent, shut = who, deque(), deque(), -1
                while times and times[0] <= t - rate_s * 1e6:
                    times.popleft()
                while spent and spent[0][0] <= t - quota_s * 1e6:
                    spent.popleft()
                if t < shut:
                    out.append("breaker")
                elif len(times) >= most:
                    out.append("rate")
                else:
                    times.append(t)
                    if charged(spent) >= quota:
                        shut = t + cooldown_s * 1e6
                        out.append("quota")
                    else:
                        out.append("admitted")
                        if usd > 0:
                            spent.append((t, usd))
            yield f.assign(outcome=out)

    rows = requests.select("tenant", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "usd").repartition("tenant").sortWithinPartitions("tenant", "us", "request_id")
    return rows.mapInPandas(run, rows.select("*").schema.add("outcome", "string"))


def erased(chunks: DataFrame, subjects: DataFrame, key: bytes, at: str) -> tuple[DataFrame, DataFrame]:
    """(remaining, receipts): chunks without those of the subjects' documents (document_id), and a signed canonical
    receipt a document."""
    gone = chunks.join(subjects.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("chunks"))
    told = subjects.select("document_id").distinct().join(gone, "document_id", "left").select("document_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.lit(at).alias("erased_at"))
    body = F.to_json(F.struct("document_id", "chunks", "erased_at"))
    receipts = told.withColumn("receipt", body).withColumn("signature", T.hmac_sha256(F.col("receipt"), key))
    return chunks.join(subjects.select("document_id").distinct(), "document_id", "left_anti"), receipts


def _utc(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def erasure_receipts(requests: DataFrame, chunks: DataFrame, entities: DataFrame, redacted: DataFrame, key: bytes, sla_days: int = 30) -> DataFrame:
    """(request_id, subject_id, sla_met, receipt, signature) of requests (request_id, subject_id, received_at, completed_at): what was
    erased of each store (chunks and entities: subject_id, a row a record) and redacted in the audit log (subject_id, records), as
    canonical JSON. The signature covers it with an empty signature of its own."""
    count = lambda rows, name: rows.groupBy("subject_id").agg(F.count("*").cast("int").alias(name))
    rows = requests.join(count(chunks, "_c"), "subject_id", "left").join(count(entities, "_e"), "subject_id", "left").join(redacted.select("subject_id", F.col("records").cast("int").alias("_r")), "subject_id", "left")
    done = _utc(F.col("completed_at"))

    def store(name: str, erased: Column, kept: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), erased.alias("recordsErased"), kept.alias("recordsRedacted"), done.alias("completedAt"))

    none = F.lit(None).cast("int")
    stores = F.array(store("vector-store", F.coalesce("_c", F.lit(0)), none), store("graph-store", F.coalesce("_e", F.lit(0)), none))
    stores = F.when(F.coalesce("_r", F.lit(0)) > 0, F.concat(stores, F.array(store("audit-log", none, F.col("_r"))))).otherwise(stores)
    met = F.col("completed_at") - F.col("received_at") <= F.expr(f"interval {sla_days} days")
    body = F.to_json(F.struct(F.col("request_id").alias("requestId"), F.col("subject_id").alias("subjectId"), _utc(F.col("received_at")).alias("receivedAt"), done.alias("completedAt"), met.alias("slaMet"), stores.alias("stores"), F.lit("").alias("signature")))
    return rows.select("request_id", "subject_id", met.alias("sla_met"), body.alias("receipt")).withColumn("signature", T.hmac_sha256(F.col("receipt"), key))


def backfill_due(chunks: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Chunks of another embedding model that no earlier run has finished. Rows are marked done after their write."""
    return chunks.where(F.col("embedding_model") != model).join(done.select("chunk_id"), "chunk_id", "left_anti")


def cutover(live_hit_rate: float, shadow_hit_rate: float, slack: float = 1e-4) -> bool:
    return shadow_hit_rate >= live_hit_rate - slack


def reingested(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table after the changed documents' chunks, old or new, are replaced by the fresh ones: no orphans."""
    return chunks.join(changed.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def latest_versions(events: DataFrame, processed: DataFrame | None = None, tenant: str | None = None) -> DataFrame:
    """(document_id, version) to ingest: each document's highest version above what was processed."""
    rows = events if tenant is None else events.where(F.col("tenant_id") == tenant)
    top = rows.groupBy("document_id").agg(F.max("version").alias("version"))
    if processed is None:
        return top
    old = processed.select("document_id", F.col("version").alias("old"))
    return top.join(old, "document_id", "left").where(F.col("old").isNull() | (F.col("version") > F.col("old"))).drop("old")


def live_states(states: DataFrame, now) -> DataFrame:
    """The latest state a key (id, blob, written_at, expires_at) that is alive at ``now``; expired is absent."""
    last = states.groupBy("id").agg(F.max_by(F.struct("blob", "expires_at"), "written_at").alias("s"))
    return last.select("id", "s.*").where(F.lit(now) < F.col("expires_at"))


def reviews(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending in order of arrival, resolved in order of review) of a review log (item_id, event, at, verdict)."""
    state = log.groupBy("item_id").agg(F.min(F.when(F.col("event") == "submitted", F.col("at"))).alias("submitted_at"), F.max(F.when(F.col("event") == "resolved", F.col("at"))).alias("reviewed_at"), F.max_by(F.when(F.col("event") == "resolved", F.col("verdict")), F.when(F.col("event") == "resolved", F.col("at"))).alias("verdict"))
    return state.where("reviewed_at is null").orderBy("submitted_at", "item_id"), state.where("reviewed_at is not null").orderBy("reviewed_at", "item_id")


#: How a backfill writes: in nightly batches, in paced batches, or as a whole shadow cohort that is cut over at once.
SCHEDULES = ("nightly", "trickle", "shadow")


def backfilled(chunks: DataFrame, done: DataFrame, model: str, embed, schedule: str = "nightly", batches: int = 1) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(upserts, done) of each step of a backfill of chunks on another model. ``embed`` maps a table of chunks to one with
    new embeddings. Batches are dealt by a hash of chunk_id; the shadow schedule is one step. The caller writes the
    upserts first and marks done after, so what a crash interrupts is due again."""
    if schedule not in SCHEDULES:
        raise ValueError(f"unknown schedule {schedule!r}")
    due = backfill_due(chunks, done, model)
    steps = 1 if schedule == "shadow" else batches
    for i in range(steps):
        part = embed(due.where(F.pmod(F.xxhash64("chunk_id"), F.lit(steps)) == i)).withColumn("embedding_model", F.lit(model))
        yield part, part.select("chunk_id")


def reindexed(live: DataFrame, arrivals: DataFrame, model: str, embed, hit_rate, slack: float = 1e-4) -> tuple[DataFrame, DataFrame, bool]:
    """(serving, rollback, cut_over): a shadow table of ``live`` on a new model, with documents that arrive meanwhile written
    to both, serves once its hit rate is not below the live one's; the other table is kept for a rollback."""
    both = live.unionByName(arrivals)
    shadow = embed(both).withColumn("embedding_model", F.lit(model)).select(*both.columns)
    ready = cutover(hit_rate(both), hit_rate(shadow), slack)
    return (shadow, both, True) if ready else (both, shadow, False)


def dashboard(metrics: DataFrame) -> DataFrame:
    """(title, value, detail, link): six tiles of one row of metrics."""
    number, share = lambda c: _shown(F.col(c), "0.###"), lambda c: _shown(F.col(c), "0.##%")
    # fixed values: titles and links of the tiles
    tiles = [
        ("Faithfulness (today)", number("faithfulness_today"), F.concat(F.lit("7-day "), number("faithfulness_7_day")), "faithfulness/samples"),
        ("PII redaction rate", share("redaction_rate"), None, "redaction/events"),
        ("Tenant leaks prevented", F.col("leaks_prevented").cast("string"), None, "tenant-guard/blocks"),
        ("Active erasure requests", F.col("erasures").cast("string"), None, "gdpr/requests"),
        ("Consent coverage", share("coverage"), F.concat("covered", F.lit("/"), "people", F.lit(" ("), "scope", F.lit(")")), "consent/coverage"),
        ("Open incidents", F.col("open_incidents").cast("string"), None, "incidents/open"),
    ]
    rows = [F.struct(F.lit(t).alias("title"), v.alias("value"), (F.lit(None).cast("string") if d is None else d).alias("detail"), F.lit(link).alias("link")) for t, v, d, link in tiles]
    return metrics.select(F.inline(F.array(*rows)))


def model_card(profile: DataFrame, inventory: DataFrame, key: bytes) -> DataFrame:
    """(markdown, signature): the card of a profile (one row: system, version, generated_at, intended_use, models
    array<struct<role,name,version>>, metrics array<struct<name,value>>, failures, controls) and the corpus inventory (silo,
    documents, confidentiality), signed by HMAC over its bytes."""
    sources = inventory.select(F.struct("silo", "confidentiality", F.concat(F.lit("| "), "silo", F.lit(" | "), F.col("documents").cast("string"), F.lit(" | "), "confidentiality", F.lit(" |\n")).alias("line")).alias("s"))
    listed = sources.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "").alias("sources"))
    lines = lambda column, line: F.array_join(F.transform(column, line), "")
    # fixed values: headings and table heads of the card
    text = F.concat(
        F.lit("# Model Card: "), "system", F.lit(" v"), "version", F.lit("\n\n_Generated "), "generated_at", F.lit("_\n\n## Intended Use\n\n"), "intended_use",
        F.lit("\n\n## Models\n\n| Role | Name | Version |\n|---|---|---|\n"), lines("models", lambda m: F.concat(F.lit("| "), m["role"], F.lit(" | "), m["name"], F.lit(" | "), m["version"], F.lit(" |\n"))),
        F.lit("\n## Data Sources\n\n| Silo | Documents | Confidentiality |\n|---|---|---|\n"), "sources",
        F.lit("\n## Performance Metrics\n\n| Metric | Value |\n|---|---|\n"), lines("metrics", lambda m: F.concat(F.lit("| "), m["name"], F.lit(" | "), _shown(m["value"], "0.###"), F.lit(" |\n"))),
        F.lit("\n## Known Failure Modes\n\n"), lines("failures", lambda f: F.concat(F.lit("- "), f, F.lit("\n"))),
        F.lit("\n## Operational Controls\n\n"), lines("controls", lambda f: F.concat(F.lit("- "), f, F.lit("\n"))),
    )
    made = profile.crossJoin(listed).select(text.alias("markdown"))  # one row each
    return made.select("markdown", T.hmac_sha256(F.col("markdown"), key).alias("signature"))


REVIEW_ACTION = "request-human-review"


def explanations(answers: DataFrame) -> DataFrame:
    """Adds chips, full_panel, cited, chain, model and action to answers (risk, confidence, citations, reasoning, model_name,
    model_version): only answers of high risk show the whole panel and offer a review."""
    high = F.col("risk") == "High"
    chips = F.concat(F.lit("Confidence="), _shown("confidence", "0.##"), F.lit(";Sources="), F.size("citations").cast("string"), F.lit(";Model="), "model_name")
    empty = lambda c: F.when(high, F.col(c)).otherwise(F.array().cast(answers.schema[c].dataType))
    return answers.withColumns({
        "chips": chips, "full_panel": high, "cited": empty("citations"), "chain": empty("reasoning"),
        "model": F.when(high, F.concat("model_name", F.lit(" "), "model_version")), "action": F.when(high, F.lit(REVIEW_ACTION)),
    })
