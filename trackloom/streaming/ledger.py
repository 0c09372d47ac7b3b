"""Streaming forms: keyed mailbox, job ledger, budgets.

Files dropped into a folder are the stream. State is keyed and watermarked, so it
stays bounded; sinks are idempotent per batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.plans.runtime import ship

ENTRIES = "kind string, id string, at bigint, bytes bigint, payload string"
EVENTS = "job string, at timestamp, event string, reason string"
JOBS = "job string, state string, attempts int, reason string, at timestamp"
STRIKES = 3
ENDS = ("done", "cancelled", "benched")
DAY_MS = 86_400_000


def read_mailbox(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def deduplicated(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (kind, id, at) once: redelivered entries drop out within the watermark."""
    timed = entries.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["kind", "id", "at"])


def daily_counts(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """Writes per kind and UTC day, for a rate budget."""
    timed = entries.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 day").alias("day"), "kind").agg(F.count("*").alias("n")).select("day.start", "kind", "n")


def latest_sink(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends each batch's latest entries under its own
    batch number: a replayed batch overwrites itself. Readers take the latest of all
    (:func:`trackloom.sources.documents.mailbox_listing`)."""

    def write(batch: DataFrame, number: int) -> None:
        own = F.struct("at", "bytes", "payload")
        last = batch.groupBy("kind", "id").agg(F.max_by(own, "at").alias("v")).select("kind", "id", "v.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def job_states(events: DataFrame, delay: str = "1 hour", keep_ms: int = DAY_MS) -> DataFrame:
    """The job ledger: requested, started, progressed, done, failed, cancelled events
    to a state per job. Three failures bench a job; progress clears its strikes.

    A job at its end is forgotten once the watermark has passed its last event by
    ``keep_ms``; an event that comes later begins a job of its own. So the state holds
    open jobs and those ended lately. Events without a time are left out."""
    ship(events.sparkSession)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now, attempts, reason, at = state.get if state.exists else ("queued", 0, None, None)
        rows = pd.concat(list(frames)).sort_values(["at", "event"], kind="mergesort")
        for r in rows.itertuples():
            if now in ENDS:
                break
            if r.event == "started":
                now = "running"
            elif r.event == "progressed":
                attempts, reason = 0, None
            elif r.event == "failed":
                attempts, reason = attempts + 1, r.reason
                now = "benched" if attempts >= STRIKES else "failed"
            elif r.event in ("done", "cancelled", "superseded", "dropped"):
                now = r.event
            at = r.at
        state.update((now, int(attempts), reason, at))
        if now in (*ENDS, "superseded", "dropped"):
            state.setTimeoutTimestamp(max(int(rows["ms"].max()), state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({"job": [key[0]], "state": [now], "attempts": pd.array([attempts], "int32"), "reason": [reason], "at": [at]})

    timed = events.where("at is not null").withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    return timed.groupBy("job").applyInPandasWithState(step, JOBS, "state string, attempts int, reason string, at timestamp", "update", GroupStateTimeout.EventTimeTimeout)


def ledger_sink(spark: SparkSession, path: str, delay_ms: int = 3_600_000, keep_ms: int = DAY_MS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps :func:`job_states` as tables: a join and a fold per
    batch instead of a Python call per job.

    ``path/state/batch=n`` holds the jobs that are known after batch ``n`` (from the
    table of the batch before), ``path/changes/batch=n`` what the batch did, ``path/seen``
    the latest time so far, for the watermark. A replayed batch overwrites its own. States
    older than the one before are dropped."""
    ends = (*ENDS, "superseded", "dropped")
    kind = "struct<state:string,attempts:int,reason:string,at:timestamp>"
    table = f"{JOBS}, until bigint, changed boolean"

    def one(*fields: Column) -> Column:
        return F.struct(*[f.alias(n) for f, n in zip(fields, ("state", "attempts", "reason", "at"), strict=True)]).cast(kind)

    def after(now: Column, e: Column) -> Column:
        state, attempts, reason, event = now["state"], now["attempts"], now["reason"], e["event"]
        struck = attempts + 1
        moved = (
            F.when(event == "started", one(F.lit("running"), attempts, reason, e["at"]))
            .when(event == "progressed", one(state, F.lit(0), F.lit(None), e["at"]))
            .when(event == "failed", one(F.when(struck >= STRIKES, "benched").otherwise("failed"), struck, e["reason"], e["at"]))
            .when(event.isin("done", "cancelled", "superseded", "dropped"), one(event, attempts, reason, e["at"]))
            .otherwise(one(state, attempts, reason, e["at"]))
        )
        return F.when(state.isin(*ENDS), now).otherwise(moved).cast(kind)

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        read = lambda what, schema, n: s.read.schema(schema).parquet(f"{path}/{what}/batch={n}")
        known = read("state", table, number - 1) if number else s.createDataFrame([], table)
        seen = read("seen", "ms bigint", number - 1).first()["ms"] if number else None
        edge = max(seen - delay_ms, 0) if seen is not None else 0
        events = batch.where(F.col("at") > F.timestamp_millis(F.lit(edge))) if edge else batch.where("at is not null")
        new = events.groupBy(F.col("job").alias("_job")).agg(F.sort_array(F.collect_list(F.struct("at", "event", "reason"))).alias("_rows"), F.max(F.unix_millis("at")).alias("_last"))
        held = known.where(F.col("until").isNull() | (F.col("until") > edge))
        j = held.select("job", one(*map(F.col, ("state", "attempts", "reason", "at"))).alias("_now"), "until").join(new, F.col("job").eqNullSafe(F.col("_job")), "full")
        touched, queued = F.col("_rows").isNotNull(), one(F.lit("queued"), F.lit(0), F.lit(None), F.lit(None))
        j = j.withColumn("_s", F.when(touched, F.aggregate("_rows", F.coalesce("_now", queued), after)).otherwise(F.col("_now")))
        until = F.when(touched, F.when(F.col("_s.state").isin(*ends), F.greatest("_last", F.lit(edge)) + keep_ms)).otherwise(F.col("until"))
        j = j.select(F.coalesce("job", "_job").alias("job"), "_s.state", "_s.attempts", "_s.reason", "_s.at", until.alias("until"), touched.alias("changed"))
        j.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        read("state", table, number).where("changed").drop("until", "changed").write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        latest = batch.agg(F.greatest(F.max(F.unix_millis("at")), F.lit(seen).cast("bigint")).alias("ms"))
        latest.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        if number > 1:
            old = s._jvm.org.apache.hadoop.fs.Path(f"{path}/state/batch={number - 2}")
            old.getFileSystem(s._jsc.hadoopConfiguration()).delete(old, True)

    return write


def job_states_batch(events: DataFrame) -> DataFrame:
    """The same ledger from a whole log: last terminal or latest event per job, and
    failures since the last progress."""
    at = F.struct("at", "event")
    last = events.groupBy("job").agg(F.max(F.when(F.col("event") == "progressed", at)).alias("_p"))
    d = events.join(last, "job")
    fails = F.count_if((F.col("event") == "failed") & (F.col("_p").isNull() | (at > F.col("_p"))))
    final = F.min_by("event", F.when(F.col("event").isin("done", "cancelled"), at))
    g = d.groupBy("job").agg(fails.alias("attempts"), final.alias("_final"), F.max_by("event", F.when(F.col("event").isin("started", "failed"), at)).alias("_latest"))
    state = F.when(F.col("attempts") >= STRIKES, "benched").when(F.col("_final").isNotNull(), F.col("_final")).when(F.col("_latest") == "started", "running").when(F.col("_latest") == "failed", "failed").otherwise("queued")
    return g.select("job", state.alias("state"), F.col("attempts").cast("int").alias("attempts"))
