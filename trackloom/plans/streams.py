"""Registered streams: folders that fill up, and queries that go on where they stopped.

The given tables land in slices of time, as files of a folder; after each slice a
stream runs over what is new (``availableNow``) and stops. State and progress lie in the
checkpoint, so every run but the first is a restart: what a job's earlier events did to
it is known, no file is read twice, and a sink that is written per batch number ends up
the same if a batch runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.operators import joins as J
from trackloom.plans.catalog import ORACLES, QUERIES, query
from trackloom.plans.runtime import Scratch, table
from trackloom.streaming import ledger as T

__all__ = ["ORACLES", "QUERIES"]

SLICES = 3


def run_over(scratch: Scratch, slices: list[DataFrame], land: Callable[[DataFrame, str], None], start: Callable[[str, str], StreamingQuery]) -> None:
    """Land one slice after the other and run the stream to its end after each.
    ``start(folder, checkpoint)`` begins the query."""
    for part in slices:
        land(part, scratch.path("landed"))
        q = start(scratch.path("landed"), scratch.path("checkpoint"))
        q.awaitTermination()
        if q.exception():
            raise q.exception()


def _slices(d: DataFrame, at: str) -> list[DataFrame]:
    """Slices of equal time."""
    lo, hi = d.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return [d]
    edge = [lo + (hi - lo) * k / SLICES for k in range(1, SLICES)]
    where = F.lit(0)
    for e in edge:
        where = where + (F.col(at) > F.lit(e)).cast("int")
    return [d.where(where == k) for k in range(SLICES)]


#: A job per user and three days.
_JOB = "user_id || '-' || floor(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 259200000000)::BIGINT"
_KIND = {"signup": "requested", "click": "started", "view": "progressed", "error": "failed", "purchase": "done"}


def _log(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    kind = F.lit(None).cast("string")
    for name, event in _KIND.items():
        kind = F.when(F.col("event_type") == name, event).otherwise(kind)
    job = F.concat_ws("-", "user_id", F.floor(micros / 259_200_000_000).cast("long"))
    return table(spark, sf, "events").select(job.alias("job"), F.col("ts").cast("timestamp").alias("at"), kind.alias("event"), F.lit(None).cast("string").alias("reason"))


@query(f"""
WITH e AS (SELECT {_JOB} AS job, ts, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KIND.items())} END AS event FROM events),
n AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (event = 'progressed') OVER w AS p FROM e WINDOW w AS (PARTITION BY job ORDER BY ts, event)),
f AS (SELECT *, count(*) FILTER (event = 'failed') OVER (PARTITION BY job, p ORDER BY n) AS strikes FROM n),
z AS (SELECT *, min(CASE WHEN event = 'done' OR event = 'failed' AND strikes >= 3 THEN n END) OVER (PARTITION BY job) AS stop FROM f),
l AS (SELECT job, max(n) AS last, arg_max(strikes, n) AS attempts, arg_max(event, n) FILTER (event IN ('started', 'failed', 'done')) AS event FROM z WHERE n <= coalesce(stop, n) GROUP BY job)
SELECT job, CASE WHEN event IS NULL THEN 'queued' WHEN event = 'started' THEN 'running' WHEN event = 'done' THEN 'done' WHEN attempts >= 3 THEN 'benched' ELSE 'failed' END AS state, attempts::INT AS attempts FROM l""")
def job_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """States and strikes of jobs, from a log that comes in slices."""
    scratch = Scratch(spark, "jobs")

    def start(folder: str, checkpoint: str) -> StreamingQuery:
        log = spark.readStream.schema(T.EVENTS).parquet(folder)
        sink = T.ledger_sink(spark, scratch.path("ledger"), 40 * T.DAY_MS, 40 * T.DAY_MS)
        return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()

    log = _log(spark, sf)
    run_over(scratch, _slices(log, "at"), lambda d, folder: d.write.mode("append").parquet(folder), start)
    states = spark.read.schema(f"{T.JOBS}, batch int").parquet(f"{scratch.path('ledger')}/changes")
    return states.groupBy("job").agg(F.max_by(F.struct("state", "attempts"), "batch").alias("s")).select("job", "s.state", "s.attempts")


@query("""
WITH e AS (SELECT event_type AS kind, user_id::VARCHAR AS id, date_diff('millisecond', TIMESTAMP '1970-01-01 00:00:00', ts) AS ms, length(props)::BIGINT AS bytes, event_id FROM events)
SELECT kind, id, max(ms)::BIGINT AS at, arg_max(bytes, ms) AS bytes FROM e GROUP BY kind, id""")
def mailbox_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The latest entry of each mailbox key, though every file is delivered twice."""
    scratch = Scratch(spark, "mailbox")

    def start(folder: str, checkpoint: str) -> StreamingQuery:
        fresh = T.deduplicated(T.read_mailbox(spark, folder), "40 days")
        sink = T.latest_sink(spark, scratch.path("latest"))
        return fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()

    def land(d: DataFrame, folder: str) -> None:
        for _ in range(2):
            d.write.mode("append").json(folder)

    entries = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.length("props").cast("bigint").alias("bytes"), F.col("props").alias("payload")
    )
    run_over(scratch, _slices(entries, "at"), land, start)
    return J.last_per_key(spark.read.parquet(scratch.path("latest")), ["kind", "id"], ["at"]).select("kind", "id", "at", "bytes")
