"""Streams that stop and go on: jobs against one pass over the whole log."""

import datetime as dt
import random

from pyspark.sql import functions as F

from trackloom.plans import streams
from trackloom.plans.runtime import Scratch
from trackloom.streaming import ledger as T


def in_turn(rows):
    out = {}
    for job, at, event, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        state, strikes = out.get(job, ("queued", 0))
        if state in ("done", "cancelled", "benched"):
            continue
        if event == "failed":
            strikes += 1
            state = "benched" if strikes == 3 else "failed"
        elif event == "progressed":
            strikes = 0
        elif event != "requested":
            state = "running" if event == "started" else event
        out[job] = state, strikes
    return out


def test_jobs_over_restarts(spark):
    """Every slice is a new run of the query from the checkpoint of the last one."""
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(f"j{rng.randrange(40)}", start + dt.timedelta(minutes=i), rng.choice(["requested", "started", "progressed", "failed", "failed", "done"]), None) for i in range(300)]
    log = spark.createDataFrame(rows, T.EVENTS)
    scratch, batches = Scratch(spark, "t"), []

    def begin(folder, checkpoint):
        states = T.job_states(spark.readStream.schema(T.EVENTS).parquet(folder), "40 days")

        def sink(batch, number):
            batches.append((number, {r.job: (r.state, r.attempts) for r in batch.collect()}))

        return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()

    slices = [log.where((F.col("at") >= start + dt.timedelta(minutes=a)) & (F.col("at") < start + dt.timedelta(minutes=a + 75))) for a in range(0, 300, 75)]
    streams.run_over(scratch, slices, lambda d, folder: d.write.mode("append").parquet(folder), begin)
    assert len({n for n, _ in batches}) == len(batches) >= 4  # no batch twice
    found = {}
    for _, states in sorted(batches, key=lambda b: b[0]):
        found |= states
    assert found == in_turn(rows)
    # nothing new: a further run has no batch to work on
    before = len(batches)
    streams.run_over(scratch, [log.limit(0)], lambda d, folder: None, begin)
    assert len([b for b in batches[before:] if b[1]]) == 0


def test_slices_cover_a_table(spark):
    rows = [(i, float(i % 7)) for i in range(50)] + [(99, None)]
    parts = streams._slices(spark.createDataFrame(rows, "i long, at double"), "at")
    assert sum(p.where("at is not null").count() for p in parts) == 50 and len(parts) == streams.SLICES
    assert len(streams._slices(spark.createDataFrame([], "i long, at double"), "at")) == 1
