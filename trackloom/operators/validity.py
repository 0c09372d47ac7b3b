"""Hysteresis over sampled verdicts, without a state to carry along.

A state that changes after enough equal verdicts in a row is known from the rows
alone: unknown samples aside, every unbroken row of one verdict that is long enough
sets the state, whatever it was before, and all other rows change nothing. So the
states of a log are its long rows in order, and long logs split: rows are found within
buckets of time, those at a bucket's ends are joined with their neighbours', and only
these and the long ones are ordered over a whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.joins import asof

#: Verdicts that must last for so many seconds.
LASTING = {"blank": 6.0, "cut": 4.0}


def equal_rows(df: DataFrame, key: str, t: str, value: str, bucket: float) -> DataFrame:
    """``(key, value, n, first, last)``: unbroken rows of one value, nulls skipped."""
    d = df.where(F.col(value).isNotNull()).select(key, F.col(t).cast("double").alias("t"), F.col(value).alias("v"), F.floor(F.col(t) / bucket).alias("b"))
    w = Window.partitionBy(key, "b").orderBy("t", "v")
    new = F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(0))
    d = d.withColumn("r", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = d.groupBy(key, "b", "r").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    part = part.withColumn("end", F.max("r").over(Window.partitionBy(key, "b")))
    inner = part.where((F.col("r") > 0) & (F.col("r") < F.col("end")))
    # the first and the last of each bucket, in order; a bucket is whole where they are one
    edge = part.where((F.col("r") == 0) | (F.col("r") == F.col("end")))
    o = Window.partitionBy(key).orderBy("b", "r")
    broken = (F.lag("v").over(o) != F.col("v")) | (F.lag("b").over(o) == F.col("b"))
    edge = edge.withColumn("g", F.sum(F.coalesce(broken.cast("int"), F.lit(0))).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(key, "g").agg(F.first("v").alias("v"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return inner.select(key, "v", "n", "first", "last").unionByName(joined.select(key, "v", "n", "first", "last")).withColumnRenamed("v", value)


def valid_spans(df: DataFrame, key: str, t: str, verdict: str, hold: int = 2, sample: float = 2.0, lasting: dict[str, float] | None = None, bucket: float | None = None) -> DataFrame:
    """``(key, lo, hi)``: when a view can be trusted, from verdicts every ``sample``
    seconds: ``ok``, others that speak against it, null for no evidence.

    A log counts as good until told otherwise, and changes after ``hold`` equal verdicts
    in a row, for those in ``lasting`` as many as their seconds hold. A span opens with
    the row that confirms it (the first with the log) and ends at the last sample seen
    good (the last with the log); shorter ones than a sample are dropped. Times of one
    log differ.
    """
    need = F.lit(hold)
    for name, seconds in (LASTING if lasting is None else lasting).items():
        need = F.when(F.col(verdict) == name, max(1, round(seconds / sample))).otherwise(need)
    bucket = bucket or 1000 * sample
    strong = equal_rows(df, key, t, verdict, bucket).where(F.col("n") >= need).withColumn("good", F.col(verdict) == "ok")
    ends = df.groupBy(key).agg(F.min(t).cast("double").alias("begin"), F.max(t).cast("double").alias("end"))
    # the log itself opens as good, and closes what is open
    opens = ends.select(key, F.lit(True).alias("good"), F.col("begin").alias("first"), F.lit(0).alias("o"))
    closes = ends.select(key, F.lit(False).alias("good"), F.col("end").alias("first"), F.lit(2).alias("o"))
    marks = strong.select(key, "good", "first", F.lit(1).alias("o")).unionByName(opens).unionByName(closes)
    w = Window.partitionBy(key).orderBy("o", "first")
    turns = marks.withColumn("was", F.lag("good").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("good")))
    spans = turns.withColumns({"stop": F.lead("first").over(w), "last": F.lead("o").over(w) == 2}).where("good and stop is not null")
    seen = df.where(F.col(verdict) == "ok").select(key, F.col(t).cast("double").alias("stop"))
    closed = asof(spans.select(key, F.col("first").alias("lo"), "stop", "last"), seen, key, "stop", [], bucket, strict=True)
    hi = F.when(F.col("last"), F.col("stop")).otherwise(F.coalesce("matched_at", F.col("lo")))
    return closed.select(key, "lo", hi.alias("hi")).where((F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") >= sample))
