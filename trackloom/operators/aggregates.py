"""Aggregations: votes, coverage, histograms, apportionment, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S


def majority(df: DataFrame, key: list[str], value: str, order: str, weight: Column | None = None) -> DataFrame:
    """Each key's heaviest value (first seen on ties), its share and the total."""
    w = F.lit(1) if weight is None else weight
    each = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.sum(w).alias("w"), F.min(order).alias("first"))
    g = each.groupBy(*key).agg(F.max_by(F.struct(value, "w"), F.struct(F.col("w"), -F.col("first"))).alias("m"), F.sum("w").alias("total"))
    return g.select(*key, F.col(f"m.{value}").alias(value), (F.col("m.w") / F.col("total")).alias("share"), "total")


def two_way_vote(df: DataFrame, key: list[str], side: str, confidence: str, a: str, b: str, floor: float = 0.05) -> DataFrame:
    """Confidence-weighted vote between two sides; b on ties, null without votes. Weights
    are added as decimals, so that equal ones tie whatever the order of rows; only those
    that don't fit (not finite, or beyond 1e20) are added as they are."""
    w = F.greatest(F.col(confidence), F.lit(floor))

    def total(name: str) -> Column:
        mine = F.when(F.col(side) == name, w)
        exact = mine.try_cast("decimal(38,18)")
        return F.coalesce(F.when(F.count(mine) == F.count(exact), F.try_sum(exact).cast("double")), F.sum(mine), F.lit(0.0))

    g = df.groupBy(*key).agg(total(a).alias("a_weight"), total(b).alias("b_weight"))
    return g.withColumn("winner", F.when((F.col("a_weight") == 0) & (F.col("b_weight") == 0), None).when(F.col("a_weight") > F.col("b_weight"), a).otherwise(b))


def track_summary(df: DataFrame, key: str, t: str, x: str, side: str, order: str) -> DataFrame:
    """Span, size, ends, and the majority side with its confidence: the decided
    share of rows times the majority's share of those."""
    base = df.groupBy(key).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n"), F.count(side).alias("decided"), F.min_by(x, F.struct(t, order)).alias("x0"), F.max_by(x, F.struct(t, order)).alias("x1"))
    m = majority(df, [key], side, order).select(key, F.col(side), F.col("share"))
    return base.join(m, key, "left").withColumn("confidence", F.coalesce(F.col("decided") / F.col("n") * F.col("share"), F.lit(0.0)))


def custody(df: DataFrame, key: str, t: str, lo: float, hi: float, frames: Column) -> DataFrame:
    """Coverage of a window: share of its frames seen, and the gaps longer than
    max(1.5 median steps, 0.3)."""
    d = df.where(F.col(t).between(lo, hi)).select(key, F.round(t, 3).alias("_t")).distinct()
    d = d.withColumn("_step", F.col("_t") - F.lag("_t").over(Window.partitionBy(key).orderBy("_t")))
    m = d.groupBy(key).agg(F.percentile("_step", 0.5).alias("_m"))
    long = F.when(F.col("_step") > F.greatest(F.col("_m") * 1.5, F.lit(0.3)), F.col("_step"))
    g = d.join(m, key).groupBy(key).agg(F.count("*").alias("seen"), F.count(long).alias("gaps"), F.coalesce(F.max(long), F.lit(0.0)).alias("longest"), F.coalesce(F.sum(long), F.lit(0.0)).alias("lost"), F.min("_t").alias("first"), F.max("_t").alias("last"))
    return g.withColumn("coverage", F.col("seen") / frames)


def clipped_seconds(spans: DataFrame, key: list[str], lo: Column, hi: Column) -> DataFrame:
    """Seconds of spans (lo, hi) inside a window."""
    return spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0.0), F.least(F.col("hi"), hi) - F.greatest(F.col("lo"), lo))).alias("seconds"))


def grid_histogram(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(x) / cell).alias("gx"), F.floor(F.col(y) / cell).alias("gy")).agg(F.count("*").alias("n"))


def largest_remainder(tally: DataFrame, group: list[str], key: str, n: str, budget: int) -> DataFrame:
    """Whole-number shares of ``budget`` in proportion to ``n``; remainders go by
    largest fraction, then by key descending."""
    w = Window.partitionBy(*group)
    d = tally.withColumn("_exact", F.col(n) * F.lit(float(budget)) / F.sum(n).over(w)).withColumn("_floor", F.floor("_exact"))
    rank = F.row_number().over(w.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(key).desc()))
    d = d.withColumns({"_rank": rank, "_left": F.lit(budget) - F.sum("_floor").over(w)})
    return d.withColumn("share", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("long")).drop("_exact", "_floor", "_rank", "_left")


def accuracy(df: DataFrame, key: list[str], truth: Column, guess: Column) -> DataFrame:
    """hit, wrong and unresolved counts, and percentages to one digit (null: none)."""
    g = df.groupBy(*key).agg(F.count_if(truth == guess).alias("hit"), F.count_if(truth != guess).alias("wrong"), F.count_if(truth.isNotNull() & guess.isNull()).alias("unresolved"))
    done = F.col("hit") + F.col("wrong")
    return g.withColumn("pct", F.when(done > 0, F.round(F.col("hit") * 100.0 / done, 1)))


def spread(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Median, mean and 90th percentile (linear interpolation)."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9)))
    g = df.groupBy(*key).agg(p.alias("_p"), F.avg(value).alias("mean")) if key else df.agg(p.alias("_p"), F.avg(value).alias("mean"))
    return g.select(*key, F.col("_p")[0].alias("median"), "mean", F.col("_p")[1].alias("p90"))


def nearest_rank(df: DataFrame, key: list[str], value: str, ps: list[float]) -> DataFrame:
    """Quantiles as the element at floor(p (n - 1)), not interpolated: by rank, so
    no group's values are gathered."""
    w = Window.partitionBy(*key)
    d = df.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    return d.groupBy(*key).agg(*[F.max(F.when(F.col("_r") == F.floor((F.col("_n") - 1) * p), F.col(value))).alias(f"p{round(p * 100)}") for p in ps])


def centroid_update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Weighted mean of two centroid tables ``(key, vector, n)``."""
    o, n = old.select(key, F.col("vector").alias("ov"), F.col("n").alias("on")), new.select(key, F.col("vector").alias("nv"), F.col("n").alias("nn"))
    j = o.join(n, key, "full")
    mixed = F.transform(F.arrays_zip("ov", "nv"), lambda z: (z["ov"] * F.col("on") + z["nv"] * F.col("nn")) / (F.col("on") + F.col("nn")))
    return j.select(key, F.when(F.col("ov").isNull(), F.col("nv")).when(F.col("nv").isNull(), F.col("ov")).otherwise(mixed).alias("vector"), (F.coalesce("on", F.lit(0)) + F.coalesce("nn", F.lit(0))).alias("n"))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, dimension by dimension (combined map-side)."""
    e = df.select(key, F.posexplode(vector).alias("dim", "v")).groupBy(key, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.count("*").alias("n"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("vector"), F.max("n").alias("n"))


def latest_decisions(log: DataFrame, key: str, order: list[str], action: str, keep: list[str]) -> DataFrame:
    """The last decision per key, if its action is one of ``keep``."""
    own = F.struct(*[c for c in log.columns if c != key])
    last = log.groupBy(key).agg(F.max_by(own, F.struct(*order)).alias("d")).select(key, "d.*")
    return last.where(F.col(action).isin(keep))


def content_version(df: DataFrame, cols: list[str]) -> DataFrame:
    """One hash of a table's rows, whatever their order. Row hashes are combined
    per group of their first byte before the last step, so no list grows unbounded."""
    row = df.select(F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = row.groupBy(F.substring("h", 1, 2).alias("b"), F.substring("h", 3, 3).alias("b2")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "b2", "h"))), lambda s: s["h"]), ""), 256).alias("version"))


def snapshot_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer comparison: status and which fields differ (null equals null)."""
    x = a.select(key, F.struct(*fields).alias("a"))
    y = b.select(key, F.struct(*fields).alias("b"))
    j = x.join(y, key, "full")
    differ = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda v: v.isNotNull())
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return j.select(key, status.alias("status"), F.when(status == "changed", F.array_join(differ, ",")).otherwise("").alias("fields"))


def folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """Holdout fold of each different value of ``order``: its rank modulo k."""
    from trackloom.operators.windows import numbered

    ids = numbered(df.select(order).distinct(), [order], "_n")
    return df.join(ids.select(order, F.pmod(F.col("_n") - 1, F.lit(k)).alias("fold")), order)


def robust_location(df: DataFrame, key: str, x: str, y: str, least: int = 6, max_error: float = 2.0) -> DataFrame:
    """Median position, redone without what lies beyond median + 2.5 IQR of the
    distance; kept with enough rows and a small standard error."""
    m = df.groupBy(key).agg(F.percentile(x, 0.5).alias("mx"), F.percentile(y, 0.5).alias("my"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    d = df.join(m, key).withColumn("_d", F.hypot(F.col(x) - F.col("mx"), F.col(y) - F.col("my")))
    q = d.groupBy(key).agg(F.percentile("_d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    d = d.join(q, key).where(F.col("_d") <= F.col("_q")[1] + 2.5 * (F.col("_q")[2] - F.col("_q")[0]))
    g = d.groupBy(key).agg(F.percentile(x, 0.5).alias("x"), F.percentile(y, 0.5).alias("y"), F.count("*").alias("n"), (F.stddev_pop("_d") / F.sqrt(F.count("*"))).alias("error"))
    return g.where(F.col("error") < max_error)


def stretches(edges: DataFrame, key: str, t: str, limit: int) -> DataFrame:
    """The longest stretches between consecutive times of a key, ``limit`` in all."""
    d = edges.select(key, t).distinct().withColumn("next", F.lead(t).over(Window.partitionBy(key).orderBy(t))).where("next is not null")
    return d.withColumn("length", F.col("next") - F.col(t)).orderBy(F.desc("length"), key, t).limit(limit)


def route_length(df: DataFrame, key: str, t: str, x: str, y: str) -> DataFrame:
    """Positions at one time averaged, and the path's length as |dx| + |dy|."""
    p = df.groupBy(key, F.round(t, 3).alias("t")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    w = Window.partitionBy(key).orderBy("t")
    step = F.abs(F.col("x") - F.lag("x").over(w)) + F.abs(F.col("y") - F.lag("y").over(w))
    return p.withColumn("_s", step).groupBy(key).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("dist"), F.count("*").alias("samples"))
