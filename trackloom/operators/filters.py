"""Predicates and filters as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S


def in_rectangle(x, y, width: float, height: float, slack: float) -> Column:
    return S.c(x).between(-slack, width + slack) & S.c(y).between(-slack, height + slack)


def keep_in_spans(df: DataFrame, spans: Column, t: str) -> DataFrame:
    """Rows in some span (both ends inclusive); null or empty ``spans`` keep all."""
    return df.where(spans.isNull() | (F.size(spans) == 0) | F.exists(spans, lambda s: F.col(t).between(s["a"], s["b"])))


def motion_flags(df: DataFrame, key: list[str], t: str, x: str, y: str, limit: float, outside: Column, moved: Column) -> DataFrame:
    """flags: offfield, viewmoved, and fast on the later of two samples too far apart
    in speed."""
    w = Window.partitionBy(*key).orderBy(t)
    d = df.withColumns({"_dt": F.col(t) - F.lag(t).over(w), "_d": F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))})
    fast = (F.col("_dt") > 0) & (F.col("_d") / F.when(F.col("_dt") > 0, F.col("_dt")) > limit)
    flags = F.array_compact(F.array(F.when(outside, "offfield"), F.when(moved, "viewmoved"), F.when(fast, "fast")))
    return d.withColumn("flags", flags).drop("_dt", "_d")


def without_flags(df: DataFrame, banned: list[str]) -> DataFrame:
    return df.where(~F.arrays_overlap("flags", F.array(*map(F.lit, banned))))


def reasons(*named: tuple[str, Column]) -> Column:
    """Names of the conditions that hold; null counts as not holding."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in named]))


def calibration_reasons(points, inliers, mean_error, max_error) -> Column:
    """Why a calibration isn't admitted: too few points or inliers, errors too large
    or not finite."""
    bad = lambda e, most: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")) | (e > most)
    return reasons(("points", S.c(points) < 8), ("inliers", S.c(inliers).isNotNull() & (S.c(inliers) < 8)), ("mean error", bad(S.c(mean_error), 0.25)), ("max error", bad(S.c(max_error), 0.75)))


def first_flag(*named: tuple[str, Column]) -> Column:
    out = None
    for name, cond in named:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def demote_small(df: DataFrame, root: str, least: int, ident: str) -> DataFrame:
    """Rows of groups smaller than ``least`` get id -1; all rows stay."""
    return df.withColumn(ident, F.when(F.count("*").over(Window.partitionBy(root)) < least, F.lit(-1)).otherwise(F.col(ident)))


def mask_other_side(df: DataFrame, key: list[str], score: str, candidate_side: str, side: str, confidence: str, least: float) -> DataFrame:
    """Candidates of the other side score -inf where the row's side is known well
    enough, unless no candidate would be left."""
    sure = F.col(side).isNotNull() & (F.col(confidence) >= least)
    some = F.max((F.col(candidate_side) == F.col(side)).cast("int")).over(Window.partitionBy(*key)) == 1
    return df.withColumn("gated", F.when(sure & some & (F.col(candidate_side) != F.col(side)), F.lit(float("-inf"))).otherwise(F.col(score)))


def category(*ordered: tuple[str, Column], rest: str) -> Column:
    """The first condition that holds names the row."""
    return F.coalesce(first_flag(*ordered), F.lit(rest))


def violations(df: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """Rows that refer to nothing allowed, or repeat a key: (key, problem)."""
    unknown = df.select(*key).join(allowed.select(*key), key, "left_anti").withColumn("problem", F.lit("unknown"))
    twice = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key, F.lit("repeated").alias("problem"))
    return unknown.distinct().union(twice)


def fresh(out_at, *inputs) -> Column:
    """An output is current if no existing input is newer by more than a second."""
    newest = F.greatest(*[S.c(i) for i in inputs]) if len(inputs) > 1 else S.c(inputs[0])
    return S.c(out_at).isNotNull() & (newest.isNull() | (S.c(out_at) >= newest - 1))
