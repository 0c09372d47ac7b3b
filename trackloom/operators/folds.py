"""Folds whose next step looks back on what was accepted, not on what came.

A window function sees all rows; here a row is judged by the accepted ones before it,
so the answer to one decides the next. What lies further back than the window can't
matter, so a key's rows fall apart at longer gaps: each stretch is folded on its own,
in parallel, and no stretch is longer than its track was seen without a break.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.runtime import ship


def accepted(df: DataFrame, key: list[str], t: str, order: list[str], values: list[str], window: float, judge: Callable[[np.ndarray, tuple], bool], name: str = "accepted") -> DataFrame:
    """``df`` with a flag: whether ``judge(history, row)`` holds, where ``history`` has
    the ``values`` of rows accepted in the ``window`` before the row's time (its start
    included, the row's own time not), oldest first. Rows with a null among ``values``
    or without a time are accepted and no part of any history.

    ``order`` breaks ties in time; rows equal in all of it are judged in any order.
    """
    ship(df.sparkSession)
    numbered = df.withColumn("_row", F.struct(*df.columns))
    known = F.col(t).isNotNull()
    for v in values:
        known = known & F.col(v).isNotNull()
    w = Window.partitionBy(*key).orderBy(t, *order)
    held = numbered.where(known)
    far = F.coalesce(F.col(t) - F.lag(t).over(w) > window, F.lit(False))
    held = held.withColumn("_far", far.cast("int")).withColumn("_stretch", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = [f"_{i}" for i in range(len(values))]
    slim = held.select(*key, "_stretch", F.col(t).cast("double").alias("_t"), F.struct(*order).alias("_o"), *[F.col(v).cast("double").alias(k) for v, k in zip(values, kinds, strict=True)], "_row")
    shape = slim.select("_row").schema["_row"].dataType.simpleString()

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_t", "ascending"), *[(f"_o{i}", "ascending") for i in range(len(order))]])
        at = table["_t"].to_numpy()
        cols = np.stack([table[k].to_numpy() for k in kinds], axis=1)
        past: deque = deque()
        said = []
        for x, row in zip(at, cols, strict=True):
            while past and past[0][0] < x - window:
                past.popleft()
            history = np.array([r for s, r in past if s < x]).reshape(-1, len(kinds))
            said.append(bool(judge(history, tuple(row))))
            if said[-1]:
                past.append((x, row))
        return pa.table({"_row": table["_row"], name: pa.array(said)})

    flat = slim.select(*key, "_stretch", "_t", *[F.col("_o")[o].alias(f"_o{i}") for i, o in enumerate(order)], *kinds, "_row")
    out = flat.groupBy(*key, "_stretch").applyInArrow(fold, f"_row {shape}, {name} boolean").select("_row.*", name)
    return out.unionByName(numbered.where(~F.coalesce(known, F.lit(False))).select(*df.columns, F.lit(True).alias(name)))


def whole_boxes(df: DataFrame, key: list[str], t: str, order: list[str], height: str, bottom: str, window: float = 1.5, shrink: float = 0.70, rise: float = 0.25, least: int = 5) -> DataFrame:
    """``df`` with ``whole``: false where a box is much shorter than the key's own
    accepted ones lately (median of ``least`` or more) and its bottom has risen: it shows
    only the top of what it did, and its foot is nowhere. Such boxes aren't the measure of
    later ones."""

    def judge(history: np.ndarray, row: tuple) -> bool:
        if len(history) < least:
            return True
        tall, low = np.median(history, axis=0)
        return not (row[0] < shrink * tall and low - row[1] > rise * tall)

    return accepted(df, key, t, order, [height, bottom], window, judge, "whole")
