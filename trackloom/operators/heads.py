"""Whitening heads fitted from scatter matrices that Spark adds up.

A head needs a mean, the scatter of all vectors and their scatter within labels: sums
over rows whose size is the square of the dimension. Every task adds its own rows as
matrix products and passes on one number per cell, Spark adds these, and only the cells
come to the driver, however large the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.runtime import Scratch, ship

CELLS = "i int, j int, total double, within double"


def _cells(total: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(total.shape, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel()), pa.array(within.ravel())], names=["i", "j", "total", "within"])


def label_sums(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``(label, n, sums)`` per label, nulls left out: one sum per component."""
    at = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("at", "x"))
    one = at.groupBy("label", "at").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    return one.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda r: r["s"]).alias("sums"))


def scatter(df: DataFrame, label: str, vector: str, scratch: Scratch, least: int = 2) -> tuple[DataFrame, np.ndarray, int, int]:
    """``(i, j, total, within)``: the scatter of all labelled vectors about their mean,
    and about the means of labels with ``least`` rows or more; the mean; the number of
    vectors; and the degrees of freedom within labels. Vectors have one length."""
    ship(df.sparkSession)
    sums = scratch.keep(label_sums(df, label, vector), "sums")
    place = sums.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()  # the dimension
    if not place:
        raise ValueError("no labelled vectors")
    n = place[0]["n"]
    mean = np.array([r["s"] for r in place]) / n
    free = sums.where(F.col("n") >= least).agg(F.sum(F.col("n") - 1).alias("free")).first()["free"] or 0
    d = len(mean)

    def rows(batches):
        total, within = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), float).reshape(-1, d) - mean
            total += x.T @ x
            x = x[np.asarray(batch.column("inside"))]
            within += x.T @ x
        yield _cells(total, within)

    def means(batches):
        within = np.zeros((d, d))
        for batch in batches:
            many = np.asarray(batch.column("n"), float)[:, None]
            s = np.asarray(batch.column("sums").flatten(), float).reshape(-1, d) - many * mean
            within -= (s / many).T @ s
        yield _cells(np.zeros((d, d)), within)

    big = sums.where(F.col("n") >= least)
    held = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    held = held.join(big.select("label", F.lit(True).alias("inside")), "label", "left").select("x", F.coalesce("inside", F.lit(False)).alias("inside"))
    cells = held.mapInArrow(rows, CELLS).unionByName(big.select("n", "sums").mapInArrow(means, CELLS))
    return cells.groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("within").alias("within")), mean, n, free


def fit_head(df: DataFrame, label: str, vector: str, scratch: Scratch, dims: int = 256, ridge: float = 1e-3, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): whitening by the principal axes of all vectors, then by what
    varies within labels of ``least`` rows or more."""
    cells, mean, n, free = scatter(df, label, vector, scratch, least)
    total, within = np.zeros((2, len(mean), len(mean)))
    for r in cells.collect():  # the square of the dimension
        total[r["i"], r["j"]], within[r["i"], r["j"]] = r["total"], r["within"]
    spread, axes = np.linalg.eigh(total)
    order = np.argsort(-spread)[:dims]
    order = order[spread[order] > 1e-12 * max(spread.max(), 1e-300)]
    first = axes[:, order] / np.sqrt(spread[order] / n)
    e, u = np.linalg.eigh(first.T @ within @ first / max(free, 1) + ridge * np.eye(len(order)))
    return mean, first @ (u / np.sqrt(e)) @ u.T
