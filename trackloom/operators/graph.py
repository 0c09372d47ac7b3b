"""Graph operators on edge tables (components, absorb chains)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.runtime import Scratch, ship


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected edge table ``(src, dst)`` of longs.

    Returns ``(id, component)`` for every vertex that occurs on an edge between
    different vertices; ``component`` is the smallest id reachable. Self loops,
    nulls and repeated edges are ignored; an empty table gives an empty result.

    Each round first joins what meets within one scan partition (bounded by the
    split size), then takes a large-star and a small-star step: minima per vertex
    (combined map-side, so a hub costs one row per task) and equi-joins that AQE may
    split; a table of minima grows with the vertices and is never broadcast. Each round
    is written to the shared folder.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = scratch.keep(e.where("u != v").distinct(), f"{name}-0")
    size = _mark(e)
    if size[0] == 0:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for k in range(1, max_rounds + 1):
        e = _contract(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u != v").distinct(), f"{name}-{k}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        nxt = scratch.keep(small.select("x.u", "x.v").where("u != v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k}-large")
        scratch.drop(f"{name}-{k - 1}")
        now = _mark(nxt)
        e = nxt
        if now == size:
            roots = e.select(F.col("v").alias("u"), "v").distinct()
            return e.unionByName(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))
        size = now
    raise RuntimeError("components did not settle")


def join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the pairs (u, v) in ``root``, the smallest known partner of each item."""
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root[:] = nxt


def _contract(e: DataFrame) -> DataFrame:
    """Edges of each partition as stars around its components' smallest vertices."""
    ship(e.sparkSession)

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
            root = np.arange(len(ids))
            join_roots(root, at[: len(u)], at[len(u) :])
            low = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[low], pa.int64()), pa.array(ids[root[low]], pa.int64())], names=["u", "v"])

    return e.select("u", "v").mapInArrow(run, "u long, v long")


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 32)).alias("s")).first()
    return r["n"], r["x"], r["s"]


def grid_components(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """8-connected components of cells ``(cell, gx, gy)``: ``(cell, component)``."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) > (0, 0)]))
    near = cells.select(F.col("cell").alias("src"), "gx", "gy", step.alias("s")).select("src", (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"))
    edges = near.join(cells.select(F.col("cell").alias("dst"), "gx", "gy"), ["gx", "gy"]).select("src", "dst")
    cc = connected_components(edges, scratch, "cells")
    return cells.join(cc.withColumnRenamed("id", "cell"), "cell", "left").select("cell", F.coalesce("component", "cell").alias("component"))


def collapse_chains(absorbed: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """``(src, dst)`` absorb steps to ``(src, root)`` by pointer jumping."""
    d = scratch.keep(absorbed.select("src", F.col("dst").alias("root")), "chain-0")
    for k in range(1, max_rounds + 1):
        hop = d.select(F.col("src").alias("root"), F.col("root").alias("_next"))
        nxt = scratch.keep(d.join(hop.hint("merge"), "root", "left").select("src", F.coalesce("_next", "root").alias("root")), f"chain-{k}")
        moved = nxt.join(d.withColumnRenamed("root", "_old").hint("merge"), "src").where("root != _old").limit(1).count()
        scratch.drop(f"chain-{k - 1}")
        d = nxt
        if not moved:
            return d
    raise RuntimeError("absorb chains did not settle")
