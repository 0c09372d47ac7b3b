"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine c lie at squared distance 2 - 2c. After a fixed random
rotation the dimensions are split into blocks, each with a share of that distance
in proportion to its size; a pair within the whole distance is within its share in
at least one block. So each block is range-joined on its own: a grid on the
block's leading coordinates, with cells twice the block's radius wide, gives each
vector one home cell, and a copy goes to every lower cell its ball touches, so that
a pair meets in the lower of its two homes. Candidates are verified exactly by cosine in double precision, and a pair counts in the first
block where it is within its share, so the union over blocks holds it once.

Equal vectors are collapsed first. A cell with many vectors is cut into tiles of
bounded size. A tile gives link counts and a spanning forest of its links, never
the pairs themselves, so a large group of copies costs rows in proportion to it.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrowio import sliced
from trackloom.operators.graph import connected_components, join_roots
from trackloom.plans.runtime import Scratch, ship

BLOCKS, CELL_DIMS, TILE, STRIP, SPAN = 4, 3, 32_768, 128, 4096
SLACK = 1e-6
LEFT, HOME, VISITOR = 0, 1, 2


class Rotation:
    """Blocks, budgets and cells for vectors of ``dim`` dimensions."""

    def __init__(self, dim: int, cosine: float, blocks: int = BLOCKS):
        self.dim, self.cosine = dim, cosine
        q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
        self.matrix = q * np.sign(np.diag(r))
        edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.budget = [(2 - 2 * cosine) * (b - a) / dim for a, b in self.blocks]

    def rotate(self, v: np.ndarray) -> np.ndarray:
        v = scaled(v)
        return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ self.matrix

    def cells(self, z: np.ndarray, b: int):
        """(row, cell, is home) for block ``b`` of rotated vectors ``z``: the home
        cell, and lower cells in reach."""
        lo, hi = self.blocks[b]
        dims = min(CELL_DIMS, hi - lo)
        r = np.sqrt(self.budget[b]) * (1 + SLACK) + 1e-9
        x = z[:, lo : lo + dims] / (2 * r)
        home = np.floor(x).astype(np.int64)
        for step in product((-1, 0, 1), repeat=dims):
            if step > (0,) * dims:
                continue
            c = home + np.array(step)
            gap = np.maximum(np.maximum(c - x, x - c - 1), 0)
            near = np.flatnonzero((gap * gap).sum(axis=1) <= 0.25 * (1 + SLACK))
            code = np.zeros(len(near), np.int64)
            for k in range(dims):
                code = code * (1 << 20) + (c[near, k] + (1 << 19))
            yield near, code, not any(step)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows in doubles, by the power of two (so exactly) that brings the largest
    component near 1: squares stay in range."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _decode(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of an array column, by dimension."""
    size = np.array(pa.compute.list_value_length(column))
    flat = np.asarray(column.flatten())
    end = np.cumsum(size)
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[int(d)] = rows, flat[(end[rows] - d)[:, None] + np.arange(d)]
    return out


def _place(classes: DataFrame, cosine: float, tiles: dict | None) -> DataFrame:
    """Without ``tiles``: how many vectors of each role each cell gets. With them:
    the vectors dealt to the tiles of their cells."""

    def run(batches):
        for batch in sliced(batches, 4096):
            ids, mult, emb = batch.column("id").to_numpy(), batch.column("mult").to_numpy(), batch.column("embedding")
            for dim, (rows, v) in _decode(emb).items():
                rot = Rotation(dim, cosine)
                z = rot.rotate(v)
                counts: dict = {}
                for b in range(len(rot.blocks)):
                    for near, code, home in rot.cells(z, b):
                        for c in np.unique(code):
                            at = near[code == c]
                            key = f"{dim}:{b}:{c}"
                            if tiles is None:
                                n = counts.setdefault(key, [0, 0])
                                n[0] += len(at) * home
                                n[1] += len(at)
                                continue
                            nh, nr = tiles[key]
                            if not nh:
                                continue
                            pick = (ids[rows[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                            # a home is left once per right part and, like a visitor, right once per left part
                            roles = [(LEFT, nh, nr), (HOME, nr, nh)] if home else [(VISITOR, nr, nh)]
                            for role, n_own, n_other in roles:
                                own = pick % np.uint64(n_own)
                                for other, mine in product(range(n_other), range(n_own)):
                                    sel = at[own == mine]
                                    if len(sel):
                                        i, j = (mine, other) if role == LEFT else (other, mine)
                                        yield pa.RecordBatch.from_arrays([pa.array([f"{key}:{i}:{j}"] * len(sel)), pa.array([role] * len(sel), pa.int32()), pa.array(ids[rows[sel]]), pa.array(mult[rows[sel]]), emb.take(pa.array(rows[sel]))], names=["tile", "role", "id", "mult", "embedding"])
                if counts:
                    yield pa.RecordBatch.from_pylist([{"cell": k, "homes": h, "all": a} for k, (h, a) in counts.items()], schema=pa.schema([("cell", pa.string()), ("homes", pa.int64()), ("all", pa.int64())]))

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInArrow(run, "cell string, homes long, all long" if tiles is None else f"tile string, role int, id long, mult long, embedding {kind}")


def _compare(cosine: float):
    """Links of one tile: per vector its count and its root."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, b = (int(x) for x in table["tile"][0].as_py().split(":")[:2])
        role, ids, mult = table["role"].to_numpy(), table["id"].to_numpy(), table["mult"].to_numpy()
        emb = table["embedding"].combine_chunks()
        v = np.asarray(emb.flatten()).reshape(-1, dim)
        rot = Rotation(dim, cosine)
        z = rot.rotate(v)
        v = scaled(v)
        norm = np.sqrt((v * v).sum(axis=1))
        lo, hi = rot.blocks[b]
        x = z[:, lo:hi].astype(np.float32)
        sq = (x * x).sum(axis=1, keepdims=True)
        one = np.ones_like(sq)
        by_id = np.argsort(ids, kind="stable")
        left = by_id[role[by_id] == LEFT]
        own, visitors = by_id[role[by_id] == HOME], np.flatnonzero(role == VISITOR)
        right = np.concatenate((own, visitors))
        every, number = np.unique(ids, return_inverse=True)
        root, count = np.arange(len(every)), np.zeros(len(every), np.int64)
        # one product gives |a|^2 + |b|^2 - 2ab
        a_side, b_side = np.hstack((-2 * x, sq, one))[left], np.ascontiguousarray(np.hstack((x, one, sq))[right].T)
        limit = np.float32(rot.budget[b] + 1e-5)
        for s in range(0, len(left), STRIP):
            strip = left[s : s + STRIP]
            first = int(np.searchsorted(ids[own], ids[strip[0]], side="right"))  # homes below meet it as left ones
            for u in range(first, len(right), SPAN):
                p, q = np.nonzero(a_side[s : s + STRIP] @ b_side[:, u : u + SPAN] <= limit)
                for t in range(0, len(p), 32_768):
                    i, j = strip[p[t : t + 32_768]], right[u + q[t : t + 32_768]]
                    once = (ids[i] < ids[j]) | (role[j] == VISITOR)
                    i, j = i[once], j[once]
                    keep = np.ones(len(i), bool)
                    for k in range(b + 1):
                        near = _squared(z[i], z[j], *rot.blocks[k]) <= rot.budget[k] * (1 + SLACK)
                        keep &= near if k == b else ~near
                    i, j = i[keep], j[keep]
                    link = (v[i] * v[j]).sum(axis=1) / (norm[i] * norm[j]) >= cosine
                    i, j = i[link], j[link]
                    for here, there in ((i, j), (j, i)):
                        count += np.bincount(number[here], weights=mult[there], minlength=len(every)).astype(np.int64)
                    join_roots(root, number[i], number[j])
        said = np.flatnonzero((count > 0) | (root != np.arange(len(every))))
        return pa.Table.from_arrays([pa.array(every[said], pa.int64()), pa.array(count[said], pa.int64()), pa.array(every[root[said]], pa.int64())], schema=schema)

    return run


def _squared(a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Squared distance over columns lo to hi, added in a fixed order."""
    out = np.zeros(len(a))
    for k in range(lo, hi):
        d = a[:, k] - b[:, k]
        out += d * d
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do rows without ``vec_id`` (their component stays null and
    they are kept). Repeated rows count as vectors of their own, also where one
    ``vec_id`` comes with different vectors: each row has its own links, and one id may
    show several components. Components of any finite size count. Vectors of
    different length don't link. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0)
    base = vectors.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.col("embedding")).alias("embedding"))
    classes = base.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    # a number of its own per class: several may share their smallest vec_id
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("id"), "least", "mult", "embedding"), "classes")

    cells = _place(classes, cosine, None).groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("all").alias("all"))
    # A row per grid cell: coordinates of unit vectors span few cells of fixed width.
    tiles = {r["cell"]: (-(-r["homes"] // TILE), max(1, -(-r["all"] // TILE))) for r in cells.collect()}
    found = _place(classes, cosine, tiles).groupBy("tile").applyInArrow(_compare(cosine), "id long, n long, root long")
    found = scratch.keep(found, "found")
    cc = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), scratch)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    label = classes.join(cc, "id", "left").join(counts, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = label.groupBy("c").agg(F.min("least").alias("component_id"))
    named = label.join(least, "c").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.col("component_id").alias("c"))
    out = base.join(named, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
