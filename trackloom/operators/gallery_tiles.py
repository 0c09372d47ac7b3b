"""Exact votes of the nearest prototypes by all pairs, in tiles.

For galleries whose bounds rule out little: queries fall into blocks by hash, prototypes
into blocks in order of their labels, and each two blocks are a tile. A task holds the
queries of one tile and, for each of them, the best similarities of one label; the
prototypes are sorted by label and streamed past. A label that lies inside a tile is
scored there and only a query's two best are given back; the first and the last label of
a tile may go on in another, so their similarities are. No pair is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackloom.plans.runtime import Scratch

#: Queries or prototypes of a block, bytes of a block of queries, and the least worth a tile.
BLOCK, BLOCK_BYTES, LEAST = 32_768, 16_000_000, 2048
#: Prototypes, and queries, whose similarities are there at a time; rows of them under one maximum.
ROWS, COLUMNS, UNDER = 512, 2048, 16


def unit_rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of unit vectors; zero vectors stay."""
    v = np.asarray(column.flatten(), float).reshape(len(column), -1)
    n = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, n, out=v.copy(), where=n > 0)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as in SQL."""
    y = x * 10.0**digits
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**digits


def raise_best(best: np.ndarray, sim: np.ndarray) -> None:
    """``best`` (k, query), falling, takes in ``sim`` (prototype, query). Only the rows
    under the k largest maxima of ``UNDER`` rows each can hold one of the k largest."""
    k, queries = best.shape
    m = len(sim) // UNDER * UNDER
    tops = sim[:m].reshape(-1, UNDER, queries).max(axis=1) if len(sim) > 2 * k * UNDER else None
    most = sim.max(axis=0) if tops is None else tops.max(axis=0)
    if tops is not None and m < len(sim):
        most = np.maximum(most, sim[m:].max(axis=0))
    at = np.flatnonzero(most > best[-1])
    if not len(at):
        return
    found = sim[:, at] if len(at) < queries else sim
    if tops is not None:
        pick = np.argpartition(-tops[:, at], k - 1, axis=0)[:k]
        rows = (pick[:, None, :] * UNDER + np.arange(UNDER)[:, None]).reshape(-1, len(at))
        found = np.concatenate((sim[rows, at], sim[m:, at]))
    both = -np.concatenate((best[:, at], found))
    best[:, at] = -np.sort(np.partition(both, k - 1, axis=0)[:k], axis=0)


class _Tile:
    """The queries of a tile, and what they have found so far."""

    def __init__(self, top: int, digits: int, kinds: tuple[pa.DataType, pa.DataType]):
        self.top, self.digits, self.kinds = top, digits, kinds
        self.qids, self.parts, self.labels = [], [], []
        self.q = self.best = None
        self.seen = 0

    def ask(self, qids: pa.Array, v: np.ndarray) -> None:
        self.qids.append(qids)
        self.parts.append(v)

    def meet(self, label, p: np.ndarray):
        if self.q is None:
            if not self.parts:
                return
            self.q, self.qids = np.concatenate(self.parts), pa.concat_arrays(self.qids).cast(self.kinds[0])
            self.parts = []
            n = len(self.q)
            self.score, self.which = np.full((2, n), -np.inf), np.zeros((2, n), np.int64)
        if not self.labels or label != self.labels[-1]:
            yield from self._close(last=False)
            self.labels.append(label)
            self.best, self.seen = np.full((self.top, len(self.q)), -np.inf), 0
        self.seen += len(p)
        for i in range(0, len(p), ROWS):
            for j in range(0, len(self.q), COLUMNS):
                raise_best(self.best[:, j : j + COLUMNS], p[i : i + ROWS] @ self.q[j : j + COLUMNS].T)

    def _close(self, last: bool):
        if not self.labels:
            return
        held = rounded(self.best[: min(self.top, self.seen)], self.digits)
        n = len(self.q)
        if last or len(self.labels) == 1:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, len(held)), pa.int32()), pa.array(held.T.ravel()))
            yield pa.RecordBatch.from_arrays([self.qids, pa.array(self.labels[-1:], self.kinds[1]).take(pa.array(np.zeros(n, np.int64))), flat, pa.nulls(n, pa.float64())], names=["qid", "label", "sims", "score"])
            return
        score = np.zeros(n)
        for row in held:
            score += row
        score = rounded(score / len(held), self.digits)
        first = score > self.score[0]
        second = ~first & (score > self.score[1])
        self.score[1], self.which[1] = np.where(first, self.score[0], np.where(second, score, self.score[1])), np.where(first, self.which[0], np.where(second, len(self.labels) - 1, self.which[1]))
        self.score[0], self.which[0] = np.where(first, score, self.score[0]), np.where(first, len(self.labels) - 1, self.which[0])

    def end(self):
        yield from self._close(last=True)
        names = pa.array(self.labels, self.kinds[1])
        for k in range(2 if self.labels else 0):
            have = np.flatnonzero(self.score[k] > -np.inf)
            if len(have):
                at = pa.array(have)
                yield pa.RecordBatch.from_arrays([self.qids.take(at), names.take(pa.array(self.which[k][have])), pa.nulls(len(have), pa.list_(pa.float64())), pa.array(self.score[k][have])], names=["qid", "label", "sims", "score"])


def _blocks(n: int, rows: int, cores: int) -> int:
    return max(1, math.ceil(n / rows), min(math.ceil(math.sqrt(4 * cores)), math.ceil(n / LEAST)))


def scores(queries: DataFrame, prototypes: DataFrame, counts: DataFrame, sizes: tuple[int, int], dim: int, scratch: Scratch, top: int = 3, digits: int = 9) -> DataFrame:
    """``(qid, label, score)``: each query's two best labels at least, with the mean of
    its ``top`` best similarities, from ``queries (qid, v)`` and ``prototypes (label, v)``,
    all unit vectors, the latter a written table. ``counts (label, n)``; ``sizes``: how many there are."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    rows = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))
    across, down = _blocks(sizes[0], rows, cores), _blocks(sizes[1], BLOCK, cores)
    per = math.ceil(max(1, sizes[1]) / down)
    kinds = tuple(to_arrow_type(d.schema[c].dataType) for d, c in ((queries, "qid"), (prototypes, "label")))
    names = tuple(d.schema[c].dataType.simpleString() for d, c in ((queries, "qid"), (prototypes, "label")))

    # a label's rows take the places behind those of lesser labels, in any order
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = prototypes.join(F.broadcast(starts.withColumnRenamed("label", "_l")), F.col("label").eqNullSafe(F.col("_l")))
    place = F.col("start") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), "n")
    asked = queries.select(F.pmod(F.xxhash64("qid"), F.lit(across)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("j"), "qid", F.lit(None).cast(names[1]).alias("label"), "v", F.lit(False).alias("shown"))
    shown = placed.select(F.floor(place / per).cast("int").alias("j"), F.lit(None).cast(names[0]).alias("qid"), "label", "v", F.lit(True).alias("shown")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    both = asked.unionByName(shown).withColumn("tile", (F.col("i") * down + F.col("j")).cast("int")).drop("i", "j")
    dealt = both.repartitionById(across * down, "tile").sortWithinPartitions("tile", "shown", "label")

    def run(batches):
        tile, at = None, -1
        for batch in batches:
            tiles, shown = batch.column("tile").to_numpy(), batch.column("shown").to_numpy(zero_copy_only=False)
            code = batch.column("label").dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(shown.astype(int)) != 0) | (np.diff(code) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)], strict=True):
                if a == b:
                    continue
                if tile is None or tiles[a] != at:
                    if tile is not None:
                        yield from tile.end()
                    tile, at = _Tile(top, digits, kinds), tiles[a]
                v = np.asarray(batch.column("v").slice(a, b - a).flatten(), float).reshape(b - a, -1)
                if shown[a]:
                    yield from tile.meet(batch.column("label")[a].as_py(), v)
                else:
                    tile.ask(batch.column("qid").slice(a, b - a), v)
        if tile is not None:
            yield from tile.end()

    found = scratch.keep(dealt.mapInArrow(run, f"qid {names[0]}, label {names[1]}, sims array<double>, score double"), "tiles")
    sims = found.where("sims is not null").groupBy("qid", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("sims")), asc=False), 1, top).alias("sims"))
    open_ = sims.select("qid", "label", F.round(F.aggregate("sims", F.lit(0.0), lambda a, x: a + x) / F.size("sims"), digits).alias("score"))
    return open_.unionByName(found.where("sims is null").select("qid", "label", "score"))
