"""Product codes of vectors, their entries found by VA-file filtering.

Vectors of whole numbers are cut into parts, each with a codebook of 16 entries that
some rounds of k-means refine. The codebooks are a thousand numbers and go to every
task; a task gives back one sum per entry and coordinate, which Spark adds up.

A part finds its nearest entry as in a VA-file: each coordinate of the entries is
quantised to two bits, so an entry is a row of cells. For a query, a table per
coordinate holds the least and the largest squared distance to each cell; adding up an
entry's cells bounds its distance from both sides. Entries whose lower bound exceeds
the least upper bound are out; the others, few, are compared in whole numbers. Bounds
and distances are integers, so ties stay ties and go to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.arrowio import sliced
from trackloom.plans.runtime import Scratch, ship

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 8, 16, 6, 4096, 2
#: Components beyond this are computed with Python's whole numbers: 2**26 keeps the
#: squared distance of 128 coordinates within 64 bits.
WIDE = 1 << 26
MOST = (1 << 63) - 1
ROWS = 2048


def whole_numbers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: longs, or Python integers where some are wide."""
    x = np.floor(v.astype(np.float64) * scale)  # a power of two only moves the exponent
    if not x.size or np.abs(x).max() < WIDE:
        return x.astype(np.int64)
    return np.array([int(a) if np.isfinite(a) else (lambda n, d: n * scale // d)(*float(b).as_integer_ratio()) for a, b in zip(x.flat, v.flat, strict=True)], object).reshape(v.shape)


def bounds_of_parts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    edge = [i * dim // parts for i in range(parts + 1)]
    return list(zip(edge[:-1], edge[1:], strict=True))


class Cells:
    """The cells of a codebook ``(entries, coordinates)``: per coordinate the marks
    between cells (its entries' quantiles) and each entry's cell."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, n = entries, len(entries)
        ranked = np.sort(entries, axis=0)
        lows = [-(-n * c // (1 << bits)) for c in range(1 << bits)]
        # a cell reaches from its least to its largest entry
        self.start = np.stack([ranked[min(a, n - 1)] for a in lows])
        self.cell = (entries[:, None, :] >= self.start[None]).sum(axis=1) - 1
        self.least = np.stack([self._edge(c, np.min) for c in range(1 << bits)])
        self.most = np.stack([self._edge(c, np.max) for c in range(1 << bits)])

    def _edge(self, c: int, pick) -> np.ndarray:
        """The outermost entry of cell ``c`` per coordinate (its mark where it is empty)."""
        out = self.start[c].copy()
        for j in range(out.shape[0]):
            inside = self.entries[self.cell[:, j] == c, j]
            if len(inside):
                out[j] = pick(inside)
        return out

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every row of ``q``."""
        kind = object if q.dtype == object or self.entries.dtype == object else np.int64
        if not q.shape[1]:
            return np.zeros(len(q), np.int64), np.zeros(len(q), kind)
        low = np.zeros((len(q), len(self.entries)), kind)
        high = low.copy()
        for j in range(q.shape[1]):
            x = q[:, j : j + 1]
            under, over = self.least[None, :, j] - x, x - self.most[None, :, j]
            gap = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(np.abs(under), np.abs(over))
            low += (gap * gap)[:, self.cell[:, j]]
            high += (far * far)[:, self.cell[:, j]]
        row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))
        apart = q[row] - self.entries[entry]
        exact = (apart * apart).sum(axis=1)
        head = np.flatnonzero(np.diff(row, prepend=-1))
        error = np.minimum.reduceat(exact, head)
        place = np.where(exact == error[row], entry, len(self.entries))
        return np.minimum.reduceat(place, head), error


def _matrices(batch: pa.RecordBatch):
    """(rows, matrix) of an array column, by dimension."""
    column = batch.column("embedding")
    size = np.array(pc.list_value_length(column), np.int64)
    flat, end = np.asarray(column.flatten()), np.cumsum(size)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[(end[rows] - d)[:, None] + np.arange(d)]


def usable() -> Column:
    kept = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(kept, F.lit(False))


def _first(vectors: DataFrame, entries: int) -> dict[int, list]:
    """By dimension the vectors of the smallest ids: a task sends its own smallest, a
    window with a limit keeps the rest of them small."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches):
        best: dict[int, dict] = {}
        for batch in sliced(batches, ROWS):
            ids = batch.column("vec_id").to_pylist()
            size = np.array(pc.list_value_length(batch.column("embedding")), np.int64)
            for d in np.unique(size):
                mine = best.setdefault(int(d), {})
                for i in np.flatnonzero(size == d).tolist():
                    key = (ids[i] is None, ids[i] or 0)
                    if len(mine) < entries or key in mine or key < max(mine):
                        v = batch.column("embedding")[i].as_py()
                        mine[key] = min(v, mine[key]) if key in mine else v
                        if len(mine) > entries:
                            del mine[max(mine)]
        for d, mine in best.items():
            for (missing, i), v in mine.items():
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([missing]), pa.array([i], pa.int64()), pa.array([v], batch.schema.field("embedding").type)], names=["dim", "missing", "id", "embedding"])

    sent = vectors.select("vec_id", "embedding").mapInArrow(run, f"dim int, missing boolean, id long, embedding {kind}")
    sent = sent.groupBy("dim", "missing", "id").agg(F.min("embedding").alias("embedding"))
    sent = sent.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("missing", "id"))).where(F.col("place") <= entries)
    out: dict[int, list] = {}
    for r in sent.orderBy("dim", "place").collect():  # 16 rows a dimension
        out.setdefault(r["dim"], []).append(r["embedding"])
    return out


def _codebooks(dim: int, rows: list, scale: int, parts: int) -> list[np.ndarray]:
    v = whole_numbers(np.array(rows, np.float64).reshape(len(rows), dim), scale)
    return [v[:, a:b] for a, b in bounds_of_parts(dim, parts)]


def _sums(vectors: DataFrame, books: dict[int, list[np.ndarray]], scale: int) -> DataFrame:
    """``(dim, part, entry, j, total, n)``: of all vectors nearest to an entry."""

    def run(batches):
        cells = {d: [Cells(b) for b in bs] for d, bs in books.items()}
        total = {(d, p): np.zeros(b.shape, object) for d, bs in books.items() for p, b in enumerate(bs)}
        count = {(d, p): np.zeros(len(b), np.int64) for d, bs in books.items() for p, b in enumerate(bs)}
        for batch in sliced(batches, ROWS):
            for d, _, v in _matrices(batch):
                x = whole_numbers(v, scale)
                for p, c in enumerate(cells[d]):
                    a, b = bounds_of_parts(d, len(cells[d]))[p]
                    near, _ = c.nearest(x[:, a:b])
                    hit = np.zeros((len(near), len(c.entries)), x.dtype)
                    hit[np.arange(len(near)), near] = 1
                    total[d, p] += (hit.T @ x[:, a:b]).astype(object)  # whole numbers of Python
                    count[d, p] += np.bincount(near, minlength=len(c.entries))
        for (d, p), t in total.items():
            e, j = np.nonzero((count[d, p] > 0)[:, None] & np.ones(t.shape, bool))
            if len(e):
                said = pa.array([str(int(t[a, b])) for a, b in zip(e, j, strict=True)])
                cols = [pa.array(np.full(len(e), k, np.int32)) for k in (d, p)] + [pa.array(e.astype(np.int32)), pa.array(j.astype(np.int32)), said, pa.array(count[d, p][e])]
                yield pa.RecordBatch.from_arrays(cols, names=["dim", "part", "entry", "j", "total", "n"])

    sent = vectors.select("embedding").mapInArrow(run, "dim int, part int, entry int, j int, total string, n long")
    return sent.groupBy("dim", "part", "entry", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, parts: int = PARTS) -> dict[int, list[np.ndarray]]:
    """Codebooks by dimension, from all of ``vectors`` (usable ones).

    A round is one pass; its sums, one per entry and coordinate, come to the driver.
    """
    books = {d: _codebooks(d, rows, scale, parts) for d, rows in _first(vectors, entries).items()}
    for _ in range(rounds):
        fresh = {d: [b.copy() for b in bs] for d, bs in books.items()}
        for r in _sums(vectors, books, scale).collect():
            value, book = int(r["total"]) // r["n"], fresh[r["dim"]][r["part"]]
            if abs(value) >= WIDE and book.dtype != object:
                book = fresh[r["dim"]][r["part"]] = book.astype(object)
            book[r["entry"], r["j"]] = value
        books = fresh
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()


def encode(vectors: DataFrame, books: dict[int, list[np.ndarray]], scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, code, error, codebooks_sha256)`` per usable vector."""
    digest = {d: books_digest(bs) for d, bs in books.items()}

    def run(batches):
        cells = {d: [Cells(b) for b in bs] for d, bs in books.items()}
        for batch in sliced(batches, ROWS):
            for d, rows, v in _matrices(batch):
                x, places, error = whole_numbers(v, scale), [], 0
                for c, (a, b) in zip(cells[d], bounds_of_parts(d, len(cells[d])), strict=True):
                    near, apart = c.nearest(x[:, a:b])
                    places.append(near)
                    error = error + apart
                raw = np.stack(places, axis=1).astype(np.uint8)
                at = pa.array(rows)
                cols = [pa.array([r.tobytes().hex() for r in raw]), pa.array([min(int(e), MOST) for e in error], pa.int64()), pa.array([digest[d]] * len(rows))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), *cols], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per usable vector.

    Vectors that are null or hold null or non-finite components are dropped. Vectors of
    different length have codebooks of their own (few lengths are expected); a length
    that 8 doesn't divide is cut at ``i * length // 8``, so some parts may be empty, and
    an empty part is at distance 0 from entry 0. Repeated rows count each time in means
    and errors. A repeated ``vec_id`` starts one entry, with its least vector; a null id
    counts as largest. Fewer ids than 16 give fewer entries. Means and distances of any
    size are exact while sums stay below 1e38; errors beyond a long are its largest value.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.where(usable()).select(F.col("vec_id").cast("long"), "label", "embedding")
    scratch = Scratch(spark, "codes")
    coded = scratch.keep(encode(base, fit(base)), "coded")
    per = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(MOST)).cast("long").alias("label_error"))
    # written, so that the planner knows its size: broadcast under Spark's threshold, else sorted and split where skewed
    c, p = coded.alias("c"), scratch.keep(per, "labels").alias("p")
    return c.join(p, F.col("c.label").eqNullSafe(F.col("p.label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
