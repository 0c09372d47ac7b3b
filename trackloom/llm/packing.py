"""Packing token sequences by non-negative least squares.

Documents longer than a window give whole windows and one remainder. The
histogram of remainder lengths (one entry per length below the window, however
many documents) goes to the driver. All combinations of up to three lengths that
fill a window exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares, rounded down and clipped to what is
there. Remainders left over are laid end to end, longest first, and cut at
window ends; the last, unfilled window is cut into powers of two, which need no
padding. Which remainder takes which place is a matter of its rank among those
of its length, found with salted counts, so no length gathers in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.arrowio import map_rows
from trackloom.llm.tokens import encode_documents, unpack
from trackloom.plans.runtime import Scratch

#: Rows whose ranks one task counts.
RANKED = 200_000


def combinations_filling(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths (0: unused) of ``present`` that add up to ``window``."""
    have = np.zeros(window + 1, bool)
    have[present[(present > 0) & (present < window)]] = True
    out = []
    for a in np.flatnonzero(have):
        b = np.arange(a, (window - a) // 2 + 1)
        c = window - a - b
        ok = have[b] & have[c] & (c >= b) if len(b) else np.zeros(0, bool)
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
        if 2 * a <= window and have[window - a]:
            out.append(np.array([[a, window - a, 0]]))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_counts(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares ``min |A x - hist|`` by accelerated projected
    gradient; A holds how often each combination uses each length."""
    if not len(combos):
        return np.zeros(0)
    n = len(hist)
    target = hist.astype(np.float64).copy()
    target[0] = 0
    usage = np.bincount(combos.ravel(), minlength=n)
    step = 1.0 / max(1.0, 3.0 * usage[1:].max())
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        made = sum(np.bincount(combos[:, k], weights=y, minlength=n) for k in range(3))
        gap = made - target
        gap[0] = 0
        nxt = np.maximum(0, y - step * gap[combos].sum(axis=1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


class Plan:
    """Where the k-th remainder of each length goes."""

    def __init__(self, hist: np.ndarray, window: int):
        self.window = window
        combos = combinations_filling(window, np.flatnonzero(hist))
        fitted = fit_counts(combos, hist)
        left, used, seq = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64), 0
        slots: dict[int, list[tuple[int, int, int]]] = {}  # length: (first rank, first sequence, offset)
        for i in sorted(range(len(combos)), key=lambda i: (-fitted[i], *combos[i].tolist())):
            parts = [int(v) for v in combos[i] if v]
            times = int(min([int(fitted[i] + 1e-9), *[left[v] // parts.count(v) for v in parts]]))
            if times <= 0:
                continue
            at = 0
            for v in parts:
                slots.setdefault(v, []).append((int(used[v]), seq, at))
                used[v] += times
                left[v] -= times
                at += v
            seq += times
        self.slots = {v: np.array(s, np.int64) for v, s in slots.items()}
        self.used, self.filled = used, seq
        base, at = np.zeros(len(hist), np.int64), 0
        for v in range(len(hist) - 1, 0, -1):
            base[v] = at
            at += int(left[v]) * v
        self.base, self.total = base, at
        self.whole = at // window
        self.tail = []  # (first position, length, sequence)
        pos, seq = self.whole * window, self.filled + self.whole
        for bit in range(window.bit_length() - 1, -1, -1):
            if (at - self.whole * window) >> bit & 1:
                self.tail.append((pos, 1 << bit, seq))
                pos, seq = pos + (1 << bit), seq + 1
        self.sequences = seq

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the remainder, length, sequence, offset) of its pieces."""
        if rank < self.used[length]:
            s = self.slots[length]
            first, seq, at = s[np.searchsorted(s[:, 0], rank, side="right") - 1].tolist()
            return [(0, length, seq + rank - first, at)]
        pos, out, done = int(self.base[length]) + (rank - int(self.used[length])) * length, [], 0
        while done < length:
            p = pos + done
            if p < self.whole * self.window:
                seq, at, room = self.filled + p // self.window, p % self.window, self.window - p % self.window
            else:
                start, size, seq = next(x for x in reversed(self.tail) if x[0] <= p)
                at, room = p - start, start + size - p
            take = min(room, length - done)
            out.append((done, take, seq, at))
            done += take
        return out


def pack(tokens: DataFrame, scratch: Scratch, window: int = 1024) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of
    the documents in ``tokens (rid, doc_id, n, ids)``; ``rid`` is unique per row.

    Every id lies in exactly one piece; sequences are gapless. Rows with n = 0
    give no piece; an empty table gives no rows.
    """
    salts = max(16, -(-tokens.count() // RANKED))
    light = tokens.select("rid", "n").withColumns({"salt": F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"), "q": F.floor(F.col("n") / window).cast("long"), "rem": (F.col("n") % window).cast("int")})
    counts = scratch.keep(light.groupBy("rem", "salt").agg(F.count("*").alias("c"), F.sum("q").alias("qs")), "counts")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("rem").agg(F.sum("c").alias("c")).collect():  # at most one row per length
        hist[r["rem"]] = r["c"]
    hist[0] = 0
    plan = Plan(hist, window)
    start = counts.groupBy("salt").agg(F.sum("qs").alias("qs"))  # a row per salt
    ahead = F.coalesce(F.sum("qs").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = start.select("salt", (ahead + plan.sequences).alias("first"))

    before = Window.partitionBy("rem").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("rem", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead")).join(start, "salt")
    ranked = light.withColumns({
        "rank": F.row_number().over(Window.partitionBy("salt", "rem").orderBy("rid")) - 1,
        "whole": F.sum("q").over(Window.partitionBy("salt").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q"),
    })
    placed = ranked.join(offsets, ["rem", "salt"]).select("rid", "rem", (F.col("rank") + F.col("ahead")).alias("rank"), (F.col("first") + F.col("whole")).alias("whole"))
    placed = scratch.keep(placed, "placed")

    def make():
        def rows(cols):
            for doc, n, raw, rem, rank, whole in zip(*cols, strict=True):
                ids = unpack(raw, n)
                q = n // window
                for k in range(q):
                    yield doc, k * window, window, ids[k * window : (k + 1) * window].tobytes(), n, whole + k, 0
                if rem:
                    for start, length, seq, at in plan.places(rem, rank):
                        a = q * window + start
                        yield doc, a, length, ids[a : a + length].tobytes(), n, seq, at

        return rows

    both = tokens.join(placed.hint("shuffle_hash"), "rid").select("doc_id", "n", "ids", "rem", "rank", "whole")
    return map_rows(both, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", make)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """Tokenise whole ``docs`` (null text: empty) and pack them; columns as
    :func:`pack`. Repeated rows are packed as often as they occur, a null
    ``doc_id`` stays null."""
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = encode_documents(docs, tokenizer, end_id).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n", "ids")
    return pack(scratch.keep(tokens, "tokens"), scratch, window)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with their ids' crc32 in place of the ids."""

    def make():
        return lambda cols: [(d, s, n, zlib.crc32(i), t, q, o) for d, s, n, i, t, q, o in zip(*cols, strict=True)]

    cols = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return map_rows(pieces.select(*cols), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", make)
