"""Positions sampled by content, and the first pass over repeated windows.

A window is ``length`` consecutive tokens (bytes or words) of one document. Every
window chooses an anchor, a ``k``-gram inside it, by its content alone
(mod-minimizers: the position of the smallest ``t``-gram, modulo the number of
k-grams in the window), so equal windows choose the same one. Consecutive windows
with one anchor form a run. Where an anchor's k-gram occurs only once, no window
of its run is repeated: :func:`recurring` finds the others, which are what the
suffix and the De Bruijn operator go on with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.batches import Batch, Store, numbers, per_batch

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(m: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, m, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def _inverse(m: np.uint64) -> np.uint64:
    return np.uint64(pow(int(m), -1, 1 << 64))


class Hashes:
    """Hashes of any stretch of a token sequence, by prefix sums."""

    _table: dict = {}

    def __init__(self, x: np.ndarray, m: np.uint64):
        n = len(x)
        up, down = Hashes._table.get(int(m), (np.zeros(0), np.zeros(0)))
        if len(up) < n + 1:
            up, down = Hashes._table[int(m)] = _powers(m, n + 1), _powers(_inverse(m), n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], out=self.sum[1:])
        self.down = down

    def at(self, i: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sum[i + length] - self.sum[i]) * self.down[i] + np.uint64(length))

    def order(self, length: int) -> np.ndarray:
        """A cheap scrambled order of all stretches of one length."""
        n = len(self.sum) - length
        v = self.sum[length:] - self.sum[:n]
        v *= self.down[:n]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xFF51AFD7ED558CCD)
        return v


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        v = np.minimum(v[: len(v) - done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if done < width else v


@dataclass
class Runs:
    """Per run: first and last window start, anchor, document."""

    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


def find_runs(x: np.ndarray, ends: np.ndarray, length: int, k: int, h: Hashes) -> Runs:
    """``ends``: where each document's tokens end."""
    n, w = len(x), length - k + 1
    t = k % w
    if t < 3:
        t += w
    none = np.zeros(0, np.int64)
    if n < length:
        return Runs(none, none, none, none)
    bits = np.uint64(max(1, n.bit_length()))
    key = h.order(t)
    key >>= bits
    key <<= bits
    key |= np.arange(n - t + 1, dtype=np.uint64)
    least = sliding_min(key, length - t + 1)
    least &= (np.uint64(1) << bits) - np.uint64(1)
    start, anchor = np.arange(n - length + 1), least.view(np.int64)
    ahead = anchor - start
    anchor -= w * (ahead >= w) if length - t < 2 * w else ahead - ahead % w
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)[: len(start)]
    inside = np.repeat(ends - length, sizes)[: len(start)] >= start
    start, anchor, doc = start[inside], anchor[inside], doc[inside]
    if not len(start):
        return Runs(none, none, none, none)
    first = np.ones(len(start), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    last = np.concatenate((at[1:], [len(start)])) - 1
    return Runs(start[at], start[last], anchor[at], doc[at])


def word_bounds(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, document) of every word ``[^\\x20\\x09-\\x0D]+``."""
    b = np.frombuffer(data, np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    if not len(b):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.concatenate(([False], word[:-1]))
    cut = np.zeros(len(b) + 1, bool)
    cut[ends] = True  # a document's end is a word's end
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.concatenate((word[1:], [False]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(ends, start, side="right")


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray, block: int = 4 << 20) -> np.ndarray:
    """A hash per word, a block of bytes at a time."""
    b, out, i = np.frombuffer(data, np.uint8), np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        at = int(start[i])
        h = Hashes(_BYTE[b[at : int(end[j - 1])]], B)
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = mix((h.sum[e] - h.sum[s]) * h.down[s] + (e - s).astype(np.uint64) * A)
        i = j
    return out


def word_tokens(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and where each document's words end."""
    start, end, doc = word_bounds(data, ends)
    return word_hashes(data, start, end), np.searchsorted(doc, np.arange(len(ends)), side="right")


def byte_tokens(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[np.frombuffer(data, np.uint8)], ends


class Sampled:
    """The runs of a batch, those with a recurring anchor where that is known."""

    def __init__(self, batch: Batch, tokens, length: int, k: int):
        x, self.ends = tokens(batch.data, batch.ends)
        self.x, self.h = x, Hashes(x, A)
        self.runs = find_runs(x, self.ends, length, k, self.h)
        self.key = self.h.at(self.runs.anchor, k).view(np.int64)
        if "recurring" in batch.known:
            some = np.isin(self.key, batch.known["recurring"])
            r = self.runs
            self.runs, self.key = Runs(r.lo[some], r.hi[some], r.anchor[some], r.doc[some]), self.key[some]


def recurring(store: Store, tokens, length: int, k: int) -> DataFrame:
    """``(batch, recurring)``: the batch's anchor k-grams that occur more than once.
    A batch sends a k-gram once, however often it holds it."""

    def make():
        def f(batch: Batch):
            key, n = np.unique(Sampled(batch, tokens, length, k).key, return_counts=True)
            if len(key):
                yield key, numbers(batch.number, len(key)), n

        return f

    sent = store.map(make, "recurring long, batch long, n int")
    every = sent.withColumn("n", F.sum("n").over(Window.partitionBy("recurring"))).where("n > 1")
    return store.scratch.keep(per_batch(every.select("batch", "recurring"), "recurring"), "recurring")


def cut_words(overlap: int):
    """Pieces of about a limit of bytes at word bounds, ``overlap`` words in common."""

    def cut(text: bytes, limit: int):
        a, first, room = 0, 0, limit
        while a + room < len(text):
            start, end, _ = word_bounds(text[a : a + room], np.array([room]))
            n = len(end) - int(len(end) > 0 and end[-1] == room)  # the last word may go on
            if n <= overlap:
                room += limit
                continue
            yield a, a + int(end[n - 1]), first
            a, first, room = a + int(start[n - overlap]), first + n - overlap, limit
        yield a, len(text), first

    return cut


def cut_bytes(overlap: int):
    def cut(text: bytes, limit: int):
        step = max(limit, 2 * overlap) - overlap
        for a in range(0, max(1, len(text) - overlap), step):
            yield a, min(len(text), a + step + overlap), a

    return cut
