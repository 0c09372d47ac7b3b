"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a product of perfect covering codes over 61 of the
64 fingerprint bits: two binary Golay codes (23 bits, covering radius 3) and one
Hamming code (15 bits, covering radius 1). A fingerprint has one home anchor,
its nearest in every block. If two fingerprints differ in at most ``threshold``
bits, then the home anchor of one lies within covering radius plus
``threshold`` of the other, the excess over the radii being shared among the
blocks; so each fingerprint is replicated to all anchors within that reach
(about 150 of 2**35) and compared with those that live there.

Equal fingerprints are collapsed first, links are only made between different
ones, and each unordered pair meets exactly once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrowio import column, map_rows, utf8
from trackloom.operators.graph import connected_components
from trackloom.plans.runtime import Scratch, ship

SEED = 42
GOLAY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bit per position over the XXH64 of word shingles; 0 without words."""
    words = utf8(text).lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m, digest = n - width + 1, xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for i in range(0, m, 8192):
        part = h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > m).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


class _Block:
    """A perfect code on ``n`` bits at offset ``at``: for each syndrome the error
    patterns of each excess weight (0: the one to the home anchor)."""

    def __init__(self, at: int, n: int, radius: int, syndrome_of_bit: list[int], checks: int, reach: int):
        self.at, self.n = at, n
        half = 12
        self.low, self.high = np.zeros(1 << half, np.int32), np.zeros(1 << max(n - half, 0), np.int32)
        for i in range(n):
            t, k = (self.low, i) if i < half else (self.high, i - half)
            idx = np.arange(len(t))
            t[(idx >> k) & 1 == 1] ^= syndrome_of_bit[i]
        by: list[list[list[int]]] = [[[] for _ in range(1 << checks)] for _ in range(reach + 1)]
        for w in range(radius + reach + 1):
            for c in combinations(range(n), w):
                s = 0
                for i in c:
                    s ^= syndrome_of_bit[i]
                by[max(0, w - radius)][s].append(sum(1 << i for i in c))
        self.pattern, self.valid = [], []
        for lists in by:
            m = max(map(len, lists))
            p, v = np.zeros((len(lists), m), np.int64), np.zeros((len(lists), m), bool)
            for s, x in enumerate(lists):
                p[s, : len(x)], v[s, : len(x)] = x, True
            self.pattern.append(p)
            self.valid.append(v)

    def split(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = ((fp >> np.uint64(self.at)) & np.uint64((1 << self.n) - 1)).astype(np.int64)
        return x, self.low[x & 0xFFF] ^ self.high[x >> 12]


_blocks: dict[int, list[_Block]] = {}


def blocks(reach: int) -> list[_Block]:
    if reach not in _blocks:
        golay = []
        for i in range(23):
            x = 1 << i
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= GOLAY << (k - 11)
            golay.append(x)
        hamming = list(range(1, 16))
        _blocks[reach] = [_Block(0, 23, 3, golay, 11, reach), _Block(23, 23, 3, golay, 11, reach), _Block(46, 15, 1, hamming, 4, reach)]
    return _blocks[reach]


def anchors(fp: np.ndarray, reach: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within the radii plus ``reach`` of each row (0: home)."""
    a, b, c = blocks(threshold)
    (xa, sa), (xb, sb), (xc, sc) = (k.split(fp) for k in (a, b, c))
    rows, out = [], []
    for i in range(reach + 1):
        for j in range(reach + 1 - i):
            for k in range(reach + 1 - i - j):
                pa_, pb_, pc_ = a.pattern[i][sa], b.pattern[j][sb], c.pattern[k][sc]
                ok = a.valid[i][sa][:, :, None, None] & b.valid[j][sb][:, None, :, None] & c.valid[k][sc][:, None, None, :]
                v = ((xa[:, None] ^ pa_)[:, :, None, None]) | ((xb[:, None] ^ pb_)[:, None, :, None] << 23) | ((xc[:, None] ^ pc_)[:, None, None, :] << 46)
                r = np.broadcast_to(np.arange(len(fp))[:, None, None, None], ok.shape)
                rows.append(r[ok])
                out.append(v[ok])
    return np.concatenate(rows), np.concatenate(out)


def _spread(fps: DataFrame, reach: int, threshold: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), 2048):
                part = fp[i : i + 2048]
                row, anchor = anchors(part.view(np.uint64), reach, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(part[row], pa.int64())], names=["anchor", "fp"])

    ship(fps.sparkSession)
    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs ``(src, dst)`` of different fingerprints (column ``fp``, distinct
    longs) at ``threshold`` or fewer differing bits, each once."""
    home = _spread(fps, 0, threshold).select("anchor", F.col("fp").alias("src"))
    near = _spread(fps, threshold, threshold).select("anchor", F.col("fp").alias("dst"))
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= threshold
    return near.join(home.hint("shuffle_hash"), "anchor").where((F.col("src") < F.col("dst")) & close).select("src", "dst")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row: zero for a null, empty or blank text. Repeated rows and
    null ids stay, other columns are ignored."""

    def make():
        return lambda cols: [(d, signed_fingerprint(t, width)) for d, t in zip(*cols, strict=True)]

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", make)


def signed_fingerprint(text: str | None, width: int = 3) -> int:
    return _signed(fingerprint(text, width))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, threshold: int = 2, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null text counts as empty and gets the zero fingerprint, which links like
    any other. Rows with a null ``doc_id`` are returned with a fingerprint and a
    null component unless other documents share it. Repeated rows stay repeated;
    other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, width), "fps")
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    cc = connected_components(links(classes, threshold), scratch)
    label = classes.join(cc, classes.fp == cc.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = label.groupBy("c").agg(F.min("first").alias("component_id"))
    named = scratch.keep(label.join(least, "c").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, threshold: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns, unchanged) whose document is the smallest
    of its near-duplicate group. Rows with a null ``doc_id`` stay, and so do
    all rows of a kept id; an empty table gives no rows."""
    found = near_duplicates(docs, threshold, width)
    later = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*map(column, docs.columns))
