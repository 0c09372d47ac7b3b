"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text: each step shifts it by one bit and adds a
number for the byte, so sixteen bits know the last sixteen bytes and nothing else. A
chunk ends where the hash is small, and how small is normalised: below the normal size
a place must pass a strict test, above it a loose one, so sizes keep close to the
normal one. Where chunks end depends on near bytes alone; an insertion shifts the
chunks behind it without changing them.

The fingerprint is the set of a text's chunks, each a 42-bit digest and its length in
6 bits, in order of number, base64. The likeness of one fingerprint to another is the
share of its length whose chunks the other holds too (containment): 1 for equal texts,
0 where nothing is shared. Longer chunks count more.

Documents follow each other by falling id. Bounds between ranges of ids come from a
pass over ids alone; texts are then shuffled once, to the range of their id, and the
head of each range also to the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrowio import sliced, utf8
from trackloom.plans.runtime import ship

#: Chunk sizes in bytes, and the shares of places that pass the tests below and above
#: the normal size, in bits.
LEAST, NORMAL, MOST, STRICT, LOOSE = 8, 24, 64, 5, 4
BLOCK = 1 << 20
WINDOW = 16
GEAR = np.random.default_rng(13).integers(0, 1 << 16, 256, dtype=np.uint16)
PLACED, COPY, ALONE = 0, 1, 2


def _gear(x: np.ndarray) -> np.ndarray:
    """The gear hash behind every byte, by doubling the bytes it knows."""
    h, n = GEAR[x], 1
    while n < WINDOW:
        more = h.copy()
        more[n:] += h[:-n] << np.uint16(n)
        h, n = more, 2 * n
    return h


def chunk_ends(data: bytes, start: int = 0) -> list[int]:
    """Where the chunks of a text end, from an end ``start`` on, a block at a time."""
    out: list[int] = []
    while start < len(data):
        # the block, and the bytes before it that its first hashes know
        back = min(start, WINDOW)
        h = _gear(np.frombuffer(data, np.uint8, min(len(data), start + BLOCK) - start + back, start - back))[back:]
        n = len(h)
        far = np.int32(n + MOST)
        ends, pad = np.arange(1, n + 1, dtype=np.int32), np.full(MOST, far, np.int32)

        def next_end(bits: int, h=h, ends=ends, pad=pad, far=far) -> memoryview:
            """The first end at or behind each place that passes a test."""
            passed = np.where(h < 1 << (16 - bits), ends, far)
            return memoryview(np.concatenate((np.minimum.accumulate(passed[::-1])[::-1], pad)))

        strict, loose = next_end(STRICT), next_end(LOOSE)
        at, stop = 0, n if start + n == len(data) else n - MOST
        while at < stop:
            end = strict[at + LEAST - 1]
            if end >= at + NORMAL:
                end = min(loose[at + NORMAL - 1], at + MOST, n)
            at = end
            out.append(start + at)
        start += at
    return out


@dataclass
class Chunks:
    """A text's chunks in order: where they end, and digest times 64 plus length less one."""

    ends: list[int]
    codes: list[int]

    def set(self) -> set[int]:
        return set(self.codes)


def chunked(data: bytes, known: Chunks | None = None, same: int = 0) -> Chunks:
    """``known``: the chunks of a text that has the first ``same`` bytes in common: an
    end depends on no byte behind it, so these chunks are the same."""
    n = bisect_right(known.ends, same) if known else 0
    if n and known.ends[n - 1] == known.ends[-1] and known.ends[-1] != len(data):
        n -= 1  # a text's last chunk may have ended for want of bytes
    a = known.ends[n - 1] if n else 0
    ends = chunk_ends(data, a)
    codes, digest = [], xxhash.xxh3_64_intdigest
    for b in ends:
        codes.append((digest(data[a:b]) >> 22) << 6 | (b - a - 1))
        a = b
    return Chunks(known.ends[:n] + ends, known.codes[:n] + codes) if n else Chunks(ends, codes)


def written(parts: set[int]) -> str:
    raw = np.array(sorted(parts), ">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def read(fingerprint: str) -> set[int]:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return set(np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").tolist())


def contained(a: set[int], b: set[int]) -> float:
    """The share of ``a``'s length that ``b`` holds; two empty sets are alike."""
    if not a or not b:
        return float(a == b)
    return sum((x & 63) + 1 for x in a & b) / sum((x & 63) + 1 for x in a)


def fingerprint(text: str | None) -> str:
    return written(chunked(utf8(text)).set())


def likeness(fingerprint: str, other: str) -> float:
    return contained(read(fingerprint), read(other))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` per row; a null text is empty (its fingerprint too)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in sliced(batches):
            said = [fingerprint(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(said, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _heads(docs: DataFrame, parts: int) -> list[int]:
    """The largest id of each of up to ``parts`` ranges, ascending: a row per range."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    top = ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top"))
    return sorted({r["top"] for r in top.collect()})


def in_order(docs: DataFrame) -> DataFrame:
    """Texts dealt to ranges of ids and sorted there by falling id: columns ``role``,
    ``doc_id``, ``text``. Behind a range's rows (``PLACED``) comes the head of the next
    one (``COPY``), then rows without an id (``ALONE``), spread over all ranges."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    heads = _heads(docs, parts)
    n = max(1, len(heads))

    def run(batches):
        turn = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            take, role, where = [], [], []
            for i, doc in enumerate(ids):
                if doc is None:
                    places = [(ALONE, (turn := turn + 1) % n)]
                else:
                    r = min(bisect_left(heads, doc), n - 1)
                    places = [(PLACED, r)] + [(COPY, (r + 1) % n)] * (doc == heads[r])
                for a, b in places:
                    take.append(i)
                    role.append(a)
                    where.append(b)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(role, pa.int32()), batch.column("doc_id").take(at), batch.column("text").take(at)], names=["place", "role", "doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(run, "place int, role int, doc_id long, text string").repartitionById(n, "place")
    return dealt.select("role", "doc_id", "text").sortWithinPartitions("role", F.desc("doc_id"), "text")


def edited(text: str, other: str) -> tuple[str, str]:
    """What stays of ``text``, and what replaces its last half (rounded down): as many code points of ``other``, or all."""
    half = len(text) // 2
    return text[: len(text) - half], other[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)`` per row of ``docs``; the next document is the one with the next smaller
    ``doc_id``, and after the smallest comes the largest.

    A null text is empty. Rows that share an id follow each other in order of text and
    lie in one task, as rows, never as a list. A row without an id has no place in the
    order: an empty text follows it. A single document is its own next. Empty texts have
    the empty fingerprint, like no other and 1 like each other. An empty table gives no
    rows; other columns are ignored. Texts are hashed whole, a block at a time.
    """
    ship(docs.sparkSession)
    dealt = in_order(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc, text: str, own: Chunks, other: str, its: set[int]) -> tuple:
        stays, new = map(utf8, edited(text, other))
        mine, changed = own.set(), chunked(stays + new, own, len(stays)).set()
        return doc, len(text), hashlib.sha256(stays + new).hexdigest(), written(mine), written(changed), contained(mine, changed), contained(mine, its)

    def run(batches):
        before = None
        for batch in sliced(batches, 200):
            out = []
            for role, doc, text in zip(*(batch.column(c).to_pylist() for c in ("role", "doc_id", "text")), strict=True):
                if role == COPY and before is None:
                    continue
                own = chunked(utf8(text))
                if role == ALONE:
                    out.append(row(doc, text, own, "", set()))
                    continue
                if before:
                    out.append(row(*before, text, own.set()))
                before = (doc, text, own) if role == PLACED else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
