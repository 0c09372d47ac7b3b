"""Token-id files with a minimal perfect hash index.

A store is a set of shards in key order. Each shard has two files::

    shard-00000.ids   raw little-endian ids (16 or 32 bits), record after record
    shard-00000.mph   header "<4s4Q": magic, keys, buckets, bytes per id, ids
                      int64[buckets]   displacement of each bucket
                      uint64[keys]     fingerprint of the key in each slot
                      uint64[keys + 1] in key order: first id of each record
                      uint32[keys]     record number of each slot

A key is hashed once to a bucket; the bucket's displacement sends each of its
keys to a slot of its own (hash and displace: large buckets search a seed, single
keys name a free slot directly), so a lookup is constant time. The stored 64-bit
fingerprint tells absent keys apart. Keys are (doc_id, occurrence), so repeated
rows keep records of their own.

Files are written by the tasks through ``pyarrow.fs`` to a temporary name and then
renamed, so a repeated task replaces its own output with the same bytes.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrowio import map_rows
from trackloom.llm.tokens import encode_documents, unpack
from trackloom.plans.runtime import Scratch, ship

#: Bytes of text in a shard, about; all records of one id lie in one shard.
SHARD = 32_000_000
MAGIC, HEAD, PER_BUCKET = b"MPH1", struct.Struct("<4s4Q"), 4


def _key(doc_id: int | None, occurrence: int) -> bytes:
    return struct.pack("<?qq", doc_id is None, doc_id or 0, occurrence)


def _h(key: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(key, seed)


def build_index(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) of a minimal perfect hash of distinct keys."""
    n = len(keys)
    buckets: list[list[int]] = [[] for _ in range(max(1, (n + PER_BUCKET - 1) // PER_BUCKET))]
    for i, k in enumerate(keys):
        buckets[_h(k, 0) % len(buckets)].append(i)
    move, slot, taken = np.zeros(len(buckets), np.int64), np.zeros(n, np.int64), bytearray(n)
    order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
    free = 0
    for b in order:
        members = buckets[b]
        if len(members) > 1:
            seed = 1
            while True:
                want = [_h(keys[i], seed) % n for i in members]
                if len(set(want)) == len(want) and not any(taken[w] for w in want):
                    break
                seed += 1
            move[b] = seed
            for i, w in zip(members, want, strict=True):
                slot[i], taken[w] = w, 1
        elif members:
            while taken[free]:
                free += 1
            slot[members[0]], taken[free], move[b] = free, 1, -free - 1
    return move, slot


class Shard:
    """A written shard: ``find`` gives a record's (first id, length) or None."""

    def __init__(self, fs, path: str):
        with fs.open_input_file(path + ".mph") as f:
            raw = f.read()
        magic, n, m, self.width, self.total = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError(f"{path}.mph is not an index")
        at = HEAD.size
        self.move = np.frombuffer(raw, "<i8", m, at)
        self.prints = np.frombuffer(raw, "<u8", n, at + 8 * m)
        self.first = np.frombuffer(raw, "<u8", n + 1, at + 8 * m + 8 * n)
        self.record = np.frombuffer(raw, "<u4", n, at + 8 * m + 8 * n + 8 * (n + 1))
        self.n, self.m, self.fs, self.path = n, m, fs, path
        self.payload = fs.open_input_file(path + ".ids")

    def find(self, key: bytes) -> tuple[int, int] | None:
        if not self.n:
            return None
        d = int(self.move[_h(key, 0) % self.m])
        s = -d - 1 if d < 0 else _h(key, d) % self.n
        if int(self.prints[s]) != _h(key, 0):
            return None
        r = int(self.record[s])
        return int(self.first[r]), int(self.first[r + 1] - self.first[r])

    def ids(self, first: int, length: int) -> np.ndarray:
        return unpack(self.payload.read_at(length * self.width, first * self.width), length)

    def close(self) -> None:
        self.payload.close()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD) -> list[dict]:
    """Encode whole ``docs`` and write them in ascending ``doc_id`` order (nulls
    first; equal ids by their ids' bytes). Returns the manifest, a row per shard
    in order: shard, docs, ids, low and high (its smallest and largest doc_id).

    The bounds between shards come from the keys alone; the ids are shuffled once.
    """
    spark = docs.sparkSession
    ship(spark)
    bounds = _bounds(docs, shard_bytes)
    n = len(bounds) + 1
    tokens = encode_documents(docs, tokenizer, end_id, bounds)
    dealt = tokens.repartitionById(n, "shard").sortWithinPartitions("shard", "doc_id", "ids")

    def run(batches):
        writer = None
        for batch in batches:
            for shard, doc, size, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "ids")), strict=True):
                if writer is None or writer.shard != shard:
                    if writer:
                        yield writer.close()
                    writer = _Writer(folder, shard)
                writer.add(doc, size, raw)
        if writer:
            yield writer.close()

    out = dealt.mapInArrow(run, "shard int, docs long, ids long, low long, high long")
    return sorted((r.asDict() for r in out.collect()), key=lambda r: r["shard"])  # a row per shard


def _bounds(docs: DataFrame, shard_bytes: int) -> list[int]:
    """The least doc_id of each shard but the first: a row per shard."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    shards = -(-size // shard_bytes)
    if shards < 2:
        return []
    dealt = docs.select("doc_id").where("doc_id is not null").repartitionByRange(shards, "doc_id")
    low = dealt.groupBy(F.spark_partition_id().alias("shard")).agg(F.min("doc_id").alias("low"))
    return sorted({r["low"] for r in low.collect()})[1:]


class _Writer:
    def __init__(self, folder: str, shard: int):
        self.fs, base = _filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.shard, self.path = shard, f"{base}/shard-{shard:05d}"
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.ids = self.fs.open_output_stream(self.tmp + ".ids")
        self.keys, self.first, self.width, self.low, self.high, self.last, self.k = [], [0], 2, None, None, object(), 0

    def add(self, doc: int | None, n: int, raw: bytes) -> None:
        self.k = self.k + 1 if doc == self.last else 0
        self.last = doc
        self.keys.append(_key(doc, self.k))
        self.first.append(self.first[-1] + n)
        self.width = len(raw) // n
        self.ids.write(raw)
        if doc is not None:
            self.low = doc if self.low is None else self.low
            self.high = doc

    def close(self):
        import pyarrow as pa

        self.ids.close()
        n = len(self.keys)
        move, slot = build_index(self.keys)
        prints, record = np.zeros(n, "<u8"), np.zeros(n, "<u4")
        prints[slot] = np.fromiter((_h(k, 0) for k in self.keys), np.uint64, n)
        record[slot] = np.arange(n)
        with self.fs.open_output_stream(self.tmp + ".mph") as f:
            f.write(HEAD.pack(MAGIC, n, len(move), self.width, self.first[-1]) + move.astype("<i8").tobytes() + prints.tobytes() + np.array(self.first, "<u8").tobytes() + record.tobytes())
        for end in (".ids", ".mph"):
            if self.fs.get_file_info(self.path + end).is_file:  # of an earlier attempt; not all stores rename over files
                self.fs.delete_file(self.path + end)
            self.fs.move(self.tmp + end, self.path + end)
        row = {"shard": self.shard, "docs": n, "ids": self.first[-1], "low": self.low, "high": self.high}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))


def read(keys: DataFrame, folder: str, manifest: list[dict]) -> DataFrame:
    """Keyed access: ``(doc_id, start, n_tokens, ids)`` for each row of ``keys
    (doc_id)`` that the store holds, repeated keys taking successive records.
    ``start`` counts the ids of all records before it. ``manifest`` has a row per
    shard, so it is small."""
    lows = [m["low"] if m["low"] is not None else -(1 << 63) for m in manifest]
    shards = [m["shard"] for m in manifest]
    before = np.concatenate(([0], np.cumsum([m["ids"] for m in manifest]))).tolist()

    def place():
        def rows(cols):
            for (d,) in zip(*cols, strict=True):
                if shards:
                    yield (0 if d is None else max(0, bisect.bisect_right(lows, d) - 1)), d

        return rows

    # one task a shard; a repeated key counts its occurrences there
    dealt = map_rows(keys.select("doc_id"), "at int, doc_id long", place).repartitionById(max(1, len(shards)), "at").sortWithinPartitions("at", "doc_id")

    def look():
        fs, base = _filesystem(folder)
        now: list = [None, None, object(), 0]

        def rows(cols):
            for at, d in zip(*cols, strict=True):
                if now[0] != at:
                    if now[1]:
                        now[1].close()
                    now[:2] = [at, Shard(fs, f"{base}/shard-{shards[at]:05d}")]
                now[2:] = [d, now[3] + 1 if d == now[2] else 0]
                found = now[1].find(_key(d, now[3]))
                if found:
                    yield d, before[at] + found[0], found[1], now[1].ids(*found).tobytes()

        return rows

    return map_rows(dealt, "doc_id long, start long, n_tokens long, ids binary", look)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD) -> DataFrame:
    """Write ``docs`` to files under the shared folder and read every document
    back by key: ``(doc_id, start, n_tokens, ids_crc32)``.

    Null text counts as empty (just the end id); null ``doc_id`` comes first;
    repeated rows keep one record each; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    folder = scratch.path("store")
    manifest = write(docs, folder, tokenizer, end_id, shard_bytes)

    def sums():
        return lambda cols: [(d, s, n, zlib.crc32(i)) for d, s, n, i in zip(*cols, strict=True)]

    return map_rows(read(docs, folder, manifest), "doc_id long, start long, n_tokens long, ids_crc32 long", sums)
