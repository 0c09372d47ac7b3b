"""Batches of whole texts that several passes go over.

A :class:`Store` holds documents packed into batches of a few MB, compressed, in a
table bucketed by batch number. A pass maps a function over the batches and emits
plain rows; joins and groupings of those rows are Spark's; what a later pass needs
of them comes back as arrays per batch, joined to the batches without moving text
again. Every pass's rows are in proportion to the text.

A text longer than a batch is cut into pieces that overlap (``cut`` says where), so
no pass holds more than a few MB of it; :func:`whole` joins what the pieces gave.
"""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from trackloom.plans.runtime import Scratch, ship

BATCH = 2_000_000
#: Bits of a place (a token of a batch) below the batch's number.
PLACE = 22


@dataclass
class Batch:
    """Documents or pieces: ids (None allowed), and their UTF-8 bytes end to end.
    ``pieces``: for a piece its document's key and its first token there."""

    number: int
    ids: list
    ends: np.ndarray
    data: bytes
    extra: list
    pieces: dict[int, tuple[str, int]]
    known: dict = field(default_factory=dict)

    def text(self, i: int) -> bytes:
        return self.data[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]

    def order(self) -> np.ndarray:
        """Ids as numbers, null as the largest."""
        return np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)


class Store:
    """``docs`` has doc_id and text; a string column ``extra``, if any, travels along.
    ``cut(text)`` gives ``(from byte, to byte, first token)`` of a long text's pieces."""

    def __init__(self, docs: DataFrame, scratch: Scratch, cut: Callable | None = None, batch_bytes: int = BATCH):
        spark = self.spark = docs.sparkSession
        ship(spark)
        self.scratch = scratch
        self.name = f"trackloom_batches_{uuid.uuid4().hex[:12]}"
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

        packed = docs.select("doc_id", "text", *[c for c in ("extra",) if c in docs.columns])
        packed = packed.mapInArrow(lambda b: _pack(b, batch_bytes, cut), "ids binary, missing binary, ends binary, data binary, extra binary, pieces binary")
        # a task's number and its batches', so that a batch and a place in it fit a long
        own = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        own = F.when(own < 1 << 16, own).otherwise(F.raise_error(F.lit("more than 65536 batches in one input partition: repartition the input")).cast("long"))
        packed = packed.withColumn("batch", F.shiftleft(F.spark_partition_id().cast("long"), 16).bitwiseOR(own)).repartition(parts, "batch")
        packed.write.bucketBy(parts, "batch").option("path", scratch.path("batches")).option("compression", "uncompressed").saveAsTable(self.name)
        atexit.register(self.drop)
        self.table = spark.table(self.name)

    def drop(self) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.scratch.drop("batches")
        except Exception:  # the session may be gone at exit
            pass

    def map(self, make: Callable[[], Callable[[Batch], Iterator[list]]], ddl: str, *known: DataFrame) -> DataFrame:
        """Rows ``ddl`` of every batch: ``make()(batch)`` yields lists of columns.
        ``known``: tables ``(batch, array of longs, ..)`` that ``batch.known`` holds."""
        df = self.table.select("batch", "ids", "missing", "ends", "data", "extra", "pieces")
        for k in known:
            df = df.join(k.hint("shuffle_hash"), "batch", "left")

        def run(batches):
            f = make()
            for rows in batches:
                for i in range(rows.num_rows):
                    for cols in f(_unpack(rows.slice(i, 1))):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], names=schema.names)

        schema = to_arrow_schema(_parse_datatype_string(ddl))
        return df.mapInArrow(run, ddl)


def per_batch(rows: DataFrame, *names: str) -> DataFrame:
    """``(batch, array, ..)``: at most what one batch's text gives."""
    return rows.groupBy("batch").agg(*[F.collect_list(n).alias(n) for n in names])


def numbers(values, n: int) -> pa.Array:
    """``n`` times one number."""
    return pa.array(np.full(n, values, np.int64))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def whole(out: DataFrame, join: Callable[[list[dict]], dict], names: list[str]) -> DataFrame:
    """Rows of pieces (those with ``piece_of``, and ``piece_first``, ``piece_data``,
    ``piece_gone``) joined to one row per document by ``join``; the others unchanged.
    One group is one document."""
    short, long = out.where("piece_of is null").select(*names), out.where("piece_of is not null")
    ddl = ", ".join(f"{n} {dict(out.dtypes)[n]}" for n in names)

    def run(t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda r: r["piece_first"])
        return pa.Table.from_pylist([{"doc_id": parts[0]["doc_id"]} | join(parts)], schema=pa.schema([t.schema.field(n) for n in names]))

    return short.unionByName(long.groupBy("piece_of").applyInArrow(run, ddl))


def _pack(batches, limit: int, cut: Callable | None):
    ids: list = []
    sizes: list[int] = []
    parts: list[bytes] = []
    more: list = []
    pieces: list = []
    size, z = 0, zstandard.ZstdCompressor(level=3)
    names = ["ids", "missing", "ends", "data", "extra", "pieces"]

    def flush():
        known = np.array([i or 0 for i in ids], "<i8").tobytes()
        missing = np.packbits([i is None for i in ids]).tobytes() if None in ids else b""
        row = [known, missing, np.cumsum(sizes).astype("<i8").tobytes(), z.compress(b"".join(parts)), z.compress(json.dumps(more).encode()) if more else b"", json.dumps(pieces).encode() if pieces else b""]
        for x in (ids, sizes, parts, more, pieces):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            doc, text = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
            stretches = list(cut(text, limit)) if cut and len(text) > limit else [(0, len(text), 0)]
            key = uuid.uuid4().hex if len(stretches) > 1 else None
            for a, b, first in stretches:
                if ids and size + b - a > limit:
                    yield flush()
                    size = 0
                if key:
                    pieces.append((len(ids), key, first))
                ids.append(doc)
                sizes.append(b - a)
                parts.append(text[a:b] if key else text)
                if batch.num_columns > 2:
                    more.append(batch.column(2)[i].as_py())
                size += b - a
    if ids:
        yield flush()


def _unpack(row: pa.RecordBatch) -> Batch:
    r = {n: row.column(n)[0] for n in row.schema.names}
    z = zstandard.ZstdDecompressor()
    ids: list = np.frombuffer(r["ids"].as_py(), "<i8").tolist()
    if missing := r["missing"].as_py():
        ids = [None if m else i for i, m in zip(ids, np.unpackbits(np.frombuffer(missing, np.uint8), count=len(ids)), strict=True)]
    extra, pieces = r["extra"].as_py(), r["pieces"].as_py()
    known = {}
    for n in row.schema.names[7:]:
        known[n] = np.asarray(r[n].values) if r[n].is_valid else np.zeros(0, np.int64)
    return Batch(r["batch"].as_py(), ids, np.frombuffer(r["ends"].as_py(), "<i8"), z.decompress(r["data"].as_py()), json.loads(z.decompress(extra)) if extra else [], {s: (k, f) for s, k, f in json.loads(pieces)} if pieces else {}, known)
