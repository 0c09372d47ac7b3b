"""Suffix dedup by distributed prefix doubling over a table of ranked positions.

Equal strings have equal names (64-bit hashes of their content), which serve as
ranks: only equality is asked. Spark sorts pairs of names at growing offsets; a
position whose pair is unique drops out, the others go on until past the threshold:

1. Half the threshold, at positions sampled by content (:mod:`repeats`): every
   string over the threshold holds a sampled one at the same place in each of its
   copies. Strings around a position that is unique are unique.
2. The pairs of half-threshold names at both ends of the strings around a position:
   where they equal those of an earlier document, all these strings go. Where all
   documents agree around the position, there is nothing left to tell apart.
3. Single positions, for the rest: the pair of names at ``i`` and half a threshold
   on is the rank of the string over the threshold.

A row per byte from the start would be 17 bytes per byte and sort; the sample leaves
one in fourteen to the first sort and a few in a hundred to the last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import repeats
from trackloom.llm.batches import Batch, Store, lists, numbers, per_batch, whole
from trackloom.llm.repeats import A, B, Sampled, mix
from trackloom.plans.runtime import Scratch

THRESHOLD = 50
PAIRS = "one long, two long, low long, batch long, at array<long>"


def pair_rows(batch: Batch, doc: np.ndarray, one: np.ndarray, two: np.ndarray, at: np.ndarray):
    """A row per different pair with its places in the least document that has it
    here, and one without a document (under a key of its own): the places in later
    ones, which surely go. Both names are whole: behind a first half that all strings
    share, the second alone tells them apart."""
    order = np.lexsort((at, doc, two, one))
    doc, one, two, at = doc[order], one[order], two[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    first = doc == doc[head][group]
    if len(head):
        n = len(head)
        yield one[head].view(np.int64), two[head].view(np.int64), doc[head], numbers(batch.number, n), lists(at[first], np.bincount(group[first], minlength=n))
    if (~first).any():
        yield mix(np.array([batch.number], np.uint64)).view(np.int64), numbers(0, 1), pa.nulls(1, pa.int64()), numbers(batch.number, 1), lists(at[~first], np.array([(~first).sum()]))


def rank(pairs: DataFrame) -> DataFrame:
    """Sort pairs. ``gone``: an earlier document has the pair too; else the row holds
    the first occurrence, and keeps its names. A batch has a row per pair."""
    low = F.min("low").over(Window.partitionBy("one", "two"))
    known = pairs.withColumn("gone", F.coalesce(F.col("low") > low, F.lit(True)))
    return known.select(*[F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("one", "two")], "batch", "at", "gone")


def _places(rows: DataFrame) -> DataFrame:
    return per_batch(rows, "at").select("batch", F.flatten("at").alias("places"))


def _pairs(store: Store, threshold: int, half: int, recur: DataFrame) -> DataFrame:
    """Pairs of names around each sampled position that recurs."""
    step = threshold - half

    def make():
        def f(batch: Batch):
            s = Sampled(batch, repeats.byte_tokens, threshold, half)
            r, h = s.runs, s.h
            if len(r.lo):
                around = mix(h.at(r.lo, half) + mix(h.at(r.lo + step, half) + mix(h.at(r.hi, half) + mix(h.at(r.hi + step, half) + (r.hi - r.lo).astype(np.uint64) * B + (r.anchor - r.lo).astype(np.uint64) * A))))
                yield from pair_rows(batch, batch.order()[r.doc], s.key, around, r.lo << 8 | r.hi - r.lo)

        return f

    return store.map(make, PAIRS, recur)


def _singles(store: Store, threshold: int, half: int, open_: DataFrame) -> DataFrame:
    """Pairs of names at every position left open."""
    step = threshold - half

    def make():
        def f(batch: Batch):
            if len(places := np.sort(batch.known["places"])):
                h = repeats.Hashes(repeats.byte_tokens(batch.data, batch.ends)[0], A)
                i = np.unique(spread(places))
                doc = batch.order()[np.searchsorted(batch.ends, i, side="right")]
                yield from pair_rows(batch, doc, h.at(i, half), h.at(i + step, half), i << 8)

        return f

    return store.map(make, PAIRS, open_)


def spread(places: np.ndarray) -> np.ndarray:
    """Single positions of packed stretches."""
    lo, n = places >> 8, (places & 255) + 1
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``n`` tokens lie in one of the stretches from lo to before hi."""
    edge = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def _spans(removed: np.ndarray) -> int:
    return int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum()) if len(removed) else 0


def deduplicate(docs: DataFrame, digest: bool = False, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, per row of ``docs``; with
    ``digest`` the sha256 of the kept bytes in place of them (``kept_sha256``).

    A byte goes if a string of ``threshold`` bytes (510 at most) that covers it also
    starts in a document with a smaller ``doc_id``; equal ids aren't smaller, and a
    null id counts as largest. Null text counts as empty. Repeated rows are judged
    alike; other columns are ignored; an empty table gives no rows. Texts longer than
    a batch are cut with an overlap and joined again at the end.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    store = Store(docs.select("doc_id", "text"), scratch, repeats.cut_bytes(threshold - 1))
    half = -(-threshold // 2)
    recur = repeats.recurring(store, repeats.byte_tokens, threshold, half)
    around = scratch.keep(rank(_pairs(store, threshold, half, recur)), "around")
    left = around.where("not gone")
    apart = left.groupBy("one").agg(F.min("two").alias("a"), F.max("two").alias("b")).where("a != b").select("one")
    open_ = scratch.keep(_places(left.join(apart, "one", "left_semi")), "open")
    single = scratch.keep(_places(rank(_singles(store, threshold, half, open_)).where("gone")), "single")
    gone = _places(around.where("gone")).withColumnRenamed("places", "around")

    last = "kept_sha256" if digest else "kept"

    def row(text: bytes, g: np.ndarray) -> dict:
        kept = np.frombuffer(text, np.uint8)[~g].tobytes()
        return {"n_bytes": len(text), "n_removed": int(g.sum()), "n_spans": _spans(g), last: hashlib.sha256(kept).hexdigest() if digest else kept}

    def make():
        def f(batch: Batch):
            gone = np.concatenate((batch.known["places"], batch.known["around"]))
            lo, n = gone >> 8, gone & 255
            g, at, out = covered(len(batch.data), lo, lo + n + threshold), 0, []
            for k, end in enumerate(batch.ends.tolist()):
                text, cut = batch.data[at:end], batch.pieces.get(k)
                if cut:
                    out.append({"piece_of": cut[0], "piece_first": cut[1], "piece_data": text, "piece_gone": np.packbits(g[at:end]).tobytes()})
                else:
                    out.append(row(text, g[at:end]))
                out[-1]["doc_id"], at = batch.ids[k], end
            yield pa.RecordBatch.from_pylist(out, schema=schema).columns

        return f

    def join(parts: list[dict]) -> dict:
        text = bytearray(parts[-1]["piece_first"] + len(parts[-1]["piece_data"]))
        g = np.zeros(len(text), bool)
        for p in parts:
            a, n = p["piece_first"], len(p["piece_data"])
            text[a : a + n] = p["piece_data"]
            g[a : a + n] |= np.unpackbits(np.frombuffer(p["piece_gone"], np.uint8), count=n).astype(bool)
        return row(bytes(text), g)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", last]
    kinds = [pa.int64()] * 4 + [pa.string() if digest else pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip([*names, "piece_of", "piece_first", "piece_data", "piece_gone"], kinds, strict=True)))
    ddl = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}, piece_of string, piece_first long, piece_data binary, piece_gone binary"
    out = scratch.keep(store.map(make, ddl, single, gone), "result")
    store.drop()
    return whole(out, join, names)
