"""Substring dedup by De Bruijn compaction over word k-mers.

A window of k words is an edge from the (k - 1)-mer that it starts with to the one
that it ends with. Edges around sampled k-mers that occur once are unique and left
out (:mod:`repeats`). The rest is a table with source coordinates:

1. Edges that occur once drop out.
2. An edge is joined to its successor where every occurrence of either is followed
   or preceded by the other: these are the nonbranching stretches. The first
   occurrences of such edges lie next to each other, so that a path is a run of
   source coordinates, and every occurrence of its first edge goes its whole length.
3. Every occurrence of a path is read again at its coordinates, and counts only if
   another one has the very same words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import repeats
from trackloom.llm.batches import PLACE, Batch, Store, numbers, per_batch, whole
from trackloom.llm.repeats import B, Hashes, Sampled
from trackloom.llm.suffix_dedup import covered
from trackloom.plans.runtime import Scratch

WINDOW, KMER = 35, 20


def edges(store: Store, window: int, kmer: int, recur: DataFrame) -> DataFrame:
    """``(edge, check, next, place)``: every window of a recurring sampled k-mer, told
    by 96 bits; ``next`` names the edge after it, 0 at a document's end and before
    unique ones; ``place`` is its source coordinate, a batch and a word there."""

    def make():
        def f(batch: Batch):
            s = Sampled(batch, repeats.word_tokens, window, kmer)
            if len(s.runs.lo):
                n = s.runs.hi - s.runs.lo + 1
                at = np.repeat(s.runs.lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                doc = np.repeat(s.runs.doc, n)
                edge = s.h.at(at, window).view(np.int64)
                follows = np.zeros(len(at), bool)
                follows[:-1] = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
                check = Hashes(s.x, B).at(at, window).astype(np.uint32).view(np.int32)
                yield edge, check, np.where(follows, np.roll(edge, -1).astype(np.int32), np.int32(0)), (batch.number << PLACE) + at

        return f

    return store.map(make, "edge long, check int, next int, place long", recur)


def paths(every: DataFrame, scratch: Scratch) -> DataFrame:
    """``(edge, check, path, length)``: the first edge of each compacted path of
    repeated edges, the path's source coordinate and how many edges it has."""
    twice = every.groupBy("edge", "check").agg(F.count("*").alias("n"), F.min("place").alias("source"), F.min("next").alias("a"), F.max("next").alias("b"))
    twice = scratch.keep(twice.where("n > 1").withColumn("name", F.shiftright(F.shiftleft("edge", 32), 32).cast("int")), "repeated-edges")
    unary = twice.where("a = b and a != 0").select(F.col("a").alias("name"), "n", (F.col("source") + 1).alias("source"), F.lit(True).alias("inner"))
    marked = twice.select("edge", "check", "name", "n", "source").join(unary, ["name", "n", "source"], "left")
    order = Window.partitionBy(F.shiftright("source", PLACE)).orderBy("source")
    stops = marked.withColumn("path", F.max(F.when(F.col("inner").isNull(), F.col("source"))).over(order))
    length = F.count("*").over(Window.partitionBy(F.shiftright("source", PLACE), "path"))
    heads = stops.withColumn("length", length).where("inner is null")
    return heads.select("edge", "check", "path", "length")


def verified(store: Store, spans: DataFrame, window: int) -> DataFrame:
    """The spans ``(path, batch, at, length)`` whose words, read at their coordinates,
    equal those of another span of their path."""

    def make():
        def f(batch: Batch):
            path, at, length = (batch.known[c] for c in ("path", "at", "length"))
            if len(path):
                start, end, _ = repeats.word_bounds(batch.data, batch.ends)
                said = []
                for i, n in zip(at.tolist(), length.tolist(), strict=True):
                    a, b = start[i : i + n + window - 1].tolist(), end[i : i + n + window - 1].tolist()
                    said.append(hashlib.blake2b(b" ".join([batch.data[x:y] for x, y in zip(a, b, strict=True)]), digest_size=24).digest())
                yield path, numbers(batch.number, len(path)), at, length, pa.array(said, pa.binary())

        return f

    known = per_batch(spans, "path", "at", "length")
    read = store.scratch.keep(store.map(make, "path long, batch long, at long, length long, words binary", known), "read")
    alone = store.scratch.keep(read.groupBy("path", "words").agg(F.count("*").alias("n")).where("n = 1"), "alone")  # but for hash collisions none
    return read.join(alone, ["path", "words"], "left_anti").select("batch", "at", "length")


def deduplicate(docs: DataFrame, digest: bool = False, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row of ``docs``: the kept words
    joined by one space; with ``digest`` their sha256 (``kept_sha256``).

    A word goes if a window of ``window`` words that covers it also starts anywhere
    else, the same document included, the first occurrence too. Null text has no
    words. Repeated rows and rows without ``doc_id`` are occurrences of their own;
    other columns are ignored; an empty table gives no rows. Texts longer than a
    batch are cut with an overlap and joined again at the end.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    store = Store(docs.select("doc_id", "text"), scratch, repeats.cut_words(window - 1))
    recur = repeats.recurring(store, repeats.word_tokens, window, kmer)
    every = scratch.keep(edges(store, window, kmer, recur), "edges")
    heads = scratch.keep(paths(every, scratch), "paths")
    at = F.col("place").bitwiseAND((1 << PLACE) - 1)
    spans = every.join(heads, ["edge", "check"]).select("path", F.shiftright("place", PLACE).alias("batch"), at.alias("at"), "length")
    gone = per_batch(verified(store, spans, window), "at", "length")

    last = "kept_sha256" if digest else "kept"

    def row(words: list[bytes], n: int) -> dict:
        kept = b" ".join(words)
        return {"n_words": n, "n_removed": n - len(words), last: hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")}

    def make():
        def f(batch: Batch):
            start, end, doc = repeats.word_bounds(batch.data, batch.ends)
            g = covered(len(start), batch.known["at"], batch.known["at"] + batch.known["length"] + window - 1)
            edge, out = np.searchsorted(doc, np.arange(len(batch.ids) + 1)).tolist(), []
            for k, i in enumerate(batch.ids):
                a, b, cut = edge[k], edge[k + 1], batch.pieces.get(k)
                take = np.arange(a, b) if cut else np.flatnonzero(~g[a:b]) + a
                words = [batch.data[s:e] for s, e in zip(start[take].tolist(), end[take].tolist(), strict=True)]
                if cut:
                    out.append({"piece_of": cut[0], "piece_first": cut[1], "piece_data": b" ".join(words), "piece_gone": np.packbits(g[a:b]).tobytes()})
                else:
                    out.append(row(words, b - a))
                out[-1]["doc_id"] = i
            yield pa.RecordBatch.from_pylist(out, schema=schema).columns

        return f

    def join(parts: list[dict]) -> dict:
        words: list[bytes] = []
        gone = np.zeros(0, bool)
        for p in parts:
            own = p["piece_data"].split(b" ") if p["piece_data"] else []
            g = np.unpackbits(np.frombuffer(p["piece_gone"], np.uint8), count=len(own)).astype(bool)
            both = len(words) - p["piece_first"]
            gone[p["piece_first"] :] |= g[:both]
            words += own[both:]
            gone = np.concatenate((gone, g[both:]))
        return row([words[i] for i in np.flatnonzero(~gone).tolist()], len(words))

    names = ["doc_id", "n_words", "n_removed", last]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
    schema = pa.schema(list(zip([*names, "piece_of", "piece_first", "piece_data", "piece_gone"], kinds, strict=True)))
    ddl = f"doc_id long, n_words long, n_removed long, {last} string, piece_of string, piece_first long, piece_data binary, piece_gone binary"
    out = scratch.keep(store.map(make, ddl, gone), "result")
    store.drop()
    return whole(out, join, names)
