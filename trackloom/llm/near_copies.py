"""Near copies by word shingles: pairs whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more, and their connected groups.

Candidates come from anchor-point covering, as in :mod:`simhash`: fingerprints at two or
fewer differing bits. A fingerprint of 64 bits sees few changes only, so that bands give
the others. These candidates share a band: five of 200 minima of the set under different hash
functions. Forty bands miss a pair at 0.8 with a chance of about 1e-7, and a more
similar one less. Every candidate is decided by its exact similarity.

Equal sets are collapsed first. In each band all members are compared with its
smallest and largest key. What that leaves outside the component of its band's
smallest key is then compared with every member of another component, in tiles of
bounded size that give back a forest of links, never pairs. Only pairs that already
are in one group go untested, so a band of copies costs no square; a band of sets
that are alike below 0.8 costs one in products within tiles, not in rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import simhash
from trackloom.llm.arrowio import column, map_rows, utf8
from trackloom.llm.repeats import A, Hashes, mix, word_tokens
from trackloom.operators.graph import connected_components, join_roots
from trackloom.plans.runtime import Scratch, ship

#: Shingles on each side of a tile; a single longer text has a side of its own size.
TILE = 32_768
WIDTH, BANDS, DEEP = 5, 40, 5
_RNG = np.random.default_rng(17)
_TIMES = _RNG.integers(1, 1 << 63, (BANDS * DEEP, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, (BANDS * DEEP, 1), dtype=np.uint64)


def normal(text: str | None) -> bytes:
    return b" ".join(utf8(text).lower().split())  # bytes: A-Z and \x20\x09-\x0D only


def shingles(words: bytes, width: int = WIDTH) -> np.ndarray:
    """Different hashes of the shingles, in order; a shorter text is one shingle."""
    x, _ = word_tokens(words, np.array([len(words)]))
    if not len(x):
        return x
    width = min(width, len(x))
    return np.unique(Hashes(x, A).at(np.arange(len(x) - width + 1), width))


def bands(s: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        np.minimum(least, ((s[i : i + 256] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEEP).T:
        out = mix(out * A + column)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 4/5 or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, n, bands, fp, words)`` per row: a name of its shingle set, its size,
    the bands it lies in, its fingerprint and its words. A null text has none; repeated rows stay, other
    columns are ignored."""

    def make():
        z = zstandard.ZstdCompressor(level=1)

        def rows(cols):
            for d, t in zip(*cols, strict=True):
                words = normal(t)
                s = shingles(words)
                key = xxhash.xxh64_intdigest(s.tobytes(), 42)
                yield d, key - (1 << 64) if key >> 63 else key, len(s), bands(s).tolist() if len(s) else [], simhash.signed_fingerprint(t), z.compress(words)

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, key long, n int, bands array<long>, fp long, words binary", make)


def _words(rows: DataFrame, need: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(key, words)``, once for each ``key`` of ``need``."""
    rows = rows.select("key", "words").join(need.distinct(), "key", "left_semi")
    return scratch.keep(rows.groupBy("key").agg(F.first("words").alias("words")), f"{name}-words")


def _verified(pairs: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``(src, dst)`` of keys that are similar."""
    words = _words(rows, pairs.select(F.explode(F.array("src", "dst")).alias("key")), scratch, name)
    both = pairs.join(words.toDF("src", "a"), "src").join(words.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")

    def make():
        z = zstandard.ZstdDecompressor()
        last: dict = {}

        def of(key, words):
            if key not in last:
                if len(last) >= 64:
                    last.clear()
                last[key] = shingles(z.decompress(words))
            return last[key]

        return lambda cols: [(u, v) for u, v, a, b in zip(*cols, strict=True) if similar(of(u, a), of(v, b))]

    out = scratch.keep(map_rows(both, "src long, dst long", make), f"{name}-similar")
    scratch.drop(f"{name}-words")
    return out


def _across(table: pa.Table) -> pa.Table:
    """A forest of links of one tile, from its sets that are in question to its members
    of other components."""
    table = table.combine_chunks()
    z = zstandard.ZstdDecompressor()
    sets = [shingles(z.decompress(w)) for w in table["words"].to_pylist()]
    size = np.array([len(s) for s in sets])
    asks, key = table["asks"].to_numpy(zero_copy_only=False), table["key"].to_numpy()
    names, of = np.unique(table["c"].to_numpy(), return_inverse=True)
    root = np.arange(len(names))
    members = np.flatnonzero(~asks)
    held = np.concatenate([np.zeros(0, np.uint64), *(sets[m] for m in members)])
    order = np.argsort(held, kind="stable")
    held, holder = held[order], np.repeat(np.arange(len(members)), size[members])[order]
    src, dst = [], []
    for k in np.flatnonzero(asks):
        lo = np.searchsorted(held, sets[k], side="left")
        n = np.searchsorted(held, sets[k], side="right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holder[at], minlength=len(members))
        near = members[5 * both >= 4 * (size[k] + size[members] - both)]
        near = near[root[of[near]] != root[of[k]]]
        near = near[np.unique(root[of[near]], return_index=True)[1]]
        src += [key[k]] * len(near)
        dst += key[near].tolist()
        join_roots(root, np.full(len(near), of[k]), of[near])
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _linked(named: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Links ``(src, dst)`` that join the components ``c`` of ``named`` wherever members
    of one band are similar, from those outside their band's main component. Its two
    ends have met all members before."""
    ship(named.sparkSession)
    heads = named.where("head").select("band", F.col("c").alias("main"))
    open_ = named.where("not end").join(heads, "band").withColumn("asks", F.col("c") != F.col("main"))
    left = open_.where("asks").groupBy("band").agg(F.sum("n").alias("left"))
    open_ = scratch.keep(open_.join(left, "band").select("band", "key", "c", "asks", "load", "left"), "open")
    words = _words(rows, open_.select("key"), scratch, "open")

    h, sides = F.xxhash64("key"), {s: F.ceil(F.col(s) / TILE).cast("long") for s in ("left", "load")}
    own = {s: F.array(F.pmod(h, n)) for s, n in sides.items()}
    each = {s: F.sequence(F.lit(0).cast("long"), n - 1) for s, n in sides.items()}
    # a member meets every part of the askers; an asker is also a member
    as_member = F.struct(F.lit(False).alias("asks"), each["left"].alias("i"), own["load"].alias("j"))
    as_asker = F.struct(F.lit(True).alias("asks"), own["left"].alias("i"), each["load"].alias("j"))
    dealt = open_.join(words, "key").select("band", "key", "c", "words", F.explode(F.when(F.col("asks"), F.array(as_member, as_asker)).otherwise(F.array(as_member))).alias("x"))
    dealt = dealt.select("band", "key", "c", "words", "x.asks", F.explode("x.i").alias("i"), "x.j").select("band", "key", "c", "words", "asks", "i", F.explode("j").alias("j"))
    out = scratch.keep(dealt.groupBy("band", "i", "j").applyInArrow(_across, "src long, dst long"), "across")
    scratch.drop("open-words")
    scratch.drop("open")
    return out


def _covered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``(src, dst)`` of sets whose fingerprints are linked by the covering: every
    set of a component of fingerprints and its smallest."""
    held = scratch.keep(rows.select("key", "fp").distinct(), "held")
    cc = connected_components(simhash.links(held.select("fp").distinct()), scratch, "fp-cc")
    placed = held.join(cc.withColumnRenamed("id", "fp"), "fp", "left").select("key", F.coalesce("component", "fp").alias("c"))
    least = placed.groupBy("c").agg(F.min("key").alias("src"))
    return scratch.keep(placed.join(least, "c").where("key != src").select("src", F.col("key").alias("dst")).distinct(), "candidates")


def _pair(a, b) -> list:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, unchanged) whose document is the smallest
    of its group of near copies. Texts without a word are copies of each other.
    Rows with a null ``doc_id`` stay, and join others."""
    scratch = Scratch(docs.sparkSession, "copies")
    rows = scratch.keep(sketches(docs), "rows")
    classes = scratch.keep(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("key", "n", F.explode("bands").alias("band"))
    full = placed.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("n").alias("load")).where("lo < hi")
    members = scratch.keep(placed.join(full, "band"), "members")

    star = members.select("key", F.explode(F.array("lo", "hi")).alias("other")).where("key != other").select(*_pair("key", "other"))
    star = scratch.keep(star.distinct(), "star")
    edges = _verified(_covered(rows, scratch), rows, scratch, "covered").unionByName(_verified(star, rows, scratch, "star"))
    cc = connected_components(edges, scratch, "star-cc")

    named = members.join(cc.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
    named = scratch.keep(named.select("band", "key", "n", "load", "c", (F.col("key") == F.col("lo")).alias("head"), F.col("key").isin(F.col("lo"), F.col("hi")).alias("end")), "named")
    more = _linked(named, rows, scratch)
    if more.limit(1).count():
        cc = connected_components(edges.unionByName(more), scratch, "all-cc")

    label = classes.join(cc.withColumnRenamed("id", "key"), "key", "left").select("key", "first", F.coalesce("component", "key").alias("c"))
    least = label.groupBy("c").agg(F.min("first").alias("least"))
    kept = scratch.keep(label.join(least, "c").select("key", "least"), "kept")
    later = scratch.keep(rows.select("doc_id", "key").join(kept, "key").where("doc_id != least").select("doc_id").distinct(), "later")
    return docs.join(later, "doc_id", "left_anti").select(*map(column, docs.columns))
