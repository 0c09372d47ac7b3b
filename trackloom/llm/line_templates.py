"""Line dedup by a log-template tree of fixed depth.

A line's tokens are masked where they vary by nature (digits, addresses). The tree
parses a line by its token count and its three leading tokens to a leaf. What is fixed
in a leaf and what varies can't be told from one line, nor by one count: what is a rare
word in a large corpus is a frequent value of a field in a larger one. So templates are
looked for at all levels of frequency. At level k a token is fixed where 3 * 1.1**k
documents hold it at its position of the leaf, the other positions are fields: the
lowest level finds what is rare and exact, the higher ones what is common and varies.
A template's own tokens come as often as the template, a field's values less often, so
some level tells them apart. A line has a template at each level where enough of its tokens are fixed; above
the lowest, also half of those behind the leading ones, which the leaf has fixed. That
depends on counts alone, not on the order or the batches in which lines are met, and no
leaf has to fit anywhere. Lines of a template that recurs across documents are dropped
from all documents but the first that has one.

Three passes count: leaves, tokens by position of the leaves that recur, templates. A
batch sends each of its keys once, with the number of its documents that hold it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.arrowio import column
from trackloom.llm.batches import Batch, Store, numbers, per_batch
from trackloom.llm.repeats import A, B, Hashes, mix, word_bounds, word_hashes
from trackloom.plans.runtime import Scratch

#: Other columns travel as JSON, times to the microsecond.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Documents that a token or template recurs in; share of fixed tokens; leading tokens.
MIN_DOCS, FIXED, DEPTH = 3, 0.6, 3
#: How much more documents a level asks for than the one below.
STEP = 1.1
MASKED, FIELD = np.uint64(1), np.uint64(2)


class Lines:
    """The lines of a batch that hold a word: first word, words, document, leaf."""

    def __init__(self, batch: Batch):
        data, ends = batch.data, batch.ends
        b = np.frombuffer(data, np.uint8)
        start, end, doc = word_bounds(data, ends)
        self.x = word_hashes(data, start, end)
        digit = (b - 48 < 10) | (b == 64)
        letter = (b > 127) | ((b | 32) - 97 < 26)
        site = np.zeros(len(b), bool)
        site[:-2] = (b[:-2] == 58) & (b[1:-1] == 47) & (b[2:] == 47) if len(b) > 2 else False
        self.masked = _any(digit, start, end) | _any(site, start, np.maximum(end - 2, start + 1))
        self.letter = _any(letter, start, end) & ~self.masked
        self.x[self.masked] = MASKED
        breaks = np.flatnonzero(b == 10)
        at = np.searchsorted(breaks, start)  # line breaks before each word
        self.first = np.flatnonzero(np.diff(at + doc, prepend=-1)) if len(start) else start
        self.n = np.diff(self.first, append=len(start))
        self.doc = doc[self.first]
        self.number = at[self.first] - np.searchsorted(breaks, np.concatenate(([0], ends))[self.doc])
        self.id = batch.order()[self.doc]
        leaf = mix(self.n.astype(np.uint64) * A)
        for k in range(DEPTH):
            more = self.n > k
            leaf[more] = mix(leaf[more] * B + self.x[self.first[more] + k])
        self.leaf = leaf

    def tokens(self) -> np.ndarray:
        """A key per word: leaf, position and token."""
        place = np.arange(len(self.x)) - np.repeat(self.first, self.n)
        return mix(np.repeat(self.leaf, self.n) + place.astype(np.uint64) * A + self.x * B)

    def templates(self, some: np.ndarray, level: np.ndarray, share: float):
        """``(lines, keys)`` for each level: the template of every line of ``some`` that
        has enough fixed words there, one of them with a letter, where it differs from
        the level below. ``level``: up to which one their words are fixed, -1 for none."""
        words = np.repeat(some, self.n)
        line, x, n, letter = np.flatnonzero(some), self.x[words], self.n[some], self.letter[words]
        tail = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) >= DEPTH
        before = n + 1
        for k in np.unique(level[level >= 0]).tolist():
            first, fixed = np.cumsum(n) - n, level >= k
            many = np.add.reduceat(fixed.astype(np.int64), first)
            enough = (many >= share * n) & np.maximum.reduceat(fixed & letter, first)
            new = enough & (many < before)
            if k:  # beyond the leading words, which the leaf has fixed, half at least
                new &= 2 * np.add.reduceat((fixed & tail).astype(np.int64), first) >= n - DEPTH
            if new.any():
                words, size = np.repeat(new, n), n[new]
                h = Hashes(np.where(fixed[words], x[words], FIELD), A).at(np.cumsum(size) - size, size)
                yield line[new], mix(self.leaf[line[new]] + h * B)
            if not enough.any():
                return
            words = np.repeat(enough, n)  # the others have none at higher levels
            line, before, n = line[enough], many[enough], n[enough]
            x, letter, tail, level = x[words], letter[words], tail[words], level[words]


def _any(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, bool)
    return np.maximum.reduceat(np.append(flags, False), np.stack((start, end), 1).ravel())[::2]


def _counted(batch: Batch, key: np.ndarray, doc: np.ndarray, ids: np.ndarray):
    """Different keys, in how many of the batch's documents, and the least id."""
    if len(key):
        order = np.lexsort((doc, key))
        key, doc, ids = key[order], doc[order], ids[order]
        new = np.append(True, key[1:] != key[:-1])
        head = np.flatnonzero(new)
        docs = np.add.reduceat((new | np.append(True, doc[1:] != doc[:-1])).astype(np.int32), head)
        yield key[head].view(np.int64), numbers(batch.number, len(head)), docs, np.minimum.reduceat(ids, head)


def _lookup(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in ``known``, and whether it is there at all."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(len(keys), bool)
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known[order], keys), len(known) - 1)]
    return at, known[at] == keys


COUNTED = "key long, batch long, docs int, low long"


def _recurring(sent: DataFrame, min_docs: int, scratch: Scratch, name: str, also: str) -> DataFrame:
    """``(batch, name, name_also)``: a batch's keys that enough documents hold, and the
    least document (``low``) or the number of documents (``docs``) that do. A key comes
    once a batch."""
    every = Window.partitionBy("key")
    found = sent.withColumn("total", F.sum("docs").over(every))
    found = found.withColumn("also", F.min("low").over(every) if also == "low" else F.col("total")).where(F.col("total") >= min_docs)
    return scratch.keep(per_batch(found.select("batch", F.col("key").alias(name), F.col("also").alias(f"{name}_{also}")), name, f"{name}_{also}"), name)


def deduplicate(docs: DataFrame, mode: str = "text", min_docs: int = MIN_DOCS, share: float = FIXED) -> DataFrame:
    """Drop lines of recurring templates from all but the first document.

    ``mode`` "text": the rows of ``docs`` with all their columns, ``text`` being the
    kept lines (``n_chars``, where present, follows it). "digest": ``(doc_id,
    n_lines, n_dropped, kept_sha256)``, lines without a word not counted.

    A template needs ``share`` of its tokens fixed, one of them with a letter, and
    ``min_docs`` documents, at any level. First means the smallest ``doc_id``, null last; lines
    without a word stay. Null text stays null and counts as empty. Repeated rows are
    documents of their own with one id, and keep the same lines. An empty table gives
    no rows. A document is handled whole, at about ten bytes per byte of its text.
    """
    spark, others = docs.sparkSession, [c for c in docs.columns if c not in ("doc_id", "text")]
    scratch = Scratch(spark, "lines")
    carried = docs.select("doc_id", "text")
    if mode == "text":
        rest = F.struct(F.col("text").isNull().alias("missing"), F.struct(*map(column, others), F.lit(0).alias("_")).alias("row"))
        shape = docs.select(rest.alias("rest")).schema["rest"].dataType
        carried = docs.select("doc_id", "text", F.to_json(rest, EXACT).alias("extra"))
    store = Store(carried, scratch)

    def leaves():
        def f(batch):
            x = Lines(batch)
            yield from _counted(batch, x.leaf, x.doc, x.id)

        return f

    def words():
        def f(batch):
            x = Lines(batch)
            on = np.repeat(np.isin(x.leaf.view(np.int64), batch.known["leaf"]), x.n) & ~x.masked
            yield from _counted(batch, x.tokens()[on], np.repeat(x.doc, x.n)[on], np.repeat(x.id, x.n)[on])

        return f

    def templates(x: Lines, batch: Batch):
        some = np.isin(x.leaf.view(np.int64), batch.known["leaf"])
        words = np.repeat(some, x.n)
        at, found = _lookup(batch.known["word"], x.tokens()[words].view(np.int64))
        many = batch.known["word_docs"][at] if len(at) else np.full(len(found), min_docs)
        level = np.where(found & ~x.masked[words], (np.log(many / min_docs) / np.log(STEP)).astype(np.int64), -1)
        return x.templates(some, level, share)

    def patterns():
        def f(batch):
            x = Lines(batch)
            found = list(templates(x, batch))
            if found:
                line, key = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
                yield from _counted(batch, key, x.doc[line], x.id[line])

        return f

    leaf = _recurring(store.map(leaves, COUNTED), min_docs, scratch, "leaf", "low")
    leaf = leaf.select("batch", "leaf")
    word = _recurring(store.map(words, COUNTED, leaf), min_docs, scratch, "word", "docs")
    template = _recurring(store.map(patterns, COUNTED, leaf, word), min_docs, scratch, "template", "low")

    def make():
        def f(batch: Batch):
            x = Lines(batch)
            gone = np.zeros(len(x.first), bool)
            for line, key in templates(x, batch):
                at, found = _lookup(batch.known["template"], key.view(np.int64))
                if len(at):
                    gone[line] |= found & (x.id[line] > batch.known["template_low"][at])
            edge = np.searchsorted(x.doc, np.arange(len(batch.ids) + 1))
            drop = np.add.reduceat(np.append(gone, False).astype(np.int64), edge[:-1]) * (np.diff(edge) > 0)
            texts = []
            for d in range(len(batch.ids)):
                text = batch.text(d)
                if drop[d]:
                    out = set(x.number[edge[d] : edge[d + 1]][gone[edge[d] : edge[d + 1]]].tolist())
                    text = b"\n".join([line for i, line in enumerate(text.split(b"\n")) if i not in out])
                texts.append(text)
            ids = pa.array(batch.ids, pa.int64())
            if mode == "text":
                yield ids, pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string()), pa.array(batch.extra, pa.string())
            else:
                yield ids, np.diff(edge), drop, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())

        return f

    if mode == "text":
        out = store.map(make, "doc_id long, text string, extra string", leaf, word, template)
        out = out.select("doc_id", "text", F.from_json("extra", shape, EXACT).alias("x")).withColumn("text", F.when(~F.col("x.missing"), F.col("text")))

        def value(c: str) -> Column:
            return F.col(c) if c in ("doc_id", "text") else F.length("text").cast("long") if c == "n_chars" else F.col("x.row")[c]

        out = out.select(*[value(c).alias(c) for c in docs.columns])
    else:
        out = store.map(make, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", leaf, word, template)
    out = scratch.keep(out, "result")
    store.drop()
    return out
