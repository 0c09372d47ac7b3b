"""Filter interaction audit by an incidence matrix product.

Five filters judge every document on its own, so what any order of them keeps,
removes or finds gone already follows from the set of filters a document fails: a
mask of five bits. The documents of a part come down to three histograms of 32 masks
(all, good, toxic), a row each. Stacked, they are multiplied by integer matrices of 32
masks by 600 columns (120 orders of 5 steps), one per outcome.

Copies: a text is named by 128 bits of its SHA-256. The smallest id of each name is a
minimum that Spark combines before it shuffles, and whether a row has that id is a
join on name and id together, so a text that a third of all rows share is no hot key.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrowio import map_rows, sliced, utf8
from trackloom.plans.runtime import Scratch, ship

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Stands for an id that is null: the largest.
LAST = (1 << 63) - 1


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()  # bytes split at exactly \x20 and \x09-\x0D
    points = len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    upper = len(text) - len(text.translate(None, UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def matrices() -> dict[str, np.ndarray]:
    """Per outcome the incidence of masks (rows) on order and step (columns)."""
    fails = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    here = fails[:, order]  # mask, order, step
    before = np.cumsum(here, axis=2) - here
    removed = here * (before == 0)
    by_filter = np.zeros((MASKS, STEPS), np.int64)
    for s in range(STEPS):
        for f in range(STEPS):
            by_filter[:, f] += removed[:, order[:, s] == f, s].sum(axis=1)
    out = {
        "kept": (before + here) == 0,
        "removed": removed,
        "redundant": here * (before > 0),
        "unique_fails": here * (fails.sum(axis=1) == 1)[:, None, None],
        "shapley": by_filter[:, order],
    }
    return {k: m.astype(np.int64).reshape(MASKS, -1) for k, m in out.items()}


def judged(docs: DataFrame, part: str = "source") -> DataFrame:
    """``(doc_id, part, mask, hi, lo)``: a row per row of ``docs``, its filters A to D
    and the name of its text. A null text is empty, a null part the empty string."""

    def make():
        def f(cols):
            for i, p, text in zip(*cols, strict=True):
                t = utf8(text)
                d = hashlib.sha256(t).digest()
                yield i, p or "", text_mask(t), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)

        return f

    rows = docs.select(F.col("doc_id").cast("long"), F.col(part).cast("string").alias("part"), "text")
    return map_rows(rows, "doc_id long, part string, mask int, hi long, lo long", make)


def histograms(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``(part, all, good, toxic)``: arrays of 32 counts by failure mask.

    Repeated rows count each time. A null ``doc_id`` counts as the largest (such rows
    fail E where an id has their text, and never make each other fail), has no label,
    and a document is good or toxic if any row of ``labels`` for it says so.
    """
    every = Scratch(docs.sparkSession, "audit").keep(judged(docs, part).withColumn("id", F.coalesce("doc_id", F.lit(LAST))), "judged")
    rows = every.groupBy("hi", "lo", "id", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = every.groupBy("hi", "lo").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.join(first, ["hi", "lo", "id"], "left").join(said, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(16)
    sums = known.groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )

    def stacked(name: str) -> Column:
        return F.array(*[F.coalesce(F.max(F.when(F.col("mask") == m, F.col(name))), F.lit(0)) for m in range(MASKS)]).alias(name)

    return sums.groupBy("part").agg(stacked("all"), stacked("good"), stacked("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley)``: 600 rows per part, zeros included.

    Filters: A under 200 words; B fewer than half of the words different; C over 2 % of
    the code points in A-Z; D any of ``#$%&*|``; E the text of a smaller ``doc_id``,
    removed or not. Nulls and repeated rows as :func:`histograms` says; an empty table
    has no parts and gives no rows. A text is read whole, however long. Other columns are
    ignored, whatever their names.
    """
    ship(docs.sparkSession)
    stack = histograms(docs, labels, part)
    names = ["part", "filter_order", "step", *COUNTS]
    ddl = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])

    def run(batches):
        m = matrices()
        columns = len(ORDERS) * STEPS
        order, step = pa.array(np.repeat(ORDERS, STEPS)), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
        for batch in sliced(batches, 64):
            parts = batch.column("part").to_pylist()
            every, good, toxic = (np.asarray(batch.column(c).flatten()).reshape(len(parts), MASKS) for c in ("all", "good", "toxic"))
            made = {c: every @ m[c] for c in m} | {"good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"]}
            for i, p in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([p] * columns), order, step, *[pa.array(made[c][i]) for c in COUNTS]], schema=schema)

    return stack.mapInArrow(run, ddl).select(*names)
