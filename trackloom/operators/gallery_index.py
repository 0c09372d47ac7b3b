"""Exact votes of the nearest prototypes through a metric index.

Prototypes are grouped around centres; a group and label is described by how many it
holds and how far they reach from the centre. The angle between a query and a centre,
less that reach, bounds what any of them can score. A query visits the groups of its
best bounds first. What it has found then rules out labels, and within the labels left
all groups whose bound doesn't beat the query's third best; it visits the others in a
second step, and its two best labels are exact. Visits are rows: an equi-join of blocks
of queries and blocks of prototypes that share a group, each pair one matrix product.
Where a sample of the queries would visit more than a small share of a large gallery,
all pairs are compared in tiles instead (:mod:`gallery_tiles`), with the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackloom.operators import gallery_tiles
from trackloom.plans.runtime import Scratch, ship

#: Bytes of centres and of group descriptions that go to every task; groups at most.
CENTRE_BYTES, DESCRIBED, GROUPS = 16_000_000, 200_000, 4096
QUERIES, ROWS, PROBE = 512, 2048, 4
#: Pairs of blocks, of a MB or two each, that a task holds at a time.
PAIRS = 4
#: Visits that a task gives out at a time, each with its query's vector.
VISITS = 8192
#: Queries times prototypes from which a sample of so many queries is asked first, and the
#: share of the gallery it may visit; it decides speed, never results.
ASKED, SAMPLE, SHARE = 50_000_000, 256, 0.02
SLACK = 1e-7


@dataclass
class Index:
    """Centres, and per group and label (by number) the size and the reach."""

    centres: np.ndarray
    labels: list
    size: np.ndarray
    reach: np.ndarray
    blocks: DataFrame | None = None
    assigned: DataFrame | None = None
    counts: DataFrame | None = None

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds (group, label) on the cosine of ``q`` and a member."""
        angle = np.arccos(np.clip(self.centres @ q, -1, 1))
        top = np.cos(np.maximum(angle[:, None] - self.reach, 0)) + SLACK
        top[-1] = SLACK  # zero vectors
        return np.where(self.size > 0, top, -np.inf)

    def first(self, top: np.ndarray) -> np.ndarray:
        """The groups a query visits at once."""
        best = top.max(axis=1)
        return np.sort(np.argsort(-best, kind="stable")[:PROBE])

    def second(self, q: np.ndarray, found: dict[int, list[float]], k: int, best_two: bool) -> tuple[list[int], np.ndarray]:
        """Labels that may still be the best (or among the best two), and the groups to visit."""
        top = self.bounds(q)
        seen = self.first(top)
        left = top.copy()
        left[seen] = -np.inf
        total = self.size.sum(axis=0)
        low, high, third = (np.full(len(self.labels), -np.inf) for _ in range(3))
        for j in range(len(self.labels)):
            need = min(k, int(total[j]))
            if not need:
                continue
            sims = sorted(found.get(j, []), reverse=True)[:need]
            low[j] = (sum(sims) - (need - len(sims))) / need
            third[j] = sims[-1] if len(sims) == need else -np.inf
            open_ = left[:, j]
            rest = np.repeat(open_, np.minimum(self.size[:, j], need) * (open_ > -np.inf))
            best = np.sort(np.concatenate((sims, rest)))[::-1][:need]
            high[j] = best.sum() / need
        limit = low.max() if not best_two else np.sort(low)[-2] if len(low) > 1 else -np.inf
        play = np.flatnonzero(high >= limit - SLACK)
        visit = (left[:, play] > third[play] - SLACK) & (left[:, play] > -np.inf)
        return play.tolist(), np.flatnonzero(visit.any(axis=1))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _units(df: DataFrame, name: str) -> DataFrame:
    """``(name, v)``: rows with a vector, as unit vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = gallery_tiles.unit_rows(batch.column("vector"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]) if v.size else np.zeros(len(v) + 1), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(name), flat], names=[name, "v"])

    kind = df.schema[name].dataType.simpleString()
    return df.where("vector is not null").select(name, "vector").mapInArrow(run, f"{name} {kind}, v array<double>")


def build(prototypes: DataFrame, scratch: Scratch, groups: int | None = None, rows: int = ROWS) -> Index:
    """An index of unit vectors ``(label, v)``, all of one length. Centres are the
    ``groups`` vectors of least hash (by default as many as the root of their number,
    bounded): a sample that decides speed, never results."""
    spark = prototypes.sparkSession
    ship(spark)
    prototypes = scratch.keep(prototypes, "units")
    said = prototypes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).orderBy("label").limit(DESCRIBED + 1).collect()
    labels, n, dim = [r["label"] for r in said], sum(r["n"] for r in said), max((r["dim"] for r in said), default=1)
    if len(labels) > DESCRIBED:
        raise ValueError("an index describes each label of a group: too many labels")
    most = max(1, min(groups or GROUPS, CENTRE_BYTES // (8 * dim), DESCRIBED // max(1, len(labels))))
    h = F.xxhash64("v")
    sample = prototypes.where(F.exists("v", lambda x: x != 0)).select("v").orderBy(h, "v").limit(groups or int(n**0.5) + 1).collect()
    centres = np.unique(np.array([r["v"] for r in sample[:most]], float).reshape(-1, dim), axis=0)
    centres = np.vstack((centres, np.zeros((1, dim))))  # the last group holds zero vectors
    number = {k: i for i, k in enumerate(labels)}
    kind = to_arrow_type(prototypes.schema["label"].dataType)

    def assign(batches):
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            v = _vectors(batch.column("v"))
            sim = v @ centres.T
            group = np.where(np.any(v != 0, axis=1), np.argmax(sim[:, :-1], axis=1) if len(centres) > 1 else 0, len(centres) - 1)
            near = np.clip(sim[np.arange(len(v)), group], -1, 1)
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), batch.column("label"), batch.column("v"), pa.array(np.arccos(near))], names=["group", "label", "v", "angle"])

    simple = prototypes.schema["label"].dataType.simpleString()
    assigned = scratch.keep(prototypes.select("label", "v").mapInArrow(assign, f"group int, label {simple}, v array<double>, angle double"), "assigned")
    scratch.drop("units")
    size, reach = np.zeros((len(centres), len(labels)), np.int64), np.zeros((len(centres), len(labels)))
    for r in assigned.groupBy("group", "label").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect():  # bounded above
        size[r["group"], number[r["label"]]], reach[r["group"], number[r["label"]]] = r["n"], r["reach"]
    many = assigned.groupBy("group").agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = assigned.join(F.broadcast(many), "group").withColumn("part", F.pmod(F.monotonically_increasing_id(), "parts"))

    def numbered(batches):
        for batch in batches:
            at = pa.array([number[k] for k in batch.column("label").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("part"), at, batch.column("v")], names=["group", "part", "label", "v"])

    assert kind is not None
    blocks = dealt.select("group", "part", "label", "v").mapInArrow(numbered, "group int, part long, label int, v array<double>")
    blocks = blocks.groupBy("group", "part").agg(F.collect_list("label").alias("labels"), F.flatten(F.collect_list("v")).alias("vs"))
    counts = assigned.groupBy("label").agg(F.count("*").alias("n"))
    return Index(centres, labels, size, reach, scratch.keep(blocks, "blocks"), assigned, counts)


def _visit(index: Index, visits: DataFrame, k: int, digits: int, scratch: Scratch, name: str) -> DataFrame:
    """``(qid, label, sims)``: the best of every pair of blocks. ``visits (group, qid, v)``."""
    kind = visits.schema["qid"].dataType
    visits = scratch.keep(visits, f"{name}-visits")
    many = visits.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    asked = visits.join(F.broadcast(many), "group").withColumn("q", F.pmod(F.monotonically_increasing_id(), "parts"))
    asked = asked.groupBy("group", "q").agg(F.collect_list("qid").alias("qids"), F.flatten(F.collect_list("v")).alias("qs"))
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qids, labels = batch.column("qids")[i].values, np.asarray(batch.column("labels")[i].values)
                q, p = (np.asarray(batch.column(c)[i].values, float) for c in ("qs", "vs"))
                dim = len(p) // len(labels)
                sim = np.round(q.reshape(-1, dim) @ p.reshape(-1, dim).T, digits)
                for j in np.unique(labels).tolist():
                    x = -sim[:, labels == j]
                    best = -np.partition(x, k - 1, axis=1)[:, :k] if x.shape[1] > k else -x
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1]), pa.int32()), pa.array(best.ravel()))
                    yield pa.RecordBatch.from_arrays([qids.cast(arrow), pa.array(np.full(len(qids), j, np.int32)), flat], names=["qid", "label", "sims"])

    pairs = asked.join(index.blocks, "group").select("qids", "qs", "labels", "vs")
    return scratch.keep(pairs.mapInArrow(run, f"qid {kind.simpleString()}, label int, sims array<double>"), name, batch_rows=PAIRS)


def votes(queries: DataFrame, prototypes: DataFrame, scratch: Scratch, top: int = 3, digits: int = 9, groups: int | None = None, rows: int = ROWS, margin: bool = True) -> DataFrame:
    """``(qid, label, score, margin)``: the label whose ``top`` nearest prototypes are
    closest on average by cosine, the least label on ties, and how far the next one is
    behind (null where there is one label). Without ``margin`` that is null and only the
    best label need be exact, which takes fewer visits. ``qid`` names a row. Similarities and
    scores are rounded before they are compared; null vectors are left out, all others
    have one length."""
    spark = queries.sparkSession
    ship(spark)
    q, p = _units(queries, "qid"), _units(prototypes, "label")
    index = build(p, scratch, groups, rows)
    centres, labels, size, reach = index.centres, index.labels, index.size, index.reach
    kinds = q.schema["qid"].dataType.simpleString(), p.schema["label"].dataType.simpleString()
    if not labels:
        return spark.createDataFrame([], f"qid {kinds[0]}, label {kinds[1]}, score double, margin double")

    def said(qids: pa.Array, v: pa.Array, where: Sequence[tuple[int, int]]) -> pa.RecordBatch:
        at = pa.array([i for i, _ in where], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([g for _, g in where], pa.int32()), qids.take(at), v.take(at)], names=["group", "qid", "v"])

    def first(batches):
        local = Index(centres, labels, size, reach)
        for batch in (b.slice(i, VISITS // PROBE) for b in batches for i in range(0, b.num_rows, VISITS // PROBE)):
            v = _vectors(batch.column("v"))
            yield said(batch.column("qid"), batch.column("v"), [(i, g) for i in range(len(v)) for g in local.first(local.bounds(v[i])).tolist()])

    def second(batches):
        local = Index(centres, labels, size, reach)
        for batch in batches:
            v, known, play = batch.column("v"), batch.column("found"), []

            def visits(v=v, known=known, play=play):
                for i in range(len(v)):
                    found: dict[int, list[float]] = {}
                    for r in known[i].as_py() or []:
                        found.setdefault(r["label"], []).extend(r["sims"])
                    labels_left, groups_left = local.second(np.asarray(v[i].values, float), found, top, margin)
                    play.append(labels_left)
                    yield from [(i, g) for g in groups_left.tolist()] or [(i, -1)]

            for where in batched(visits(), VISITS):
                out = said(batch.column("qid"), v, where)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([play[i] for i, _ in where], pa.list_(pa.int32()))], names=["group", "qid", "v", "play"])

    ddl = f"group int, qid {kinds[0]}, v array<double>"

    def planned(asked: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        near = _visit(index, asked.mapInArrow(first, ddl), top, digits, scratch, f"{name}first")
        best = near.groupBy("qid", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("sims")), asc=False), 1, top).alias("sims"))
        found = best.groupBy("qid").agg(F.collect_list(F.struct("label", "sims")).alias("found"))
        return near, scratch.keep(asked.join(found, "qid", "left").mapInArrow(second, f"{ddl}, play array<int>"), f"{name}plan")

    def ranked(scored: DataFrame) -> DataFrame:
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "label")
        return scored.withColumns({"r": F.row_number().over(w), "next": F.lead("score").over(w)}).where("r = 1")

    behind = F.col("score") - F.col("next") if margin else F.lit(None).cast("double")
    asked, held = q.count(), int(size.sum())
    if asked * held > ASKED:
        some = scratch.keep(q.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE), "sample")
        _, plan = planned(some, "sample-")
        many = dict(enumerate(size.sum(axis=1).tolist()))
        visited = sum(r["n"] * many.get(r["group"], 0) for r in plan.groupBy("group").agg(F.count("*").alias("n")).collect())  # a row per group
        if visited > SHARE * min(asked, SAMPLE) * held:
            scored = gallery_tiles.scores(q, index.assigned.select("label", "v"), index.counts, (asked, held), centres.shape[1], scratch, top, digits)
            return ranked(scored).select("qid", "label", "score", behind.alias("margin"))
    near, plan = planned(q, "")
    far = _visit(index, plan.where("group >= 0").select("group", "qid", "v"), top, digits, scratch, "second")
    every = near.unionByName(far).groupBy("qid", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("sims")), asc=False), 1, top).alias("sims"))
    play = plan.select("qid", "play").distinct()
    score = F.round(F.aggregate("sims", F.lit(0.0), lambda a, x: a + x) / F.size("sims"), digits)
    exact = every.join(play, "qid").where(F.array_contains("play", F.col("label"))).select("qid", "label", score.alias("score"))  # labels are numbered in order
    names = spark.createDataFrame(list(enumerate(labels)), f"label int, name {kinds[1]}")
    return ranked(exact).join(F.broadcast(names), "label").select("qid", F.col("name").alias("label"), "score", behind.alias("margin"))
