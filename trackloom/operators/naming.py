"""Tracks named exactly: a 0/1 search with pair terms, dealt out as rows.

Per match every track takes one of ``teams`` labels or is parked. The value is a sum of
scores per track and label and of weights per pair that shares a label; some pairs
never may, some labels are pinned, and each label is used at least once. The best
labelling is found by branch and bound. A search that reaches its budget of nodes
hands back what it left open as rows, which Spark deals out for the next round together
with the best value any search of the match has found, so a hard match spreads over
tasks, and every answer is proven.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.joins import within_window
from trackloom.plans.runtime import Scratch, ship

#: Takes the place of a weight that forbids; values stay far below it.
NEVER = -(1 << 44)


class Search:
    """Branch and bound of one match. Labels 0 to ``teams - 1``, then parked."""

    def __init__(self, scores: np.ndarray, pairs: list[tuple[int, int, int]], pins: dict[int, int], differ: list[int] | None = None):
        self.n, self.teams = scores.shape[0], scores.shape[1] - 1
        self.scores = scores.copy()
        for i, k in pins.items():
            keep = self.scores[i, k]
            self.scores[i] = NEVER
            self.scores[i, k] = keep
        self.w = np.zeros((self.n, self.n), np.int64)
        for i, j, v in pairs:
            self.w[i, j] = self.w[j, i] = max(self.w[i, j] + v, NEVER)
        # from a track on: pairs that could only add, and each track's costliest earlier partner
        up = np.triu(np.maximum(self.w, 0), 1)
        self.gain = np.array([up[d:, d:].sum() for d in range(self.n + 1)])
        self.differ = differ
        self.last = max((i for i, k in enumerate(differ) if k < self.teams), default=-1) if differ else -1

    def bound(self, depth: int, open_: np.ndarray) -> int:
        """No completion is worth more than this: tracks left over a tree of pairs, the
        dearest earlier one for each, exactly; other pairs only where they add."""
        n, t = self.n, self.teams
        best, total, free = open_.copy(), 0, int(self.gain[depth])
        for j in range(n - 1, depth, -1):
            p = depth + int(np.argmin(self.w[depth:j, j]))
            w, row = int(self.w[p, j]), best[j - depth]
            if w >= 0:
                total += int(row.max())
                continue
            first = int(row.argmax())
            top = int(row[first])
            total += top
            if first < t:  # only where the partner takes this label as well is there a loss
                row[first] = NEVER
                best[p - depth, first] -= min(top - int(row.max()), -w)
        return total + (int(best[0].max()) if depth < n else 0) + free

    def run(self, start: list[int], value: int | None, labels: list[int] | None, budget: int):
        """From a prefix: (best value, its labels, prefixes left open); ties go to the
        labels that come first in order."""
        n, t = self.n, self.teams
        open_, worth = self.scores.copy(), 0
        for d, k in enumerate(start):
            worth += int(open_[d, k])
            if k < t:
                open_[:, k] += self.w[d]
        stack = [(list(start), worth, open_[len(start) :], sum(1 << k for k in set(start) if k < t))]
        nodes = 0
        while stack:
            if nodes >= budget:
                return value, labels, [s[0] for s in stack]
            prefix, worth, open_, used = stack.pop()
            nodes += 1
            d = len(prefix)
            if worth < NEVER // 2 or t - used.bit_count() > n - d:
                continue
            if self.differ and d > self.last and prefix[: self.last + 1] and all(a == b or b == t for a, b in zip(prefix, self.differ, strict=False)):
                continue  # says what it must not
            if d == n:
                if value is None or (worth, [-k for k in prefix]) > (value, [-k for k in labels]):
                    value, labels = worth, prefix
                continue
            if value is not None:
                most = worth + int(open_.max(axis=1).sum()) + int(self.gain[d])
                if most >= value:
                    most = min(most, worth + self.bound(d, open_))
                if most < value or most == value and prefix > labels[:d]:
                    continue
            for k in np.argsort(open_[0], kind="stable").tolist():
                gained = int(open_[0, k])
                if gained > NEVER // 2:
                    rest = open_[1:].copy()
                    if k < t:
                        rest[:, k] += self.w[d, d + 1 :]
                    stack.append(([*prefix, k], worth + gained, rest, used | (1 << k if k < t else 0)))
        return value, labels, []


def problems(tracks: DataFrame, scores: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """A row per match, bounded by its tracks and pairs: what a search reads.

    ``tracks (key, i, park, pin)`` with ``i`` from 0 on in order of search, ``scores
    (key, i, k, score)``, ``pairs (key, i, j, weight)`` where a null weight forbids.
    Pins beat forbidden pairs: two tracks pinned to one label may share it.
    """
    t = tracks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "park", "pin"))).alias("tracks"))
    s = scores.groupBy(key).agg(F.collect_list(F.struct("i", "k", "score")).alias("scores"))
    pins = tracks.where("pin is not null").select(key, "i", "pin")
    both = pairs.join(pins.withColumnRenamed("pin", "_p"), [key, "i"], "left").join(pins.select(key, F.col("i").alias("j"), F.col("pin").alias("_q")), [key, "j"], "left")
    free = both.where(F.col("weight").isNotNull() | F.col("_p").isNull() | F.col("_q").isNull() | (F.col("_p") != F.col("_q")))
    p = free.groupBy(key).agg(F.collect_list(F.struct("i", "j", F.coalesce("weight", F.lit(NEVER)).alias("weight"))).alias("pairs"))
    return t.join(s, key, "left").join(p, key, "left")


def solve(found: DataFrame, key: str, teams: int, scratch: Scratch, budget: int = 5000, differ: DataFrame | None = None, name: str = "named") -> DataFrame:
    """``(key, value, labels)`` of every match of :func:`problems`: the best labelling,
    proven, the first in order on ties; nulls where there is none.

    ``differ (key, labels)``: answers that don't count, nor do those that only name
    what it parks.
    """
    ship(found.sparkSession)
    kind = found.schema[key].dataType.simpleString()
    base = found if differ is None else found.join(differ.select(key, F.col("labels").alias("differ")), key)
    out = pa.schema([("labels", pa.list_(pa.int32())), ("value", pa.int64()), ("open", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(key), batch.to_pylist()
            took, said = [], []
            for at, r in enumerate(rows):
                n = len(r["tracks"])
                scores = np.zeros((n, teams + 1), np.int64)
                for s in r["scores"] or []:
                    scores[s["i"], s["k"]] += s["score"]
                scores[:, teams] = [x["park"] for x in r["tracks"]]
                pins = {i: x["pin"] for i, x in enumerate(r["tracks"]) if x["pin"] is not None}
                search = Search(scores, [(p["i"], p["j"], p["weight"]) for p in r["pairs"] or []], pins, r.get("differ"))
                value, labels, left = search.run(r["open"], r["value"], r["labels"], budget)
                for x in [{"labels": labels, "value": value, "open": None}, *[{"labels": None, "value": None, "open": o} for o in left]]:
                    took.append(at)
                    said.append(x)
            table = pa.RecordBatch.from_pylist(said, schema=out)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(took, pa.int64())), *table.columns], names=[key, "labels", "value", "open"])

    best = base.select(key, F.lit(None).cast("long").alias("value"), F.lit(None).cast("array<int>").alias("labels"))
    left = base.select(key, F.array().cast("array<int>").alias("open"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = 0
    while True:
        work = left.join(base, key).join(best, key).repartition(parts)
        state = scratch.keep(work.mapInArrow(run, f"{key} {kind}, labels array<int>, value long, open array<int>"), f"{name}-{k}")
        known = best.select(key, "value", "labels").unionByName(state.where("open is null").select(key, "value", "labels"))
        top = F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("value"), F.col("labels").alias("labels"))))
        best = scratch.keep(known.groupBy(key).agg(top.alias("_b")).select(key, (-F.col("_b.col1")).alias("value"), F.col("_b.labels").alias("labels")), f"{name}-best-{k}")
        left = state.where("open is not null").select(key, "open")
        k += 1
        if not left.limit(1).count():
            return best


def named(found: DataFrame, key: str, teams: int, scratch: Scratch, budget: int = 5000) -> DataFrame:
    """``(key, i, label, other, unstable, value, gap)`` per track: its label (null:
    parked), the one in the best answer that differs, and by how much that one is worse
    (nulls where there is no other answer)."""
    found = scratch.keep(found, "problems")
    first = solve(found, key, teams, scratch, budget)
    second = solve(found, key, teams, scratch, budget, first.where("labels is not null"), "other")
    j = first.where("labels is not null").join(second.select(key, F.col("value").alias("_v"), F.col("labels").alias("_l")), key, "left")
    one = j.select(key, "value", (F.col("value") - F.col("_v")).alias("gap"), F.col("_l"), F.posexplode("labels").alias("i", "_k"))
    other = F.get("_l", F.col("i"))
    shown = lambda c: F.when(c < teams, c)
    return one.select(key, "i", shown(F.col("_k")).alias("label"), shown(other).alias("other"), F.coalesce(other != F.col("_k"), F.lit(False)).alias("unstable"), "value", "gap")


def park_cost(n: Column, weight: float = 40) -> Column:
    """What parking a track of ``n`` detections costs: more for long ones."""
    return -F.floor(F.lit(weight) * F.log1p(n)).cast("long")


def vote_score(votes: Column, wrong_side: Column, sureness: Column, vote: int = 10, side: int = 250) -> Column:
    """A label's votes, less a penalty by how sure the track's other colour is."""
    penalty = F.round(F.lit(float(side)) * F.coalesce(sureness, F.lit(1.0))).cast("long")
    return votes * vote - F.when(wrong_side, penalty).otherwise(F.lit(0))


def pair_costs(tracks: DataFrame, key: str, furthest: float = 25.0, jump: int = 120, gap: int = 2, cap: float = 3.0) -> DataFrame:
    """``(key, i, j, weight)`` of track pairs that follow each other within
    ``furthest`` seconds: the gap costs, and so does a distance beyond the envelope,
    by its excess. ``tracks (key, i, t0, x0, y0, t1, x1, y1)``."""
    a = tracks.select(key, F.col("i").alias("a"), F.col("t1").alias("a_t"), F.col("x1").alias("a_x"), F.col("y1").alias("a_y"))
    b = tracks.select(key, F.col("i").alias("b"), F.col("t0").alias("b_t"), F.col("x0").alias("b_x"), F.col("y0").alias("b_y"))
    near = within_window(a, b, [key], "a_t", "b_t", furthest).where("a != b and a_t <= b_t").withColumn("_gap", F.col("b_t") - F.col("a_t"))
    budget, far = S.distance_budget("_gap"), F.hypot(F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y"))
    over = F.when(far > budget, F.floor(jump * F.least((far - budget) / budget, F.lit(cap)))).otherwise(0)
    cost = (over + F.floor(gap * F.col("_gap"))).cast("long")
    one = near.select(key, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), (-cost).alias("weight"))
    return one.groupBy(key, "i", "j").agg(F.max("weight").alias("weight")).where("weight != 0")
