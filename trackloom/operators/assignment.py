"""Grouping and assignment per bounded group: small matrices, boxes, colours."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.plans.runtime import ship


def best_permutations(cost: Column, n: int) -> Column:
    """The exact assignment of ``n`` rows to columns (7 at most) of ``cost``, an array of
    arrays: a struct of its cost (rounded to 9 digits, so that orders of one cost tie) and
    each row's column, the first in order on ties."""
    if not 0 < n <= 7:
        raise ValueError("an order of 1 to 7 rows")
    orders = F.array(*[F.array(*map(F.lit, p)) for p in permutations(range(n))])

    def priced(order: Column) -> Column:
        total = F.lit(0.0)
        for i in range(n):
            total = total + F.get(F.get(cost, F.lit(i)), F.get(order, F.lit(i)))
        return F.struct(F.round(total, 9).alias("cost"), order.alias("columns"))

    return F.array_min(F.transform(orders, priced))


def name_groups(groups: DataFrame, votes: DataFrame, teams: DataFrame, key: str, n: int, base: float = 50.0, share: float = 100.0, wrong: float = 500.0) -> DataFrame:
    """``(key, g, team, cost)``: the cheapest naming of up to ``n`` groups by teams.

    A team costs a group ``base`` less ``share`` times its part of the group's votes,
    and ``wrong`` more if the group's side is known and another one. Groups ``(key, g,
    side)`` and teams ``(key, k, team, side)`` are numbered from 0 below ``n``, ``votes
    (key, g, team, n)``; places that neither fills cost ``base``. Orders are tried all,
    per match as one expression; the first in order on ties. Everything goes by ``key``
    alone: tables dealt out by it are not shuffled again.
    """
    gs = groups.groupBy(key).agg(F.collect_list(F.struct("g", "side")).alias("_gs"))
    ts = teams.groupBy(key).agg(F.collect_list(F.struct("k", "team", "side")).alias("_ts"))
    vs = votes.groupBy(key).agg(F.collect_list(F.struct("g", "team", F.col("n").cast("double").alias("n"))).alias("_vs"))
    d = gs.join(ts.hint("merge"), key).join(vs.hint("merge"), key, "left")

    def counted(holds) -> Column:
        return F.aggregate(F.filter("_vs", holds), F.lit(0.0), lambda x, v: x + F.coalesce(v["n"], F.lit(0.0)))

    def first(of: str, place: str, i: int) -> Column:
        return F.get(F.filter(of, lambda x: x[place] == i), F.lit(0))

    def priced(g: Column, t: Column, all_: Column) -> Column:
        own = counted(lambda v: (v["g"] == g["g"]) & (v["team"] == t["team"]))
        part = F.when(all_ > 0, own * share / all_).otherwise(0.0)
        off = F.coalesce(g["side"] != t["side"], F.lit(False))
        return F.when(g.isNotNull() & t.isNotNull(), F.lit(base) - part + F.when(off, wrong).otherwise(0.0)).otherwise(base)

    def votes_of(i: int) -> Column:
        return counted(lambda v: v["g"] == i)

    places = range(n)
    d = d.withColumns({f"_g{i}": first("_gs", "g", i) for i in places} | {f"_t{j}": first("_ts", "k", j) for j in places} | {f"_n{i}": votes_of(i) for i in places})
    d = d.withColumn("_m", F.array(*[F.array(*[priced(F.col(f"_g{i}"), F.col(f"_t{j}"), F.col(f"_n{i}")) for j in places]) for i in places])).withColumn("_best", best_permutations(F.col("_m"), n))

    def won(g: Column) -> Column:
        k = F.when(g["g"].between(0, n - 1), F.get("_best.columns", g["g"].cast("int")))
        return F.transform(F.filter("_ts", lambda t: t["k"] == k), lambda t: F.struct(g["g"].cast("int").alias("g"), t["team"].alias("team")))

    named = d.select(key, F.col("_best.cost").alias("cost"), F.explode(F.flatten(F.transform("_gs", won))).alias("_w"))
    return named.select(key, "_w.g", "_w.team", "cost")


def fused_boxes(boxes: Column, gap: float = 18.0, level: float = 0.5) -> Column:
    """Pieces of one kind fused to whole boxes, as an array of structs ``(kind, x1, y1,
    x2, y2, n)``. ``boxes``: an array of structs ``(kind, x1, y1, x2, y2)``.

    By kind and left edge, and their order in the array on ties, a piece joins the
    first box of its kind that is level with it (their heights overlap by ``level`` of
    the smaller one) and at most ``gap`` away sideways; that box grows. A fold over the
    boxes of one image.
    """
    shape = "struct<kind:string,x1:double,y1:double,x2:double,y2:double,n:int>"
    keyed = F.transform(boxes, lambda b, i: F.struct(b["kind"].cast("string").alias("kind"), b["x1"].cast("double").alias("x1"), i.alias("i"), b["y1"].cast("double").alias("y1"), b["x2"].cast("double").alias("x2"), b["y2"].cast("double").alias("y2")))

    def box(kind, x1, y1, x2, y2, n) -> Column:
        return F.struct(kind.alias("kind"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), n.alias("n")).cast(shape)

    def joins(m: Column, b: Column) -> Column:
        shared = F.least(b["y2"], m["y2"]) - F.greatest(b["y1"], m["y1"])
        flat = F.least(b["y2"] - b["y1"], m["y2"] - m["y1"])
        return (m["kind"] == b["kind"]) & (shared > 0) & (shared >= flat * level) & (F.greatest(b["x1"], m["x1"]) - F.least(b["x2"], m["x2"]) <= gap)

    def step(done: Column, b: Column) -> Column:
        at = F.array_position(F.transform(done, lambda m: joins(m, b)), F.lit(True))
        grown = F.transform(done, lambda m, i: F.when(i + 1 == at, box(m["kind"], F.least(m["x1"], b["x1"]), F.least(m["y1"], b["y1"]), F.greatest(m["x2"], b["x2"]), F.greatest(m["y2"], b["y2"]), m["n"] + 1)).otherwise(m))
        return F.when(at > 0, grown).otherwise(F.concat(done, F.array(box(b["kind"], b["x1"], b["y1"], b["x2"], b["y2"], F.lit(1))))).cast(f"array<{shape}>")

    return F.aggregate(F.sort_array(keyed), F.array().cast(f"array<{shape}>"), step)


#: Matches that are Python objects at once; an Arrow batch may hold thousands.
_MATCHES = 16


class _Groups:
    """The groups of one match while its tracks are dealt out, as columns over groups."""

    def __init__(self, most: int, sides: list[str], teams: list[str]):
        self.open, self.end = 0, np.zeros((most, 3))
        self.sides, self.votes = np.zeros((most, len(sides)), int), np.zeros((most, len(teams)), int)
        self.side_of, self.team_of = {s: i for i, s in enumerate(sides)}, {t: i for i, t in enumerate(teams)}
        self.barred: list[set] = [set() for _ in range(most)]

    def costs(self, r: dict, votes: np.ndarray, speed: float, gap_cost: float, far_cost: float, other_vote: float, other_side: float) -> np.ndarray:
        n = self.open
        gap = np.maximum(r["t0"] - self.end[:n, 0], 0)
        budget = speed * np.maximum(gap, 0.1) + 1.0
        cost = gap_cost * gap + far_cost * np.maximum(np.hypot(r["x0"] - self.end[:n, 1], r["y0"] - self.end[:n, 2]) - budget, 0) / budget
        if r["side"] is not None:
            cost += other_side * (self.sides[:n].any(axis=1) & (self.sides[:n].argmax(axis=1) != self.side_of[r["side"]]))
        if votes.any():
            cost += other_vote * (self.votes[:n].any(axis=1) & (self.votes[:n].argmax(axis=1) != votes.argmax()))
        return np.where([r["tid"] in b for b in self.barred[:n]], np.inf, cost)

    def add(self, g: int, r: dict, votes: np.ndarray, company: set) -> None:
        self.open = max(self.open, g + 1)
        self.end[g] = r["t1"], r["x1"], r["y1"]
        self.votes[g] += votes
        self.barred[g] |= company
        if r["side"] is not None:
            self.sides[g, self.side_of[r["side"]]] += 1


def colour_tracks(tracks: DataFrame, together: DataFrame, votes: DataFrame, key: str, groups: int = 6, speed: float = 5.5, gap_cost: float = 2.0, far_cost: float = 12.0, other_vote: float = 60.0, other_side: float = 1e6) -> DataFrame:
    """``(key, tid, g)``: the tracks of each match dealt to ``groups`` robots, -1 for
    those that no group can take.

    By start (longer ones first, then by ``tid``) a track joins the cheapest group that
    holds none it was seen with; a new group opens where there is none, or only one of
    the other side. Costs: the time unobserved, a distance beyond ``speed``, another
    majority of votes, another majority of sides; the first in order on ties. ``tracks
    (key, tid, t0, x0, y0, t1, x1, y1, n, side)``, ``together (key, a, b)``, ``votes
    (key, tid, team, n)``. A match is one row, bounded by its tracks; matches are
    coloured in parallel.
    """
    ship(tracks.sparkSession)
    kind = tracks.schema[key].dataType.simpleString()
    both = together.select(key, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    one = tracks.groupBy(key).agg(F.collect_list(F.struct("tid", "t0", "x0", "y0", "t1", "x1", "y1", "n", "side")).alias("tracks"))
    one = one.join(both.groupBy(key).agg(F.collect_list("p").alias("pairs")), key, "left")
    one = one.join(votes.groupBy(key).agg(F.collect_list(F.struct("tid", "team", "n")).alias("votes")), key, "left")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, _MATCHES):
                part = batch.slice(lo, _MATCHES)
                took, tids, where = [], [], []
                for at, m in enumerate(part.to_pylist()):
                    rows = sorted(m["tracks"], key=lambda r: (r["t0"], -r["n"], r["tid"]))
                    company: dict = {}
                    for p in m["pairs"] or []:
                        company.setdefault(p["a"], set()).add(p["b"])
                    teams = sorted({v["team"] for v in m["votes"] or []})
                    state = _Groups(groups, sorted({r["side"] for r in rows if r["side"] is not None}), teams)
                    tally = {r["tid"]: np.zeros(len(teams), int) for r in rows}
                    for v in m["votes"] or []:
                        if v["tid"] in tally:
                            tally[v["tid"]][state.team_of[v["team"]]] += v["n"]
                    for r in rows:
                        mine = tally[r["tid"]]
                        cost = state.costs(r, mine, speed, gap_cost, far_cost, other_vote, other_side)
                        g = int(cost.argmin()) if len(cost) else -1
                        if state.open < groups and (g < 0 or cost[g] >= other_side):
                            g = state.open
                        elif g < 0 or np.isinf(cost[g]):
                            g = -1
                        if g >= 0:
                            state.add(g, r, mine, company.get(r["tid"], set()))
                        took.append(at)
                        tids.append(r["tid"])
                        where.append(g)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(took, pa.int64())), pa.array(tids, pa.int64()), pa.array(where, pa.int32())], names=[key, "tid", "g"])

    return one.mapInArrow(run, f"{key} {kind}, tid long, g int")
