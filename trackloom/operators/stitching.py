"""Fragments of tracks joined over gaps, in order of birth.

A fragment that is born may continue one that died. Who may continue whom is a set of
joins: near in time; behind one structure; or still on one spot. Who does is decided in
order of birth, each fragment claiming the best predecessor that no earlier one has
claimed, unless a runner-up scores too close. That order is no reason to go through
fragments one by one: :func:`claims` settles in each round all fragments whose outcome
earlier ones can't change any more, over all matches at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import graph
from trackloom.operators.joins import within_window
from trackloom.plans.runtime import Scratch


@dataclass(frozen=True)
class Gates:
    """Limits of a handoff; times in the unit of the fragments.

    ``max_gap`` bounds the plain path. Behind a structure a gap may last its transit
    time (``speed``, up to ``hidden``) or, parked, ``parked_gap`` at ``parked_move``.
    ``still`` (0: off) is how far a fragment may reappear after up to ``still_gap``.
    """

    max_gap: float
    speed: float = 1.0
    hidden: float = 20.0
    edge: float = 130.0
    parked_gap: float = 180.0
    parked_move: float = 60.0
    still: float = 0.0
    still_gap: float = 150.0


def fragments(samples: DataFrame, key: str, track: str, t: str, x: str, y: str, kind: str) -> DataFrame:
    """One row per track: ``t0, x0, y0, t1, x1, y1``, and its most frequent ``kind``
    (nulls have no vote; the least on ties). Equal times: by place."""
    at = F.struct(t, x, y)
    ends = samples.groupBy(key, track).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    votes = samples.where(F.col(kind).isNotNull()).groupBy(key, track, kind).agg(F.count("*").alias("n"))
    voted = votes.groupBy(key, track).agg(F.min_by(kind, F.struct(-F.col("n"), F.col(kind))).alias("kind"))
    one = [F.col(f"a.{t}").alias("t0"), F.col(f"a.{x}").alias("x0"), F.col(f"a.{y}").alias("y0"), F.col(f"b.{t}").alias("t1"), F.col(f"b.{x}").alias("x1"), F.col(f"b.{y}").alias("y1")]
    return ends.join(voted, [key, track], "left").select(key, F.col(track).alias("tid"), *one, "kind")


#: Corners of all outlines that are written out as expressions; more are folded per row.
CORNERS = 400


def _drawn_distance(x: str, y: str, poly: list, closed: bool) -> Column:
    """Distance to an outline of known corners, 0 from inside a closed one."""
    px, py, inside, far = F.col(x), F.col(y), F.lit(False), []
    sides = list(zip(poly, [*poly[1:], poly[0]], strict=True))
    for (ax, ay), (bx, by) in sides if closed else sides[:-1]:
        dx, dy = bx - ax, by - ay
        if dy:
            inside = inside != (((F.lit(ay) > py) != (F.lit(by) > py)) & (px < dx * (py - ay) / dy + ax))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else F.lit(0.0)
        far.append(F.hypot(px - (ax + t * dx), py - (ay + t * dy)))
    least = F.least(*far) if len(far) > 1 else far[0]
    return F.when(inside, 0.0).otherwise(least) if closed else least


def structure_at(points: DataFrame, x: str, y: str, structures: DataFrame, name: str, edge: float) -> DataFrame:
    """``points`` with the nearest structure (0 from inside a closed one) within
    ``edge``; the first by ``order`` on ties. ``structures (order, structure, poly,
    closed)`` is drawn by hand, a few outlines per camera: up to ``CORNERS`` corners are
    read and written out as plain expressions, more are folded into one row."""
    rows = structures.select("order", "structure", "poly", "closed").orderBy("order").limit(CORNERS).collect()
    if len(rows) < CORNERS and 0 < sum(len(r["poly"]) for r in rows) <= CORNERS and all(len(r["poly"]) > 1 for r in rows):
        near = F.array_min(F.array(*[F.struct(_drawn_distance(x, y, r["poly"], r["closed"]).alias("d"), F.lit(r["order"]).alias("o"), F.lit(r["structure"]).alias("structure")) for r in rows]))
        return points.withColumn("_near", near).withColumn(name, F.when(F.col("_near.d") <= edge, F.col("_near.structure"))).drop("_near")
    drawn = structures.agg(F.sort_array(F.collect_list(F.struct("order", "structure", "poly", "closed"))).alias("_drawn"))

    def distance(s: Column) -> Column:
        poly = s["poly"]
        return F.when(s["closed"] & S.inside_polygon(x, y, poly), 0.0).when(s["closed"], S.distance_to_outline(x, y, poly)).otherwise(S.distance_to_outline(x, y, poly, closed=False))

    near = F.array_min(F.transform("_drawn", lambda s: F.struct(distance(s).alias("d"), s["order"].alias("o"), s["structure"].alias("structure"))))
    return points.join(F.broadcast(drawn), F.lit(True)).withColumn("_near", near).withColumn(name, F.when(F.col("_near.d") <= edge, F.col("_near.structure"))).drop("_drawn", "_near")


def transit_times(structures: DataFrame, gates: Gates) -> DataFrame:
    """How long each structure may hide a robot: an open line up to the cap."""
    xs, ys = F.transform("poly", lambda p: p[0]), F.transform("poly", lambda p: p[1])
    across = F.hypot(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    hidden = F.when(F.col("closed"), S.hide_budget(across, F.lit(max(gates.speed, 1e-6)), gates.hidden)).otherwise(F.lit(gates.hidden))
    return structures.groupBy("structure").agg(F.min_by(hidden, "order").alias("transit"))


def handoffs(frags: DataFrame, key: str, gates: Gates, reach: Column, structures: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``(key, a, b, born, score, why)``: fragments ``b`` that may continue ``a``.

    ``frags (key, tid, t0, x0, y0, t1, x1, y1, kind)``; ``a`` ends before ``b`` starts,
    kinds agree (null fits all). Within ``max_gap`` the distance must be within
    ``reach``, a Column over ``gap``, and scores as its share. After longer gaps: both
    ends at one structure, in transit time or parked; else both on one spot. With
    ``scratch`` fragments and what they are at are written once, not worked out per join.
    """
    a, b = _ends(frags, key, gates, structures, scratch)
    plain = _measured(within_window(a, b, [key], "a_t", "b_t", gates.max_gap)).where(F.col("gap") <= gates.max_gap).withColumn("budget", reach)

    def out(pairs: DataFrame, score: Column, why: str) -> DataFrame:
        return pairs.select(key, "a", "b", F.col("b_t").alias("born"), score.alias("score"), F.lit(why).alias("why"))

    found = [out(plain.where("dist <= budget"), F.col("dist") / F.greatest("budget", F.lit(1e-9)), "near")]
    if structures is not None:
        far = _behind(a, b, key, gates).where(F.col("gap") > gates.max_gap)
        found.append(out(far, F.least(F.col("dist") / max(gates.parked_move, 1e-9), F.lit(0.99)), "hidden"))
    if gates.still > 0:
        cell = lambda x: F.floor(F.col(x) / gates.still)
        spread = F.explode(F.array(*[F.struct((cell("b_x") + i).alias("i"), (cell("b_y") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        here = a.withColumn("_c", F.struct(cell("a_x").alias("i"), cell("a_y").alias("j")))
        spot = _measured(within_window(here, b.withColumn("_c", spread), [key, "_c"], "a_t", "b_t", gates.still_gap))
        spot = spot.where((F.col("gap") > gates.max_gap) & (F.col("dist") <= gates.still) & ~_hidden(gates))
        found.append(out(spot, F.col("dist") / gates.still, "still"))
    return reduce(DataFrame.unionByName, found)


def _ends(frags: DataFrame, key: str, gates: Gates, structures: DataFrame | None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Ends ``a_*`` and starts ``b_*`` of fragments, with the structures they are at."""
    if structures is not None:
        ends = structure_at(structure_at(frags, "x1", "y1", structures, "end_at", gates.edge), "x0", "y0", structures, "start_at", gates.edge)
        frags = ends.join(F.broadcast(transit_times(structures, gates).withColumnRenamed("structure", "end_at")), "end_at", "left")
    else:
        frags = frags.withColumns({"end_at": F.lit(None).cast("string"), "start_at": F.lit(None).cast("string"), "transit": F.lit(None).cast("double")})
    if scratch is not None:
        frags = scratch.keep(frags, "ends")
    a = frags.select(key, F.col("tid").alias("a"), F.col("t1").alias("a_t"), F.col("x1").alias("a_x"), F.col("y1").alias("a_y"), F.col("kind").alias("a_kind"), F.col("end_at").alias("a_at"), "transit")
    b = frags.select(key, F.col("tid").alias("b"), F.col("t0").alias("b_t"), F.col("x0").alias("b_x"), F.col("y0").alias("b_y"), F.col("kind").alias("b_kind"), F.col("start_at").alias("b_at"))
    return a, b


def _measured(pairs: DataFrame) -> DataFrame:
    """Pairs of which one ends before the other starts, and kinds agree."""
    fits = (F.col("a") != F.col("b")) & (F.col("a_t") < F.col("b_t")) & S.compatible("a_kind", "b_kind")
    return pairs.where(fits).withColumns({"gap": F.col("b_t") - F.col("a_t"), "dist": F.hypot(F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y"))})


def _hidden(gates: Gates) -> Column:
    parked = S.parked("gap", "dist", gates.parked_gap, gates.parked_move)
    return F.coalesce((F.col("a_at") == F.col("b_at")) & ((F.col("gap") <= F.col("transit")) | parked), F.lit(False))


def _behind(a: DataFrame, b: DataFrame, key: str, gates: Gates) -> DataFrame:
    """Pairs that end and start at one structure, in transit time or parked."""
    longest = max(gates.hidden, gates.parked_gap)
    same = within_window(a.withColumn("_at", F.col("a_at")), b.withColumn("_at", F.col("b_at")), [key, "_at"], "a_t", "b_t", longest)
    return _measured(same).where(_hidden(gates))


def claims(edges: DataFrame, key: str, scratch: Scratch, margin: float = 1.5) -> DataFrame:
    """``(key, a, b, score)``: which handoffs hold, of ``edges (key, a, b, born, score)``.

    As if each ``b``, in order of ``(born, b)``, took the ``a`` of least ``(score, a)``
    that is still free, or none if the runner-up scores below ``margin`` times that.

    A round looks at all open fragments. An ``a`` is sure for ``b`` if no earlier open
    fragment can still take it; one that has a sure ``a`` can't take any that it ranks
    lower. A fragment is settled when its best is sure and so is the answer of the
    runner-up test; a taken ``a`` leaves the lists of those born later. The earliest
    open fragment of a match is always settled, most others soon after.
    """
    order = F.struct("born", "b")
    state = edges.select(key, "a", "b", F.col("born").cast("double").alias("born"), F.col("score").cast("double").alias("score")).withColumns({"live": F.lit(True), "verdict": F.lit(None).cast("string")})
    links, k = [], 0
    per_a = Window.partitionBy(key, "a")
    before = per_a.orderBy("born", "b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = Window.partitionBy(key, "b")
    rank = F.struct("score", "a")
    state = scratch.keep(state, "claims-0")
    while True:
        # rivals on each a: earlier ones still open, or the one that took it
        seen = state.withColumns({
            "rival": F.max(F.col("live") & F.col("verdict").isNull()).over(before),
            "taken": F.min(F.when(F.col("verdict") == "claims", order)).over(per_a),
        }).where(F.col("verdict").isNull() & (F.col("taken").isNull() | (order < F.col("taken"))))
        seen = seen.withColumn("sure", ~F.coalesce("rival", F.lit(False)))
        seen = seen.withColumns({"best": F.min(F.when(F.col("sure"), rank)).over(per_b), "doubt": F.min(F.when(~F.col("sure"), rank)).over(per_b)})
        seen = seen.withColumn("second", F.min(F.when(F.col("sure") & (rank > F.col("best")), F.col("score"))).over(per_b))
        limit = F.col("best.score") * margin
        first = F.col("best").isNotNull() & (F.col("doubt").isNull() | (F.col("best") < F.col("doubt")))
        close = F.coalesce(F.col("second") < limit, F.lit(False))
        clear = F.col("doubt").isNull() | (F.col("doubt.score") >= limit)
        mine = F.col("a") == F.col("best.a")
        said = F.when(first & close, F.lit("unclear")).when(first & clear, F.when(mine, F.lit("claims")).otherwise(F.lit("passes")))
        live = F.col("best").isNull() | (rank <= F.col("best"))
        k += 1
        state = scratch.keep(seen.select(key, "a", "b", "born", "score", live.alias("live"), said.alias("verdict")), f"claims-{k}")
        links.append(state.where("verdict = 'claims'").select(key, "a", "b", "score"))
        if not state.where("verdict is null").limit(1).count():
            return reduce(DataFrame.unionByName, links)


def stitch(frags: DataFrame, key: str, gates: Gates, reach: Column, scratch: Scratch, structures: DataFrame | None = None, margin: float = 1.5) -> DataFrame:
    """``(key, tid, track)`` for every fragment: the first one of its chain."""
    links = scratch.keep(claims(handoffs(frags, key, gates, reach, structures, scratch), key, scratch, margin), "links")
    chains = graph.collapse_chains(links.select(F.struct(key, F.col("b").alias("tid")).alias("src"), F.struct(key, F.col("a").alias("tid")).alias("dst")), scratch)
    found = chains.select(F.col(f"src.{key}").alias(key), F.col("src.tid").alias("tid"), F.col("root.tid").alias("track"))
    return frags.select(key, "tid").join(found, [key, "tid"], "left").select(key, "tid", F.coalesce("track", "tid").alias("track"))


def rebinds(frags: DataFrame, looks: DataFrame, key: str, gates: Gates, structures: DataFrame, scratch: Scratch, apart: float = 0.8, margin: float = 1.25) -> DataFrame:
    """``(key, keep, absorbed, best, region, gap, cos, runner_up)``: fragments that went
    on behind a structure, chosen among all that vanished there by their looks.

    A fragment joins the one of least cosine distance, unless that is beyond ``apart``
    or a runner-up is within ``margin`` times it. What has itself been absorbed is no
    candidate; ``keep`` is the first fragment of the chain. ``looks (key, tid, v)``:
    mean vectors; fragments without stay out. Kinds agree, as in :func:`handoffs`.

    Whether a candidate was absorbed is known once it is settled, and candidates were
    born earlier: a round settles every fragment whose candidates are, in all matches.
    """
    a, b = _ends(frags, key, gates, structures, scratch)
    near = _behind(a, b, key, gates).where(F.col("gap") <= gates.parked_gap)
    look = looks.select(key, "tid", S.unit("v").alias("_v"))
    seen = near.join(look.select(key, F.col("tid").alias("a"), F.col("_v").alias("_p")), [key, "a"]).join(look.select(key, F.col("tid").alias("b"), F.col("_v").alias("_q")), [key, "b"])
    edges = scratch.keep(seen.select(key, "a", "b", F.col("a_at").alias("region"), "gap", (F.lit(1.0) - S.dot("_p", "_q")).alias("cos")), "rebinds")
    open_ = edges.select(key, F.col("b").alias("tid")).distinct()
    said, k = None, 0
    rank = F.struct("cos", F.col("a").alias("best"), "gap", "region")
    while True:
        state = edges.join(open_.select(key, F.col("tid").alias("b")), [key, "b"], "left_semi")
        state = state.join(open_.select(key, F.col("tid").alias("a"), F.lit(True).alias("waits")), [key, "a"], "left")
        if said is not None:
            gone = said.where("best is not null").select(key, F.col("b").alias("a"), F.lit(True).alias("absorbed"))
            state = state.join(gone, [key, "a"], "left")
        else:
            state = state.withColumn("absorbed", F.lit(None).cast("boolean"))
        free = F.sort_array(F.collect_list(F.when(F.col("absorbed").isNull(), rank)))  # those of one structure and window
        g = state.groupBy(key, "b").agg(F.coalesce(F.bool_or("waits"), F.lit(False)).alias("waits"), free.alias("free")).where("not waits")
        first, runner = F.get("free", F.lit(0)), F.get("free", F.lit(1))["cos"]
        holds = first.isNotNull() & (first["cos"] <= apart) & F.coalesce(runner >= first["cos"] * margin, F.lit(True))
        done = g.select(key, "b", F.when(holds, first["best"]).alias("best"), first["region"].alias("region"), first["gap"].alias("gap"), first["cos"].alias("cos"), runner.alias("runner_up"))
        done = scratch.keep(done, f"rebinds-{k}")
        said = done if said is None else said.unionByName(done)
        open_ = scratch.keep(open_.join(done.select(key, F.col("b").alias("tid")), [key, "tid"], "left_anti"), f"rebinds-open-{k}")
        k += 1
        if not open_.limit(1).count():
            break
    held = scratch.keep(said.where("best is not null"), "rebound")
    chains = graph.collapse_chains(held.select(F.struct(key, F.col("b").alias("tid")).alias("src"), F.struct(key, F.col("best").alias("tid")).alias("dst")), scratch)
    root = chains.select(F.col(f"src.{key}").alias(key), F.col("src.tid").alias("b"), F.col("root.tid").alias("keep"))
    return held.join(root, [key, "b"]).select(key, "keep", F.col("b").alias("absorbed"), "best", "region", "gap", "cos", "runner_up")
