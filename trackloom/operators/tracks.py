"""Track operators: splits, conflicts, pins, holds and quality checks.

``samples`` are rows (tid, t, x, y, ..) of one or more matches; functions take the
key columns they need. Theta joins go by time buckets, and only recurrences run per
track in grouped batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import aggregates as A
from trackloom.operators import filters as P
from trackloom.operators import joins as J
from trackloom.operators import windows as W
from trackloom.operators.graph import connected_components
from trackloom.plans.runtime import Scratch


# -- cuts ---------------------------------------------------------------------
def side_change_cuts(samples: DataFrame, width: float = 3.0, least: int = 5, pure: float = 0.8, run: int = 2) -> DataFrame:
    """Cut a track where its side changes: bins of ``width`` seconds with enough
    decided rows, pure enough, in stretches that span ``run`` bins; the cut lies
    between the two stretches. Stretches too short are passed over."""
    b = samples.where("side is not null").groupBy("tid", F.floor(F.col("t") / width).alias("bin"), "side").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tid", "bin")
    b = b.withColumns({"_t": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), "side"))}).where((F.col("_r") == 1) & (F.col("_t") >= least) & (F.col("n") >= pure * F.col("_t")))
    r = W.runs(b, ["tid"], ["bin"], "side").groupBy("tid", "run").agg(F.first("side").alias("side"), F.min("bin").alias("b0"), F.max("bin").alias("b1")).where(F.col("b1") - F.col("b0") + 1 >= run)
    o = Window.partitionBy("tid").orderBy("b0")
    r = r.withColumns({"_s": F.lag("side").over(o), "_b": F.lag("b1").over(o)}).where("_s != side")
    return r.select("tid", ((F.col("_b") + 1 + F.col("b0")) / 2 * width).alias("cut"))


def appearance_cuts(vectors: DataFrame, width: int = 12, threshold: float = 0.5) -> DataFrame:
    """Change points of a track's descriptors ``(tid, t, vector)``."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        v = np.array(p["vector"].tolist(), float)
        at = W.change_points(v, width, threshold, width) if len(p) else []
        return pd.DataFrame({"tid": [p["tid"].iloc[0]] * len(at), "cut": p["t"].to_numpy(float)[at]})

    return W.grouped(vectors.select("tid", "t", "vector"), ["tid"], ["t"], "tid long, cut double", f)


def join_cuts(samples: DataFrame, vectors: DataFrame, side: float = 6.0, least: int = 4, threshold: float = 0.89) -> DataFrame:
    """Cut at pauses of at least max(0.3 s, 3 median steps) where the mean descriptors
    of the ``side`` seconds on either hand differ."""
    w = Window.partitionBy("tid").orderBy("t")
    d = samples.select("tid", "t").distinct().withColumn("_p", F.lag("t").over(w)).withColumn("_s", F.col("t") - F.col("_p"))
    m = d.groupBy("tid").agg(F.percentile("_s", 0.5).alias("_m"))
    gaps = d.join(m, "tid").where(F.col("_s") >= F.greatest(F.lit(0.3), 3 * F.col("_m"))).select("tid", F.col("_p").alias("lo"), F.col("t").alias("hi"))
    near = J.within_window(gaps, vectors.select("tid", F.col("t").alias("vt"), "vector"), ["tid"], "lo", "vt", side * 2)
    before, after = F.col("vt").between(F.col("lo") - side, F.col("lo")), F.col("vt").between(F.col("hi"), F.col("hi") + side)
    e = near.where(before | after).select("tid", "lo", "hi", before.alias("first"), "vt", F.posexplode("vector").alias("dim", "v"))
    g = e.groupBy("tid", "lo", "hi", "dim").agg(F.avg(F.when(F.col("first"), F.col("v"))).alias("a"), F.avg(F.when(~F.col("first"), F.col("v"))).alias("b"), F.count_if("first").alias("na"), F.count_if(~F.col("first")).alias("nb"))
    s = g.groupBy("tid", "lo", "hi").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    return s.where((F.col("na") >= least) & (F.col("nb") >= least) & (1 - F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")) >= threshold)).select("tid", ((F.col("lo") + F.col("hi")) / 2).alias("cut"))


def vote_change_cuts(votes: DataFrame, width: float = 6.0, least: int = 2) -> DataFrame:
    """Cut between consecutive vote windows with different winners ``(tid, t, team)``."""
    return W.winner_changes(W.binned_votes(votes, ["tid"], "t", "team", width, least), ["tid"], width).select("tid", "cut")


def label_gap_cuts(samples: DataFrame, labelled: DataFrame, gap: float = 2.0) -> DataFrame:
    """Cut labelled tracks in the middle of stretches unseen for longer."""
    d = samples.join(labelled.select("tid").distinct(), "tid", "left_semi").select("tid", "t").distinct()
    d = d.withColumn("_p", F.lag("t").over(Window.partitionBy("tid").orderBy("t")))
    return d.where(F.col("t") - F.col("_p") > gap).select("tid", ((F.col("t") + F.col("_p")) / 2).alias("cut"))


def label_change_cuts(labels: DataFrame, scores: DataFrame | None = None, least: float = 0.35) -> DataFrame:
    """Cut between consecutive labels ``(tid, t, value)`` that differ: at the sharpest
    change in between ``scores (tid, at, score)`` if it is sharp enough, else halfway."""
    w = Window.partitionBy("tid").orderBy("t")
    d = labels.withColumns({"_v": F.lag("value").over(w), "lo": F.lag("t").over(w)}).where("_v != value").select("tid", "lo", F.col("t").alias("hi"))
    half = (F.col("lo") + F.col("hi")) / 2
    if scores is None:
        return d.select("tid", half.alias("cut"))
    best = d.join(scores, "tid").where(F.col("at").between(F.col("lo"), F.col("hi"))).groupBy("tid", "lo", "hi").agg(F.max_by(F.struct("at", "score"), F.struct(F.col("score"), -F.col("at"))).alias("m"))
    return d.join(best, ["tid", "lo", "hi"], "left").select("tid", F.when(F.col("m.score") >= least, F.col("m.at")).otherwise(half).alias("cut"))


def apply_cuts(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """Number of cuts at or before each sample, by a backward as-of join."""
    w = Window.partitionBy("tid").orderBy("cut")
    ranked = cuts.distinct().withColumn("n", F.row_number().over(w)).select("tid", F.col("cut").alias("t"), "n")
    return J.asof(samples, ranked, "tid", "t", ["n"], bucket=60.0).withColumn("segment", F.coalesce("matched_n", F.lit(0))).drop("matched_n", "matched_at")


def sever_leaps(dets: DataFrame, joined: DataFrame, key: str, per_second: float = 8.0, least: float = 1.2, centre: Column | None = None, width: Column | None = None) -> DataFrame:
    """``dets`` with ``new_tid`` and ``track``: joined tracks cut where their own box
    leaps further than a robot can, in box widths per second (``least`` for any step).

    ``dets (key, f, d, tid, t, x1, y1, x2, y2)``, one row per box and negative ``tid``
    for none; ``joined (key, tid, track)``. What follows a cut is a track of its own:
    fresh ids of a match count on from its largest, by the first box (f, d) of the track
    they were cut from and then in time, however many cuts a track has. Steps without
    time between them are none. Where boxes were made from a ``centre`` and a ``width``,
    these say it without the rounding of their corners, which a leap of just the limit
    would hang on.
    """
    d = dets.join(joined, [key, "tid"], "left").withColumn("track", F.coalesce("track", "tid"))
    none, d = d.where("tid < 0"), d.where("tid >= 0")
    x = (F.col("x1") + F.col("x2")) / 2 if centre is None else centre
    d = d.withColumns({"_x": x, "_w": F.greatest(F.col("x2") - F.col("x1") if width is None else width, F.lit(1.0))})
    w = Window.partitionBy(key, "track").orderBy("t", "_x", "y2", "_w", "f", "d")
    dt = F.col("t") - F.lag("t").over(w)
    dx, dy = F.col("_x") - F.lag("_x").over(w), F.col("y2") - F.lag("y2").over(w)
    leap = F.sqrt(dx * dx + dy * dy) / ((F.col("_w") + F.lag("_w").over(w)) / 2)
    d = d.withColumn("_cut", F.coalesce((dt > 0) & (leap > F.greatest(F.lit(least), dt * per_second)), F.lit(False)))
    d = d.withColumns({"_n": F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.min(F.struct("f", "d")).over(Window.partitionBy(key, "track"))})
    top = dets.select(key, F.col("tid").alias("i")).unionByName(joined.select(key, F.col("track").alias("i"))).groupBy(key).agg(F.greatest(F.max("i"), F.lit(-1)).alias("_top"))
    cuts = d.where("_cut").select(key, "track", "_n", "_first").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_first", "track", "_n")))
    fresh = cuts.join(top, key).select(key, "track", "_n", (F.col("_top") + F.col("_r")).alias("_id"))
    out = d.join(fresh, [key, "track", "_n"], "left")
    plain = [c for c in dets.columns]
    return out.select(*plain, F.coalesce("_id", "tid").alias("new_tid"), F.coalesce("_id", "track").alias("track")).unionByName(none.select(*plain, F.col("tid").alias("new_tid"), F.col("tid").alias("track")))


def split_at(samples: DataFrame, cuts: DataFrame, others: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``samples`` and all ``others`` (each with tid and t) cut alike: what lies behind a
    track's n-th cut gets a fresh id, counted on from the largest in order of (tid, n).
    So votes and vectors go to the piece that holds their time."""
    ranked = cuts.select("tid", "cut").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("tid").orderBy("cut")))
    top = samples.agg(F.coalesce(F.max("tid"), F.lit(0)).alias("_top"))
    fresh = W.numbered(ranked.select("tid", "_n"), ["tid", "_n"], "_rank").join(F.broadcast(top), F.lit(True)).select("tid", F.col("_n").alias("segment"), (F.col("_top") + F.col("_rank")).cast("long").alias("_id"))

    def apart(d: DataFrame) -> DataFrame:
        cut = apply_cuts(d, cuts.select("tid", "cut")).join(fresh, ["tid", "segment"], "left")
        return cut.withColumn("tid", F.coalesce("_id", F.col("tid").cast("long"))).select(*d.columns)

    return apart(samples), {k: apart(d) for k, d in others.items()}


def prepared(samples: DataFrame, votes: DataFrame, scratch: Scratch, vectors: DataFrame | None = None, inside: Column | None = None, spans: Column | None = None, side: dict | None = None, looks: dict | None = None, vote: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, votes) as all later steps share them: one segmentation of tracks.

    Rows outside the trusted ``spans`` of the view and those not ``inside`` the field go
    first, before they can take part in any track. Then tracks are cut where their side
    changes, where their looks do (``vectors (tid, t, vector)``), and where their votes
    ``(tid, t, team)`` do; each cut is judged on the pieces the ones before left, and
    votes and vectors follow their piece. ``samples (tid, t, side, ..)`` keep all their
    columns and their first id as ``source``. ``side``, ``looks`` and ``vote`` are options
    of the three cuts. Every step is a written table.
    """
    d = samples.withColumn("source", F.col("tid"))
    if spans is not None:
        d = P.keep_in_spans(d, spans, "t")
    if inside is not None:
        d = d.where(inside)
    d = scratch.keep(d, "prepared-0")
    others = {"votes": votes} | ({"vectors": vectors} if vectors is not None else {})
    steps = [lambda d, o: side_change_cuts(d, **(side or {}))]
    if vectors is not None:
        steps.append(lambda d, o: appearance_cuts(o["vectors"], **(looks or {"threshold": 0.25})))
    steps.append(lambda d, o: vote_change_cuts(o["votes"], **(vote or {})))
    for k, step in enumerate(steps, 1):
        cuts = scratch.keep(step(d, others).select("tid", "cut"), f"cuts-{k}")
        d, others = split_at(d, cuts, others)
        d = scratch.keep(d, f"prepared-{k}")
        others = {n: scratch.keep(o, f"{n}-{k}") for n, o in others.items()}
    return d, others["votes"]


def crossing_cuts(samples: DataFrame, labels: DataFrame, widths: float = 1.5) -> DataFrame:
    """Tracks of one pin that come closer than ``widths`` box widths at shared times:
    both are cut at the middle (index n // 2) of the close times strictly between
    their labels. ``samples (pin, tid, t, x, w)``, ``labels (pin, t)``."""
    s = samples.select("pin", "t", F.col("tid").alias("a"), F.col("x").alias("ax"), F.col("w").alias("aw"))
    o = samples.select("pin", "t", F.col("tid").alias("b"), F.col("x").alias("bx"), F.col("w").alias("bw"))
    ends = labels.groupBy("pin").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    near = s.join(o, ["pin", "t"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ax") - F.col("bx")) < widths * (F.col("aw") + F.col("bw")) / 2)).join(ends, "pin").where((F.col("t") > F.col("lo")) & (F.col("t") < F.col("hi")))
    w = Window.partitionBy("pin", "a", "b")
    mid = near.withColumns({"_i": F.row_number().over(w.orderBy("t")) - 1, "_n": F.count("*").over(w)}).where(F.col("_i") == F.floor(F.col("_n") / 2))
    return mid.select(F.explode(F.array("a", "b")).alias("tid"), F.col("t").alias("cut")).distinct()


# -- windows of play ----------------------------------------------------------
def moving_window(samples: DataFrame, width: float = 0.5, moving: float = 0.35, hold: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """First sustained motion and the first sustained rest after it, by mean speed in
    bins rounded half to even; bins count by position. A row per ``by`` (a match), one
    row without it."""
    key = [*by, "g"]
    w = Window.partitionBy(*by, "tid").orderBy("t")
    d = samples.withColumns({"_dt": F.col("t") - F.lag("t").over(w), "_d": F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))}).where("_dt > 0")
    b = d.groupBy(*by, F.lit(0).alias("g"), (F.bround(F.col("t") / width) * width).alias("bin")).agg(F.avg(F.col("_d") / F.col("_dt")).alias("speed"))
    times = max(1, round(hold / width))
    start = W.sustained(b, key, "bin", F.col("speed") > moving, times).withColumnRenamed("onset", "start")
    rest = b.join(start, key).where(F.col("bin") > F.col("start"))
    stop = W.sustained(rest, key, "bin", F.col("speed") <= moving, times).withColumnRenamed("onset", "stop")
    return start.join(stop, key, "left").drop("g")


def hot_span(samples: DataFrame, width: float = 2.0, least: float = 3.0, hold: float = 4.0, cap: float = 166.0, pad: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """From the first to the last sustained run of bins whose 75th percentile travel
    is large, padded and capped. A row per ``by`` (a match), one row without it."""
    w = Window.partitionBy(*by, "tid").orderBy("t")
    d = samples.withColumn("_d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).where("_d is not null")
    b = d.groupBy(*by, F.lit(0).alias("g"), F.floor(F.col("t") / width).alias("bin")).agg(F.percentile("_d", 0.75).alias("p"))
    r = W.runs(b.withColumn("hot", F.col("p") >= least), [*by, "g"], ["bin"], "hot").where("hot").groupBy(*by, "g", "run").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.count("*").alias("n")).where(F.col("n") * width >= hold)
    g = r.groupBy(*by).agg(F.min("b0").alias("b0"), F.max("b1").alias("b1")).where("b0 is not null")
    lo, hi = F.col("b0") * width - pad, (F.col("b1") + 1) * width + pad
    return g.select(*by, F.greatest(F.lit(0.0), lo).alias("lo"), F.least(hi, lo + cap + 2 * pad).alias("hi"))


# -- conflicts ----------------------------------------------------------------
def custody_conflicts(samples: DataFrame, frames: DataFrame, overlap: float = 1.0, share: float = 0.2, least: int = 5, within: float = 0.25, far: float = 0.5, match: str | None = None) -> DataFrame:
    """Two tracks of one team that are seen apart at the same time: spans overlap by
    ``overlap`` s, both are there in ``share`` of its frames, at least ``least``
    nearest pairs lie within ``within`` s, and over ``far`` of those are more than a
    width plus what both could move apart. ``samples (team, tid, t, x, y, w, v)``;
    ``match`` names a column of both tables where they hold many matches."""
    if match:
        samples = samples.withColumn("team", F.struct(match, "team"))
    spans = samples.groupBy("team", "tid").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    pairs = J.interval_overlap(spans, "team", "tid", "lo", "hi", 30.0, overlap)
    a = samples.select("team", F.col("tid").alias("a"), F.col("t").alias("at"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("w").alias("aw"), F.col("v").alias("av"))
    b = samples.select("team", F.col("tid").alias("b"), F.col("t").alias("bt"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("v").alias("bv"))
    j = J.within_window(a, b, ["team"], "at", "bt", within).where("a < b").join(pairs.select("team", "a", "b", "overlap"), ["team", "a", "b"])
    best = j.groupBy("team", "a", "b", "overlap", "at").agg(F.min_by(F.struct("ax", "ay", "aw", "av", "bx", "by", "bw", "bv", "bt"), F.struct(F.abs(F.col("at") - F.col("bt")), "bt")).alias("m")).select("team", "a", "b", "overlap", "at", "m.*")
    reach = (F.col("aw") + F.col("bw")) / 2 + (F.col("av") + F.col("bv")) * F.abs(F.col("at") - F.col("bt"))
    apart = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) > reach
    g = best.groupBy("team", "a", "b", "overlap").agg(F.count("*").alias("pairs"), F.avg(apart.cast("double")).alias("apart"))
    n = frames.groupBy(*([match] if match else [])).agg(F.count("*").alias("_frames"), (F.max("t") - F.min("t")).alias("_span"))
    g = g.withColumn(match, F.col("team")[match]).join(n, match) if match else g.crossJoin(n)  # one row
    g = g.withColumn("_need", F.greatest(F.lit(least), share * F.col("overlap") / F.col("_span") * F.col("_frames")))
    return g.where((F.col("pairs") >= F.col("_need")) & (F.col("apart") >= far)).select("team.*" if match else "team", "a", "b", "overlap", "pairs", "apart")


def handover_conflicts(spans: DataFrame, gap: float = 1.5, speed: float = 7.15, distance: float = 1.5) -> DataFrame:
    """Consecutive tracks of one team ``(team, tid, t0, t1, x0, y0, x1, y1)`` with an
    impossible step between them, fastest first. No other of its tracks starts in
    between, since the next one by start time is taken."""
    w = Window.partitionBy("team").orderBy("t0", "tid")
    d = spans.withColumns({f"next_{k}": F.lead(k).over(w) for k in ("tid", "t0", "x0", "y0")})
    d = d.withColumns({"gap": F.col("next_t0") - F.col("t1"), "dist": F.hypot(F.col("next_x0") - F.col("x1"), F.col("next_y0") - F.col("y1"))})
    d = d.where((F.col("gap") >= 0) & (F.col("gap") <= gap) & (F.col("dist") >= distance)).withColumn("speed", F.col("dist") / F.greatest("gap", F.lit(1e-3)))
    return d.where(F.col("speed") > speed).select("team", "tid", "next_tid", "gap", "dist", "speed").orderBy(F.desc("speed"), "team", "tid")


def jumps(samples: DataFrame, key: str = "team", mult: float = 1.5, longest: float = 5.0, source: str | None = None) -> DataFrame:
    """Steps beyond the budget between a key's samples up to ``longest`` s apart; with
    ``source`` only where it changes."""
    w = Window.partitionBy(key).orderBy("t")
    d = samples.dropDuplicates([key, "t"])
    d = d.withColumns({"dt": F.col("t") - F.lag("t").over(w), "dist": F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), **({"_src": F.lag(source).over(w)} if source else {})})
    d = d.where((F.col("dt") > 0) & (F.col("dt") <= longest) & (F.col("dist") > S.distance_budget("dt") * mult))
    return d.where(~F.col("_src").eqNullSafe(F.col(source))).drop("_src") if source else d


def route_gaps(samples: DataFrame, key: str = "team", unseen: float = 1.0, mult: float = 1.5) -> DataFrame:
    """Breaks to draw: ``unobserved`` stretches and ``teleport`` steps."""
    w = Window.partitionBy(key).orderBy("t")
    d = samples.select(key, "t", "x", "y", F.lead("t").over(w).alias("t1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("t1 is not null")
    dt = F.col("t1") - F.col("t")
    far = F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")) > S.distance_budget(dt) * mult
    return d.select(key, F.col("t").alias("tStart"), F.col("t1").alias("tEnd"), F.when(dt > unseen, "unobserved").when(far, "teleport").alias("reason")).where("reason is not null")


def label_conflicts(labels: DataFrame, together: DataFrame, budget: Column | None = None, window: float = 5.0) -> DataFrame:
    """Pairs of labels that can't both hold: one team on two tracks seen together
    (same-moment) or too far apart in too little time (impossible), or consecutive
    labels of one original track that differ (disagree). The pair closest in time
    stands for each (kind, a, b, team). ``labels (tid, orig, team, t, x, y)``."""
    a = labels.select("team", F.col("tid").alias("a"), F.col("t").alias("at"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = labels.select("team", F.col("tid").alias("b"), F.col("t").alias("bt"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = J.within_window(a, b, ["team"], "at", "bt", window).where("a < b").withColumn("dt", F.abs(F.col("at") - F.col("bt")))
    seen = together.select("a", "b", F.lit(True).alias("_t"))
    far = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) > (S.distance_budget("dt") * 1.5 if budget is None else budget)
    j = j.join(seen, ["a", "b"], "left").withColumn("kind", F.when(F.col("_t"), "same-moment").when(far, "impossible")).where("kind is not null")
    j = j.select("kind", "team", "a", "b", "at", "bt", "dt")
    w = Window.partitionBy("orig").orderBy("t")
    d = labels.withColumns({"_team": F.lag("team").over(w), "at": F.lag("t").over(w), "a": F.lag("tid").over(w)}).where("_team != team")
    d = d.select(F.lit("disagree").alias("kind"), "team", "a", F.col("tid").alias("b"), "at", F.col("t").alias("bt"), (F.col("t") - F.col("at")).alias("dt"))
    return J.first_per_key(j.unionByName(d), ["kind", "team", "a", "b"], ["dt", "at", "bt"])


# -- pins ---------------------------------------------------------------------
def pins(labels: DataFrame) -> DataFrame:
    """Tracks whose labels name exactly one team, no stronger flag being there.
    ``labels (tid, team, flag)``; unknown yields to a team."""
    g = labels.groupBy("tid").agg(F.min("team").alias("team"), F.max("team").alias("_hi"), F.bool_or(F.coalesce(F.col("flag").isin("mixed", "notrobot"), F.lit(False))).alias("_bad"))
    return g.where((F.col("team") == F.col("_hi")) & ~F.col("_bad")).select("tid", "team")


def sandwich_pins(pieces: DataFrame, pinned: DataFrame, together: DataFrame, sides: DataFrame) -> DataFrame:
    """Unlabelled pieces ``(orig, tid, t0, side)`` between two pieces of one team take
    it, unless their side is the other one's or they are seen with that team."""
    d = pieces.join(pinned, "tid", "left")
    w = Window.partitionBy("orig").orderBy("t0", "tid")
    d = d.withColumns({
        "_p": F.last("team", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.first("team", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).where("team is null and _p = _n").drop("team").withColumnRenamed("_p", "team").drop("_n")
    d = d.join(sides.select("team", F.col("side").alias("_side")), "team", "left").where(S.compatible("side", "_side"))
    both = together.select(F.col("a").alias("tid"), F.col("b").alias("o")).union(together.select("b", "a"))
    clash = both.join(pinned.select(F.col("tid").alias("o"), "team"), "o").select("tid", "team").distinct()
    return d.join(clash, ["tid", "team"], "left_anti").select("tid", "team")


def colour_pieces(pieces: DataFrame, labels: DataFrame, pinned: DataFrame) -> DataFrame:
    """Curator colours onto pieces; contradicting ones cancel, pinned pieces stay."""
    c = J.agreed(labels.select("tid", F.col("side").alias("_s")), ["tid"], "_s").join(pinned, "tid", "left_anti").select("tid", "_s")
    return pieces.join(c, "tid", "left").withColumn("side", F.coalesce("_s", "side")).drop("_s")


def split_same_team(pinned: DataFrame, together: DataFrame, votes: DataFrame, spark_name: str = "pins") -> DataFrame:
    """Pins of one team seen together: per component the strongest (votes, then
    detections, then id) stays hard, the rest turn soft. ``votes (tid, votes, dets)``."""
    same = together.join(pinned.select(F.col("tid").alias("a"), F.col("team").alias("ta")), "a").join(pinned.select(F.col("tid").alias("b"), F.col("team").alias("tb")), "b").where("ta = tb")
    cc = connected_components(same.select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst")), Scratch(pinned.sparkSession, spark_name))
    d = pinned.join(cc, F.col("tid") == F.col("id"), "left").join(votes, "tid", "left").withColumn("component", F.coalesce("component", F.col("tid").cast("long")))
    r = F.row_number().over(Window.partitionBy("component").orderBy(F.desc_nulls_last("votes"), F.desc_nulls_last("dets"), "tid"))
    return d.select("tid", "team", (r == 1).alias("hard"))


def unique_taker(stretches: DataFrame, ends: DataFrame, sides: DataFrame, present: DataFrame) -> DataFrame:
    """Stretches ``(sid, donor, side, t0, t1, x, y)`` that exactly one other team can
    take: of the wanted side, silent throughout, reachable from its nearest end.
    ``ends (team, t, x, y)``, ``present (team, t)``, ``sides (team, side)``."""
    c = stretches.join(sides, "side").where("team != donor")
    busy = c.join(present.withColumnRenamed("t", "pt"), "team").where(F.col("pt").between(F.col("t0"), F.col("t1"))).select("sid", "team").distinct()
    c = c.join(busy, ["sid", "team"], "left_anti")
    near = c.join(ends.select("team", F.col("t").alias("et"), F.col("x").alias("ex"), F.col("y").alias("ey")), "team", "left")
    gap = F.least(F.abs(F.col("et") - F.col("t0")), F.abs(F.col("et") - F.col("t1")))
    ok = F.col("et").isNull() | (F.hypot(F.col("ex") - F.col("x"), F.col("ey") - F.col("y")) <= S.distance_budget(gap))
    g = near.groupBy("sid", "team").agg(F.bool_and(ok).alias("ok")).where("ok")
    return J.exactly_one(g.select("sid", "team"), ["sid"], "team")


def holds(deaths: DataFrame, births: DataFrame, occupancy: DataFrame, cap: float = 20.0, full: int = 6) -> DataFrame:
    """Tracks that end in a region ``(region, tid, t)`` are held until the next birth
    there, until ``full`` are in sight again ``occupancy (t, n)``, or for ``cap`` s."""
    flip = lambda d: d.withColumn("t", -F.col("t"))
    back = J.asof(flip(deaths), flip(births.select("region", "t", F.col("tid").alias("born"))), "region", "t", ["born"], 60.0, strict=True)
    d = back.select("region", "tid", (-F.col("t")).alias("t"), (-F.col("matched_at")).alias("exit"), F.col("matched_born").alias("born"))
    again = flip(occupancy.where(F.col("n") >= full).select(F.lit(0).alias("_k"), "t"))
    d = flip(d.withColumn("_k", F.lit(0)))
    d = J.asof(d, again, "_k", "t", [], 60.0, strict=True).withColumns({"t": -F.col("t"), "again": -F.col("matched_at")}).drop("matched_at", "_k")
    return d.withColumn("until", F.least(F.coalesce("exit", F.lit(float("inf"))), F.coalesce("again", F.lit(float("inf"))), F.col("t") + cap))


def reteam_hidden(labels: DataFrame, boxes: DataFrame, least: float = 0.45) -> DataFrame:
    """``notrobot`` labels whose box lies in the boxes of exactly one team on its frame.
    ``labels (lid, f, x1..y2)``, ``boxes (f, team, x1..y2)``."""
    names = ("x1", "y1", "x2", "y2")
    o = boxes.select("f", "team", *[F.col(k).alias(f"b_{k}") for k in names])
    j = labels.join(o, "f").where(S.containment(S.box(""), S.box("b_")) >= least)
    return J.exactly_one(j.select("lid", "team"), ["lid"], "team")


# -- measures -----------------------------------------------------------------
def max_speed(routes: DataFrame, window: float = 1.0, step: float = 0.2, gap: float = 0.45) -> DataFrame:
    """Largest displacement over ``window`` s along the interpolated route, in steps;
    the first maximum wins. ``bracketed`` marks one across an unseen stretch."""
    w = Window.partitionBy("team").orderBy("t")
    seg = routes.select("team", "t", "x", "y", *[F.lead(k).over(w).alias(f"n{k}") for k in ("t", "x", "y")]).where("nt is not null")
    tick = F.explode(F.sequence(F.ceil(F.col("t") / step), F.floor(F.col("nt") / step)))
    r = (F.col("k") * step - F.col("t")) / (F.col("nt") - F.col("t"))
    g = seg.withColumn("k", tick).select("team", "k", (F.col("x") + r * (F.col("nx") - F.col("x"))).alias("px"), (F.col("y") + r * (F.col("ny") - F.col("y"))).alias("py"), (F.col("nt") - F.col("t") > gap).alias("wide")).dropDuplicates(["team", "k"])
    n = round(window / step)
    later = g.select("team", (F.col("k") - n).alias("k"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("wide").alias("wide2"))
    d = g.join(later, ["team", "k"]).withColumn("speed", F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")) / window)
    return d.groupBy("team").agg(F.max_by(F.struct("speed", (F.col("k") * step).alias("t"), (F.col("wide") | F.col("wide2")).alias("bracketed")), F.struct("speed", -F.col("k"))).alias("m")).select("team", "m.*")


def start_sides(samples: DataFrame, sides: DataFrame, first: float = 1.0, apart: float = 3.0) -> DataFrame:
    """Median x per team in the first second, and teams that start at the other
    side's end, where the sides are apart at all."""
    m = samples.where(F.col("t") <= first).groupBy("team").agg(F.percentile("x", 0.5).alias("mx")).join(sides, "team")
    s = m.groupBy().pivot("side", ["red", "blue"]).agg(F.percentile("mx", 0.5))
    d = m.crossJoin(s)  # one row
    own, other = F.when(F.col("side") == "red", F.col("red")).otherwise(F.col("blue")), F.when(F.col("side") == "red", F.col("blue")).otherwise(F.col("red"))
    clear = F.abs(F.col("red") - F.col("blue")) > apart
    return d.select("team", "side", "mx", (clear & (F.abs(F.col("mx") - other) < F.abs(F.col("mx") - own))).alias("wrong_end"))


def retention(samples: DataFrame, named: DataFrame, present: DataFrame, dt: float) -> DataFrame:
    """Seconds by membership of each valid detection time ``(tid, f)``."""
    d = J.membership(samples.withColumn("_k", F.struct("tid", "f")), "_k", named.select(F.struct("tid", "f").alias("_k")), present.select(F.struct("tid", "f").alias("_k")))
    return d.groupBy("status").agg((F.count("*") * dt).alias("seconds"))


def alignment(labels: DataFrame, boxes: DataFrame, limit: float = 90.0) -> DataFrame:
    """Curator labels against the nearest box of their frame: hit, miss, unresolved.
    ``labels (lid, f, x, y, team)``, ``boxes (f, bid, bx, by, guess)``."""
    d2 = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2
    r = J.nearest_in_group(labels, boxes, ["f"], "lid", d2, ["bid"], limit * limit, ["bid", "guess"])
    return r.withColumn("result", F.when(F.col("bid").isNull(), "missing").when(F.col("guess").isNull(), "unassigned").when(F.col("guess") == F.col("team"), "correct").otherwise("wrong"))


def interval_seconds(spans: DataFrame, lo: float, hi: float) -> DataFrame:
    return A.clipped_seconds(spans, ["match"], F.lit(lo), F.lit(hi)).withColumn("pct", F.round(F.col("seconds") * 100 / (hi - lo), 1))
