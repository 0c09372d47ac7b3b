"""Sorts, limits, top-k, spread-out and greedy picks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.windows import grouped
from trackloom.plans.runtime import spread


def capped_topk(df: DataFrame, group: list[str], sub: str, order: list, k: int, cap: int) -> DataFrame:
    """Best k per group with at most ``cap`` per subgroup. Both caps being nested,
    two rankings give what the greedy scan gives."""
    d = df.withColumn("_s", F.row_number().over(Window.partitionBy(*group, sub).orderBy(*order))).where(F.col("_s") <= cap)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k).drop("_s")


def top_mean(df: DataFrame, group: list[str], value: str, k: int = 3) -> DataFrame:
    """Mean of the k largest values (of fewer, if there are fewer)."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value))))
    return d.where(F.col("_r") <= k).groupBy(*group).agg(F.avg(value).alias("top_mean"), F.count("*").alias("n"))


def evenly_spaced(df: DataFrame, group: list[str], order: list, k: int, truncate: bool) -> DataFrame:
    """k rows per group at even positions, first and last among them; positions are
    truncated or rounded half to even. A group of at most k rows stays whole."""
    w = Window.partitionBy(*group)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    spot = F.sequence(F.lit(0), F.lit(k - 1))
    exact = lambda j: j.cast("double") * (F.col("_n") - 1) / max(1, k - 1)
    at = F.transform(spot, (lambda j: F.floor(exact(j) + 1e-9)) if truncate else (lambda j: F.bround(exact(j)).cast("long")))
    return d.where((F.col("_n") <= k) | F.array_contains(at, F.col("_i"))).drop("_i", "_n")


def every_nth(df: DataFrame, key: list[str], order: list, n: int, phase: int = 0) -> DataFrame:
    """Rows phase, phase + n, ... of each key (from 0)."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).where(F.pmod(F.col("_i") - phase, F.lit(n)) == 0).drop("_i")


def best_per_slot(df: DataFrame, group: list[str], t: str, lo: float, hi: float, slots: int, quality: list) -> DataFrame:
    """The best row of each of ``slots`` equal time slots, filled up by quality."""
    slot = F.least(F.floor((F.col(t) - lo) / ((hi - lo) / slots)), F.lit(slots - 1))
    d = df.where(F.col(t).between(lo, hi)).withColumn("slot", slot)
    d = d.withColumn("_s", F.row_number().over(Window.partitionBy(*group, "slot").orderBy(*quality)))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_s") > 1).cast("int"), *quality)))
    return d.where(F.col("_k") <= slots).drop("_s", "_k")


def newest_request(df: DataFrame, key: list[str], at: str, last_run: str) -> DataFrame:
    """The next job: newest of equal requests, then least recently run, then oldest."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at)))).where("_r = 1").drop("_r")
    return d.orderBy(F.col(last_run).asc_nulls_first(), at, *key).limit(1)


def balance_sides(df: DataFrame, group: list[str], side: str, confidence: str, a: str, b: str, each: int = 3) -> DataFrame:
    """Where all 2 x each are decided, flip the least confident of the larger side. One
    sort serves the counts and the ranks, and tasks are not merged."""
    w = Window.partitionBy(*group).orderBy(side, confidence).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = spread(df, *group).withColumns({"_n": F.count(side).over(w), "_a": F.count_if(F.col(side) == a).over(w)})
    rank = F.row_number().over(Window.partitionBy(*group, side).orderBy(confidence))
    extra = F.when(F.col(side) == a, F.col("_a") - each).otherwise(F.col("_n") - F.col("_a") - each)
    flip = (F.col("_n") == 2 * each) & (F.col("_r") <= extra)
    d = d.withColumn("_r", rank).withColumn("balanced", F.when(flip, F.when(F.col(side) == a, b).otherwise(a)).otherwise(F.col(side)))
    return d.drop("_n", "_a", "_r")


def range_list(df: DataFrame, spec: str, name: str = "item") -> DataFrame:
    """Expand 'qm1-qm3, sf2' to qm1, qm2, qm3, sf2; what isn't a range stays."""
    d = df.withColumn("_p", F.explode(F.filter(F.transform(F.split(F.col(spec), ","), lambda x: F.trim(x)), lambda x: x != "")))
    pat = "^([a-z]+)(\\d+)-([a-z]*)(\\d+)$"
    lo, hi, head = F.regexp_extract("_p", pat, 2).try_cast("int"), F.regexp_extract("_p", pat, 4).try_cast("int"), F.regexp_extract("_p", pat, 1)
    many = F.when(F.col("_p").rlike(pat) & (lo <= hi), F.transform(F.sequence(lo, hi), lambda i: F.concat(head, i.cast("string"))))
    return d.withColumn(name, F.explode(F.coalesce(many, F.array("_p")))).drop("_p")


def hot_cells(cells: DataFrame, rate: Column, p: float) -> DataFrame:
    """Cells whose rate reaches its p-quantile over all cells."""
    d = cells.withColumn("rate", rate)
    return d.crossJoin(d.agg(F.percentile("rate", p).alias("_cut"))).where("rate >= _cut").drop("_cut")  # one row


def mirrored_bands(bands: DataFrame, width: float, within: float = 0.40) -> DataFrame:
    """Bands ``(band, centre, ends)`` with whether another one lies at the mirrored
    place; mirrored first, then by ``ends``."""
    from trackloom.operators.joins import within_window

    a, b = bands.select(F.col("band").alias("a"), (F.lit(width) - F.col("centre")).alias("want")), bands.select(F.col("band").alias("b"), F.col("centre").alias("at"))
    twin = within_window(a, b, [], "want", "at", within).where("a != b").select(F.col("a").alias("band")).distinct().withColumn("_m", F.lit(True))
    d = bands.join(twin, "band", "left").withColumn("mirrored", F.coalesce("_m", F.lit(False))).drop("_m")
    return d.orderBy(F.desc("mirrored"), F.desc("ends"), "band")


def clear_winner(df: DataFrame, key: list[str], score: str, order: list, most: float, margin: float) -> DataFrame:
    """The lowest-scoring row per key, if its score is at most ``most`` and the
    runner-up's at least ``margin`` times as large."""
    w = Window.partitionBy(*key).orderBy(score, *order)
    d = df.withColumns({"_r": F.row_number().over(w), "_second": F.lead(score).over(w)}).where("_r = 1")
    return d.where((F.col(score) <= most) & (F.col("_second").isNull() | (F.col("_second") >= F.col(score) * margin))).drop("_r", "_second")


def agreeing_row(df: DataFrame, ident: str, x: str, within: float) -> DataFrame:
    """Each row with how many rows lie within ``within`` of it (bucketed)."""
    from trackloom.operators.joins import within_window

    a, b = df.select(F.col(ident).alias("a"), F.col(x).alias("ax")), df.select(F.col(ident).alias("b"), F.col(x).alias("bx"))
    return within_window(a, b, [], "ax", "bx", within).groupBy("a").agg((F.count("*") - 1).alias("agree")).withColumnRenamed("a", ident)


# -- greedy, order-dependent picks: per bounded group, in Arrow batches --------
def farthest_points(pos: np.ndarray, limit: int, start: Sequence[int], size: np.ndarray | None = None) -> list[int]:
    """Seeds, then always the point farthest from those picked (larger size, then
    first on ties)."""
    n = len(pos)
    if n <= limit:
        return list(range(n))
    picked = list(dict.fromkeys(int(i) for i in start))[:limit]
    size = np.zeros(n) if size is None else size
    d = np.min([np.abs(pos - pos[i]).sum(axis=1) for i in picked], axis=0)
    while len(picked) < limit:
        d[picked] = -1
        best = max(range(n), key=lambda i: (d[i], size[i], -i))
        picked.append(best)
        d = np.minimum(d, np.abs(pos - pos[best]).sum(axis=1))
    return sorted(picked)


def spread_picks(df: DataFrame, key: list[str], t: str, order: list[str], limit: int) -> DataFrame:
    """Farthest-point picks in time, both ends first."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        return p.iloc[farthest_points(p[[t]].to_numpy(float), limit, [0, len(p) - 1])]

    return grouped(df, key, order, df.schema, f)


def cover(sets: list[set], weight: dict, times: np.ndarray, limit: int, apart: float) -> list[int]:
    """Greedy weighted set cover: the set that adds most uncovered weight, first on
    ties, at least ``apart`` in time from those taken."""
    taken: list[int] = []
    left = set().union(*sets) if sets else set()
    while left and len(taken) < limit:
        free = [i for i in range(len(sets)) if i not in taken and all(abs(times[i] - times[j]) >= apart for j in taken)]
        gain = {i: sum(weight.get(x, 1.0) for x in sets[i] & left) for i in free}
        best = max(free, key=lambda i: (gain[i], -i), default=None)
        if best is None or gain[best] <= 0:
            break
        taken.append(best)
        left -= sets[best]
    return taken


def frame_cover(df: DataFrame, key: list[str], frame: str, item: str, limit: int, apart: float) -> DataFrame:
    """Frames that together show the most items, picked greedily per key."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        g = p.groupby(frame)[item].agg(set).sort_index()
        at = cover(list(g), {}, g.index.to_numpy(float), limit, apart)
        return pd.DataFrame({**{k: [p[k].iloc[0]] * len(at) for k in key}, frame: g.index[at], "pick": range(len(at))})

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in [*key, frame])
    return grouped(df, key, [frame, item], f"{kinds}, pick int", f)


def greedy_apart(df: DataFrame, key: list[str], t: str, order: list[str], ascending: list[bool], limit: int, apart: float) -> DataFrame:
    """Best rows first, each at least ``apart`` in time from those taken."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, ascending=ascending, kind="mergesort")
        taken: list[int] = []
        times = p[t].to_numpy(float)
        for i, x in enumerate(times):
            if len(taken) < limit and all(abs(x - times[j]) >= apart for j in taken):
                taken.append(i)
        return p.iloc[taken]

    return grouped(df, key, [t, *order], df.schema, f)


# Multiplier, increment and modulus of the generator behind a shuffle.
GENERATOR = (1664525, 1013904223, 1 << 32)


def shuffled(length, seed) -> Column:
    """The numbers below ``length`` in the order that ``seed`` gives them: from the last
    place down, each is exchanged with the place that the next random number names. A seed
    counts as 32 bits without a sign, so -1 is the largest."""
    times, plus, modulus = GENERATOR
    n = F.col(length) if isinstance(length, str) else length
    begin = F.struct((F.pmod((F.col(seed) if isinstance(seed, str) else seed).cast("long"), F.lit(1 << 32)) % modulus).alias("random"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("order"))

    def exchange(a: Column, place: Column) -> Column:
        random = (a["random"] * times + plus) % modulus
        other = (random % (place + 1)).cast("int")
        order = F.transform(a["order"], lambda x, k: F.when(k == place, F.get(a["order"], other)).when(k == other, F.get(a["order"], place)).otherwise(x))
        return F.struct(random.alias("random"), order.alias("order"))

    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, begin, exchange)["order"]
