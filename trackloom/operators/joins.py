"""Joins beyond equality: nearest, as-of, interval, co-occurrence, theta by bucket.

Nothing here compares all pairs of a table: theta joins are equi-joins on a time or
frame bucket, as-of joins are one sort per key and bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.runtime import Scratch, ship


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order`` (``Array.find`` semantics)."""
    own = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(own, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in ``order`` (an index that later rows overwrite)."""
    own = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(own, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def nearest_in_group(left: DataFrame, right: DataFrame, by: list[str], left_id: str, distance: Column, order: list, limit: float | None, take: list[str]) -> DataFrame:
    """Each left row with the nearest right row of its group, the first on ties.

    ``distance`` may use columns of both sides (names must differ but for ``by``).
    Beyond ``limit`` (inclusive) the match is null; the left row always stays. The least
    distance comes first, a number that a hash keeps, and only pairs at that distance
    are compared by ``order``: a minimum of structs would sort all pairs. A distance
    along one line needs no pairs (:func:`nearest_on_line`).
    """
    pairs = left.join(right, by).withColumn("_d", distance)
    pairs = pairs.where(F.col("_d") <= limit if limit is not None else F.col("_d").isNotNull())
    least = pairs.groupBy(left_id).agg(F.min("_d").alias("_least"))
    ties = left.join(least, left_id).join(right, by).withColumn("_d", distance).where(F.col("_d") == F.col("_least"))
    best = ties.groupBy(left_id).agg(F.min_by(F.struct("_d", *take), F.struct(*order)).alias("_m"))
    return left.join(best, left_id, "left").select(*left.columns, F.col("_m._d").alias("distance"), *[F.col(f"_m.{t}").alias(t) for t in take])


def nearest_on_line(left: DataFrame, right: DataFrame, by: str, left_id: str, at: str, right_at: str, right_id: str, limit: float) -> DataFrame:
    """:func:`nearest_in_group` for places on a line, the smallest ``right_id`` on ties:
    the next place either way by as-of joins, so no pairs are made.

    Groups in which two places are so near that their distances may round to one number
    take the way by pairs.
    """
    places = right.where(F.col(by).isNotNull() & (F.abs(right_at) < float("inf"))).groupBy(by, right_at).agg(F.min(right_id).alias(right_id))
    step = F.col(right_at) - F.lag(right_at).over(Window.partitionBy(by).orderBy(right_at))
    dense = places.withColumn("_s", step).where(F.col("_s") <= 2 * math.ulp(limit)).select(by).distinct()
    apart = left.join(dense, by, "left_anti").select(*left.columns)
    ahead = places.withColumnRenamed(right_at, at)
    back = asof(apart, ahead, by, at, [right_id], limit).withColumnsRenamed({"matched_at": "_at0", f"matched_{right_id}": "_id0"})
    both = asof(back.withColumn(at, -F.col(at)), ahead.withColumn(at, -F.col(at)), by, at, [right_id], limit).withColumn(at, -F.col(at))
    id1 = F.col(f"matched_{right_id}")
    d0, d1 = F.abs(F.col(at) - F.col("_at0")), F.abs(F.col(at) + F.col("matched_at"))
    d = F.least(d0, d1)
    found = both.select(*left.columns, F.when(d <= limit, d).alias("distance"), F.when(d <= limit, F.least(F.when(d0 == d, F.col("_id0")), F.when(d1 == d, id1))).alias(right_id))
    near = nearest_in_group(left.join(dense, by, "left_semi").select(*left.columns), right, [by], left_id, F.abs(F.col(at) - F.col(right_at)), [right_id], limit, [right_id])
    return found.unionByName(near)


def asof(left: DataFrame, right: DataFrame, by: str, on: str, take: list[str], bucket: float, strict: bool = False) -> DataFrame:
    """Backward as-of join: each left row with the latest right row at or before it
    (``strict``: before), by key, in one pass per (key, bucket).

    ``on`` is numeric. Rows are sorted within time buckets, so a key with a large
    share of all rows is spread over its buckets; what an earlier bucket ends with
    is carried in from a table with one row per key and bucket. Right rows with
    equal times: the largest ``take`` counts.
    """
    b = F.floor(F.col(on) / bucket)
    value = F.struct(F.col(on).alias("at"), *take)
    r = right.select(by, F.col(on).alias("_t"), b.alias("_b"), value.alias("_v"), F.lit(None).cast("long").alias("_id"))
    numbered = left.withColumn("_id", F.monotonically_increasing_id())
    keyed = numbered.select(by, F.col(on).alias("_t"), b.alias("_b"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), "_id", F.struct(*left.columns).alias("_row"))
    both = keyed.unionByName(r.withColumn("_row", F.lit(None).cast(keyed.schema["_row"].dataType)))
    side = F.when(F.col("_id").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    w = Window.partitionBy(by, "_b").orderBy("_t", side, "_v").rowsBetween(Window.unboundedPreceding, 0)
    inner = both.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_id is not null")
    ends = r.groupBy(by, "_b").agg(F.max("_v").alias("_end"))
    buckets = keyed.select(by, "_b").union(r.select(by, "_b")).distinct().join(ends, [by, "_b"], "left")
    carry = buckets.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    out = inner.join(carry.select(by, "_b", "_carry"), [by, "_b"], "left").withColumn("_m", F.coalesce("_in", "_carry"))
    return out.select("_row.*", F.col("_m.at").alias("matched_at"), *[F.col(f"_m.{t}").alias(f"matched_{t}") for t in take])


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, on: str, take: list[str], bucket: float, within: float | None = None) -> DataFrame:
    """Nearest right row in time, either way; the earlier one on ties."""
    mirrored = right.withColumn(on, -F.col(on))
    back = asof(left, right, by, on, take, bucket)
    names = {f"matched_{k}": f"before_{k}" for k in ("at", *take)}
    back = back.withColumnsRenamed(names).withColumn(on, -F.col(on))
    fwd = asof(back, mirrored, by, on, take, bucket).withColumn(on, -F.col(on)).withColumn("matched_at", -F.col("matched_at"))
    d0, d1 = F.abs(F.col(on) - F.col("before_at")), F.abs(F.col("matched_at") - F.col(on))
    earlier = d1.isNull() | (d0 <= d1)
    gap = F.when(earlier, d0).otherwise(d1)
    ok = gap <= within if within is not None else gap.isNotNull()
    out = [F.when(ok, F.when(earlier, F.col(f"before_{k}")).otherwise(F.col(f"matched_{k}"))).alias(f"matched_{k}") for k in ("at", *take)]
    return fwd.select(*left.columns, *out, F.when(ok, gap).alias("time_gap"))


#: Bytes of a tile's matrix of counts, items of a block at most (of bytes) and at least.
_TILE, _BLOCK, _LEAST = 1 << 27, 11_585, 2048


def co_occurring(df: DataFrame, group: list[str], item: str, block: int = _BLOCK) -> DataFrame:
    """Different pairs (a < b) of items that share a group, with how many groups.

    Pairs are counted where they are made and never shuffled: items fall into blocks of
    about ``block``, and each two blocks are a tile with a matrix of counts. A tile's
    rows are sorted by group and streamed, so a task holds the matrix and one batch,
    however many groups there are or items in one of them. A row goes to as many tiles
    as there are blocks, so it is the item's place in its block, two bytes, and counts
    are as narrow as the most rows of an item allow, for large blocks.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pairs")
    rows = df.select(*group, item)
    for c in (*group, item):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.select(F.struct(*group).alias("_g"), F.col(item).alias("_i"))
    items = scratch.keep(rows.groupBy("_i").agg(F.count("*").alias("_n")), "items")
    size = items.agg(F.count("*").alias("items"), F.max("_n").alias("most")).first()
    counts = next(t for t in (np.uint8, np.uint16, np.int64) if (size["most"] or 0) <= np.iinfo(t).max)
    block = max(1, min(block, _BLOCK, math.isqrt(_TILE // np.dtype(counts).itemsize)))
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(size["items"] / block), min(math.isqrt(8 * cores), math.ceil(size["items"] / _LEAST)))
    own = items.select("_i", F.pmod(F.xxhash64("_i"), F.lit(blocks)).cast("int").alias("_p"))
    places = scratch.keep(own.withColumn("_at", (F.row_number().over(Window.partitionBy("_p").orderBy("_i")) - 1).cast("smallint")), "places")
    body = scratch.keep(rows.join(places, "_i").groupBy("_g", "_p").agg(F.sort_array(F.collect_set("_at")).alias("_items")), "groups")
    head = places.groupBy("_p").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_i"))), lambda x: x["_i"]).alias("_names"))
    both = head.unionByName(body, allowMissingColumns=True).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("_p", "_q"), F.greatest("_p", "_q")
    tile = low * blocks - F.floor(low * (low - 1) / 2) + high - low
    tiles = blocks * (blocks + 1) // 2
    parts = min(tiles, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))
    dealt = both.select(tile.cast("int").alias("_tile"), "_g", F.signum(F.col("_p") - F.col("_q")).cast("int").alias("_side"), "_names", "_items")
    sorted_ = dealt.repartitionById(parts, "_tile").sortWithinPartitions("_tile", "_g", "_side")
    kind = df.schema[item].dataType.simpleString()

    def counted(names: dict, kind: pa.DataType, n: np.ndarray | None):
        """A tile's pairs, some rows of the matrix at a time; of a block with itself those
        over the diagonal."""
        if n is None:
            return
        x, y = (names[0], names[0]) if 0 in names else (names[-1], names[1])
        step = max(1, 131_072 // len(y))
        for at in range(0, len(x), step):
            part = np.triu(n[at : at + step], at + 1) if 0 in names else n[at : at + step]
            i, j = np.nonzero(part)
            if len(i):
                a, b = x[at + i], y[j]
                turned = a > b
                yield pa.RecordBatch.from_arrays([pa.array(np.where(turned, b, a), kind), pa.array(np.where(turned, a, b), kind), pa.array(part[i, j].astype(np.int64))], names=["a", "b", "shared"])

    def run(batches):
        tile, names, n, held, kind = None, {}, None, None, None  # names by side: -1 and 1, or 0
        for batch in batches:
            lists, titles = batch.column("_items"), batch.column("_names")
            kind = titles.type.value_type
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            tiles, groups, sides = batch.column("_tile").to_numpy(), batch.column("_g").to_pylist(), batch.column("_side").to_pylist()
            for k, (g, side) in enumerate(zip(groups, sides, strict=True)):
                if tiles[k] != tile:
                    yield from counted(names, kind, n)
                    tile, names, n, held = tiles[k], {}, None, None
                if g is None:
                    names[side] = titles[k].values.to_numpy(zero_copy_only=False).copy()
                    continue
                own = flat[ends[k] : ends[k + 1]]
                if side < 0:
                    held = g, own
                    continue
                if side == 0 or held and held[0] == g:
                    if n is None:
                        n = np.zeros((len(names[-1 if side else 0]), len(names[side])), counts)
                    n[np.ix_(held[1] if side else own, own)] += 1
        yield from counted(names, kind, n)

    return sorted_.mapInArrow(run, f"a {kind}, b {kind}, shared long")


def interval_overlap(df: DataFrame, key: str, ident: str, lo: str, hi: str, bucket: float, least: float = 0.0) -> DataFrame:
    """Pairs (a < b) of one key's intervals that overlap by at least ``least``.

    Intervals are spread over the buckets they touch; a pair is made only in the
    bucket where the later one starts, so it appears once.
    """
    spread = df.select(key, F.col(ident).alias("i"), F.col(lo).alias("s"), F.col(hi).alias("e"), F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))).alias("_b"))
    a = spread.select(key, "_b", F.col("i").alias("a"), F.col("s").alias("a_lo"), F.col("e").alias("a_hi"))
    b = spread.select(key, "_b", F.col("i").alias("b"), F.col("s").alias("b_lo"), F.col("e").alias("b_hi"))
    start = F.floor(F.greatest("a_lo", "b_lo") / bucket)
    shared = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")
    return a.join(b, [key, "_b"]).where((F.col("a") < F.col("b")) & (start == F.col("_b")) & (shared >= least)).select(key, "a", "b", shared.alias("overlap"))


def in_intervals(points: DataFrame, spans: DataFrame, by: str, on: str, bucket: float, take: list[str], nearest: bool = False) -> DataFrame:
    """Each point with the earliest span (lo, hi, both inclusive) of its key that
    holds it; with ``nearest`` else the span with the nearest end, the earlier one on
    ties."""
    spread = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    p = points.withColumns({"_pid": F.monotonically_increasing_id(), "_b": F.floor(F.col(on) / bucket)})
    hit = p.join(spread, [by, "_b"]).where(F.col(on).between(F.col("lo"), F.col("hi")))
    best = hit.groupBy("_pid").agg(F.min_by(F.struct("lo", "hi", *take), F.struct("lo", "hi", *take)).alias("_m"))
    out = p.join(best, "_pid", "left")
    if nearest:
        # outside all spans: the last end before the point or the first start after it
        lost, own = out.where(F.col("_m").isNull() & F.col(by).isNotNull()).select("_pid", by, on), F.struct("lo", "hi", *take).alias("_s")
        back = asof(lost, spans.select(by, F.col("hi").alias(on), (-F.col("lo")).alias("_o"), own), by, on, ["_o", "_s"], bucket)
        back = back.select("_pid", by, (-F.col(on)).alias(on), (F.col(on) - F.col("matched_at")).alias("_d0"), F.col("matched__s").alias("_s0"))
        both = asof(back, spans.select(by, (-F.col("lo")).alias(on), (-F.col("hi")).alias("_o"), own), by, on, ["_o", "_s"], bucket)
        d1 = F.col(on) - F.col("matched_at")
        near = both.select("_pid", F.when(d1.isNull() | (F.col("_d0") <= d1), F.col("_s0")).otherwise(F.col("matched__s")).alias("_n"))
        out = out.join(near, "_pid", "left").withColumn("_m", F.coalesce("_m", "_n"))
    return out.select(*points.columns, F.col("_m.lo").alias("span_lo"), F.col("_m.hi").alias("span_hi"), *[F.col(f"_m.{t}").alias(t) for t in take])


def within_window(a: DataFrame, b: DataFrame, by: list[str], a_on: str, b_on: str, window: float) -> DataFrame:
    """Pairs of two tables (names differing but for ``by``) at most ``window`` apart:
    b goes to its own and the neighbouring buckets, a to its own. Never by a broadcast:
    the planner takes spread rows for as small as the compressed file they come from."""
    left = a.withColumn("_b", F.floor(F.col(a_on) / window))
    right = b.withColumn("_b", F.explode(F.array(*[F.floor(F.col(b_on) / window) + k for k in (-1, 0, 1)])))
    return left.join(right.hint("merge"), [*by, "_b"]).where(F.abs(F.col(a_on) - F.col(b_on)) <= window).drop("_b")


def successors(segments: DataFrame, key: str, max_gap: float, reach: Column, top: int = 3, max_score: float | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """Candidate continuations between segments ``(key, seg, t0, t1, x0, x1, kind)``
    of one key: a ends at or before b starts, the gap is at most ``max_gap``, kinds
    agree (null fits all) and the distance is within ``reach`` (a Column over
    ``gap``). Score is the sum of both ratios; the best ``top`` per b stay.
    ``conflicts (a, b)`` are taken out."""
    a = segments.select(key, F.col("seg").alias("a"), F.col("t1").alias("a_end"), F.col("x1").alias("a_x"), F.col("kind").alias("a_kind"))
    b = segments.select(key, F.col("seg").alias("b"), F.col("t0").alias("b_start"), F.col("x0").alias("b_x"), F.col("kind").alias("b_kind"))
    j = within_window(a, b, [key], "a_end", "b_start", max_gap).where("a != b and a_end <= b_start")
    j = j.where(F.col("a_kind").isNull() | F.col("b_kind").isNull() | (F.col("a_kind") == F.col("b_kind")))
    j = j.withColumns({"gap": F.col("b_start") - F.col("a_end"), "dist": F.abs(F.col("b_x") - F.col("a_x"))}).withColumn("budget", reach)
    j = j.where("dist <= budget").withColumn("score", F.col("gap") / max_gap + F.col("dist") / F.col("budget"))
    if max_score is not None:
        j = j.where(F.col("score") <= max_score)
    if conflicts is not None:
        either = conflicts.select("a", "b").union(conflicts.select(F.col("b"), F.col("a")))
        j = j.join(either, ["a", "b"], "left_anti")
    best = F.row_number().over(Window.partitionBy(key, "b").orderBy("score", "a"))
    return j.withColumn("rank", best).where(F.col("rank") <= top)


def kinematic_conflicts(samples: DataFrame, key: str, ident: str, t: str, x: str, y: str, window: float, budget: Column) -> DataFrame:
    """Pairs of tracks with some two samples close in time but farther apart than
    ``budget`` (a Column over ``dt``) allows. Only such samples are shuffled."""
    a = samples.select(key, F.col(ident).alias("a"), F.col(t).alias("a_t"), F.col(x).alias("a_x"), F.col(y).alias("a_y"))
    b = samples.select(key, F.col(ident).alias("b"), F.col(t).alias("b_t"), F.col(x).alias("b_x"), F.col(y).alias("b_y"))
    j = within_window(a, b, [key], "a_t", "b_t", window).where("a < b").withColumn("dt", F.abs(F.col("a_t") - F.col("b_t")))
    return j.where(F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) > budget).select(key, "a", "b").distinct()


def agreed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys on which all rows agree, with the value; contradictions leave no row."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_hi")).where(F.col(value) == F.col("_hi")).drop("_hi")


def exactly_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with exactly one different value."""
    return agreed(df, keys, value)


def membership(base: DataFrame, key: str, named: DataFrame, present: DataFrame) -> DataFrame:
    """``base`` with status: named, present (but not named) or missing."""
    j = base.join(named.select(key, F.lit(True).alias("_n")).distinct(), key, "left").join(present.select(key, F.lit(True).alias("_p")).distinct(), key, "left")
    return j.withColumn("status", F.when(F.col("_n"), "named").when(F.col("_p"), "present").otherwise("missing")).drop("_n", "_p")


def duplicates_by_overlap(boxes: DataFrame, frame: list[str], ident: str, dx: float = 0.6, vertical: float = 0.25, overlap: float = 0.35, min_frames: int = 5) -> DataFrame:
    """Pairs of tracks whose boxes mostly coincide: medians over shared frames.
    ``boxes`` has x1, y1, x2, y2. Keeper is the lower box (larger median y2)."""
    from trackloom.functions import scalars as S

    one = lambda p: boxes.select(*frame, F.col(ident).alias(p), *[F.col(k).alias(f"{p}_{k}") for k in ("x1", "y1", "x2", "y2")])
    j = one("a").join(one("b"), frame).where("a < b")
    a, b = S.box("a_"), S.box("b_")
    g = j.groupBy("a", "b").agg(
        F.count("*").alias("frames"), F.percentile(S.offset_in_widths(a, b), 0.5).alias("dx"), F.percentile(S.vertical_overlap(a, b), 0.5).alias("vertical"),
        F.percentile(S.iou(a, b), 0.5).alias("iou"), F.percentile(F.col("a_y2") - F.col("b_y2"), 0.5).alias("lower"),
    )
    g = g.where((F.col("frames") >= min_frames) & (F.col("dx") < dx) & (F.col("vertical") > vertical) & (F.col("iou") > overlap))
    return g.withColumn("keeper", F.when(F.col("lower") >= 0, F.col("a")).otherwise(F.col("b")))
