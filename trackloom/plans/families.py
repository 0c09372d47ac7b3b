"""More registered queries: one per family of scalar functions, gates, upserts and
track rules, with their SQL counterparts. Stand-ins as in :mod:`catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import aggregates as A
from trackloom.operators import assignment as G
from trackloom.operators import filters as P
from trackloom.operators import joins as J
from trackloom.operators import selection as O
from trackloom.operators import tracks as T
from trackloom.operators import upserts as U
from trackloom.operators import windows as W
from trackloom.plans.catalog import _E, ORACLES, QUERIES, _events, query
from trackloom.plans.runtime import table
from trackloom.sources import documents as D

__all__ = ["ORACLES", "QUERIES"]


def _piecewise(x: str, knots, extend: bool) -> str:
    """The SQL of :func:`scalars.piecewise`."""
    out = f"CASE WHEN {x} <= {knots[0][0]} THEN {knots[0][1]}::DOUBLE"
    for (t0, d0), (t1, d1) in zip(knots, knots[1:], strict=False):
        out += f" WHEN {x} <= {t1} THEN {d0}::DOUBLE + {d1 - d0!r}::DOUBLE * ({x} - {t0}::DOUBLE) / {t1 - t0!r}::DOUBLE"
    (ta, da), (tb, db) = knots[-2:]
    return out + (f" ELSE {db}::DOUBLE + {(db - da) / (tb - ta)!r}::DOUBLE * ({x} - {tb}::DOUBLE) END" if extend else f" ELSE {db}::DOUBLE END")


def _lines(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), *cols)


# -- scalar functions ---------------------------------------------------------
@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(md5(url), 1, 11) END AS video, (2000 + page_id % 30)::VARCHAR AS year,
 CASE WHEN page_id % 7 <> 0 THEN round(page_id::DOUBLE / (page_id % 7), 6) END AS rate, page_id::VARCHAR AS team, url AS last_line,
 sha256('{"id":' || page_id || ',"url":"' || url || '"}') AS hash FROM pages""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, years, ratios, lines and hashes from text."""
    p, i = table(spark, sf, "pages").select("page_id", "url"), F.col("page_id")
    address = F.when(i % 3 == 0, F.concat(F.lit("https://youtu.be/"), F.substring(F.md5("url"), 1, 11))).otherwise("no video")
    return p.select(
        "page_id", S.video_id(address).alias("video"), S.event_year(F.concat((i % 30 + 2000).cast("string"), F.lit("abc"))).alias("year"),
        F.round(S.rational(F.concat_ws("/", i.cast("string"), (i % 7).cast("string"))), 6).alias("rate"), S.strip_team_prefix(F.concat(F.lit("frc"), i.cast("string"))).alias("team"),
        S.last_meaningful_line(F.concat("url", F.lit("\n \n\t"))).alias("last_line"), S.canonical_hash(("url", F.col("url")), ("id", i)).alias("hash"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times as text to the second."""
    return table(spark, sf, "orders").select("o_orderkey", S.iso_seconds("o_orderdate").alias("at"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity AS x, l_linenumber::DOUBLE AS y, (l_partkey % 50)::DOUBLE AS u, (l_suppkey % 8)::DOUBLE AS v FROM lineitem),
i AS (SELECT *, greatest(0, least(x + 20, u + 15) - greatest(x, u)) AS w, greatest(0, least(y + 4, v + 5) - greatest(y, v)) AS h FROM b)
SELECT l_orderkey, line, round(w * h / (155 - w * h), 6) AS iou, round(w * h / 75, 6) AS containment, round(h / 4, 6) AS upright, round(abs(x + 10 - u - 7.5) / 17.5, 6) AS offset_ FROM i""")
def box_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap, containment, shared height and offset of two boxes."""
    x, y, u, v = F.col("l_quantity"), F.col("line").cast("double"), (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 8).cast("double")
    a, b = (x, y, x + 20, y + 4), (u, v, u + 15, v + 5)
    d = _lines(spark, sf, "l_quantity", "l_partkey", "l_suppkey")
    return d.select("l_orderkey", "line", *[F.round(f(a, b), 6).alias(n) for n, f in (("iou", S.iou), ("containment", S.containment), ("upright", S.vertical_overlap), ("offset_", S.offset_in_widths))])


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity AS x, (l_partkey % 40)::DOUBLE AS y FROM lineitem),
p AS (SELECT *, x * 0.001 + y * 0.002 + 1 AS w, sqrt((x - 25) * (x - 25) + (y - 5) * (y - 5)) AS n FROM b)
SELECT l_orderkey, line, round((x * 1.1 + y * 0.02 + 3) / w, 6) AS px, round((x * 0.01 + y * 0.9 - 2) / w, 6) AS py, round((x - 10) / 25, 6) AS mx, round((500 - y) / 25, 6) AS my,
 round((x + CASE WHEN n > 1e-9 THEN (x - 25) * 0.5 / n ELSE 0 END) * 1.02 + 0.3, 6) AS cx, round((y + CASE WHEN n > 1e-9 THEN (y - 5) * 0.5 / n ELSE 0 END) * 1.02 - 0.2, 6) AS cy FROM p""")
def plane_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """A homography, pixels to metres, and ordered corrections of positions."""
    d = _lines(spark, sf, "l_quantity", (F.col("l_partkey") % 40).cast("double").alias("y"))
    (px, py), (mx, my) = S.project("l_quantity", "y", [[1.1, 0.02, 3.0], [0.01, 0.9, -2.0], [0.001, 0.002, 1.0]]), S.pixels_to_metres("l_quantity", "y", 10.0, 500.0, 25.0)
    cx, cy = S.corrected("l_quantity", "y", [{"op": "radialShift", "fromXY": [25, 5], "meters": 0.5}, {"op": "similarity", "scale": 1.02, "translationM": [0.3, -0.2]}])
    return d.select("l_orderkey", "line", *[F.round(v, 6).alias(n) for n, v in (("px", px), ("py", py), ("mx", mx), ("my", my), ("cx", cx), ("cy", cy))])


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, (l_partkey % 1920 - 960) / 2000.0::DOUBLE AS u, (l_suppkey * 7 % 1080 - 540) / 2000.0::DOUBLE AS v FROM lineitem),
g AS (SELECT *, 1 - 0.2 * (u * u + v * v) + 0.02 * (u * u + v * v) * (u * u + v * v) AS g FROM b)
SELECT l_orderkey, line, round(u * g * 2000 + 960, 5) AS dx, round(v * g * 2000 + 540, 5) AS dy, true AS there_and_back FROM g""")
def lens_model(spark: SparkSession, sf: str) -> DataFrame:
    """Radial distortion, and its inverse by fixed-point steps."""
    d = _lines(spark, sf, (F.col("l_partkey") % 1920).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 1080).cast("double").alias("y"))
    lens = {"f": 2000.0, "k1": -0.2, "k2": 0.02, "cx": 960.0, "cy": 540.0}
    dx, dy = S.distort("x", "y", **lens)
    d = d.select("l_orderkey", "line", "x", "y", dx.alias("dx"), dy.alias("dy"))
    d = S.undistorted(d, "dx", "dy", ("bx", "by"), **lens)
    return d.select("l_orderkey", "line", F.round("dx", 5).alias("dx"), F.round("dy", 5).alias("dy"), (F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y")) < 1e-5).alias("there_and_back"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity + 0.25 AS x, l_partkey % 45 + 0.5::DOUBLE AS y FROM lineitem)
SELECT l_orderkey, line, x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 30 AS inside, round(CASE WHEN x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 30 THEN least(x - 10, 40 - x, y - 10, 30 - y)
 ELSE sqrt(pow(greatest(10 - x, 0, x - 40), 2) + pow(greatest(10 - y, 0, y - 30), 2)) END, 6) AS distance FROM b""")
def polygon_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Inside a region, and how far from its outline."""
    d = _lines(spark, sf, (F.col("l_quantity") + 0.25).alias("x"), (F.col("l_partkey") % 45 + 0.5).alias("y"))
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((10, 10), (40, 10), (40, 30), (10, 30))])
    return d.select("l_orderkey", "line", S.inside_polygon("x", "y", ring).alias("inside"), F.round(S.distance_to_outline("x", "y", ring), 6).alias("distance"))


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity / 10 AS dt, (l_partkey % 100) / 10.0::DOUBLE AS d, (l_suppkey % 6)::DOUBLE AS v, l_partkey % 300 AS gap, l_suppkey % 100 AS moved, l_quantity AS q FROM lineitem)
SELECT l_orderkey, line, dt > 0 AND d <= least(v * dt + dt * dt * 4, dt * 5.5) * 1.25 + 0.35 AS reach, round({_piecewise("dt", S.ENVELOPE_PX, False)}, 6) AS pixels,
 round(least(20, q / line + 2), 6) AS hide, gap <= 180 AND moved <= 60 AS parked FROM b""")
def motion_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Reach from a speed, pixel budgets, hiding times and parked robots."""
    d = _lines(spark, sf, "l_quantity", (F.col("l_quantity") / 10).alias("dt"), ((F.col("l_partkey") % 100) / F.lit(10.0)).alias("d"), (F.col("l_suppkey") % 6).cast("double").alias("v"), (F.col("l_partkey") % 300).alias("gap"), (F.col("l_suppkey") % 100).alias("moved"))
    return d.select("l_orderkey", "line", S.reachable("d", "dt", "v").alias("reach"), F.round(S.pixel_budget("dt"), 6).alias("pixels"), F.round(S.hide_budget("l_quantity", "line"), 6).alias("hide"), S.parked("gap", "moved").alias("parked"))


@query("""
WITH u AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * x))) AS a, sqrt(list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE * x))) AS b, embedding AS e FROM embeddings)
SELECT vec_id, round(e[1]::DOUBLE / a * sqrt(0.5::DOUBLE), 6) AS first_, round(e[33]::DOUBLE / b * sqrt(0.5::DOUBLE), 6) AS second_, 64::BIGINT AS n, round(list_sum(list_transform(range(1, 33), lambda i: e[i]::DOUBLE * e[i + 32])) / (a * b), 6) AS cosine FROM u""")
def fused_views(spark: SparkSession, sf: str) -> DataFrame:
    """Two views as one unit vector, and their cosine."""
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    d = table(spark, sf, "embeddings").select("vec_id", S.fuse_views(a, b).alias("v"), S.cosine(a, b).alias("c"))
    return d.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first_"), F.round(F.get("v", F.lit(32)), 6).alias("second_"), F.size("v").cast("long").alias("n"), F.round("c", 6).alias("cosine"))


@query("""
WITH RECURSIVE s(id, i, st, items) AS (
 SELECT p_partkey, 8, (p_partkey * 1664525 + 1013904223) % 4294967296, range(9) FROM part UNION ALL
 SELECT id, i - 1, (st * 1664525 + 1013904223) % 4294967296, list_transform(range(9), lambda k: CASE WHEN k = i THEN items[st % (i + 1) + 1] WHEN k = st % (i + 1) THEN items[i + 1] ELSE items[k + 1] END) FROM s WHERE i > 0)
SELECT id AS p_partkey, array_to_string(items, ',') AS shuffled FROM s WHERE i = 0""")
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed order per seed."""
    return table(spark, sf, "part").select("p_partkey", F.array_join(O.shuffled(F.lit(9), "p_partkey").cast("array<string>"), ",").alias("shuffled"))


# -- gates and rules ----------------------------------------------------------
@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'large' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderstatus = 'P' THEN 'open' ELSE 'other' END AS kind,
 CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_custkey % 2 = 0 THEN 'even' END AS flag, (o_custkey % 4 = 0 OR o_orderkey % 4 = 0 OR o_custkey % 4 = o_orderkey % 4) AS fits,
 coalesce(o_custkey % 4 <> 0 AND (CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END IS NULL OR o_custkey % 4 >= o_orderkey % 5 - 1), false) AS fresh FROM orders""")
def ordered_categories(spark: SparkSession, sf: str) -> DataFrame:
    """First rule that holds, unknowns that fit, and outputs newer than inputs."""
    a, b = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 4), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 4)
    kind = P.category(("large", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)), ("urgent", F.col("o_orderpriority").like("1%")), ("open", F.col("o_orderstatus") == "P"), rest="other")
    flag = P.first_flag(("low", F.col("o_totalprice") < 50000), ("even", F.col("o_custkey") % 2 == 0))
    fresh = P.fresh(a, F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 5))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), flag.alias("flag"), S.compatible(a, b).alias("fits"), fresh.alias("fresh"))


@query(f"""
SELECT event_id FROM {_E} WHERE value BETWEEN -5 AND 305 AND t / 86400 BETWEEN -5 AND 25 AND (user_id % 3 <> 2 OR t BETWEEN 0 AND 400000 OR t BETWEEN 600000 AND 900000)""")
def in_field_and_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Rows within a rectangle and, where spans are known, within one of them."""
    d = _events(spark, sf).withColumn("day", F.col("t") / 86400)
    span = lambda a, b: F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))
    two = F.array(span(0, 400_000), span(600_000, 900_000))
    spans = F.when(F.col("user_id") % 3 == 2, two).when(F.col("user_id") % 3 == 1, F.slice(two, 1, 0))
    return P.keep_in_spans(d.where(P.in_rectangle("value", "day", 300, 20, 5)).withColumn("spans", spans), F.col("spans"), "t").select("event_id")


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, l_returnflag AS c, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 'A' ELSE 'N' END AS side, o_totalprice AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, max((c = side)::INT) OVER (PARTITION BY l_orderkey) AS found FROM d)
SELECT l_orderkey, line, coalesce(side IS NOT NULL AND conf >= 100000 AND found = 1 AND c <> side, false) AS out_ FROM g""")
def side_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the other side are masked, unless none would be left."""
    side = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "F", "A").otherwise("N")
    d = _lines(spark, sf, F.col("l_returnflag").alias("c"), F.lit(1.0).alias("score")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), side.alias("side"), F.col("o_totalprice").alias("conf")), "l_orderkey")
    g = P.mask_other_side(d, ["l_orderkey"], "score", "c", "side", "conf", 100_000.0)
    return g.select("l_orderkey", "line", (F.col("gated") < 0).alias("out_"))


@query("""
SELECT DISTINCT l_partkey AS k, 'unknown' AS problem FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL
SELECT l_partkey, 'repeated' FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that refer to nothing allowed or come twice."""
    allowed = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    return P.violations(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")), allowed, ["k"])


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_returnflag = 'N' THEN 'N' ELSE 'A' END AS side, l_extendedprice AS p FROM lineitem),
r AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) FILTER (side = 'N') OVER (PARTITION BY l_orderkey) AS a, row_number() OVER (PARTITION BY l_orderkey, side ORDER BY p, line) AS r FROM d)
SELECT l_orderkey, line, CASE WHEN n = 6 AND r <= CASE WHEN side = 'N' THEN a - 3 ELSE n - a - 3 END THEN CASE WHEN side = 'N' THEN 'A' ELSE 'N' END ELSE side END AS balanced FROM r""")
def three_and_three(spark: SparkSession, sf: str) -> DataFrame:
    """The least confident of the larger side change over."""
    d = _lines(spark, sf, F.when(F.col("l_returnflag") == "N", "N").otherwise("A").alias("side"), F.col("l_extendedprice").alias("p"))
    d = d.withColumn("p", F.struct("p", "line"))
    return O.balance_sides(d, ["l_orderkey"], "side", "p", "N", "A").select("l_orderkey", "line", "balanced")


@query("""
WITH d AS (SELECT o_custkey, max(o_orderkey) AS asked FROM orders GROUP BY 1)
SELECT o_custkey, asked FROM d ORDER BY CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 1000 END NULLS FIRST, asked, o_custkey LIMIT 1""")
def next_request(spark: SparkSession, sf: str) -> DataFrame:
    """The newest of equal requests, then least recently run, then oldest."""
    d = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("asked"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 1000).alias("run"))
    return O.newest_request(d, ["o_custkey"], "asked", "run").select("o_custkey", "asked")


@query("""
SELECT s_suppkey, 'qm' || unnest(range(s_suppkey % 5 + 1, s_suppkey % 5 + 4)) AS item FROM supplier UNION ALL SELECT s_suppkey, 'sf' || (s_suppkey % 4) FROM supplier""")
def expanded_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of matches with ranges in them."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("qm"), (k % 5 + 1).cast("string"), F.lit("-qm"), (k % 5 + 3).cast("string"), F.lit(", sf"), (k % 4).cast("string"), F.lit(","))
    return O.range_list(table(spark, sf, "supplier").select("s_suppkey", text.alias("spec")), "spec").select("s_suppkey", "item")


# -- upserts ------------------------------------------------------------------
@query("""
WITH o AS (SELECT s_suppkey, s_name AS v, 'o' || s_nationkey AS c FROM supplier WHERE s_nationkey % 2 = 0),
n AS (SELECT s_suppkey, upper(s_name) || '!' AS v, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'n' END AS c FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN n.s_suppkey IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(n.c, o.c) AS c FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey""")
def answers_by_team(spark: SparkSession, sf: str) -> DataFrame:
    """The last writer wins per key; one field is carried over where it is missing."""
    s = table(spark, sf, "supplier")
    old = s.where("s_nationkey % 2 = 0").select("s_suppkey", F.col("s_name").alias("v"), F.concat(F.lit("o"), F.col("s_nationkey").cast("string")).alias("c"))
    new = s.where("s_acctbal > 0").select("s_suppkey", F.concat(F.upper("s_name"), F.lit("!")).alias("v"), F.when(F.col("s_nationkey") % 3 != 0, "n").alias("c"))
    return U.merge_by_team(old, new, "s_suppkey", "v", "c")


@query("""
SELECT s_suppkey, s_nationkey::BIGINT AS choice FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT s_suppkey, -1 FROM supplier WHERE s_acctbal > 5000 AND s_nationkey >= 10""")
def appended_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that weren't decided before."""
    s = table(spark, sf, "supplier")
    log = s.where("s_nationkey < 10").select("s_suppkey", F.col("s_nationkey").cast("long").alias("choice"))
    return U.append_decisions(log, s.where("s_acctbal > 5000").select("s_suppkey", F.lit(-1).cast("long").alias("choice")), ["s_suppkey"])


@query("""
SELECT s_suppkey FROM supplier WHERE (s_acctbal >= 40 AND s_nationkey / 25.0 >= 0.6 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_tax > 0.06) AND s_suppkey % 10 <> 0) OR s_suppkey % 50 = 0""")
def absent_teams(spark: SparkSession, sf: str) -> DataFrame:
    """A roster less those seen or named, with enough evidence; explicit ones always."""
    s = table(spark, sf, "supplier")
    seen = table(spark, sf, "lineitem").where("l_quantity = 50 and l_tax > 0.06").select(F.col("l_suppkey").alias("s_suppkey"))
    return U.absent(s, seen, s.where("s_suppkey % 10 = 0"), "s_suppkey", F.col("s_acctbal"), F.col("s_nationkey") / F.lit(25.0), s.where("s_suppkey % 50 = 0"))


@query("""
SELECT l_orderkey, l_linenumber::BIGINT AS line, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS retired FROM lineitem""")
def retired_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the keys that a reset names are retired."""
    bundle = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return U.marked(_lines(spark, sf), bundle, ["l_orderkey"], "retired")


# -- tracks -------------------------------------------------------------------
@query(f"""
WITH b AS (SELECT user_id, CAST(floor(t / 172800) AS BIGINT) AS bin, event_type, count(*) AS n FROM {_E} GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY user_id, bin) AS s, row_number() OVER (PARTITION BY user_id, bin ORDER BY n DESC, event_type) AS r FROM b),
p AS (SELECT user_id, bin, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY bin) AS was FROM k WHERE r = 1 AND s >= 2 AND n >= 0.5 * s),
q AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY bin) AS run FROM p),
r AS (SELECT user_id, run, min(event_type) AS side, min(bin) AS b0, max(bin) AS b1 FROM q GROUP BY ALL HAVING max(bin) - min(bin) + 1 >= 2),
l AS (SELECT *, lag(side) OVER (PARTITION BY user_id ORDER BY b0) AS ls, lag(b1) OVER (PARTITION BY user_id ORDER BY b0) AS lb FROM r)
SELECT user_id AS tid, (lb + 1 + b0) / 2.0::DOUBLE * 172800 AS cut FROM l WHERE ls <> side""")
def side_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks are cut where their side changes for good."""
    d = _events(spark, sf).select(F.col("user_id").alias("tid"), "t", F.col("event_type").alias("side"))
    return T.side_change_cuts(d, 172_800.0, 2, 0.5, 2)


@query(f"""
WITH d AS (SELECT DISTINCT user_id, t FROM {_E} WHERE user_id IN (SELECT user_id FROM {_E} WHERE value > 300)), p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM d)
SELECT user_id AS tid, (t + p) / 2 AS cut FROM p WHERE t - p > 86400""")
def unseen_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled tracks are cut in the middle of long gaps."""
    d = _events(spark, sf).withColumnRenamed("user_id", "tid")
    return T.label_gap_cuts(d.select("tid", "t"), d.where("value > 300"), 86_400.0)


@query(f"""
WITH d AS (SELECT user_id, t, min(event_type) AS v FROM {_E} GROUP BY ALL), p AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id AS tid, (pt + t) / 2 AS cut FROM p WHERE pv <> v""")
def label_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts halfway between labels that differ."""
    d = _events(spark, sf).groupBy(F.col("user_id").alias("tid"), "t").agg(F.min("event_type").alias("value"))
    return T.label_change_cuts(d)


@query(f"""
WITH d AS (SELECT user_id, t / 20000 AS t, min(value) / 20 AS x FROM {_E} GROUP BY user_id, t), p AS (SELECT *, t - lag(t) OVER w AS dt, abs(x - lag(x) OVER w) AS dist FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id AS team, round(t, 6) AS t, round(dt, 6) AS dt, round(dist, 6) AS dist FROM p WHERE dt > 0 AND dt <= 5 AND dist > ({_piecewise("dt", S.ENVELOPE_M, True)}) * 1.5""")
def impossible_jumps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps beyond the envelope between samples that are near in time."""
    d = _events(spark, sf).groupBy(F.col("user_id").alias("team"), "t").agg((F.min("value") / 20).alias("x")).select("team", (F.col("t") / 20000).alias("t"), "x", F.lit(0.0).alias("y"))
    return T.jumps(d).select("team", F.round("t", 6).alias("t"), F.round("dt", 6).alias("dt"), F.round("dist", 6).alias("dist"))


@query("""
WITH d AS (SELECT o_custkey AS team, o_orderkey AS tid, o_orderkey::DOUBLE AS t0, o_orderkey + o_orderkey % 7::DOUBLE AS t1, o_totalprice / 1000 AS x FROM orders),
n AS (SELECT *, lead(tid) OVER w AS ntid, lead(t0) OVER w - t1 AS gap, abs(lead(x) OVER w - x) AS dist FROM d WINDOW w AS (PARTITION BY team ORDER BY t0, tid))
SELECT team, tid, ntid AS next_tid, gap, round(dist, 6) AS dist, round(dist / greatest(gap, 0.001), 6) AS speed FROM n WHERE gap BETWEEN 0 AND 500 AND dist >= 1.5 AND dist / greatest(gap, 0.001) > 0.5""")
def handovers(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive tracks of one team with an impossible step between them."""
    x, t = F.col("o_totalprice") / 1000, F.col("o_orderkey")
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("team"), t.alias("tid"), t.cast("double").alias("t0"), (t + t % 7).cast("double").alias("t1"), x.alias("x0"), F.lit(0.0).alias("y0"), x.alias("x1"), F.lit(0.0).alias("y1"))
    out = T.handover_conflicts(d, 500.0, 0.5, 1.5)
    return out.select("team", "tid", "next_tid", "gap", F.round("dist", 6).alias("dist"), F.round("speed", 6).alias("speed"))


@query("""
SELECT l_orderkey AS tid, min(l_returnflag) AS team FROM lineitem GROUP BY 1 HAVING min(l_returnflag) = max(l_returnflag) AND NOT bool_or(coalesce(l_linenumber = 1 AND l_quantity < 10, false))""")
def hard_pins(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks whose labels name one team, with nothing stronger against it."""
    flag = F.when((F.col("line") == 1) & (F.col("l_quantity") < 10), "mixed")
    return T.pins(_lines(spark, sf, "l_returnflag", "l_quantity").select(F.col("l_orderkey").alias("tid"), F.col("l_returnflag").alias("team"), flag.alias("flag")))


@query("""
WITH c AS (SELECT l_orderkey AS tid, min(l_returnflag) AS s FROM lineitem GROUP BY 1 HAVING min(l_returnflag) = max(l_returnflag))
SELECT o_orderkey AS tid, CASE WHEN s IS NOT NULL AND o_orderpriority NOT LIKE '1%' THEN s ELSE o_orderstatus END AS side FROM orders LEFT JOIN c ON tid = o_orderkey""")
def coloured_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Colours onto pieces; contradicting ones cancel, pinned pieces stay."""
    o = table(spark, sf, "orders")
    labels = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_returnflag").alias("side"))
    pinned = o.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("tid"))
    return T.colour_pieces(o.select(F.col("o_orderkey").alias("tid"), F.col("o_orderstatus").alias("side")), labels, pinned).select("tid", "side")


@query("""
WITH p AS (SELECT o_custkey AS orig, o_orderkey AS tid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 END AS team FROM orders),
d AS (SELECT *, last_value(team IGNORE NULLS) OVER (PARTITION BY orig ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(team IGNORE NULLS) OVER (PARTITION BY orig ORDER BY tid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM p)
SELECT d.tid, d.b AS team FROM d JOIN orders ON o_orderkey = tid WHERE team IS NULL AND b = n AND (o_orderstatus = 'P' OR o_orderstatus = CASE b WHEN 0 THEN 'F' ELSE 'O' END) AND NOT EXISTS (SELECT 1 FROM p q WHERE q.team = d.b AND (q.tid = d.tid + 1 OR q.tid = d.tid - 1) AND q.tid % 4 = 0)""")
def sandwiched_pins(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces between two of one team take it, unless side or company speak against it."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    pieces = o.select(F.col("o_custkey").alias("orig"), k.alias("tid"), k.cast("double").alias("t0"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("side"))
    pinned = o.where("o_orderkey % 2 = 0").select(k.alias("tid"), (k % 3).alias("team"))
    some = o.where("o_orderkey % 4 = 0")
    together = some.select(k.alias("a"), (k + 1).alias("b")).union(some.select(k.alias("a"), (k - 1).alias("b")))
    sides = spark.createDataFrame([(0, "F"), (1, "O"), (2, "O")], "team long, side string")
    return T.sandwich_pins(pieces, pinned, together, sides)


@query(f"""
WITH d AS (SELECT user_id, event_id, t, value > 100 AS good FROM {_E}), p AS (SELECT *, lag(good) OVER w AS was FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
q AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> good THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM p),
g AS (SELECT user_id, run, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM q WHERE good GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t0) AS r FROM g)
SELECT user_id, n, t0, t1 FROM r WHERE r = 1""")
def longest_good_run(spark: SparkSession, sf: str) -> DataFrame:
    """The longest stretch of good rows per track."""
    return W.longest_run(_events(spark, sf), ["user_id"], ["t", "event_id"], F.col("value") > 100, "t", 2).select("user_id", "n", "t0", "t1")


@query(f"""
WITH g AS (SELECT user_id, CAST(floor(t / 43200) AS BIGINT) AS run, min(t) AS t0, max(t) AS t1, arg_min(value, t) AS x0, arg_max(value, t) AS x1, avg(value) AS mid FROM {_E} GROUP BY ALL),
n AS (SELECT *, lag(t1) OVER w AS bt, lag(x1) OVER w AS bx, lead(t0) OVER w AS nt, lead(x0) OVER w AS nx FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t0, run))
SELECT user_id, run, round(mid, 6) AS mid FROM n WHERE t1 - t0 <= 20000 AND nt - bt <= 200000 AND abs(mid - bx) >= 20 AND abs(mid - nx) >= 20""")
def short_excursions(spark: SparkSession, sf: str) -> DataFrame:
    """Short stretches that leave and come back."""
    d = _events(spark, sf).withColumn("run", F.floor(F.col("t") / 43200))
    mid = F.round(F.col("mid") * 1e6) / 1e6  # as the SQL rounds: means of 32 rows end in halves
    return W.excursions(d, ["user_id"], ["event_id"], "t", "value", "run", 20_000.0, 200_000.0, 20.0).select("user_id", "run", mid.alias("mid"))


# -- documents ----------------------------------------------------------------
def _orders_of_lines(spark: SparkSession, sf: str, *fields) -> DataFrame:
    """A document per order, with an array of its lines in order."""
    d = _lines(spark, sf, "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line", *fields))).alias("many"))


@query("""
SELECT l_orderkey AS f, l_linenumber::BIGINT AS tid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS ord, printf('%.1f,%.1f,%.1f,%.1f', l_quantity, l_linenumber::DOUBLE, l_quantity + 20, l_linenumber + 4::DOUBLE) AS box_key FROM lineitem""")
def frame_detections(spark: SparkSession, sf: str) -> DataFrame:
    """One row per detection of a frame, with a key of its box."""
    y = F.col("line").cast("double")
    frames = _orders_of_lines(spark, sf, F.col("line").alias("tid"), F.array("l_quantity", y, F.col("l_quantity") + 20, y + 4).alias("xyxy"))
    return D.detections(frames.select(F.col("l_orderkey").alias("f"), F.lit(0.0).alias("t"), F.col("many").alias("dets"))).select("f", "tid", F.col("ord").cast("long").alias("ord"), "box_key")


def _curated(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("line")
    label = [
        (F.col("l_returnflag") == "A").alias("mixed"), (F.col("l_returnflag") == "R").alias("notrobot"), (F.col("l_linestatus") == "O").alias("unknown"), F.when(k % 2 == 0, "human").otherwise("auto").alias("src"),
        F.col("l_returnflag").alias("team"), F.when(k % 3 != 0, F.when(F.col("l_quantity") > 25, "N").otherwise("A")).alias("was"), F.when(k % 4 != 0, F.col("l_partkey") * 10 + 1).alias("ms"),
    ]
    d = _orders_of_lines(spark, sf, *label)
    return d.select(F.col("l_orderkey").alias("stem"), F.col("many").alias("labels"), F.struct(F.lit(5).cast("long").alias("activeSec"), F.lit(9).cast("long").alias("wallSec")).alias("session"))


@query("""
SELECT l_orderkey AS stem, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag = 'A', l_returnflag = 'R', l_linestatus = 'O') - 1 AS ord, CASE l_returnflag WHEN 'A' THEN 'mixed' WHEN 'R' THEN 'notrobot' ELSE CASE WHEN l_linestatus = 'O' THEN 'unknown' END END AS flag FROM lineitem""")
def curator_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per label of a document, in order, with its strongest flag."""
    return D.labels(_curated(spark, sf)).select("stem", F.col("ord").cast("long").alias("ord"), "flag")


@query("""
SELECT l_orderkey AS match, count(*) AS labels, count(*) FILTER (l_linenumber % 2 = 0) AS human, round(sum(l_partkey * 10 + 1) FILTER (l_linenumber % 2 = 0 AND l_linenumber % 4 <> 0) / 1000.0::DOUBLE, 1) AS seconds FROM lineitem GROUP BY 1""")
def label_times(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, human ones and seconds on boxes per document."""
    return D.label_timing(_curated(spark, sf)).select("match", F.col("labels").cast("long").alias("labels"), F.col("human").cast("long").alias("human"), F.col("onBoxSec").alias("seconds"))


@query("""
WITH d AS (SELECT l_orderkey, l_returnflag AS team, CASE WHEN l_linenumber % 3 <> 0 THEN CASE WHEN l_quantity > 25 THEN 'N' ELSE 'A' END END AS was FROM lineitem WHERE l_linenumber % 2 = 0),
g AS (SELECT l_orderkey AS stem, count(*) AS human, count(was) AS guessed, count(*) FILTER (was = team) AS agree FROM d GROUP BY 1)
SELECT stem, human, guessed, agree, CASE WHEN guessed > 0 THEN round(agree * 100.0::DOUBLE / guessed, 1) END AS pct FROM g""")
def guess_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How often the guess shown was confirmed."""
    return D.agreement(_curated(spark, sf)).withColumnRenamed("hadGuess", "guessed")


def _shots(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "static").when(F.col("o_orderstatus") == "O", "pan").otherwise("zoom")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("shotId"), kind.alias("motionClass"), (F.col("o_orderkey") % 61).alias("durationSec"))


@query("""
WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'static' WHEN 'O' THEN 'pan' ELSE 'zoom' END AS kind, o_orderkey % 61 AS d FROM orders)
SELECT kind, sum(d)::BIGINT AS seconds, count(*) AS shots, count(*) FILTER (d > 20) AS over20, max(d) AS longest, quantile_cont(d::DOUBLE, 0.5) AS median, round(sum(d) * 100.0::DOUBLE / (SELECT sum(d) FROM s), 1) AS pct FROM s GROUP BY 1""")
def shot_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Durations by motion class."""
    return D.shot_summary(_shots(spark, sf)).withColumnRenamed("motionClass", "kind")


@query("SELECT o_orderkey AS shotId, o_orderkey % 61 AS durationSec FROM orders WHERE o_orderstatus = 'F' ORDER BY 2 DESC, 1 LIMIT 1")
def longest_static_shot(spark: SparkSession, sf: str) -> DataFrame:
    """The longest static shot."""
    return D.longest_static(_shots(spark, sf)).select("shotId", "durationSec")


@query("SELECT o_orderkey, o_custkey * 10 AS at FROM orders WHERE o_orderkey % 3 = 2 OR (o_orderkey % 4) * 700 > 1000")
def waiting_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers newer than what was processed."""
    o, at = table(spark, sf, "orders"), F.col("o_custkey") * 10
    done = o.where("o_orderkey % 3 < 2").select("o_orderkey", (at - F.col("o_orderkey") % 4 * 700).alias("at"))
    return D.waiting(o.select("o_orderkey", at.alias("at")), done, "o_orderkey")


@query("""
SELECT l_orderkey AS match, l_orderkey % 7 AS event, count(*) AS teams, count(*) FILTER (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS known FROM lineitem GROUP BY ALL""")
def route_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Teams per route document, and how many the gallery knows."""
    d = _orders_of_lines(spark, sf, F.col("l_suppkey").alias("team"))
    routes = d.select(F.col("l_orderkey").alias("match"), (F.col("l_orderkey") % 7).alias("event"), F.transform("many", lambda x: x["team"]).alias("teams"))
    return D.manifest(routes, table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("team")))


@query("""
SELECT 'm' || o_orderkey AS key, o_custkey % 9 AS number, (o_orderkey % 50) || ',' || (o_orderkey % 60) AS red, (o_custkey % 50)::VARCHAR AS blue, o_orderkey % 99 AS redScore, o_custkey % 99 AS blueScore FROM orders""")
def api_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Landed matches with alliances flattened and team keys without prefix."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    key = lambda x: F.concat(F.lit("frc"), x.cast("string"))
    side = lambda teams, score: F.struct(F.array(*teams).alias("team_keys"), score.alias("score"))
    raw = table(spark, sf, "orders").select(
        F.concat(F.lit("m"), o.cast("string")).alias("key"), F.lit("e").alias("event_key"), F.lit("qm").alias("comp_level"), F.lit(1).alias("set_number"), (c % 9).alias("match_number"), F.lit(0).alias("actual_time"),
        F.struct(side([key(o % 50), key(o % 60)], o % 99).alias("red"), side([key(c % 50)], c % 99).alias("blue")).alias("alliances"),
    )
    m = D.shape_matches(raw)
    return m.select("key", F.col("matchNumber").alias("number"), F.array_join("red", ",").alias("red"), F.array_join("blue", ",").alias("blue"), "redScore", "blueScore")


@query("SELECT page_id, 'clip' || page_id AS stem FROM pages")
def source_stems(spark: SparkSession, sf: str) -> DataFrame:
    """File names without augmentation suffix and extension."""
    name = F.concat(F.lit("clip"), F.col("page_id").cast("string"), F.lit("_jpg.rf."), F.md5("url"), F.lit(".jpg"))
    return table(spark, sf, "pages").select("page_id", D.source_stem(name).alias("stem"))


# -- measures and matching ----------------------------------------------------
@query("""
WITH s AS (SELECT l_orderkey AS match, sum(greatest(0, least(l_linenumber * 10 + l_quantity, 50) - greatest(l_linenumber * 10, 15))) AS seconds FROM lineitem GROUP BY 1)
SELECT match, seconds, round(seconds * 100 / 35, 1) AS pct FROM s""")
def clipped_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds of spans inside a window, and their share of it."""
    d = _lines(spark, sf, "l_quantity").select(F.col("l_orderkey").alias("match"), (F.col("line") * 10).cast("double").alias("lo"), (F.col("line") * 10 + F.col("l_quantity")).alias("hi"))
    return T.interval_seconds(d, 15.0, 50.0)


@query("SELECT a.s_suppkey, count(*) - 1 AS agree FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) <= 50 GROUP BY 1")
def agreeing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows lie near each row."""
    return O.agreeing_row(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal", 50.0)


@query("""
WITH m AS (SELECT l_suppkey AS team, quantile_cont(l_quantity, 0.5) AS mx, CASE WHEN l_suppkey % 2 = 0 THEN 'red' ELSE 'blue' END AS side FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
s AS (SELECT quantile_cont(mx, 0.5) FILTER (side = 'red') AS r, quantile_cont(mx, 0.5) FILTER (side = 'blue') AS b FROM m)
SELECT team, side, mx, abs(r - b) > 0.1 AND abs(mx - CASE side WHEN 'red' THEN b ELSE r END) < abs(mx - CASE side WHEN 'red' THEN r ELSE b END) AS wrong_end FROM m, s""")
def wrong_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Teams that start at the other side's end."""
    d = _lines(spark, sf, F.col("l_suppkey").alias("team"), F.col("l_quantity").alias("x")).withColumn("t", F.col("line") - 1)
    sides = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("team"), F.when(F.col("s_suppkey") % 2 == 0, "red").otherwise("blue").alias("side"))
    return T.start_sides(d, sides, 1.0, 0.1)


@query("""
WITH b AS (SELECT l_orderkey AS f, l_suppkey % 10 AS i, l_quantity AS x, l_linenumber::DOUBLE AS y FROM lineitem),
j AS (SELECT a.i AS a, b.i AS b, abs(a.x - b.x) / 40 AS dx, greatest(0, 4 - abs(a.y - b.y)) AS h, greatest(0, 40 - abs(a.x - b.x)) AS w, a.y - b.y AS low FROM b a JOIN b ON a.f = b.f AND a.i < b.i),
g AS (SELECT a, b, count(*) AS frames, quantile_cont(dx, 0.5) AS dx, quantile_cont(h / 4, 0.5) AS v, quantile_cont(w * h / (320 - w * h), 0.5) AS iou, quantile_cont(low, 0.5) AS low FROM j GROUP BY ALL)
SELECT a, b, frames, round(dx, 6) AS dx, CASE WHEN low >= 0 THEN a ELSE b END AS keeper FROM g WHERE frames >= 5 AND dx < 0.9 AND v > 0.1 AND iou > 0.01""")
def overlap_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks whose boxes mostly coincide, and which of a pair stays."""
    y = F.col("line").cast("double")
    boxes = _lines(spark, sf, F.col("l_suppkey"), "l_quantity").select(F.col("l_orderkey").alias("f"), (F.col("l_suppkey") % 10).alias("i"), F.col("l_quantity").alias("x1"), y.alias("y1"), (F.col("l_quantity") + 40).alias("x2"), (y + 4).alias("y2"))
    return J.duplicates_by_overlap(boxes, ["f"], "i", 0.9, 0.1, 0.01).select("a", "b", "frames", F.round("dx", 6).alias("dx"), "keeper")


@query("""
WITH b AS (SELECT l_orderkey AS f, l_orderkey * 10 + l_linenumber AS lid, l_suppkey % 3 AS team, l_returnflag = 'N' AS hidden, l_quantity AS x, l_linenumber::DOUBLE AS y FROM lineitem)
SELECT l.lid, min(o.team) AS team FROM b l JOIN b o ON l.f = o.f AND l.hidden AND NOT o.hidden AND greatest(0, 20 - abs(l.x - o.x)) * greatest(0, 4 - abs(l.y - o.y)) / 80 >= 0.45 GROUP BY 1 HAVING min(o.team) = max(o.team)""")
def hidden_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels whose box lies in the boxes of exactly one team."""
    y = F.col("line").cast("double")
    d = _lines(spark, sf, "l_suppkey", "l_quantity", "l_returnflag").select(F.col("l_orderkey").alias("f"), (F.col("l_orderkey") * 10 + F.col("line")).alias("lid"), (F.col("l_suppkey") % 3).alias("team"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x1"), y.alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (y + 4).alias("y2"))
    return T.reteam_hidden(d.where("flag = 'N'").drop("team", "flag"), d.where("flag != 'N'").drop("lid", "flag")).select("lid", "team")


@query("""
WITH c AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 HAVING count(*) = 3),
o AS (SELECT unnest([[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]) AS o), x AS (SELECT l_orderkey, o, list_sum(list_transform(range(3), lambda i: (p[i + 1] * (o[i + 1] + 2)) % 17)) AS cost FROM c, o)
SELECT l_orderkey, arg_min(array_to_string(o, ','), (cost, o)) AS columns_, min(cost)::DOUBLE AS cost FROM x GROUP BY 1""")
def best_naming(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows to three columns at least cost, by all orders of a small matrix."""
    d = _lines(spark, sf, "l_partkey").where("line <= 3").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line", "l_partkey"))).alias("p")).where(F.size("p") == 3)
    cost = F.transform("p", lambda x: F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda w: (x["l_partkey"] * w % 17).cast("double")))
    best = G.best_permutations(cost, 3)
    return d.select("l_orderkey", F.array_join(best["columns"].cast("array<string>"), ",").alias("columns_"), best["cost"].alias("cost"))


@query(f"""
WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS mx, quantile_cont(t / 86400, 0.5) AS my FROM {_E} GROUP BY 1 HAVING count(*) >= 6),
d AS (SELECT user_id, value AS x, t / 86400 AS y, sqrt((value - mx) * (value - mx) + (t / 86400 - my) * (t / 86400 - my)) AS d FROM {_E} JOIN m USING (user_id)),
q AS (SELECT user_id, quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.5) AS b, quantile_cont(d, 0.75) AS c FROM d GROUP BY 1)
SELECT user_id, round(quantile_cont(x, 0.5), 6) AS x, round(quantile_cont(y, 0.5), 6) AS y, count(*) AS n, round(stddev_pop(d) / sqrt(count(*)), 6) AS error FROM d JOIN q USING (user_id) WHERE d <= b + 2.5 * (c - a) GROUP BY 1 HAVING stddev_pop(d) / sqrt(count(*)) < 20""")
def robust_places(spark: SparkSession, sf: str) -> DataFrame:
    """Median places without what lies far off, where they are sure enough."""
    d = _events(spark, sf).withColumn("day", F.col("t") / 86400)
    return A.robust_location(d, "user_id", "value", "day", 6, 20.0).select("user_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", F.round("error", 6).alias("error"))
