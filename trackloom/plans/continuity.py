"""Registered queries of continuity: fragments joined over gaps. Stand-ins as in
:mod:`catalog`: a user's sessions are fragments of tracks, value and ``k`` their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import alignment as L
from trackloom.operators import assignment as G
from trackloom.operators import folds as K
from trackloom.operators import heads as H
from trackloom.operators import joins as J
from trackloom.operators import naming as N
from trackloom.operators import stitching as C
from trackloom.operators import tracks as T
from trackloom.operators import validity as V
from trackloom.operators import windows as W
from trackloom.plans.catalog import _ZERO, ORACLES, QUERIES, query
from trackloom.plans.runtime import Scratch, spread, table

__all__ = ["ORACLES", "QUERIES"]


# -- samples with a place in the plane ----------------------------------------
#: Events with seconds since the start, a place (x, y) and a fragment ``tid``.
_P = f"""(SELECT event_id, user_id, event_type, date_diff('microsecond', {_ZERO}, ts) / 1000000.0::DOUBLE AS t, value AS x, regexp_extract(props, '"k": ([0-9]+)', 1)::DOUBLE AS y FROM events)"""
_S = f"""(SELECT *, user_id * 1000 + sum(CASE WHEN p IS NULL OR t - p > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS tid FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {_P}))"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", (micros / F.lit(1000000.0)).alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    d = W.gap_islands(places(spark, sf), ["user_id"], "t", ["t", "event_id"], 3600, "seg")
    return d.withColumn("tid", (F.col("user_id") * 1000 + F.col("seg")).cast("long"))


# -- handoffs and claims ------------------------------------------------------
GATES = C.Gates(max_gap=43_200, speed=0.002, hidden=150_000, edge=12, parked_gap=300_000, parked_move=25, still=9, still_gap=400_000)
#: Outlines in order: (name, corners, closed).
STRUCTURES = (("pit", ((0, 0), (40, 0), (40, 50), (0, 50)), True), ("wall", ((120, 0), (120, 100)), False), ("tower", ((60, 60), (90, 60), (90, 90), (60, 90)), True))
_REACH = "(20 + gap / 900)"


def structures(spark: SparkSession) -> DataFrame:
    rows = [(i, n, [[float(x), float(y)] for x, y in p], closed) for i, (n, p, closed) in enumerate(STRUCTURES)]
    return spark.createDataFrame(rows, "order int, structure string, poly array<array<double>>, closed boolean")


def _outside(lo: tuple, hi: tuple, x: str, y: str) -> str:
    """Distance to an upright rectangle (or line), 0 inside."""
    return f"sqrt(greatest({lo[0]} - {x}, {x} - {hi[0]}, 0) ** 2 + greatest({lo[1]} - {y}, {y} - {hi[1]}, 0) ** 2)"


def _at(x: str, y: str) -> str:
    near = [f"{{'d': {_outside(tuple(map(min, zip(*p, strict=True))), tuple(map(max, zip(*p, strict=True))), x, y)}, 'o': {i}, 's': '{n}'}}" for i, (n, p, _) in enumerate(STRUCTURES)]
    return f"(SELECT CASE WHEN m.d <= {GATES.edge} THEN m.s END FROM (SELECT list_min([{', '.join(near)}]) AS m))"


def _transit() -> str:
    out = "CASE end_at"
    for n, p, closed in STRUCTURES:
        (x0, x1), (y0, y1) = ((min(c), max(c)) for c in zip(*p, strict=True))
        across = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        out += f" WHEN '{n}' THEN {min(GATES.hidden, across / GATES.speed + 2) if closed else GATES.hidden}"
    return out + " END"


_HANDOFFS = f"""
f0 AS (SELECT user_id, tid, min(t) AS t0, max(t) AS t1, arg_min(x, (t, x, y)) AS x0, arg_min(y, (t, x, y)) AS y0, arg_max(x, (t, x, y)) AS x1, arg_max(y, (t, x, y)) AS y1 FROM {_S} GROUP BY user_id, tid),
votes AS (SELECT tid, event_type, count(*) AS n FROM {_S} WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
kinds AS (SELECT tid, arg_min(event_type, (-n, event_type)) AS kind FROM votes GROUP BY tid),
f AS (SELECT *, {_at("x1", "y1")} AS end_at, {_at("x0", "y0")} AS start_at FROM f0 LEFT JOIN kinds USING (tid)),
j AS (SELECT a.user_id, a.tid AS a, b.tid AS b, b.t0 AS born, b.t0 - a.t1 AS gap, sqrt((b.x0 - a.x1) ** 2 + (b.y0 - a.y1) ** 2) AS dist, a.end_at, b.start_at
 FROM f a JOIN f b ON a.user_id = b.user_id AND a.t1 < b.t0 AND (a.kind IS NULL OR b.kind IS NULL OR a.kind = b.kind)),
h AS (SELECT *, coalesce(end_at = start_at AND (gap <= {_transit()} OR gap <= {GATES.parked_gap} AND dist <= {GATES.parked_move}), false) AS hidden FROM j),
edges AS MATERIALIZED (SELECT user_id, a, b, born, CASE WHEN gap <= {GATES.max_gap} THEN dist / {_REACH} WHEN hidden THEN least(dist / {GATES.parked_move}, 0.99) ELSE dist / {GATES.still} END AS score,
 CASE WHEN gap <= {GATES.max_gap} THEN 'near' WHEN hidden THEN 'hidden' ELSE 'still' END AS why FROM h
 WHERE CASE WHEN gap <= {GATES.max_gap} THEN dist <= {_REACH} ELSE hidden OR gap <= {GATES.still_gap} AND dist <= {GATES.still} END)"""
#: Fragments one after the other: what is free, whom it claims.
_CLAIMS = """
wish AS MATERIALIZED (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY born, b) AS n, list({'score': score, 'a': a} ORDER BY score, a) AS l FROM edges GROUP BY user_id, b, born),
step AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS score FROM wish WHERE n = 1
 UNION ALL SELECT user_id, n, CASE WHEN ok THEN list_append(taken, free[1].a) ELSE taken END, CASE WHEN ok THEN free[1].a END, CASE WHEN ok THEN b END, free[1].score FROM (
  SELECT user_id, n, taken, b, free, len(free) > 0 AND (len(free) = 1 OR free[2].score >= 1.5 * free[1].score) AS ok FROM (
   SELECT w.user_id, w.n, s.taken, w.b, list_filter(w.l, lambda c: NOT list_contains(s.taken, c.a)) AS free FROM step s JOIN wish w ON w.user_id = s.user_id AND w.n = s.n + 1)))"""


def _frags(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    return C.fragments(sessions(spark, sf).withColumn("kind", kinds), "user_id", "tid", "t", "x", "y", "kind")


@query(f"WITH {_HANDOFFS} SELECT user_id, a::BIGINT AS a, b::BIGINT AS b, round(score, 6) AS score, why FROM edges")
def fragment_handoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Which fragments may continue which: near, behind one structure, or on one spot."""
    e = C.handoffs(_frags(spark, sf), "user_id", GATES, F.expr(_REACH), structures(spark), Scratch(spark, "handoffs"))
    return e.select("user_id", "a", "b", F.round("score", 6).alias("score"), "why")


@query(f"WITH RECURSIVE {_HANDOFFS}, {_CLAIMS} SELECT user_id, a, b, round(score, 6) AS score FROM step WHERE a IS NOT NULL")
def fragment_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Handoffs that hold when fragments claim their predecessors in order of birth."""
    scratch = Scratch(spark, "claims")
    e = C.handoffs(_frags(spark, sf), "user_id", GATES, F.expr(_REACH), structures(spark), scratch)
    return C.claims(e, "user_id", scratch).withColumn("score", F.round("score", 6))


@query(f"""
WITH RECURSIVE {_HANDOFFS}, {_CLAIMS}, links AS (SELECT a, b FROM step WHERE a IS NOT NULL),
walk AS (SELECT tid, tid AS place FROM f0 UNION ALL SELECT walk.tid, links.a FROM walk JOIN links ON links.b = walk.place)
SELECT user_id, tid::BIGINT AS tid, (SELECT min_by(w.place, o.t0) FROM walk w JOIN f0 o ON o.tid = w.place WHERE w.tid = f0.tid)::BIGINT AS track FROM f0""")
def stitched_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Every fragment's track: the first fragment of its chain."""
    return C.stitch(_frags(spark, sf), "user_id", GATES, F.expr(_REACH), Scratch(spark, "stitch"), structures(spark))


# -- exact naming -------------------------------------------------------------
#: Six customers are the tracks of a match, labels 0 to 2; who shares a nation was seen at once.
_CUST = """t AS (SELECT c_custkey AS c, c_custkey // 6 AS match, (c_custkey % 6)::INT AS i, c_nationkey AS nation, c_acctbal AS bal, (c_custkey * 7919) % 1000 / 10.0::DOUBLE AS t0, (c_custkey * 104729) % 97 / 5.0::DOUBLE AS x0, (c_custkey * 1299709) % 89 / 10.0::DOUBLE AS x1 FROM customer)"""
_LABELS = 3


def _knots(x: str) -> str:
    """The SQL of :func:`scalars.distance_budget`."""
    k = S.ENVELOPE_M
    out = f"CASE WHEN {x} <= {k[0][0]} THEN {k[0][1]}::DOUBLE"
    for (t0, d0), (t1, d1) in zip(k, k[1:], strict=False):
        out += f" WHEN {x} <= {t1} THEN {d0}::DOUBLE + {d1 - d0!r}::DOUBLE * ({x} - {t0}::DOUBLE) / {t1 - t0!r}::DOUBLE"
    (ta, da), (tb, db) = k[-2:]
    return f"({out} ELSE {db}::DOUBLE + {(db - da) / (tb - ta)!r}::DOUBLE * ({x} - {tb}::DOUBLE) END)"


def _naming(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    t = table(spark, sf, "customer").select(
        F.floor(c / 6).alias("match"), (c % 6).cast("int").alias("i"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"),
        (c * 7919 % 1000 / F.lit(10.0)).alias("t0"), (c * 104_729 % 97 / F.lit(5.0)).alias("x0"), (c * 1_299_709 % 89 / F.lit(10.0)).alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"),
    ).withColumn("t1", F.col("t0") + 4)
    pin = F.when(F.col("bal") > 9500, (F.col("nation") % _LABELS).cast("int"))
    tracks = t.select("match", "i", N.park_cost(F.abs("bal")).alias("park"), pin.alias("pin"))
    votes = F.pmod(F.floor("bal") + F.col("k") * F.col("nation") * 37, F.lit(23))
    wrong = F.pmod(F.floor("bal"), F.lit(2)) != F.col("k") % 2
    scores = t.withColumn("k", F.explode(F.array(*map(F.lit, range(_LABELS))))).select("match", "i", "k", N.vote_score(votes, wrong, F.pmod(F.floor("bal"), F.lit(5)) / F.lit(4.0)).cast("long").alias("score"))
    a, b = (t.select("match", "nation", F.col("i").alias(n)) for n in "ij")
    seen = a.join(b, ["match", "nation"]).where("i < j").select("match", "i", "j", F.lit(None).cast("long").alias("weight"))
    return N.problems(tracks, scores, seen.unionByName(N.pair_costs(t, "match")), "match")


_NAMED = """
@tracks,
u AS (SELECT match, i, k::INT AS k, CASE WHEN bal > 9500 AND k <> nation % 3 THEN NULL WHEN k = 3 THEN -floor(40 * ln(1 + abs(bal)))::BIGINT
  ELSE (floor(bal)::BIGINT + k * nation * 37) % 23 * 10 + CASE WHEN (floor(bal)::BIGINT + k * nation * 37) % 23 < 0 THEN 230 ELSE 0 END
   - CASE WHEN abs(floor(bal)::BIGINT) % 2 <> k % 2 THEN round(250 * ((floor(bal)::BIGINT % 5 + 5) % 5) / 4.0::DOUBLE)::BIGINT ELSE 0 END END AS s, CASE WHEN bal > 9500 THEN nation % 3 END AS pin FROM t, range(4) r(k)),
g AS (SELECT a.match, a.i AS p, b.i AS q, b.t0 - (a.t0 + 4) AS gap, abs(b.x0 - a.x1) AS d FROM t a JOIN t b ON a.match = b.match AND a.i <> b.i AND a.t0 + 4 <= b.t0 AND b.t0 - (a.t0 + 4) <= 25),
w AS (SELECT match, least(p, q) AS i, greatest(p, q) AS j, -(CASE WHEN d > @budget THEN floor(120 * least((d - @budget) / @budget, 3)) ELSE 0 END + floor(2 * gap))::BIGINT AS w FROM g),
n AS (SELECT a.match, a.i, b.i AS j FROM t a JOIN t b ON a.match = b.match AND a.nation = b.nation AND a.i < b.i WHERE NOT (a.bal > 9500 AND b.bal > 9500)),
m AS (SELECT match, max(i) + 1 AS n, list(i ORDER BY i) AS ids FROM t GROUP BY match),
l AS (SELECT match, ids, [a, b, c, d, e, f][1:n] AS labels FROM m, range(4) r1(a), range(4) r2(b), range(4) r3(c), range(4) r4(d), range(4) r5(e), range(4) r6(f) WHERE n = len(ids) AND (n > 5 OR f = 0) AND (n > 4 OR e = 0) AND (n > 3 OR d = 0) AND (n > 2 OR c = 0) AND (n > 1 OR b = 0)),
ok AS (SELECT match, labels FROM l WHERE list_contains(labels, 0) AND list_contains(labels, 1) AND list_contains(labels, 2)),
us AS (SELECT match, list({'i': i, 'k': k, 's': s}) AS us FROM u GROUP BY match), ws AS (SELECT match, list({'i': i, 'j': j, 'w': w}) AS ws FROM w GROUP BY match), ns AS (SELECT match, list({'i': i, 'j': j}) AS ns FROM n GROUP BY match),
v AS MATERIALIZED (SELECT match, labels, (list_sum(list_transform(us, lambda z: CASE WHEN labels[z.i + 1] = z.k THEN coalesce(z.s, -1000000000) ELSE 0 END))
   + coalesce(list_sum(list_transform(ws, lambda z: CASE WHEN labels[z.i + 1] = labels[z.j + 1] AND labels[z.i + 1] < 3 THEN z.w ELSE 0 END)), 0)
   + coalesce(list_sum(list_transform(ns, lambda z: CASE WHEN labels[z.i + 1] = labels[z.j + 1] AND labels[z.i + 1] < 3 THEN -1000000000 ELSE 0 END)), 0))::BIGINT AS v
 FROM ok JOIN us USING (match) LEFT JOIN ws USING (match) LEFT JOIN ns USING (match)),
best AS (SELECT match, labels, v FROM (SELECT *, row_number() OVER (PARTITION BY match ORDER BY v DESC, labels) AS r FROM v WHERE v > -100000000) WHERE r = 1),
alt AS (SELECT match, labels, v FROM (SELECT v.*, row_number() OVER (PARTITION BY v.match ORDER BY v.v DESC, v.labels) AS r FROM v JOIN best b ON b.match = v.match
 WHERE v.v > -100000000 AND list_bool_or(list_transform(range(1, len(b.labels) + 1), lambda i: b.labels[i] < 3 AND v.labels[i] <> b.labels[i]))) WHERE r = 1)""".replace("@tracks", _CUST).replace("@budget", _knots("gap"))


@query(f"""
WITH {_NAMED} SELECT b.match, i::INT AS i, CASE WHEN b.labels[i + 1] < 3 THEN b.labels[i + 1] END::INT AS label, CASE WHEN a.labels[i + 1] < 3 THEN a.labels[i + 1] END::INT AS other,
 coalesce(a.labels[i + 1] <> b.labels[i + 1], false) AS unstable, b.v AS value, b.v - a.v AS gap FROM best b LEFT JOIN alt a USING (match), unnest(range(len(b.labels))) r(i)""")
def exact_naming(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks to labels at the best value, and what the best differing answer changes."""
    return N.named(_naming(spark, sf), "match", _LABELS, Scratch(spark, "naming"), budget=300)


# -- appearance ---------------------------------------------------------------
@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
x AS (SELECT vec_id, label, (generate_subscripts(v, 1) - 1)::INT AS i, unnest(v) AS x FROM e),
c AS (SELECT vec_id, label, i, x - avg(x) OVER (PARTITION BY i) AS x, x - avg(x) OVER (PARTITION BY i, label) AS y FROM x),
l AS (SELECT vec_id, list(x ORDER BY i) AS x, list(y ORDER BY i) AS y FROM c GROUP BY vec_id)
SELECT i::INT AS i, j::INT AS j, round(sum(x[i + 1] * x[j + 1]), 6) AS total, round(sum(y[i + 1] * y[j + 1]), 6) AS within FROM l, range(64) a(i), range(64) b(j) GROUP BY ALL""")
def appearance_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Scatter of appearance vectors, in all and within labels: what a head is fitted from."""
    cells, _, _, _ = H.scatter(table(spark, sf, "embeddings"), "label", "embedding", Scratch(spark, "scatter"))
    return cells.select("i", "j", F.round("total", 6).alias("total"), F.round("within", 6).alias("within"))


# -- validity -----------------------------------------------------------------
_VERDICT = "CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 'cut' WHEN 'purchase' THEN 'moved' ELSE 'ok' END"


@query(f"""
WITH e AS (SELECT user_id, t, {_VERDICT} AS v FROM {_P}), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, v ORDER BY t) AS g FROM e WHERE v IS NOT NULL),
r AS (SELECT user_id, v, count(*) AS n, min(t) AS first, v = 'ok' AS good FROM s GROUP BY user_id, v, g),
m AS (SELECT user_id, good, first, 1 AS o FROM r WHERE n >= CASE v WHEN 'cut' THEN 3 ELSE 2 END UNION ALL SELECT user_id, true, min(t), 0 FROM e GROUP BY user_id UNION ALL SELECT user_id, false, max(t), 2 FROM e GROUP BY user_id),
w AS (SELECT *, lag(good) OVER (PARTITION BY user_id ORDER BY o, first) AS was FROM m), u AS (SELECT * FROM w WHERE was IS NULL OR was <> good),
p AS (SELECT *, lead(first) OVER z AS stop, lead(o) OVER z AS how FROM u WINDOW z AS (PARTITION BY user_id ORDER BY o, first)),
q AS (SELECT user_id, first AS lo, CASE WHEN how = 2 THEN stop ELSE coalesce((SELECT max(e.t) FROM e WHERE e.user_id = p.user_id AND e.v = 'ok' AND e.t < p.stop), first) END AS hi FROM p WHERE good AND stop IS NOT NULL)
SELECT user_id, lo, hi FROM q WHERE hi - lo >= 3600 AND hi > lo""")
def trusted_spans(spark: SparkSession, sf: str) -> DataFrame:
    """When a view counts as good: verdicts that last change the state."""
    e = places(spark, sf).withColumn("v", F.expr(_VERDICT))
    return V.valid_spans(e, "user_id", "t", "v", sample=3600.0, lasting={"cut": 10_800.0}, bucket=500_000.0)


# -- folds over what was accepted ---------------------------------------------
@query(f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM (SELECT event_id, user_id, t, x AS h, x + y AS b FROM {_P})),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BOOLEAN AS whole, []::STRUCT(t DOUBLE, h DOUBLE, b DOUBLE)[] AS past FROM e WHERE n = 1
 UNION ALL SELECT user_id, n, event_id, ok, CASE WHEN ok THEN list_append(near, {{'t': t, 'h': h, 'b': b}}) ELSE near END FROM (
  SELECT *, NOT (len(near) >= 3 AND h < 0.7 * tall AND low - b > 0.25 * tall) AS ok FROM (
   SELECT *, list_aggregate(list_transform(near, lambda p: p.h), 'median') AS tall, list_aggregate(list_transform(near, lambda p: p.b), 'median') AS low FROM (
    SELECT e.user_id, e.n, e.event_id, e.t, e.h, e.b, list_filter(s.past, lambda p: p.t >= e.t - 100000) AS near FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))))
SELECT event_id, coalesce(whole, true) AS whole FROM s WHERE event_id IS NOT NULL""")
def whole_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that don't show a part only, by the accepted ones before them."""
    e = places(spark, sf).select("event_id", "user_id", "t", F.col("x").alias("h"), (F.col("x") + F.col("y")).alias("b"))
    return K.whole_boxes(e, ["user_id"], "t", ["event_id"], "h", "b", window=100_000, least=3).select("event_id", "whole")


# -- groups, boxes and colours ------------------------------------------------
_TRIPLES = "[[0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]"


@query(f"""
WITH l AS (SELECT l_orderkey AS m, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g, l_suppkey % 3 AS k, l_linestatus AS s FROM lineitem),
gs AS (SELECT m, g, CASE WHEN count(*) > 1 THEN CASE min(s) WHEN 'O' THEN 'red' ELSE 'blue' END END AS side FROM l GROUP BY m, g), v AS (SELECT m, g, k, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT m, g, count(*) AS total FROM l GROUP BY ALL),
c AS (SELECT gs.m, gs.g, r.k, 50.0::DOUBLE - coalesce(v.n, 0) * 100.0::DOUBLE / a.total + CASE WHEN gs.side <> CASE WHEN r.k = 1 THEN 'blue' ELSE 'red' END THEN 500 ELSE 0 END AS c
 FROM gs CROSS JOIN range(3) r(k) JOIN a USING (m, g) LEFT JOIN v ON v.m = gs.m AND v.g = gs.g AND v.k = r.k),
x AS (SELECT m, map_from_entries(list((g * 3 + k, c))) AS c FROM c GROUP BY m),
p AS (SELECT m, p, round(list_sum(list_transform([0, 1, 2], lambda i: coalesce(c[i * 3 + p[i + 1]], 50.0::DOUBLE))), 9) AS cost FROM x, unnest({_TRIPLES}) u(p)),
b AS (SELECT m, arg_min(p, (cost, p)) AS p, min(cost) AS cost FROM p GROUP BY m)
SELECT b.m AS match, gs.g::INT AS g, 'T' || p[gs.g + 1] AS team, round(cost, 6) + 0.0::DOUBLE AS cost FROM b JOIN gs USING (m)""")
def named_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups named by teams at least cost: votes and sides."""
    g = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match"), g.alias("g"), F.concat(F.lit("T"), F.col("l_suppkey") % 3).alias("team"), F.col("l_linestatus").alias("s"))
    lines = spread(lines, "match")
    groups = lines.groupBy("match", "g").agg(F.when(F.count("*") > 1, F.when((F.count_if(F.col("s") < "O") == 0) & (F.count_if(F.col("s") == "O") > 0), "red").otherwise("blue")).alias("side"))
    votes = lines.groupBy("match", "g", "team").agg(F.count("*").alias("n"))
    k = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    teams = lines.select("match").distinct().select("match", k).select("match", "k", F.concat(F.lit("T"), "k").alias("team"), F.when(F.col("k") == 1, "blue").otherwise("red").alias("side"))
    return G.name_groups(groups, votes, teams, "match", 3).withColumn("cost", F.round("cost", 6) + F.lit(0.0))  # no negative zero


@query("""
WITH RECURSIVE b AS (SELECT l_orderkey AS o, l_linestatus AS kind, (l_quantity * 4)::DOUBLE AS x1, (l_partkey % 50)::DOUBLE AS y1, (l_quantity * 4 + 30)::DOUBLE AS x2, (l_partkey % 50 + 40)::DOUBLE AS y2,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_quantity, l_linenumber, l_partkey % 50) AS n FROM lineitem),
s AS (SELECT o, 0::BIGINT AS n, []::STRUCT(kind VARCHAR, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, n INT)[] AS done FROM b WHERE n = 1
 UNION ALL SELECT o, n, CASE WHEN spot IS NULL OR spot = 0 THEN list_append(done, {'kind': kind, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'n': 1::INT})
  ELSE list_transform(done, lambda m, i: CASE WHEN i = spot THEN {'kind': m.kind, 'x1': least(m.x1, x1), 'y1': least(m.y1, y1), 'x2': greatest(m.x2, x2), 'y2': greatest(m.y2, y2), 'n': (m.n + 1)::INT} ELSE m END) END FROM (
  SELECT b.*, s.done, list_position(list_transform(s.done, lambda m: m.kind = b.kind AND least(b.y2, m.y2) - greatest(b.y1, m.y1) > 0
    AND least(b.y2, m.y2) - greatest(b.y1, m.y1) >= 0.5 * least(b.y2 - b.y1, m.y2 - m.y1) AND greatest(b.x1, m.x1) - least(b.x2, m.x2) <= 18), true) AS spot
  FROM s JOIN b ON b.o = s.o AND b.n = s.n + 1)),
e AS (SELECT o, arg_max(done, n) AS done FROM s GROUP BY o), u AS (SELECT o, unnest(done) AS d FROM e)
SELECT o AS l_orderkey, d.kind AS kind, d.x1 AS x1, d.y1 AS y1, d.x2 AS x2, d.y2 AS y2, d.n AS n FROM u""")
def fused_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of boxes fused to whole ones, by kind and left edge."""
    x, y = F.col("l_quantity") * 4, F.col("l_partkey") % 50
    box = F.struct("l_linenumber", F.struct(F.col("l_linestatus").alias("kind"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 40).alias("y2")).alias("b"))
    images = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(box)), lambda r: r["b"]).alias("boxes"))
    return images.select("l_orderkey", F.explode(G.fused_boxes(F.col("boxes"))).alias("f")).select("l_orderkey", "f.*")


@query()
def coloured_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments dealt to six robots in order of birth; those that overlap in time stay apart."""
    f = _frags(spark, sf).withColumnRenamed("kind", "side").withColumn("n", F.lit(1).cast("long"))
    spans = f.select("user_id", "tid", "t0", (F.col("t1") + 7200).alias("t1"))
    together = J.interval_overlap(spans, "user_id", "tid", "t0", "t1", 86_400.0)
    votes = sessions(spark, sf).groupBy("user_id", "tid", F.col("event_type").alias("team")).agg(F.count("*").alias("n"))
    return G.colour_tracks(f, together, votes, "user_id", speed=0.01, gap_cost=0.0001)


# -- rebinding behind structures ----------------------------------------------
_LOOKS = 8


@query(f"""
WITH RECURSIVE {_HANDOFFS},
look AS (SELECT tid, list_transform(range(1, {_LOOKS} + 1), lambda i: embedding[i]::DOUBLE) AS v FROM f0 JOIN embeddings ON vec_id = tid % (SELECT count(*) FROM embeddings)),
unit AS (SELECT tid, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM look),
pair AS (SELECT h.user_id, h.a, h.b, h.born, h.gap, h.end_at AS region, 1 - list_inner_product(p.v, q.v) AS cos FROM h JOIN unit p ON p.tid = h.a JOIN unit q ON q.tid = h.b WHERE hidden AND gap <= {GATES.parked_gap}),
wish AS MATERIALIZED (SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY born, b) AS n, list({{'cos': cos, 'a': a, 'gap': gap, 'region': region}} ORDER BY cos, a) AS l FROM pair GROUP BY user_id, b, born),
step AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS gone, NULL::BIGINT AS b, NULL::BIGINT AS best, NULL::VARCHAR AS region, NULL::DOUBLE AS gap, NULL::DOUBLE AS cos, NULL::DOUBLE AS runner_up FROM wish WHERE n = 1
 UNION ALL SELECT user_id, n, CASE WHEN ok THEN list_append(gone, b) ELSE gone END, b, CASE WHEN ok THEN free[1].a END, free[1].region, free[1].gap, free[1].cos, free[2].cos FROM (
  SELECT *, len(free) > 0 AND free[1].cos <= 0.8 AND (len(free) = 1 OR free[2].cos >= 1.25 * free[1].cos) AS ok FROM (
   SELECT w.user_id, w.n, s.gone, w.b, list_filter(w.l, lambda c: NOT list_contains(s.gone, c.a)) AS free FROM step s JOIN wish w ON w.user_id = s.user_id AND w.n = s.n + 1))),
held AS (SELECT * FROM step WHERE best IS NOT NULL),
walk AS (SELECT b, best AS place FROM held UNION ALL SELECT walk.b, held.best FROM walk JOIN held ON held.b = walk.place)
SELECT user_id, (SELECT arg_min(w.place, o.t0) FROM walk w JOIN f0 o ON o.tid = w.place WHERE w.b = held.b)::BIGINT AS keep, b::BIGINT AS absorbed, best::BIGINT AS best, region, round(gap, 6) AS gap, round(cos, 6) AS cos, round(runner_up, 6) AS runner_up FROM held""")
def rebound_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments that went on behind a structure, chosen by their looks."""
    f, e = _frags(spark, sf), table(spark, sf, "embeddings")
    n = e.count()
    looks = f.select("user_id", "tid", (F.col("tid") % n).alias("vec_id")).join(e.select("vec_id", F.slice("embedding", 1, _LOOKS).alias("v")), "vec_id").drop("vec_id")
    out = C.rebinds(f, looks, "user_id", GATES, structures(spark), Scratch(spark, "rebinds"))
    return out.withColumns({c: F.round(c, 6) for c in ("gap", "cos", "runner_up")})


# -- leaps inside joined tracks -----------------------------------------------
@query(f"""
WITH d AS (SELECT event_id, user_id, user_id % 10 AS match, floor(t)::BIGINT AS f, tid, t, x, y AS y2, 10 + y / 10 AS w FROM {_S}),
l AS (SELECT *, t - lag(t) OVER o AS dt, sqrt((x - lag(x) OVER o) ** 2 + (y2 - lag(y2) OVER o) ** 2) / ((w + lag(w) OVER o) / 2) AS leap, min({{'f': f, 'd': event_id}}) OVER (PARTITION BY user_id) AS first FROM d WINDOW o AS (PARTITION BY user_id ORDER BY t, x, event_id)),
c AS (SELECT *, coalesce(dt > 0 AND leap > greatest(9, dt * 0.0005), false) AS cut FROM l), n AS (SELECT *, sum(cut::INT) OVER (PARTITION BY user_id ORDER BY t, x, event_id) AS n FROM c),
r AS (SELECT user_id, n, row_number() OVER (PARTITION BY match ORDER BY first, user_id, n) + (SELECT max(greatest(tid, user_id)) FROM d e WHERE e.match = n.match) AS fresh FROM n WHERE cut)
SELECT event_id, coalesce(fresh, tid)::BIGINT AS new_tid, coalesce(fresh, n.user_id)::BIGINT AS track FROM n LEFT JOIN r ON r.user_id = n.user_id AND r.n = n.n""")
def severed_leaps(spark: SparkSession, sf: str) -> DataFrame:
    """Joined tracks cut at leaps of their box, with fresh ids per match."""
    wide = F.lit(10) + F.col("y") / 10
    half = wide / 2
    d = sessions(spark, sf).select("event_id", "user_id", (F.col("user_id") % 10).alias("match"), F.floor("t").alias("f"), F.col("event_id").alias("d"), "tid", "t", (F.col("x") - half).alias("x1"), F.lit(0.0).alias("y1"), (F.col("x") + half).alias("x2"), F.col("y").alias("y2"), "x", wide.alias("w"))
    joined = d.select("match", "tid", F.col("user_id").alias("track")).distinct()
    return T.sever_leaps(d, joined, "match", per_second=0.0005, least=9.0, centre=F.col("x"), width=F.col("w")).select("event_id", "new_tid", "track")


# -- placing a snippet in a clip ----------------------------------------------
_STEPS = f"c AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, [x, y, hour_, 40.0] AS v FROM (SELECT *, (floor(t / 3600)::BIGINT % 24)::DOUBLE AS hour_ FROM {_P}))"


@query(f"""
WITH {_STEPS}, s AS (SELECT clip, clip * 2 AS snippet, i - 15 AS i, list_transform(v, lambda a: a + (i % 3)) AS v FROM c WHERE i BETWEEN 15 AND 26 UNION ALL SELECT clip - 1, clip * 2 - 1, i - 15, v FROM c WHERE i BETWEEN 15 AND 26),
cc AS (SELECT clip, i, list_transform(v, lambda a: a - list_avg(v)) AS v FROM c), ss AS (SELECT clip, snippet, i, list_transform(v, lambda a: a - list_avg(v)) AS v FROM s),
w AS (SELECT snippet, count(*) AS n, sum(list_inner_product(v, v)) AS power FROM ss GROUP BY snippet HAVING count(*) >= 10),
h AS (SELECT ss.clip, ss.snippet, cc.i - ss.i AS o, count(*) AS m, sum(list_inner_product(ss.v, cc.v)) AS x, sum(list_inner_product(cc.v, cc.v)) AS held FROM ss JOIN cc ON cc.clip = ss.clip GROUP BY ALL),
p AS (SELECT clip, snippet, o, round(x / sqrt(power * held), 9) AS score FROM h JOIN w USING (snippet) WHERE m = n AND o >= 0),
b AS (SELECT clip, snippet, arg_max(o, (score, -o)) AS o, max(score) AS score FROM p GROUP BY ALL),
r AS (SELECT b.clip, b.snippet, b.o, b.score, coalesce((SELECT max(p.score) FROM p WHERE p.clip = b.clip AND p.snippet = b.snippet AND abs(p.o - b.o) > 2), 0) AS second FROM b)
SELECT clip, snippet, o::BIGINT AS "offset", round(score, 6) AS score, round(second, 6) AS runner_up, score >= 0.9 AND score - second >= 0.05 AS found FROM r""")
def located_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Where twelve steps of a user, and of the next one, lie in the user's sequence."""
    p = places(spark, sf)
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1).cast("long")
    hour = (F.floor(F.col("t") / 3600) % 24).cast("double")
    c = p.select(F.col("user_id").alias("clip"), n.alias("i"), F.array("x", "y", hour, F.lit(40.0)).alias("v"))
    part = c.where(F.col("i").between(15, 26))
    own = part.select("clip", (F.col("clip") * 2).alias("snippet"), (F.col("i") - 15).alias("i"), F.transform("v", lambda a: a + F.col("i") % 3).alias("v"))
    other = part.select((F.col("clip") - 1).alias("clip"), (F.col("clip") * 2 - 1).alias("snippet"), (F.col("i") - 15).alias("i"), "v")
    out = L.located(c, own.unionByName(other), apart=2, score=0.9, margin=0.05)
    return out.withColumns({"score": F.round("score", 6), "runner_up": F.round("runner_up", 6)})


# -- one segmentation for all later steps -------------------------------------
def _split(k: int, name: str, cols: str) -> str:
    """A table cut at ``c{k}``, with the ids of ``i{k}``."""
    return f"""{name}{k} AS (SELECT {cols}, coalesce(i.id, d.tid)::BIGINT AS tid FROM (SELECT *, (SELECT count(*) FROM c{k} WHERE c{k}.tid = {name}{k - 1}.tid AND c{k}.cut <= {name}{k - 1}.t) AS n FROM {name}{k - 1}) d LEFT JOIN i{k} i ON i.tid = d.tid AND i.n = d.n)"""


def _ids(k: int) -> str:
    return f"""i{k} AS (SELECT tid, n, row_number() OVER (ORDER BY tid, n) + (SELECT max(tid) FROM d{k - 1}) AS id FROM (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY cut) AS n FROM c{k}))"""


@query(f"""
WITH d0 AS (SELECT event_id, user_id AS source, user_id AS tid, t, event_type AS side FROM {_P} WHERE x < 200 AND (t <= 900000 OR t >= 1000000)),
v0 AS (SELECT user_id AS tid, t, event_type AS team FROM {_P} WHERE event_type IN ('click', 'purchase', 'view')),
sb AS (SELECT tid, floor(t / 172800)::BIGINT AS bin, side, count(*) AS n FROM d0 GROUP BY ALL), sk AS (SELECT *, sum(n) OVER (PARTITION BY tid, bin) AS s, row_number() OVER (PARTITION BY tid, bin ORDER BY n DESC, side) AS r FROM sb),
sp AS (SELECT tid, bin, side, lag(side) OVER (PARTITION BY tid ORDER BY bin) AS was FROM sk WHERE r = 1 AND s >= 2 AND n >= 0.5 * s),
sq AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> side THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY bin) AS run FROM sp), sr AS (SELECT tid, run, min(side) AS side, min(bin) AS b0, max(bin) AS b1 FROM sq GROUP BY ALL HAVING max(bin) - min(bin) + 1 >= 2),
sl AS (SELECT *, lag(side) OVER (PARTITION BY tid ORDER BY b0) AS ls, lag(b1) OVER (PARTITION BY tid ORDER BY b0) AS lb FROM sr), c1 AS (SELECT DISTINCT tid, (lb + 1 + b0) / 2.0::DOUBLE * 172800 AS cut FROM sl WHERE ls <> side),
{_ids(1)}, {_split(1, "d", "event_id, source, t")}, {_split(1, "v", "team, t")},
vc AS (SELECT tid, floor(t / 259200)::BIGINT AS bin, team, count(*) AS n, min(t) AS f FROM v1 GROUP BY ALL), vv AS (SELECT tid, bin, arg_max(team, (n, -f, team)) AS winner FROM vc GROUP BY ALL HAVING sum(n) >= 2),
vl AS (SELECT *, lag(winner) OVER w AS pw, lag(bin) OVER w AS pb FROM vv WINDOW w AS (PARTITION BY tid ORDER BY bin)), c2 AS (SELECT DISTINCT tid, (pb + bin) / 2.0::DOUBLE * 259200 + 129600 AS cut FROM vl WHERE pw <> winner),
{_ids(2)}, {_split(2, "d", "event_id, source")}
SELECT event_id, source, tid FROM d2""")
def prepared_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Filters, then cuts by side and by votes, each on what the one before left."""
    e = places(spark, sf)
    d = e.select("event_id", F.col("user_id").alias("tid"), "t", F.col("event_type").alias("side"), "x")
    v = e.where("event_type in ('click', 'purchase', 'view')").select(F.col("user_id").alias("tid"), "t", F.col("event_type").alias("team"))
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1.0, 900_000.0), (1_000_000.0, 1e12))])
    side, vote = {"width": 172_800.0, "least": 2, "pure": 0.5, "run": 2}, {"width": 259_200.0, "least": 2}
    out, _ = T.prepared(d, v, Scratch(spark, "prepared"), inside=F.col("x") < 200, spans=spans, side=side, vote=vote)
    return out.select("event_id", "source", "tid")
