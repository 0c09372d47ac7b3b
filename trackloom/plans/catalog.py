"""All registered queries of the library and their SQL counterparts.

Driver tables stand in for the domain: ``events`` for track samples (user: track,
ts: time, value: position, event_type: side), ``lineitem`` and ``orders`` for
observations and matches, ``embeddings`` for appearance vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import aggregates as A
from trackloom.operators import appearance as M
from trackloom.operators import filters as P
from trackloom.operators import gallery_index, graph
from trackloom.operators import joins as J
from trackloom.operators import selection as O
from trackloom.operators import upserts as U
from trackloom.operators import windows as W
from trackloom.plans.runtime import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_ZERO = "TIMESTAMP '2024-01-01 00:00:00'"
#: Events with seconds since the start, the shared SQL side of ``_events``.
_E = f"(SELECT event_id, user_id, event_type, value, props, date_diff('microsecond', {_ZERO}, ts) / 1000000.0::DOUBLE AS t FROM events)"


def _events(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", (micros / F.lit(1000000.0)).alias("t"), *extra)


def _long(*names: str) -> dict:
    return {n: F.col(n).cast("long") for n in names}


# -- scouting analogues -------------------------------------------------------
@query("""
SELECT l_suppkey AS team, count(*) FILTER (l_linestatus <> 'O') AS matches, count(*) FILTER (l_linestatus = 'O') AS no_shows,
  round(coalesce(sum(l_quantity) FILTER (l_linestatus <> 'O'), 0) / greatest(count(*) FILTER (l_linestatus <> 'O'), 1), 6) AS avg_qty,
  CAST(floor(count(*) FILTER (l_linestatus <> 'O' AND l_returnflag = 'R') / greatest(count(*) FILTER (l_linestatus <> 'O'), 1)::DOUBLE * 100 + 0.5) AS BIGINT) AS pct_returned
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey""")
def team_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Observations joined with matches, aggregated per team without no-shows."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    d = d.join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out, n = F.col("l_linestatus") == "O", F.count_if(F.col("l_linestatus") != "O")
    return d.groupBy(F.col("l_suppkey").alias("team")).agg(
        n.alias("matches"), F.count_if(out).alias("no_shows"), F.round(F.coalesce(F.sum(F.when(~out, F.col("l_quantity"))), F.lit(0.0)) / F.greatest(n, F.lit(1)), 6).alias("avg_qty"),
        S.percent(F.count_if(~out & (F.col("l_returnflag") == "R")), n).alias("pct_returned"),
    )


@query("""
WITH x AS (SELECT page_id, regexp_replace(url, '^[^0-9]*', '') AS tail, url FROM pages)
SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(tail, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)', 0), '') AS DOUBLE), 0) AS num,
  lower(trim(regexp_extract(url, '^([a-z]+)', 1))) IN ('true', 'yes', '1', 'x') AS yes, length(url)::BIGINT AS n FROM x""")
def typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns to numbers by prefix and to flags."""
    d = table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "^[^0-9]*", "").alias("tail"))
    return d.select("page_id", S.leading_number("tail").alias("num"), S.flag(F.regexp_extract("url", "^([a-z]+)", 1)).alias("yes"), F.length("url").cast("long").alias("n"))


@query("""
SELECT l_orderkey, l_suppkey, min(l_linenumber)::BIGINT AS first_line, max(l_linenumber)::BIGINT AS last_line,
  arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS first_qty, arg_max(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS last_qty FROM lineitem GROUP BY ALL""")
def dup_first_last_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups by a duplicated key: first row wins and last row wins."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("qty"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("ord"))
    own = ["l_orderkey", "l_suppkey"]
    first = J.first_per_key(d, own, ["ord"]).select(*own, F.col("line").alias("first_line"), F.col("qty").alias("first_qty"))
    last = J.last_per_key(d, own, ["ord"]).select(*own, F.col("line").alias("last_line"), F.col("qty").alias("last_qty"))
    return first.join(last, own)


@query("""
WITH g AS (SELECT *, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) OVER (PARTITION BY l_orderkey) AS grp FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS line, floor((CASE WHEN grp > 0 THEN (CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / grp ELSE 1.0::DOUBLE / 3 END) * o_totalprice * 100 + 0.5) / 100 AS fused
FROM g JOIN orders ON l_orderkey = o_orderkey""")
def alliance_share_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's share of its order's total; a third where nothing was seen."""
    own = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", own.alias("own")).withColumn("grp", F.sum("own").over(Window.partitionBy("l_orderkey")))
    d = d.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return d.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), (S.half_up(S.share_weighted("own", "grp", "o_totalprice") * 100) / 100).alias("fused"))


@query("""
WITH e AS (SELECT l_suppkey % 10 AS grp, count(*) FILTER (l_quantity + l_linenumber > 50) AS o, count(*) FILTER (l_quantity < l_linenumber) AS u FROM lineitem GROUP BY 1)
SELECT grp::BIGINT AS grp, CASE WHEN o > u THEN 'cumulative' WHEN u > o THEN 'separate' ELSE 'unknown' END AS mode FROM e""")
def reporting_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Which of two kinds of evidence prevails."""
    g = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("grp")).agg(F.count_if(F.col("l_quantity") + F.col("l_linenumber") > 50).alias("o"), F.count_if(F.col("l_quantity") < F.col("l_linenumber")).alias("u"))
    return g.select("grp", F.when(F.col("o") > F.col("u"), "cumulative").when(F.col("u") > F.col("o"), "separate").otherwise("unknown").alias("mode"))


@query("""
WITH g AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1),
h AS (SELECT l_orderkey, coalesce(a, 0) AS a, coalesce(n, 0) AS n, o_totalprice AS tot FROM g JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, floor(tot * (CASE WHEN a + n > 0 THEN a / (a + n) ELSE 0.5::DOUBLE END) * 100 + 0.5) / 100 AS part_a, floor(tot * (1 - (CASE WHEN a + n > 0 THEN a / (a + n) ELSE 0.5::DOUBLE END)) * 100 + 0.5) / 100 AS part_n FROM h""")
def split_ratio_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """A total split again by the ratio of two observed parts."""
    qty = lambda f: F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(qty("A").alias("a"), qty("N").alias("n"))
    g = g.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    a, n = S.split_by_ratio("o_totalprice", "a", "n")
    return g.select("l_orderkey", (S.half_up(a * 100) / 100).alias("part_a"), (S.half_up(n * 100) / 100).alias("part_n"))


@query("""
WITH g AS (SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS a, max(l_quantity) FILTER (l_linenumber = 2) AS b, max(l_quantity) FILTER (l_linenumber = 3) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(a, 0) * 3 + coalesce(b, 0) * 4 + coalesce(c, 0) * 6 AS points, a + b + c AS total FROM g""")
def point_model(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted points with nulls as 0, and a total that needs all parts."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(k) for i, k in ((1, "a"), (2, "b"), (3, "c"))])
    return g.select("l_orderkey", S.weighted_points({"a": 3, "b": 4, "c": 6}).alias("points"), S.sum_if_all("a", "b", "c").alias("total"))


@query("""
WITH g AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, max(o_totalprice) AS off FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) = max(l_linenumber))
SELECT count(*) AS complete, round(avg(q * 1000 - off), 2) AS mean_delta, round(sum(q) * 1000 / sum(off) * 100, 4) AS pct FROM g""")
def accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Observed against official totals over complete groups."""
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.max("l_linenumber").alias("m")).where("n = m")
    d = d.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("off")), "l_orderkey")
    return d.agg(F.count("*").alias("complete"), F.round(F.avg(F.col("q") * 1000 - F.col("off")), 2).alias("mean_delta"), F.round(F.sum("q") * 1000 / F.sum("off") * 100, 4).alias("pct"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity AS tot, l_returnflag AS f, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS line, CAST(CASE WHEN s > 0 THEN floor(tot / s * 100 + 0.5) ELSE 33 END AS BIGINT) AS share FROM d""")
def attribution_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-percent shares within a group."""
    from trackloom.plans import scouting

    d = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("tot"))
    return scouting.attribution_shares(d, ["tot"], ["l_orderkey"]).select("l_orderkey", "line", F.col("tot_share").cast("long").alias("share"))


# -- votes and summaries ------------------------------------------------------
@query(f"""
WITH w AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN greatest(value / 1000, 0.05) ELSE 0 END) AS a, sum(CASE WHEN event_type = 'view' THEN greatest(value / 1000, 0.05) ELSE 0 END) AS b FROM {_E} GROUP BY 1)
SELECT user_id, round(a, 6) AS a_weight, round(b, 6) AS b_weight, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a > b THEN 'click' ELSE 'view' END AS winner FROM w""")
def weighted_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence-weighted vote of two sides."""
    v = A.two_way_vote(_events(spark, sf).withColumn("conf", F.col("value") / 1000), ["user_id"], "event_type", "conf", "click", "view")
    return v.select("user_id", F.round("a_weight", 6).alias("a_weight"), F.round("b_weight", 6).alias("b_weight"), "winner")


@query(f"""
WITH e AS {_E}, c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM e GROUP BY ALL),
m AS (SELECT user_id, event_type AS side, n, sum(n) OVER (PARTITION BY user_id) AS tot, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c)
SELECT e.user_id, min(t) AS t0, max(t) AS t1, count(*) AS n, arg_min(value, (t, event_id)) AS x0, arg_max(value, (t, event_id)) AS x1, any_value(side) AS side, round(any_value(m.n) / any_value(tot)::DOUBLE, 6) AS confidence
FROM e JOIN m ON e.user_id = m.user_id AND r = 1 GROUP BY e.user_id""")
def track_info(spark: SparkSession, sf: str) -> DataFrame:
    """Span, ends and majority side per track."""
    s = A.track_summary(_events(spark, sf), "user_id", "t", "value", "event_type", "event_id")
    return s.select("user_id", "t0", "t1", "n", "x0", "x1", F.col("event_type").alias("side"), F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH e AS (SELECT DISTINCT user_id, floor(t / 3600) AS h FROM {_E})
SELECT a.user_id AS a, b.user_id AS b, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.user_id < b.user_id GROUP BY ALL""")
def co_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracks seen in the same frame."""
    return J.co_occurring(_events(spark, sf).withColumn("h", F.floor(F.col("t") / 3600)), ["h"], "user_id")


@query(f"""
WITH l AS (SELECT event_id AS lid, floor(t / 3600) AS h, value AS lv FROM {_E} WHERE event_type = 'click'), r AS (SELECT event_id AS rid, floor(t / 3600) AS h, value AS rv FROM {_E} WHERE event_type = 'view'),
p AS (SELECT lid, rid, abs(lv - rv) AS d, row_number() OVER (PARTITION BY lid ORDER BY abs(lv - rv), rid) AS k FROM l JOIN r USING (h))
SELECT l.lid, CASE WHEN d <= 40 THEN rid END AS rid, CASE WHEN d <= 40 THEN round(d, 6) END AS distance FROM l LEFT JOIN p ON l.lid = p.lid AND k = 1""")
def nearest_label(spark: SparkSession, sf: str) -> DataFrame:
    """Each label with the nearest box of its frame, within a limit."""
    e = _events(spark, sf).withColumn("h", F.floor(F.col("t") / 3600))
    left = e.where("event_type = 'click'").select(F.col("event_id").alias("lid"), "h", F.col("value").alias("lv"))
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("rid"), "h", F.col("value").alias("rv"))
    out = J.nearest_on_line(left, right, "h", "lid", "lv", "rv", "rid", 40.0)
    return out.select("lid", "rid", F.round("distance", 6).alias("distance"))


@query(f"""
WITH p AS (SELECT * FROM {_E} WHERE event_type = 'purchase'), v AS (SELECT * FROM {_E} WHERE event_type = 'view'),
j AS (SELECT p.event_id, v.t AS vt, abs(p.t - v.t) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v.t), v.t) AS k FROM p JOIN v USING (user_id))
SELECT p.event_id, vt AS matched_at, round(gap, 6) AS gap FROM p LEFT JOIN j ON p.event_id = j.event_id AND k = 1""")
def nearest_time_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest row in time of the same track, either way."""
    e = _events(spark, sf)
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), e.where("event_type = 'view'").select("user_id", "t")
    out = J.nearest_in_time(left, right, "user_id", "t", [], bucket=86_400 * 3)
    return out.select("event_id", "matched_at", F.round("time_gap", 6).alias("gap"))


@query(f"""
SELECT c.event_id, s.t AS matched_at FROM {_E} c ASOF LEFT JOIN (SELECT DISTINCT user_id, t FROM {_E} WHERE event_type = 'signup') s ON c.user_id = s.user_id AND c.t > s.t WHERE c.event_type = 'click'""")
def backward_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The latest strictly earlier row of another kind."""
    e = _events(spark, sf)
    out = J.asof(e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'signup'").select("user_id", "t"), "user_id", "t", [], bucket=86_400 * 3, strict=True)
    return out.select("event_id", "matched_at")


@query(f"""
WITH s AS (SELECT user_id, event_id AS sid, t AS lo, t + 7200 AS hi FROM {_E} WHERE event_type = 'purchase'),
j AS (SELECT e.event_id, s.sid, row_number() OVER (PARTITION BY e.event_id ORDER BY lo, hi, sid) AS k FROM {_E} e JOIN s ON e.user_id = s.user_id AND e.t BETWEEN lo AND hi)
SELECT e.event_id, j.sid FROM {_E} e LEFT JOIN j ON e.event_id = j.event_id AND k = 1""")
def point_in_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Each point with the earliest span that holds it."""
    e = _events(spark, sf)
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("sid"), F.col("t").alias("lo"), (F.col("t") + 7200).alias("hi"))
    return J.in_intervals(e.select("event_id", "user_id", "t"), spans, "user_id", "t", 7200.0, ["sid"]).select("event_id", "sid")


@query("""
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'named' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'present' ELSE 'missing' END AS status FROM customer""")
def anti_semi_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Membership classes by two semi-joins."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return J.membership(table(spark, sf, "customer").select("c_custkey"), "c_custkey", o.where("o_totalprice > 300000"), o)


_SEG = f"""(SELECT user_id, seg, min(t) AS t0, max(t) AS t1, arg_min(value, (t, event_id)) AS x0, arg_max(value, (t, event_id)) AS x1 FROM
 (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS seg FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM {_E})) GROUP BY user_id, seg)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    d = W.gap_islands(_events(spark, sf), ["user_id"], "t", ["t", "event_id"], 3600, "seg")
    at = F.struct("t", "event_id")
    return d.groupBy("user_id", "seg").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("value", at).alias("x0"), F.max_by("value", at).alias("x1"))


@query(f"""
WITH s AS {_SEG}, j AS (SELECT a.user_id, a.seg AS a, b.seg AS b, b.t0 - a.t1 AS gap, abs(b.x0 - a.x1) AS dist FROM s a JOIN s b ON a.user_id = b.user_id AND a.seg <> b.seg AND a.t1 <= b.t0 AND b.t0 - a.t1 <= 86400),
k AS (SELECT *, gap / 86400 + dist / (50 + gap / 400) AS score FROM j WHERE dist <= 50 + gap / 400), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, b ORDER BY score, a) AS rank FROM k)
SELECT user_id, a::BIGINT AS a, b::BIGINT AS b, round(score, 6) AS score, rank::BIGINT AS rank FROM r WHERE rank <= 3""")
def continuity_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Best three predecessors of each segment by gap and distance."""
    s = _segments(spark, sf).withColumn("kind", F.lit(None).cast("string"))
    out = J.successors(s, "user_id", 86_400.0, F.lit(50) + F.col("gap") / 400)
    return out.select("user_id", "a", "b", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT user_id, seg::BIGINT AS seg, t0, t1, x0, x1 FROM {_SEG}")
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches without a long gap, summarised."""
    return _segments(spark, sf)


@query(f"""
WITH e AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND abs(value - pv) > 100 + (t - pt) / 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment FROM e),
n AS (SELECT user_id, segment, row_number() OVER (ORDER BY user_id, segment) + (SELECT max(user_id) FROM events) AS fresh FROM (SELECT DISTINCT user_id, segment FROM c WHERE segment > 0))
SELECT c.event_id, c.segment::BIGINT AS segment, coalesce(fresh, c.user_id)::BIGINT AS new_id FROM c LEFT JOIN n USING (user_id, segment)""")
def step_cuts_renumber(spark: SparkSession, sf: str) -> DataFrame:
    """Cut impossible steps and give later segments new ids."""
    e = _events(spark, sf)
    d = W.cut_impossible_steps(e, "user_id", "t", ["t", "event_id"], F.abs(F.col("value") - F.col("prev_value")), lambda dt: F.lit(100) + dt / 100)
    return W.renumber(d, "user_id", "segment").select("event_id", "segment", F.col("new_id").cast("long").alias("new_id"))


@query(f"""
WITH c AS (SELECT user_id, floor(t / 86400)::BIGINT AS bin, event_type, count(*) AS n, min(t) AS f FROM {_E} GROUP BY ALL),
v AS (SELECT user_id, bin, sum(n)::BIGINT AS votes, arg_max(event_type, (n, -f, event_type)) AS winner FROM c GROUP BY ALL HAVING sum(n) >= 2),
l AS (SELECT *, lag(winner) OVER w AS pw, lag(bin) OVER w AS pb FROM v WINDOW w AS (PARTITION BY user_id ORDER BY bin))
SELECT user_id, bin, votes, winner, pw AS from_winner, ((pb + bin) / 2.0::DOUBLE * 86400 + 43200) AS cut FROM l WHERE pw IS NOT NULL AND pw <> winner""")
def tumbling_vote_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Winners of tumbling windows, and where they change."""
    v = W.binned_votes(_events(spark, sf), ["user_id"], "t", "event_type", 86_400, least=2)
    return W.winner_changes(v, ["user_id"], 86_400).select("user_id", "bin", "votes", "winner", "from_winner", "cut")


@query(f"""
SELECT event_id, sum((value > 250)::INT) OVER w * 2 > count(*) OVER w AS conflict FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def majority_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling strict majority of seven rows."""
    return W.rolling_majority(_events(spark, sf), ["user_id"], ["t", "event_id"], F.col("value") > 250).select("event_id", "conflict")


@query(f"""
WITH b AS (SELECT user_id, floor(t / 172800)::BIGINT AS bin, quantile_cont(value, 0.75) AS p75 FROM {_E} GROUP BY ALL),
r AS (SELECT *, min((p75 > 60)::INT) OVER w AS m, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT user_id, min(bin) AS onset FROM r WHERE m = 1 AND n = 3 GROUP BY user_id""")
def sustained_onset(spark: SparkSession, sf: str) -> DataFrame:
    """First of three hot bins in a row, by the 75th percentile."""
    b = _events(spark, sf).groupBy("user_id", F.floor(F.col("t") / 172_800).alias("bin")).agg(F.percentile("value", 0.75).alias("p75"))
    return W.sustained(b, ["user_id"], "bin", F.col("p75") > 60, 3)


@query(f"""
WITH e AS (SELECT event_id, value AS v, first_value(value) OVER a AS f, last_value(value) OVER a AS l, count(*) OVER a AS n, lag(value) OVER w AS m1, lag(value, 2) OVER w AS m2, lead(value) OVER w AS p1, lead(value, 2) OVER w AS p2
 FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id), a AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN n >= 5 THEN (v + coalesce(m1, f) + coalesce(m2, f) + coalesce(p1, l) + coalesce(p2, l)) / 5 ELSE v END, 6) AS smooth FROM e""")
def moving_average_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Five-point mean with repeated ends."""
    return W.moving_average(_events(spark, sf), ["user_id"], ["t", "event_id"], "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN regr_slope(value, t / 86400) END, 6) AS velocity FROM {_E} GROUP BY user_id")
def regression_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of a track's positions."""
    return W.linear_velocity(_events(spark, sf).withColumn("d", F.col("t") / 86400), ["user_id"], "d", "value").select("user_id", "n", F.round("velocity", 6).alias("velocity"))


@query(f"""
WITH g AS (SELECT floor(value / 25)::BIGINT AS gx, floor(t / 86400)::BIGINT AS gy, count(*) AS n FROM {_E} GROUP BY ALL)
SELECT gx, gy, n FROM g WHERE n >= (SELECT quantile_cont(n::DOUBLE, 0.97) FROM g)""")
def grid_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Hot cells of a two-dimensional histogram."""
    g = A.grid_histogram(_events(spark, sf).withColumn("day", F.col("t") / 86400 * 25), "value", "day", 25.0)
    return O.hot_cells(g, F.col("n").cast("double"), 0.97).select("gx", "gy", "n")


@query("""
WITH c AS (SELECT c_nationkey AS g, o_orderpriority AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
x AS (SELECT *, n * 24.0::DOUBLE / sum(n) OVER (PARTITION BY g) AS e FROM c), y AS (SELECT *, floor(e) AS f, row_number() OVER (PARTITION BY g ORDER BY e - floor(e) DESC, k DESC) AS r, 24 - sum(floor(e)) OVER (PARTITION BY g) AS left_ FROM x)
SELECT g::BIGINT AS g, k, CAST(f + (r <= left_)::INT AS BIGINT) AS share FROM y""")
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty-four votes apportioned by order counts."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("g")), "o_custkey")
    t = o.groupBy("g", F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return A.largest_remainder(t, ["g"], "k", "n", 24).select("g", "k", "share")


@query("""
WITH s AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS s FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM s WHERE s <= 2)
SELECT c_custkey, c_nationkey::BIGINT AS nation, rank::BIGINT AS rank FROM r WHERE rank <= 6""")
def capped_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Top six per nation, at most two per segment."""
    d = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment", "c_acctbal")
    return O.capped_topk(d, ["nation"], "c_mktsegment", [F.desc("c_acctbal"), "c_custkey"], 6, 2).select("c_custkey", "nation", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {_E})
SELECT event_id FROM e WHERE n <= 12 OR list_contains(list_transform(range(12), lambda j: floor(j * (n - 1)::DOUBLE / 11 + 1e-9)::BIGINT), i)""")
def linspace_thinning(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve evenly spaced rows per track."""
    return O.evenly_spaced(_events(spark, sf), ["user_id"], ["t", "event_id"], 12, truncate=True).select("event_id")


@query(f"""
WITH d AS (SELECT DISTINCT user_id, round(t, 3) AS t FROM {_E} WHERE t BETWEEN 0 AND 864000), s AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM d),
m AS (SELECT user_id, quantile_cont(step, 0.5) AS m FROM s GROUP BY 1), l AS (SELECT s.*, CASE WHEN step > greatest(1.5 * m, 0.3) THEN step END AS g FROM s JOIN m USING (user_id))
SELECT user_id, count(*) AS seen, count(g) AS gaps, round(coalesce(max(g), 0), 3) AS longest, round(coalesce(sum(g), 0), 3) AS lost FROM l GROUP BY user_id""")
def custody_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Rows seen in a window and the long gaps between them."""
    return A.custody(_events(spark, sf), "user_id", "t", 0, 864_000, F.lit(1)).select("user_id", "seen", "gaps", F.round("longest", 3).alias("longest"), F.round("lost", 3).alias("lost"))


@query("""
WITH d AS (SELECT lang, quality, CASE WHEN n_chars < 300 THEN 0 WHEN n_chars > 20000 THEN NULL ELSE 1 END AS guess FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (quality = guess) AS hit, count(*) FILTER (quality <> guess) AS wrong, count(*) FILTER (guess IS NULL) AS unresolved, round(count(*) FILTER (quality = guess) * 100.0 / nullif(count(guess), 0), 1)::DOUBLE AS pct FROM d GROUP BY lang""")
def accuracy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Truth against predictions per group."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    guess = F.when(F.col("n_chars") < 300, 0).when(F.col("n_chars") > 20000, None).otherwise(1)
    return A.accuracy(d.withColumn("guess", guess), ["lang"], F.col("quality"), F.col("guess"))


@query("SELECT lang, quantile_cont(n_chars, 0.5)::DOUBLE AS median, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.9)::DOUBLE, 6) AS p90 FROM documents GROUP BY lang")
def distribution_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Median, mean and 90th percentile."""
    return A.spread(table(spark, sf, "documents").select("lang", "n_chars"), ["lang"], "n_chars").select("lang", F.col("median").cast("double").alias("median"), F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90"))


@query("""
WITH d AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n_chars) FILTER (r = floor((n - 1) * 0.1)) AS p10, max(n_chars) FILTER (r = floor((n - 1) * 0.5)) AS p50, max(n_chars) FILTER (r = floor((n - 1) * 0.9)) AS p90 FROM d GROUP BY lang""")
def nearest_rank_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles by rank, not interpolated."""
    return A.nearest_rank(table(spark, sf, "documents").select("lang", "n_chars"), ["lang"], "n_chars", [0.1, 0.5, 0.9])


@query(f"""
WITH l AS (SELECT user_id, arg_max(event_type, (t, event_id)) AS action, arg_max(value, (t, event_id)) AS value FROM {_E} GROUP BY 1) SELECT user_id, action, value FROM l WHERE action IN ('click', 'purchase')""")
def latest_decision(spark: SparkSession, sf: str) -> DataFrame:
    """The last decision per key, if it is one of two."""
    e = _events(spark, sf).withColumn("action", F.col("event_type"))
    return A.latest_decisions(e, "user_id", ["t", "event_id"], "action", ["click", "purchase"]).select("user_id", "action", "value")


@query(f"""
WITH e AS (SELECT user_id, floor(value / 50)::BIGINT AS cell, floor(t / 604800)::BIGINT AS round, event_type AS label, event_id FROM {_E}), m AS (SELECT user_id, cell, max(round) FILTER (label <> 'view') AS top FROM e GROUP BY ALL)
SELECT event_id, label FROM e JOIN m USING (user_id, cell) WHERE top IS NULL OR round >= top""")
def round_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the newest round per key; weak labels supersede nothing."""
    e = _events(spark, sf).select("user_id", F.floor(F.col("value") / 50).alias("cell"), F.floor(F.col("t") / 604_800).alias("round"), F.col("event_type").alias("label"), "event_id")
    return U.newest_round(e, ["user_id", "cell"], "round", "label", "view")[0].select("event_id", "label")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n IS DISTINCT FROM b.n OR a.p IS DISTINCT FROM b.p THEN 'changed' ELSE 'same' END AS status,
 CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END) END AS fields FROM a FULL JOIN b ON a.k = b.k""")
def diff_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots compared field by field."""
    o = table(spark, sf, "orders")
    snap = lambda r: o.where(F.col("o_orderkey") % 3 != r).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    return A.snapshot_diff(snap(0), snap(1), "k", ["n", "p"])


@query("""
WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT qid, label, round(list_cosine_similarity(q.v, p.v), 9) AS sim FROM q, p), t AS (SELECT qid, label, sim, row_number() OVER (PARTITION BY qid, label ORDER BY sim DESC) AS r FROM s),
m AS (SELECT qid, label, round(avg(sim), 9) AS score FROM t WHERE r <= 3 GROUP BY ALL)
SELECT qid, arg_max(label, (score, -label))::BIGINT AS label, round(max(score), 6) AS score FROM m GROUP BY qid""")
def cosine_topk_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's label by the three nearest labelled vectors per label."""
    e = table(spark, sf, "embeddings")
    gallery = e.where("label is not null").select("label", F.col("embedding").alias("vector"))
    v = M.prototype_votes(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), gallery)
    return v.select("qid", F.col("label").cast("long").alias("label"), F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label::BIGINT AS label, (i - 1)::BIGINT AS dim, round(avg(v::DOUBLE), 6) AS mean FROM e GROUP BY ALL""")
def incremental_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves' centroids merged equal the centroid of all."""
    e = table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("long"))
    half = lambda r: A.centroids(e.where(F.col("vec_id") % 2 == r), "label", "embedding")
    c = A.centroid_update(half(0), half(1), "label")
    return c.select("label", F.posexplode("vector").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


_KNOTS = "CASE " + " ".join(["WHEN g <= 0.15 THEN 0.96", *[f"WHEN g <= {t1} THEN {d0} + ({d1} - {d0})::DOUBLE * (g - {t0}) / ({t1} - {t0})::DOUBLE" for (t0, d0), (t1, d1) in zip(S.ENVELOPE_M, S.ENVELOPE_M[1:], strict=False)]]) + " ELSE 10.79 + (10.79 - 8.86)::DOUBLE / (5.0 - 3.5) * (g - 5.0) END"


@query(f"""
WITH e AS (SELECT event_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 3600 AS g FROM {_E}) SELECT event_id, round({_KNOTS}, 6) AS budget FROM e WHERE g IS NOT NULL""")
def piecewise_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Distance budgets of the gaps between samples."""
    e = _events(spark, sf).withColumn("g", (F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))) / 3600)
    return e.where("g is not null").select("event_id", F.round(S.distance_budget("g"), 6).alias("budget"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS p FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(CASE WHEN n = 1 OR p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM r)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS kind, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM s GROUP BY user_id, run""")
def consecutive_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of rows of one kind."""
    d = W.runs(_events(spark, sf), ["user_id"], ["t", "event_id"], "event_type")
    return d.groupBy("user_id", "run").agg(F.first("event_type").alias("kind"), F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query(f"""
WITH s AS (SELECT user_id, event_id AS i, t AS s, t + 3600 AS e FROM {_E} WHERE event_type = 'click') SELECT a.user_id, a.i AS a, b.i AS b, round(least(a.e, b.e) - greatest(a.s, b.s), 6) AS overlap
FROM s a JOIN s b ON a.user_id = b.user_id AND a.i < b.i AND least(a.e, b.e) - greatest(a.s, b.s) >= 60""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of overlapping spans of one track."""
    s = _events(spark, sf).where("event_type = 'click'").select("user_id", "event_id", "t", (F.col("t") + 3600).alias("e"))
    return J.interval_overlap(s, "user_id", "event_id", "t", "e", 3600.0, 60.0).withColumn("overlap", F.round("overlap", 6))


@query(f"""
WITH e AS (SELECT event_id, user_id, t, value FROM {_E}) SELECT DISTINCT a.user_id AS a, b.user_id AS b FROM e a JOIN e b ON a.user_id < b.user_id AND abs(a.t - b.t) <= 300 AND abs(a.value - b.value) > 400""")
def kinematic_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracks with samples close in time but too far apart."""
    e = _events(spark, sf).withColumns({"match": F.lit(0), "y": F.lit(0.0)})
    return J.kinematic_conflicts(e, "match", "user_id", "t", "value", "y", 300.0, F.lit(400.0)).select("a", "b")


@query(f"""
SELECT user_id, floor(t / 86400)::BIGINT AS day, min(event_type) AS kind FROM {_E} GROUP BY ALL HAVING min(event_type) = max(event_type)""")
def agreed_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Keys on which all rows agree."""
    return J.agreed(_events(spark, sf).select("user_id", F.floor(F.col("t") / 86400).alias("day"), F.col("event_type").alias("kind")), ["user_id", "day"], "kind")


@query("""
WITH e AS (SELECT DISTINCT least(c_custkey, o) AS a, greatest(c_custkey, o) AS b FROM (SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS o FROM customer) WHERE o IS NOT NULL)
SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of chains."""
    d = table(spark, sf, "customer").select("c_custkey", F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")).alias("o"))
    return graph.connected_components(d.where("o is not null").select(F.col("c_custkey").alias("src"), F.col("o").alias("dst")), Scratch(spark, "components"))


@query(f"""
WITH e AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, concat_ws(',', CASE WHEN value > 450 THEN 'offfield' END, CASE WHEN event_type = 'error' THEN 'viewmoved' END, CASE WHEN t > pt AND abs(value - pv) / (t - pt) > 0.5 THEN 'fast' END) AS flags FROM e""")
def motion_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Quality flags of samples."""
    e = _events(spark, sf).withColumn("y", F.lit(0.0))
    d = P.motion_flags(e, ["user_id"], "t", "value", "y", 0.5, F.col("value") > 450, F.col("event_type") == "error")
    return d.select("event_id", F.array_join("flags", ",").alias("flags"))


@query("""
SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey < 8 THEN 'points' END, CASE WHEN c_acctbal IS NULL OR c_acctbal > 5000 THEN 'mean' END) AS reasons FROM customer""")
def admission_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a row isn't admitted."""
    r = P.reasons(("points", F.col("c_nationkey") < 8), ("mean", F.col("c_acctbal").isNull() | (F.col("c_acctbal") > 5000)))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(r, ",").alias("reasons"))


@query("""
WITH c AS (SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_suppkey, CASE WHEN n < 4 THEN -1 ELSE s_nationkey END::BIGINT AS root FROM c""")
def demote_small_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that are too small lose their id; rows stay."""
    d = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("root"))
    return P.demote_small(d, "root", 4, "root")


@query(f"""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM {_E}) WHERE (i - 2) % 3 = 0 AND i >= 2""")
def every_third(spark: SparkSession, sf: str) -> DataFrame:
    """Every third row of a track from the third."""
    return O.every_nth(_events(spark, sf), ["user_id"], ["t", "event_id"], 3, 2).select("event_id")


@query(f"""
WITH d AS (SELECT *, least(floor(t / 259200), 9) AS slot FROM {_E} WHERE t BETWEEN 0 AND 2592000), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY value DESC, event_id) AS s FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (s > 1)::INT, value DESC, event_id) AS k FROM s)
SELECT event_id, slot::BIGINT AS slot FROM k WHERE k <= 10""")
def best_per_slot(spark: SparkSession, sf: str) -> DataFrame:
    """Best row per time slot, filled up by quality."""
    d = O.best_per_slot(_events(spark, sf), ["user_id"], "t", 0, 2_592_000, 10, [F.desc("value"), "event_id"])
    return d.select("event_id", F.col("slot").cast("long").alias("slot"))


@query("""
SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def unreviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates without a decision."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("""
SELECT DISTINCT s_nationkey::BIGINT AS k FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def leak_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Values that two splits share."""
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    b = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("k"))
    return U.leak(a, b, ["k"])


@query(f"""
WITH u AS (SELECT DISTINCT user_id FROM {_E}), r AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 5 AS fold FROM u) SELECT fold::BIGINT AS fold, count(*) AS n, round(avg(value), 6) AS mean FROM {_E} JOIN r USING (user_id) GROUP BY fold""")
def holdout_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds of whole tracks."""
    d = A.folds(_events(spark, sf), "user_id", 5)
    return d.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""
WITH e AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM (SELECT DISTINCT user_id, t FROM {_E})) SELECT user_id, t, round(nx - t, 6) AS length FROM e WHERE nx IS NOT NULL ORDER BY nx - t DESC, user_id, t LIMIT 15""")
def longest_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen longest stretches between samples."""
    return A.stretches(_events(spark, sf), "user_id", "t", 15).select("user_id", "t", F.round("length", 6).alias("length"))


@query(f"""
WITH p AS (SELECT user_id, round(t, 3) AS t, avg(value) AS x FROM {_E} GROUP BY ALL), s AS (SELECT user_id, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY t)) AS d FROM p) SELECT user_id, round(coalesce(sum(d), 0), 4) AS dist, count(*) AS samples FROM s GROUP BY user_id""")
def route_length(spark: SparkSession, sf: str) -> DataFrame:
    """Length of a track's path."""
    d = A.route_length(_events(spark, sf).withColumn("y", F.lit(0.0)), "user_id", "t", "value", "y")
    return d.select("user_id", F.round("dist", 4).alias("dist"), "samples")


@query(f"""
WITH e AS (SELECT *, floor(t * 1000)::BIGINT AS ms FROM {_E}) SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND 3600000 FOLLOWING), 6) AS pooled FROM e""")
def pooled_window(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over an hour either side."""
    d = W.pooled_mean(_events(spark, sf).withColumn("ms", F.floor(F.col("t") * 1000)), ["user_id"], "ms", ["value"], 3_600_000)
    return d.select("event_id", F.round("pooled_value", 6).alias("pooled"))


@query(f"""
SELECT event_type, floor(t / 86400)::BIGINT AS day, count(*) AS n, count(*) <= 60 AS allowed FROM {_E} GROUP BY ALL""")
def daily_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Requests per kind and day against a daily budget."""
    g = _events(spark, sf).groupBy("event_type", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"))
    return g.withColumn("allowed", F.col("n") <= 60)


@query(f"""
WITH l AS (SELECT user_id, max(t) AS seen_at, arg_max(value, (t, event_id)) AS payload FROM {_E} GROUP BY 1) SELECT user_id, seen_at, payload FROM l WHERE seen_at + 86400 * 7 > (SELECT max(t) FROM {_E})""")
def mailbox_index(spark: SparkSession, sf: str) -> DataFrame:
    """Latest entry per key with a time to live of seven days."""
    e = _events(spark, sf)
    now = e.agg(F.max("t").alias("now"))
    d = U.latest(e.select("user_id", "event_id", F.col("t").alias("seen_at"), F.col("value").alias("payload")), ["user_id"], ["seen_at", "event_id"]).crossJoin(now)  # one row
    return d.where(F.col("seen_at") + 86400 * 7 > F.col("now")).select("user_id", "seen_at", "payload")


@query("""
WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (n > 1 AND p IS DISTINCT FROM role) AS changes FROM t GROUP BY conv_id""")
def role_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between consecutive rows of a sequence."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = table(spark, sf, "conversations").select("conv_id", "role", F.row_number().over(w).alias("n"), F.lag("role").over(w).alias("p"))
    return d.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if((F.col("n") > 1) & ~F.col("p").eqNullSafe(F.col("role"))).alias("changes"))


@query("""
SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_quantity >= 48 THEN 'top' WHEN l_quantity >= 40 THEN 'high' WHEN l_quantity >= 30 THEN 'mid' WHEN l_quantity >= 18 THEN 'low' ELSE 'bottom' END AS tier FROM lineitem""")
def tiering(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds to tiers."""
    steps = ((48, "top"), (40, "high"), (30, "mid"), (18, "low"))
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), S.tier("l_quantity", steps).alias("tier"))


# -- order-dependent operators: tested against plain Python -------------------
#: Rows of each user in order, and a step from one to the next.
_N = f"e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM {_E})"


@query(f"""
WITH RECURSIVE {_N}, s AS (SELECT user_id, n, t AS last, true AS kept FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t - s.last >= 3600 THEN e.t ELSE s.last END, e.t - s.last >= 3600 FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, user_id, event_type, value, t FROM e JOIN s USING (user_id, n) WHERE kept""")
def greedy_thin(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at least an hour after the last one kept."""
    return W.thin(_events(spark, sf), ["user_id"], "t", ["t", "event_id"], 3600.0)


@query(f"""
WITH RECURSIVE {_N}, u AS (SELECT user_id, list(t ORDER BY n) AS ts, count(*) AS size FROM e GROUP BY user_id),
s AS (SELECT user_id, CASE WHEN size <= 5 THEN range(1, size + 1) ELSE [1::BIGINT, size] END AS picked FROM u
 UNION ALL SELECT user_id, list_append(picked, -far.m) FROM (SELECT s.user_id, s.picked, list_max(list_transform(range(1, size + 1), lambda i: {{'d': CASE WHEN list_contains(picked, i) THEN -1 ELSE list_min(list_transform(picked, lambda j: abs(ts[i] - ts[j]))) END, 'm': -i}})) AS far
  FROM s JOIN u ON u.user_id = s.user_id AND u.size > 5 WHERE len(s.picked) < 5)),
l AS (SELECT user_id, arg_max(picked, len(picked)) AS picked FROM s GROUP BY user_id)
SELECT event_id, user_id, event_type, value, t FROM e JOIN l USING (user_id) WHERE list_contains(picked, n)""")
def farthest_point(spark: SparkSession, sf: str) -> DataFrame:
    """Five rows per track spread over time."""
    return O.spread_picks(_events(spark, sf), ["user_id"], "t", ["t", "event_id"], 5)


@query(f"""
WITH RECURSIVE d AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, list(DISTINCT event_type) AS kinds FROM {_E} GROUP BY ALL),
u AS (SELECT user_id, list(day ORDER BY day) AS days, list(kinds ORDER BY day) AS sets, list_distinct(flatten(list(kinds))) AS every FROM d GROUP BY user_id),
s AS (SELECT user_id, 0 AS k, []::BIGINT[] AS taken, every AS rest FROM u
 UNION ALL SELECT user_id, k + 1, list_append(taken, -best.m), list_filter(rest, lambda x: NOT list_contains(sets[-best.m], x)) FROM (
  SELECT s.*, u.sets, list_max(list_transform(range(1, len(sets) + 1), lambda i: {{'g': CASE WHEN list_contains(taken, i) THEN -1 ELSE len(list_intersect(sets[i], rest)) END, 'm': -i}})) AS best FROM s JOIN u ON u.user_id = s.user_id WHERE s.k < 3 AND len(s.rest) > 0) WHERE best.g > 0),
l AS (SELECT user_id, arg_max(taken, k) AS taken FROM s GROUP BY user_id)
SELECT user_id, days[taken[i + 1]] AS day, i::INT AS pick FROM l JOIN u USING (user_id), unnest(range(len(taken))) r(i)""")
def set_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Days that together show the most kinds of events, per user."""
    d = _events(spark, sf).select("user_id", F.floor(F.col("t") / 86400).alias("day"), "event_type").distinct()
    return O.frame_cover(d, ["user_id"], "day", "event_type", 3, 1.0)


@query()
def rts_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Kalman smoothing of each track."""
    d = _events(spark, sf).select("user_id", (F.col("t") / 86400).alias("t"), (F.col("value") / 100).alias("x"), F.lit(0.0).alias("y"))
    return W.smooth_tracks(d, ["user_id"], gap=2.0)


@query(f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM {_E}),
s AS (SELECT user_id, n, [t] AS taken, true AS kept FROM e WHERE n = 1
 UNION ALL SELECT user_id, n, CASE WHEN ok THEN list_append(taken, t) ELSE taken END, ok FROM (
  SELECT e.user_id, e.n, e.t, s.taken, len(s.taken) < 3 AND list_min(list_transform(s.taken, lambda x: abs(x - e.t))) >= 86400 AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT event_id, user_id, event_type, value, t FROM e JOIN s USING (user_id, n) WHERE kept""")
def separated_best(spark: SparkSession, sf: str) -> DataFrame:
    """Three best rows per track, a day apart."""
    return O.greedy_apart(_events(spark, sf), ["user_id"], "t", ["value", "event_id"], [False, True], 3, 86_400.0)


@query("""
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, p.label, round(list_inner_product(q.v, p.v), 9) AS sim FROM u q, u p WHERE p.label IS NOT NULL), t AS (SELECT qid, label, sim, row_number() OVER (PARTITION BY qid, label ORDER BY sim DESC) AS r FROM s),
m AS (SELECT qid, label, round(avg(sim), 9) AS score FROM t WHERE r <= 3 GROUP BY ALL), w AS (SELECT *, row_number() OVER o AS r, lead(score) OVER o AS next FROM m WINDOW o AS (PARTITION BY qid ORDER BY score DESC, label))
SELECT qid, label::BIGINT AS label, round(score, 6) AS score, round(score - next, 6) AS margin FROM w WHERE r = 1""")
def cosine_topk_vote_all(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's label by all labelled vectors through an index, and its margin."""
    e = table(spark, sf, "embeddings")
    gallery = e.where("label is not null").select(F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    v = gallery_index.votes(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), gallery, Scratch(spark, "votes"))
    return v.select("qid", "label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))
