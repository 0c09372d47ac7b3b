"""Where a short sequence of vectors lies in a longer one.

A clip and a snippet are rows of vectors, one per step. Every pair of a clip's and a
snippet's row votes for the offset between them, with what the pair adds to the
correlation at that offset; adding up votes by offset scores all placements at once, in
one join and one aggregation that combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S


def _centred(v: str) -> Column:
    """A vector less its mean component."""
    x = F.transform(v, lambda a: a.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda s, a: s + a) / F.size(x)
    return F.transform(x, lambda a: a - mean)


def placements(clips: DataFrame, snippets: DataFrame) -> DataFrame:
    """``(clip, snippet, offset, score)``: the normalised correlation of each snippet
    with each stretch of its clip that it covers whole. ``clips (clip, i, v)``,
    ``snippets (clip, snippet, i, v)``, with ``i`` from 0 without gaps; vectors have one
    length and are taken less their mean. A stretch or snippet without any change
    scores 0."""
    c = clips.select("clip", F.col("i").alias("at"), _centred("v").alias("c")).withColumn("cc", S.dot("c", "c"))
    s = snippets.select("clip", "snippet", F.col("i").alias("step"), _centred("v").alias("s")).withColumn("ss", S.dot("s", "s"))
    whole = s.groupBy("clip", "snippet").agg(F.count("*").alias("n"), F.sum("ss").alias("power"))
    votes = s.join(c, "clip").select("clip", "snippet", (F.col("at") - F.col("step")).alias("offset"), S.dot("s", "c").alias("x"), "cc")
    hits = votes.groupBy("clip", "snippet", "offset").agg(F.count("*").alias("m"), F.sum("x").alias("x"), F.sum("cc").alias("held"))
    full = hits.join(whole, ["clip", "snippet"]).where("m = n and offset >= 0")
    scale = F.sqrt(F.col("power") * F.col("held"))
    return full.select("clip", "snippet", "offset", F.when(scale > 0, F.col("x") / scale).otherwise(0.0).alias("score"))


def located(clips: DataFrame, snippets: DataFrame, apart: int, score: float, margin: float, least: int = 10, digits: int = 9) -> DataFrame:
    """``(clip, snippet, offset, score, runner_up, found)``: each snippet's best
    placement (scores rounded, the first on ties), and the best one more than ``apart``
    steps away (0 where there is none). It is found where it scores ``score`` or more and
    leads by ``margin``. Snippets of fewer than ``least`` rows have none."""
    enough = snippets.groupBy("clip", "snippet").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("clip", "snippet")
    p = placements(clips, snippets.join(enough, ["clip", "snippet"], "left_semi")).withColumn("score", F.round("score", digits))
    w = Window.partitionBy("clip", "snippet")
    best = F.max(F.struct("score", -F.col("offset"))).over(w)
    p = p.withColumn("_b", best).withColumn("_o", -F.col("_b")["col2"])
    other = F.coalesce(F.max(F.when(F.abs(F.col("offset") - F.col("_o")) > apart, F.col("score"))), F.lit(0.0))
    g = p.groupBy("clip", "snippet", F.col("_o").alias("offset"), F.col("_b.score").alias("score")).agg(other.alias("runner_up"))
    return g.withColumn("found", (F.col("score") >= score) & (F.col("score") - F.col("runner_up") >= margin))


def sources(found: DataFrame, leads: DataFrame) -> DataFrame:
    """``(clip, source, start, score)``: where each clip came from, of snippets that were
    taken from a source at a time: ``leads (snippet, source, t, seconds)`` with the
    ``seconds`` of one step, first by ``rank``. The first snippet found decides."""
    j = found.where("found").join(leads, "snippet")
    first = F.min_by(F.struct("source", (F.col("t") - F.col("offset") * F.col("seconds")).alias("start"), "score"), F.struct("rank", "snippet"))
    return j.groupBy("clip").agg(first.alias("m")).select("clip", "m.*")
