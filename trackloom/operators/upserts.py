"""Set operations and upserts: newest wins, histories kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.runtime import spread


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    own = F.struct(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(own, F.struct(*order)).alias("_r")).select(*key, "_r.*")


def unexpired(df: DataFrame, key: list[str], order: list, expires: Column, now: Column) -> DataFrame:
    """A keyed register with time to live: the latest row per key, if still valid."""
    return latest(df, key, order).where(expires > now)


def merge_round(existing: DataFrame, new: DataFrame, frame: str, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(live, retired): new labels overwrite by key; old labels on frames that the
    new answer reviewed but doesn't repeat are retired."""
    reviewed = new.select(frame).distinct()
    old = existing.join(new.select(*key).distinct(), key, "left_anti")
    retired = old.join(reviewed, frame, "left_semi")
    live = old.join(reviewed, frame, "left_anti").select(*existing.columns).unionByName(latest(new, key, [order]).select(*existing.columns))
    return live, retired.select(*existing.columns)


def newest_round(df: DataFrame, key: list[str], round_: str, label: str, weak: str) -> tuple[DataFrame, DataFrame]:
    """(kept, superseded with the winning label): per key the highest round stays;
    a ``weak`` label never supersedes; rows without a round stay."""
    w = Window.partitionBy(*key)
    top = F.max(F.when(F.col(label) != weak, F.col(round_))).over(w)
    d = df.withColumn("_top", top)
    beaten = F.col(round_).isNotNull() & F.col("_top").isNotNull() & (F.col(round_) < F.col("_top"))
    d = d.withColumn("winner", F.max_by(F.when(F.col(label) != weak, F.col(label)), F.when(F.col(label) != weak, F.col(round_))).over(w))
    return d.where(~F.coalesce(beaten, F.lit(False))).drop("_top", "winner"), d.where(beaten).drop("_top")


def merge_by_team(old: DataFrame, new: DataFrame, key: str, value: str, carried: str) -> DataFrame:
    """Last writer wins per key; a null ``carried`` keeps its earlier value."""
    o, n = old.select(key, F.col(value).alias("ov"), F.col(carried).alias("oc")), new.select(key, F.col(value).alias("nv"), F.col(carried).alias("nc"), F.lit(True).alias("_new"))
    return o.join(n, key, "full").select(key, F.when(F.col("_new"), F.col("nv")).otherwise(F.col("ov")).alias(value), F.coalesce("nc", "oc").alias(carried))


def append_decisions(log: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Append answers not decided before (null keys match nothing)."""
    return log.unionByName(answers.join(log.select(*key).distinct(), key, "left_anti").select(*log.columns))


def leak(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    return a.select(*cols).intersect(b.select(*cols))


def absent(roster: DataFrame, seen: DataFrame, named: DataFrame, key: str, answers: Column, coverage: Column, explicit: DataFrame, least: int = 40, share: float = 0.6) -> DataFrame:
    """Roster less seen and named, if there is enough evidence; explicit ones always."""
    silent = roster.where((answers >= least) & (coverage >= share)).select(key).join(seen.select(key), key, "left_anti").join(named.select(key), key, "left_anti")
    return silent.union(explicit.select(key)).distinct()


def clip_split(df: DataFrame, clip: str, share: float) -> DataFrame:
    """Split by source clip, whole clips together: in order of a clip's hash, valid
    until ``share`` of the clips is reached."""
    from trackloom.operators.windows import numbered

    ids = numbered(df.select(clip, F.xxhash64(clip).alias("_h")).distinct(), ["_h", clip], "_r")
    n = df.select(clip).distinct().agg(F.greatest(F.lit(1), F.bround(F.count("*") * share)).alias("_n"))  # one row
    split = ids.crossJoin(n).select(clip, F.when(F.col("_r") <= F.col("_n"), "valid").otherwise("train").alias("split"))
    return df.join(split, clip)


def marked(labels: DataFrame, bundle: DataFrame, key: list[str], name: str) -> DataFrame:
    """``labels`` with a flag for those whose key ``bundle`` names, in one join. Sorted and
    merged, never broadcast: keys grow with the table. Tasks are as many as the session
    asks for; a sorted table's blocks say little about the rows they unpack to."""
    named = spread(bundle.select(*key), *key).distinct().withColumn("_named", F.lit(True))
    return spread(labels, *key).join(named.hint("merge"), key, "left").select(*labels.columns, F.col("_named").isNotNull().alias(name))


def retire_rounds(labels: DataFrame, bundle: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reset: labels of a bundle's keys become retired, the others stay."""
    d = marked(labels, bundle, key, "_retired")
    return d.where("not _retired").drop("_retired"), d.where("_retired").drop("_retired")
