"""Vector operators: prototype votes and whitening heads."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import aggregates, gallery_index, selection
from trackloom.plans.runtime import Scratch, ship


#: Prototypes, and bytes of them, that are handed to every task; a larger gallery is indexed.
GALLERY, GALLERY_BYTES = 50_000, 64_000_000
#: Similarities a task holds at a time (queries times prototypes).
SIMILARITIES = 4_000_000


def prototype_votes(queries: DataFrame, prototypes: DataFrame, top: int = 3, digits: int = 9, bound: int = GALLERY) -> DataFrame:
    """Each query (qid, vector) with the label whose ``top`` nearest prototypes
    (label, vector) are closest on average by cosine; ties by label.

    A curated gallery is small: up to ``bound`` rows and 64 MB go to every task as one
    matrix and queries meet it some at a time. A larger one is indexed, with the
    same rows. Similarities and scores are rounded before they are compared. Null
    vectors are left out.
    """
    held = prototypes.where("vector is not null")
    size = held.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if size["n"] > bound or size["n"] * (size["dim"] or 0) * 8 > GALLERY_BYTES:
        return gallery_index.votes(queries, prototypes, Scratch(queries.sparkSession, "votes"), top, digits)
    rows = held.select("label", S.unit("vector").alias("v")).collect()
    rows.sort(key=lambda r: r["label"])
    many = Counter(r["label"] for r in rows)
    labels = sorted(many)
    matrix = np.array([r["v"] for r in rows], float)
    edges = np.cumsum([0, *(many[k] for k in labels)])
    kinds = {k: d.schema[k].dataType.simpleString() for k, d in (("qid", queries), ("label", prototypes))}
    ship(queries.sparkSession)

    step = max(1, SIMILARITIES // max(1, len(rows)))

    def ranked(p: pd.DataFrame) -> pd.DataFrame:
        q = np.array(p["vector"].tolist(), float)
        sim = np.round(q @ matrix.T / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), digits)
        best = [-np.sort(-sim[:, a:b], axis=1)[:, :top].mean(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        score = np.round(np.stack(best, axis=1), digits)
        order = np.argsort(-score, axis=1, kind="stable")
        at = np.arange(len(q))
        first = score[at, order[:, 0]]
        margin = np.round(first - score[at, order[:, 1]], digits) if len(labels) > 1 else np.full(len(q), np.nan)
        return pd.DataFrame({"qid": p["qid"], "label": [labels[i] for i in order[:, 0]], "score": first, "margin": margin})

    def run(batches):
        for p in batches:
            for i in range(0, len(p) if labels else 0, step):
                yield ranked(p.iloc[i : i + step])

    return queries.where("vector is not null").select("qid", "vector").mapInPandas(run, f"qid {kinds['qid']}, label {kinds['label']}, score double, margin double")


def tally(votes: DataFrame, track: str, label: str, order: list, cap: int) -> DataFrame:
    """Votes per track and label over at most ``cap`` evenly spaced votes."""
    return selection.evenly_spaced(votes, [track], order, cap, truncate=True).groupBy(track, label).agg(F.count("*").alias("n"))


def pure_tracks(df: DataFrame, track: str, label: str, order: str, share: float = 0.8, least: int = 4) -> DataFrame:
    """Tracks whose majority label is pure and frequent enough."""
    m = aggregates.majority(df, [track], label, order)
    return m.where((F.col("share") >= share) & (F.col("total") >= least))


def apply_head(df: DataFrame, vector: str, mean: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(x - mean) M per row, as Columns over literal rows of the (small) head."""
    centred = F.zip_with(vector, F.lit(mean.tolist()), lambda x, m: x.cast("double") - m)
    return df.withColumn("_c", centred).withColumn(vector, F.transform(F.lit(matrix.T.tolist()), lambda row: S.dot(row, F.col("_c")))).drop("_c")
