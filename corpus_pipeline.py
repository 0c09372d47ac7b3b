"""Training-corpus pipeline: quality rules, line dedup, near-dedup, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import line_templates, near_copies, packing, quality, secrets
from trackloom.llm.queries import vocabulary
from trackloom.plans.runtime import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the learned decision list reject: null, empty and
    blank texts too. Null ids, repeated rows and other columns pass."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of recurring templates from all but the first document. Null texts
    stay null, repeated rows keep the same lines, other columns pass."""
    return line_templates.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are 0.8 alike:
    the one with the smallest id, in all its rows. Null ids stay. Candidates come from
    the anchor-point covering of operator 1, and from bands where it doesn't reach."""
    return near_copies.first_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace reported secrets by their kind. Null texts stay null, other columns
    pass."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack; a row per piece, with its ids. A null text is empty: just the
    end id. An empty table gives no rows, as in all stages."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
