"""Session helpers: shared scratch space, worker import path, table loading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package in local mode.

    On a cluster the package is installed or passed with ``--py-files``; the
    extra path entry is then simply unused.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in have if p]])
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    env.setdefault("RAYON_NUM_THREADS", "1")
    env.setdefault("TOKENIZERS_PARALLELISM", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly per-row work: one that is scanned in fewer parts than there
    are cores (a small file, so little data) is dealt out."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    scan = df._jdf.queryExecution().toRdd()  # plans the scan, runs nothing
    return df.repartition(cores) if scan.getNumPartitions() < cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys to as many tasks as the session's shuffles have, none merged:
    tables that compress well would else be merged by their packed size, and each task
    sorts a share that grows with the table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _fallback:
        _fallback[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return _fallback[sc.applicationId]


class Scratch:
    """Written intermediate tables under the shared folder.

    ``keep`` writes a DataFrame and reads it back, which cuts lineage: a lost
    executor costs a re-read, not a recomputation. ``drop`` frees one table.
    Everything left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/trackloom-{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", batch_rows: int | None = None) -> DataFrame:
        """Written and reread. The write's shuffle files go as soon as it is done: the
        setting for that holds during the write alone. So does ``batch_rows``, how many
        rows a Python function gets at a time, for rows of a MB."""
        conf, settings = self.spark.conf, {CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
        before = {k: conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                conf.set(k, v)
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        finally:
            for k, v in before.items():
                if v is None:
                    conf.unset(k)
                else:
                    conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit
            pass
