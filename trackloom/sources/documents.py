"""Sources and sinks: sheets, frame logs, correction documents, galleries, mailboxes.

Schemas are declared, never inferred; keys in file names are parsed in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import upserts

DETECTION = "struct<tid:int,xyxy:array<double>,conf:double,alliance:string,aconf:double,orig_tid:int,source_tid:int,team:string,alliance_raw:string,alliHuman:boolean>"
FRAMES = f"f int, t double, dets array<{DETECTION}>"
LABEL = "struct<f:int,xy:array<double>,team:string,src:string,was:string,ms:bigint,aid:array<string>,notrobot:boolean,wasNotrobot:boolean,unknown:boolean,mixed:boolean,alliance:string,round:int>"
CORRECTIONS = f"schemaVersion int, video string, match string, createdAt string, `by` string, session struct<startedAt:string,activeSec:int,wallSec:int,actions:int,sends:int,idleGapS:int>, labels array<{LABEL}>"
POSITIONS = "samples array<struct<f:int,t:double,tid:int,team:string,alliance:string,conf:double,x:double,y:double,flags:array<string>>>"
API_SIDE = "struct<score:int,team_keys:array<string>>"
API_MATCHES = f"key string, event_key string, comp_level string, set_number int, match_number int, actual_time bigint, alliances struct<red:{API_SIDE},blue:{API_SIDE}>"

# Kinds of the keyed mailbox, their time to live in seconds, and the largest document.
KINDS = ("bundle", "answer", "calib", "points", "occl", "tracks", "gallery-bundle", "gallery-answer", "gallery-status", "control", "status", "job")
TTL = {"tracks": 604_800, "gallery-bundle": 604_800, "gallery-answer": 2_592_000, "gallery-status": 2_592_000, "control": 604_800, "status": 604_800, "job": 604_800}
TTL_DEFAULT, LATEST_TTL = 86_400, 7_200
MAX_BYTES, MAX_GALLERY_BYTES = 24 * 1024 * 1024, 4 * 1024 * 1024


# -- sheets -------------------------------------------------------------------
def merge_catalogues(*games: dict[str, dict]) -> dict[str, dict]:
    """Event key to source description; a later game wins."""
    out: dict[str, dict] = {}
    for g in games:
        out |= g
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with headers, all text; or a JSON array of text objects."""
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# -- frame logs ---------------------------------------------------------------
def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame rows of a JSON-lines log; blank lines drop out."""
    return spark.read.schema(FRAMES).json(path).where("f is not null")


def detections(frames: DataFrame) -> DataFrame:
    """One row per detection with a key that survives track splits."""
    d = frames.select("f", "t", F.posexplode("dets").alias("ord", "d")).select("f", "t", "ord", "d.*")
    box = {k: F.get("xyxy", F.lit(i)) for i, k in enumerate(("x1", "y1", "x2", "y2"))}
    return d.withColumns({**box, "box_key": F.array_join(F.transform("xyxy", lambda v: F.format_string("%.1f", F.round(v, 1))), ",")})


def row_counts(dets: DataFrame) -> DataFrame:
    return dets.agg(F.count_distinct(F.when(F.col("tid") >= 0, F.col("tid"))).alias("tracks"), F.count("*").alias("detections"))


# -- documents ----------------------------------------------------------------
def read_documents(spark: SparkSession, path: str, schema: str, version: int | None = None, suffix: str = "") -> DataFrame:
    """JSON documents with ``stem`` from the file name (less ``suffix``), its event and
    its match number, so that order is numeric. A wrong schemaVersion fails the
    query; unreadable files drop out."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+?)(\\.[^./]+)?$", 1)
    stem = F.regexp_replace(name, f"{suffix}$", "") if suffix else name
    d = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).select("*", stem.alias("stem"))
    d = d.where("_corrupt is null").drop("_corrupt")
    d = d.withColumns({"event": F.regexp_extract("stem", "^([^_]+)", 1), "match_kind": F.regexp_extract("stem", "_([a-z]+)\\d*", 1), "match_number": F.regexp_extract("stem", "(\\d+)$", 1).try_cast("int")})
    if version is not None:
        gate = F.when(F.col("schemaVersion").eqNullSafe(version), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported schemaVersion in "), F.col("stem"))).cast("boolean"))
        d = d.where(gate)
    return d


def labels(docs: DataFrame) -> DataFrame:
    """One row per curator label, in order, with its flag."""
    d = docs.select("stem", F.posexplode("labels").alias("ord", "l")).select("stem", "ord", "l.*")
    flag = F.when(F.col("mixed"), "mixed").when(F.col("notrobot"), "notrobot").when(F.col("unknown"), "unknown")
    return d.withColumn("flag", flag)


def label_timing(docs: DataFrame) -> DataFrame:
    """Per document: labels, human labels, seconds on boxes (one digit)."""
    human = F.filter("labels", lambda x: x["src"] == "human")
    ms = F.filter(F.transform(human, lambda x: x["ms"]), lambda v: v.isNotNull())
    total = F.aggregate(ms, F.lit(0).cast("long"), lambda a, v: a + v)
    return docs.select(F.col("stem").alias("match"), F.coalesce(F.size("labels"), F.lit(0)).alias("labels"), F.size(human).alias("human"), "session.activeSec", "session.wallSec", F.when(F.size(ms) > 0, F.round(total / 1000, 1)).alias("onBoxSec"), F.size(ms).alias("msN"))


def agreement(docs: DataFrame) -> DataFrame:
    """Per document: how often the guess shown was confirmed (null without guesses)."""
    d = labels(docs).where("src = 'human'")
    had = F.col("was").isNotNull()
    g = d.groupBy("stem").agg(F.count("*").alias("human"), F.count_if(had).alias("hadGuess"), F.count_if(had & (F.col("was") == F.col("team"))).alias("agree"))
    return g.withColumn("pct", F.when(F.col("hadGuess") > 0, F.round(F.col("agree") * 100 / F.col("hadGuess"), 1)))


def shape_matches(raw: DataFrame) -> DataFrame:
    """API matches to match records: alliances flattened, team keys without prefix."""
    teams = lambda side: F.transform(f"alliances.{side}.team_keys", lambda k: F.regexp_replace(k, "^frc", ""))
    return raw.select(
        "key", F.col("event_key").alias("eventKey"), F.col("comp_level").alias("compLevel"), F.col("set_number").alias("setNumber"), F.col("match_number").alias("matchNumber"),
        teams("red").alias("red"), teams("blue").alias("blue"), F.col("alliances.red.score").alias("redScore"), F.col("alliances.blue.score").alias("blueScore"), F.col("actual_time").alias("actualTime"),
    )


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def write_documents(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Rows as nested JSON, one per line, under Spark's commit protocol."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).json(path)


def longest_static(shots: DataFrame, shot: str | None = None) -> DataFrame:
    """The named shot, or the longest static one."""
    if shot is not None:
        return shots.where(F.col("shotId") == shot)
    return shots.where("motionClass = 'static'").orderBy(F.desc("durationSec"), "shotId").limit(1)


def shot_summary(shots: DataFrame) -> DataFrame:
    """Duration by motion class, its percentage, count over 20 s and longest."""
    g = shots.groupBy("motionClass").agg(F.sum("durationSec").alias("seconds"), F.count("*").alias("shots"), F.count_if(F.col("durationSec") > 20).alias("over20"), F.max("durationSec").alias("longest"), F.percentile("durationSec", 0.5).alias("median"))
    return g.crossJoin(shots.agg(F.sum("durationSec").alias("_t"))).withColumn("pct", F.round(F.col("seconds") * 100 / F.col("_t"), 1)).drop("_t")  # one row


# -- vectors ------------------------------------------------------------------
def read_gallery(spark: SparkSession, path: str, space: str, without_match: str | None = None) -> DataFrame:
    """Prototypes of one embedding space, optionally without one source match."""
    d = spark.read.parquet(path).where(F.col("embeddingSpace") == space)
    return d if without_match is None else d.where(~F.col("sourceMatch").eqNullSafe(without_match))


def write_gallery(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("embeddingSpace").parquet(path)


def box_audit(lines: DataFrame) -> DataFrame:
    """Label text lines 'class cx cy w h' to typed rows; malformed lines drop out."""
    p = F.split(F.trim("value"), "\\s+")
    d = lines.where(F.size(p) == 5).select(*[c for c in lines.columns if c != "value"], p[0].try_cast("int").alias("cls"), *[p[i].try_cast("double").alias(k) for i, k in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))])
    return d.where("cls is not null and h is not null").withColumn("aspect", F.when(F.col("h") > 0, F.col("w") / F.col("h")))


# -- mailbox ------------------------------------------------------------------
def time_to_live(kind: Column) -> Column:
    out = None
    for k, v in TTL.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(TTL_DEFAULT)


def admitted(entries: DataFrame) -> DataFrame:
    """Entries of known kinds within the size cap, with their expiry (seconds)."""
    cap = F.when(F.col("kind") == "gallery-bundle", MAX_GALLERY_BYTES).otherwise(MAX_BYTES)
    return entries.where(F.col("kind").isin(*KINDS) & (F.col("bytes") <= cap)).withColumn("expires", F.floor(F.col("at") / 1000) + time_to_live(F.col("kind")))


def mailbox_listing(entries: DataFrame, now: Column) -> DataFrame:
    """The index: latest entry per (kind, id) that hasn't expired at ``now`` (seconds)."""
    return upserts.unexpired(admitted(entries), ["kind", "id"], ["at"], F.col("expires"), now)


def waiting(answers: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Answers newer than what was processed, by more than a second (1000 ms)."""
    j = answers.join(processed.select(key, F.col("at").alias("_done")), key, "left")
    return j.where(F.col("_done").isNull() | (F.col("at") > F.col("_done") + 1000)).drop("_done")


def manifest(routes: DataFrame, gallery: DataFrame) -> DataFrame:
    """Summary per route document: its teams and how many the gallery knows."""
    e = routes.select("match", "event", F.explode("teams").alias("team"))
    known = gallery.select("team").distinct().withColumn("_k", F.lit(1))
    return e.join(known, "team", "left").groupBy("match", "event").agg(F.count("*").alias("teams"), F.count("_k").alias("known"))


def adapter(f: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
    return f or (lambda d: d)


def source_stem(x) -> Column:
    """A file name without its augmentation suffix (``.rf.<hash>``) and extension."""
    return F.regexp_replace(F.regexp_replace(S.c(x), "\\.rf\\.[0-9a-f]+", ""), "(_(jpg|jpeg|png))?\\.[A-Za-z0-9]+$", "")
