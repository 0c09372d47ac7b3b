"""Sources, sinks and streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from trackloom.sources import documents as D
from trackloom.streaming import ledger as T


def test_frames(spark, tmp_path):
    det = {"tid": 3, "xyxy": [1.04, 2, 3, 4], "conf": 0.5}
    (tmp_path / "x.jsonl").write_text(json.dumps({"f": 2, "t": 0.1, "dets": [det, {**det, "tid": -1}]}) + "\n\n" + json.dumps({"f": 1, "t": 0.0, "dets": []}) + "\n")
    d = D.detections(D.read_frames(spark, str(tmp_path / "x.jsonl")))
    r = D.row_counts(d).first()
    assert (r.tracks, r.detections) == (1, 2) and d.first().box_key == "1.0,2.0,3.0,4.0"


def test_corrections(spark, tmp_path):
    label = {"f": 1, "xy": [1.0, 2.0], "src": "human", "ms": 1500}
    for n, v in ((2, 1), (10, 1)):
        (tmp_path / f"ev_qm{n}_corrections.json").write_text(json.dumps({"schemaVersion": v, "labels": [{**label, "team": "5", "was": "5"}, {**label, "notrobot": True}]}))
    (tmp_path / "ev_qm3_corrections.json").write_text("{broken")
    d = D.read_documents(spark, str(tmp_path), D.CORRECTIONS, 1, "_corrections")
    assert [r.match_number for r in d.orderBy("match_number").collect()] == [2, 10]
    r = D.label_timing(d).first()
    assert (r.labels, r.human, r.onBoxSec, r.msN) == (2, 2, 3.0, 2)
    assert D.agreement(d).first().pct == 100.0 and {x.flag for x in D.labels(d).collect()} == {None, "notrobot"}
    (tmp_path / "ev_qm4_corrections.json").write_text(json.dumps({"schemaVersion": 9, "labels": []}))
    with pytest.raises(Exception, match="unsupported schemaVersion"):
        D.read_documents(spark, str(tmp_path), D.CORRECTIONS, 1, "_corrections").collect()


def test_matches_and_shots(spark, tmp_path):
    m = {"key": "e_qm1", "event_key": "e", "comp_level": "qm", "match_number": 1, "alliances": {"red": {"score": 3, "team_keys": ["frc1", "frc2"]}, "blue": {"score": 4, "team_keys": ["frc3"]}}}
    (tmp_path / "m.json").write_text(json.dumps(m))
    r = D.shape_matches(spark.read.schema(D.API_MATCHES).json(str(tmp_path / "m.json"))).first()
    assert (r.red, r.blue, r.redScore, r.matchNumber) == (["1", "2"], ["3"], 3, 1)
    shots = spark.createDataFrame([(1, "static", 30.0), (2, "static", 90.0), (3, "pan", 200.0)], "shotId int, motionClass string, durationSec double")
    assert D.longest_static(shots).first().shotId == 2 and D.longest_static(shots, 3).first().motionClass == "pan"
    assert {r.motionClass: r.pct for r in D.shot_summary(shots).collect()} == {"static": 37.5, "pan": 62.5}


def test_mailbox(spark):
    rows = [("bundle", "a", 1_000_000, 10, "x"), ("bundle", "a", 2_000_000, 10, "y"), ("tracks", "b", 0, 10, "z"), ("nonsense", "c", 0, 1, ""), ("gallery-bundle", "d", 0, 5 << 20, "")]
    d = spark.createDataFrame(rows, "kind string, id string, at long, bytes long, payload string")
    at = lambda s: sorted((r.id, r.payload) for r in D.mailbox_listing(d, F.lit(s)).collect())
    assert at(3000) == [("a", "y"), ("b", "z")] and at(2000 + 86_400) == [("b", "z")]
    done = spark.createDataFrame([("a", 1_999_500)], "id string, at long")
    assert sorted(r.payload for r in D.waiting(d.where("kind in ('bundle', 'tracks')"), done, "id").collect()) == ["z"]


def test_audit_and_provenance(spark, tmp_path):
    lines = spark.createDataFrame([("0 0.5 0.5 0.2 0.1",), ("bad",)], "value string")
    assert D.box_audit(lines).first().aspect == pytest.approx(2.0)
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert D.provenance(spark, str(tmp_path / "f.bin")).first().sha256.startswith("ba7816bf")
    assert D.source_stem(F.lit("x")) is not None


def test_job_ledger(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    ev = [("j1", 1, "started"), ("j1", 2, "failed"), ("j1", 3, "failed"), ("j1", 4, "failed"), ("j2", 1, "started"), ("j2", 2, "failed"), ("j2", 3, "progressed"), ("j2", 4, "started"), ("j3", 1, "started"), ("j3", 2, "done")]
    (src / "a.json").write_text("\n".join(json.dumps({"job": j, "at": f"2024-01-01T00:00:0{t}Z", "event": e, "reason": "r"}) for j, t, e in ev))
    stream = spark.readStream.schema(T.EVENTS).json(str(src))
    q = T.job_states(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.job: (r.state, r.attempts) for r in spark.table("jobs").collect()}
    assert got == {"j1": ("benched", 3), "j2": ("running", 0), "j3": ("done", 0)}
    batch = spark.read.schema(T.EVENTS).json(str(src))
    assert {r.job: (r.state, r.attempts) for r in T.job_states_batch(batch).collect()} == got


def test_job_ledger_forgets_ended_jobs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(T.EVENTS).json(str(src))
    q = T.job_states(stream, delay="1 second", keep_ms=60_000).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    for i, (job, hour, event) in enumerate([("j1", 0, "done"), ("j2", 1, "started"), ("j3", 2, "started"), ("j4", 3, "started")]):
        (src / f"{i}.json").write_text(json.dumps({"job": job, "at": f"2024-01-01T0{hour}:00:00Z", "event": event, "reason": None}))
        q.processAllAvailable()
    total = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert total == 3 and spark.table("kept").count() == 4  # j1 is gone, open jobs stay


def test_mailbox_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"kind": "bundle", "id": "a", "at": 1_700_000_000_000, "bytes": 1, "payload": "x"}
    (src / "a.json").write_text(json.dumps(row) + "\n" + json.dumps(row) + "\n" + json.dumps({**row, "at": row["at"] + 5, "payload": "y"}))
    out = str(tmp_path / "out")
    q = T.deduplicated(T.read_mailbox(spark, str(src))).writeStream.foreachBatch(T.latest_sink(spark, out)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.payload for r in spark.read.parquet(out).collect()] == ["y"]
