"""Label lines, selection, near-duplicate groups, files, configuration and the ingestion source."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import datasets as D
from vigil.operators.hamming import near_pairs
from vigil.operators.ordered import index_rows
from vigil.operators.skew import skew_join
from vigil.session import Scratch
from vigil.sources import config, files
from vigil.streaming.ingest import FrameLog, latest_per_camera


def test_label_errors(spark):
    lines = {
        "0 0.5 0.5 0.2 0.3": None, "4 0.5 0.5 0.2 0.3": "class_range", "-1 0.5 0.5 0.2 0.3": "class_range", "0 -0.05 0.5 0.2 0.3": "centre_range", "0 0.5 1.5 0.2 0.3": "centre_range",
        "0 0.5 0.5 0.0 0.3": "size_range", "0 0.5 0.5 0.2 -0.1": "size_range", "0 0.5 0.5 0.2": "token_count", "0 0.5 0.5 0.2 0.3 1": "token_count", "abc 0.5 0.5 0.2 0.3": "class_not_a_number", "0 nan 0.5 0.2 0.3": "not_finite",
    }
    got = {r.line: r.e for r in spark.createDataFrame([(x,) for x in lines], "line string").transform(D.judged).withColumnRenamed("error", "e").collect()}
    assert got == lines


def test_names(spark):
    r = spark.createDataFrame([("cam1_clip_t0002000_p00_jpg.rf.abc123.jpg", "a/cam_t0012500.jpg")], "a string, b string").select(D.original_name(F.col("a")), D.name_seconds(F.col("b"))).first()
    assert tuple(r) == ("cam1_clip_t0002000_p00.jpg", 12.5)


def test_selection(spark):
    rows = spark.createDataFrame([(1, "g_a", 0.9, 1), (2, "g_a", 0.8, 1), (3, "g_b", 0.7, 255)], "id long, g string, conf double, h long")
    assert sorted(r.id for r in D.diverse(rows, "g", "id", "h", [F.desc("conf")], 3, 3, Scratch(spark)).collect()) == [1, 3]
    assert [r.id for r in D.capped_top(rows, "g", [F.desc("conf")], 1, 5).collect()] == [1, 3]


def test_near_pairs_match_brute_force_also_in_crowded_cells(spark, monkeypatch):
    from vigil.operators import hamming

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    hashes = {h ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for h in base for _ in range(6)} | {(0xABCDEF << 40) | rng.getrandbits(16) for _ in range(150)}
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in (x & (1 << 64) - 1 for x in hashes)]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for crowded in (1_000_000, 400):
        monkeypatch.setattr(hamming, "CROWDED", crowded)
        l, r = (spark.createDataFrame([(h,) for h in signed], f"{n} long") for n in ("hl", "hr"))
        got = [tuple(x) for x in near_pairs(l, r, 3, Scratch(spark)).where("hl < hr").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicate_groups(spark):
    rows = [(1, 0), (2, 1), (3, 0b1111), (4, -1), (5, -1), (5, -1), (6, None), (None, 0), (7, 1 << 40)]
    df = spark.createDataFrame(rows, "image_id long, h long")
    assert {(r.image_id, r.group_id) for r in D.near_duplicate_groups(df, "image_id", "h", 3, Scratch(spark)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 1)}


def test_index_and_skew_join(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(1).alias("hot"))
    assert index_rows(df, ["x"], Scratch(spark), "i").where("i <> x").count() == 0
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [None])], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k int, w string")
    hot = spark.createDataFrame([(1,)], "k int")
    assert {how: skew_join(left, right, "k", how, hot).count() for how in ("inner", "left", "left_semi", "left_anti")} == {"inner": 50, "left": 54, "left_semi": 50, "left_anti": 4}


def test_manifests_labels_and_logs(spark, tmp_path):
    frame = spark.createDataFrame([("a.jpg", "c", "k", 1.5, "g", None)], files.SPLIT_MANIFEST)
    files.write_manifest(frame, str(tmp_path / "m"), files.SPLIT_MANIFEST)
    assert files.read_manifest(spark, str(tmp_path / "m"), files.SPLIT_MANIFEST).first().split == "train"
    with pytest.raises(Exception, match="exists"):
        files.write_manifest(frame, str(tmp_path / "m"), files.SPLIT_MANIFEST)
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "x.txt").write_text("0 0.1 0.1 0.1 0.1\r\n\n  \n1 0.2 0.2 0.2 0.2\n")
    assert [(r.line_no, r.line[0]) for r in files.read_labels(spark, str(tmp_path / "labels")).orderBy("line_no").collect()] == [(1, "0"), (2, "1")]
    log = tmp_path / "log" / "cam" / "ses"
    log.mkdir(parents=True)
    (log / "audit.jsonl").write_text('corrupt line\n{"event_id": "e1", "action": "EVENT_CREATED", "details": {"a": 1}}\n[1]\n\n{"event_id": "e2", "camera_id": "other", "action": "EVIDENCE_SAVED"}\n')
    got = {r.event_id: (r.camera_id, r.session_id, r.action, r.details) for r in files.read_audit_log(spark, str(tmp_path / "log")).collect()}
    assert got == {"e1": ("cam", "ses", "EVENT_CREATED", '{"a":1}'), "e2": ("other", "ses", "EVIDENCE_SAVED", "{}")}
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "metadata.json").write_text(json.dumps({"event_id": "e", "camera_id": "c"}))
    assert files.read_event_metadata(spark, str(tmp_path / "ev")).count() == 1
    (tmp_path / "st").mkdir()
    (tmp_path / "st" / "a.json").write_text('{"camera_id": "c", "updated_at_utc": "2021-01-01T00:00:00Z"}')
    (tmp_path / "st" / "b.json").write_text("{ broken")
    assert [r.camera_id for r in files.read_status(spark, str(tmp_path / "st")).collect()] == ["c"]


def test_config(spark, tmp_path):
    path = str(tmp_path / "zones.yaml")
    square = [[1, 1], [9, 1], [9, 9], [1, 9]]
    config.upsert_zone(path, "c", (10, 10), {"zone_id": "z", "zone_type": "restricted", "polygon": square})
    config.upsert_zone(path, "c", (10, 10), {"zone_id": "z", "zone_type": "counting", "polygon": square})
    zones = config.read_zones(spark, path)
    assert [(r.zone_id, r.zone_type, r.zone_name) for r in config.strict(zones, config.zone_violations(zones)).collect()] == [("z", "counting", "z")]
    config.upsert_zone(path, "c", (10, 10), {"zone_id": "y", "zone_type": "odd", "polygon": [[1, 1], [2, 2], [30, 3]]})
    bad = config.read_zones(spark, path)
    assert {r.violation for r in config.zone_violations(bad).collect()} == {"point outside the frame", "unknown zone type"}
    with pytest.raises(ValueError):
        config.strict(bad, config.zone_violations(bad))
    with pytest.raises(ValueError):
        config.upsert_zone(path, "c", (20, 20), {"zone_id": "z"})
    assert config.read_zones(spark, str(tmp_path / "none.yaml"), lenient=True).count() == 0


def test_ingestion(spark, tmp_path):
    batch = spark.createDataFrame([("c", 1, 10), ("c", 3, 30), ("c", 2, 20), ("d", 1, 5)], "camera_id string, sequence long, width int")
    assert {(r.camera_id, r.sequence, r.width, r.received, r.dropped) for r in latest_per_camera(batch).collect()} == {("c", 3, 30, 3, 2), ("d", 1, 5, 1, 0)}
    log = tmp_path / "reads.jsonl"
    log.write_text("".join(json.dumps(x) + "\n" for x in [{"camera_id": "c"}, {"camera_id": "c", "ok": False}, {"camera_id": "c", "ok": False}, {"camera_id": "c"}, 5]))
    spark.dataSource.register(FrameLog)
    q = spark.readStream.format("frame_log").option("path", str(log)).option("threshold", "2").load().writeStream.format("memory").queryName("frame_log_out").start()
    try:
        q.processAllAvailable()
        assert [(r.sequence, r.failed_reads, r.reconnects) for r in spark.table("frame_log_out").orderBy("sequence").collect()] == [(1, 0, 0), (2, 2, 1)]
    finally:
        q.stop()
