"""Sources and sinks on disk, readers' lives, and runs that go over the borders of tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import datasets as D
from vigil.operators import records as R
from vigil.operators.ordered import runs
from vigil.session import Scratch
from vigil.sources import config as C
from vigil.sources import files as S


def _runs(rows, marks):
    out, held = [], None
    for key in sorted({k for k, _, _ in rows}):
        for _, o, f in sorted(r for r in rows if r[0] == key):
            if not f:
                held = None
            elif held and held[0] == key:
                held[2], held[3] = o, held[3] + 1
                held[4] = (held[4] + [o])[:marks]
            else:
                held = [key, o, o, 1, [o][:marks]]
                out.append(held)
        held = None
    return sorted(map(tuple, ((*h[:4], tuple(h[4])) for h in out)))


@pytest.mark.parametrize("parts, failed", [(1, 0.5), (3, 0.9), (8, 0.97), (8, 0.2), (8, 1.0)])
def test_runs_over_borders(spark, parts, failed):
    rng = random.Random(parts)
    rows = [(f"k{i % 3}", i, rng.random() < failed) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, f boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = runs(df.repartition(5), ["k"], "o", F.col("f"), Scratch(spark), 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.k, r["first"], r["last"], r.n, tuple(r.marks)) for r in got) == _runs(rows, 3)
    assert runs(df.limit(0), ["k"], "o", F.col("f"), Scratch(spark)).count() == 0


def test_lifecycle(spark):
    kinds = {"a": "xx.xxxxxxx.x", "b": "....", "c": "xxxx.xxxx", "d": "xxxxx"}
    rows = [(k, i, c == "x") for k, text in kinds.items() for i, c in enumerate(text)]
    got = {r.k: (r.n_failures, r.n_waits, r.seconds_waited, r.terminal_at) for r in R.lifecycle(spark.createDataFrame(rows, "k string, o long, f boolean"), "k", "o", F.col("f"), Scratch(spark)).collect()}
    assert got == {"a": (7, 6, 1 + 2 + 1 + 2 + 4 + 8, 7), "c": (8, 8, 30.0, None), "d": (5, 4, 15.0, 4)}


def test_finite_run_and_snapshot(spark):
    rows = [("a", 1, 0, True), ("a", 2, 2_000_000, False), ("a", 3, 9_000_000, False), ("a", 4, 11_000_000, True), ("b", 5, 0, True), ("c", 6, 7, False), (None, 7, 7, False)]
    df = spark.createDataFrame(rows, "k string, o long, t long, f boolean")
    got = {r.k: (r.n_frames, r.stopped) for r in R.finite_run(df.where("k is not null"), "k", "t", F.col("f"), 10.0, 5.0).collect()}
    assert got == {"a": (2, "duration"), "b": (0, "no first frame"), "c": (1, "end of source")}
    snap = {r.k: r for r in R.snapshot(df.where("k is not null"), "k", "o", "t", F.col("f")).collect()}
    assert (snap["a"].frames_received, snap["a"].failed_reads, snap["a"].consecutive_failed_reads, snap["a"].time_to_first_frame) == (2, 2, 1, 2.0)
    assert snap["b"].consecutive_failed_reads == 1 and snap["b"].time_to_first_frame is None and snap["c"].runtime_seconds == 0.0


def test_packages_are_never_overwritten(spark, tmp_path):
    schema = "event_id string, camera_id string, session_id string, module_id string, track_id long, source_video string, source_timestamp_seconds double"
    one = spark.createDataFrame([("e1", "c", "s", "BAR-001", 1, None, 2.0), ("e1", "c", "s", "BAR-001", 1, None, 2.0), ("e2", "cam_good_test", "s", "BAR-001", 2, "", None)], schema)
    root = str(tmp_path / "evidence")
    assert sorted((r.event_id, r.action) for r in S.write_packages(one, root).collect()) == [("e1", S.REFUSED), ("e1", S.SAVED), ("e2", S.SAVED)]
    again = spark.createDataFrame([("e1", "c", "s", "BAR-001", 9, "v.mp4", 8.0), ("e3", "c", "s", "EXC-002", 9, "v.mp4", 8.0), (None, "c", "s", "x", 1, None, None)], schema)
    assert sorted((r.event_id, r.action) for r in S.write_packages(again, root).collect()) == [("e1", S.REFUSED), ("e3", S.SAVED)]
    got = {r.event_id: r for r in S.read_packages(spark, root).collect()}
    assert got["e1"].track_id == 1 and {k: r.is_recorded_prototype for k, r in got.items()} == {"e1": False, "e2": True, "e3": True}
    assert got["e3"].raw_snapshot_path == "c/s/event_e3/snapshot_raw.jpg"
    assert S.read_audit(spark, f"{root}/audit").count() == 5


def test_status_is_replaced_in_one_step(spark, tmp_path):
    names = [c.split() for c in S.STATUS.split(", ")]
    frame = lambda rows: spark.createDataFrame([tuple(r.get(n) for n, _ in names) for r in rows], S.STATUS)
    path = str(tmp_path / "status")
    S.write_status(frame([{"camera_id": "a", "updated_at_utc": "2021-01-01", "processing_fps": 1.23456}, {"camera_id": "b", "updated_at_utc": "2021-01-01"}]), path)
    S.write_status(frame([{"camera_id": "a", "updated_at_utc": "2021-01-03", "processing_fps": 2.34567}, {"camera_id": "a", "updated_at_utc": "2021-01-02"}]), path)
    assert [(r.camera_id, r.updated_at_utc, r.processing_fps) for r in S.read_status_lines(spark, path).collect()] == [("a", "2021-01-03", 2.346)]


def test_strict_audit_names_the_line(spark, tmp_path):
    path = tmp_path / "audit.jsonl"
    path.write_text('{"event_id": "a"}\n\n{"event_id": \n')
    with pytest.raises(ValueError, match=r"audit\.jsonl:3"):
        S.read_audit_log_strict(spark, str(path))
    path.write_text('{"event_id": "a"}\n')
    assert S.read_audit_log_strict(spark, str(path)).count() == 1


def test_layouts_and_listing(spark, tmp_path):
    cases = {
        "train/images/a.jpg": ("train", "train/labels/a.txt"), "images/valid/b.c.PNG": ("val", "labels/valid/b.c.txt"), "test/d.jpeg": ("test", "test/d.txt"), "e.jpg": (None, None), "x/y/z/w.jpg": (None, None),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    split, label = S.layout(F.col("path"))
    assert {r.path: (r.s, r.l) for r in df.select("path", split.alias("s"), label.alias("l")).collect()} == cases
    for name in ("train/images/a.jpg", "train/images/b.JPEG", "train/images/c.txt", "train/labels/a.txt", "valid/d.webp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r.path for r in S.images(S.list_files(spark, str(tmp_path))).collect()} == {"train/images/a.jpg", "train/images/b.JPEG", "valid/d.webp"}
    import yaml

    (tmp_path / "data.yaml").write_text(yaml.safe_dump({"names": {0: "helmet", 1: "no_helmet", 2: "no_vest", 3: "vest"}, "train": "train/images"}))
    content = C.read_dataset(str(tmp_path / "data.yaml"), D.CLASSES)
    assert [(s, a.replace(str(tmp_path), ""), b.replace(str(tmp_path), "")) for s, a, b in C.split_folders(str(tmp_path), content)] == [("train", "/train/images", "/train/labels"), ("val", "/valid", "/valid")]
    (tmp_path / "other.yaml").write_text(yaml.safe_dump({"names": ["vest", "helmet", "no_vest", "no_helmet"]}))
    with pytest.raises(ValueError, match="class names"):
        C.read_dataset(str(tmp_path / "other.yaml"), D.CLASSES)
    assert C.read_dataset(str(tmp_path / "other.yaml"), D.CLASSES, ordered=False)["names"][0] == "vest"


def test_controls_fail_safely(tmp_path):
    path, defaults = str(tmp_path / "c" / "controls.yaml"), {"A": {"enabled": True, "label": "a"}, "B": {"enabled": False, "label": "b"}}
    assert C.load_controls(path, defaults) == defaults
    C.save_controls(path, {"A": {"enabled": False, "label": "renamed"}, "Z": {"enabled": True}}, defaults)
    assert C.load_controls(path, defaults) == {"A": {"enabled": False, "label": "a"}, "B": {"enabled": False, "label": "b"}}
    with pytest.raises(ValueError):
        C.save_controls(path, {"A": {"enabled": "yes"}}, defaults)
    assert C.load_controls(path, defaults)["A"]["enabled"] is False
    (tmp_path / "bad.yaml").write_text("- a\n- b\n")
    with pytest.raises(ValueError):
        C.load_controls(str(tmp_path / "bad.yaml"), defaults)


def test_group_manifest_and_pool(spark, tmp_path):
    rows = spark.createDataFrame([("g1", "REVIEW_REQUIRED", f"train/images/{i}.jpg") for i in range(200)] + [("g2", "LIKELY_SAME_SOURCE", "val/images/7.jpg")], "group_id string, review_status string, path string")
    path = str(tmp_path / "groups")
    S.write_group_manifest(rows, path)
    assert sorted(map(tuple, S.read_group_manifest(spark, path).select("group_id", "review_status", "path").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_group_manifest(rows, path)
    (tmp_path / "one.json").write_text(json.dumps({"groups": [{"group_id": "g", "review_status": "r", "members": [{"path": "p"}, {"path": "q"}]}]}, indent=2))
    assert S.read_group_manifest(spark, str(tmp_path / "one.json"), multi_line=True).count() == 2
    pool = S.pool_manifest(rows, F.lit("public__"))
    assert pool.where("destination_image = 'images/public__7.jpg'").count() == 2
    with pytest.raises(ValueError, match="public__7.jpg"):
        S.write_pool_manifest(pool, str(tmp_path / "pool"))
    S.write_pool_manifest(pool.where("n_same = 1"), str(tmp_path / "pool"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_pool_manifest(pool.where("n_same = 1"), str(tmp_path / "pool"))


def test_blanks_survive_a_manifest(spark, tmp_path):
    names = [c.split()[0] for c in S.SPLIT_MANIFEST.split(", ")]
    df = spark.createDataFrame([(" a.jpg", "c", None, 1.5, "g ", None)], S.SPLIT_MANIFEST)
    S.write_manifest(df, str(tmp_path / "m"), S.SPLIT_MANIFEST)
    (r,) = S.read_manifest(spark, str(tmp_path / "m"), S.SPLIT_MANIFEST).collect()
    assert [r[n] for n in names] == [" a.jpg", "c", None, 1.5, "g ", "train"]


def test_group_evidence_needs_a_pair_within_the_threshold(spark):
    """a - b - c is a chain; a and c are the same picture by name but too far apart to tell."""
    rows = [(1, 0b0, "x"), (2, 0b111, "y"), (3, 0b111111, "x"), (4, 255 << 40, "q"), (5, 255 << 40, "q"), (6, 255 << 50, "z")]
    images = spark.createDataFrame(rows, "image_id long, h long, stem string")
    members, _, near = D.near_duplicates(images, "image_id", "h", 3, Scratch(spark))
    assert {(r.image_id, r.group_id) for r in members.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    known = members.join(images.select("image_id", "stem"), "image_id")
    assert [r.group_id for r in D.group_matches(known, near, "stem").collect()] == [4]
    counted = D.split_pairs(known.withColumn("split", F.when(F.col("image_id") == 2, "val").otherwise("train")), near, "split").first()
    assert (counted.n_within, counted.n_across) == (1, 2)


def test_diverse_selection(spark):
    rng = random.Random(5)
    rows = [(i, f"g{rng.randrange(5)}", rng.randrange(40) << 20 if rng.random() < 0.9 else None, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, h long, c double")
    for most in (1, 7, 60):
        ranked = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[0])) for g in {r[1] for r in rows}}
        want, turn = [], 0
        while len(want) < most and any(turn < len(v) for v in ranked.values()):
            for g in sorted(ranked):
                if turn < len(ranked[g]) and len(want) < most:
                    r = ranked[g][turn]
                    if r[2] is None or all(w[2] is None or (r[2] ^ w[2]).bit_count() > 3 for w in want):
                        want.append(r)
            turn += 1
        got = D.diverse(df, "g", "i", "h", [F.desc("c"), F.asc("i")], most, 3, Scratch(spark)).collect()
        assert [(r.i, r.h) for r in sorted(got, key=lambda r: r.accepted)] == [(r[0], r[2]) for r in want]


def test_gate_reasons(spark):
    images = spark.createDataFrame([
        *[(d, f"{d}{i}", s, f"{d}g{i}") for d in ("ok", "bad", "none") for i, s in enumerate(["train", "val"])], ("noval", "n0", "train", "g"), ("notrain", "t0", "val", "g"), ("leak", "l0", "train", "same"), ("leak", "l1", "val", "same"),
    ], "d string, image string, split string, source_group string")
    lines = spark.createDataFrame([
        ("ok", "ok0", 1, None), *[("bad", "bad0", i, "token_count") for i in range(1, 6)], ("noval", "n0", 1, None), ("notrain", "t0", 1, None), ("leak", "l0", 1, None),
    ], "d string, image string, line_no int, error string")
    got = {r.d: r.reason for r in D.gate(images, lines, "d").collect()}
    assert got == {
        "ok": "passed", "bad": "fatal errors: bad0:1 token_count; bad0:2 token_count; bad0:3 token_count", "none": "no labelled instances", "noval": "validation split is empty", "notrain": "train split is empty", "leak": "source groups leak",
    }
    with pytest.raises(ValueError, match="no frame"):
        D.referred(images, F.col("split") == "train", "frame")
