"""Rules: scenarios, and windows against the sequential machine on random input, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.functions.geometry import area, edges, point_in_polygon
from vigil.operators import rules as R
from vigil.streaming.rules import FRAME, Machine, Thresholds, Zone, rule_stream

SQUARE = ((10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (10.0, 90.0))
IN, OUT = 50.0, 5.0


def _zones(spark, zones):
    rows = [("c", z.zone_id, z.zone_id, "restricted" if z.restricted else "counting", True, z.inside_after, z.outside_after, z.ttl, n, [{"x": x, "y": y} for x, y in z.polygon]) for n, z in enumerate(zones)]
    schema = "camera_id string, zone_id string, zone_name string, zone_type string, enabled boolean, confirm_inside_seconds double, confirm_outside_seconds double, state_ttl_seconds double, zone_ordinal int, polygon array<struct<x:double,y:double>>"
    return spark.createDataFrame(rows, schema).withColumn("edges", edges(F.col("polygon")))


def _batch(spark, frames, zones, limits):
    obs = [("c", s, k, n, t, x, y, h, 0.8) for s, n, t, tracks in frames for k, x, y, h in tracks]
    observations = spark.createDataFrame(obs, "camera_id string, session_id string, track_id long, frame_number long, timestamp_seconds double, x double, y double, height double, confidence double")
    spine = spark.createDataFrame([("c", s, n, t) for s, n, t, _ in frames], "camera_id string, session_id string, frame_number long, timestamp_seconds double")
    z = _zones(spark, zones)
    states = R.debounce(R.membership(observations, z))
    occupied = R.occupancy(states, spine, z)
    lone = R.lone_person_events(R.lone_person(occupied, limits.alone_after, limits.reset_after))
    still = R.low_movement_events(R.low_movement(R.eligible(states), limits.still_after, limits.ratio, limits.least_pixels, limits.still_ttl))
    out = set()
    for df in (R.restricted_entries(states), lone, still):
        out |= {(r.module_id, r.session_id, r.zone_id, r.track_id, r.frame_number) for r in df.collect()}
    return out, {(r.session_id, r.zone_id, r.frame_number): r.occupancy for r in occupied.collect()}


def _machine(frames, zones, limits):
    out, held, machines = set(), {}, {}
    for s, n, t, tracks in frames:
        m = machines.setdefault(s, Machine(zones, limits))
        for kind, zone, track, value in m.step(n, t, tracks):
            if kind == "IDT-004":
                held[s, zone, n] = int(value)
            else:
                out.add((kind, s, zone, track, n))
    return out, held


def _path(moves, step=0.1, confirm=0.1, ttl=2.0):
    zone = Zone("z", True, SQUARE, confirm, confirm, ttl)
    frames = [("s", i, t, [(1, IN if side == "in" else OUT, 50.0, 100.0)]) for i, (t, side) in enumerate(moves)]
    return frames, (zone,)


SCENARIOS = {
    "entry once": ([(0.0, "out"), (0.1, "out"), (0.2, "in"), (0.3, "in"), (0.4, "in")], 0.1, [3]),
    "outside not confirmed": ([(0.0, "out"), (0.1, "in"), (0.3, "in")], 0.2, []),
    "re-entry": ([(0.0, "in"), (0.1, "in"), (0.2, "out"), (0.3, "out"), (0.4, "in"), (0.5, "in")], 0.1, [5]),
    "first seen inside": ([(0.0, "in")], 0.0, []),
    "gap equal to time to live": ([(0.0, "out"), (0.1, "out"), (2.1, "in"), (2.2, "in")], 0.1, [3]),
    "gap over time to live": ([(0.0, "out"), (0.1, "out"), (2.2, "in"), (2.3, "in")], 0.1, []),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_entries(spark, name):
    moves, confirm, want = SCENARIOS[name]
    frames, zones = _path(moves, confirm=confirm)
    for events, _ in (_batch(spark, frames, zones, Thresholds()), _machine(frames, zones, Thresholds())):
        assert sorted(n for kind, *_, n in events if kind == "BAR-001") == want


def _random(seed):
    rng = random.Random(seed)
    zones = tuple(Zone(z, z != "b", SQUARE if z != "c" else ((0.0, 0.0), (60.0, 0.0), (60.0, 60.0)), rng.choice([0.0, 0.2, 0.5]), rng.choice([0.0, 0.2, 0.5]), rng.choice([0.5, 1.0])) for z in "abc")
    limits = Thresholds(rng.choice([0.3, 1.0]), rng.choice([0.2, 0.6]), rng.choice([0.6, 1.2]), 0.1, 5.0, rng.choice([0.5, 1.0]))
    frames = []
    for s in ("s1", "s2", "s3"):
        t = 0.0
        for n in range(60):
            t = round(t + rng.choice([0.0, 0.1, 0.1, 0.2, 0.6]), 1)
            frames.append((s, n, t, [(k, rng.choice([5.0, 30.0, 50.0, 53.0, 90.0]), rng.choice([5.0, 50.0]), 100.0) for k in (1, 2) if rng.random() < 0.7]))
    return frames, zones, limits


@pytest.mark.parametrize("seed", range(4))
def test_windows_agree_with_the_machine(spark, seed):
    frames, zones, limits = _random(seed)
    assert _batch(spark, frames, zones, limits) == _machine(frames, zones, limits)


def test_stream_agrees_with_the_machine(spark, tmp_path):
    frames, zones, limits = _random(9)
    source = str(tmp_path / "in")
    spark.createDataFrame([], FRAME).write.parquet(source)
    rows = [("c", s, n, t, [{"track_id": k, "x": x, "y": y, "height": h, "confidence": 0.8} for k, x, y, h in tracks]) for s, n, t, tracks in frames]
    for part in (lambda n: n < 25, lambda n: n >= 25):
        spark.createDataFrame([r for r in rows if part(r[2])], FRAME).coalesce(1).write.mode("append").parquet(source)
        stream = rule_stream(spark.readStream.schema(FRAME).parquet(source), {"c": zones}, limits)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    events, held = _machine(frames, zones, limits)
    assert {(r.kind, r.session_id, r.zone_id, r.track_id, r.frame_number) for r in got if r.kind != "IDT-004"} == events
    assert {(r.session_id, r.zone_id, r.frame_number): int(r.value) for r in got if r.kind == "IDT-004"} == held


def test_late_frames():
    m = Machine((), Thresholds())
    assert list(m.step(1, 5.0, [])) == []
    assert [k for k, *_ in m.step(2, 4.0, [])] == ["late"]


def test_polygon(spark):
    z = _zones(spark, (Zone("z", True, SQUARE, 0.0, 0.0, 1.0),))
    points = spark.createDataFrame([(10.0, 10.0, True), (50.0, 90.0, True), (50.0, 50.0, True), (9.9, 50.0, False), (95.0, 10.0, False)], "x double, y double, want boolean")
    assert points.crossJoin(z).where(point_in_polygon(F.col("x"), F.col("y"), F.col("edges")) != F.col("want")).count() == 0
    assert z.select(area(F.col("edges"))).first()[0] == 6400.0


def test_rule_windows_need_one_exchange_and_no_python(spark):
    frames, zones, _ = _random(1)
    obs = spark.createDataFrame([("c", s, k, n, t, x, y, h, 0.8) for s, n, t, tr in frames for k, x, y, h in tr], "camera_id string, session_id string, track_id long, frame_number long, timestamp_seconds double, x double, y double, height double, confidence double")
    plan = R.restricted_entries(R.debounce(R.membership(obs.repartition(*R.TRACK), _zones(spark, zones))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
