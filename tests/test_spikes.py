"""Spikes: each kind of case and of decoy, and verdicts that don't depend on where chunks are cut."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest

from vigil.operators import spikes as S

START = datetime(2021, 1, 1)


def _frame(spark, series):
    """series: {(source, field, camera, session): [(value, eligible, bound), ...]}"""
    rows, n = [], 0
    for (source, name, camera, session), values in series.items():
        for i, (v, ok, bound) in enumerate(values):
            n += 1
            rows.append((source, name, camera, session, n, START + timedelta(seconds=5 * i), ok, v, bound))
    return spark.createDataFrame(rows, S.READINGS)


def _got(spark, series):
    out = {}
    ids = {}
    n = 0
    for key, values in series.items():
        for i in range(len(values)):
            n += 1
            ids[n] = (key[1], key[3], i)
    for r in S.flagged(_frame(spark, series), S.LIMITS).collect():
        out[ids[r.row_id]] = r.reason
    return out


def _rate(rng, n, level=10.0, spread=0.3):
    return [round(level + float(x), 3) for x in rng.normal(0, spread, n)]


def _all(values, bound=None, ok=True):
    return [(v, ok, bound) for v in values]


def test_rates(spark):
    rng = np.random.default_rng(1)
    spiky, shifted, plateau, limits, stuck = (_rate(rng, 60) for _ in range(5))
    spiky[20:23] = [40.0, 41.0, 3.0 + 40]
    spiky[40] = 31.0
    shifted[30:] = [x + 20 for x in shifted[30:]]
    plateau[20:26] = [x + 20 for x in plateau[20:26]]
    limits[5], limits[6], limits[7], limits[8] = float("nan"), -1.0, 240.5, float("inf")
    stuck[10:18] = [stuck[10]] * 8
    stuck[30:37] = [stuck[30]] * 7
    key = lambda s: ("runtime_status", "processing_fps", "cam", s)
    got = _got(spark, {key("spiky"): _all(spiky), key("shifted"): _all(shifted), key("plateau"): _all(plateau), key("limits"): _all(limits), key("stuck"): _all(stuck)})
    f = "processing_fps"
    want = {(f, "spiky", i): "spike" for i in (20, 21, 22, 40)} | {(f, "limits", i): "limit" for i in (5, 6, 7, 8)} | {(f, "stuck", i): "stuck" for i in range(10, 18)}
    assert got == want


def test_constant_camera_and_zero(spark):
    values = [25.0] * 30
    values[10], values[20] = 12.5, 0.0
    got = _got(spark, {("rtsp_metrics", "reported_source_fps", "c", "s"): _all(values)})
    assert got == {("reported_source_fps", "s", 10): "spike", ("reported_source_fps", "s", 20): "limit"}


def test_counts(spark):
    values = [float(20 * i) for i in range(40)]
    values[10], values[20], values[30] = 900.0, 0.0, -5.0
    got = _got(spark, {("runtime_status", "frames_dropped", "c", "s"): [(v, True, 40.0 * i + 1000) for i, v in enumerate(values)]})
    assert got == {("frames_dropped", "s", 10): "disorder", ("frames_dropped", "s", 20): "disorder", ("frames_dropped", "s", 30): "limit"}
    above = [(float(20 * i), True, 40.0 * i if i != 15 else 1.0) for i in range(40)]
    assert _got(spark, {("runtime_status", "frames_dropped", "c", "s"): above}) == {("frames_dropped", "s", 15): "limit"}


def test_only_eligible_rows_and_empty_input(spark):
    rng = np.random.default_rng(2)
    values = _all(_rate(rng, 40))
    values[20] = (90.0, False, None)
    assert _got(spark, {("runtime_status", "processing_fps", "c", "s"): values}) == {}
    assert _got(spark, {}) == {}


@pytest.mark.parametrize("chunk", [128, 1_000])
def test_chunks_do_not_matter(spark, monkeypatch, chunk):
    rng = np.random.default_rng(3)
    values = _rate(rng, 3000)
    for i in range(50, 2950, 61):
        values[i] = 60.0
    values[700:760] = [values[700]] * 60
    series = {("runtime_status", "processing_fps", "hot", "s"): _all(values)}
    whole = _got(spark, series)
    monkeypatch.setattr(S, "CHUNK", chunk)
    assert _got(spark, series) == whole and sum(r == "spike" for r in whole.values()) >= 45


def test_few_rounds_and_neighbours_are_made_up_for(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = _rate(rng, 1200)
    for i in range(30, 1170, 4):  # so dense that levels are right only after several rounds
        values[i] += float(rng.choice([30, 60, 90]))
        values[i + 1] += float(rng.choice([0, 45]))
    counts = [float(20 * i) for i in range(1200)]
    for i in range(50, 1100, 9):
        counts[i : i + 3] = [counts[i] + 1e5, counts[i] + 2e5, 0.0]
    series = {("runtime_status", "processing_fps", "c", "s"): _all(values), ("runtime_status", "frames_dropped", "c", "s"): [(v, True, 1e9) for v in counts]}
    whole = _got(spark, series)
    monkeypatch.setattr(S, "CHUNK", 100)
    monkeypatch.setattr(S, "ROUNDS", 1)
    monkeypatch.setattr(S, "HALO", 12)
    tried = []
    judge = S._judge
    monkeypatch.setattr(S, "_judge", lambda limits, rounds, total: (tried.append(rounds), judge(limits, rounds, total))[1])
    assert _got(spark, series) == whole and len(whole) > 300 and tried[:2] == [1, 4]


def test_the_autoregression_decides():
    n, spread = 40, np.full(40, 1.0)
    x = np.where(np.arange(n) % 2, 0.2, -0.2)
    x[19:22] = 3.0, 11.0, 3.0  # a slow wave's crest rather than a spike, if readings carry over
    series, usable = np.zeros(n, int), np.ones(n, bool)
    off = lambda phi: np.flatnonzero(S.additive_outliers(x, series, spread, np.full(n, phi), usable)).tolist()
    assert off(0.0) == [20] and off(0.8) == []
    x[19:22] = -3.0, 9.0, -3.0  # from below, the same reading is further off than its level tells
    assert off(0.0) == [] and off(0.8) == [20]


def test_coefficient_of_each_source(spark):
    rng = np.random.default_rng(7)
    smooth, e = [0.0], rng.normal(0, 1, 4000)
    for v in e:
        smooth.append(0.8 * smooth[-1] + float(v))
    rows = {("runtime_status", "processing_fps", "smooth", "s"): _all([v + 50 for v in smooth]), ("runtime_status", "processing_fps", "rough", "s"): _all(_rate(rng, 4000, 50.0, 1.0))}
    frame = _frame(spark, rows)
    placed = frame.orderBy("camera_id", "at").toPandas()
    for c in ("smooth", "rough"):
        v = placed[placed.camera_id == c].value.to_numpy()
        one, two = np.median(np.abs(np.diff(v))), np.median(np.abs(v[2:] - v[:-2]))
        phi = (two / one) ** 2 - 1
        assert abs(phi - {"smooth": 0.8, "rough": 0.0}[c]) < 0.1
    assert S.flagged(frame, S.LIMITS).count() < 10


def test_steps_over_partition_and_batch_borders():
    import pyarrow as pa

    values = [1.0, 4.0, 9.0, 16.0, 25.0, 36.0, 5.0, 6.0]
    session = ["a"] * 6 + ["b"] * 2
    for cuts in ([8], [1, 1, 1, 1, 1, 1, 1, 1], [3, 5], [7, 1], [1, 7]):
        batches, at = [], 0
        for n in cuts:
            part = slice(at, at + n)
            batches.append(pa.RecordBatch.from_pydict({"source_table": ["t"] * n, "field_name": ["f"] * n, "camera_id": ["c"] * n, "session_id": session[part], "value": values[part]}))
            at += n
        got = pa.Table.from_batches(S._with_steps(iter(batches))).to_pydict()
        assert got["step"] == [None, 3.0, 5.0, 7.0, 9.0, 11.0, None, 1.0] and got["step2"] == [None, None, 8.0, 12.0, 16.0, 20.0, None, None]
        assert got["edge"] == [True, True, False, False, False, False, True, True] and got["value"] == values


def test_repeated_and_null_rows(spark):
    rows = [(1, "c", "s", START, 5.0, "x"), (1, "c", "s", START, 5.0, "x"), (None, "c", "s", START, 9.0, "x"), (2, None, None, START, None, "x"), (3, None, None, None, 7.0, "x")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "metric_id long, camera_id string, session_id string, at timestamp, v double, row_id string")
    got = S.readings(df, "t", "v", "metric_id", F.col("at")).collect()
    assert sorted((r.row_id, r.camera_id, r.value) for r in got) == [(1, "c", 5.0), (3, "", 7.0)]


def _shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_little_is_shuffled_and_kept(spark):
    from pyspark.sql import functions as F

    from vigil.session import Scratch

    n = 60_000
    at = F.timestamp_micros(F.lit(1_609_459_200_000_000) + (F.col("id") / 50).cast("long") * 5_000_000 + (F.rand(1) * 1e6).cast("long"))
    status = spark.range(n, numPartitions=4).select(
        ((F.col("id") * 7919) % n).alias("status_id"), F.concat(F.lit("press_cam_"), F.col("id") % 10).alias("camera_id"), F.format_string("ses%09d", F.col("id") % 50).alias("session_id"),
        F.lit("running").alias("state"), at.alias("received_at"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("updated_at_utc"),
        F.round(F.randn(2) * 0.3 + 10, 3).alias("processing_fps"), (F.col("id") / 50).cast("long").alias("frames_dropped"), (F.col("id") / 25).cast("long").alias("frames_received"),
    )
    metrics = spark.createDataFrame([], "metric_id long, camera_id string, session_id string, snapshot_at timestamp, reported_source_fps double")
    scratch, before = Scratch(spark), _shuffled(spark)
    S.flagged(S.camera_readings(status, metrics), S.LIMITS, scratch)
    kept = sum(os.path.getsize(os.path.join(d, f)) for p in scratch.paths.values() for d, _, names in os.walk(p.removeprefix("file:")) for f in names)
    assert (_shuffled(spark) - before + kept) / (2 * n) < 75
