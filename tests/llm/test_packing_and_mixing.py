"""Containers: all items once, none over capacity, little room left.  Mixtures: shares, repeats, distinct blocks."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import mixing, packing
from vigil.session import Scratch


def _pack(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "item_id long, size long, container_id string")
    return packing.pack(df, "item_id", "size", capacity).collect()


def test_everything_is_packed_once(spark, monkeypatch):
    rng = random.Random(1)
    sizes = [rng.choice([rng.randint(1, 60), rng.randint(60, 512), rng.randint(500, 3000), 512, 0]) for _ in range(3000)] + [None]
    for shard in (40_000, 300):
        monkeypatch.setattr(packing, "SHARD", shard)
        rows = _pack(spark, sizes, 512)
        held, parts = Counter(), {}
        for r in rows:
            if r.container_id is not None:
                held[r.container_id] += r.n_tokens
            parts.setdefault(r.item_id, []).append((r.token_start, r.n_tokens))
        assert max(held.values()) <= 512
        for i, s in enumerate(sizes):
            got = sorted(parts[i])
            assert sum(n for _, n in got) == (s or 0) and [a for a, _ in got] == [512 * k for k in range(len(got))]
            assert len(got) == 1 or s > 512
        used = sum(s or 0 for s in sizes)
        assert used / (512 * len(held)) > 0.97


def test_few_and_equal_items(spark):
    assert _pack(spark, [], 100) == []
    assert {r.container_id for r in _pack(spark, [0, None], 100)} == {None}
    assert len({r.container_id for r in _pack(spark, [50] * 10, 100)}) == 5
    assert len({r.container_id for r in _pack(spark, [51] * 4, 100)}) == 4
    assert len({r.container_id for r in _pack(spark, [1] * 100, 100)}) == 1


def test_configurations_meet_demand():
    rng = random.Random(2)
    for _ in range(20):
        sizes = sorted(rng.sample(range(13, 100), 12))
        demand = [rng.randint(1, 400) for _ in sizes]
        plan = packing.configurations(sizes, demand, 100)
        assert [sum(c[g] * n for c, n in plan) for g in range(12)] == demand
        assert all(sum(a * s for a, s in zip(c, sizes)) <= 100 for c, _ in plan)
        least = sum(s * d for s, d in zip(sizes, demand)) / 100
        assert sum(n for _, n in plan) >= least


def test_permutation():
    for n in (1, 2, 3, 100, 1025):
        for key in (0, 5):
            assert sorted(mixing.permuted(np.arange(n), n, np.uint64(key)).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, np.uint64(1)).tolist() != mixing.permuted(np.arange(1000), 1000, np.uint64(2)).tolist()


def _documents(spark):
    rng = random.Random(4)
    rows = [(i, s, rng.randint(1, 900)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["tiny"] * 150 + ["other"] * 50 + [None] * 5)] + [(9000, "mid", 0), (9001, "mid", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


WANTED = [mixing.Target("big", 0.5, 1), mixing.Target("mid", 0.3, 2), mixing.Target("tiny", 0.2, 4), mixing.Target("absent", 0.1, 3)]


def test_mixture(spark):
    docs = _documents(spark)
    m = mixing.mix(docs, WANTED, Scratch(spark))
    report = {r.source: r for r in m.report.collect()}
    assert report["absent"].n_tokens == 0 and report["absent"].share == 0
    for s in ("big", "mid", "tiny"):
        assert abs(report[s].share - report[s].feasible_share) < 0.03 and report[s].repeats <= report[s].max_repeats
    rows = m.drawn.collect()
    slots = Counter((r.shard, r.slot, r["pass"], r.source, r.block) for r in rows)
    assert len({(a, b) for a, b, *_ in slots}) == len(slots)  # a slot holds one block
    assert len({(p, s, b) for _, _, p, s, b in slots}) == len(slots)  # a block occurs once a pass
    sizes = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert all(0 <= r.token_start < r.token_end <= sizes[r.doc_id] for r in rows)
    per = Counter()
    for r in rows:
        per[r.shard, r.slot] += r.token_end - r.token_start
    assert max(per.values()) == mixing.BLOCK and sorted(per.values())[5] == mixing.BLOCK
    assert all(r.repeats <= 4 for r in mixing.by_document(m.drawn).collect())
    again = mixing.mix(docs.repartition(7), WANTED, Scratch(spark))
    key = lambda r: (r.shard, r.slot, r.source, r.block, r.doc_id, r.token_start)
    assert sorted(map(key, again.drawn.collect())) == sorted(map(key, rows))


def test_scarce_source_does_not_hold_the_total(spark):
    docs = _documents(spark)
    wanted = [mixing.Target("big", 0.6, 1), mixing.Target("mid", 0.395, 4), mixing.Target("other", 0.005, 1)]
    m = mixing.mix(docs, wanted, Scratch(spark), total_tokens=1_000_000)
    report = {r.source: r for r in m.report.collect()}
    other, mid, big = (report[s] for s in ("other", "mid", "big"))
    other_tokens = other.available_tokens
    assert mid.n_tokens + big.n_tokens + other.n_tokens > 999_000 and 0 < other.n_tokens <= other_tokens
    wanted = [mixing.Target("big", 0.6, 1), mixing.Target("mid", 0.35, 4), mixing.Target("other", 0.05, 1)]
    m = mixing.mix(docs, wanted, Scratch(spark), total_tokens=1_000_000)
    report = {r.source: r for r in m.report.collect()}
    other, mid, big = (report[s] for s in ("other", "mid", "big"))
    assert other.n_tokens == other.available_tokens  # up to its repeats, not a block less
    assert abs((big.share - 0.6) - (mid.share - 0.35)) < 0.001 and big.share > 0.6  # what it leaves is spread evenly
    assert abs(other.shortfall - (0.05 - other.share)) < 1e-12 and other.shortfall > 0.01 and big.shortfall == mid.shortfall == 0
    every = m.drawn.where("source = 'other'").groupBy("block", "doc_id", "token_start").agg(F.count_distinct("pass").alias("n")).collect()
    assert {r.n for r in every} == {1}


def test_total_is_the_largest_within_the_tolerance(spark):
    docs = _documents(spark)
    wanted = [mixing.Target("big", 0.6, 1), mixing.Target("mid", 0.35, 4), mixing.Target("other", 0.05, 1)]
    for tolerance in (0.005, 0.02):
        report = {r.source: r for r in mixing.mix(docs, wanted, Scratch(spark), tolerance=tolerance).report.collect()}
        over = [report[s].share - report[s].target_share for s in ("big", "mid")]
        assert max(over) < tolerance + 0.002 and min(over) > tolerance - 0.002 and report["other"].n_tokens == report["other"].available_tokens


def test_no_slot_is_lost(spark):
    m = mixing.mix(_documents(spark), WANTED, Scratch(spark), total_tokens=10**9)  # all that the sources can serve
    report = {r.source: r for r in m.report.collect()}
    assert sum(r.slots_moved for r in report.values()) == 0 and any(r.slots_moved for r in report.values())
    assert all(r.n_tokens == r.available_tokens * r.max_repeats and r.repeats == r.max_repeats for r in report.values() if r.available_tokens)
    got = sorted((r.shard, r.slot) for r in m.drawn.select("shard", "slot").distinct().collect())
    assert got == [(i // mixing.SHARD, i % mixing.SHARD) for i in range(len(got))]  # neither in a shard nor in the last one


def test_slots_by_source():
    share, most = {"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 6000, "b": 9000, "c": 7}
    assert mixing.slots_by_source(share, most, 50) == {"a": 30, "b": 15, "c": 5}
    assert mixing.slots_by_source(share, most, 97) == {"a": 59, "b": 31, "c": 7} or mixing.slots_by_source(share, most, 97) == {"a": 60, "b": 30, "c": 7}
    assert mixing.slots_by_source(share, most, 1_000) == {"a": 647, "b": 346, "c": 7} or mixing.slots_by_source(share, most, 1_000) == {"a": 646, "b": 347, "c": 7}
    assert mixing.slots_by_source(share, most, 99_999) == most
    best = mixing.slots_by_source(share, most, tolerance=0.01)
    total = sum(best.values())
    assert best["c"] == 7 and all(best[s] <= (share[s] + 0.01) * total + 1 for s in share) and total == int(7 / (0.1 - 0.02))
    assert mixing.slots_by_source({"a": 0.5}, {"a": 10}) == {"a": 10}  # the rest has no source at all
    assert mixing.slots_by_source({}, {}) == {}


def test_total_and_empty(spark):
    docs = _documents(spark)
    small = mixing.mix(docs, WANTED, Scratch(spark), total_tokens=20_000)
    assert sum(r.n_tokens for r in small.report.collect()) <= 20_000 + mixing.BLOCK
    none = mixing.mix(docs.limit(0), WANTED, Scratch(spark))
    assert none.drawn.count() == 0 and {r.share for r in none.report.collect()} == {0.0}


def test_targets(spark):
    df = spark.createDataFrame([("Camera Log", 0.5, 1), ("camera-log ", 0.1, 2), (None, 0.3, 1), ("x", None, 1), ("y", 0.2, None)], "source string, target_share double, max_repeats int")
    assert mixing.targets(df) == [mixing.Target("camera_log", 0.6, 2), mixing.Target("y", 0.2, 0)]
