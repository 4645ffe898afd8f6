"""Orphan references: ids in all spellings, deletions, late events, repeats, nulls, empty tables, clashing names."""

from datetime import datetime

from vigil.operators import references as R

D = lambda d: datetime(2021, 1, d)
AUDIT = "audit_id long, event_id string, ingested_at timestamp, ref_key string, n_refs int"
EVENTS = "event_id string, status string, ingested_at timestamp, ref_key int"


def _run(spark, audit, events):
    refs = R.references(spark.createDataFrame(audit, AUDIT), "audit_log", "audit_id", "event_id", "ingested_at")
    alive = R.living(spark.createDataFrame(events, EVENTS), "event_id", "status", "ingested_at")
    total = refs.count()
    orphans = R.orphan_keys(refs, alive, total)
    return refs, orphans, {r.ref_id for r in R.orphan_rows(refs, orphans, total).collect()}


def test_cases(spark):
    events = [("bar_1_ab", "new", D(1), 0), ("bar_2_cd", "new", D(1), 0), ("bar_2_cd", " Deleted", D(2), 0), ("bar_3_ef", "deleted", D(1), 0), ("bar_3_ef", "reviewed", D(3), 0), (None, "new", D(1), 0), ("bar_5_aa", None, None, 0)]
    audit = [
        (1, " BAR-1-AB ", D(1), "x", 0), (2, "bar_2_cd", D(1), "x", 0), (3, "bar_3_ef", D(1), "x", 0), (4, "bar_9_zz", D(2), "x", 0), (4, "bar_9_zz", D(5), "x", 0),
        (5, None, D(1), "x", 0), (6, "   ", D(1), "x", 0), (7, "bar_9_zz", None, "x", 0), (8, "bar_5_aa", D(1), "x", 0), (None, "bar_9_zz", D(1), None, None),
    ]
    refs, orphans, found = _run(spark, audit, events)
    assert found == {2, 4, 7, None}
    report = {(r.ref_period): (r.n_refs, r.n_orphans, r.n_orphan_keys) for r in R.orphan_report(refs, orphans).collect()}
    assert report == {"2021-01": (6, 3, 2), "unknown": (1, 1, 1)}


def test_empty(spark):
    assert _run(spark, [], [])[2] == set()
    assert _run(spark, [(1, "a", D(1), None, None)], [])[2] == {1}


def test_hot_keys_take_the_broadcast_path(spark):
    audit = [(i, "hot" if i % 3 else f"k{i}", D(1 + i % 9), None, None) for i in range(3000)]
    refs = R.references(spark.createDataFrame(audit, AUDIT), "audit_log", "audit_id", "event_id", "ingested_at")
    alive = R.living(spark.createDataFrame([("k3", None, None, 0)], EVENTS), "event_id", "status", "ingested_at")
    hot = spark.createDataFrame([("hot",)], "ref_key string")
    parts = {(r.ref_key, r.ref_period, r.n_refs) for r in R.orphan_keys(refs, alive, 3000, hot).collect()}
    for total in (3000, 10**9):  # every key heavy, none
        assert parts == {(r.ref_key, r.ref_period, r.n_refs) for r in R.orphan_keys(refs, alive, total).collect()}
    assert ("hot", "2021-01", 2000) in parts and not any(k == "k3" for k, _, _ in parts)
