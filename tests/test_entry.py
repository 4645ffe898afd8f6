"""The registered queries: names, oracles, and the flagship over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    assert {"p2_found", "p5_found"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(entry.SMALL), reason="no test tables")
def test_flagship_agrees_with_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    got = sorted((r.camera_id, r.track_id, r.zone_id, r.frame_number) for r in entry.entry(spark).collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{entry.SMALL}/events.parquet'")
    want = con.execute(f"select camera_id, track_id, zone_id, frame_number from ({entry.oracle_sql()['bar_001_restricted_entry']})").fetchall()
    assert got == sorted(want) and got
