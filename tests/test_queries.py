"""Every query runs, and gives its oracle's rows."""

import math

import duckdb
import pytest

from tonelake.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def shown(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    r = con.execute(ORACLES[name])
    columns = sorted(x[0] for x in r.description)
    order = [[x[0] for x in r.description].index(c) for c in columns]
    want = sorted(repr(tuple(shown(x[i]) for i in order)) for x in r.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(shown(x[c]) for c in columns)) for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_video_sync():
    from tonelake.streaming.sync import Sync, nearest_rate

    s = Sync(start=10.0)
    assert s.on_transport(0, "play", 0.0, False) == [("video_seek", 10.0), ("video_play", None)]
    assert s.on_video(0.1, "playing", 10.0, False) == []  # our own echo
    assert s.on_tick(5, 15.1, "playing", 5.0, True) == []  # no drift to speak of
    assert s.on_tick(6, 16.5, "playing", 6.0, True) == [("video_seek", 16.0)]
    assert s.on_tick(9, 30.0, "playing", 9.0, True) == [("transport_seek", 20.0)]
    assert s.on_transport(9.1, "seek", 20.0, True) == []
    assert s.on_video(20, "paused", 31.0, True) == [("transport_pause", None)]
    early = Sync(start=10.0)
    assert early.on_video(0, "playing", 2.0, False) == [("transport_seek", 0.0)] and early.parked
    assert early.on_tick(9, 10.5, "playing", 0.0, False) == [("transport_play", 0.5)] and not early.parked
    assert Sync.load(s.dump()) == s and nearest_rate([0.5, 1, 1.5], 1.25) == 1
