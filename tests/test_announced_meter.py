"""Long assembled scores: a meter that the line before announced is overridden like a printed one, in query and SQL."""

import duckdb

from tonelake.plans import registry


def test_announced_meter_is_overridden(spark, tmp_path):
    events = str(tmp_path / "events.parquet")
    # A score of 25 systems: its 19th is announced as 3/4, and its bars add up to 2/4.
    duckdb.sql(f"copy (select event_id + 100000 * k as event_id, ts, user_id, event_type, value, props from '/root/testdata/sf0.1/events.parquet', (select unnest(range(0, 6)) k) where user_id = 294) to '{events}' (format parquet)")
    got = sorted(tuple(r) for r in registry.queries()["c18_signatures"](spark, str(tmp_path)).select("score_id", "tick", "sign").collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{events}'")
    sql = registry.oracle_sql()["c18_signatures"]
    assert sorted(con.execute(f"select score_id, tick, sign from ({sql})").fetchall()) == got
    assert sum(sign == "2/4" for _, _, sign in got) > 1
