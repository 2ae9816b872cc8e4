"""Measures that fingering's warnings name, found by joins, against a plain count of barlines."""

from bisect import bisect_right

import pytest

from tonelake.operators import tab

NOTES = "score_id long, track_ord int, note_ord int, pitch int, start_tick long, duration long, measure int"


@pytest.mark.parametrize("ends", [[], [1920.0], [960.0, 960.0, 2880.5, 20000.0, 20001.0], [float(480 * k) for k in range(1, 60)]])
def test_measures_in_warnings(spark, ends):
    # Pitches out of range, so every note is warned of; columns with the names used inside do not matter.
    ticks = [-5, 0, 479, 480, 959, 960, 2880, 2881, 7680, 19999, 20000, 99999]
    notes = spark.createDataFrame([(2**53 + 1, 0, k, 20, t, 240, 7) for k, t in enumerate(ticks)], NOTES)
    bars = spark.createDataFrame([(2**53 + 1, e) for e in ends], "score_id long, end_tick double")
    rows = tab.assign_tab(notes, bars).orderBy("note_ord").collect()
    assert [r["pitch"] for r in rows] == [44] * len(ticks)
    want = list(dict.fromkeys(f"Note G#0 at measure {min(bisect_right(ends, t) + 1, max(1, len(ends)))} transposed up 2 octaves" for t in ticks))
    assert rows[0]["warnings"] == want
