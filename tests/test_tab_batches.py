"""Fingering takes many scores in one Arrow batch, and no data frame a score."""

import io
from contextlib import redirect_stdout

from tonelake.operators.tab import assign_tab


def test_scores_share_batches(spark):
    notes = spark.createDataFrame([(s, k % 2, k, 40 + (s + 3 * k) % 40, 240 * k, 240) for s in range(50) for k in range(12)], "score_id long, track_ord long, note_ord long, pitch long, start_tick long, duration long")
    bars = spark.createDataFrame([(s, 0, 0.0, 1920.0) for s in range(50)], "score_id long, index long, start_tick double, end_tick double")
    got = assign_tab(notes, bars)
    shown = io.StringIO()
    with redirect_stdout(shown):
        got.explain()
    assert "FlatMapGroupsInPandas" not in shown.getvalue()
    rows = got.collect()
    assert len(rows) == 600 and all(r["string"] is not None for r in rows)
    assert sum(r["warnings"] is not None for r in rows) == 50
