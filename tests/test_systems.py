"""Cells and assembled scores of small systems that are written out by hand."""

import pytest
from pyspark.sql import functions as F

from tonelake.operators import systems as s

KINDS = {"staves": s.STAVES, "barlines": s.BARLINES, "events": s.EVENTS, "heads": s.HEADS, "slashes": s.SLASHES, "rests": s.RESTS, "signatures": s.SIGNATURES, "tuplets": s.TUPLETS}


def staff(system, part=0, right=500.0, clef="treble", found=True, lower=False, eight=False, fifths=0, top=None, bottom=None, sign=False, blurred=False):
    return (1, system // 2, system, part, 100.0, right, 10.0, clef, found, lower, eight, fifths, top, bottom, sign, blurred)


def tables(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), schema) for k, schema in KINDS.items()}


def laid(t):
    return s.lay_out(*(t[k] for k in ("staves", "barlines", "events", "slashes", "rests", "signatures", "tuplets")))


def notes(system, xs, ticks=480, part=0, first=0, step=0, **more):
    """Events and heads of quarter notes at ``xs``."""
    events = [(1, system, part, first + i, float(x), False, False, ticks, 1.0) for i, x in enumerate(xs)]
    heads = [(1, system, part, first + i, first + i, float(x), step, more.get("accidental"), False, more.get("out", False) and i == len(xs) - 1, ticks, 1.0) for i, x in enumerate(xs)]
    return events, heads


def test_cells(spark):
    bars = [(1, 0, 0, x) for x in (200.0, 300.0, 400.0, 500.0)]
    events = notes(0, [110, 130, 150, 170])[0] + [(1, 0, 0, 9, 350.0, True, False, 480, 1.0)]
    t = tables(spark, staves=[staff(0)], barlines=bars, events=events, slashes=[(1, 0, 0, x) for x in (310.0, 330.0, 350.0)], rests=[(1, 0, 0, 230.0, 270.0, 5)])
    got = [tuple(r) for r in laid(t).cells.select("cell", "bar", "bars_here", "slash", "slash_count").orderBy("cell").collect()]
    # A rest of five measures, slashes beside a rest (no count of beats), an empty bar, nothing after the closing barline.
    assert got == [(0, 0, 1, False, 0), (1, 1, 5, False, 0), (2, 6, 1, True, 0), (3, 7, 1, False, 0)]
    assert {r["event_ord"]: r["bar"] for r in laid(t).events.collect()} == {0: 0, 1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("heads, sign, kept", [(0, False, False), (1, False, True), (2, True, False), (4, True, True)])
def test_last_cell(spark, heads, sign, kept):
    """After the last barline a bar with notes stays, a narrow courtesy signature goes, even if some of it was read as heads."""
    events = notes(0, [120, 250])[0] + notes(0, [415 + 10 * i for i in range(heads)], first=5)[0]
    signs = [(1, 0, 0, 410.0, 430.0, 2, 3, 4, False, None, False)] if sign else []
    t = tables(spark, staves=[staff(0, right=450.0)], barlines=[(1, 0, 0, x) for x in (200.0, 300.0, 400.0)], events=events, signatures=signs)
    out = laid(t)
    assert (out.cells.where("cell = 3").count() == 1) == kept
    if sign:
        assert [(r["bar"], r["numerator"]) for r in out.changes.collect()] == [(3, 3)]


def test_rests_of_signatures_and_triplets(spark):
    events = notes(0, [120, 140, 160])[0] + [(1, 0, 0, 7, 262.0, True, False, 240, 1.0), (1, 0, 0, 8, 290.0, True, False, 240, 1.0)]
    t = tables(spark, staves=[staff(0, right=300.0)], barlines=[(1, 0, 0, 200.0), (1, 0, 0, 300.0)], events=events, signatures=[(1, 0, 0, 255.0, 265.0, 0, None, None, False, 2, False)], tuplets=[(1, 0, 0, 118.0, 142.0, 3)])
    assert {r["event_ord"]: (r["bar"], r["triplet"]) for r in laid(t).events.collect()} == {0: (0, True), 1: (0, True), 2: (0, False), 8: (1, False)}


def test_a_score_over_systems(spark):
    """3/4 announced at a line's end, a key that one system alone shows, a clef that is not found again, a tie over the line."""
    e0, h0 = notes(0, [110, 130, 150, 170], out=True, step=1)
    e1, h1 = notes(1, [110, 130, 150], first=10, step=1)
    e2, h2 = notes(2, [110, 130, 150], first=20)
    t = tables(
        spark, staves=[staff(0, clef="bass", top=4, bottom=4), staff(1, found=False), staff(2, clef="bass", fifths=3)], barlines=[(1, k, 0, x) for k in range(3) for x in (200.0, 500.0)],
        events=e0 + e1 + e2, heads=h0 + h1 + h2, signatures=[(1, 0, 0, 470.0, 480.0, 1, 3, 4, False, None, False)],
    )
    got = s.assemble(**t)
    assert [tuple(r) for r in got.time_signatures.orderBy("tick").collect()] == [(1, 0, 4, 4), (1, 3840, 3, 4)]
    assert [tuple(r) for r in got.key_signatures.collect()] == [(1, 0, 0)]
    rows = [tuple(r) for r in got.notes.orderBy("head_ord").select("head_ord", "pitch", "start_tick", "duration", "tied").collect()]
    # Bass clef, the space over the middle line: E3; carried to the second system.
    assert rows[:5] == [(0, 52, 0, 480, False), (1, 52, 480, 480, False), (2, 52, 960, 480, False), (3, 52, 1440, 480, False), (10, 52, 3840, 480, True)]
    assert [r[:3] for r in rows[5:]] == [(11, 52, 4320), (12, 52, 4800), (20, 50, 6720), (21, 50, 7200), (22, 50, 7680)]
    text = [r["text"] for r in got.warnings.orderBy("ord").collect()]
    assert "Page 1: no clef was found on at least one staff." in text


def test_lower_staff_and_guitar(spark):
    e, h = zip(*(notes(0, [110, 130], ticks=960, part=p, first=10 * p) for p in (0, 1)))
    for lower, guitar, want in ((True, False, {0: 71, 1: 50}), (False, True, {0: 71, 1: 50})):
        t = tables(spark, staves=[staff(0), staff(0, 1, clef="bass", lower=lower)], barlines=[(1, 0, p, 500.0) for p in (0, 1)], events=e[0] + e[1], heads=h[0] + h[1])
        assert {r["part"]: r["pitch"] for r in s.assemble(**t, guitar=guitar).notes.collect()} == want
    t = tables(spark, staves=[staff(0)], barlines=[(1, 0, 0, 500.0)], events=e[0], heads=h[0])
    assert {r["pitch"] for r in s.assemble(**t, guitar=True).notes.collect()} == {59}


def test_chord_words(spark):
    t = tables(spark, staves=[staff(0)], barlines=[(1, 0, 0, 200.0), (1, 0, 0, 500.0)], events=notes(0, [110])[0], rests=[(1, 0, 0, 300.0, 400.0, 3)])
    cells = laid(t)
    systems = s.keys(s.system_rows(t["staves"], cells))
    none = spark.createDataFrame([], "score_id long, system int, numerator int, denominator int, bars long, total long, low_confidence boolean")
    rows = s.measures(systems, cells, none)
    labels = spark.createDataFrame([(1, 0, 155.0, 150.0, "Am", 0.5), (1, 0, 152.0, 150.0, "A", 0.4), (1, 0, 240.0, 210.0, "G", 0.9), (1, 0, 420.0, 400.0, "C7", 0.9)], s.LABELS)
    got = sorted((r["tick"], r["text"]) for r in s.place_chords(labels, t["staves"], cells, rows).collect())
    assert got == [(960, "Am"), (1920, "G"), (5760, "C7")]


def test_empty(spark):
    got = s.assemble(**tables(spark))
    assert [f.count() for f in (got.notes, got.measures, got.time_signatures, got.key_signatures, got.slash_measures, got.warnings)] == [0] * 6
    only = s.assemble(**tables(spark, staves=[staff(0), staff(1)]))
    assert only.measures.count() == 2 and only.warnings.where(F.col("text").startswith("No notes")).count() == 1
