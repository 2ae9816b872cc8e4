"""Shortcuts of page reading against the plain way, and pages that are drawn and read in one step."""

import numpy as np
import pandas as pd
import pytest

from tonelake.operators import glyphs, omr, tuplets, words
from tonelake.plans import q_pages, q_tuplets, q_words, registry

SF = "/root/testdata/sf0.001"


def page(score=3, n=20):
    rng = np.random.default_rng(score)
    k = np.arange(n)
    return q_pages.draw({"score_id": score, "staff": k // 8, "slot": k % 8, "kind": rng.integers(0, 9, n), "step": rng.integers(-1, 2, n) * 2, "arc": np.zeros(n, bool)})


@pytest.mark.parametrize("name", ["c11_systems_of_staves", "c12_symbols", "c13_ties", "c14_word_boxes", "c31_tuplets"])
def test_no_table_of_pixels_is_moved(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and "rgba" not in plan


def test_pages_read_from_a_table_give_the_same(spark):
    direct = glyphs.barlines(q_pages.dealt(q_pages.drawn(spark, SF)), q_pages.draw).collect()
    assert sorted(map(tuple, glyphs.barlines(q_pages.pages(spark, SF)).collect())) == sorted(map(tuple, direct)) != []


def test_black_and_white_needs_no_threshold(monkeypatch):
    a = page()
    want, rng = omr.binary(omr.grey(a)), np.random.default_rng(0)
    others = [a.copy() for _ in range(4)]
    others[0][5, 5, 1] = 7  # nearly black
    others[1][:30, :, 3] = 0  # seen through, on white
    others[2][...] = [0, 0, 0, 255]
    others[3] = rng.integers(0, 256, a.shape).astype(np.uint8)
    for b in others:
        assert (omr.ink_of(b) == omr.binary(omr.grey(b))).all()
    monkeypatch.setattr(omr, "grey", None)
    assert (omr.ink_of(a) == want).all()


def sharp(ink, deg):
    y, x = np.nonzero(ink)
    a = np.deg2rad(deg)
    rows = np.floor(-(x - ink.shape[1] / 2) * np.sin(a) + (y - ink.shape[0] / 2) * np.cos(a) + 0.5).astype(int)
    return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())


def pages_of_ink():
    ink = omr.ink_of(page())
    rng = np.random.default_rng(1)
    return [ink, omr.rotated(ink, np.deg2rad(1.3)), omr.rotated(ink, np.deg2rad(-0.2)), rng.random((333, 217)) < 0.1, rng.random((64, 500)) < 0.4]


def test_bounds_hold_at_every_angle():
    for ink in pages_of_ink():
        counts = omr.column_counts(ink)
        sums = np.concatenate([np.zeros((1, len(counts)), np.int32), counts.T.cumsum(0, dtype=np.int32)])
        for deg in (*omr.COARSE.tolist(), *omr.FINE.tolist(), 3.5, -3.5):
            assert not omr._below(sums, ink.shape[1], deg, sharp(ink, deg))  # nothing is told to be less than itself
    assert omr._stands(pages_of_ink()[0]) and not omr._stands(pages_of_ink()[1])


def test_skew_is_what_all_angles_give(monkeypatch):
    got = [omr.skew(ink) for ink in pages_of_ink()]
    monkeypatch.setattr(omr, "_stands", lambda ink: False)
    assert got == [omr.skew(ink) for ink in pages_of_ink()] and got[1] != 0 != got[2]


def test_runs_down_columns():
    for ink in pages_of_ink():
        for a, b in zip(omr.column_runs(ink), omr.row_runs(ink.T)):
            assert (a == b).all()


def test_lines_are_taken_out_row_by_row():
    for ink in pages_of_ink()[:3]:
        for staff in omr.staves(ink):
            want, most = ink.copy(), staff.thick * 1.6 + 1
            for y in staff.lines:
                top, bottom = max(0, int(y - staff.space / 2)), min(len(ink), int(y + staff.space / 2) + 1)
                for x in range(staff.left, staff.right):
                    for a, b in omr.runs(ink[top:bottom, x]):
                        if b - a <= most and a + top <= y + 1.5 and b + top >= y - 0.5:
                            want[top + a : top + b, x] = False
            assert (omr.without_lines(ink, staff) == want).all()


def test_drawing_takes_tables_and_arrays():
    rows = {"score_id": 1, "note_ord": np.arange(12), "step": np.arange(12) % 3 - 1, "kind": np.repeat([0, 1, 2, 5], 3), "whole": np.ones(12, bool), "up": np.zeros(12, bool), "slope": np.full(12, 0.03)}
    assert (q_tuplets.draw(rows) == q_tuplets.draw(pd.DataFrame(rows))).all()
    drawn = {"score_id": 1, "staff": np.zeros(8, int), "slot": np.arange(8), "kind": np.arange(8), "shift": np.arange(8), "drop": np.arange(8) % 4}
    assert (q_words.draw(drawn) == q_words.draw(pd.DataFrame(drawn))).all()


def test_letters_are_judged_once(monkeypatch):
    a = q_words.draw({"score_id": 1, "staff": np.zeros(8, int), "slot": np.arange(8), "kind": np.arange(8), "shift": np.arange(8), "drop": np.arange(8) % 4})
    want = words.read_words(a)
    monkeypatch.setattr(np, "polyfit", None)
    assert words.read_words(a) == want != []


def test_components_against_flooding():
    rng = np.random.default_rng(2)
    for fill in (0.05, 0.3, 0.45, 0.7):
        ink = rng.random((23, 31)) < fill
        left, want = {tuple(p) for p in np.argwhere(ink).tolist()}, []
        while left:
            todo, piece = [left.pop()], []
            while todo:
                y, x = todo.pop()
                piece.append((y, x))
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            ys, xs = zip(*piece)
            want.append((min(xs), max(xs) + 1, min(ys), max(ys) + 1, len(piece)))
        assert sorted(tuple(c[k] for k in ("x0", "x1", "y0", "y1", "area")) for c in omr.components(ink)) == sorted(want)
    assert omr.components(np.zeros((4, 5), bool)) == omr.components(np.zeros((0, 5), bool)) == []


def test_symbols_are_judged_once(monkeypatch):
    a = page()
    want = glyphs.read_symbols(a)
    monkeypatch.setattr(glyphs, "features", None)
    assert glyphs.read_symbols(a) == want != []


def test_no_path_is_sought_without_ink(monkeypatch):
    bare = q_pages.draw({"score_id": 3, "staff": np.arange(20) // 8, "slot": np.arange(20) % 8, "kind": np.full(20, 4), "step": np.arange(20) % 3 * 2 - 2, "arc": np.zeros(20, bool)})  # heads with dots
    tied = q_pages.draw({"score_id": 3, "staff": np.zeros(3, int), "slot": np.arange(3), "kind": np.zeros(3, int), "step": np.zeros(3, int), "arc": np.array([True, True, False])})
    seek, sought = glyphs.path_between, []
    monkeypatch.setattr(glyphs, "path_between", lambda *a: sought.append(a) or seek(*a))
    assert [r[7] for r in glyphs.read_symbols(bare) if r[3] == "solid"] == [False] * 20 and not sought
    assert [r[7] for r in glyphs.read_symbols(tied) if r[3] == "solid"] == [False, True, True] and sought


def test_lines_are_fitted_once(monkeypatch):
    rows = {"score_id": 1, "note_ord": np.arange(18), "step": np.arange(18) % 3 - 1, "kind": np.repeat([0, 2, 3, 5, 1, 4], 3), "whole": np.ones(18, bool), "up": np.arange(18) > 8, "slope": np.full(18, 0.03)}
    a = q_tuplets.draw(rows)
    want = tuplets.read_tuplets(a)
    assert {r[5] for r in want} == {3, 5, None}
    monkeypatch.setattr(np, "polyfit", None)
    assert tuplets.read_tuplets(a) == want


def test_strokes_hold_only_thin_ink():
    ink = np.zeros((60, 120), bool)
    ink[20:22, 10:60] = ink[20:22, 80:110] = True  # a stroke with a gap
    ink[40:48, 10:110] = True  # a beam
    ink[0:2, 5:100] = True  # at the edge
    found = tuplets.strokes(ink, 10.0)
    assert [(s["x0"], s["x1"], s["gaps"]) for s in found] == [(5, 100, []), (10, 110, [(60, 80)])]


def test_bars_of_tuplets_move_no_pixels(spark):
    plan = registry.queries()["c31_tuplets_fit_bars"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") >= 1 and "rgba" not in plan
