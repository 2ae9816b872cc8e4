"""Tuplets on drawn pages, digits and strokes, against what was drawn."""

import numpy as np
import pandas as pd
import pytest

from tonelake.operators import tuplets
from tonelake.plans import q_tuplets


def page(groups):
    """Rows ``(step, kind, up, slope)`` of three heads each."""
    return q_tuplets.draw(pd.DataFrame([(o, groups[o // 3][0], groups[o // 3][1], True, groups[o // 3][2], groups[o // 3][3]) for o in range(3 * len(groups))], columns=["note_ord", "step", "kind", "whole", "up", "slope"]))


@pytest.mark.parametrize("n", tuplets.DIGITS)
@pytest.mark.parametrize("space", [7, 9, 10, 13, 18])
def test_digits_at_any_size(n, space):
    assert tuplets.digit(tuplets.drawn_digit(n, space)) == n


def test_no_digit():
    assert tuplets.digit(np.ones((14, 10), bool)) is None
    accent = np.zeros((12, 14), bool)  # an accent, whose only point is in the middle
    for x in range(14):
        y = int(6 - (13 - x) * 0.4)
        accent[max(0, y) : y + 2, x] = accent[11 - y - 1 : 12 - max(0, y), x] = True
    assert tuplets.digit(accent) != 3


def test_strokes_of_any_slope():
    for slope in (-0.15, -0.06, 0.0, 0.03, 0.11, 0.18):
        a = np.zeros((90, 200), bool)
        for x in range(30, 150):
            if not 80 <= x < 100:
                y = int(round(40 + slope * (x - 90)))
                a[y : y + 2, x] = True
        a[60:70, 20:180] = True  # a beam is too thick
        (s,) = tuplets.strokes(a, 10)
        assert (s["x0"], s["x1"], s["gaps"]) == (30, 150, [(80, 100)]) and abs(s["slope"] - slope) < 0.01
    assert tuplets.strokes(np.zeros((50, 50), bool), 10) == []
    assert tuplets.strokes(np.zeros((0, 0), bool), 10) == []


def test_hooks():
    a = np.zeros((60, 100), bool)
    a[30:32, 10:90] = True
    stroke = tuplets.strokes(a, 10)[0]
    assert tuplets.hook(a, stroke, 10) == 0
    a[30:38, 10:12] = True
    assert tuplets.hook(a, stroke, 10) == 0  # one end alone
    down = a.copy()
    down[30:38, 88:90] = True
    assert tuplets.hook(down, stroke, 10) == 1
    a[24:32, 88:90] = True
    assert tuplets.hook(a, stroke, 10) == 0  # one down, one up


@pytest.mark.parametrize("up", [True, False])
def test_every_kind_of_group(up):
    got = tuplets.read_tuplets(page([(0, kind, up, 0.03) for kind in range(7)]))
    want = {0: (False, 3, "bracket"), 1: (True, 3, "bare"), 2: (False, None, None), 3: (False, 5, "bracket"), 4: (True, None, None), 5: (True, 3, "bracket"), 6: (True, None, None)}
    assert [(r[4], r[5], r[6]) for r in got] == [want[k] for k in range(7) for _ in range(3)]
    # Tuplets of a staff are counted from the left.
    assert [r[7] for r in got if r[0] == 0 and r[7] is not None] == [0, 0, 0, 1, 1, 1]


def test_a_bracket_belongs_to_the_staff_its_hooks_point_to():
    """Brackets under one staff and over the next, in one gap."""
    got = tuplets.read_tuplets(page([(0, 0, False, 0.0)] * 3 + [(0, 3, True, 0.0)] * 3))
    assert [r[5] for r in got] == [3] * 9 + [5] * 9


def test_a_bare_digit_needs_three_beamed_heads():
    a = page([(0, 4, True, 0.0), (0, 2, True, 0.0)])
    a[:] = np.where((a == 0).all(2)[..., None], a, 255)
    ink = np.zeros(a.shape[:2], bool)
    shape = tuplets.drawn_digit(3, 10)
    # Beyond three heads that are not beamed, nothing; far above those that are, nothing.
    for x, y in ((q_tuplets.FIRST + 4 * q_tuplets.WIDE + q_tuplets.BETWEEN, 60), (q_tuplets.FIRST + q_tuplets.WIDE, 40)):
        ink[y : y + shape.shape[0], x : x + shape.shape[1]] |= shape
    a[ink, :3] = 0
    assert all(r[5] is None for r in tuplets.read_tuplets(a) if r[1] < 3)


def test_pages_without_staves(spark):
    white = np.full((120, 90, 4), 255, np.uint8)
    pages = spark.createDataFrame([(1, 0, 90, 120, bytearray(white.tobytes()))], "score_id long, page int, width int, height int, rgba binary")
    assert tuplets.tuplets(pages).collect() == []
    assert tuplets.tuplets(pages.limit(0)).collect() == []
