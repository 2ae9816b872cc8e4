"""Reading synthetic engravings."""

import numpy as np
import pytest

from tonelake.operators import omr

TOP, D = 100, 10


class Page:
    def __init__(self, width=640, height=300):
        self.a = np.full((height, width, 4), 255, np.uint8)

    def rect(self, x0, y0, x1, y1, ink=0):
        self.a[int(y0) : int(y1) + 1, int(x0) : int(x1) + 1, :3] = ink

    def oval(self, cx, cy, a, b, ink=0):
        y, x = np.mgrid[0 : self.a.shape[0], 0 : self.a.shape[1]]
        self.a[((x - cx) / a) ** 2 + ((y - cy) / b) ** 2 <= 1, :3] = ink

    def staff(self, bars=(300,)):
        for i in range(5):
            self.rect(40, TOP + D * i, 580, TOP + D * i + 1)
        for x in (*bars, 579):
            self.rect(x, TOP, x + 1, TOP + 41)
        return self

    def note(self, x, step, hollow=False, stem=True, flags=0):
        y = TOP + 20.5 - step * 5
        self.oval(x, y, 6.5, 5)
        if hollow:
            self.oval(x, y, 4.5, 2.8, 255)
        if stem:
            self.rect(x + 5, y - 35, x + 6, y)
            for k in range(flags):
                self.rect(x + 5, y - 35 + k * 8, x + 16, y - 31 + k * 8)


def test_staff_and_bars():
    ink = omr.binary(omr.grey(Page().staff().a))
    (s,) = omr.staves(ink)
    assert s.space == pytest.approx(10, abs=0.3) and s.thick == 2 and s.lines[0] == pytest.approx(100.5, abs=0.6)
    assert [round(x) for x in omr.barlines(ink, s)] == [300, 580] or [round(x) for x in omr.barlines(ink, s)] == [300, 579]
    assert omr.staves(np.zeros((50, 50), bool)) == [] and omr.read_page(np.full((40, 40, 4), 255, np.uint8)) == []


def test_notes_of_a_page():
    p = Page().staff()
    for x, step in ((100, 0), (140, 2), (180, -3), (220, -5)):
        p.note(x, step)
    p.note(350, 1, hollow=True)
    p.note(430, -1, flags=1)
    p.note(480, -1, flags=2)
    got = omr.read_page(p.a)
    assert [(n["pitch"], n["start"], n["duration"]) for n in got] == [(71, 0, 480), (74, 480, 480), (65, 960, 480), (62, 1440, 480), (72, 1920, 960), (69, 2880, 240), (69, 3120, 120)]
    assert [n["pitch"] for n in omr.read_page(p.a, fifths=1)][2] == 66
    assert [n["pitch"] for n in omr.read_page(p.a, octave_down=True)][0] == 59


def test_skew_and_shade():
    p = Page().staff()
    p.note(120, 0)
    ink = omr.rotated(omr.binary(omr.grey(p.a)), np.deg2rad(1.0))
    assert omr.skew(ink) == pytest.approx(np.deg2rad(-1.0), abs=np.deg2rad(0.15))
    shade = np.linspace(1.0, 0.55, p.a.shape[1])[None, :, None]
    dim = p.a.copy()
    dim[..., :3] = (dim[..., :3] * shade).astype(np.uint8)
    assert [n["pitch"] for n in omr.read_page(dim)] == [71]


def test_components_and_otsu():
    a = np.zeros((6, 6), bool)
    a[0, 0] = a[1, 1] = a[4, 4] = True
    assert sorted(c["area"] for c in omr.components(a)) == [1, 2]
    g = np.array([[10] * 5 + [200] * 5], np.uint8)
    assert 10 <= omr.otsu(g) < 200


def test_recognise(spark):
    p = Page().staff()
    p.note(100, 0)
    rows = [(7, 0, p.a.shape[1], p.a.shape[0], bytearray(p.a.tobytes()))]
    got = omr.recognise(spark.createDataFrame(rows, "score_id long, page int, width int, height int, rgba binary")).collect()
    assert [(r["score_id"], r["pitch"], r["duration"]) for r in got] == [(7, 71, 480)]


def test_onsets():
    head = lambda x, y, stem=None: {"x": x, "y": y, "stem": stem}
    shown = lambda found, d=10: [[(h["x"], h["y"]) for h in g] for g in omr.onsets(found, d)]
    assert shown([head(60, 100), head(75, 95), head(90, 90)]) == [[(60, 100)], [(75, 95)], [(90, 90)]]
    assert shown([head(60, 100), head(64, 120), head(61, 101)]) == [[(60, 100), (64, 120)]]
    assert shown([head(60, 100), head(71, 95)]) == [[(71, 95), (60, 100)]]  # a displaced second
    assert shown([head(60, 100, (66, 70)), head(80, 130, (66, 70)), head(110, 90)]) == [[(60, 100), (80, 130)], [(110, 90)]]
    assert shown([]) == []


def test_a_bar_that_is_too_long_is_filled():
    p = Page().staff()
    for x in (80, 125, 170, 215):
        p.note(x, 0, hollow=x == 125)
    got = [(n["start"], n["duration"]) for n in omr.read_page(p.a) if n["measure"] == 0]
    assert got == [(0, 480), (480, 480), (960, 480), (1440, 480)]
