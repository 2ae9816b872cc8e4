"""Words over a staff: gaps, bands, marks told from letters, on drawn pages."""

import numpy as np
import pandas as pd
import pytest

from tonelake.operators import glyphs, tuplets, words
from tonelake.plans import q_words


def test_two_means_against_every_cut():
    rng = np.random.default_rng(3)
    for n in range(2, 12):
        v = np.sort(rng.integers(0, 30, n)).astype(float)
        if v[0] == v[-1]:
            continue
        costs = {(v[k - 1] + v[k]) / 2: v[:k].var() * k + v[k:].var() * (n - k) for k in range(1, n) if v[k] > v[k - 1]}
        assert costs[words.two_means(list(v[::-1]))] == pytest.approx(min(costs.values()))
    assert words.two_means([]) is words.two_means([4]) is words.two_means([2, 2, 2]) is None


def lines(size, *strokes, thick=2.2):
    h, w = size
    a = np.zeros((h, w), bool)
    for s in strokes:
        glyphs._stroke(a, *s, thick)
    y, x = np.flatnonzero(a.any(1)), np.flatnonzero(a.any(0))
    return a[y[0] : y[-1] + 1, x[0] : x[-1] + 1]


@pytest.mark.parametrize("k", [1.0, 1.4, 2.0])
def test_accents_and_letters(k):
    s = lambda *xy: tuple(v * k for v in xy)
    size = (int(24 * k), int(24 * k))
    wide, tall = lines(size, s(2, 2, 18, 7), s(18, 7, 2, 12)), lines(size, s(2, 16, 7, 2), s(7, 2, 12, 16))
    assert [words.chevron(a) for a in (wide, wide[:, ::-1], tall, tall[::-1])] == [True] * 4
    letters = [
        lines(size, s(2, 18, 8, 2), s(8, 2, 14, 18), s(5, 11, 11, 11)),  # A
        lines(size, s(2, 2, 2, 18), s(2, 2, 12, 2), s(2, 10, 10, 10), s(2, 18, 12, 18)),  # E
        lines(size, s(2, 2, 12, 2), s(2, 2, 2, 18), s(2, 18, 12, 18)),  # C
        lines(size, s(2, 2, 2, 18)),
        *[tuplets.drawn_digit(n, 10 * k) for n in (2, 3, 4, 5, 6, 9)],
    ]
    assert [words.chevron(a) for a in letters] == [False] * len(letters)
    assert words.articulation(np.ones((4, 4), bool), 10) and words.articulation(np.ones((2, 9), bool), 10) and not words.articulation(letters[0], 10 * k)


def boxes(*xs, y=0, h=14):
    return [{"x0": a, "x1": b, "y0": y, "y1": y + h} for a, b in xs]


def test_chains():
    runs = lambda *xs: [len(w) for w in words.chained(boxes(*xs), 10)]
    assert runs((0, 10)) == [1]
    assert runs((0, 10), (12, 20), (40, 50), (53, 60)) == [2, 2]
    assert runs((0, 10), (40, 50), (75, 80)) == [1, 1, 1]  # wide gaps alone, of two sizes
    assert runs((0, 10), (11, 20), (23, 30), (32, 40)) == [4]  # narrow ones alone
    assert runs((0, 10), (40, 50), (80, 90)) == [1, 1, 1] and runs((0, 10), (12, 20), (22, 30)) == [3]  # all alike
    assert runs((0, 30), (5, 10), (32, 40)) == [3]  # a piece over another


def test_bands():
    found = boxes((0, 10), (30, 40)) + boxes((12, 20), y=5, h=9) + boxes((0, 10), (12, 20), y=30) + boxes((50, 52), y=2, h=4)
    assert [[c["x0"] for c in b] for b in words.bands(found)] == [[0, 12, 30, 50], [0, 12]]


def page(kinds, shift=0, drop=0):
    return q_words.draw(pd.DataFrame([(k // 8, k % 8, kind, shift, drop) for k, kind in enumerate(kinds)], columns=["staff", "slot", "kind", "shift", "drop"]))


def read(a):
    return words.find_words((a[..., :3] == 0).all(2))


@pytest.mark.parametrize("kind", range(8))
def test_a_staff_of_one_kind(kind):
    """Equal words, where no gap is another's measure, and marks alone."""
    wide = [10, 24, 20, 34]
    want = [(0, x, x + wide[kind], 30, 44, len(q_words.DRAWN[kind])) for x in (q_words.FIRST + q_words.WIDE * k for k in range(8))] if kind < 4 else []
    assert read(page([kind] * 8)) == want


def test_words_under_the_staff_before():
    """A zone ends under the staff above; words near that staff's lines are not read."""
    a = page([7, 7, 7, 7, 7, 7, 7, 7, 0, 1, 2, 3, 0, 1, 2, 3])
    a[q_words.TOP + 43 : q_words.TOP + 53, 300:310, :3] = 0
    assert [(w[0], w[5]) for w in read(a)] == [(1, n) for n in (1, 2, 2, 3, 1, 2, 2, 3)]


def test_pages_without_staves(spark):
    white = np.full((120, 90, 4), 255, np.uint8)
    pages = spark.createDataFrame([(1, 0, 90, 120, bytearray(white.tobytes()))], "score_id long, page int, width int, height int, rgba binary")
    assert words.words(pages).collect() == [] and words.words(pages.limit(0)).collect() == []
