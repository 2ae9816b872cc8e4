"""Shapes, arcs and systems on drawn pages, against what was drawn."""

import numpy as np
import pandas as pd
import pytest

from tonelake.operators import glyphs, omr
from tonelake.plans import q_pages


def plain_holes(box):
    """White areas that a flood from outside does not reach (4-connected), single pixels apart."""
    white = np.pad(~box, 1, constant_values=True)
    seen, todo = np.zeros(white.shape, bool), [(0, 0)]

    def flood(start):
        todo, n = [start], 0
        seen[start] = True
        while todo:
            y, x = todo.pop()
            n += 1
            for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= p[0] < white.shape[0] and 0 <= p[1] < white.shape[1] and white[p] and not seen[p]:
                    seen[p] = True
                    todo.append(p)
        return n

    flood((0, 0))
    return sum(flood((y, x)) > 1 for y, x in zip(*np.nonzero(white)) if not seen[y, x])


@pytest.mark.parametrize("kind", glyphs.KINDS)
@pytest.mark.parametrize("space", [9, 11, 13])
def test_shapes_by_topology(kind, space):
    box = glyphs.drawn(kind, space)
    assert glyphs.holes(box) == plain_holes(box)
    assert glyphs.classify(box, space) == kind
    # A little noise at the rim changes nothing.
    rng = np.random.default_rng(1)
    rim = box ^ (np.roll(box, 1, 0) | np.roll(box, 1, 1))
    assert glyphs.classify(box & ~(rim & (rng.random(box.shape) < 0.15)), space) == kind or kind == "eighth_rest"


def test_nothing_is_near_a_bar_of_ink():
    assert glyphs.classify(np.ones((4, 90), bool), 10) is None


def page(slots, score=0):
    return q_pages.draw(pd.DataFrame([(score, k // 8, k % 8, kind, step, arc) for k, (kind, step, arc) in enumerate(slots)], columns=["score_id", "staff", "slot", "kind", "step", "arc"]))


def read(a):
    return [(r[0], int((r[4] - q_pages.FIRST + 25) // q_pages.WIDE), r[3], r[6], r[7]) for r in glyphs.read_symbols(a)]


def test_ties_and_slurs():
    a = page([(0, 0, True), (0, 0, False), (0, -2, True), (0, 2, False), (5, 0, False), (0, 2, False), (0, 2, True), (4, 2, False)])
    assert [(slot, step) for _, slot, kind, step, tied in read(a) if tied] == [(1, 0), (7, 2)]
    # A phrase mark far above the heads, and a straight line, tie nothing.
    for line in (lambda t: -34 - 30 * t * (1 - t), lambda t: -9):
        b = page([(0, 0, False), (0, 0, False)])
        y = q_pages.TOP + 20
        for t in np.linspace(0, 1, 200):
            b[int(y + line(t)) : int(y + line(t)) + 3, int(q_pages.FIRST + 8 + t * 46), :3] = 0
        assert not any(tied for *_, tied in read(b))


@pytest.mark.parametrize("score", range(4))
def test_systems_of_staves(score):
    got = [(r[0], r[1], r[2]) for r in glyphs.read_symbols(page([(0, 0, False)] * 8 * 5, score)) if r[3] == "barline"]
    assert got == [(k, k // (score + 1), k % (score + 1)) for k in range(5)]


def test_cheapest_path():
    """Against all paths."""
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(20):
        weight, start, end = rng.random((4, 5)), rng.random(4), rng.random(4)
        best = min(start[p[0]] + end[p[-1]] + sum(weight[y, x] for x, y in enumerate(p)) + 0.05 * sum(a != b for a, b in zip(p, p[1:])) for p in product(range(4), repeat=5) if all(abs(a - b) <= 1 for a, b in zip(p, p[1:])))
        path, cost = glyphs.path_between(weight, start, end)
        assert cost == pytest.approx(best) and start[path[0]] + end[path[-1]] + weight[path, range(5)].sum() + 0.05 * np.count_nonzero(np.diff(path)) == pytest.approx(best)


def test_pages_without_staves(spark):
    white = np.full((200, 300, 4), 255, np.uint8)
    rows = [(1, 0, 300, 200, bytearray(white.tobytes())), (2, 0, 0, 0, bytearray())]
    pages = spark.createDataFrame(rows[:1], "score_id long, page int, width int, height int, rgba binary")
    assert glyphs.symbols(pages).collect() == []
    assert omr.staves(omr.binary(omr.grey(white))) == []
