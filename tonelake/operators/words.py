"""Words above a staff: letters in a band put together by their gaps, and articulation marks told from letters.

Letters are pieces of ink.  Those at one height are a band; in a band each is
chained to the next one, and the chain is cut where two-means over all its gaps
says that words end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import glyphs, omr

#: The zone of words over a staff, and heights and widths of letters, in staff spaces.
ZONE, ABOVE = (6.0, 0.4), 1.5
LETTER, WIDE = (0.15, 2.6), 3.0
#: A gap within a word is no wider and a gap between words no narrower, in staff spaces; in between the two means decide.
CLOSE, APART = 0.9, 0.35
#: Pieces are at one height if so much of the lower one lies beside the other.
BESIDE = 0.5
#: How far, as a share of its size, a chevron's arms may stray from straight lines.
STRAY = 0.14
#: Marks smaller than this in both directions are dots, flatter ones dashes, in staff spaces.
DOT, DASH = 0.55, 0.35


def two_means(values: list[float]) -> float | None:
    """Where sorted values part into the two groups of least squares, exactly; None if they are all alike."""
    v = np.sort(np.asarray(values, float))
    if len(v) < 2 or v[0] == v[-1]:
        return None
    n = np.arange(1, len(v))
    sums, squares = v.cumsum(), (v * v).cumsum()
    left = squares[:-1] - sums[:-1] ** 2 / n
    right = (squares[-1] - squares[:-1]) - (sums[-1] - sums[:-1]) ** 2 / (len(v) - n)
    cost = np.where(v[1:] > v[:-1], left + right, np.inf)
    k = int(cost.argmin())
    return float((v[k] + v[k + 1]) / 2)


def chevron(box: np.ndarray) -> bool:
    """Whether a piece is an accent or marcato: two straight arms that start apart and meet in a point.

    It encloses no white; across it, lines meet two runs of ink until they join, and the
    distance between its outer edges falls evenly to the stroke's thickness.
    """
    return min(box.shape) >= 4 and _chevron(*glyphs.packed(box))


@lru_cache(maxsize=4096)
def _chevron(bits: bytes, high: int, wide: int) -> bool:
    box = glyphs.unpacked(bits, high, wide)
    for a in (box, box[:, ::-1], box.T, box.T[:, ::-1]):  # points to the right, left, down, up
        h, w = a.shape
        if not a.any(0).all():
            continue
        first, last = a.argmax(0), h - 1 - a[::-1].argmax(0)
        arms = a[:, : max(1, int(0.35 * w))]
        arms = np.count_nonzero(arms[1:] & ~arms[:-1], 0) + arms[0]
        if np.abs((first + last) / 2 - (h - 1) / 2).max() > STRAY * h or np.mean(arms == 2) <= 0.5:
            continue
        spread = (last - first + 1) / h
        x = np.arange(w)[w // 12 + 1 : w - w // 12 - 1]  # rounded ends do not count
        if len(x) < 2:
            continue
        line = np.polyval(np.polyfit(x, spread[x], 1), np.arange(w))
        if line[0] >= 0.75 and line[-1] <= 0.45 and np.abs(spread - line)[x].max() <= STRAY:
            return not glyphs.holes(box)
    return False


def articulation(box: np.ndarray, space: float) -> bool:
    """Whether a word of a single piece is a mark over a note and no letter: an accent, a marcato, a dot or a dash."""
    h, w = box.shape
    return chevron(box) or max(h, w) <= DOT * space or h <= DASH * space


def bands(found: list[dict]) -> list[list[dict]]:
    """Pieces by height, each from left to right: those beside each other, directly or through others, are a band."""
    out: list[list[dict]] = []
    for c in found:
        beside = lambda o, c=c: min(c["y1"], o["y1"]) - max(c["y0"], o["y0"]) >= BESIDE * min(c["y1"] - c["y0"], o["y1"] - o["y0"])
        mine = [b for b in out if any(beside(o) for o in b)]
        out = [b for b in out if not any(b is m for m in mine)] + [[c, *(o for m in mine for o in m)]]
    return [sorted(b, key=lambda c: (c["x0"], c["y0"])) for b in sorted(out, key=lambda b: min(c["y0"] for c in b))]


def chained(band: list[dict], space: float) -> list[list[dict]]:
    """A band's words: neighbours stay together unless their gap belongs to the wide ones."""
    gaps, end = [], band[0]["x1"]
    for c in band[1:]:
        gaps.append(max(0, c["x0"] - end))
        end = max(end, c["x1"])
    cut = two_means(gaps)
    cut = CLOSE * space if cut is None else min(CLOSE * space, max(APART * space, cut))
    out = [[band[0]]]
    for gap, c in zip(gaps, band[1:]):
        if gap > cut:
            out.append([])
        out[-1].append(c)
    return out


WORDS = "score_id long, page int, staff int, x0 int, x1 int, y0 int, y1 int, letters int"


def find_words(ink: np.ndarray) -> list[tuple]:
    """``(staff, x0, x1, y0, y1, letters)`` of the words over each staff of a page, ends not included."""
    out, staves = [], omr.staves(ink)
    for number, staff in enumerate(staves):
        d = staff.space
        top = staff.lines[0] - ZONE[0] * d
        if number:
            top = max(top, staves[number - 1].lines[4] + ABOVE * d)
        y0, y1 = max(0, int(top)), int(staff.lines[0] - ZONE[1] * d)
        found = []
        for c in omr.components(ink[y0:y1, staff.left : staff.right]) if y1 > y0 else ():
            # What reaches into the zone from under it is a stem or a slur.
            high, wide = c["y1"] - c["y0"], c["x1"] - c["x0"]
            if c["y1"] < y1 - y0 and (c["y0"] > 0 or y0 == 0) and LETTER[0] * d <= high <= LETTER[1] * d and wide <= WIDE * d:
                found.append({"x0": c["x0"] + staff.left, "x1": c["x1"] + staff.left, "y0": c["y0"] + y0, "y1": c["y1"] + y0})
        found = [c for c in found if not chevron(ink[c["y0"] : c["y1"], c["x0"] : c["x1"]])]
        for band in bands(found):
            for word in chained(band, d):
                x0, x1, top, bottom = min(c["x0"] for c in word), max(c["x1"] for c in word), min(c["y0"] for c in word), max(c["y1"] for c in word)
                if len(word) > 1 or not articulation(ink[top:bottom, x0:x1], d):
                    out.append((number, x0, x1, top, bottom, len(word)))
    return sorted(out)


def read_words(rgba: np.ndarray) -> list[tuple]:
    """Rows of a page, as places in the page turned upright."""
    return find_words(omr.upright(rgba))


def words(pages: DataFrame, pixels: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """Words of ``(score_id, page, width, height, rgba)`` pages, or of pages that ``pixels`` makes (:func:`~tonelake.operators.omr.by_page`); a page without staves gives no rows."""
    return omr.by_page(pages, read_words, WORDS, pixels)
