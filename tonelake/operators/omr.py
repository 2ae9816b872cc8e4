"""Reading engraved pages: binarising, staves, note heads, bars, notes.

A page is one row and one task: its pixels are decoded to numpy arrays and
everything runs on whole arrays.  What is read: staves, barlines, solid and
hollow heads, stems, flags and beams by strokes at the stem's end.  Clefs and
signatures are parameters; accidentals, rests, ties and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import pieces, table
from .assembly import fit_bar

# Fixed values.
LETTERS = (0, 2, 4, 5, 7, 9, 11)
TREBLE, BASS = 4 * 7 + 6, 3 * 7 + 1  # diatonic numbers of the middle lines
BLOCK = 8


def grey(rgba: np.ndarray) -> np.ndarray:
    """Luma of ``(h, w, 4)`` pixels on white paper."""
    out = np.empty(rgba.shape[:2], np.uint8)
    for y in range(0, len(out), BLOCK):  # a few rows stay in the cache
        p = rgba[y : y + BLOCK].astype(np.float64)
        luma = p[..., 0] * 0.299 + p[..., 1] * 0.587 + p[..., 2] * 0.114
        a = p[..., 3] / 255
        out[y : y + BLOCK] = np.floor(luma * a + 255 * (1 - a) + 0.5)
    return out


def otsu(g: np.ndarray) -> int:
    """The threshold that parts ink from paper best; pixels up to it are ink."""
    n = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    low, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    between = np.where((low > 0) & (high > 0), between, -1.0)
    return int(between.argmax()) if between.max() > -1 else 127


def background(g: np.ndarray) -> np.ndarray:
    """Paper brightness: block means, spread by maxima over neighbours and smoothed."""
    h, w = g.shape
    padded = np.pad(g.astype(np.float64), ((0, -h % BLOCK), (0, -w % BLOCK)), mode="edge")
    cells = padded.reshape(padded.shape[0] // BLOCK, BLOCK, -1, BLOCK).mean((1, 3))
    around = lambda c, f: f([np.roll(np.roll(np.pad(c, 2, mode="edge"), i, 0), j, 1)[2:-2, 2:-2] for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2)], axis=0)
    cells = around(around(cells, np.max), np.mean)
    return np.repeat(np.repeat(cells, BLOCK, 0), BLOCK, 1)[:h, :w]


def binary(g: np.ndarray) -> np.ndarray:
    """True where there is ink, after evening out the paper."""
    even = np.clip(g / np.maximum(background(g), 1.0) * 255, 0, 255).astype(np.uint8)
    if even.max() - even.min() < 40:
        return np.zeros(g.shape, bool)
    return even <= min(otsu(even), 225)


#: Opaque black and white, as a pixel's four bytes in one number.
BLACK, WHITE = (int(np.array([v, v, v, 255], np.uint8).view(np.uint32)[0]) for v in (0, 255))


def ink_of(rgba: np.ndarray) -> np.ndarray:
    """:func:`binary` of a page's :func:`grey`; where all is pure black or white there is no paper to even out, nor a threshold to seek."""
    pixels = np.ascontiguousarray(rgba).view(np.uint32)[..., 0]
    black = pixels == BLACK
    n = np.count_nonzero(black)
    if n == pixels.size or n + np.count_nonzero(pixels == WHITE) < pixels.size:
        return binary(grey(rgba))
    return black


def upright(rgba: np.ndarray) -> np.ndarray:
    """Ink of a page, turned so that its rows do not lean."""
    ink = ink_of(rgba)
    return rotated(ink, skew(ink))


def column_counts(ink: np.ndarray) -> np.ndarray:
    """Pixels of ink in each row and each eight columns."""
    return np.bitwise_count(np.packbits(ink, axis=1))


@lru_cache(maxsize=1024)
def _turns(tall: int, wide: int, deg: float) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """How a page of a size turns: the number of rows there are then, and which rows ``y0`` to ``y1`` of which eights of columns ``p`` to ``q`` may reach the rows from ``to`` on."""
    a, n, parts = np.deg2rad(deg), -(-wide // 8), 4 if abs(deg) > 1.7 else 1
    x = np.stack([np.arange(n) * 8.0, np.minimum(np.arange(n) * 8.0 + 7, wide - 1)]) - wide / 2
    at, out = -x * np.sin(a) - tall / 2 + 0.5, []
    for y0, y1 in zip(np.arange(parts) * tall // parts, np.arange(1, parts + 1) * tall // parts):
        lean = -(np.array([y0, y1 - 1]) - tall / 2) * (1 - np.cos(a))
        low, high = np.floor(at.min(0) + lean.min() - 1e-6).astype(int), np.floor(at.max(0) + lean.max() + 1e-6).astype(int)
        for shift in range(low.min(), high.max() + 1):
            there = np.flatnonzero((low <= shift) & (shift <= high))
            if len(there):  # they stand together, as columns go up or down evenly
                out.append((int(y0), int(y1), int(y0) + shift, int(there[0]), int(there[-1]) + 1))
    first = min(to for _, _, to, _, _ in out)
    return max(y1 - y0 + to for y0, y1, to, _, _ in out) - first, [(y0, y1, to - first, p, q) for y0, y1, to, p, q in out]


def _below(sums: np.ndarray, wide: int, deg: float, limit: float) -> bool:
    """Whether ``sharp`` of :func:`skew` is less than a limit at an angle, told by a bound.

    ``sums`` holds, summed up from the left, the ink of eight columns in each
    row.  Eight columns turn into few rows, and each of these could get all their
    ink; as no more ink than there is can be given away, the fullest rows get theirs.
    """
    n, turns = _turns(sums.shape[1], wide, deg)
    rows = np.zeros(n, sums.dtype)
    for y0, y1, to, p, q in turns:
        part = rows[to : to + y1 - y0]
        part += sums[q, y0:y1]
        part -= sums[p, y0:y1]
    rows = rows.astype(float)
    if np.dot(rows, rows) < limit:
        return True
    given = np.diff(np.minimum(np.sort(rows)[::-1].cumsum(), float(sums[-1].sum())), prepend=0)
    return bool(np.dot(given, given) < limit)


COARSE, FINE = np.arange(-3, 3.01, 0.5), np.arange(-0.5, 0.51, 0.1)


def _stands(ink: np.ndarray) -> bool:
    """Whether bounds alone show that no angle :func:`skew` tries has a profile so much sharper that the page would be turned."""
    counts = column_counts(ink)
    if not 200 <= int(counts.sum(dtype=np.int64)) < 500_000:  # of more ink a part is looked at
        return False
    sums = np.zeros((counts.shape[1] + 1, len(counts)), np.int32)
    np.cumsum(counts.T, axis=0, out=sums[1:])
    flat = float(np.dot(rows := sums[-1].astype(float), rows))
    wide = ink.shape[1]
    return all(_below(sums, wide, deg, flat * 1.02) for deg in FINE.tolist() if abs(deg) > 0.1) and all(_below(sums, wide, deg, flat) for deg in COARSE.tolist() if deg)


def skew(ink: np.ndarray) -> float:
    """Radians by which rows lean: the angle with the sharpest row profile."""
    if _stands(ink):
        return 0.0
    y, x = np.nonzero(ink)
    if len(x) < 200:
        return 0.0
    part = slice(None, None, max(1, len(x) // 250_000))
    x, y = x[part] - ink.shape[1] / 2, y[part] - ink.shape[0] / 2

    def sharp(deg: float) -> float:
        a = np.deg2rad(deg)
        rows = np.floor(-x * np.sin(a) + y * np.cos(a) + 0.5).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    flat = sharp(0.0)
    best = max(COARSE, key=sharp)
    best = max(np.arange(best - 0.5, best + 0.51, 0.1), key=sharp)
    return float(np.deg2rad(best)) if sharp(best) > flat * 1.02 and abs(best) > 0.1 else 0.0


def rotated(ink: np.ndarray, angle: float) -> np.ndarray:
    if angle == 0:
        return ink
    h, w = ink.shape
    y, x = np.mgrid[0:h, 0:w]
    x, y = x - w / 2, y - h / 2
    sx = np.floor(x * np.cos(angle) - y * np.sin(angle) + w / 2 + 0.5).astype(int)
    sy = np.floor(x * np.sin(angle) + y * np.cos(angle) + h / 2 + 0.5).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(ok, ink[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], False)


def runs(line: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of True."""
    padded = np.zeros(len(line) + 2, bool)
    padded[1:-1] = line
    edges = np.flatnonzero(padded[1:] != padded[:-1]).tolist()
    return list(zip(edges[::2], edges[1::2]))


def row_runs(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every run of ink, from top to bottom and left to right."""
    h, w = ink.shape
    line = np.zeros(h * (w + 1) + 1, bool)  # all rows behind each other, with white between them
    line[1:].reshape(h, w + 1)[:, :w] = ink
    edges = np.flatnonzero(line[1:] != line[:-1])
    rows = edges[::2] // (w + 1)
    return rows, edges[::2] - rows * (w + 1), edges[1::2] - rows * (w + 1)


def column_runs(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, start and end of every run of ink down the columns, from left to right and top to bottom."""
    h, w = ink.shape
    edges = np.empty((h + 1, w), bool)
    edges[0], edges[-1] = ink[:1].any(0), ink[-1:].any(0)
    np.not_equal(ink[1:], ink[:-1], out=edges[1:-1])
    rows, columns = np.divmod(np.flatnonzero(edges), w)
    order = np.argsort(columns.astype(np.min_scalar_type(w)), kind="stable")
    rows = rows[order]
    return columns[order[::2]], rows[::2], rows[1::2]


def crossed(line: np.ndarray) -> int:
    """How many runs a line has."""
    return int(np.count_nonzero(line[1:] & ~line[:-1])) + int(line[0]) if len(line) else 0


def contacts(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all two runs that touch, also at a corner, the lower one first."""
    wide = int(b.max(initial=0)) + 2
    row = y * wide
    begin, end = row + a, row + b
    first = end.searchsorted(begin - wide, "left")
    n = np.maximum(begin.searchsorted(end - wide, "right") - first, 0)
    low = np.arange(len(y)).repeat(n)
    return low, np.arange(len(low)) + (first - n.cumsum() + n).repeat(n)


def joined(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least number in each of ``n`` numbers' component; ``p`` and ``q`` are linked."""
    label = np.arange(n)
    while True:
        u, v = label[p], label[q]
        differ = u != v
        if not differ.any():
            return label
        p, q, u, v = p[differ], q[differ], u[differ], v[differ]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while not (label == (further := label[label])).all():
            label = further


def components(ink: np.ndarray) -> list[dict]:
    """Boxes and areas of 8-connected components, by joining the runs of adjacent rows."""
    y, a, b = row_runs(ink)
    if not len(y):
        return []
    label = joined(len(y), *contacts(y, a, b))
    order = np.argsort(label, kind="stable")
    y, a, b, label = y[order], a[order], b[order], label[order]
    at = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    last = np.append(at[1:], len(y)) - 1  # a component's runs go from top to bottom
    boxes = np.minimum.reduceat(a, at), np.maximum.reduceat(b, at), y[at], y[last] + 1, np.add.reduceat(b - a, at)
    return [dict(zip(("x0", "x1", "y0", "y1", "area"), box)) for box in zip(*(v.tolist() for v in boxes))]


@dataclass
class Staff:
    lines: list[float]
    left: int
    right: int
    space: float
    thick: float

    @property
    def middle(self) -> float:
        return self.lines[2]


def spacing(ink: np.ndarray) -> tuple[float, float] | None:
    """Distance of staff lines and their thickness, from black and white runs down the columns."""
    column, start, end = column_runs(ink[:, :: max(1, ink.shape[1] // 1500)])
    apart, black = start[1:] - start[:-1], (end - start)[:-1]
    kept = (column[1:] == column[:-1]) & (apart <= 120)
    apart, black = apart[kept], black[kept]
    pairs = np.bincount(apart, minlength=123).astype(float)
    near = pairs[3:121] + pairs[4:122] + pairs[5:123]
    if near.max(initial=0) < 30:
        return None
    d = int(near.argmax()) + 4
    w = pairs[d - 1 : d + 2]
    thin = np.bincount(black[(abs(apart - d) <= 1) & (black < d / 2)])
    return float((w * [d - 1, d, d + 1]).sum() / w.sum()), float(max(1, thin.argmax()))


def staves(ink: np.ndarray) -> list[Staff]:
    """Five evenly spaced rows of ink that run across the page."""
    size = spacing(ink)
    if size is None:
        return []
    d, thick = size
    weight = column_counts(ink).sum(1, dtype=np.int64)
    if weight.max(initial=0) < 5 * d:
        return []
    rows = [((a + b - 1) / 2, b - a) for a, b in runs(weight >= 0.5 * weight.max()) if b - a <= max(3, 0.5 * d)]
    out, at = [], 0
    while at + 5 <= len(rows):
        group = [y for y, _ in rows[at : at + 5]]
        if all(abs(b - a - d) <= max(1.5, 0.2 * d) for a, b in zip(group, group[1:])):
            band = ink[int(group[0]) : int(group[4]) + 1].sum(0)
            across = np.flatnonzero(band >= 4)
            out.append(Staff(group, int(across[0]), int(across[-1]) + 1, (group[4] - group[0]) / 4, thick))
            at += 5
        else:
            at += 1
    return out


def without_lines(ink: np.ndarray, staff: Staff) -> np.ndarray:
    """The page without a staff's lines, where nothing crosses them."""
    out, most = ink.copy(), int(staff.thick * 1.6 + 1)
    tops = [max(0, int(y - staff.space / 2)) for y in staff.lines]
    sizes = [min(len(ink), int(y + staff.space / 2) + 1) - top for y, top in zip(staff.lines, tops)]
    n = max(sizes)
    # Rows about all lines beside each other; rows beyond a line's own are white.
    at = np.array(tops) + np.arange(n)[:, None]
    part = ink[np.minimum(at, len(ink) - 1), staff.left : staff.right]
    part &= (np.arange(n)[:, None] < sizes)[..., None]
    # First and last row of the run of ink that each pixel belongs to.
    rows = np.arange(n, dtype=np.int16)[:, None, None]
    first, last = np.where(part, np.int16(0), rows + np.int16(1)), np.where(part, np.int16(n), rows)
    for k in range(1, n):
        np.maximum(first[k], first[k - 1], out=first[k])
        np.minimum(last[-1 - k], last[-k], out=last[-1 - k])
    begins = np.array([int(np.floor(y + 1.5 - top)) for y, top in zip(staff.lines, tops)], np.int16)[:, None]
    ends = np.array([int(np.ceil(y - 0.5 - top)) for y, top in zip(staff.lines, tops)], np.int16)[:, None]
    part &= (last - first <= most) & (first <= begins) & (last >= ends)
    for k, (top, size) in enumerate(zip(tops, sizes)):
        out[top : top + size, staff.left : staff.right][part[:size, k]] = False
    return out


def barlines(ink: np.ndarray, staff: Staff, clean: np.ndarray | None = None) -> list[float]:
    """Thin strokes from the first to the last line that end there and have nothing beside them."""
    clean = without_lines(ink, staff) if clean is None else clean
    top, bottom = int(staff.lines[0]), int(staff.lines[4]) + 1
    full = ink[top:bottom, staff.left : staff.right].view(np.uint8).sum(0, dtype=np.uint16) / (bottom - top) >= 0.97
    reach = int(staff.space)
    out = []
    for a, b in runs(full):
        column = ink[:, staff.left + a]
        beyond = column[max(0, top - reach) : top - 2].mean() if top > 2 else 0.0
        below = column[bottom + 2 : bottom + reach].mean() if bottom + 2 < len(column) else 0.0
        x, half = staff.left + a, reach // 2
        left, right = clean[top:bottom, max(0, x - half) : max(0, x - 2)], clean[top:bottom, staff.left + b + 2 : staff.left + b + half]
        beside = max(left.any(1).mean() if left.size else 0.0, right.any(1).mean() if right.size else 0.0)
        if b - a <= max(3, 0.6 * staff.space) and max(beyond, below) < 0.6 and beside < 0.15:
            out.append(staff.left + (a + b - 1) / 2)
    return out


def heads(clean: np.ndarray, staff: Staff, ink: np.ndarray) -> list[dict]:
    """Solid heads fill an oval, hollow ones enclose white of about half of one, with or without the lines."""
    d = staff.space
    top, bottom = max(0, int(staff.lines[0] - 5 * d)), min(clean.shape[0], int(staff.lines[4] + 5 * d))
    area = clean[top:bottom]
    a, b = 0.55 * d, 0.36 * d
    hw, hh = max(1, int(a)), max(1, int(b))
    h, w = area.shape
    # Ink of the box about each pixel, row by row and then column by column.
    padded = np.zeros((h + 2 * hh, w + 2 * hw), np.uint8 if (2 * hw + 1) * (2 * hh + 1) < 256 else np.int32)
    padded[hh : hh + h, hw : hw + w] = area
    down = padded[:h].copy()
    for k in range(1, 2 * hh + 1):
        down += padded[k : k + h]
    box = down[:, :w].copy()
    for k in range(1, 2 * hw + 1):
        box += down[:, k : k + w]
    size = (2 * hw + 1) * (2 * hh + 1)
    full = box >= np.flatnonzero(np.arange(size + 1) / size >= 0.88)[0]
    found = []
    # Full boxes, and white with and without the lines, under each other: their pieces are sought at once.
    stacked = np.zeros((3, h + 1, w), bool)
    stacked[0, :h] = full
    np.logical_not(area, out=stacked[1, :h])
    np.logical_not(ink[top:bottom], out=stacked[2, :h])
    for c in components(stacked.reshape(-1, w)):
        k = c["y0"] // (h + 1)
        y0, y1, wide, high = c["y0"] - k * (h + 1), c["y1"] - k * (h + 1), c["x1"] - c["x0"], c["y1"] - c["y0"]
        if k == 0:
            kept = wide <= 1.2 * d and high <= 1.2 * d
        else:
            inside = c["x0"] > 0 and c["x1"] < w and y0 > 0 and y1 < h
            kept = inside and 0.35 * d <= wide <= 1.3 * d and 0.25 * d <= high <= 0.9 * d and c["area"] >= 0.5 * wide * high
        if kept:
            found.append({"x": (c["x0"] + c["x1"] - 1) / 2, "y": top + (y0 + y1 - 1) / 2, "hollow": k > 0})
    out: list[dict] = []
    for f in sorted(found, key=lambda f: (f["hollow"], f["x"])):
        if all(abs(f["x"] - o["x"]) > 0.7 * d or abs(f["y"] - o["y"]) > 0.4 * d for o in out):
            out.append(f)
    return sorted(out, key=lambda f: (f["x"], f["y"]))


def stem(clean: np.ndarray, head: dict, d: float) -> tuple[float, int] | None:
    """``(x, end row)`` of a head's stem, up on its right or down on its left."""
    y, offsets = int(head["y"]), np.arange(0.3, 0.95, 0.05) * d
    for sign, up in ((1, True), (-1, False)):
        columns = (head["x"] + sign * offsets + 0.5).astype(int)
        columns = columns[(columns >= 0) & (columns < clean.shape[1])]
        if not len(columns):
            continue
        low = int(columns.min())
        part = clean[: y + 1, low : int(columns.max()) + 1][::-1] if up else clean[y:, low : int(columns.max()) + 1]
        lengths = part.argmin(0) if len(part) else np.zeros(part.shape[1], int)
        if len(part):
            lengths[(lengths == 0) & part[0]] = len(part)
        for x, length in zip(columns.tolist(), lengths[columns - low].tolist()):
            if length >= 2.2 * d:
                return float(x), y - length + 1 if up else y + length - 1
    return None


def strokes(clean: np.ndarray, x: float, end: int, up: bool, d: float) -> int:
    """Flags or beams: separate bars of ink beside the stem's end."""
    best = 0
    for side in (int(x + 0.35 * d), int(x - 0.35 * d)):
        if 0 <= side < clean.shape[1]:
            a, b = (end - 1, int(end + 2.2 * d)) if up else (int(end - 2.2 * d), end + 2)
            best = max(best, sum(0.2 * d <= q - p <= 0.9 * d for p, q in runs(clean[max(0, a) : max(0, b), side])))
    return min(3, best)


def pitch_of(step: int, middle: int, fifths: int = 0) -> int:
    """MIDI number of a step from the middle line in a key."""
    n = middle + step
    sharps, flats = (3, 0, 4, 1, 5, 2, 6), (6, 2, 5, 1, 4, 0, 3)
    alter = 1 if n % 7 in sharps[: max(0, fifths)] else -1 if n % 7 in flats[: max(0, -fifths)] else 0
    return (n // 7 + 1) * 12 + LETTERS[n % 7] + alter


def onsets(found: list[dict], d: float) -> list[list[dict]]:
    """Heads in groups that sound together, from left to right, one head a staff position.

    Two heads belong together if they share a stem, stand over each other
    (0.6 spaces apart) or would touch (1.3 by 1.05 spaces); groups that are
    linked so by a third head are one.  Of heads at one position (0.4 spaces)
    the topmost stays.
    """
    def meet(p: dict, q: dict) -> bool:
        dx, dy = abs(p["x"] - q["x"]), abs(p["y"] - q["y"])
        return dx <= 2.2 * d and (dx <= 0.6 * d or (dx <= 1.3 * d and dy <= 1.05 * d) or (p["stem"] is not None and p["stem"] == q["stem"]))

    groups: list[list[dict]] = []
    for h in found:
        mine = [g for g in groups if any(meet(h, other) for other in g)]
        groups = [g for g in groups if not any(g is m for m in mine)] + [[h, *(x for g in mine for x in g)]]
    out = []
    for g in groups:
        kept: list[dict] = []
        for h in sorted(g, key=lambda h: (h["y"], h["x"])):
            if all(abs(h["y"] - k["y"]) >= 0.4 * d for k in kept):
                kept.append(h)
        out.append(kept)
    return sorted(out, key=lambda g: sum(h["x"] for h in g) / len(g))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _column(c: pa.Array) -> list:
    """A column's values: arrays of numbers as numpy arrays, bytes as they lie in the batch."""
    if pa.types.is_list(c.type):
        offsets, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return [x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist()


def by_page(pages: DataFrame, reader: Callable[[np.ndarray], list[tuple]], schema: str, pixels: Callable[[dict], np.ndarray] | None = None, most: int = 2000) -> DataFrame:
    """``schema``: a page's score, its number, and a row of what ``reader`` makes of its ``(h, w, 4)`` pixels.

    The pixels are in a page's ``width``, ``height`` and ``rgba``.  Where
    ``pixels`` is given, it makes them of a row's columns in the task that reads
    them, so that no table of pixels is moved.  Rows are handed on when a page
    brings them to ``most``.
    """
    columns = ["score_id", "page", *([c for c in pages.columns if c not in ("score_id", "page")] if pixels else ["width", "height", "rgba"])]
    pixels = pixels or (lambda r: np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4))
    arrow = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for values in zip(*[_column(c) for c in b.columns]):
                r = dict(zip(columns, values))
                rows += [(r["score_id"], r["page"], *x) for x in reader(pixels(r))]
                if len(rows) >= most:
                    yield table(rows, arrow)
                    rows = []
            yield table(rows, arrow)

    return pages.select(*columns).mapInArrow(run, schema)


def read_page(rgba: np.ndarray, clef: str = "treble", fifths: int = 0, numerator: int = 4, denominator: int = 4, ppq: int = 480, octave_down: bool = False) -> list[dict]:
    """Notes of a page in order: measures follow each other staff by staff.

    A bar whose lengths are too long is repaired or moved to lengths that fill
    it (:func:`~tonelake.operators.assembly.fit_bar`); a short one stays.
    """
    ink = upright(rgba)
    middle = (TREBLE if clef == "treble" else BASS) - (7 if octave_down else 0)
    bar, out, number = ppq * 4 * numerator // denominator, [], 0
    for staff in staves(ink):
        clean = without_lines(ink, staff)
        cuts = barlines(ink, staff, clean)
        inner = [x for x in cuts if x < staff.right - staff.space]
        seen = heads(clean, staff, ink)
        for h in seen:
            s = stem(clean, h, staff.space)
            h["stem"] = None if s is None else (round(s[0]), s[1])
            h["step"] = int(np.floor((staff.middle - h["y"]) / (staff.space / 2) + 0.5))
            base = ppq * 4 if h["hollow"] else ppq
            if s is not None:
                base = ppq * 2 if h["hollow"] else ppq >> strokes(clean, s[0], s[1], s[1] < h["y"], staff.space)
            h["ticks"] = base
        edges = [staff.left - 1.0, *[x for x in inner if x > staff.left + staff.space], float(staff.right)]
        for a, b in zip(edges, edges[1:]):
            columns = onsets([h for h in seen if a < h["x"] <= b], staff.space)
            sizes = [min(h["ticks"] for h in group) for group in columns]
            none = [False] * len(columns)
            _, placed = fit_bar(sizes, [1.0] * len(columns), none, none, bar, ppq)
            for group, size, (start, length) in zip(columns, sizes, placed):
                for h in group:
                    out.append({"measure": number, "pitch": pitch_of(h["step"], middle, fifths), "start": number * bar + start, "duration": h["ticks"] * length // size, "x": h["x"], "y": h["y"]})
            number += 1
    return out


NOTES = "score_id long, page int, measure int, note_ord int, pitch int, start_tick long, duration long, x double, y double"


def recognise(pages: DataFrame, **settings) -> DataFrame:
    """Notes of ``(score_id, page, width, height, rgba)`` pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, page, w, h, data in zip(b["score_id"], b["page"], b["width"], b["height"], b["rgba"]):
                for i, n in enumerate(read_page(np.frombuffer(data, np.uint8).reshape(h, w, 4), **settings)):
                    rows.append((sid, page, n["measure"], i, n["pitch"], n["start"], n["duration"], n["x"], n["y"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NOTES.split(", ")])

    return pages.select("score_id", "page", "width", "height", F.col("rgba")).mapInPandas(run, NOTES)
