"""Tuplets on a page: brackets found as strokes with a gap for their digit, bare digits over beams, and the heads they hold.

Strokes come from a Hough transform of runs: every horizontal run of thin ink
votes, with its length, for the near-horizontal lines through its middle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache, lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import glyphs, omr

#: Slopes a bracket may have, and how far, in staff spaces, ink may lie from a stroke's line.
SLOPES = np.linspace(-0.2, 0.2, 33)
NEAR = 0.25
#: Rows above and below a staff in which its tuplets stand, in staff spaces.
BAND = 8.0
#: Thickest stroke, shortest stroke, and widest gap, in staff spaces.
THIN, SHORTEST, GAP = 0.35, 2.0, 3.2
#: Least length of the hook at a bracket's end, and the height a digit has, in staff spaces.
HOOK, LOW, HIGH = 0.4, 0.55, 1.9
#: How far a bare digit stands beyond the ends of stems, and a bracket, in staff spaces.
BARE, BEYOND = 2.4, 5.0
DIGITS = (2, 3, 4, 5, 6, 7, 9)


def drawn_digit(n: int, space: float) -> np.ndarray:
    """A plain drawing of a digit 1.4 spaces high, trimmed."""
    a = np.zeros((int(3 * space), int(3 * space)), bool)

    def line(*points: tuple[float, float]) -> None:
        for (x0, y0), (x1, y1) in zip(points, points[1:]):
            glyphs._stroke(a, *[v * space for v in (0.8 + x0, 0.8 + y0, 0.8 + x1, 0.8 + y1)], 0.2 * space)

    def bow(cx: float, cy: float, rx: float, ry: float, start: float, end: float) -> None:
        angles = np.linspace(np.radians(start), np.radians(end), 16)
        line(*[(cx + rx * np.sin(t), cy - ry * np.cos(t)) for t in angles])  # clockwise from the top

    if n == 2:
        bow(0.4, 0.4, 0.4, 0.4, -80, 120), line((0.74, 0.6), (0.0, 1.4), (0.8, 1.4))
    elif n == 3:
        bow(0.35, 0.35, 0.38, 0.35, -60, 180), bow(0.35, 1.03, 0.42, 0.36, 0, 245)
    elif n == 4:
        line((0.7, 1.4), (0.7, 0.0), (0.0, 0.95), (0.95, 0.95))
    elif n == 5:
        line((0.75, 0.0), (0.1, 0.0), (0.05, 0.6)), bow(0.35, 0.95, 0.42, 0.43, -45, 240)
    elif n == 6:
        bow(0.4, 1.0, 0.38, 0.38, 0, 360), line((0.03, 1.0), (0.15, 0.45), (0.6, 0.0))
    elif n == 7:
        line((0.0, 0.0), (0.8, 0.0), (0.25, 1.4))
    elif n == 9:
        bow(0.4, 0.4, 0.38, 0.38, 0, 360), line((0.77, 0.4), (0.65, 0.95), (0.2, 1.4))
    y, x = np.flatnonzero(a.any(1)), np.flatnonzero(a.any(0))
    return a[y[0] : y[-1] + 1, x[0] : x[-1] + 1]


_PROTOTYPES: dict[int, list[np.ndarray]] = {}


def digit(box: np.ndarray, most: float = 2.2) -> int | None:
    """The digit whose prototype is nearest in topology and proportions, whatever its size; none beyond ``most``, nor for a block of ink."""
    return _digit(*glyphs.packed(box), most)


@lru_cache(maxsize=4096)
def _digit(bits: bytes, h: int, w: int, most: float) -> int | None:
    box = glyphs.unpacked(bits, h, w)
    if box.mean() > 0.75:
        return None
    if not _PROTOTYPES:
        _PROTOTYPES.update({n: [glyphs.features(b, b.shape[0]) for b in (drawn_digit(n, d) for d in (8, 11, 15))] for n in DIGITS})
    f = glyphs.features(box, box.shape[0])
    far = {n: min(float(np.linalg.norm((f - p) * glyphs.WEIGHTS)) for p in ps) for n, ps in _PROTOTYPES.items()}
    best = min(far, key=far.get)
    return best if far[best] <= most else None


def strokes(ink: np.ndarray, d: float) -> list[dict]:
    """Thin near-horizontal strokes, those of most ink first: ``x0``, ``x1``, ``slope``, ``at`` (the row at column 0), and ``gaps``, ranges of columns without ink."""
    column, start, end = omr.column_runs(ink)
    thick = end - start > THIN * d + 1
    start, high = start[thick], (end - start)[thick]
    thin = ink.copy()
    thin[np.arange(high.sum()) + (start - high.cumsum() + high).repeat(high), column[thick].repeat(high)] = False
    found = np.stack(omr.row_runs(thin), 1).astype(float)
    found = found[found[:, 2] - found[:, 1] >= 0.3 * d]
    cell = 0.1 * d
    middle = (found[:, 1] + found[:, 2] - 1) / 2
    places = found[:, :1] - SLOPES * middle[:, None]  # the row at column 0, for each slope
    bins = np.floor(places / cell + 0.5).astype(int)
    lengths = found[:, 2] - found[:, 1]
    row, begins, ends, inked = found[:, 0].copy(), found[:, 1].tolist(), found[:, 2].tolist(), lengths.tolist()
    size = lambda chain: sum(map(inked.__getitem__, chain))
    low = int(bins.min(initial=0)) - 2
    tall = int(bins.max(initial=0)) - low + 3
    cells = (bins - low) + np.arange(len(SLOPES)) * tall  # slope by slope
    votes = np.bincount(cells.ravel(), np.repeat(lengths, len(SLOPES)), len(SLOPES) * tall).reshape(len(SLOPES), tall)
    about = votes.copy()
    about[:, 1:] += votes[:, :-1]
    about[:, :-1] += votes[:, 1:]
    about = np.pad(np.where(votes > 0, about, 0.0), 1)
    around = np.max([about[1 + i : 1 + i + len(SLOPES), 1 + j : 1 + j + tall] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    # A cell below its neighbours leads to the stroke theirs lead to.
    peaks = (votes > 0) & (about[1:-1, 1:-1] >= SHORTEST * d) & (around <= about[1:-1, 1:-1])
    # Runs by the cell they vote for, slope by slope.
    flat = cells.T.ravel()
    order = flat.argsort(kind="stable")
    flat, voters = flat[order], order % max(1, len(found))

    fits: dict[tuple[int, ...], tuple[float, float, tuple[int, ...]]] = {}

    def fitted(chain: tuple[int, ...]) -> tuple[float, float, tuple[int, ...]]:
        """Slope and place of the line through a chain's runs, and the chain of runs near it: many cells lead to one chain."""
        if chain not in fits:
            mine = list(chain)
            slope, at = _line(found[mine].tobytes())
            x0, x1 = min(begins[k] for k in mine) - GAP * d, max(ends[k] for k in mine) + GAP * d
            mine = (np.abs(row - at - slope * middle) <= NEAR * d).nonzero()[0].tolist()
            fits[chain] = slope, at, tuple(max(_chains(begins, ends, [k for k in mine if begins[k] >= x0 and ends[k] <= x1], GAP * d), key=size, default=[]))
        return fits[chain]

    @cache
    def led(chain: tuple[int, ...]) -> tuple[float, float, tuple[int, ...]] | None:
        """Where a chain leads: the line is fitted to its runs, and takes those near it; none if that is no stroke."""
        slope = at = 0.0
        for _ in range(10):
            if size(chain) < SHORTEST * d:
                return None
            before = chain
            slope, at, chain = fitted(chain)
            if chain == before:
                break
        return (slope, at, chain) if size(chain) >= SHORTEST * d and abs(slope) <= 1.2 * SLOPES[-1] else None

    @cache
    def seeded(runs: tuple[int, ...]) -> list[tuple[float, float, tuple[int, ...]]]:
        """What the chains of the runs about a cell lead to: many cells hold the same runs."""
        return [x for mine in _chains(begins, ends, runs, GAP * d) if (x := led(tuple(mine))) is not None]

    lines: dict[tuple[int, ...], tuple[float, float]] = {}
    s_of, b_of = np.nonzero(peaks)
    at_cell = s_of * tall + b_of
    first = voters[flat.searchsorted(at_cell)].tolist()
    near = zip(flat.searchsorted(at_cell - 1).tolist(), flat.searchsorted(at_cell + 1, "right").tolist())
    for _, _, _, (lo, hi) in sorted(zip(first, s_of.tolist(), b_of.tolist(), near)):
        for slope, at, chain in seeded(tuple(voters[lo:hi].tolist())):
            lines[chain] = (slope, at)
    # The strokes of most ink first; each run belongs to one.
    free, out = np.ones(len(found), bool), []
    for chain in sorted(lines, key=lambda c: (-size(c), c)):
        mine = list(chain)
        if free[mine].all():
            free[mine] = False
            covered = omr.runs(_columns(found, mine))
            out.append({"x0": covered[0][0], "x1": covered[-1][1], "slope": lines[chain][0], "at": lines[chain][1], "gaps": [(p, q) for (_, p), (q, _) in zip(covered, covered[1:]) if q - p > 2]})
    return out


@lru_cache(maxsize=4096)
def _line(runs: bytes) -> tuple[float, float]:
    """Slope and place at column 0 of the line through runs (row, start and end of each), a run weighing as much as it is long."""
    row, start, end = np.frombuffer(runs).reshape(-1, 3).T
    middle = (start + end - 1) / 2
    if (middle == middle[0]).all():
        return 0.0, float(row.mean())
    slope, at = np.polyfit(middle, row, 1, w=np.sqrt(end - start))
    return float(slope), float(at)


def _chains(begins: list[float], ends: list[float], mine: Iterable[int], most: float) -> list[list[int]]:
    """Runs from left to right, parted where a gap is too wide."""
    out: list[list[int]] = []
    end = -np.inf
    for k in sorted(mine, key=begins.__getitem__):
        if begins[k] - end > most:
            out.append([])
        out[-1].append(k)
        end = max(end, ends[k]) if len(out[-1]) > 1 else ends[k]
    return out


def _columns(found: np.ndarray, chain: list[int]) -> np.ndarray:
    line = np.zeros(int(found[chain, 2].max()), bool)
    for k in chain:
        line[int(found[k, 1]) : int(found[k, 2])] = True
    return line


def hook(ink: np.ndarray, stroke: dict, d: float) -> int:
    """1 if both ends of a stroke go down, -1 if both go up, else 0."""
    def reach(x: float, sign: int) -> int:
        y, near = int(round(stroke["at"] + stroke["slope"] * x)), slice(max(0, int(x) - 3), min(ink.shape[1], int(x) + 4))
        part = ink[y:, near] if sign > 0 else ink[: y + 1, near][::-1]
        if not part.size:
            return 0
        skip = part[:3].argmax(0)  # of the first rows white ones are passed over
        down = part | (np.arange(len(part))[:, None] < skip)
        return int((np.where(down.all(0), len(part), down.argmin(0)) - skip).max())

    for sign in (1, -1):
        if all(reach(x, sign) >= HOOK * d + 2 and reach(x, -sign) < HOOK * d + 2 for x in (stroke["x0"], stroke["x1"] - 1)):
            return sign
    return 0


def marks(clean: np.ndarray, staff: omr.Staff) -> list[dict]:
    """Brackets with a digit, and digits alone, outside a staff: ``number``, ``x0``, ``x1``, ``y``, ``side`` (-1 above the heads it belongs to, 1 under them, 0 for a digit alone)."""
    d = staff.space
    outside = lambda c: c["y1"] < staff.lines[0] - 0.2 * d or c["y0"] > staff.lines[4] + 0.2 * d
    digits, bare = [], clean.copy()
    bare[max(0, int(staff.lines[0])) : int(staff.lines[4]) + 1] = False  # strokes are sought outside the staff
    for c in omr.components(clean):
        if LOW * d <= c["y1"] - c["y0"] <= HIGH * d and 0.3 * d <= c["x1"] - c["x0"] <= 1.4 * d and c["area"] >= 0.12 * d * d and outside(c):
            n = digit(clean[c["y0"] : c["y1"], c["x0"] : c["x1"]])
            if n is not None:
                bare[c["y0"] : c["y1"], c["x0"] : c["x1"]] = False
                digits.append({"number": n, "x": (c["x0"] + c["x1"] - 1) / 2, "y": (c["y0"] + c["y1"] - 1) / 2, "used": False})
    out = []
    for s in strokes(bare, d) if digits else ():
        side = -hook(bare, s, d)
        middle = (s["x0"] + s["x1"] - 1) / 2
        y = s["at"] + s["slope"] * middle
        inside = [g for g in s["gaps"] if abs((g[0] + g[1] - 1) / 2 - middle) <= 0.15 * (s["x1"] - s["x0"])]
        if side and len(s["gaps"]) == len(inside) <= 1:
            # In the gap, or, where there is none, just over or under the middle.
            reach = 0.9 if inside else 2.2
            near = [g for g in digits if not g["used"] and abs(g["x"] - middle) <= 0.9 * d and abs(g["y"] - y) <= reach * d]
            if near:
                g = min(near, key=lambda g: abs(g["x"] - middle))
                g["used"] = True
                out.append({"number": g["number"], "x0": s["x0"], "x1": s["x1"], "y": y, "side": side})
    return out + [{"number": g["number"], "x0": g["x"], "x1": g["x"], "y": g["y"], "side": 0} for g in digits if not g["used"]]


def beamed(ink: np.ndarray, a: dict, b: dict, d: float) -> bool:
    """Whether a beam, thicker than a stroke, runs between the ends of two stems of one direction."""
    (xa, ya), (xb, yb) = a["stem"], b["stem"]
    up = ya < a["y"]
    if up != (yb < b["y"]) or not 0.8 * d <= xb - xa <= 8 * d:
        return False
    x = np.arange(int(xa), int(xb) + 1)
    y = ya + (yb - ya) * (x - xa) / (xb - xa) + (0.2 if up else -0.2) * d
    rows = np.clip((y + np.array([[-0.1], [0.0], [0.1]]) * d).astype(int), 0, len(ink) - 1)
    return bool((ink[rows, x].mean(1) >= 0.95).all())


def on_beam(clean: np.ndarray, head: dict, d: float) -> bool:
    """Whether the ink at a head's middle runs on to a side as no head does: where a stem meets a beam."""
    row, x = clean[int(head["y"])], int(head["x"])
    return any(b - a > 2.4 * d for a, b in omr.runs(row) if a <= x < b)


HEADS = "score_id long, page int, staff int, head int, x double, step int, beamed boolean, number int, mark string, tuplet int"


def read_tuplets(rgba: np.ndarray) -> list[tuple]:
    """Heads of a page from left to right: whether beamed, and the number, the kind of mark (``bracket``, ``bare``) and the count on its staff of the tuplet each is in.

    A digit alone is a tuplet only if it is a 3 beyond the beam of exactly three heads, over or under their middle.
    """
    page = omr.upright(rgba)
    out = []
    for number, whole in enumerate(omr.staves(page)):
        d = whole.space
        above = max(0, int(whole.lines[0] - BAND * d))
        ink = page[above : int(whole.lines[4] + BAND * d)]
        staff = omr.Staff([y - above for y in whole.lines], whole.left, whole.right, d, whole.thick)
        clean = omr.without_lines(ink, staff)
        heads = [h | {"stem": s} for h in omr.heads(clean, staff, ink) if not on_beam(clean, h, d) and (s := omr.stem(clean, h, d)) is not None]
        links = [beamed(ink, a, b, d) for a, b in zip(heads, heads[1:])]
        held: dict[int, tuple[int, str, int]] = {}
        for n, m in enumerate(sorted(marks(clean, staff), key=lambda m: m["x0"])):
            if m["side"]:
                ends = [min(h["y"], h["stem"][1]) if m["side"] < 0 else max(h["y"], h["stem"][1]) for h in heads]
                mine = [i for i, h in enumerate(heads) if m["x0"] - 0.6 * d <= h["x"] <= m["x1"] + 0.6 * d and 0 < m["side"] * (m["y"] - ends[i]) <= BEYOND * d]
                kind = "bracket"
            else:
                mine, kind = [], "bare"
                for i in range(len(heads) - 2):
                    three = heads[i : i + 3]
                    alone = not (i and links[i - 1]) and not (i + 2 < len(links) and links[i + 2])
                    side = 1 if three[1]["stem"][1] > three[1]["y"] else -1
                    middle = (three[0]["stem"][0] + three[2]["stem"][0]) / 2
                    if m["number"] == 3 and alone and links[i] and links[i + 1] and abs(m["x0"] - middle) <= 0.8 * d and 0 < side * (m["y"] - three[1]["stem"][1]) <= BARE * d:
                        mine = [i, i + 1, i + 2]
            held |= {i: (m["number"], kind, n) for i in mine if i not in held}
        order = {n: k for k, n in enumerate(dict.fromkeys(held[i][2] for i in sorted(held)))}
        for i, h in enumerate(heads):
            n, kind, at = held.get(i, (None, None, None))
            step = int(np.floor((staff.middle - h["y"]) / (d / 2) + 0.5))
            out.append((number, i, h["x"], step, (i > 0 and links[i - 1]) or (i < len(links) and links[i]), n, kind, None if at is None else order[at]))
    return out


def tuplets(pages: DataFrame, pixels: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """Heads with a stem of ``(score_id, page, width, height, rgba)`` pages, or of pages that ``pixels`` makes (:func:`~tonelake.operators.omr.by_page`), and the tuplet each is in (null: none); a page without staves gives no rows."""
    return omr.by_page(pages, read_tuplets, HEADS, pixels)
