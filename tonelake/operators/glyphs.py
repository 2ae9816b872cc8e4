"""Shapes on a page: what a connected piece of ink is, which heads an arc ties, and which staves stand together.

A piece of ink is described by its topology (holes, by the Euler number of its
run-length components; how often lines across it meet ink) and its proportions
in staff spaces, and is what its nearest prototype is.  An arc is a shortest
path through the columns between two heads.  Staves are joined by vertical ink
between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import omr

KINDS = ("sharp", "flat", "natural", "quarter_rest", "eighth_rest", "block_rest", "dot", "treble", "bass")
# How far an accidental or a dot stands from its head, in staff spaces.
BEFORE_HEAD, AFTER_HEAD = 2.6, 1.9
#: Rows above and below a staff that belong to it, in staff spaces.
BAND = 6.0
#: A path is an arc if so much of it is ink, and if it bows so far, in staff spaces, between its ends.
INK, BOW = 0.82, 0.2
#: So much of it has to be ink that is not a staff line's: of a tie, and of a slur to another place, which crosses lines.
OWN, OWN_SLUR = 0.42, 0.3
#: Staves stand together if a column between them has so much ink; a brace needs less where the gap is small.
JOINED, BRACED = 0.9, 0.7
APART, NEAR = 30.0, 14.0


def holes(box: np.ndarray) -> int:
    """White areas that ink encloses: components of ink less its Euler number, which runs of rows give.

    Runs less contacts of runs in neighbouring rows (8-connected) is the Euler
    number of the ink, components less holes.
    """
    around = np.pad(box, 1)
    box = box | (around[:-2, 1:-1] & around[2:, 1:-1] & around[1:-1, :-2] & around[1:-1, 2:])  # a lone white pixel is no hole
    y, a, b = omr.row_runs(box)
    p, q = omr.contacts(y, a, b)
    pieces = np.count_nonzero(omr.joined(len(y), p, q) == np.arange(len(y)))
    return int(pieces) - (len(y) - len(p))


def crossings(box: np.ndarray) -> list[int]:
    """How often three rows and three columns, at a quarter, half and three quarters, meet ink."""
    h, w = box.shape
    at = lambda n: [min(n - 1, int(n * f)) for f in (0.25, 0.5, 0.75)]
    return [omr.crossed(box[y]) for y in at(h)] + [omr.crossed(box[:, x]) for x in at(w)]


#: What a step of each feature weighs: height and width in spaces, holes, crossings, fill, and the share of ink above, left and in the middle.
WEIGHTS = np.array([2.4, 1.6, 1.2, *[0.5] * 3, *[0.35] * 3, 1.0, 3.0, 3.0, 2.0])


def features(box: np.ndarray, space: float) -> np.ndarray:
    h, w = box.shape
    total = max(1, int(box.sum()))
    share = lambda part: part.sum() / total
    return np.array([np.log2(max(h / space, 0.05)), np.log2(max(w / space, 0.05)), min(holes(box), 3), *[min(c, 4) for c in crossings(box)], total / (h * w), share(box[: h // 2]), share(box[:, : w // 2]), share(box[h // 4 : h - h // 4])])


def _stroke(a: np.ndarray, x0: float, y0: float, x1: float, y1: float, thick: float) -> None:
    """Ink within half of ``thick`` of a segment."""
    y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
    length = max(1e-9, (x1 - x0) ** 2 + (y1 - y0) ** 2)
    t = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length, 0, 1)
    a |= (x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2 <= (thick / 2) ** 2


def drawn(kind: str, space: float) -> np.ndarray:
    """A plain drawing of a symbol at a size, trimmed: the prototypes, and what test pages are made of."""
    d = space
    a = np.zeros((int(9 * d), int(6 * d)), bool)
    line = lambda *xy, t=0.22: _stroke(a, *[v * d for v in xy], t * d)
    if kind == "sharp":
        line(1.35, 1.15, 1.35, 3.8), line(1.75, 1.0, 1.75, 3.65)
        line(1.05, 2.1, 2.05, 1.8, t=0.36), line(1.05, 3.0, 2.05, 2.7, t=0.36)
    elif kind == "natural":
        line(1.3, 1.0, 1.3, 3.2), line(1.85, 1.7, 1.85, 3.9)
        line(1.3, 2.05, 1.85, 1.85, t=0.36), line(1.3, 3.05, 1.85, 2.85, t=0.36)
    elif kind == "flat":
        line(1.2, 1.0, 1.2, 3.4)
        for k in range(12):
            u, v = k * np.pi / 12, (k + 1) * np.pi / 12
            line(1.25 + 0.6 * np.sin(u), 2.85 - 0.55 * np.cos(u), 1.25 + 0.6 * np.sin(v), 2.85 - 0.55 * np.cos(v), t=0.26)
    elif kind == "quarter_rest":
        line(1.2, 1.0, 1.9, 1.9, t=0.34), line(1.9, 1.9, 1.35, 2.5, t=0.5), line(1.35, 2.5, 2.0, 3.3, t=0.34), line(2.0, 3.3, 1.35, 3.3, t=0.42), line(1.35, 3.3, 1.65, 3.9, t=0.3)
    elif kind == "eighth_rest":
        line(1.3, 1.45, 1.32, 1.45, t=0.6), line(1.35, 1.65, 2.0, 1.45, t=0.2), line(2.0, 1.4, 1.55, 2.9, t=0.22)
    elif kind == "block_rest":
        a[int(2 * d) : int(2.5 * d) + 1, int(1.2 * d) : int(2.5 * d) + 1] = True
    elif kind == "dot":
        line(1.5, 1.5, 1.5, 1.5, t=0.42)
    elif kind == "treble":
        line(2.2, 0.8, 2.0, 7.0), line(2.0, 7.0, 1.6, 7.1, t=0.4)
        for cx, cy, r in ((2.1, 4.6, 1.0), (2.15, 4.7, 0.45)):
            for k in range(20):
                u, v = k * np.pi / 10, (k + 1) * np.pi / 10
                line(cx + r * np.cos(u), cy + r * np.sin(u), cx + r * np.cos(v), cy + r * np.sin(v), t=0.22)
        for k in range(12):
            u, v = k * np.pi / 6, (k + 1) * np.pi / 6
            line(2.35 + 0.35 * np.cos(u), 1.7 + 0.8 * np.sin(u), 2.35 + 0.35 * np.cos(v), 1.7 + 0.8 * np.sin(v), t=0.2)
    elif kind == "bass":
        line(1.4, 2.0, 1.42, 2.0, t=0.7)
        for k in range(14):
            u, v = np.pi + k * np.pi * 1.35 / 14, np.pi + (k + 1) * np.pi * 1.35 / 14
            line(2.1 + 0.9 * np.cos(u), 2.1 + 0.95 * np.sin(u), 2.1 + 0.9 * np.cos(v), 2.1 + 0.95 * np.sin(v), t=0.3)
        line(2.5, 2.95, 1.4, 4.0, t=0.26)
    y, x = np.flatnonzero(a.any(1)), np.flatnonzero(a.any(0))
    return a[y[0] : y[-1] + 1, x[0] : x[-1] + 1]


_PROTOTYPES: dict[str, list[np.ndarray]] = {}


def prototypes() -> dict[str, list[np.ndarray]]:
    """Features of each kind, drawn at a few sizes."""
    if not _PROTOTYPES:
        _PROTOTYPES.update({k: [features(drawn(k, d), d) for d in (8, 10, 14)] for k in KINDS})
    return _PROTOTYPES


def classify(box: np.ndarray, space: float, most: float = 3.2) -> str | None:
    """The kind whose prototype is nearest; none is near enough beyond ``most``."""
    return _classified(*packed(box), space, most)


def packed(box: np.ndarray) -> tuple[bytes, int, int]:
    """A shape's pixels and size, by which what was told of it is found again: the same shapes come over and over."""
    return np.packbits(box).tobytes(), *box.shape


def unpacked(bits: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=h * w).view(bool).reshape(h, w)


@lru_cache(maxsize=4096)
def _classified(bits: bytes, h: int, w: int, space: float, most: float) -> str | None:
    f = features(unpacked(bits, h, w), space)
    far = {k: min(float(np.linalg.norm((f - p) * WEIGHTS)) for p in ps) for k, ps in prototypes().items()}
    best = min(far, key=far.get)
    return best if far[best] <= most else None


def pieces(clean: np.ndarray, staff: omr.Staff, heads: list[dict], bars: list[float], found: list[tuple] = ()) -> list[dict]:
    """``(kind, x, y, x0, x1)`` of the symbols of a staff that are neither heads nor barlines.

    ``clean`` is the page without lines.  Pieces that touch a head go with it,
    those that lie along one of the arcs ``found`` with that.
    """
    d = staff.space
    along = np.zeros(clean.shape, bool)
    reach = max(1, int(0.25 * d))
    for _, _, columns, rows in found:
        for x, y in zip(columns, rows):
            along[max(0, y - reach) : y + reach + 1, max(0, x - 1) : x + 2] = True
    top, bottom = max(0, int(staff.lines[0] - 3.5 * d)), min(clean.shape[0], int(staff.lines[4] + 3.5 * d))
    area = clean[top:bottom]
    out = []
    for c in omr.components(area):
        y0, y1, x0, x1 = c["y0"] + top, c["y1"] + top, c["x0"], c["x1"]
        if x0 < staff.left or x1 > staff.right or (x1 - x0) * (y1 - y0) < 0.06 * d * d or (x1 - x0) > 4 * d:
            continue
        if any(x0 - 0.1 * d <= h["x"] <= x1 + 0.1 * d and y0 - 0.1 * d <= h["y"] <= y1 + 0.1 * d for h in heads) or any(x0 - 2 <= b <= x1 + 1 and y1 - y0 > 3.5 * d for b in bars):
            continue
        box = clean[y0:y1, x0:x1]
        if (along[y0:y1, x0:x1] & box).sum() > 0.5 * box.sum():
            continue
        kind = classify(box, d)
        if kind is not None:
            out.append({"kind": kind, "x": (x0 + x1 - 1) / 2, "y": (y0 + y1 - 1) / 2, "x0": x0, "x1": x1, "y0": y0, "y1": y1})
    return sorted(out, key=lambda p: p["x"])


#: A clef stands within so many spaces of a staff's left edge; its pieces, parted by the lines, lie this near each other.
CLEF_ZONE, CLEF_GAP = 7.0, 0.35


def clef(clean: np.ndarray, staff: omr.Staff) -> dict | None:
    """The clef of a staff: pieces of ink at its left edge put together and read as one shape."""
    d = staff.space
    top, bottom = max(0, int(staff.lines[0] - 2.5 * d)), min(clean.shape[0], int(staff.lines[4] + 2.5 * d))
    x1 = min(clean.shape[1], int(staff.left + CLEF_ZONE * d))
    near = [c for c in omr.components(clean[top:bottom, staff.left + int(0.6 * d) : x1]) if c["area"] >= 0.02 * d * d]
    groups: list[list[dict]] = []
    for c in near:
        meets = lambda o, c=c: c["x0"] - CLEF_GAP * d <= o["x1"] and o["x0"] <= c["x1"] + CLEF_GAP * d and c["y0"] - CLEF_GAP * d <= o["y1"] and o["y0"] <= c["y1"] + CLEF_GAP * d
        mine = [g for g in groups if any(meets(o) for o in g)]
        groups = [g for g in groups if not any(g is m for m in mine)] + [[c, *(o for g in mine for o in g)]]
    for g in sorted(groups, key=lambda g: min(c["x0"] for c in g)):
        x0, x2, y0, y1 = (f(c[k] for c in g) for f, k in ((min, "x0"), (max, "x1"), (min, "y0"), (max, "y1")))
        left = staff.left + int(0.6 * d)
        kind = classify(clean[top + y0 : top + y1, left + x0 : left + x2], d, most=6.0)
        if kind in ("treble", "bass") and y1 - y0 > 2.2 * d:
            return {"kind": kind, "x": left + (x0 + x2 - 1) / 2, "y": top + (y0 + y1 - 1) / 2, "x0": left + x0, "x1": left + x2}
    return None


def path_between(weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, float]:
    """The cheapest path of one row a column, rising or falling at most one row a column, and its cost.

    ``weight`` is the price of each pixel; ``start`` and ``end`` the price of
    beginning and ending in each row.
    """
    rows, n = weight.shape
    price, costs = np.ascontiguousarray(weight.T), np.full((n, rows + 2), np.inf)
    costs[0, 1:-1] = start + price[0]
    aside, least = np.empty(rows + 2), np.empty(rows)
    for x in range(1, n):
        before = costs[x - 1]
        np.add(before, 0.05, out=aside)
        np.minimum(aside[:-2], before[1:-1], out=least)
        np.minimum(least, aside[2:], out=least)
        np.add(least, price[x], out=costs[x, 1:-1])
    total = costs[-1, 1:-1] + end
    path = np.empty(n, int)
    path[-1] = row = int(total.argmin())
    for x in range(n - 1, 0, -1):
        above, same, below = costs[x - 1, row : row + 3].tolist()
        above, below = above + 0.05, below + 0.05
        row += -1 if above <= same and above <= below else 0 if same <= below else 1
        path[x - 1] = row
    return path, float(total.min())


def arc(clean: np.ndarray, ink: np.ndarray, a: dict, b: dict, space: float, others: list[dict] = ()) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns and rows of an arc from head ``a`` to head ``b``, on the same side of both; none if there is none.

    It begins and ends close to the heads, is nearly all ink (a line that was
    taken out counts in part), and bows away from the straight line between its ends.
    """
    d = space
    x0, x1 = int(a["x"] + 0.8 * d + 0.5), int(b["x"] - 0.8 * d)
    if x1 - x0 < 0.8 * d:
        return None
    for sign in (-1, 1):
        # Rows from the heads' side outwards.
        near, far = (min, max) if sign > 0 else (max, min)
        rows = np.arange(int(near(a["y"], b["y"]) + sign * 0.45 * d + 0.5), int(far(a["y"], b["y"]) + sign * 2.6 * d), sign)
        rows = rows[(rows >= 0) & (rows < clean.shape[0])]
        if len(rows) < d:
            continue
        part, lines = clean[rows, x0 : x1 + 1], ink[rows, x0 : x1 + 1]
        weight = np.where(part, 0.0, np.where(lines, 0.2, 1.0))
        for h in others:  # no arc runs through a head
            weight[np.ix_(np.abs(rows - h["y"]) <= 0.5 * d, np.abs(np.arange(x0, x1 + 1) - h["x"]) <= 0.65 * d)] = len(weight[0])
        if 1 - weight.min(0).mean() < INK - 1e-9:  # no path has more ink than its columns
            continue
        least = OWN if a["step"] == b["step"] else OWN_SLUR
        if (part & (weight < 1)).any(0).mean() < least - 1e-9:  # nor more of its own, away from heads
            continue
        edge = lambda h, rows=rows, sign=sign: np.where((sign * (rows - h["y"]) >= 0.4 * d) & (sign * (rows - h["y"]) <= 1.4 * d), 0.0, np.inf)
        path, cost = path_between(weight, edge(a), edge(b))
        if not np.isfinite(cost):
            continue
        share = 1 - weight[path, np.arange(len(path))].mean()
        own, third = part[path, np.arange(len(path))].mean(), len(path) // 3
        if share >= INK and own >= least and path[third : len(path) - third].mean() - (path[0] + path[-1]) / 2 >= BOW * d:
            return np.arange(x0, x1 + 1), rows[path]
    return None


def arcs(clean: np.ndarray, ink: np.ndarray, heads: list[dict], space: float) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(head, head, columns, rows)`` of all arcs from a head, by place in ``heads`` (from left to right), to the next one and to the next on its line or space.

    Near heads come first: an arc that runs along ink of one found before is that one.
    """
    pairs = set()
    for i, h in enumerate(heads):
        later = [j for j in range(i + 1, len(heads)) if heads[j]["x"] - h["x"] > space]
        same = next((j for j in later if heads[j]["step"] == h["step"]), None)
        pairs |= {(j - i, i, j) for j in (same, later[0] if later else None) if j is not None}
    out, taken, reach = [], np.zeros(clean.shape, bool), max(1, int(0.3 * space))
    for _, i, j in sorted(pairs):
        found = arc(clean, ink, heads[i], heads[j], space, [h for k, h in enumerate(heads[i : j + 1], i) if k not in (i, j)])
        if found is not None and taken[found[1], found[0]].mean() < 0.3:
            out.append((i, j, *found))
            for x, y in zip(*found):
                taken[max(0, y - reach) : y + reach + 1, x] = True
    return out


def grouped(ink: np.ndarray, staves: list[omr.Staff]) -> list[tuple[int, int]]:
    """``(system, part)`` of each staff, from the top.

    Staves next to each other that are aligned stand together where a column
    just left of them, in the gap, is nearly all ink: a line that joins them, or
    a brace in a small gap.  Joined staves, directly or through others, are a
    system.
    """
    up = list(range(len(staves)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(1, len(staves)):
        p, s = staves[i - 1], staves[i]
        d = min(p.space, s.space)
        gap = s.lines[0] - p.lines[4]
        if abs(s.left - p.left) < 2 * d and abs(s.right - p.right) < 6 * d and gap < APART * d:
            y0, y1 = int(p.lines[4] + 0.3 * d), int(np.ceil(s.lines[0] - 0.3 * d)) + 1
            most = ink[y0:y1, max(0, int(p.left - 3 * d)) : int(p.left + 0.3 * d) + 1].mean(0).max(initial=0)
            if most >= JOINED or (most >= BRACED and gap < NEAR * d):
                up[find(i)] = find(i - 1)
    roots = [find(i) for i in range(len(staves))]
    order = {r: n for n, r in enumerate(dict.fromkeys(roots))}
    return [(order[r], roots[:i].count(r)) for i, r in enumerate(roots)]


def in_place(kind: str, x: float, y: float, heads: list[dict], staff: omr.Staff) -> bool:
    """Whether a symbol stands where one of its kind can: accidentals before a head and dots after one, at its height; rests about the middle of the staff, with no head over or under them."""
    d = staff.space
    if kind in ("sharp", "flat", "natural"):
        return any(0.8 * d <= h["x"] - x <= BEFORE_HEAD * d and abs(h["y"] - y) <= 0.8 * d for h in heads)
    if kind == "dot":
        return any(0.8 * d <= x - h["x"] <= AFTER_HEAD * d and abs(h["y"] - y) <= 0.8 * d for h in heads)
    alone = all(abs(x - h["x"]) >= 1.2 * d for h in heads)
    return alone and abs(y - staff.middle) <= (1.0 if kind in ("quarter_rest", "eighth_rest") else 1.5) * d


SYMBOLS = "score_id long, page int, staff int, system int, part int, kind string, x double, y double, step int, tied boolean"


def bands(rgba: np.ndarray) -> Iterator[tuple]:
    """Each staff of a page from the top: its number, system and part, its place, and the band of the page it is read in.

    A band is its first row, its ink, the staff within it, and its ink without the staff's lines.
    """
    page = omr.upright(rgba)
    staves = omr.staves(page)
    for number, (whole, (system, part)) in enumerate(zip(staves, grouped(page, staves))):
        # A staff is read in its own band of the page, so the work does not grow with the page's height.
        above = max(0, int(whole.lines[0] - BAND * whole.space))
        ink = page[above : int(whole.lines[4] + BAND * whole.space)]
        staff = omr.Staff([y - above for y in whole.lines], whole.left, whole.right, whole.space, whole.thick)
        yield number, system, part, whole, above, ink, staff, omr.without_lines(ink, staff)


def read_barlines(rgba: np.ndarray) -> list[tuple]:
    """Rows of a page's barlines, as :func:`read_symbols` has them: no other symbol is read."""
    return [(number, system, part, "barline", b, whole.middle, 0, False) for number, system, part, whole, _, ink, staff, clean in bands(rgba) for b in omr.barlines(ink, staff, clean)]


def read_symbols(rgba: np.ndarray) -> list[tuple]:
    """Rows of a page: staff, its system and part, kind of symbol, place, step from the middle line, and whether a tie from the left ends at a head."""
    out = []
    for number, system, part, whole, above, ink, staff, clean in bands(rgba):
        bars = omr.barlines(ink, staff, clean)
        heads = omr.heads(clean, staff, ink)
        key = clef(clean, staff)
        if key is not None:  # its loops are no heads
            heads = [h for h in heads if h["x"] > key["x1"]]
            out.append((number, system, part, key["kind"], key["x"], above + key["y"], 0, False))
        step = lambda y, s=staff: int(np.floor((s.middle - y) / (s.space / 2) + 0.5))
        kept = []
        for h in heads:
            stem = omr.stem(clean, h, staff.space)
            if stem is not None:
                kept.append(h | {"step": step(h["y"])})
        curves = arcs(clean, ink, kept, staff.space)
        ends = {b for a, b, *_ in curves if kept[a]["step"] == kept[b]["step"]}
        for i, h in enumerate(kept):
            out.append((number, system, part, "hollow" if h["hollow"] else "solid", h["x"], above + h["y"], h["step"], i in ends))
        for p in pieces(clean, staff, kept, bars, curves):
            kind = p["kind"]
            if kind in ("treble", "bass") or (key is not None and p["x"] <= key["x1"]):
                continue
            if kind == "block_rest":  # on the middle line, or under the line above it
                kind = "half_rest" if abs(p["y1"] - staff.lines[2]) < abs(p["y0"] - staff.lines[1]) else "whole_rest"
            # A flat is read where its bowl is.
            y = p["y1"] - 0.6 * staff.space if kind == "flat" else p["y"]
            if not in_place(kind, p["x"], y, kept, staff):
                continue
            out.append((number, system, part, kind, p["x"], above + y, step(y), False))
        out += [(number, system, part, "barline", b, whole.middle, 0, False) for b in bars]
    return out


def symbols(pages: DataFrame, pixels: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """Symbols of ``(score_id, page, width, height, rgba)`` pages, or of pages that ``pixels`` makes (:func:`~tonelake.operators.omr.by_page`); a page without staves gives no rows."""
    return omr.by_page(pages, read_symbols, SYMBOLS, pixels)


def barlines(pages: DataFrame, pixels: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """The barlines among the :func:`symbols` of pages, with their staves' systems and parts."""
    return omr.by_page(pages, read_barlines, SYMBOLS, pixels)
