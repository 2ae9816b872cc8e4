"""ASCII tablature of fingered notes."""

from __future__ import annotations

from bisect import bisect_right

from ..functions.theory import FLATS, SHARPS
from ..operators.tab import Guitar

# Fixed values.
DIVISIONS = (4, 8, 12, 6, 24, 16, 48)
MARKS = (("hammer", "h"), ("pull", "p"), ("slide", "/"), ("bend", "b"))


def grid_unit(ppq: int, ticks: list[float]) -> float:
    """The first division of a quarter on which all ticks lie, else an eighth of it."""
    for d in DIVISIONS:
        u = ppq / d
        if ppq % d == 0 and all(abs(t / u - int(t / u + 0.5)) < 1e-6 for t in ticks):
            return u
    return ppq / 8


def _names(guitar: Guitar) -> tuple[str, ...]:
    return FLATS if any(p % 12 in (3, 8, 10) for p in guitar.tuning) else SHARPS


def string_labels(guitar: Guitar) -> list[str]:
    raw = [_names(guitar)[p % 12] for p in guitar.tuning]
    width = max(map(len, raw))
    return [(r.lower() if i == 0 and len(r) == 1 else r).ljust(width) for i, r in enumerate(raw)]


class _Bar:
    """One measure's grid: a fret and a trailing mark per string and column."""

    def __init__(self, start: float, end: float, unit: float, strings: int):
        self.start, self.unit = start, unit
        self.columns = max(1, int(-(-((end - start) / unit - 1e-6) // 1)))
        self.frets: list[dict[int, int]] = [{} for _ in range(strings)]
        self.marks: list[dict[int, str]] = [{} for _ in range(strings)]

    def column(self, tick: float) -> int:
        return min(self.columns - 1, max(0, int((tick - self.start) / self.unit + 0.5)))

    def widths(self) -> list[int]:
        return [max([1, *(len(str(s[c])) for s in self.frets if c in s)]) for c in range(self.columns)]

    def offsets(self) -> list[int]:
        out = [0]
        for w in self.widths():
            out.append(out[-1] + w + 1)
        return out

    def line(self, s: int) -> str:
        return "".join((str(self.frets[s][c]) if c in self.frets[s] else "").rjust(w, "-") + self.marks[s].get(c, "-") for c, w in enumerate(self.widths())) + "|"


def render(notes: list[dict], bars: list[tuple[float, float]], guitar: Guitar = Guitar(), ppq: int = 480, title: str = "Untitled", tuning_name: str = "Standard (EADGBE)", per_line: int = 4, chords: list[tuple[float, str]] | None = None) -> str:
    """The tab as text.

    ``notes`` have start, string, fret and articulations, ``bars`` are the
    measures' bounds.  Frets are shown from the capo; ``chords`` are
    ``(tick, name)``, a name that would overlap the one before is left out.
    """
    names = _names(guitar)
    out = [title, f"Tuning: {' '.join(names[p % 12] for p in reversed(guitar.tuning))} ({tuning_name})   Capo: {guitar.capo or 'none'}", ""]
    if not bars:
        return "\n".join(out)
    unit = grid_unit(ppq, [n["start"] for n in notes] + [b[0] for b in bars] + [t for t, _ in chords or []])
    grids = [_Bar(a, b, unit, len(guitar.tuning)) for a, b in bars]
    starts = [a for a, _ in bars]

    def home(tick: float) -> int | None:
        i = bisect_right(starts, tick) - 1
        return i if i >= 0 and tick < bars[i][1] else None

    by_string: dict[int, list] = {}
    for n in notes:
        i = home(n["start"])
        if i is None or n["string"] is None or n["string"] >= len(guitar.tuning):
            continue
        c = grids[i].column(n["start"])
        grids[i].frets[n["string"]][c] = n["fret"] - guitar.capo
        by_string.setdefault(n["string"], []).append((n["start"], i, c, n.get("articulations") or []))
    for s, placed in by_string.items():
        placed.sort(key=lambda x: x[0])
        for (t0, i0, c0, a0), (t1, i1, c1, a1) in zip(placed, placed[1:]):
            mark = next((m for k, m in MARKS if k in a0 or k in a1), None)
            if mark and t1 != t0 and i0 == i1 and c1 > c0:
                grids[i1].marks[s][c1 - 1] = mark
    labels = string_labels(guitar)
    for first in range(0, len(bars), per_line):
        lines = [f"{x}|" for x in labels]
        above = " " * (len(labels[0]) + 1)
        for i in range(first, min(first + per_line, len(bars))):
            base, offsets = len(lines[0]), grids[i].offsets()
            lines = [line + grids[i].line(s) for s, line in enumerate(lines)]
            for tick, name in sorted(chords or []):
                if home(tick) == i:
                    at = base + offsets[grids[i].column(tick)]
                    if len(above) <= at:
                        above = above.ljust(at) + name + " "
            above = above.ljust(len(lines[0]))
        if chords is not None:
            out.append(above.rstrip())
        out += [*lines, ""]
    return "\n".join(out).rstrip("\n") + "\n"
