"""The score that readers build, one file at a time, before it becomes rows."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

PPQ = 480
WHOLE = 4 * PPQ


class FormatError(ValueError):
    """A file that is not what it claims to be."""


def rounded(x: float) -> int:
    """Rounds halves up."""
    return int((x + 0.5) // 1)


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


@dataclass
class Note:
    pitch: int
    start: int
    duration: int
    velocity: int = 90
    voice: int = 0
    spelling: dict | None = None
    tab: dict | None = None
    locked: bool = False
    tied: bool = False
    articulations: list[str] | None = None
    confidence: float | None = None


@dataclass
class Track:
    id: str
    name: str
    program: int = 0
    notes: list[Note] = field(default_factory=list)
    target: bool = False


@dataclass
class Score:
    tracks: list[Track] = field(default_factory=list)
    meters: list[dict] = field(default_factory=list)
    keys: list[dict] = field(default_factory=list)
    tempos: list[dict] = field(default_factory=list)
    meta: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    ppq: int = PPQ

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)

    def change(self, kind: str, tick: int, **values) -> None:
        """Adds a change point: one at the last one's tick replaces it, an equal value is dropped."""
        items = getattr(self, kind)
        if items and items[-1]["tick"] == tick:
            items[-1] = {"tick": tick, **values}
        elif not items or any(items[-1][k] != v for k, v in values.items()):
            items.append({"tick": tick, **values})

    def settle(self) -> Score:
        """Default change points at tick 0, and everything in order."""
        for items, default in ((self.meters, {"numerator": 4, "denominator": 4}), (self.keys, {"fifths": 0, "mode": "major"}), (self.tempos, {"bpm": 120.0})):
            if not items or items[0]["tick"] > 0:
                items.insert(0, {"tick": 0, **default})
            items.sort(key=lambda x: x["tick"])
        for t in self.tracks:
            t.notes.sort(key=lambda n: (n.start, -n.pitch))
        return self

    def aim(self, drums: list[bool] | None = None) -> None:
        """Marks the guitar track: most notes among guitar programs, else most notes; drums never."""
        drums = drums or [False] * len(self.tracks)
        open_ = [t for t, d in zip(self.tracks, drums) if not d]
        guitars = [t for t in open_ if 24 <= t.program <= 31 and t.notes]
        if guitars or open_:
            max(guitars or open_, key=lambda t: len(t.notes)).target = True

    def as_dict(self) -> dict:
        return asdict(self)


def base_name(name: str) -> str:
    last = re.split(r"[\\/]", name)[-1]
    return last.rsplit(".", 1)[0] if last.rfind(".") > 0 else last


def extension(name: str) -> str:
    last = re.split(r"[\\/]", name)[-1]
    return last.rsplit(".", 1)[1].lower() if "." in last else ""


def decode(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("﻿")
