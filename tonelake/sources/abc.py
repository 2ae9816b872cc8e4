"""ABC notation: the first tune of a file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

from .score import WHOLE, Note, Score, Track, clamp, rounded

# Fixed values.
_STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
_SHARPS, _FLATS = "FCGDAEB", "BEADGCF"
_TONICS = {"Cb": -7, "Gb": -6, "Db": -5, "Ab": -4, "Eb": -3, "Bb": -2, "F": -1, "C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5, "F#": 6, "C#": 7}
_MODES = {"maj": 0, "ion": 0, "mix": -1, "dor": -2, "min": -3, "aeo": -3, "phr": -4, "lyd": 1, "loc": -5}
_ACCIDENTALS = {"^^": 2, "^": 1, "=": 0, "_": -1, "__": -2}
_CLEFS = re.compile(r"\b(?:clef|middle|transpose|octave|stafflines)\S*|\b(?:treble|bass|alto|tenor|perc)\b\S*", re.I)
_PITCH = r"(?P<acc>\^\^|__|\^|_|=)?(?P<step>[A-Ga-g])(?P<oct>[',]*)"
_LENGTH = r"(?P<num>\d+)?(?P<slash>/+)?(?P<den>\d+)?"
_TOKEN = re.compile(
    rf"""(?P<comment>%.*)|(?P<skip>\s+|\\|"[^"]*"?|![^!]*!?|\+[^+]*\+?|\{{[^}}]*\}}?)|(?P<overlay>&)
    |\((?P<tuplet>\d)(?::(?P<tq>\d*))?(?::(?P<tr>\d*))?
    |\[(?P<field>[A-Za-z]):(?P<value>[^\]]*)\]
    |(?P<bar>(?:\[\||\|\]|\|\||\|:|:\||::|\||:)+\d*)|(?P<ending>\[\d)
    |(?P<rest>[zZxX])(?P<rnum>\d+)?(?P<rslash>/+)?(?P<rden>\d+)?
    |\[(?P<chord>[^\]]*)\](?P<cnum>\d+)?(?P<cslash>/+)?(?P<cden>\d+)?
    |{_PITCH}{_LENGTH}
    |(?P<broken>>+|<+)|(?P<tie>-)|(?P<other>.)""",
    re.X,
)


def _length(num: str | None, slash: str | None, den: str | None) -> Fraction:
    size = Fraction(int(num or 1))
    if slash:
        size /= int(den) if den else 2 ** len(slash)
    return size


def fraction(text: str) -> Fraction | None:
    m = re.fullmatch(r"\s*(\d+)\s*/\s*(\d+)\s*", text)
    if m:
        return Fraction(int(m[1]), int(m[2])) if int(m[2]) else None
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*", text)
    return Fraction(m[1]) if m and Fraction(m[1]) > 0 else None


@dataclass
class Key:
    fifths: int = 0
    mode: str = "major"
    alters: dict[str, int] = field(default_factory=dict)


def parse_key(text: str) -> Key | None:
    """Tonic, mode and explicit accidentals of a ``K:`` field."""
    text = text.strip()
    if re.fullmatch("none", text, re.I):
        return Key()
    if text[:2].upper() == "HP" and text[:1] == "H":
        return Key(2, "major", {"F": 0, "C": 0})
    m = re.match(r"([A-G])([#b]?)\s*([A-Za-z]*)", text)
    if not m:
        return None
    word = m[3].lower()
    mode = word[:3] if word[:3] in _MODES else "min" if re.match(r"m(?!ix|aj)", word) else "maj"
    if re.match(r"m(?!ix|aj)", word):
        mode = "min"
    fifths = clamp(_TONICS.get(m[1] + m[2], 0) + _MODES[mode], -7, 7)
    alters = {s: 1 for s in _SHARPS[: max(0, fifths)]} | {s: -1 for s in _FLATS[: max(0, -fifths)]}
    for acc, step in re.findall(r"(\^\^|__|\^|_|=)([a-gA-G])", text[m.end() :]):
        alters[step.upper()] = _ACCIDENTALS[acc]
    return Key(fifths, "minor" if mode in ("min", "aeo", "dor", "phr", "loc") else "major", alters)


@dataclass
class _Voice:
    id: str
    name: str
    key: Key
    unit: Fraction
    notes: list[Note] = field(default_factory=list)
    at: Fraction = Fraction(0)
    bar: Fraction = Fraction(0)
    in_bar: dict[tuple[str, int], int] = field(default_factory=dict)
    tied: set[int] = field(default_factory=set)
    last: list[Note] = field(default_factory=list)
    last_size: Fraction = Fraction(0)
    scale: Fraction = Fraction(1)  # what broken rhythm leaves for the next element
    tuplet: tuple[Fraction, int] | None = None

    def take(self) -> Fraction:
        """Factor of tuplet and broken rhythm for the next element."""
        f, self.scale = self.scale, Fraction(1)
        if self.tuplet:
            ratio, left = self.tuplet
            f *= ratio
            self.tuplet = (ratio, left - 1) if left > 1 else None
        return f


class _Tune:
    def __init__(self) -> None:
        self.score = Score(meta={"source": "abc"})
        self.meter, self.unit, self.key = (4, 4), None, Key()
        self.body = self.repeats = False
        self.voices: dict[str, _Voice] = {}
        self.current: _Voice | None = None

    def default_unit(self) -> Fraction:
        n, d = self.meter
        return (self.unit or (Fraction(1, 16) if Fraction(n, d) < Fraction(3, 4) else Fraction(1, 8))) * WHOLE

    def voice(self, vid: str = "1", name: str | None = None) -> _Voice:
        if vid not in self.voices:
            self.voices[vid] = _Voice(vid, name or vid, self.key, self.default_unit())
        return self.voices[vid]

    def lead(self) -> _Voice:
        if self.current is None:
            self.current = self.voice()
        return self.current

    def set(self, letter: str, value: str, inline: bool = False) -> None:
        tick = rounded(self.current.at) if self.current else 0
        if letter == "T":
            self.score.meta.setdefault("title", value.strip())
        elif letter == "C":
            self.score.meta.setdefault("composer", value.strip())
        elif letter == "L" and (f := fraction(value)):
            self.unit = f
            for v in self.voices.values():
                v.unit = f * WHOLE
        elif letter == "M":
            self._meter(value.strip(), tick)
        elif letter == "Q":
            self._tempo(value, tick)
        elif letter == "K":
            self._key(value, tick, inline)
        elif letter == "V" and (m := re.match(r"(\S+)\s*(.*)", value.strip())):
            nm = re.search(r'(?:name|nm)\s*=\s*"([^"]*)"', m[2])
            self.current = self.voice(m[1], nm[1] if nm else None)
            if nm and self.current.name == self.current.id:
                self.current.name = nm[1]

    def _meter(self, text: str, tick: int) -> None:
        if text in ("C", "C|"):
            self.meter = (4, 4) if text == "C" else (2, 2)
        elif m := re.match(r"\(?([\d+ ]+)\)?\s*/\s*(\d+)", text):
            self.meter = (sum(int(x) for x in re.findall(r"\d+", m[1])) or 4, int(m[2]) or 4)
        elif text.lower() == "none":
            return
        self.score.change("meters", tick, numerator=self.meter[0], denominator=self.meter[1])
        if self.unit is None and self.current:
            self.current.unit = self.default_unit()

    def _tempo(self, text: str, tick: int) -> None:
        text = re.sub(r'"[^"]*"', "", text).strip()
        m = re.match(r"(?:([0-9/ ]+)=)?\s*(\d+(?:\.\d+)?)", text)
        if not m or (not m[1] and m.end() < len(text)):
            return
        beat = sum((fraction(p) or Fraction(0) for p in m[1].split()), Fraction(0)) if m[1] else Fraction(1, 4)
        bpm = float(m[2]) * float((beat or Fraction(1, 4)) * 4)
        if bpm > 0:
            items = self.score.tempos
            if items and items[-1]["tick"] == tick:
                items[-1]["bpm"] = bpm
            else:
                items.append({"tick": tick, "bpm": rounded(bpm * 100) / 100})

    def _key(self, text: str, tick: int, inline: bool) -> None:
        key = parse_key(_CLEFS.sub("", text))
        first, self.body = not self.body, True
        if key is None:
            return
        if self.current is None or (first and not inline):
            self.key = key
        for v in self.voices.values() if first and not inline else [self.current] if self.current else []:
            v.key = key
        self.score.change("keys", tick, fifths=key.fifths, mode=key.mode)

    def _pitch(self, v: _Voice, m: re.Match) -> tuple[int, dict]:
        step = m["step"].upper()
        octave = (4 if m["step"].isupper() else 5) + m["oct"].count("'") - m["oct"].count(",")
        if m["acc"]:
            v.in_bar[step, octave] = _ACCIDENTALS[m["acc"]]
        alter = v.in_bar.get((step, octave), v.key.alters.get(step, 0))
        return (octave + 1) * 12 + _STEPS[step] + alter, {"step": step, "alter": clamp(alter, -2, 2), "octave": octave}

    def _sound(self, v: _Voice, made: list[tuple[int, dict, Fraction]], tie: bool) -> None:
        f = v.take()
        start, tied = v.at, set()
        v.last = []
        for midi, spelling, size in made:
            a, b = rounded(start), rounded(start + v.unit * size * f)
            v.last.append(Note(midi, a, max(1, b - a), spelling=spelling, tied=midi in v.tied))
            if tie:
                tied.add(midi)
        v.notes += v.last
        v.last_size = v.unit * made[0][2] * f
        v.at, v.tied = start + v.last_size, tied

    def line(self, text: str) -> None:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            at = m.end()
            if m["comment"] is not None:
                return
            if m["field"]:
                self.set(m["field"], m["value"], True)
            elif m["overlay"]:
                v = self.lead()
                v.at = v.bar
            elif m["tuplet"]:
                self._tuplet(m)
            elif m["bar"] is not None:
                self.repeats |= ":" in m["bar"]
                if m["bar"].strip(":0123456789") or ":" in m["bar"][1:]:
                    v = self.lead()
                    v.bar, v.in_bar = v.at, {}
            elif m["rest"]:
                v = self.lead()
                whole = m["rest"] in "ZX"
                size = _length(m["rnum"], m["rslash"], m["rden"])
                unit = Fraction(WHOLE * self.meter[0], self.meter[1]) if whole else v.unit
                v.at += unit * size * v.take()
                v.last, v.tied = [], set()
            elif m["chord"] is not None:
                v = self.lead()
                outer = _length(m["cnum"], m["cslash"], m["cden"])
                inner = re.sub(r'"[^"]*"?', "", m["chord"])
                made = [(*self._pitch(v, n), _length(n["num"], n["slash"], n["den"]) * outer) for n in re.finditer(_PITCH + _LENGTH, inner)]
                tie = text[at : at + 1] == "-"
                if made:
                    self._sound(v, made, tie or "-" in m["chord"])
            elif m["step"]:
                v = self.lead()
                self._sound(v, [(*self._pitch(v, m), _length(m["num"], m["slash"], m["den"]))], text[at : at + 1] == "-")
            elif m["broken"]:
                self._broken(m["broken"])

    def _tuplet(self, m: re.Match) -> None:
        p = int(m["tuplet"])
        three = 3 if self.meter[1] == 8 and self.meter[0] % 3 == 0 else 2
        q = int(m["tq"]) if m["tq"] else {2: 3, 3: 2, 4: 3, 6: 2, 8: 3}.get(p, three if p in (5, 7, 9) else 2)
        if p:
            self.lead().tuplet = (Fraction(q, p), int(m["tr"]) if m["tr"] else p)

    def _broken(self, mark: str) -> None:
        v, short = self.lead(), Fraction(1, 2 ** len(mark))
        before, v.scale = (2 - short, short) if mark[0] == ">" else (short, 2 - short)
        if v.last:
            size = v.last_size * before
            for n in v.last:
                n.duration = max(1, rounded(size))
            v.at += size - v.last_size
            v.last_size = size


def read_abc(text: str) -> Score:
    """Fields X T C M L Q K V, also inline; notes, chords, ties, tuplets, broken rhythm, overlays, rests."""
    lines = re.split(r"\r\n|\r|\n", text.removeprefix("﻿"))
    heads = [i for i, x in enumerate(lines) if x.strip().startswith("X:")]
    tune = _Tune()
    if len(heads) > 1:
        tune.score.warn("ABC file contains several tunes; only the first was imported.")
    for raw in lines[heads[0] if heads else 0 : heads[1] if len(heads) > 1 else None]:
        line = raw.strip()
        if not line and tune.body:
            break
        m = re.match(r"([A-Za-z]):\s?(.*)$", line)
        if m:
            if m[1] in "TCMLQKV":
                tune.set(m[1], re.sub(r"\s%.*$", "", m[2]))
        elif line and not line.startswith("%") and tune.body:
            tune.line(raw.rstrip())
    score = tune.score
    if not tune.voices:
        score.warn("ABC tune contains no notes.")
    for v in tune.voices.values():
        name = score.meta.get("title", "Melody") if v.name == v.id and len(tune.voices) == 1 else v.name
        if v.notes:
            score.tracks.append(Track(f"v{v.id}", name, 0, v.notes))
    if not score.meters or score.meters[0]["tick"] > 0:
        score.meters.insert(0, {"tick": 0, "numerator": tune.meter[0], "denominator": tune.meter[1]})
    if not score.keys or score.keys[0]["tick"] > 0:
        score.keys.insert(0, {"tick": 0, "fifths": tune.key.fifths, "mode": tune.key.mode})
    if tune.repeats:
        score.warn("Repeat signs are not expanded; the tune is shown as written.")
    score.settle()
    score.aim()
    return score
