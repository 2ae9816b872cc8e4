"""MusicXML: partwise, timewise, plain or compressed."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from .score import PPQ, FormatError, Note, Score, Track, clamp, decode, rounded

# Fixed values.
_STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
_QUARTERS = {"whole": 4, "half": 2, "quarter": 1, "eighth": 0.5, "16th": 0.25, "32nd": 0.125}
_MARKS = {"hammer-on": "hammer", "pull-off": "pull", "harmonic": "harmonic", "bend": "bend", "staccato": "staccato", "accent": "accent", "strong-accent": "accent"}
_BARE = re.compile(r"&(?!(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def xml_text(data: bytes) -> str:
    """The document's text from plain, UTF-16 or zipped bytes."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            root = None
            if "META-INF/container.xml" in names:
                files = [e.get("full-path") for e in ET.fromstring(z.read("META-INF/container.xml")).iter() if e.tag.split("}")[-1] == "rootfile"]
                root = next((f for f in files if f in names), None)
            root = root or next((n for n in names if re.search(r"\.(musicxml|xml)$", n, re.I) and not n.startswith("META-INF")), None)
            if root is None:
                raise FormatError("Invalid .mxl: no MusicXML rootfile found.")
            return decode(z.read(root))
    for mark, code in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data[:2] == mark:
            return data.decode(code).removeprefix("﻿")
    return decode(data)


def sanitized(xml: str) -> str:
    """Bare ampersands escaped."""
    return _BARE.sub("&amp;", xml)


def _text(el: ET.Element | None, path: str, default: str | None = None) -> str | None:
    found = el.find(path) if el is not None else None
    return default if found is None else (found.text or "").strip()


def _num(el: ET.Element | None, path: str, default: float | None = None) -> float | None:
    try:
        return float(_text(el, path) or "")
    except ValueError:
        return default


class _Part:
    """Reads one part's measures into notes and, for the first part, change points."""

    def __init__(self, score: Score, leads: bool):
        self.score, self.leads = score, leads
        self.divisions, self.beats, self.beat_type = 1.0, 4, 4
        self.start, self.voices = 0, {}
        self.notes: list[Note] = []
        self.has_tab = self.repeats = self.graces = False

    def ticks(self, d: float) -> int:
        return rounded(d * PPQ / self.divisions)

    def measure(self, m: ET.Element) -> None:
        self.cursor = self.extent = self.onset = 0.0
        for el in m:
            read = getattr(self, "on_" + el.tag, None)
            if read:
                read(el)
        nominal = rounded(self.divisions * 4 * self.beats / self.beat_type)
        full = self.extent >= nominal or m.get("implicit") == "yes"
        self.start += self.ticks(self.extent if full else nominal)

    @property
    def now(self) -> int:
        return self.start + self.ticks(self.cursor)

    def on_attributes(self, el: ET.Element) -> None:
        d = _num(el, "divisions")
        self.divisions = d if d and d > 0 else self.divisions
        beats, kind = _text(el, "time/beats"), _num(el, "time/beat-type")
        if beats and kind:
            self.beats = sum(int(x) for x in re.findall(r"\d+", beats)) or 4
            self.beat_type = int(kind)
        if self.leads and el.find("time") is not None:
            self.score.change("meters", self.now, numerator=self.beats, denominator=self.beat_type)
        fifths = _num(el, "key/fifths")
        if self.leads and fifths is not None:
            self.score.change("keys", self.now, fifths=clamp(int(fifths), -7, 7), mode="minor" if _text(el, "key/mode") == "minor" else "major")

    def _tempo(self, bpm: float | None) -> None:
        if self.leads and bpm and bpm > 0:
            self.score.change("tempos", self.now, bpm=bpm)

    def on_direction(self, el: ET.Element) -> None:
        sound = el.find("sound")
        bpm = float(sound.get("tempo")) if sound is not None and sound.get("tempo") else 0.0
        mark = el.find("direction-type/metronome")
        if not bpm and mark is not None:
            unit, rate = _text(mark, "beat-unit"), re.match(r"\s*(\d+(?:\.\d+)?)", _text(mark, "per-minute", ""))
            if unit and rate:
                bpm = float(rate[1]) * _QUARTERS.get(unit, 1) * (1.5 if mark.find("beat-unit-dot") is not None else 1)
        self._tempo(rounded(bpm * 100) / 100 if bpm else None)

    def on_sound(self, el: ET.Element) -> None:
        self._tempo(float(el.get("tempo")) if el.get("tempo") else None)

    def on_barline(self, el: ET.Element) -> None:
        self.repeats |= el.find("repeat") is not None

    def on_backup(self, el: ET.Element) -> None:
        self.cursor = max(0.0, self.cursor - _num(el, "duration", 0.0))

    def on_forward(self, el: ET.Element) -> None:
        self.cursor += _num(el, "duration", 0.0)
        self.extent = max(self.extent, self.cursor)

    def on_note(self, el: ET.Element) -> None:
        if el.find("grace") is not None:
            self.graces = True
            return
        length = _num(el, "duration", 0.0)
        if el.find("chord") is None:
            self.onset = self.cursor
            self.cursor += length
            self.extent = max(self.extent, self.cursor)
        pitch = el.find("pitch")
        if el.find("rest") is not None or pitch is None:
            return
        step, alter, octave = _text(pitch, "step", "C").upper(), rounded(_num(pitch, "alter", 0.0)), int(_num(pitch, "octave", 4))
        midi = (octave + 1) * 12 + _STEPS.get(step, 0) + alter
        if not 0 <= midi <= 127:
            return
        voice, staff = _text(el, "voice", "1"), _text(el, "staff", "1")
        lane = self.voices.setdefault(voice if staff == "1" else f"{staff}:{voice}", len(self.voices))
        n = Note(midi, self.start + self.ticks(self.onset), max(1, self.ticks(length)), voice=lane)
        if step in _STEPS:
            n.spelling = {"step": step, "alter": clamp(alter, -2, 2), "octave": octave}
        if el.get("dynamics"):
            n.velocity = clamp(rounded(float(el.get("dynamics")) / 100 * 90), 1, 127)
        n.tied = any(t.get("type") == "stop" for t in [*el.findall("tie"), *el.findall("notations/tied")])
        marks = []
        for nt in el.findall("notations"):
            string, fret = _num(nt, "technical/string"), _num(nt, "technical/fret")
            if string is not None and fret is not None and string >= 1:
                n.tab, n.locked, self.has_tab = {"string": int(string) - 1, "fret": max(0, int(fret))}, True, True
            marks += [v for k, v in _MARKS.items() if nt.find(f"technical/{k}") is not None or nt.find(f"articulations/{k}") is not None]
            marks += ["slide"] if nt.find("slide") is not None else []
        n.articulations = list(dict.fromkeys(marks)) or None
        self.notes.append(n)


def read_musicxml(data: bytes | str) -> Score:
    """Signatures and tempos come from the first part; grace notes are skipped, repeats not expanded."""
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", xml_text(data) if isinstance(data, bytes) else data).encode("utf-8"), ET.XMLParser(encoding="utf-8"))
    except ET.ParseError as e:
        raise FormatError("Could not parse MusicXML: invalid XML.") from e
    for el in root.iter():
        el.tag = el.tag.split("}")[-1] if isinstance(el.tag, str) else ""
    if root.tag == "score-partwise":
        parts = [(p.get("id", ""), p.findall("measure")) for p in root.findall("part")]
    elif root.tag == "score-timewise":
        by: dict[str, list] = {}
        for m in root.findall("measure"):
            for p in m.findall("part"):
                by.setdefault(p.get("id", ""), []).append(p)
        parts = list(by.items())
    else:
        raise FormatError("Not a MusicXML score (expected score-partwise or score-timewise).")
    score = Score(meta={"source": "musicxml"})
    title = _text(root, "work/work-title") or _text(root, "movement-title")
    if title:
        score.meta["title"] = title
    makers = root.findall("identification/creator") or root.findall("creator")
    maker = next((c for c in makers if c.get("type") == "composer"), makers[0] if makers else None)
    if maker is not None and (maker.text or "").strip():
        score.meta["composer"] = maker.text.strip()
    listed = {p.get("id", ""): (_text(p, "part-name", ""), _num(p, "midi-instrument/midi-program")) for p in root.findall("part-list/score-part")}
    tabbed, readers = [], []
    for i, (pid, bars) in enumerate(parts):
        part = _Part(score, i == 0)
        readers.append(part)
        for m in bars:
            part.measure(m)
        if part.notes:
            name, program = listed.get(pid, ("", None))
            score.tracks.append(Track(pid or f"P{i + 1}", name or f"Part {i + 1}", 0 if program is None else clamp(int(program) - 1, 0, 127), part.notes))
            tabbed.append(part.has_tab)
    if not score.tracks:
        score.warn("MusicXML contains no pitched notes.")
    if any(p.graces for p in readers):
        score.warn("Grace notes were skipped.")
    if any(p.repeats for p in readers):
        score.warn("Repeat signs are not expanded; the score is shown as written.")
    chosen = next((t for t, has in zip(score.tracks, tabbed) if has), None) or next((t for t in score.tracks if re.search("guitar|guit|git", t.name, re.I) or 24 <= t.program <= 31), None)
    if chosen:
        chosen.target = True
    else:
        score.aim()
    return score.settle()
