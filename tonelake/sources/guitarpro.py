"""Guitar Pro 3 to 7: binary files, GPX containers, GPIF documents."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree as ET

from .score import WHOLE, FormatError, Note, Score, Track, clamp, decode, rounded

# Fixed values.
_DYNAMICS = {"PPP": 30, "PP": 42, "P": 58, "MP": 74, "MF": 90, "F": 104, "FF": 118, "FFF": 127}
_TUPLETS = {3: 2, 5: 4, 6: 4, 7: 4, 9: 8, 10: 8, 11: 8, 12: 8, 13: 8}
_VALUES = {"whole": 1, "half": 2, "quarter": 4, "eighth": 8, "16th": 16, "32nd": 32, "64th": 64, "128th": 128, "256th": 256}
_MARKS = {"HopoOrigin": "hammer", "Slide": "slide", "PalmMuted": "palm-mute", "Bended": "bend", "HarmonicType": "harmonic", "Slapped": "accent"}
_LIMIT = 1 << 24


class _Bytes:
    """Little-endian numbers and the format's strings, bounds checked."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("Guitar Pro file is truncated or corrupt.")
        self.at += n
        return self.data[self.at - n : self.at]

    def u8(self) -> int:
        return self.take(1)[0]

    def i8(self) -> int:
        return struct.unpack("<b", self.take(1))[0]

    def i16(self) -> int:
        return struct.unpack("<h", self.take(2))[0]

    def i32(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def count(self, most: int, what: str) -> int:
        n = self.i32()
        if not 0 <= n <= most:
            raise FormatError(f"Guitar Pro file is corrupt ({what}).")
        return n

    def fixed(self, size: int) -> str:
        """A length byte and ``size`` bytes that hold the string."""
        n = self.u8()
        return self.take(size)[: min(n, size)].decode("cp1252", "replace")

    def text(self) -> str:
        size = self.count(_LIMIT, "string length")
        return self.fixed(size - 1) if size else ""

    def long_text(self) -> str:
        return self.take(self.count(_LIMIT, "string length")).decode("cp1252", "replace")


class _Binary:
    """The binary layout of versions 3, 4 and 5.

    A version's differences are asked for by ``since``, so each block reads as
    one list of fields.
    """

    def __init__(self, data: bytes):
        self.r = _Bytes(data)
        head = self.r.fixed(30)
        m = re.search(r"v(\d+)\.(\d+)", head)
        if not m or "GUITAR PRO" not in head.upper():
            raise FormatError("Not a Guitar Pro file.")
        self.version = (int(m[1]), int(m[2]))
        if not 3 <= self.version[0] <= 5:
            raise FormatError(f"Unsupported Guitar Pro version {m[1]}.{m[2]}.")
        self.score = Score(meta={"source": "guitarpro"})
        self.repeats = False

    def since(self, major: int, minor: int = 0) -> bool:
        return self.version >= (major, minor)

    @property
    def plain5(self) -> bool:
        return self.version == (5, 0)

    def read(self) -> Score:
        self.information()
        tempo, key, programs, bars, tracks = self.song()
        self.score.tempos.append({"tick": 0, "bpm": float(tempo if tempo > 0 else 120)})
        if -7 <= key <= 7:
            self.score.keys.append({"tick": 0, "fifths": key, "mode": "major"})
        starts = self.bars(bars)
        lanes = [self.lane(i, programs) for i in range(tracks)]
        if self.since(5):
            self.r.take(2 if self.plain5 else 1)
        self.tempo_marks: list[tuple[int, int]] = []
        for start in starts:
            for lane in lanes:
                for voice in range(2 if self.since(5) else 1):
                    self.beats(lane, start, voice)
                if self.since(5):
                    self.r.u8()
        for tick, bpm in self.tempo_marks:
            if self.score.tempos[-1]["bpm"] != bpm:
                self.score.tempos.append({"tick": tick, "bpm": float(bpm)})
        if self.repeats:
            self.score.warn("Repeat signs are not expanded; the score is shown as written.")
        return finish(self.score, lanes)

    def information(self) -> None:
        r, meta = self.r, self.score.meta
        names = ["title", "subtitle", "artist", "album", "words", *(["music"] if self.since(5) else []), "copyright", "tabber", "instructions"]
        got = {n: r.text() for n in names}
        for _ in range(r.count(10_000, "notices")):
            r.text()
        if got["title"]:
            meta["title"] = got["title"]
        composer = got.get("music") or got["words"] or got["artist"]
        if composer:
            meta["composer"] = composer
        if got["artist"]:
            meta["artist"] = got["artist"]
        if not self.since(5):
            r.u8()
        if self.since(4):
            r.i32()
            for _ in range(5):
                r.i32()
                r.long_text()
        if self.since(5):
            r.take((19 if self.since(5, 1) else 0) + 30)
            for _ in range(11):
                r.text()

    def song(self) -> tuple[int, int, list[int], int, int]:
        r = self.r
        tempo = r.i32()
        if self.since(5, 1):
            r.u8()
        key = r.i8()
        r.take(4 if self.since(4) else 3)
        programs = [(r.i32(), r.take(8))[0] for _ in range(64)]
        if self.since(5):
            r.take(42)
        return tempo, key, programs, r.count(100_000, "measures"), r.count(256, "tracks")

    def bars(self, count: int) -> list[float]:
        r, starts, at, n, d = self.r, [], 0.0, 4, 4
        for i in range(count):
            if self.since(5) and i:
                r.u8()
            f = r.u8()
            n = r.i8() if f & 1 else n
            d = r.i8() if f & 2 else d
            if f & 8:
                r.i8()
            self.repeats |= bool(f & 12)
            if f & 16 and not self.since(5):
                r.u8()
            if f & 32:
                r.text()
                r.take(4)
            if f & 64:
                fifths, minor = r.i8(), r.i8() == 1
                values = {"fifths": clamp(fifths, -7, 7), "mode": "minor" if minor else "major"}
                self.score.change("keys", rounded(at), **values)
            if self.since(5):
                r.take(bool(f & 16) + 4 * bool(f & 3) + (not f & 16) + 1)
            if n <= 0 or d <= 0:
                n = d = 4
            if not self.score.meters or (self.score.meters[-1]["numerator"], self.score.meters[-1]["denominator"]) != (n, d):
                self.score.meters.append({"tick": rounded(at), "numerator": n, "denominator": d})
            starts.append(at)
            at += WHOLE * n / d
        return starts

    def lane(self, i: int, programs: list[int]) -> dict:
        r = self.r
        if self.since(5) and (i == 0 or self.plain5):
            r.u8()
        flags, name = r.u8(), r.fixed(40)
        strings = r.i32()
        tuning = [r.i32() for _ in range(7)]
        port, channel, _, _, capo = (r.i32() for _ in range(5))
        r.take(4)
        if self.since(5):
            r.take(5 + 36)
            r.take(3 if self.plain5 else 4)
            if self.since(5, 1):
                r.take(4)
                r.text()
                r.text()
        if not 0 <= strings <= 7:
            raise FormatError("Guitar Pro file is corrupt (string count).")
        at = (port - 1) * 16 + channel - 1
        drum = bool(flags & 1) or channel == 10 or (at >= 0 and at % 16 == 9)
        return {"name": name or f"Track {i + 1}", "strings": strings, "tuning": tuning[:strings], "capo": max(0, capo), "drum": drum, "program": clamp(programs[at] if 0 <= at < 64 else 0, 0, 127), "notes": [], "frets": [0] * 8}

    def bend(self) -> None:
        self.r.take(5)
        self.r.take(9 * self.r.count(1000, "bend"))

    def chord(self) -> None:
        r = self.r
        if self.since(5):
            r.take(106)
        elif r.u8() & 1:
            r.take(105)
        else:
            r.text()
            if r.i32():
                r.take(24)

    def beat_effects(self) -> list[str]:
        r, f = self.r, self.r.u8()
        if not self.since(4):
            r.take(5 * bool(f & 32) + 2 * bool(f & 64))
            return ["harmonic"] if f & 12 else []
        g = r.u8()
        r.take(bool(f & 32))
        if g & 4:
            self.bend()
        r.take(2 * bool(f & 64) + bool(g & 2))
        return []

    def note_effects(self) -> list[str]:
        r, f, marks = self.r, self.r.u8(), []
        g = r.u8() if self.since(4) else None
        if f & 1:
            self.bend()
            marks.append("bend")
        if f & 2:
            marks.append("hammer")
        if g is None:
            marks += ["slide"] if f & 4 else []
            r.take(4 * bool(f & 16))
            return marks
        r.take((5 if self.since(5) else 4) * bool(f & 16))
        marks += ["staccato"] * bool(g & 1) + ["palm-mute"] * bool(g & 2)
        r.take(bool(g & 4) + bool(g & 8))
        marks += ["slide"] * bool(g & 8)
        if g & 16:
            kind = r.i8()
            marks.append("harmonic")
            r.take({2: 3, 3: 1}.get(kind, 0) if self.since(5) else 0)
        r.take(2 * bool(g & 32))
        return marks

    def mix(self) -> int:
        r = self.r
        r.i8()
        if self.since(5):
            r.take(15 if self.plain5 else 16)
        levels = [r.i8() for _ in range(6)]
        if self.since(5):
            r.text()
        tempo = r.i32()
        r.take(sum(v >= 0 for v in levels))
        if tempo >= 0:
            r.take(2 if self.since(5, 1) else 1)
        r.take(self.since(4) + self.since(5))
        if self.since(5, 1):
            r.text()
            r.text()
        return tempo

    def length(self, flags: int) -> float:
        ticks = WHOLE / 2 ** (self.r.i8() + 2) * (1.5 if flags & 1 else 1)
        if flags & 32:
            n = self.r.i32()
            ticks *= _TUPLETS[n] / n if n in _TUPLETS else 1
        return ticks

    def beats(self, lane: dict, start: float, voice: int) -> None:
        r, at = self.r, start
        for _ in range(r.count(1000, "beat count")):
            f = r.u8()
            rest = bool(f & 64) and r.u8() in (0, 2)
            size = self.length(f)
            if f & 2:
                self.chord()
            if f & 4:
                r.text()
            marks = self.beat_effects() if f & 8 else []
            if f & 16 and (tempo := self.mix()) > 0:
                self.tempo_marks.append((rounded(at), tempo))
            strings = r.u8()
            for s in range(7):
                if strings >> 6 - s & 1:
                    self.note(lane, s, at, size, voice, marks, rest)
            if self.since(5) and r.i16() & 0x800:
                r.u8()
            at += size

    def note(self, lane: dict, s: int, at: float, size: float, voice: int, marks: list[str], rest: bool) -> None:
        r, f = self.r, self.r.u8()
        kind = r.u8() if f & 32 else 1
        r.take(2 * bool(f & 1 and not self.since(5)))
        velocity = clamp(15 + 16 * r.i8() - 16, 1, 127) if f & 16 else 90
        fret = r.i8() if f & 32 else 0
        r.take(2 * bool(f & 128))
        if self.since(5):
            r.take(8 * bool(f & 1) + 1)
        marks = marks + (self.note_effects() if f & 8 else []) + ["accent"] * bool(f & 2) + ["dead"] * (kind == 3)
        if rest or (s >= lane["strings"] and not lane["drum"]):
            return
        fret = max(0, lane["frets"][s] if kind == 2 else fret)
        lane["frets"][s] = fret
        place(lane, s, fret, None if lane["drum"] else lane["tuning"][s], at, size, velocity, voice, kind == 2, marks)


def place(lane: dict, string: int, fret: int, open_: int | None, at: float, size: float, velocity: int, voice: int, tied: bool, marks: list[str]) -> None:
    """Adds a note; a drum's fret is its pitch, others lock their spot above the capo."""
    start = rounded(at)
    n = Note(0, start, max(1, rounded(at + size) - start), velocity, voice, tied=tied, articulations=list(dict.fromkeys(marks)) or None)
    if open_ is None:
        n.pitch = clamp(fret, 0, 127)
    else:
        n.pitch = open_ + lane["capo"] + fret
        n.tab, n.locked = {"string": string, "fret": fret + lane["capo"]}, True
        if not 0 <= n.pitch <= 127:
            return
    lane["notes"].append(n)


def finish(score: Score, lanes: list[dict]) -> Score:
    """Tracks with notes, the guitar track among them, and its tuning."""
    used = [(i, x) for i, x in enumerate(lanes) if x["notes"]]
    for i, x in used:
        score.tracks.append(Track(f"t{i}", x["name"], 0 if x["drum"] else x["program"], x["notes"]))
    pitched = [(t, x) for t, (_, x) in zip(score.tracks, used) if not x["drum"]]
    rules = (lambda t, x: 24 <= t.program <= 31 and x["strings"] <= 8, lambda t, x: x["strings"] >= 6, lambda t, x: True)
    chosen = next(((t, x) for rule in rules for t, x in pitched if rule(t, x)), None)
    if chosen:
        chosen[0].target = True
        score.meta |= {"tuning": chosen[1]["tuning"], "capo": chosen[1]["capo"]}
    if any(x["drum"] for _, x in used):
        score.warn("Percussion tracks are included but have no tab.")
    return score.settle()


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        byte = self.data[self.at >> 3]
        self.at += 1
        return byte >> 7 - (self.at - 1 & 7) & 1

    def high_first(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (self.bit() if self.at < 8 * len(self.data) else 0)
        return v

    def low_first(self, n: int) -> int:
        return sum((self.bit() if self.at < 8 * len(self.data) else 0) << i for i in range(n))


def decompress(data: bytes) -> bytes:
    """A BCFZ stream: literal runs, and copies of what came before."""
    if data[:4] != b"BCFZ" or len(data) < 8:
        raise FormatError("Not a BCFZ stream.")
    size = int.from_bytes(data[4:8], "little", signed=True)
    if not 0 <= size <= 1 << 28:
        raise FormatError("Corrupt GPX: bad decompressed size.")
    bits, out = _Bits(data[8:]), bytearray()
    while len(out) < size and bits.at < 8 * len(bits.data):
        if bits.bit():
            width = bits.high_first(4)
            back, length = bits.low_first(width), bits.low_first(width)
            if back > len(out):
                raise FormatError("Corrupt GPX: invalid back-reference.")
            first = len(out) - back
            out += out[first : first + min(back, length)]
        else:
            for _ in range(bits.low_first(2)):
                out.append(bits.high_first(8))
    return bytes(out[:size])


def files_in(data: bytes, sector: int = 0x1000) -> dict[str, bytes]:
    """The files of a BCFS image."""
    if data[:4] != b"BCFS":
        raise FormatError("Not a BCFS file system.")
    found, word = {}, lambda o: int.from_bytes(data[o : o + 4], "little", signed=True)
    for o in range(sector, len(data) - sector + 1, sector):
        if word(o) != 2:
            continue
        name = data[o + 4 : o + 131].split(b"\0")[0].decode("latin-1")
        body, at = b"", o + 0x94
        while at + 4 <= len(data) and (block := word(at)) and block * sector < len(data):
            body += data[block * sector : (block + 1) * sector]
            at += 4
        size = word(o + 0x8C)
        found[name] = body[:size] if 0 <= size < len(body) else body
    return found


class _Gpif:
    """A GPIF document: lists of ids that point from bars to voices, beats, notes and rhythms."""

    def __init__(self, xml: str):
        try:
            self.root = ET.fromstring(xml.encode(), ET.XMLParser(encoding="utf-8"))
        except ET.ParseError as e:
            raise FormatError("Invalid Guitar Pro score.gpif XML.") from e
        if self.root.tag != "GPIF":
            raise FormatError("Invalid Guitar Pro score.gpif XML.")
        self.of = {k: {e.get("id", ""): e for e in self.root.findall(f"{k}s/{k}")} for k in ("Bar", "Voice", "Beat", "Note", "Rhythm")}

    @staticmethod
    def text(el: ET.Element | None, path: str, default: str = "") -> str:
        found = el.find(path) if el is not None else None
        return default if found is None else (found.text or "").strip()

    @classmethod
    def ids(cls, el: ET.Element | None, path: str) -> list[int]:
        return [int(x) for x in cls.text(el, path).split() if re.fullmatch(r"-?\d+", x)]

    @staticmethod
    def properties(el: ET.Element) -> dict[str, ET.Element]:
        return {p.get("name", ""): p for p in el.findall("Properties/Property")}

    def listed(self, kind: str, ids: list[int]) -> list[tuple[int, ET.Element]]:
        return [(i, self.of[kind][str(n)]) for i, n in enumerate(ids) if str(n) in self.of[kind]]

    def read(self) -> Score:
        score, text = Score(meta={"source": "guitarpro"}), self.text
        head = self.root.find("Score")
        if text(head, "Title"):
            score.meta["title"] = text(head, "Title")
        composer = text(head, "Music") or text(head, "Words") or text(head, "Artist")
        if composer:
            score.meta["composer"] = composer
        lanes = [self.lane(i, t) for i, t in enumerate(self.root.findall("Tracks/Track"))]
        bars = self.root.findall("MasterBars/MasterBar")
        spans = self.spans(score, bars)
        self.tempos(score, spans)
        for bar, (start, _) in zip(bars, spans):
            for i, b in self.listed("Bar", self.ids(bar, "Bars")):
                if i < len(lanes):
                    self.bar(lanes[i], b, start)
        for x in lanes:
            x["tuning"] = x["tuning"][::-1]
        return finish(score, lanes)

    def lane(self, i: int, t: ET.Element) -> dict:
        p = self.properties(t)
        tuning = self.ids(p.get("Tuning"), "Pitches")
        program = self.text(t, "GeneralMidi/Program")
        drum = self.text(t, "InstrumentSet/Type").lower() == "drumkit" or t.find("DrumKit") is not None
        return {"name": self.text(t, "Name") or f"Track {i + 1}", "strings": len(tuning), "tuning": tuning, "capo": max(0, (self.ids(p.get("CapoFret"), "Fret") or [0])[0]), "drum": drum, "program": clamp(int(program), 0, 127) if re.fullmatch(r"-?\d+", program) else 25, "notes": [], "frets": {}}

    def spans(self, score: Score, bars: list[ET.Element]) -> list[tuple[float, float]]:
        out, at = [], 0.0
        for bar in bars:
            m = re.match(r"(\d+)/(\d+)", self.text(bar, "Time", "4/4"))
            n, d = (int(m[1]) or 4, int(m[2]) or 4) if m else (4, 4)
            if not score.meters or (score.meters[-1]["numerator"], score.meters[-1]["denominator"]) != (n, d):
                score.meters.append({"tick": rounded(at), "numerator": n, "denominator": d})
            if bar.find("Key") is not None:
                count = self.text(bar, "Key/AccidentalCount", "0")
                fifths = clamp(int(count) if re.fullmatch(r"-?\d+", count) else 0, -7, 7)
                score.change("keys", rounded(at), fifths=fifths, mode="minor" if self.text(bar, "Key/Mode").lower() == "minor" else "major")
            out.append((at, WHOLE * n / d))
            at += WHOLE * n / d
        return out

    def tempos(self, score: Score, spans: list[tuple[float, float]]) -> None:
        for a in self.root.findall("MasterTrack/Automations/Automation"):
            value = re.match(r"[\d.]+", self.text(a, "Value"))
            bar = int(self.text(a, "Bar", "0") or 0)
            if self.text(a, "Type").lower() != "tempo" or not value or float(value[0]) <= 0 or not 0 <= bar < len(spans):
                continue
            where = float(self.text(a, "Position", "0") or 0)
            score.change("tempos", rounded(spans[bar][0] + (where if where <= 1 else 0) * spans[bar][1]), bpm=float(value[0]))
        score.tempos.sort(key=lambda x: x["tick"])

    def ticks(self, ref: str | None) -> float:
        r = self.of["Rhythm"].get(ref or "")
        if r is None:
            return WHOLE / 4
        dot, tuplet = r.find("AugmentationDot"), r.find("PrimaryTuplet")
        size = WHOLE / _VALUES.get(self.text(r, "NoteValue", "Quarter").lower(), 4)
        size *= 2 - 0.5 ** int(dot.get("count", "0") if dot is not None else 0)
        return size * (int(tuplet.get("den", "1")) or 1) / (int(tuplet.get("num", "1")) or 1) if tuplet is not None else size

    def bar(self, lane: dict, bar: ET.Element, start: float) -> None:
        loud = 90
        for v, voice in self.listed("Voice", self.ids(bar, "Voices")):
            at = start
            for _, beat in self.listed("Beat", self.ids(voice, "Beats")):
                loud = _DYNAMICS.get(self.text(beat, "Dynamic").upper(), loud)
                if beat.find("GraceNotes") is not None:
                    continue
                rhythm = beat.find("Rhythm")
                size = self.ticks(rhythm.get("ref") if rhythm is not None else None)
                for _, n in self.listed("Note", self.ids(beat, "Notes")):
                    self.note(lane, n, at, size, loud, v)
                at += size

    def note(self, lane: dict, n: ET.Element, at: float, size: float, loud: int, voice: int) -> None:
        p = self.properties(n)
        number = lambda name, field: next(iter(self.ids(p.get(name), field)), None)
        if lane["drum"]:
            midi = number("Midi", "Number")
            if midi is not None:
                place(lane, 0, midi, None, at, size, loud, voice, False, [])
            return
        string, fret, tie = number("String", "String"), number("Fret", "Fret"), n.find("Tie")
        tied = tie is not None and tie.get("destination") == "true"
        if string is None or not 0 <= string < lane["strings"]:
            return
        if fret is None:
            fret = lane["frets"].get(string, 0) if tied else 0
        lane["frets"][string] = fret
        marks = [m for k, m in _MARKS.items() if k in p and any(p[k].find(x) is not None for x in ("Enable", "Flags", "HType"))]
        place(lane, lane["strings"] - 1 - string, fret, lane["tuning"][string], at, size, loud, voice, tied, marks)


def read_gpif(xml: str) -> Score:
    return _Gpif(xml).read()


def read_guitarpro(data: bytes) -> Score:
    """Told apart by their first bytes; the file name does not count."""
    if data[:4] in (b"BCFZ", b"BCFS"):
        files = files_in(decompress(data) if data[:4] == b"BCFZ" else data)
        name = "score.gpif" if "score.gpif" in files else next((n for n in files if n.endswith(".gpif")), None)
        if name is None:
            raise FormatError("GPX file does not contain score.gpif.")
        return read_gpif(decode(files[name]))
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".gpif")]
            name = next((n for n in names if re.search(r"(^|/)score\.gpif$", n, re.I)), names[0] if names else None)
            if name is None:
                raise FormatError("Guitar Pro archive does not contain Content/score.gpif.")
            return read_gpif(decode(z.read(name)))
    return _Binary(data).read()
