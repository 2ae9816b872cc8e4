"""Standard MIDI files: reading and writing."""

from __future__ import annotations

from collections import defaultdict

from .score import PPQ, FormatError, Note, Score, Track, clamp, rounded

# Event data bytes by status nibble.
_DATA = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at


def events(chunk: bytes):
    """``(tick, status, data)`` of a track; meta events have status 0x100 + type."""
    at = tick = status = 0
    while at < len(chunk):
        delta, at = _number(chunk, at)
        tick += delta
        if chunk[at] >= 0x80:
            status = chunk[at]
            at += 1
        if status == 0xFF:
            kind = chunk[at]
            size, at = _number(chunk, at + 1)
            yield tick, 0x100 + kind, chunk[at : at + size]
            at += size
        elif status in (0xF0, 0xF7):
            size, at = _number(chunk, at)
            at += size
        else:
            size = _DATA.get(status >> 4)
            if size is None:
                raise FormatError("MIDI file is corrupt.")
            yield tick, status, chunk[at : at + size]
            at += size


def _chunks(data: bytes):
    at = 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size


def read_midi(data: bytes) -> Score:
    """Rescaled to 480 ticks a quarter; tracks without notes are dropped, as are notes that never end."""
    parts = list(_chunks(data))
    if not parts or parts[0][0] != b"MThd":
        raise FormatError("Not a MIDI file.")
    form, division = int.from_bytes(parts[0][1][:2], "big"), int.from_bytes(parts[0][1][4:6], "big")
    scale = PPQ / (division if 0 < division < 0x8000 else PPQ)
    at = lambda t: rounded(t * scale)
    score, drums = Score(meta={"source": "midi"}), []
    lanes = [c for k, c in parts[1:] if k == b"MTrk"]
    meters, keys, tempos = [], [], []
    for number, chunk in enumerate(lanes):
        name, program, channel, notes = "", {}, None, defaultdict(list)
        sounding: dict[tuple[int, int], list] = defaultdict(list)
        for tick, status, body in events(chunk):
            if status == 0x103:
                name = body.decode("utf-8", "replace").strip("\0")
            elif status == 0x151 and len(body) == 3:
                tempos.append((tick, 60e6 / max(1, int.from_bytes(body, "big"))))
            elif status == 0x158 and len(body) >= 2:
                meters.append((tick, body[0], 1 << body[1]))
            elif status == 0x159 and len(body) >= 2:
                keys.append((tick, int.from_bytes(body[:1], "big", signed=True), "minor" if body[1] else "major"))
            elif status < 0x100 and status >> 4 == 0xC:
                program.setdefault(status & 15, body[0])
            elif status < 0x100 and status >> 4 in (8, 9):
                on, who = status >> 4 == 9 and body[1] > 0, (status & 15, body[0])
                if on:
                    sounding[who].append((tick, body[1]))
                elif sounding[who]:
                    since, velocity = sounding[who].pop(0)
                    notes[who[0]].append((since, tick, who[1], velocity))
        if number == 0 and name and (form != 0 or len(lanes) > 1) and not notes:
            score.meta["title"] = name
        for channel in sorted(notes):
            made = [Note(p, at(a), max(1, at(b - a)), clamp(v, 1, 127)) for a, b, p, v in notes[channel]]
            drum = channel == 9
            label = name or f"Track {number + 1}"
            score.tracks.append(Track(f"t{number}" if len(notes) == 1 else f"t{number}c{channel}", label, 0 if drum else program.get(channel, 0), made))
            drums.append(drum)
    for tick, bpm in sorted(tempos, key=lambda x: x[0]):
        score.tempos.append({"tick": at(tick), "bpm": rounded(bpm * 100) / 100})
    for tick, n, d in sorted(meters, key=lambda x: x[0]):
        score.meters.append({"tick": at(tick), "numerator": n, "denominator": d})
    for tick, fifths, mode in sorted(keys, key=lambda x: x[0]):
        score.keys.append({"tick": at(tick), "fifths": clamp(fifths, -7, 7), "mode": mode})
    if not score.tracks:
        score.warn("MIDI file contains no notes.")
    elif any(drums):
        score.warn("Percussion track(s) present; they are not suitable for tab.")
    score.aim(drums)
    return score.settle()


def _varint(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def _track(rows: list[tuple[int, int, bytes]]) -> bytes:
    body, last = b"", 0
    for tick, _, data in sorted(rows, key=lambda r: (r[0], r[1])):
        body += _varint(tick - last) + data
        last = tick
    body += b"\0\xff\x2f\0"
    return b"MTrk" + len(body).to_bytes(4, "big") + body


def _meta(kind: int, data: bytes) -> bytes:
    return bytes([0xFF, kind]) + _varint(len(data)) + data


def sounding_notes(notes: list[Note]) -> list[Note]:
    """Ties joined: a tied note lengthens the latest one of its pitch that ends within a tick of it."""
    out: list[Note] = []
    for n in sorted(notes, key=lambda n: (n.start, n.pitch)):
        before = next((m for m in reversed(out) if m.pitch == n.pitch and abs(m.start + m.duration - n.start) <= 1), None) if n.tied else None
        if before:
            before.duration = n.start + n.duration - before.start
        else:
            out.append(Note(n.pitch, n.start, max(1, n.duration), n.velocity))
    return out


def write_midi(score: Score) -> bytes:
    """Format 1; channel 9 is left out, and a guitar track sounds as a guitar."""
    head = [(0, 0, _meta(3, str(score.meta.get("title", "")).encode()))]
    for t in score.tempos or [{"tick": 0, "bpm": 120.0}]:
        head.append((t["tick"], 1, _meta(0x51, min(0xFFFFFF, rounded(60e6 / t["bpm"])).to_bytes(3, "big"))))
    for t in score.meters or [{"tick": 0, "numerator": 4, "denominator": 4}]:
        head.append((t["tick"], 2, _meta(0x58, bytes([t["numerator"], t["denominator"].bit_length() - 1, 24, 8]))))
    for t in score.keys:
        head.append((t["tick"], 3, _meta(0x59, clamp(t["fifths"], -7, 7).to_bytes(1, "big", signed=True) + bytes([t["mode"] == "minor"]))))
    guitar = next((t for t in score.tracks if t.target), None) or next((t for t in score.tracks if t.notes), None)
    lanes = [_track(head)]
    for i, t in enumerate(score.tracks):
        channel = min(15, i + (i >= 9))
        program = 25 if t is guitar and not 24 <= t.program <= 31 else t.program
        rows = [(0, 0, _meta(3, t.name.encode())), (0, 1, bytes([0xC0 | channel, program]))]
        for n in sounding_notes(t.notes):
            rows.append((n.start, 3, bytes([0x90 | channel, n.pitch, clamp(n.velocity, 1, 127)])))
            rows.append((n.start + n.duration, 2, bytes([0x80 | channel, n.pitch, 0])))
        lanes.append(_track(rows))
    return b"MThd" + (6).to_bytes(4, "big") + (1).to_bytes(2, "big") + len(lanes).to_bytes(2, "big") + score.ppq.to_bytes(2, "big") + b"".join(lanes)
