"""Durations and pitches of written symbols, page geometry, small text helpers."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .theory import STEPS, half_up, lookup

# Harmony kinds of MusicXML, standard lengths in sixteenths, written values in quarters.
KINDS = {
    "major": "", "minor": "m", "augmented": "aug", "diminished": "dim", "dominant": "7", "major-seventh": "maj7", "minor-seventh": "m7",
    "diminished-seventh": "dim7", "augmented-seventh": "aug7", "half-diminished": "m7b5", "major-minor": "m(maj7)", "major-sixth": "6",
    "minor-sixth": "m6", "dominant-ninth": "9", "major-ninth": "maj9", "minor-ninth": "m9", "dominant-11th": "11", "dominant-13th": "13",
    "suspended-second": "sus2", "suspended-fourth": "sus4", "power": "5", "none": "",
}
STANDARD_LENGTHS = (0.5, 1, 1.5, 2, 3, 4, 6, 8, 12, 16)
VALUES = ((4.0, "w"), (3.0, "hd"), (2.0, "h"), (1.5, "qd"), (1.0, "q"), (0.75, "8d"), (0.5, "8"), (0.375, "16d"), (0.25, "16"), (0.125, "32"))


def dotted(base: Column, dots: Column) -> Column:
    return F.when(dots <= 0, base).when(dots == 1, base * 1.5).otherwise(base * 1.75)


def head_ticks(hollow: Column, stemmed: Column, flags: Column, dots: Column, ppq: Column) -> Column:
    whole = ppq * 4.0
    solid = F.when(stemmed, whole / 4 / F.pow(F.lit(2.0), F.least(F.lit(3), flags))).otherwise(whole / 4)
    return half_up(dotted(F.when(hollow, F.when(stemmed, whole / 2).otherwise(whole)).otherwise(solid), dots))


def rest_ticks(kind: Column, dots: Column, measure: Column, ppq: Column) -> Column:
    """A whole rest fills its measure."""
    part = F.when(kind == "half", 2).when(kind == "quarter", 4).when(kind == "eighth", 8).otherwise(16)
    return F.when(kind == "whole", measure).otherwise(half_up(dotted(ppq * 4.0 / part, dots)))


def quantized(ticks: Column, grid: Column) -> Column:
    return F.greatest(grid, half_up(ticks / grid) * grid)


def snapped(ticks: Column, ppq: Column) -> Column:
    """The standard length nearest on a log scale, the first of equals."""
    v = F.greatest(F.lit(1.0), ticks.cast("double"))
    options = F.array(*[F.lit(float(u)) for u in STANDARD_LENGTHS])
    return F.array_min(F.transform(options, lambda u, i: F.struct(F.abs(F.log(u * ppq / 4 / v)).alias("off"), i.alias("i"), (u * ppq / 4).alias("ticks"))))["ticks"]


def written(ticks: Column, ppq: Column) -> Column:
    """Note values that add up to ``ticks``, greedily, as an array of names; at most a dozen."""
    sizes = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(n).alias("n")) for q, n in VALUES])

    def step(acc: Column, _: Column) -> Column:
        fit = F.get(F.filter(sizes, lambda v: v["q"] <= acc["left"] + 1e-6), 0)
        go = (acc["left"] >= 0.1) & fit.isNotNull()
        return F.struct(F.when(go, acc["left"] - fit["q"]).otherwise(acc["left"]).alias("left"), F.when(go, F.concat(acc["out"], F.array(fit["n"]))).otherwise(acc["out"]).alias("out"))

    zero = F.struct((ticks / ppq).cast("double").alias("left"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), zero, step, lambda a: a["out"])


def written_key(step: Column, alter: Column, octave: Column) -> Column:
    """``c#/5``: an octave above what sounds."""
    mark = F.when(alter > 0, F.repeat(F.lit("#"), alter)).when(alter < 0, F.repeat(F.lit("b"), -alter)).otherwise("")
    return F.concat(F.lower(step), mark, F.lit("/"), (octave + 1).cast("string"))


def key_pitch(key: Column) -> Column:
    """The MIDI number a written key stands for on the page."""
    pattern = r"^([a-g])(#*|b*)/(-?\d+)$"
    step, marks, octave = (F.regexp_extract(key, pattern, i) for i in (1, 2, 3))
    alter = F.when(marks.startswith("#"), F.length(marks)).otherwise(-F.length(marks))
    return F.when(key.rlike(pattern), (octave.try_cast("int") + 1) * 12 + F.element_at(lookup(STEPS), F.upper(step)) + alter)


def root_pc(root: Column) -> Column:
    """Pitch class of a root with any mixture of accidentals, null if invalid."""
    t = F.trim(root)
    marks = F.regexp_extract(t, r"^[A-Ga-g]\s*([#♯b♭x]*)$", 1)
    count = lambda p: F.regexp_count(marks, F.lit(p))
    shift = count("[#♯]") + 2 * count("x") - count("[b♭]")
    return F.when(t.rlike(r"^[A-Ga-g]\s*[#♯b♭x]*$"), F.pmod(F.element_at(lookup(STEPS), F.upper(F.substring(t, 1, 1))) + shift, F.lit(12)).cast("int"))


def plain_quality(q: Column) -> Column:
    """One spelling for each quality, to compare by."""
    s = F.regexp_replace(F.trim(F.coalesce(q, F.lit(""))), r"[()\s]", "")
    for pattern, to in ((r"♭", "b"), (r"♯", "#"), (r"(?i)^maj$", ""), (r"(?i)^major$", ""), (r"(?i)^min(or)?", "m"), (r"^-", "m"), (r"^M7$", "maj7"), (r"^(Δ|△)7?", "maj7"), (r"(?i)^ma7", "maj7"), (r"^M9$", "maj9"), (r"(?i)^mmaj7$", "m(maj7)"), (r"^°7?", "dim7"), (r"^o7$", "dim7"), (r"^\+$", "aug"), (r"^ø7?$", "m7b5")):
        s = F.regexp_replace(s, pattern, to)
    return F.lower(s)


def file_extension(name: Column) -> Column:
    last = F.regexp_extract(name, r"([^\\/]*)$", 1)
    return F.when(last.contains("."), F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))).otherwise("")


def file_base(name: Column) -> Column:
    last = F.regexp_extract(name, r"([^\\/]*)$", 1)
    return F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_extract(last, r"^(.+)\.[^.]*$", 1)).otherwise(last)


def to_page(x: Column, y: Column, t: dict) -> Column:
    """From deskewed to original pixels; ``t`` has scale, angle, cx, cy."""
    import math

    c, s = math.cos(t["angle"]), math.sin(t["angle"])
    u, v = x - t["cx"], y - t["cy"]
    return F.struct(((u * c - v * s + t["cx"]) / t["scale"]).alias("x"), ((u * s + v * c + t["cy"]) / t["scale"]).alias("y"))


def from_page(x: Column, y: Column, t: dict) -> Column:
    """The inverse of :func:`to_page`."""
    import math

    c, s = math.cos(t["angle"]), math.sin(t["angle"])
    u, v = x * t["scale"] - t["cx"], y * t["scale"] - t["cy"]
    return F.struct((u * c + v * s + t["cx"]).alias("x"), (-u * s + v * c + t["cy"]).alias("y"))


def grid_division(ticks: Column, ppq: int) -> Column:
    """The first division of a quarter on which all ``ticks`` lie, else an eighth of it."""
    out = F.lit(ppq / 8)
    for d in reversed((4, 8, 12, 6, 24, 16, 48)):
        if ppq % d == 0:
            u = ppq / d
            out = F.when(F.forall(ticks, _on(u)), F.lit(u)).otherwise(out)
    return out


def _on(u: float):
    return lambda t: F.abs(t / u - F.floor(t / u + 0.5)) < 1e-6


def grey_png(width: int, height: int, grey: bytes) -> bytes:
    """An 8-bit grey PNG."""
    rows = b"".join(b"\0" + grey[i * width : (i + 1) * width] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

