"""Music-theory functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import STANDARD

# Fixed values.
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
MAJORS = ("Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#")
MINORS = ("Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#", "G#", "D#", "A#")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def half_up(x: Column) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(x + 0.5).cast("long")


def pitch_class(midi: Column) -> Column:
    return F.pmod(midi, F.lit(12)).cast("int")


def octave(midi: Column) -> Column:
    return (F.floor(midi / 12) - 1).cast("int")


def pitch_name(pc: Column, flats: Column | bool = False) -> Column:
    flat = F.lit(flats) if isinstance(flats, bool) else flats
    return F.when(flat, F.element_at(strings(FLATS), pc + 1)).otherwise(F.element_at(strings(SHARPS), pc + 1))


def midi_name(midi: Column, flats: Column | bool = False) -> Column:
    return F.concat(pitch_name(pitch_class(midi), flats), octave(midi).cast("string"))


def name_midi(name: Column) -> Column:
    """MIDI number of ``C4``, ``f##``, ``Bx-1``; octave 4 by default, null if invalid."""
    t = F.trim(name)
    pattern = r"^([A-Ga-g])(#{1,2}|b{1,2}|x)?(-?\d+)?$"
    step, acc, octv = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    shift = F.when(acc == "x", 2).when(acc.startswith("#"), F.length(acc)).when(acc.startswith("b"), -F.length(acc)).otherwise(0)
    number = F.when(octv == "", F.lit(4)).otherwise(F.expr("try_cast(null as int)"))
    number = F.when(octv == "", 4).otherwise(octv.try_cast("int"))
    return F.when(t.rlike(pattern), (number + 1) * 12 + F.element_at(lookup(STEPS), F.upper(step)) + shift).cast("int")


def spelling_midi(step: Column, alter: Column, octv: Column) -> Column:
    return (octv + 1) * 12 + F.element_at(lookup(STEPS), step) + alter


def spell(midi: Column, fifths: Column) -> Column:
    """``struct<step, alter, octave>``: accidentals are flats in flat keys, else sharps."""
    pc = pitch_class(midi)
    name = pitch_name(pc, fifths < 0)
    alter = F.when(F.length(name) == 1, 0).when(fifths < 0, -1).otherwise(1)
    return F.struct(F.substring(name, 1, 1).alias("step"), alter.cast("int").alias("alter"), octave(midi).alias("octave"))


def key_name(fifths: Column, mode: Column) -> Column:
    at = (fifths + 8).cast("int")
    return F.when(mode == "minor", F.concat(F.element_at(strings(MINORS), at), F.lit(" minor"))).otherwise(F.concat(F.element_at(strings(MAJORS), at), F.lit(" major")))


def key_fifths(name: Column, mode: Column) -> Column:
    """Fifths of a tonic's name in a mode; 0 where it has none."""
    minor = F.array_position(strings(MINORS), name)
    major = F.array_position(strings(MAJORS), name)
    at = F.when(mode == "minor", minor).otherwise(major)
    return F.when(at > 0, at - 8).otherwise(0).cast("int")


def note_values(ppq: Column) -> Column:
    """The 28 note values in order, as ``array<struct<base, dots, triplet, ticks>>``."""
    out = []
    for base in (1, 2, 4, 8, 16, 32, 64):
        plain = ppq * 4 / base
        for dots, triplet, ticks in ((0, False, plain), (1, False, plain * 1.5), (2, False, plain * 1.75), (0, True, plain * 2 / 3)):
            out.append(F.struct(F.lit(base).alias("base"), F.lit(dots).alias("dots"), F.lit(triplet).alias("triplet"), ticks.cast("double").alias("ticks")))
    return F.array(*out)


def note_value(ticks: Column, ppq: Column) -> Column:
    """The nearest note value; the first of equally near ones."""
    ranked = F.transform(note_values(ppq), lambda v, i: F.struct(F.abs(v["ticks"] - ticks).alias("off"), i.alias("i"), v["base"].alias("base"), v["dots"].alias("dots"), v["triplet"].alias("triplet")))
    return F.array_min(ranked)


def value_ticks(base: Column, dots: Column, triplet: Column, ppq: Column) -> Column:
    plain = ppq * 4 / base
    t = F.when(triplet, plain * 2 / 3).otherwise(plain)
    return half_up(t * (2 - F.pow(F.lit(0.5), dots)))


def playable(pitch: Column, tuning=STANDARD, capo: int = 0, max_fret: int = 22) -> Column:
    """``array<struct<string, fret>>``, highest string first."""
    all_ = F.array(*[F.struct(F.lit(i).alias("string"), (pitch - p).cast("int").alias("fret")) for i, p in enumerate(tuning)])
    return F.filter(all_, lambda x: (x["fret"] >= capo) & (x["fret"] <= max_fret))


def gain(velocity: Column) -> Column:
    return F.pow(F.greatest(F.lit(1), velocity) / 127, F.lit(1.3))


def hz_midi(hz: Column) -> Column:
    return F.lit(69.0) + F.lit(12.0) * F.log2(hz / 440.0)


def alterations(fifths: Column) -> Column:
    """Alteration of each step C..B in a key."""
    sharp, flat = ("F", "C", "G", "D", "A", "E", "B"), ("B", "E", "A", "D", "G", "C", "F")
    return F.array(*[F.when(fifths > sharp.index(s), 1).when(-fifths > flat.index(s), -1).otherwise(0) for s in STEPS])


def diatonic_midi(dia: Column, alter: Column) -> Column:
    """MIDI of a diatonic number, 28 for C4, with an alteration."""
    return (F.floor(dia / 7) + 1).cast("int") * 12 + F.element_at(F.array(*[F.lit(v) for v in STEPS.values()]), (F.pmod(dia, F.lit(7)) + 1).cast("int")) + alter


def xml_escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def clock(text: Column) -> Column:
    """Seconds of ``90``, ``1:30``, ``1:02:03``, ``1h2m3s``; null if invalid."""
    t = F.lower(F.trim(text))
    parts = F.transform(F.split(t, ":"), lambda x: x.try_cast("double"))
    colon = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    units = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s?)?$"
    h, m, s = (F.coalesce(F.regexp_extract(t, units, i).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3))
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")).when(t.rlike(r"^\d+(:\d{1,2}){1,2}(\.\d+)?$"), colon).when(t.rlike(units) & (t != ""), h * 3600 + m * 60 + s)
