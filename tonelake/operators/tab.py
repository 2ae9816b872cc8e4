"""Guitar fingerings: strings and frets for the notes of a guitar track.

A score's notes are one task, since the choice runs through time; candidate
positions are few (strings) and eight fingerings are kept per onset.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..batches import records, table
from ..functions.theory import SHARPS
from ..model import MAX_FRET, STANDARD
from .timeline import locate

# Fixed values.
BEAM = 8
ENOUGH = 4001
SPANS = (4, 6, 12)
FINGERED = "score_id long, track_ord int, note_ord int, pitch int, string int, fret int, transposed boolean, warnings array<string>"

Spot = tuple[int, int]


@dataclass(frozen=True)
class Guitar:
    tuning: tuple[int, ...] = STANDARD
    capo: int = 0
    max_fret: int = MAX_FRET

    def spots(self, pitch: int) -> list[Spot]:
        """Where ``pitch`` can be played, highest string first."""
        return [(s, pitch - p) for s, p in enumerate(self.tuning) if self.capo <= pitch - p <= self.max_fret]

    def pressed(self, spots: list[Spot]) -> list[int]:
        return [f for _, f in spots if f > self.capo]


def cost(spots: list[Spot], guitar: Guitar) -> tuple[float, int | None]:
    """Static cost of sounding ``spots`` together, and the lowest pressed fret."""
    frets = guitar.pressed(spots)
    low = min(frets) if frets else None
    total = 2.0 * (max(frets) - low) if frets else 0.0
    if frets:
        total += (sum(frets) / len(frets) - guitar.capo) * 0.3
    strings = {s for s, _ in spots}
    if len(spots) > 1:
        total += 0.7 * (max(strings) - min(strings) + 1 - len(strings))
    total += 1.5 * sum(f > 12 for f in frets)
    free = len(spots) - len(frets)
    if free and (low is None or low - guitar.capo <= 5):
        total -= 0.5 * free
    return total, low


def _reachable(spots: list[Spot], guitar: Guitar, span: int) -> bool:
    frets = guitar.pressed(spots)
    if len(frets) < 2:
        return True
    return max(frets) - min(frets) <= (max(span, 5) if min(frets) >= 7 else span)


def fingerings(choices: list[list[Spot]], held: list[Spot], guitar: Guitar, span: int) -> Iterator[list[Spot]]:
    """Assignments to distinct strings within a span; notes with fewest choices vary slowest."""
    order = sorted(range(len(choices)), key=lambda i: len(choices[i]))

    def extend(placed: dict[int, Spot], depth: int) -> Iterator[list[Spot]]:
        if depth == len(order):
            yield [placed[i] for i in range(len(order))]
            return
        taken = {s for s, _ in held} | {s for s, _ in placed.values()}
        for spot in choices[order[depth]]:
            if spot[0] not in taken and _reachable([*held, *placed.values(), spot], guitar, span):
                yield from extend({**placed, order[depth]: spot}, depth + 1)

    yield from extend({}, 0)


@dataclass
class Item:
    """A note on its way through the assignment."""

    key: int
    pitch: int
    start: int
    duration: int
    voice: int
    spot: Spot | None
    locked: bool
    tied: bool
    transposed: bool = False
    source: Item | None = None


@dataclass
class _Layer:
    free: list[Item]
    held: list[Item]
    options: list = field(default_factory=list)  # (spots, cost, own position, strings)
    best: list = field(default_factory=list)  # (total, back, position reached)


def _tie_source(n: Item, same: list[Item]) -> Item | None:
    """What ``n`` goes on from, among the notes of its pitch: the one of its voice that ends where it starts, else any still sounding."""
    exact = (m for m in same if m is not n and m.start + m.duration == n.start and m.voice == n.voice)
    loose = (m for m in same if m is not n and m.start < n.start <= m.start + m.duration)
    return next(exact, None) or next(loose, None)


def _into_range(n: Item, guitar: Guitar) -> int | None:
    """The nearest playable octave, first toward the instrument's top string."""
    toward = -1 if n.pitch > guitar.tuning[0] else 1
    return next((n.pitch + 12 * k * s for k in range(1, 11) for s in (toward, -toward) if guitar.spots(n.pitch + 12 * k * s)), None)


def _trim(free: list[Item], room: int) -> list[Item]:
    """The outer notes, highest first, then lowest, alternating until there is no room."""
    rest, kept, top = sorted(free, key=lambda n: n.pitch), [], True
    while len(kept) < room and rest:
        kept.append(rest.pop(-1 if top else 0))
        top = not top
    return kept


def _layer(notes: list[Item], guitar: Guitar, warn) -> _Layer:
    held = [n for n in notes if n.locked and n.spot]
    free = [n for n in notes if not (n.locked and n.spot) and guitar.spots(n.pitch)]
    room = max(0, len(guitar.tuning) - len(held))
    if len(free) > room:
        kept = _trim(free, room)
        gone = [n for n in free if n not in kept]
        for n in gone:
            n.spot = None
        warn(f"{len(gone)} note{'s' if len(gone) > 1 else ''} dropped", notes[0].start, f" (more than {len(guitar.tuning)} simultaneous notes)")
        free = kept
    at = tuple(n.spot for n in held)
    options = _options(tuple(n.pitch for n in free), at, guitar)
    while not options and len(free) > 1:
        middle = sorted(free, key=lambda n: n.pitch)[len(free) // 2]
        free = [n for n in free if n is not middle]
        middle.spot = None
        warn("1 note dropped", notes[0].start, " (no playable fingering)")
        options = _options(tuple(n.pitch for n in free), at, guitar)
    if not options:
        for n in free:
            n.spot = None
        free, options = [], _options((), at, guitar)
    return _Layer(free, held, list(options))


@lru_cache(maxsize=1 << 15)
def _options(pitches: tuple[int, ...], at: tuple[Spot, ...], guitar: Guitar) -> tuple:
    """The ``BEAM`` cheapest ways to sound ``pitches`` beside ``at``: ``(spots, cost, lowest pressed fret, strings)``.

    Onsets repeat, within a score and from score to score, so a worker keeps
    what it has found.
    """
    found: list = [[]]
    if pitches:
        choices = [guitar.spots(p) for p in pitches]
        found = next((f for span in SPANS if (f := list(itertools.islice(fingerings(choices, list(at), guitar, span), ENOUGH)))), [])
    costed = [(f, *cost([*at, *f], guitar)) if at or f else (f, 0.0, None) for f in found]
    return tuple((f, c, low, [s for s, _ in [*at, *f]]) for f, c, low in sorted(costed, key=lambda x: x[1])[:BEAM])


def _lead(layer: _Layer) -> Item | None:
    return (layer.free or layer.held or [None])[0]


def _link(now: _Layer, was: _Layer) -> None:
    lone = len(now.free) + len(now.held) == 1 == len(was.free) + len(was.held)
    for _, own, low, strings in now.options:
        best = None
        for j, ((_, _, _, before), (sofar, _, hand)) in enumerate(zip(was.options, was.best)):
            t = sofar + own
            if low is not None and hand is not None:
                t += abs(low - hand)
            if lone and len(before) == 1 and len(strings) == 1:
                jump = abs(before[0] - strings[0])
                if jump > 2:
                    t += 2
                if jump == 0 and abs(_lead(was).pitch - _lead(now).pitch) <= 2:
                    t -= 0.3
            if best is None or t < best[0]:
                best = (t, j, hand if low is None else low)
        now.best.append(best)


def assign(notes: list[Item], guitar: Guitar, measure_of) -> list[str]:
    """Gives every note its spot, in place; returns the new warnings in order."""
    warnings: list[str] = []

    def warn(what: str, tick: int, why: str = "") -> None:
        warnings.append(f"{what} at measure {measure_of(tick)}{why}")

    ordered = sorted(notes, key=lambda n: (n.start, n.pitch))
    by_pitch: dict[int, list[Item]] = {}
    for n in ordered:
        by_pitch.setdefault(n.pitch, []).append(n)
    for n in ordered:
        if n.tied:
            n.source = _tie_source(n, by_pitch[n.pitch])
    for n in ordered:
        if (n.locked and n.spot) or n.source or guitar.spots(n.pitch):
            continue
        name, to = f"{SHARPS[n.pitch % 12]}{n.pitch // 12 - 1}", _into_range(n, guitar)
        if to is None:
            warn(f"Could not find a playable position for {name}", n.start)
            continue
        octaves = abs(to - n.pitch) // 12
        moved = f" transposed {'down' if to < n.pitch else 'up'} {'an octave' if octaves == 1 else f'{octaves} octaves'}"
        n.pitch, n.transposed = to, True
        warnings.append(f"Note {name} at measure {measure_of(n.start)}{moved}")
    onsets: dict[int, list[Item]] = {}
    for n in ordered:
        if not n.source:
            onsets.setdefault(n.start, []).append(n)
    layers = [_layer(onsets[t], guitar, warn) for t in sorted(onsets)]
    for i, layer in enumerate(layers):
        if i == 0:
            layer.best = [(c, -1, low) for _, c, low, _ in layer.options]
        else:
            _link(layer, layers[i - 1])
    if layers:
        at = min(range(len(layers[-1].best)), key=lambda k: layers[-1].best[k][0])
        for layer in reversed(layers):
            for n, spot in zip(layer.free, layer.options[at][0]):
                n.spot = spot
            at = layer.best[at][1]
    for n in ordered:
        if n.source and n.source.spot:
            n.spot = n.source.spot
    return list(dict.fromkeys(warnings))


def assign_tab(notes: DataFrame, bars: DataFrame, guitar: Guitar = Guitar()) -> DataFrame:
    """String and fret of every note of the guitar tracks in ``notes``.

    Optional columns ``string``, ``fret``, ``tab_locked`` and
    ``tied_from_previous`` hold earlier fingerings and ties.  Notes out of
    range move by octaves, locked ones never move, and tied ones take the spot
    of the note they go on from.  ``warnings`` stands on a score's first row;
    a score that cannot be fingered is returned as it came, with a warning.
    """
    have = set(notes.columns)
    rows = notes.select(
        "score_id", "track_ord", "note_ord", "pitch", "start_tick", "duration",
        *[(F.col(c) if c in have else F.lit(d)).cast(t).alias(c) for c, d, t in (("voice", 0, "int"), ("string", None, "int"), ("fret", None, "int"), ("tab_locked", False, "boolean"), ("tied_from_previous", False, "boolean"))],
    )
    # Warnings name a note's measure, found here: one number a note goes to Python, whatever the score's length.
    by_end = Window.partitionBy("score_id").orderBy("end_tick")
    grid = bars.where("end_tick is not null").select("score_id", "end_tick", F.row_number().over(by_end).alias("index"), F.lag("end_tick", 1, 0).over(by_end).alias("start_tick"))
    last = grid.groupBy("score_id").agg(F.max("index").alias("last"))
    within = F.when(F.col("measure").isNull() & (F.col("start_tick") >= 0), F.col("last")).otherwise(F.col("measure"))
    rows = locate(rows, grid, "start_tick").join(last, "score_id", "left").withColumn("measure", F.coalesce(within, F.lit(1))).drop("measure_start", "measure_end", "last")

    note = F.struct("track_ord", "note_ord", "pitch", "start_tick", "duration", "voice", "string", "fret", "tab_locked", "tied_from_previous", "measure")
    scores = rows.groupBy("score_id").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    schema = pa.schema([("score_id", pa.int64()), *[(c, pa.int32()) for c in ("track_ord", "note_ord", "pitch", "string", "fret")], ("transposed", pa.bool_()), ("warnings", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in records(batches):
            out = []
            for score in part:
                found = score["notes"]
                measure_of = {r["start_tick"]: int(r["measure"]) for r in found}.__getitem__
                items = []
                for i, r in enumerate(found):
                    spot = None if r["string"] is None or r["fret"] is None else (r["string"], r["fret"])
                    items.append(Item(i, int(r["pitch"]), int(r["start_tick"]), int(r["duration"]), int(r["voice"]), spot, bool(r["tab_locked"]), bool(r["tied_from_previous"])))
                before = [(n.pitch, n.spot) for n in items]
                try:
                    warnings = assign(items, guitar, measure_of)
                except Exception as e:  # a score that cannot be fingered keeps what it has; the job goes on
                    for n, (pitch, spot) in zip(items, before):
                        n.pitch, n.spot, n.transposed = pitch, spot, False
                    warnings = [f"Fingering failed: {e or type(e).__name__}"]
                for r, n in zip(found, items):
                    string, fret = n.spot or (None, None)
                    out.append((score["score_id"], r["track_ord"], r["note_ord"], n.pitch, string, fret, n.transposed, None if n.key else warnings))
            yield table(out, schema)

    return scores.mapInArrow(run, FINGERED)
