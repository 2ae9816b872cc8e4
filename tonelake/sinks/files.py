"""Writing scores from their rows: one file's bytes per score."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import records, table
from ..operators.tab import Guitar
from ..sources.midi import write_midi
from ..sources.project import write_project
from ..sources.score import Note, Score, Track
from .ascii_tab import render
from .musicxml import bars_of, write_musicxml


def assembled(notes: DataFrame, meters: DataFrame, keys: DataFrame, tempos: DataFrame) -> DataFrame:
    """One row per score with everything in arrays, in order."""
    have = set(notes.columns)
    pick = lambda c, t, d=None: (F.col(c) if c in have else F.lit(d)).cast(t).alias(c)
    item = F.struct(
        F.col("track_ord").cast("int").alias("track_ord"), F.col("note_ord").cast("int").alias("note_ord"), F.col("pitch").cast("int").alias("pitch"), F.col("start_tick").cast("long").alias("start"), F.col("duration").cast("long").alias("duration"),
        pick("velocity", "int", 90), pick("voice", "int", 0), pick("string", "int"), pick("fret", "int"), pick("tied_from_previous", "boolean", False),
    )
    rows = notes.groupBy("score_id").agg(F.sort_array(F.collect_list(item)).alias("notes"))
    for df, cols, name in ((meters, ["numerator", "denominator"], "meters"), (keys, ["fifths", "mode"], "keys"), (tempos, ["bpm"], "tempos")):
        listed = df.groupBy("score_id").agg(F.sort_array(F.collect_list(F.struct("ord", "tick", *cols))).alias(name))
        rows = rows.join(listed, "score_id", "left")
    return rows


def to_score(row) -> Score:
    """A :class:`Score` from one row of :func:`assembled`."""
    s = Score()
    tracks: dict[int, Track] = {}
    for n in row["notes"]:
        t = tracks.setdefault(n["track_ord"], Track(f"t{n['track_ord']}", f"Track {n['track_ord'] + 1}"))
        tab = {"string": n["string"], "fret": n["fret"]} if n["string"] is not None else None
        t.notes.append(Note(n["pitch"], n["start"], n["duration"], n["velocity"], n["voice"], tab=tab, tied=bool(n["tied_from_previous"])))
    s.tracks = [tracks[k] for k in sorted(tracks)]
    for name in ("meters", "keys", "tempos"):
        rows = row[name]
        setattr(s, name, [] if rows is None else [{k: v for k, v in (x.asDict() if hasattr(x, "asDict") else dict(x)).items() if k != "ord"} for x in rows])
    return s


def as_midi(s: Score) -> bytes:
    return write_midi(s)


def as_musicxml(s: Score) -> bytes:
    return write_musicxml(s).encode()


def as_project(s: Score) -> bytes:
    return write_project(s).encode()


def as_tab(s: Score) -> bytes:
    track = next((t for t in s.tracks if t.notes), None)
    notes = [{"start": n.start, "string": n.tab["string"], "fret": n.tab["fret"]} for n in (track.notes if track else []) if n.tab and not n.tied]
    return render(notes, [(a, b) for a, b, _ in bars_of(s)], Guitar(), s.ppq).encode()


def export(rows: DataFrame, write: Callable[[Score], bytes]) -> DataFrame:
    """``(score_id, content)`` of assembled scores."""

    schema = pa.schema([("score_id", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for part in records(batches):
            yield table([(r["score_id"], write(to_score(r))) for r in part], schema)

    return rows.mapInArrow(run, "score_id long, content binary")
