"""Reading files of any supported kind into score tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import records
from . import abc, guitarpro, midi, musicxml, project
from .score import FormatError, Score, base_name, decode, extension

# Kinds by extension.
KINDS = {
    "mid": "midi", "midi": "midi", "kar": "midi", "xml": "musicxml", "musicxml": "musicxml", "mxl": "musicxml", "abc": "abc", "json": "project",
    "gp3": "guitarpro", "gp4": "guitarpro", "gp5": "guitarpro", "gpx": "guitarpro", "gp": "guitarpro", "pdf": "pdf",
    "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "mp3": "audio", "wav": "audio", "m4a": "audio", "ogg": "audio", "flac": "audio",
}
#: Parsed files are handed on once they hold so many notes.
NOTES_AT_ONCE = 5000
_NOTE = "pitch:int,start:bigint,duration:bigint,velocity:int,voice:int,spelling:struct<step:string,alter:int,octave:int>,tab:struct<string:int,fret:int>,locked:boolean,tied:boolean,articulations:array<string>,confidence:double"
PARSED = (
    "path string, kind string, error string, title string, composer string, source string, ppq int, warnings array<string>, meta_json string, "
    f"tracks array<struct<id:string,name:string,program:int,target:boolean,notes:array<struct<{_NOTE}>>>>, "
    "meters array<struct<tick:bigint,numerator:int,denominator:int>>, keys array<struct<tick:bigint,fifths:int,mode:string>>, tempos array<struct<tick:bigint,bpm:double>>"
)

_listed = lambda **fields: pa.list_(pa.struct(list(fields.items())))
_INT, _LONG, _TEXT, _FLAG, _REAL = pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.float64()
_NOTES = _listed(
    pitch=_INT, start=_LONG, duration=_LONG, velocity=_INT, voice=_INT, spelling=pa.struct([("step", _TEXT), ("alter", _INT), ("octave", _INT)]), tab=pa.struct([("string", _INT), ("fret", _INT)]),
    locked=_FLAG, tied=_FLAG, articulations=pa.list_(_TEXT), confidence=_REAL,
)
#: ``PARSED`` in Arrow's types.
_ARROW = pa.schema([
    *[(c, _TEXT) for c in ("path", "kind", "error", "title", "composer", "source")], ("ppq", _INT), ("warnings", pa.list_(_TEXT)), ("meta_json", _TEXT),
    ("tracks", _listed(id=_TEXT, name=_TEXT, program=_INT, target=_FLAG, notes=_NOTES)),
    ("meters", _listed(tick=_LONG, numerator=_INT, denominator=_INT)), ("keys", _listed(tick=_LONG, fifths=_INT, mode=_TEXT)), ("tempos", _listed(tick=_LONG, bpm=_REAL)),
])


def detect_kind(name: Column, head: Column) -> Column:
    """Kind by extension, else by the first bytes; ``zip`` still has to be looked into."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.\\/]*)$", 1))
    by_ext = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ext)
    hexed = F.hex(F.substring(head, 1, 32))
    text = F.ltrim(F.regexp_replace(F.make_valid_utf8(F.substring(head, 1, 2048).cast("string")), "^\ufeff", ""))
    starts = lambda *h: F.lit(False) if not h else hexed.startswith(h[0]) if len(h) == 1 else hexed.startswith(h[0]) | starts(*h[1:])
    found = (
        F.when(text.rlike(rf'"format"\s*:\s*"{project.FORMAT}"'), "project").when(starts("4D546864"), "midi").when(starts("25504446"), "pdf")
        .when(starts("4243465A", "42434653"), "guitarpro").when(starts("504B"), "zip").when(starts("89504E47", "FFD8"), "image")
        .when(starts("52494646") & (F.substring(hexed, 17, 8) == "57454250"), "image").when(starts("52494646") & (F.substring(hexed, 17, 8) == "57415645"), "audio")
        .when(starts("494433", "4F676753", "664C6143"), "audio").when(F.substring(hexed, 9, 8) == "66747970", "audio")
        .when(starts("FF") & F.substring(hexed, 3, 1).isin("E", "F"), "audio").when(starts("1346494348494552204755495441522050524F"), "guitarpro")
        .when(text.startswith("<?xml") | text.contains("<score-partwise") | text.contains("<score-timewise"), "musicxml")
        .when(text.rlike(r"(?m)^(%abc|X:\s*\d)"), "abc").otherwise("unknown")
    )
    return F.coalesce(by_ext, found)


def zip_kind(data: bytes) -> str:
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile:
        return "unknown"
    if "META-INF/container.xml" in names:
        return "musicxml"
    return "guitarpro" if any(re.search(r"\.gpif$", n, re.I) for n in names) else "unknown"


def parse(name: str, kind: str, data: bytes) -> Score:
    """One file's score; raises for kinds that hold none."""
    if kind == "project":
        score, saved = project.read_project(decode(data))
        if saved and not score.meta.get("title"):
            score.meta["title"] = saved
        return score
    readers = {"midi": midi.read_midi, "musicxml": musicxml.read_musicxml, "guitarpro": guitarpro.read_guitarpro, "abc": lambda d: abc.read_abc(decode(d))}
    if kind not in readers:
        raise FormatError(f"Unsupported file type: {name}")
    score = readers[kind](data)
    score.meta["source"] = kind
    score.meta.setdefault("title", base_name(name))
    if not any(t.notes for t in score.tracks):
        score.warn("No notes were found in this file.")
    return score


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its parsed score, or with ``error``.

    Files are read by Spark, so any store it knows will do; each is parsed in
    the task that reads it.
    """
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def parsed(files: DataFrame) -> DataFrame:
    """The same for rows of ``(path, content)``."""
    rows = files.select("path", detect_kind(F.col("path"), F.col("content")).alias("kind"), "content")


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in records(batches):
            out, notes = [], 0
            for r in part:
                p, kind, data = r["path"], r["kind"], r["content"]
                kind = zip_kind(data) if kind == "zip" else kind
                row = {"path": p, "kind": kind, "error": None, "title": None, "composer": None, "source": None, "ppq": None, "warnings": None, "meta_json": None, "tracks": None, "meters": None, "keys": None, "tempos": None}
                try:
                    s = parse(p, kind, data)
                except Exception as e:  # a file that can't be read is a row, not a failed job
                    row["error"] = str(e) or type(e).__name__
                else:
                    d = s.as_dict()
                    row |= {"title": s.meta.get("title"), "composer": s.meta.get("composer"), "source": s.meta.get("source"), "ppq": s.ppq, "warnings": s.warnings, "meta_json": json.dumps(s.meta), **{k: d[k] for k in ("tracks", "meters", "keys", "tempos")}}
                    notes += sum(len(t.notes) for t in s.tracks)
                out.append(row)
                if notes >= NOTES_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out, notes = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _ARROW)

    return rows.mapInArrow(run, PARSED)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of parsed files; ``score_id`` is a hash of the path."""
    rows = parsed.where("error is null").withColumn("score_id", F.xxhash64("path"))
    tracks = rows.select("score_id", F.posexplode("tracks").alias("track_ord", "t"))
    notes = tracks.select("score_id", "track_ord", F.posexplode("t.notes").alias("note_ord", "n"))
    points = lambda c: rows.select("score_id", F.posexplode(c).alias("ord", "x")).select("score_id", "ord", "x.*")
    return {
        "scores": rows.select("score_id", "ppq", "title", "composer", "source", "warnings", "meta_json"),
        "tracks": tracks.select("score_id", "track_ord", F.col("t.id").alias("track_id"), "t.name", "t.program", F.col("t.target").alias("is_guitar_target")),
        "notes": notes.select("score_id", "track_ord", "note_ord", "n.pitch", F.col("n.start").alias("start_tick"), "n.duration", "n.velocity", "n.voice", "n.spelling", "n.tab", F.col("n.locked").alias("tab_locked"), F.col("n.tied").alias("tied_from_previous"), "n.articulations", "n.confidence"),
        "time_signatures": points("meters"), "key_signatures": points("keys"), "tempos": points("tempos"),
    }


__all__ = ["KINDS", "detect_kind", "extension", "parse", "parsed", "read_files", "tables", "zip_kind"]
