"""Format queries: kinds, round trips through the writers and readers, exports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..batches import records, table
from ..sinks import files as sk
from ..sources import abc, files, midi, musicxml, progress, project
from . import derived as d
from .registry import query

_NAMES = "VALUES ('a.MID', ''), ('b.kar', ''), ('c.mxl', ''), ('d.gp5', ''), ('e.json', ''), ('f', 'MThd....'), ('g', '%PDF-1.7'), ('h', 'BCFZxxxx'), ('i', 'X:1'), ('j.webp', ''), ('k', '<?xml version=\"1.0\"?>'), ('l', 'OggS'), ('m', 'plain'), ('n.tar.ABC', ''), ('dir.mid/o', 'ID3')"


@query("s02_detect_kind", f"""SELECT name, CASE lower(regexp_extract(name, '\\.([^.\\\\/]*)$', 1)) WHEN 'mid' THEN 'midi' WHEN 'kar' THEN 'midi' WHEN 'mxl' THEN 'musicxml' WHEN 'gp5' THEN 'guitarpro' WHEN 'json' THEN 'project' WHEN 'webp' THEN 'image' WHEN 'abc' THEN 'abc'
 ELSE CASE WHEN starts_with(head, 'MThd') THEN 'midi' WHEN starts_with(head, '%PDF') THEN 'pdf' WHEN starts_with(head, 'BCFZ') THEN 'guitarpro' WHEN starts_with(head, 'OggS') OR starts_with(head, 'ID3') THEN 'audio' WHEN starts_with(head, '<?xml') THEN 'musicxml' WHEN regexp_matches(head, '^X:\\s*\\d') THEN 'abc' ELSE 'unknown' END END AS kind FROM ({_NAMES}) v(name, head)""")
def s02(spark, sf):
    rows = spark.sql(f"SELECT * FROM ({_NAMES}) v(name, head)")
    return rows.select("name", files.detect_kind(F.col("name"), F.col("head").cast("binary")).alias("kind"))


@query("s04_guitar_target", d.with_sql("SELECT score_id, track_ord FROM (SELECT score_id, track_ord, (track_ord * 7 + score_id) % 40 BETWEEN 24 AND 31 AS guitar, count(*) AS n FROM notes GROUP BY 1, 2) t QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY guitar DESC, n DESC, track_ord) = 1", "notes"))
def s04(spark, sf):
    tracks = d.notes(spark, sf).groupBy("score_id", "track_ord").agg(F.count("*").alias("n"))
    guitar = ((F.col("track_ord") * 7 + F.col("score_id")) % 40).between(24, 31)
    return tracks.groupBy("score_id").agg(F.max_by("track_ord", F.struct(guitar.alias("g"), "n", (-F.col("track_ord")).alias("o"))).alias("track_ord"))


@query("s11_gp_target", d.with_sql("SELECT score_id, track_ord FROM (SELECT score_id, track_ord, CASE WHEN (track_ord * 5 + score_id) % 40 BETWEEN 24 AND 31 AND score_id % 10 <= 8 THEN 0 WHEN score_id % 10 >= 6 THEN 1 ELSE 2 END AS r FROM notes GROUP BY 1, 2) t QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY r, track_ord) = 1", "notes"))
def s11(spark, sf):
    tracks = d.notes(spark, sf).select("score_id", "track_ord").distinct()
    strings = F.col("score_id") % 10
    rank = F.when(((F.col("track_ord") * 5 + F.col("score_id")) % 40).between(24, 31) & (strings <= 8), 0).when(strings >= 6, 1).otherwise(2)
    return tracks.groupBy("score_id").agg(F.min_by("track_ord", F.struct(rank.alias("r"), "track_ord")).alias("track_ord"))


_JSON = "'{\"format\":\"tonelake\",\"version\":' || (score_id % 3) || ',\"name\":\"n' || score_id || '\",\"score\":' || CASE WHEN score_id % 4 = 0 THEN '{}' ELSE '{\"ppq\":480,\"tracks\":[],\"meters\":[],\"keys\":[],\"tempos\":[]}' END || '}'"


@query("s12_project_envelope", d.with_sql("SELECT score_id, CASE WHEN score_id % 3 > 1 THEN 'This tab was saved by a newer version.' WHEN score_id % 4 = 0 THEN 'The tab file is missing score data.' END AS error, CASE WHEN score_id % 3 <= 1 AND score_id % 4 <> 0 THEN 'n' || score_id END AS name FROM len", "len"))
def s12(spark, sf):
    rows = d.notes(spark, sf).select("score_id").distinct().selectExpr("score_id", f"{_JSON} AS text")
    shape = "format string, version double, name string, score struct<ppq:double,tracks:array<string>,meters:array<string>,keys:array<string>,tempos:array<string>>"
    p = rows.withColumn("p", F.from_json("text", shape))
    whole = F.col("p.score.ppq").isNotNull() & F.col("p.score.tracks").isNotNull() & F.col("p.score.meters").isNotNull() & F.col("p.score.keys").isNotNull() & F.col("p.score.tempos").isNotNull()
    error = F.when(F.col("p").isNull() | F.col("p.format").isNull(), "That JSON file is not a saved tab.").when(F.col("p.version") > project.VERSION, "This tab was saved by a newer version.").when(~whole, "The tab file is missing score data.")
    return p.select("score_id", error.alias("error"), F.when(error.isNull(), F.col("p.name")).alias("name"))


def _assembled(spark, sf):
    return sk.assembled(d.notes(spark, sf), d.time_signatures(spark, sf), d.key_signatures(spark, sf), d.tempos(spark, sf))


def _back(spark, sf, write, read):
    schema = pa.schema([(c, pa.int64()) for c in ("score_id", "pitch", "start_tick", "duration", "track_ord")])

    def run(batches):
        for part in records(batches):
            yield table([(r["score_id"], n.pitch, n.start, n.duration, k) for r in part for k, t in enumerate(read(r["content"]).tracks) for n in t.notes], schema)

    return sk.export(_assembled(spark, sf), write).mapInArrow(run, "score_id long, pitch long, start_tick long, duration long, track_ord long")


_TRACKS = "SELECT score_id, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY track_ord) - 1 AS BIGINT) AS track_ord, pitch, start_tick, duration FROM notes"


@query("k04_project_round_trip", d.with_sql(_TRACKS, "notes"))
def k04(spark, sf):
    return _back(spark, sf, sk.as_project, lambda b: project.read_project(b.decode())[0])


@query("k01_midi_round_trip", d.with_sql("SELECT score_id, track_ord, start_tick, pitch, CAST(count(*) AS BIGINT) AS onsets FROM (" + _TRACKS + ") t GROUP BY 1, 2, 3, 4", "notes"))
def k01(spark, sf):
    return _back(spark, sf, sk.as_midi, midi.read_midi).groupBy("score_id", "track_ord", "start_tick", "pitch").agg(F.count("*").alias("onsets"))


@query("k02_musicxml_round_trip", d.with_sql("SELECT score_id, track_ord, pitch, CAST(sum(duration) AS BIGINT) AS ticks, min(start_tick) AS first_tick, max(start_tick + duration) AS last_tick FROM (" + _TRACKS + ") t GROUP BY 1, 2, 3", "notes"))
def k02(spark, sf):
    return _back(spark, sf, sk.as_musicxml, musicxml.read_musicxml).groupBy("score_id", "track_ord", "pitch").agg(F.sum("duration").alias("ticks"), F.min("start_tick").alias("first_tick"), F.max(F.col("start_tick") + F.col("duration")).alias("last_tick"))


@query("k03_ascii_tab")
def k03(spark, sf):
    from ..operators.tab import assign_tab

    notes = d.notes(spark, sf)
    spots = assign_tab(notes, d.bars(spark, sf)).select("score_id", "track_ord", "note_ord", F.col("pitch").alias("p"), "string", "fret")
    rows = notes.join(spots, ["score_id", "track_ord", "note_ord"]).withColumn("pitch", F.col("p"))
    made = sk.export(sk.assembled(rows, d.time_signatures(spark, sf), d.key_signatures(spark, sf), d.tempos(spark, sf)), sk.as_tab)
    return made.select("score_id", F.decode("content", "UTF-8").alias("tab"))


# Lengths add up; in D every F and C is sharp.
@query("s07_abc_tunes", d.with_sql(""", t AS (SELECT score_id, note_ord, CAST(pitch % 14 AS INTEGER) AS i, 240 * (duration // 240 + 1) AS size FROM notes)
 SELECT score_id, CAST(60 + 12 * (i // 7) + [0, 2, 4, 5, 7, 9, 11][i % 7 + 1] + CASE WHEN i % 7 IN (0, 3) THEN 1 ELSE 0 END AS BIGINT) AS pitch, CAST(sum(size) OVER (PARTITION BY score_id ORDER BY note_ord) - size AS BIGINT) AS start_tick, CAST(size AS BIGINT) AS duration FROM t""", "notes"))
def s07(spark, sf):
    schema = pa.schema([(c, pa.int64()) for c in ("score_id", "pitch", "start_tick", "duration")])

    def run(batches):
        for part in records(batches):
            yield table([(r["score_id"], n.pitch, n.start, n.duration) for r in part for n in abc.read_abc(r["abc"]).tracks[0].notes], schema)

    return _tunes(spark, sf).mapInArrow(run, "score_id long, pitch long, start_tick long, duration long")


def _tunes(spark, sf):
    """``(score_id, abc)``: every score's notes as a tune."""
    notes = d.notes(spark, sf)
    letter = F.element_at(F.array(*[F.lit(c) for c in "CDEFGABcdefgab"]), (F.col("pitch") % 14 + 1).cast("int"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("note_ord", letter.alias("l"), F.expr("duration div 240 + 1").alias("n")))), lambda x: F.concat(x["l"], x["n"].cast("string"))), " ")
    return notes.groupBy("score_id").agg(F.concat(F.lit("X:1\nM:4/4\nL:1/8\nK:D\n"), body).alias("abc"))


@query("st06_import_progress", d.with_sql("SELECT count(DISTINCT score_id) AS files, count(DISTINCT score_id) FILTER (WHERE score_id % 7 = 0) AS failures, count(DISTINCT score_id) FILTER (WHERE score_id % 7 > 0) AS scores, count(DISTINCT score_id) FILTER (WHERE score_id % 7 > 0) AS tracks, count(*) FILTER (WHERE score_id % 7 > 0) AS notes FROM notes", "notes"))
def st06(spark, sf):
    """Counts of one import of tunes, some of them broken, as Spark observes them while it writes the table."""
    broken = F.col("score_id") % 7 == 0
    named = F.concat(F.lit("tune-"), F.col("score_id").cast("string"), F.when(broken, ".mid").otherwise(".abc"))
    found = files.parsed(_tunes(spark, sf).select(named.alias("path"), F.encode(F.when(broken, "no tune").otherwise(F.col("abc")), "UTF-8").alias("content")))
    _, seen = progress.imported(found)
    return spark.range(1).select(*[F.lit(seen[m]).cast("long").alias(m) for m in ("files", "failures", "scores", "tracks", "notes")])


#: A GPIF document's lists, one row per id: bars of scores, two voices, four beats each.
@query("j06_gpif_chained_ids", d.with_sql(""" , bt AS (SELECT score_id, note_ord // 8 AS bar, note_ord // 4 % 2 AS voice, note_ord % 4 AS beat, duration FROM notes)
 SELECT score_id, bar, voice, beat, CAST(bar * 1920 + coalesce(sum(duration) OVER (PARTITION BY score_id, bar, voice ORDER BY beat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_tick FROM bt""", "notes"))
def j06(spark, sf):
    from pyspark.sql import Window

    n = d.notes(spark, sf)
    beats = n.select("score_id", F.col("note_ord").alias("beat_id"), "duration")
    voices = n.groupBy("score_id", F.expr("note_ord div 4").alias("voice_id")).agg(F.sort_array(F.collect_list("note_ord")).alias("beat_ids"))
    bars = voices.groupBy("score_id", F.expr("voice_id div 2").alias("bar")).agg(F.sort_array(F.collect_list("voice_id")).alias("voice_ids"))
    # Each list of ids is exploded with its places and joined to what the ids name.
    rows = bars.select("score_id", "bar", F.posexplode("voice_ids").alias("voice", "voice_id")).join(voices, ["score_id", "voice_id"])
    rows = rows.select("score_id", "bar", "voice", F.posexplode("beat_ids").alias("beat", "beat_id")).join(beats, ["score_id", "beat_id"])
    before = Window.partitionBy("score_id", "bar", "voice").orderBy("beat").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("score_id", "bar", F.col("voice").cast("long").alias("voice"), F.col("beat").cast("long").alias("beat"), (F.col("bar") * 1920 + F.coalesce(F.sum("duration").over(before), F.lit(0))).cast("long").alias("start_tick"))


@query("s21_push_unique", d.with_sql("SELECT score_id, tick, fifths FROM (SELECT *, lag(fifths) OVER (PARTITION BY score_id ORDER BY tick) AS was FROM (SELECT score_id, tick, arg_max(fifths, ord) AS fifths FROM ks GROUP BY 1, 2) a) b WHERE was IS DISTINCT FROM fifths", "ks"))
def s21(spark, sf):
    from pyspark.sql import Window

    last = d.key_signatures(spark, sf).groupBy("score_id", "tick").agg(F.max_by("fifths", "ord").alias("fifths"))
    was = F.lag("fifths").over(Window.partitionBy("score_id").orderBy("tick"))
    return last.withColumn("was", was).where(~F.col("was").eqNullSafe(F.col("fifths"))).select("score_id", "tick", "fifths")




_GPIF = """<GPIF><Tracks><Track id="0"><Name>Lead</Name><Properties><Property name="Tuning"><Pitches>40 45 50 55 59 64</Pitches></Property></Properties></Track></Tracks>
<MasterBars><MasterBar><Time>4/4</Time><Bars>0</Bars></MasterBar></MasterBars><Bars><Bar id="0"><Voices>0</Voices></Bar></Bars><Voices><Voice id="0"><Beats>0 0</Beats></Voice></Voices>
<Beats><Beat id="0"><Rhythm ref="0"/><Notes>0 1</Notes></Beat></Beats><Notes><Note id="0"><Properties><Property name="String"><String>5</String></Property><Property name="Fret"><Fret>3</Fret></Property></Properties></Note>
<Note id="1"><Properties><Property name="String"><String>0</String></Property><Property name="Fret"><Fret>0</Fret></Property></Properties></Note></Notes><Rhythms><Rhythm id="0"><NoteValue>Half</NoteValue></Rhythm></Rhythms></GPIF>"""


def _files(spark):
    """One small file of each kind that holds a score, and some that do not."""
    import io
    import zipfile

    from ..sinks.musicxml import write_musicxml
    from ..sources.score import Note, Score, Track

    s = Score(tracks=[Track("t", "T", 25, [Note(60, 0, 480), Note(64, 480, 960)])]).settle()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("Content/score.gpif", _GPIF)
    rows = [
        ("/a/one.mid", midi.write_midi(s)), ("/a/two", midi.write_midi(s)), ("/a/three.xml", write_musicxml(s).encode()), ("/a/four", write_musicxml(s).encode()),
        ("/a/five.json", project.write_project(s).encode()), ("/a/six.abc", b"X:1\nL:1/4\nK:C\nC E2|\n"), ("/a/seven.gp", packed.getvalue()), ("/a/eight", packed.getvalue()), ("/a/nine.pdf", b"%PDF-1.4"), ("/a/ten.mid", b"broken"),
    ]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


@query("s01_import_files", "SELECT * FROM (VALUES ('/a/one.mid', 'midi', 2::BIGINT, true), ('/a/two', 'midi', 2, true), ('/a/three.xml', 'musicxml', 2, true), ('/a/four', 'musicxml', 2, true), ('/a/five.json', 'project', 2, true), ('/a/six.abc', 'abc', 2, true), ('/a/seven.gp', 'guitarpro', 4, true), ('/a/eight', 'guitarpro', 4, true), ('/a/nine.pdf', 'pdf', 0, false), ('/a/ten.mid', 'midi', 0, false)) v(path, kind, notes, ok)")
def s01(spark, sf):
    rows = files.parsed(_files(spark))
    n = F.aggregate(F.coalesce(F.transform("tracks", lambda t: F.size(t["notes"])), F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)
    return rows.select("path", "kind", n.cast("long").alias("notes"), F.col("error").isNull().alias("ok"))


@query("s10_gpif_notes", "SELECT * FROM (VALUES (67, 0::BIGINT, 960::BIGINT, 0, 3), (40, 0, 960, 5, 0), (67, 960, 960, 0, 3), (40, 960, 960, 5, 0)) v(pitch, start_tick, duration, string, fret)")
def s10(spark, sf):
    t = files.tables(files.parsed(_files(spark).where("path = '/a/seven.gp'")))
    return t["notes"].select("pitch", "start_tick", "duration", "tab.string", "tab.fret")
