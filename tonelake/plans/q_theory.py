"""Queries on scalar functions: names, spellings, lengths, geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import notation as nt
from ..functions import theory as th
from ..functions.chord_names import TEMPLATES
from . import derived as d
from .registry import query

_SH = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
_FL = "['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B']"
_RANGE = "(SELECT unnest(range({})) p) t"


@query("f02_midi_to_name", f"SELECT p AS pitch, {_SH}[p % 12 + 1] || CAST(p // 12 - 1 AS VARCHAR) AS sharp, {_FL}[p % 12 + 1] || CAST(p // 12 - 1 AS VARCHAR) AS flat FROM {_RANGE.format('0, 128')}")
def f02(spark, sf):
    return spark.range(128).select(F.col("id").alias("pitch"), th.midi_name(F.col("id")).alias("sharp"), th.midi_name(F.col("id"), True).alias("flat"))


@query("f03_name_to_midi", "SELECT * FROM (VALUES ('C4', 60), ('Bb2', 46), ('f##', 67), ('Ex', 66), (' g-1 ', 7), ('H2', NULL), ('', NULL), ('Cbb5', 70)) v(name, midi)")
def f03(spark, sf):
    rows = spark.createDataFrame([(n,) for n in ("C4", "Bb2", "f##", "Ex", " g-1 ", "H2", "", "Cbb5")], "name string")
    return rows.withColumn("midi", th.name_midi(F.col("name")))


@query("f04_spelling", f"SELECT p AS pitch, f AS fifths, CASE WHEN f < 0 THEN {_FL}[p % 12 + 1] ELSE {_SH}[p % 12 + 1] END AS name, p AS back FROM (SELECT unnest(range(20, 100)) p) a, (SELECT unnest([-3, 0, 4]) f) b")
def f04(spark, sf):
    rows = spark.range(20, 100).select(F.col("id").alias("pitch"), F.explode(F.array(*[F.lit(x) for x in (-3, 0, 4)])).alias("fifths")).withColumn("s", th.spell(F.col("pitch"), F.col("fifths")))
    name = F.concat("s.step", F.when(F.col("s.alter") > 0, "#").when(F.col("s.alter") < 0, "b").otherwise(""))
    return rows.select("pitch", "fifths", name.alias("name"), th.spelling_midi(F.col("s.step"), F.col("s.alter"), F.col("s.octave")).cast("long").alias("back"))


@query("f06_ticks_to_note_value", """WITH v AS (SELECT b, d, t, row_number() OVER () - 1 AS i, CASE WHEN t THEN 1920.0 / b * 2 / 3 WHEN d = 0 THEN 1920.0 / b WHEN d = 1 THEN 1920.0 / b * 1.5 ELSE 1920.0 / b * 1.75 END AS ticks FROM (VALUES (1,0,false),(1,1,false),(1,2,false),(1,0,true),(2,0,false),(2,1,false),(2,2,false),(2,0,true),(4,0,false),(4,1,false),(4,2,false),(4,0,true),(8,0,false),(8,1,false),(8,2,false),(8,0,true),(16,0,false),(16,1,false),(16,2,false),(16,0,true),(32,0,false),(32,1,false),(32,2,false),(32,0,true),(64,0,false),(64,1,false),(64,2,false),(64,0,true)) x(b, d, t))
 SELECT q.k AS ticks, v.b AS base, v.d AS dots, v.t AS triplet FROM (SELECT unnest(range(10, 2400, 30)) k) q, v QUALIFY row_number() OVER (PARTITION BY q.k ORDER BY round(abs(v.ticks - q.k), 9), v.i) = 1""")
def f06(spark, sf):
    rows = spark.range(10, 2400, 30).select(F.col("id").alias("ticks"))
    return rows.withColumn("v", th.note_value(F.col("ticks"), F.lit(480))).select("ticks", "v.base", "v.dots", "v.triplet")


@query("f07_note_value_to_ticks", "SELECT b AS base, d AS dots, t AS triplet, CAST(floor(CASE WHEN t THEN 1920.0 / b * 2 / 3 ELSE 1920.0 / b END * (2 - pow(0.5, d)) + 0.5) AS BIGINT) AS ticks FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) b) x, (SELECT unnest([0, 1, 2]) d) y, (SELECT unnest([true, false]) t) z")
def f07(spark, sf):
    rows = spark.createDataFrame([(b, k, t) for b in (1, 2, 4, 8, 16, 32, 64) for k in (0, 1, 2) for t in (True, False)], "base int, dots int, triplet boolean")
    return rows.withColumn("ticks", th.value_ticks(F.col("base"), F.col("dots"), F.col("triplet"), F.lit(480.0)))


@query("f05_key_to_fifths", "SELECT * FROM (VALUES ('G', 'major', 1), ('Bb', 'major', -2), ('A', 'minor', 0), ('F#', 'minor', 3), ('H', 'major', 0)) v(name, mode, fifths)")
def f05(spark, sf):
    rows = spark.createDataFrame([("G", "major"), ("Bb", "major"), ("A", "minor"), ("F#", "minor"), ("H", "major")], "name string, mode string")
    return rows.withColumn("fifths", th.key_fifths(F.col("name"), F.col("mode")))


@query("f19_roots_and_qualities", "SELECT * FROM (VALUES ('Bb', 'min7', 10, 'm7'), ('F♯', 'M7', 6, 'maj7'), ('C', 'Δ', 0, 'maj7'), ('E♭', 'ø7', 3, 'm7b5'), ('x', '(b9)', NULL, 'b9'), ('A', NULL, 9, '')) v(root, quality, pc, plain)")
def f19(spark, sf):
    rows = spark.createDataFrame([("Bb", "min7"), ("F♯", "M7"), ("C", "Δ"), ("E♭", "ø7"), ("x", "(b9)"), ("A", None)], "root string, quality string")
    return rows.withColumns({"pc": nt.root_pc(F.col("root")), "plain": nt.plain_quality(F.col("quality"))})


@query("f20_file_names", "SELECT * FROM (VALUES ('a/b.Mid', 'mid', 'b'), ('x.tar.gz', 'gz', 'x.tar'), ('dir.x\\name', '', 'name'), ('.abc', 'abc', '.abc'), ('plain', '', 'plain')) v(name, ext, base)")
def f20(spark, sf):
    rows = spark.createDataFrame([("a/b.Mid",), ("x.tar.gz",), ("dir.x\\name",), (".abc",), ("plain",)], "name string")
    return rows.withColumns({"ext": nt.file_extension(F.col("name")), "base": nt.file_base(F.col("name"))})


@query("f24_diatonic_pitch", "SELECT CAST(n AS BIGINT) AS dia, (n // 7 + 1) * 12 + [0, 2, 4, 5, 7, 9, 11][n % 7 + 1] AS midi FROM (SELECT unnest(range(0, 70)) n) t")
def f24(spark, sf):
    return spark.range(70).select(F.col("id").alias("dia"), th.diatonic_midi(F.col("id"), F.lit(0)).cast("long").alias("midi"))


@query("f24_key_alterations", "SELECT CAST(f AS BIGINT) AS fifths, CAST(greatest(0, least(7, f)) - greatest(0, least(7, -f)) AS INTEGER) AS total FROM (SELECT unnest(range(-7, 8)) f) t")
def f24_key(spark, sf):
    return spark.range(-7, 8).select(F.col("id").alias("fifths"), F.aggregate(th.alterations(F.col("id")), F.lit(0), lambda a, x: a + x).alias("total"))


@query("f25_head_and_rest_ticks", "SELECT CAST(i AS BIGINT) AS i, CAST(floor((CASE WHEN i % 2 = 0 THEN CASE WHEN i % 3 > 0 THEN 960.0 ELSE 1920.0 END WHEN i % 3 > 0 THEN 480 / pow(2, least(3, i % 5)) ELSE 480.0 END) * CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 1.5 ELSE 1.75 END + 0.5) AS BIGINT) AS head, CAST(CASE i % 5 WHEN 0 THEN 1440 ELSE floor(1920.0 / [2, 4, 8, 16][i % 5] * CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 1.5 ELSE 1.75 END + 0.5) END AS BIGINT) AS rest FROM (SELECT unnest(range(0, 120)) i) t")
def f25(spark, sf):
    i = F.col("id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("whole", "half", "quarter", "eighth", "sixteenth")]), (i % 5 + 1).cast("int"))
    head = nt.head_ticks(i % 2 == 0, i % 3 > 0, i % 5, i % 4, F.lit(480))
    return spark.range(120).select(i.alias("i"), head.alias("head"), nt.rest_ticks(kind, i % 4, F.lit(1440), F.lit(480)).cast("long").alias("rest"))


@query("f25_snap_and_quantize", "SELECT v AS ticks, u * 120 AS snapped, greatest(120, CAST(floor(v / 120.0 + 0.5) AS BIGINT) * 120) AS quantized FROM (SELECT unnest(range(20, 2500, 37)) v) q, (SELECT unnest([0.5, 1, 1.5, 2, 3, 4, 6, 8, 12, 16]::DOUBLE[]) u) s QUALIFY row_number() OVER (PARTITION BY v ORDER BY round(abs(ln(u * 120 / v)), 12), u) = 1")
def f25_snap(spark, sf):
    v = F.col("id")
    return spark.range(20, 2500, 37).select(v.alias("ticks"), nt.snapped(v, F.lit(480)).alias("snapped"), nt.quantized(v, F.lit(120)).cast("long").alias("quantized"))


@query("f26_page_transform", "SELECT CAST(i AS BIGINT) AS i, CAST(i * 3 AS DOUBLE) AS x, CAST(i * 2 AS DOUBLE) AS y FROM (SELECT unnest(range(0, 50)) i) t")
def f26(spark, sf):
    """A point to the deskewed page and back."""
    t = {"scale": 0.5, "angle": 0.03, "cx": 400.0, "cy": 600.0}
    rows = spark.range(50).select(F.col("id").alias("i"), nt.from_page(F.col("id") * 3.0, F.col("id") * 2.0, t).alias("p"))
    back = nt.to_page(F.col("p.x"), F.col("p.y"), t)
    return rows.select("i", F.round(back["x"], 6).alias("x"), F.round(back["y"], 6).alias("y"))


@query("f33_grid_unit", d.with_sql("SELECT score_id, CASE WHEN bool_and(duration % 120 = 0) THEN 120.0 ELSE 60.0 END::DOUBLE AS unit FROM notes GROUP BY 1", "notes"))
def f33(spark, sf):
    return d.notes(spark, sf).groupBy("score_id").agg(F.collect_set("duration").alias("t")).select("score_id", nt.grid_division(F.col("t"), 480).alias("unit"))


@query("f35_xml_escape", "SELECT * FROM (VALUES ('a&b', 'a&amp;b'), ('<\"x\">', '&lt;&quot;x&quot;&gt;'), ('', '')) v(raw, safe)")
def f35(spark, sf):
    return spark.createDataFrame([("a&b",), ('<"x">',), ("",)], "raw string").withColumn("safe", th.xml_escape(F.col("raw")))


@query("f36_written_values", "SELECT * FROM (VALUES (2400::BIGINT, 'w,q'), (1680::BIGINT, 'hd,8'), (1200::BIGINT, 'h,8'), (100::BIGINT, '32'), (20::BIGINT, '')) v(ticks, names)")
def f36(spark, sf):
    rows = spark.createDataFrame([(2400,), (1680,), (1200,), (100,), (20,)], "ticks long")
    return rows.withColumn("names", F.array_join(nt.written(F.col("ticks"), F.lit(480)), ","))


@query("f37_written_keys", f"SELECT p AS pitch, lower({_FL}[p % 12 + 1]) || '/' || CAST(p // 12 AS VARCHAR) AS key, p + 12 AS shown FROM (SELECT unnest(range(40, 90)) p) t")
def f37(spark, sf):
    rows = spark.range(40, 90).select(F.col("id").alias("pitch"), th.spell(F.col("id"), F.lit(-1)).alias("s"))
    rows = rows.select("pitch", nt.written_key(F.col("s.step"), F.col("s.alter"), F.col("s.octave")).alias("key"))
    return rows.withColumn("shown", nt.key_pitch(F.col("key")).cast("long"))


_NAMED = ", ".join(f"('{q}', {list(t)})" for q, t in TEMPLATES.items())


@query("f12_chord_names", f"""WITH t AS (SELECT * FROM (VALUES {_NAMED}) v(quality, tones)), n AS (SELECT unnest(range(0, 12)) AS root), b AS (SELECT unnest([0, 4, 7]) AS bass),
 s AS (SELECT ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'] AS sharps, ['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B'] AS flats),
 r AS (SELECT root, quality, bass, tones, CASE WHEN bass % 2 = 1 THEN flats ELSE sharps END AS names FROM t, n, b, s)
 SELECT CAST(root AS INTEGER) AS root, quality, CAST(bass AS INTEGER) AS bass, names[root + 1] || quality || CASE WHEN bass <> root AND quality <> '5' AND list_contains(tones, (bass - root + 12) % 12) THEN '/' || names[bass + 1] ELSE '' END AS name FROM r""")
def f12(spark, sf):
    from ..functions.chord_names import chord_name

    return spark.createDataFrame([(r, q, b, chord_name(r, q, b, b % 2 == 1)) for r in range(12) for q in TEMPLATES for b in (0, 4, 7)], "root int, quality string, bass int, name string")


@query("f11_simplified_names", "SELECT * FROM (VALUES ('D7b9b5', 'D7'), ('Am11', 'Am7'), ('Gmadd2', 'Gm'), ('Hm', NULL), ('Bdim7/D', 'Bdim7/D')) v(name, plain)")
def f11(spark, sf):
    from ..functions.chord_names import over_distinct, simplify

    rows = spark.createDataFrame([("D7b9b5",), ("Am11",), ("Gmadd2",), ("Hm",), ("Bdim7/D",)], "name string")
    return over_distinct(rows, "name", lambda n: None if (s := simplify(n)) is None else (s,), "plain string").select("name", "name_x.plain")


# Semitones over the root, and those a voicing cannot leave out, as written down from chord theory.
@query("f10_chord_intervals", """SELECT * FROM (VALUES ('', '0,4,7', '0,4,7'), ('m', '0,3,7', '0,3,7'), ('7', '0,4,7,10', '0,4,10'), ('maj9', '0,2,4,7,11', '0,2,4,11'), ('m7b5', '0,3,6,10', '0,3,6,10'),
 ('13', '0,2,4,7,9,10', '0,4,9,10'), ('9sus4', '0,2,5,7,10', '0,2,5,10'), ('7alt', '0,3,4,8,10', '0,3,4,8,10'), ('7#9', '0,3,4,7,10', '0,3,4,10'), ('m6', '0,3,7,9', '0,3,9'),
 ('5', '0,7', '0,7'), ('add9', '0,2,4,7', '0,2,4'), ('xyz', NULL, NULL)) v(quality, tones, required)""")
def f10(spark, sf):
    from ..functions.chord_names import Quality, over_distinct

    rows = spark.createDataFrame([(q,) for q in ("", "m", "7", "maj9", "m7b5", "13", "9sus4", "7alt", "7#9", "m6", "5", "add9", "xyz")], "quality string")
    made = over_distinct(rows, "quality", lambda q: None if (x := Quality.parse(q)) is None else (x.tones, x.required), "tones array<int>, required array<int>")
    return made.select("quality", F.array_join("quality_x.tones", ",").alias("tones"), F.array_join("quality_x.required", ",").alias("required"))


@query("f16_chord_voicings")
def f16(spark, sf):
    from ..functions.chord_names import SHAPED, over_distinct, shape
    from ..model import TUNINGS

    rows = spark.createDataFrame([(n,) for n in ("C", "D/F#", "Bm7b5", "G13", "Ab", "E5")], "name string")
    return over_distinct(rows, "name", shape(TUNINGS["Drop D"]), SHAPED).select("name", F.array_join("name_x.pitches", ",").alias("pitches"))


@query("c16_accidentals_in_a_bar", d.with_sql("""SELECT score_id, note_ord, coalesce(last_value(CASE WHEN note_ord % 5 = 0 THEN CAST(pitch % 3 - 1 AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY score_id, start_tick // 1920, pitch % 7 ORDER BY note_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS alter FROM notes""", "notes"))
def c16(spark, sf):
    """The last accidental on a line holds until the barline."""
    w = Window.partitionBy("score_id", F.expr("start_tick div 1920"), F.expr("pitch % 7")).orderBy("note_ord").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("note_ord") % 5 == 0, (F.col("pitch") % 3 - 1).cast("int"))
    return d.notes(spark, sf).select("score_id", "note_ord", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)).alias("alter"))


@query("c26_system_cells", d.with_sql("SELECT score_id, idx AS cell, start_tick AS x0, CAST(idx + coalesce(sum(CASE WHEN idx % 4 = 1 THEN 2 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS measure FROM bars", "bars"))
def c26(spark, sf):
    """A cell's measure, counting the bars that multi-measure rests before it stand for."""
    before = Window.partitionBy("score_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.coalesce(F.sum(F.when(F.col("index") % 4 == 1, 2).otherwise(0)).over(before), F.lit(0))
    return d.bars(spark, sf).select("score_id", F.col("index").alias("cell"), F.col("start_tick").alias("x0"), (F.col("index") + extra).cast("long").alias("measure"))


@query("c34_raw_bar_totals", d.with_sql("SELECT score_id, start_tick // 1920 AS bar, CAST(sum(CASE WHEN voice = 2 THEN floor(duration * 2 / 3.0 + 0.5) ELSE duration END) AS BIGINT) AS total FROM notes GROUP BY 1, 2", "notes"))
def c34(spark, sf):
    size = F.when(F.col("voice") == 2, th.half_up(F.col("duration") * 2 / F.lit(3.0))).otherwise(F.col("duration"))
    return d.notes(spark, sf).groupBy("score_id", F.expr("start_tick div 1920").alias("bar")).agg(F.sum(size).cast("long").alias("total"))


@query("u06_same_tick_labels", d.with_sql("SELECT score_id, tick, arg_max(ord, confidence * 1000 - ord) AS ord FROM (SELECT score_id, ord, tick // 1000 AS tick, confidence FROM printed) t GROUP BY 1, 2", "printed"))
def u06(spark, sf):
    """Of labels that follow each other on one tick, the most confident, the first of equals."""
    p = d.printed(spark, sf).select("score_id", "ord", F.expr("tick div 1000").alias("tick"), "confidence")
    best = F.max_by("ord", F.struct("confidence", (-F.col("ord")).alias("o")))
    return p.groupBy("score_id", "tick").agg(best.alias("ord"))


@query("m01_recognized_measures", d.with_sql("SELECT score_id, CAST(max(idx) + 1 AS BIGINT) AS measures FROM bars GROUP BY 1", "bars"))
def m01(spark, sf):
    return d.bars(spark, sf).groupBy("score_id").agg((F.max("index") + 1).alias("measures"))


@query("m02_tolerant_readers", "SELECT * FROM (VALUES (1, 3, 'C'), (2, 0, 'Bb'), (3, 7, 'D'), (4, NULL, 'E')) v(id, measure, root)")
def m02(spark, sf):
    rows = spark.createDataFrame([(1, '{"measureIndex":3,"chord":{"root":"C"}}'), (2, '{"measure":0,"root":"Bb"}'), (3, '{"index":7,"text":"Dm7"}'), (4, '{"text":"E"}')], "id int, j string")
    at = lambda p: F.get_json_object("j", f"$.{p}")
    root = F.coalesce(at("chord.root"), at("root"), F.nullif(F.regexp_extract(F.coalesce(at("text"), F.lit("")), "^([A-G][#b]?)", 1), F.lit("")))
    return rows.select("id", F.coalesce(at("measureIndex"), at("measure"), at("index")).cast("int").alias("measure"), root.alias("root"))


@query("p20_defaults", d.with_sql("SELECT score_id, note_ord, coalesce(CASE WHEN note_ord % 2 = 0 THEN velocity END, 90) AS velocity, coalesce(CASE WHEN note_ord % 3 = 0 THEN voice END, 0) AS voice FROM notes", "notes"))
def p20(spark, sf):
    i = F.col("note_ord")
    return d.notes(spark, sf).select("score_id", "note_ord", F.coalesce(F.when(i % 2 == 0, F.col("velocity")), F.lit(90)).cast("long").alias("velocity"), F.coalesce(F.when(i % 3 == 0, F.col("voice")), F.lit(0)).cast("long").alias("voice"))


@query("s16_sample_manifest", "SELECT * FROM (VALUES (40, 'e2.mp3'), (45, 'a2.mp3'), (50, 'd3.mp3')) v(midi, file)")
def s16(spark, sf):
    rows = spark.createDataFrame([('{"instrument":"guitar","click":"click.wav","notes":{"40":"e2.mp3","45":"a2.mp3","50":"d3.mp3"}}',)], "j string")
    made = rows.select(F.from_json("j", "instrument string, click string, notes map<string,string>").alias("m")).select(F.explode("m.notes").alias("midi", "file"))
    return made.select(F.col("midi").cast("int").alias("midi"), "file")


@query("k08_grey_png")
def k08(spark, sf):
    import zlib

    data = nt.grey_png(3, 2, bytes([0, 100, 200, 255, 1, 2]))
    return spark.createDataFrame([(bytearray(data), zlib.crc32(data))], "png binary, crc long")
