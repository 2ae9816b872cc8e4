"""Queries on printed text: the text layer, symbols, tempo marks, times, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import marks as mk
from ..functions.chord_names import over_distinct
from ..operators import textlayer as tx
from . import derived as d
from .registry import query

# A page per score: two systems, the printed chords over them, numbers, tempos and key signatures.


def _systems(spark, sf):
    s = d.notes(spark, sf).select("score_id").distinct()
    rows = s.select("score_id", F.lit(1).alias("page"), F.explode(F.array(F.lit(0), F.lit(1))).alias("system"))
    top = F.lit(200.0) + F.col("system") * 300
    return rows.select("score_id", "page", "system", F.lit(50.0).alias("left"), F.lit(1050.0).alias("right"), top.alias("top"), (top + 40.0).alias("bottom"), F.lit(10.0).alias("staff_space"), F.lit(None).cast("double").alias("free_top"))


def _items(spark, sf):
    item = lambda o, s, x, y: F.struct(o.cast("int").alias("ord"), s.alias("str"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = d.printed(spark, sf)
    k = F.col("ord")
    y = F.lit(170.0) + (k % 2) * 300
    root, rest = F.col("root"), F.substring(F.col("text"), F.length("root") + 1, F.lit(9))
    x = 100.0 + k * 150
    chord = p.select("score_id", F.explode(F.array(item(k * 2, root, x, y), item(k * 2 + 1, rest, x + 10.0 * F.length("root"), y))).alias("i")).where("i.str <> ''")
    s = d.notes(spark, sf).select("score_id").distinct()
    i = F.col("score_id")
    more = s.select("score_id", F.explode(F.array(
        item(F.lit(100), (i % 200 + 1).cast("string"), F.lit(60.0), F.lit(260.0)), item(F.lit(101), F.concat(F.lit("♩ = "), (i % 100 + 60).cast("string")), F.lit(70.0), F.lit(90.0)),
        item(F.lit(102), F.lit("♭"), F.lit(80.0), F.lit(215.0)), item(F.lit(103), F.when(i % 2 == 0, "♭").otherwise("♯"), F.lit(90.0), F.lit(210.0)), item(F.lit(104), F.lit("Coda"), F.lit(700.0), F.lit(170.0)),
    )).alias("i"))
    return chord.unionByName(more).select("score_id", F.lit(1).alias("page"), "i.ord", "i.str", "i.x", "i.y", (F.length("i.str") * 10.0).alias("w"), F.lit(12.0).alias("h"), F.lit("f").alias("font"))


@query("c15_text_layer_chords", d.with_sql("SELECT score_id, CAST(ord % 2 AS INTEGER) AS system, text, CAST(100.0 + ord * 150 + 5.0 * length(text) AS DOUBLE) AS x FROM printed", "printed"))
def c15_chords(spark, sf):
    return tx.chords(_items(spark, sf), _systems(spark, sf)).select("score_id", "system", "text", "x")


@query("c15_text_layer_numbers", d.with_sql("SELECT score_id, CAST(0 AS INTEGER) AS system, CAST(score_id % 200 + 1 AS INTEGER) AS n, 'below' AS zone FROM len UNION ALL SELECT score_id, CAST(ord % 2 AS INTEGER), 7, 'above' FROM printed WHERE text = 'G7'", "printed"))
def c15_numbers(spark, sf):
    return tx.numbers(_items(spark, sf), _systems(spark, sf)).select("score_id", "system", "n", "zone")


@query("c15_text_layer_keys", d.with_sql("SELECT score_id, CAST(0 AS INTEGER) AS system, CAST(CASE WHEN score_id % 2 = 0 THEN -2 ELSE -1 END AS INTEGER) AS fifths FROM len", "len"))
def c15_keys(spark, sf):
    return tx.keys(_items(spark, sf), _systems(spark, sf)).select("score_id", "system", "fifths")


@query("c15_text_layer_tempos", d.with_sql("SELECT score_id, CAST(0 AS INTEGER) AS system, CAST(score_id % 100 + 60 AS DOUBLE) AS bpm, 'quarter' AS unit FROM len", "len"))
def c15_tempos(spark, sf):
    return tx.tempos(_items(spark, sf), _systems(spark, sf)).select("score_id", "system", "bpm", "unit")


@query("m04_marks_to_cells", d.with_sql("SELECT score_id, ord, CAST(floor((100.0 + ord * 150) / 250) AS BIGINT) AS measure, CAST(floor((100.0 + ord * 150) / 250) * 1920 + least(3, floor(((100.0 + ord * 150) - floor((100.0 + ord * 150) / 250) * 250) / 250 * 4 + 0.5)) * 480 AS BIGINT) AS at FROM printed", "printed"))
def m04(spark, sf):
    p = d.printed(spark, sf)
    marks = p.select("score_id", F.lit(1).alias("page"), F.lit(0).alias("system"), "ord", (100.0 + F.col("ord") * 150).alias("x"))
    cells = p.select("score_id").distinct().select("score_id", F.lit(1).alias("page"), F.lit(0).alias("system"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("measure"))
    m = F.col("measure")
    cells = cells.select("score_id", "page", "system", (m * 250.0).alias("x0"), ((m + 1) * 250.0).alias("x1"), m.cast("long").alias("measure"), (m * 1920).cast("long").alias("tick"), F.lit(1920).alias("length"), F.lit(480).alias("beat_ticks"))
    return tx.cell_ticks(marks, cells).select("score_id", "ord", "measure", F.col("at").cast("long").alias("at"))


@query("f17_chord_symbols", d.with_sql("SELECT DISTINCT text, root, quality FROM printed", "printed"))
def f17(spark, sf):
    rows = over_distinct(d.printed(spark, sf).select("text").distinct(), "text", mk.read_symbol, mk.SYMBOL.replace("text string", "shown string"))
    return rows.select("text", "text_x.root", "text_x.quality")


@query("f18_tempo_words", "SELECT * FROM (VALUES ('Allegro ma non troppo', 130.0::DOUBLE, 'Allegro'), ('Andante, then presto', 90.0::DOUBLE, 'Andante'), ('Moderately slow', 110.0::DOUBLE, 'Moderate'), ('Rubato', NULL, NULL)) v(text, bpm, name)")
def f18(spark, sf):
    rows = spark.createDataFrame([("Allegro ma non troppo",), ("Andante, then presto",), ("Moderately slow",), ("Rubato",)], "text string")
    return rows.withColumn("w", mk.word_tempo(F.col("text"))).select("text", "w.bpm", "w.name")


@query("f21_format_time", "SELECT CAST(s AS BIGINT) AS s, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown, CAST(s AS DOUBLE) AS parsed FROM (SELECT unnest(range(0, 9000, 61)) s) t")
def f21(spark, sf):
    rows = spark.range(0, 9000, 61).select(F.col("id").alias("s"), mk.clock(F.col("id")).alias("shown"))
    return rows.withColumn("parsed", mk.seconds(F.col("shown")))


@query("f22_video_links", "SELECT * FROM (VALUES ('dQw4w9WgXcQ', 'dQw4w9WgXcQ', NULL::DOUBLE), ('https://youtu.be/dQw4w9WgXcQ?t=1m30s', 'dQw4w9WgXcQ', 90.0), ('www.youtube.com/watch?x=1&v=dQw4w9WgXcQ#t=75', 'dQw4w9WgXcQ', 75.0), ('https://music.youtube.com/shorts/dQw4w9WgXcQ', 'dQw4w9WgXcQ', NULL), ('https://example.com/watch?v=dQw4w9WgXcQ', NULL, NULL), ('', NULL, NULL)) v(link, id, t)")
def f22(spark, sf):
    links = ["dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?t=1m30s", "www.youtube.com/watch?x=1&v=dQw4w9WgXcQ#t=75", "https://music.youtube.com/shorts/dQw4w9WgXcQ", "https://example.com/watch?v=dQw4w9WgXcQ", ""]
    return spark.createDataFrame([(x,) for x in links], "link string").withColumn("v", mk.video_link(F.col("link"))).select("link", "v.id", "v.t")


@query("f18_tempo_marks", "SELECT * FROM (VALUES ('half note = 100-120', 220.0::DOUBLE, 'half', false), ('♩ = 96', 96.0, 'quarter', false), ('q. = 60', 90.0, 'quarter', true), ('dotted eighth = 80', 60.0, 'eighth', true), ('Swing', NULL, NULL, NULL), ('12', NULL, NULL, NULL)) v(text, bpm, unit, dotted)")
def f18_marks(spark, sf):
    rows = spark.createDataFrame([(t,) for t in ("half note = 100-120", "♩ = 96", "q. = 60", "dotted eighth = 80", "Swing", "12")], "text string")
    return over_distinct(rows, "text", mk.tempo_mark, mk.TEMPO).select("text", "text_x.bpm", "text_x.unit", "text_x.dotted")


@query("f40_other_text", "SELECT * FROM (VALUES ('12', 'rehearsal'), ('Swing', 'tempo'), ('rit.', 'tempo'), ('z', 'rehearsal'), ('Guitar', 'tempo'), ('?', 'unknown')) v(text, kind)")
def f40(spark, sf):
    rows = spark.createDataFrame([(t,) for t in ("12", "Swing", "rit.", "z", "Guitar", "?")], "text string")
    return over_distinct(rows, "text", lambda t: (mk.other_kind(t),), "kind string").select("text", "text_x.kind")


@query("f41_prose_words", "SELECT * FROM (VALUES ('Dal', false), ('Coda', true), ('Fine', true), ('Gmaj', false), ('Bass', true), ('C7', false)) v(text, prose)")
def f41(spark, sf):
    """Words that start like a chord but are prose."""
    rows = spark.createDataFrame([(t,) for t in ("Dal", "Coda", "Fine", "Gmaj", "Bass", "C7")], "text string")
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return rows.select("text", (letters.rlike("^[A-G][a-z]{3,}$") & ~F.lower("text").rlike("maj|min|dim|aug|sus|add")).alias("prose"))
