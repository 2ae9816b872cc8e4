"""Edit, library and fingering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import theory as th
from ..model import STANDARD
from ..operators import edits as ed
from ..operators import tab as tb
from . import derived as d
from .registry import query

_OPEN = "[64, 59, 55, 50, 45, 40]"
#: Notes with a fingering that follows from their number, locked for every third.
_FINGERED = f""", fg AS (SELECT *, CAST(note_ord % 6 AS INTEGER) AS string, pitch - {_OPEN}[CAST(note_ord % 6 AS INTEGER) + 1] AS raw FROM notes),
 fn AS (SELECT score_id, note_ord, pitch, start_tick, duration, CASE WHEN raw BETWEEN 0 AND 22 THEN string END AS string, CASE WHEN raw BETWEEN 0 AND 22 THEN raw END AS fret, raw BETWEEN 0 AND 22 AND note_ord % 3 = 0 AS tab_locked FROM fg)"""


def _fingered(spark, sf):
    rows = d.notes(spark, sf).withColumn("s", (F.col("note_ord") % 6).cast("int"))
    fret = F.col("pitch") - F.get(F.array(*[F.lit(p) for p in STANDARD]), F.col("s"))
    ok = (fret >= 0) & (fret <= 22)
    return rows.select("score_id", "note_ord", "pitch", "start_tick", "duration", F.when(ok, F.col("s")).alias("string"), F.when(ok, fret).alias("fret"), (ok & (F.col("note_ord") % 3 == 0)).alias("tab_locked"))


def _fsql(body: str) -> str:
    return d.with_sql("", "notes").rstrip() + _FINGERED + body


@query("p13_apply_patch", _fsql(f""", pt AS (SELECT score_id, note_ord, CASE WHEN note_ord % 2 = 0 THEN pitch + 3 END AS np, CASE WHEN note_ord % 4 = 1 THEN 2 END AS ns, CASE WHEN note_ord % 4 = 1 THEN 5 END AS nf FROM notes WHERE note_ord % 5 < 2),
 jn AS (SELECT f.*, p.np, p.ns, p.nf, coalesce(p.np, CASE WHEN p.ns IS NOT NULL THEN {_OPEN}[p.ns + 1] + p.nf END, f.pitch) AS q FROM fn f LEFT JOIN pt p USING (score_id, note_ord)),
 kp AS (SELECT *, tab_locked AND string IS NOT NULL AND q - {_OPEN}[string + 1] BETWEEN 0 AND 22 AS kept FROM jn)
 SELECT score_id, note_ord, q AS pitch, CASE WHEN ns IS NOT NULL THEN ns WHEN q <> pitch THEN CASE WHEN kept THEN string END ELSE string END AS string, CASE WHEN ns IS NOT NULL THEN nf WHEN q <> pitch THEN CASE WHEN kept THEN q - {_OPEN}[string + 1] END ELSE fret END AS fret, CASE WHEN ns IS NOT NULL THEN true WHEN q <> pitch THEN coalesce(kept, false) ELSE tab_locked END AS tab_locked FROM kp"""))
def p13(spark, sf):
    i = F.col("note_ord")
    patches = d.notes(spark, sf).where(i % 5 < 2).select("score_id", "note_ord", F.when(i % 2 == 0, F.col("pitch") + 3).alias("new_pitch"), F.when(i % 4 == 1, 2).alias("new_string"), F.when(i % 4 == 1, F.lit(5).cast("long")).alias("new_fret"), F.lit(None).cast("long").alias("new_start"), F.lit(None).cast("long").alias("new_duration"))
    return ed.apply_patch(_fingered(spark, sf), patches).select("score_id", "note_ord", "pitch", "string", "fret", "tab_locked")


@query("p14_set_guitar_unlocks", _fsql(" SELECT score_id, note_ord, CASE WHEN tab_locked AND [64, 59, 55, 50, 45, 38][string + 1] + fret <> pitch THEN NULL ELSE string END AS string, tab_locked AND NOT coalesce([64, 59, 55, 50, 45, 38][string + 1] + fret <> pitch, false) AS tab_locked FROM fn"))
def p14(spark, sf):
    return ed.set_guitar(_fingered(spark, sf), (64, 59, 55, 50, 45, 38)).select("score_id", "note_ord", "string", "tab_locked")


@query("p15_transpose_clamped", d.with_sql("SELECT score_id, note_ord, greatest(0, least(127, pitch + 50)) AS pitch, CAST(duration * 3 // 2 AS BIGINT) AS dotted, CAST(duration // 2 AS BIGINT) AS halved FROM notes", "notes"))
def p15(spark, sf):
    return ed.transpose(d.notes(spark, sf), 50).select("score_id", "note_ord", "pitch", F.expr("duration * 3 div 2").alias("dotted"), F.expr("duration div 2").alias("halved"))


@query("p16_add_and_delete_notes", d.with_sql("SELECT score_id, note_ord, pitch FROM notes WHERE note_ord % 4 <> 1 UNION ALL SELECT score_id, max(note_ord) + 1, 60 FROM notes GROUP BY 1", "notes"))
def p16(spark, sf):
    notes = d.notes(spark, sf)
    left = ed.delete(notes, notes.where("note_ord % 4 = 1").select("score_id", "note_ord"), ["score_id", "note_ord"])
    added = notes.groupBy("score_id").agg((F.max("note_ord") + 1).alias("note_ord")).withColumn("pitch", F.lit(60).cast("long"))
    return left.select("score_id", "note_ord", "pitch").unionByName(added)


@query("p17_name_known_tuning", "SELECT * FROM (VALUES ('a', 'Drop D'), ('b', 'From file')) v(file, name)")
def p17(spark, sf):
    from ..model import TUNINGS

    known = spark.createDataFrame([(k, list(v)) for k, v in TUNINGS.items()], "known string, pitches array<int>")
    files = spark.createDataFrame([("a", [64, 59, 55, 50, 45, 38]), ("b", [60, 55, 50, 45])], "file string, pitches array<int>")
    return files.join(known, "pitches", "left").select("file", F.coalesce("known", F.lit("From file")).alias("name"))


@query("f08_playable_positions", d.with_sql(f"SELECT score_id, note_ord, CAST(s AS INTEGER) AS string, pitch - {_OPEN}[s + 1] AS fret FROM notes, (SELECT unnest(range(0, 6)) s) r WHERE pitch - {_OPEN}[s + 1] BETWEEN 2 AND 22", "notes"))
def f08(spark, sf):
    return d.notes(spark, sf).select("score_id", "note_ord", F.explode(th.playable(F.col("pitch"), capo=2)).alias("p")).select("score_id", "note_ord", "p.string", F.col("p.fret").cast("long").alias("fret"))


@query("p23_fret_entry_digits", "SELECT user_id, event_id, CAST(CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 600000 THEN (lag(event_id) OVER w % 10) * 10 + event_id % 10 ELSE event_id % 10 END AS BIGINT) AS fret FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def p23(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    soon = F.unix_micros(F.col("t")) - F.unix_micros(F.lag("t").over(w)) <= 600000
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    digit = F.col("event_id") % 10
    return e.select("user_id", "event_id", F.when(soon, F.lag(digit).over(w) * 10 + digit).otherwise(digit).cast("long").alias("fret"))


_LIB = """, en AS (SELECT 'e' || score_id AS id, 'Song ' || score_id AS name, score_id * 10 AS created_at, score_id * 10 AS updated_at, CASE WHEN score_id % 2 = 0 THEN 't' || score_id END AS thumbnail, 'p' || score_id AS preview FROM len),
 sv AS (SELECT 'e' || (score_id + 20) AS id, 'New ' || score_id AS name, score_id * 10 + 5 AS saved_at, CAST(NULL AS VARCHAR) AS thumbnail, CASE WHEN score_id % 3 = 0 THEN 'q' || score_id END AS preview FROM len WHERE score_id % 2 = 0)"""


def _library(spark, sf):
    s = d.notes(spark, sf).select("score_id").distinct()
    i = F.col("score_id")
    text = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    entries = s.select(text("e", i).alias("id"), text("Song ", i).alias("name"), (i * 10).alias("created_at"), (i * 10).alias("updated_at"), F.when(i % 2 == 0, text("t", i)).alias("thumbnail"), text("p", i).alias("preview"))
    saved = s.where(i % 2 == 0).select(text("e", i + 20).alias("id"), text("New ", i).alias("name"), (i * 10 + 5).alias("saved_at"), F.lit(None).cast("string").alias("thumbnail"), F.when(i % 3 == 0, text("q", i)).alias("preview"))
    return entries, saved


@query("k06_library_upsert", d.with_sql("", "len").rstrip() + _LIB + " SELECT coalesce(s.id, e.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.name ELSE e.name END AS name, coalesce(e.created_at, s.saved_at) AS created_at, coalesce(s.saved_at, e.updated_at) AS updated_at, coalesce(s.thumbnail, e.thumbnail) AS thumbnail, coalesce(s.preview, e.preview) AS preview FROM en e FULL JOIN sv s ON e.id = s.id")
def k06(spark, sf):
    return ed.upsert(*_library(spark, sf))


@query("k07_library_listing", d.with_sql("", "len").rstrip() + _LIB + " SELECT id, name, CAST(row_number() OVER (ORDER BY updated_at DESC, id) AS BIGINT) AS place FROM en WHERE created_at % 30 <> 0")
def k07(spark, sf):
    rows = _library(spark, sf)[0].where("created_at % 30 <> 0")
    return rows.select("id", "name", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("long").alias("place"))


@query("j07_selection_after_undo", d.with_sql("SELECT score_id, note_ord FROM notes n WHERE note_ord % 3 = 0 AND EXISTS (SELECT 1 FROM notes m WHERE m.score_id = n.score_id AND m.note_ord = n.note_ord AND m.pitch > 50)", "notes"))
def j07(spark, sf):
    notes = d.notes(spark, sf)
    return notes.where("note_ord % 3 = 0").select("score_id", "note_ord").join(notes.where("pitch > 50"), ["score_id", "note_ord"], "left_semi")


@query("j08_delete_by_id", d.with_sql("SELECT score_id, note_ord FROM notes WHERE note_ord % 7 <> 3", "notes"))
def j08(spark, sf):
    notes = d.notes(spark, sf).select("score_id", "note_ord")
    return ed.delete(notes, notes.where("note_ord % 7 = 3"), ["score_id", "note_ord"])


@query("j14_library_entry_with_score", d.with_sql("", "len").rstrip() + _LIB + " SELECT e.id, e.name, l.length FROM en e JOIN len l ON e.id = 'e' || l.score_id")
def j14(spark, sf):
    from ..operators.timeline import score_lengths

    scores = score_lengths(d.notes(spark, sf)).select(F.concat(F.lit("e"), F.col("score_id").cast("string")).alias("id"), "length")
    return _library(spark, sf)[0].join(scores, "id").select("id", "name", "length")


@query("o03_capped_history", d.with_sql("SELECT score_id, note_ord AS version FROM notes QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY note_ord DESC) <= 50", "notes"))
def o03(spark, sf):
    return ed.capped_history(d.notes(spark, sf).select("score_id", F.col("note_ord").alias("version")), 50)


@query("o05_polyphony_trim", d.with_sql("SELECT score_id, measure, pitch FROM (SELECT score_id, start_tick // 1920 AS measure, pitch, note_ord, row_number() OVER (PARTITION BY score_id, start_tick // 1920 ORDER BY pitch DESC, note_ord DESC) AS hi, row_number() OVER (PARTITION BY score_id, start_tick // 1920 ORDER BY pitch, note_ord) AS lo FROM notes) t WHERE hi <= 3 OR lo <= 2", "notes"))
def o05(spark, sf):
    key = ["score_id", F.expr("start_tick div 1920")]
    hi = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("pitch"), F.desc("note_ord")))
    lo = F.row_number().over(Window.partitionBy(*key).orderBy("pitch", "note_ord"))
    return d.notes(spark, sf).select("score_id", key[1].alias("measure"), "pitch", hi.alias("hi"), lo.alias("lo")).where("hi <= 3 or lo <= 2").select("score_id", "measure", "pitch")


@query("u02_union_of_pitches", d.with_sql("SELECT score_id, list_aggregate(list_sort(list_distinct(list_concat(list(pitch) FILTER (WHERE note_ord % 2 = 0), list(pitch) FILTER (WHERE note_ord % 3 = 0)))), 'string_agg', ',') AS pitches FROM notes GROUP BY 1", "notes"))
def u02(spark, sf):
    part = lambda k: F.collect_set(F.when(F.col("note_ord") % k == 0, F.col("pitch")))
    return d.notes(spark, sf).groupBy("score_id").agg(F.array_join(F.array_sort(F.array_union(part(2), part(3))), ",").alias("pitches"))


@query("u03_intersect_pitches", d.with_sql("SELECT score_id, pitch FROM notes WHERE note_ord % 2 = 0 INTERSECT SELECT score_id, pitch FROM notes WHERE note_ord % 3 = 0", "notes"))
def u03(spark, sf):
    n = d.notes(spark, sf)
    return n.where("note_ord % 2 = 0").select("score_id", "pitch").intersect(n.where("note_ord % 3 = 0").select("score_id", "pitch"))


@query("u04_except_pitches", d.with_sql("SELECT score_id, pitch FROM notes WHERE note_ord % 2 = 0 EXCEPT SELECT score_id, pitch FROM notes WHERE note_ord % 3 = 0", "notes"))
def u04(spark, sf):
    n = d.notes(spark, sf)
    return n.where("note_ord % 2 = 0").select("score_id", "pitch").subtract(n.where("note_ord % 3 = 0").select("score_id", "pitch"))


@query("u05_dedupe_first_wins", d.with_sql("SELECT score_id, pitch, min(note_ord) AS note_ord FROM notes GROUP BY 1, 2", "notes"))
def u05(spark, sf):
    w = Window.partitionBy("score_id", "pitch").orderBy("note_ord")
    return d.notes(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select("score_id", "pitch", "note_ord")


@query("c22_version_table", d.with_sql("SELECT score_id, note_ord AS version, pitch FROM notes QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY note_ord DESC) = 2", "notes"))
def c22(spark, sf):
    latest = Window.partitionBy("score_id").orderBy(F.desc("note_ord"))
    return d.notes(spark, sf).withColumn("r", F.row_number().over(latest)).where("r = 2").select("score_id", F.col("note_ord").alias("version"), "pitch")


@query("st04_debounced_saves", "SELECT user_id, event_id FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) t WHERE gap IS NULL OR gap > 3600000000")
def st04(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("score_id"), F.col("event_id").alias("edit"), F.col("ts").cast("timestamp").alias("at"))
    return ed.debounced(e, 3600.0).select(F.col("score_id").alias("user_id"), F.col("edit").alias("event_id"))


@query("c01_assign_tab")
def c01(spark, sf):
    return tb.assign_tab(d.notes(spark, sf), d.bars(spark, sf)).select("score_id", "track_ord", "note_ord", "pitch", "string", "fret", "transposed", F.concat_ws("; ", "warnings").alias("warnings"))


@query("w08_eight_best_fingerings", d.with_sql(f"SELECT score_id, note_ord, string, fret FROM (SELECT score_id, note_ord, CAST(s AS INTEGER) AS string, pitch - {_OPEN}[s + 1] AS fret, row_number() OVER (PARTITION BY score_id, note_ord ORDER BY pitch - {_OPEN}[s + 1], s) AS r FROM notes, (SELECT unnest(range(0, 6)) s) q WHERE pitch - {_OPEN}[s + 1] BETWEEN 0 AND 22) t WHERE r <= 8", "notes"))
def w08(spark, sf):
    rows = d.notes(spark, sf).select("score_id", "note_ord", F.explode(F.slice(F.array_sort(F.transform(th.playable(F.col("pitch")), lambda x: F.struct(x["fret"].alias("fret"), x["string"].alias("string")))), 1, 8)).alias("p"))
    return rows.select("score_id", "note_ord", "p.string", F.col("p.fret").cast("long").alias("fret"))
