"""Timeline queries: lengths, measures, positions, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.theory import half_up, key_name, midi_name, pitch_class
from ..operators import timeline as tl
from . import derived as d
from .registry import query


@query("p01_score_length", d.with_sql("SELECT score_id, length FROM len", "len"))
def p01(spark, sf):
    return tl.score_lengths(d.notes(spark, sf))


@query("p02_measures", d.with_sql("SELECT score_id, idx AS \"index\", start_tick, end_tick, numerator, denominator FROM bars", "bars"))
def p02(spark, sf):
    return d.bars(spark, sf)


@query("p03_ticks_per_measure", d.with_sql("SELECT score_id, note_ord, 1920.0 * (SELECT arg_max(numerator, ord) FROM ts WHERE ts.score_id = n.score_id AND tick <= n.start_tick) / (SELECT arg_max(denominator, ord) FROM ts WHERE ts.score_id = n.score_id AND tick <= n.start_tick) AS ticks FROM notes n", "ts"))
def p03(spark, sf):
    sigs = tl.change_lists(d.time_signatures(spark, sf), ["numerator", "denominator"], "sigs")
    rows = d.notes(spark, sf).join(sigs, "score_id", "left").withColumn("sig", tl.as_of(F.col("sigs"), F.col("start_tick")))
    return rows.select("score_id", "note_ord", tl.measure_ticks(F.lit(480.0), F.col("sig.numerator"), F.col("sig.denominator")).alias("ticks"))


@query("p04_pulse_ticks", d.with_sql("SELECT score_id, ord, least(480.0, 1920.0 / denominator) AS pulse FROM ts", "ts"))
def p04(spark, sf):
    return d.time_signatures(spark, sf).select("score_id", "ord", tl.pulse(F.lit(480), F.col("denominator")).alias("pulse"))


_SECONDS = """, seg AS (SELECT score_id, tick, bpm, lead(tick) OVER (PARTITION BY score_id ORDER BY tick, ord) AS nxt FROM tp)"""


def _seconds_sql(tick: str, src: str) -> str:
    return f"(SELECT coalesce(sum((least(coalesce(g.nxt, {src}.{tick}), {src}.{tick}) - g.tick) / 480.0 * (60.0 / g.bpm)), 0) FROM seg g WHERE g.score_id = {src}.score_id AND g.tick < {src}.{tick})"


@query("p05_ticks_to_seconds", d.with_sql("", "tp").rstrip() + _SECONDS + f" SELECT score_id, note_ord, round({_seconds_sql('start_tick', 'n')}, 6) AS seconds FROM notes n")
def p05(spark, sf):
    t = tl.change_lists(d.tempos(spark, sf), ["bpm"], "tempos")
    return d.notes(spark, sf).join(t, "score_id", "left").select("score_id", "note_ord", F.round(tl.seconds_at(F.col("tempos"), F.col("start_tick").cast("double"), F.lit(480.0)), 6).alias("seconds"))


_AT = """, seg AS (SELECT score_id, tick, bpm, lead(tick) OVER w AS nxt, lag(tick) OVER w AS prv, lag(bpm) OVER w AS pbpm FROM tp WINDOW w AS (PARTITION BY score_id ORDER BY tick, ord)),
 cum AS (SELECT *, sum(coalesce((tick - prv) / 480.0 * (60.0 / pbpm), 0)) OVER (PARTITION BY score_id ORDER BY tick) AS sec FROM seg),
 q AS (SELECT score_id, note_ord, note_ord * 0.25 AS sec FROM notes),
 j AS (SELECT q.score_id, q.note_ord, c.tick + (q.sec - c.sec) * c.bpm / 60.0 * 480 AS tick FROM q JOIN cum c ON q.score_id = c.score_id AND (c.sec <= q.sec) QUALIFY row_number() OVER (PARTITION BY q.score_id, q.note_ord ORDER BY c.tick DESC) = 1)"""


@query("p06_seconds_to_ticks", d.with_sql("", "tp").rstrip() + _AT + " SELECT score_id, note_ord, round(CASE WHEN note_ord = 0 THEN 0 ELSE tick END, 4) AS tick FROM j")
def p06(spark, sf):
    t = tl.change_lists(d.tempos(spark, sf), ["bpm"], "tempos")
    return d.notes(spark, sf).join(t, "score_id", "left").select("score_id", "note_ord", F.round(tl.ticks_at(F.col("tempos"), F.col("note_ord") * 0.25, F.lit(480.0)), 4).alias("tick"))


@query("p07_seconds_to_tick_rounded", d.with_sql("", "tp").rstrip() + _AT + " SELECT score_id, note_ord, CAST(floor(round(CASE WHEN note_ord = 0 THEN 0 ELSE tick END, 6) + 0.5) AS BIGINT) AS tick FROM j")
def p07(spark, sf):
    t = tl.change_lists(d.tempos(spark, sf), ["bpm"], "tempos")
    return d.notes(spark, sf).join(t, "score_id", "left").select("score_id", "note_ord", half_up(F.round(tl.ticks_at(F.col("tempos"), F.col("note_ord") * 0.25, F.lit(480.0)), 6)).alias("tick"))


@query("p08_guitar_track", d.with_sql("SELECT score_id, arg_min(track_ord, CASE WHEN flagged THEN track_ord ELSE track_ord + 1000 END) AS track_ord FROM (SELECT score_id, track_ord, score_id % 3 = 0 AND track_ord = 1 AS flagged, count(*) AS n FROM notes GROUP BY 1, 2, 3) t GROUP BY 1", "notes"))
def p08(spark, sf):
    tracks = d.notes(spark, sf).groupBy("score_id", "track_ord").agg(F.count("*").alias("n")).withColumn("flagged", (F.col("score_id") % 3 == 0) & (F.col("track_ord") == 1))
    best = F.min(F.when(F.col("flagged") | (F.col("n") > 0), F.struct((~F.col("flagged")).alias("later"), "track_ord")))
    return tracks.groupBy("score_id").agg(best.alias("x")).select("score_id", F.col("x.track_ord").alias("track_ord"))


@query("p09_rescale_ppq", d.with_sql("SELECT score_id, note_ord, CAST(floor(start_tick * 480 / 96.0 + 0.5) AS BIGINT) AS start_tick, greatest(CAST(1 AS BIGINT), CAST(floor(duration * 480 / 96.0 + 0.5) AS BIGINT)) AS duration FROM notes", "notes"))
def p09(spark, sf):
    scale = lambda c: half_up(F.col(c) * 480 / F.lit(96.0))
    return d.notes(spark, sf).select("score_id", "note_ord", scale("start_tick").alias("start_tick"), F.greatest(F.lit(1), scale("duration")).cast("long").alias("duration"))


@query("p10_position_label", d.with_sql("SELECT n.score_id, n.note_ord, (b.idx + 1) || '.' || CAST(floor((n.start_tick - b.start_tick) / least(480.0, 1920.0 / b.denominator)) + 1 AS BIGINT) AS position FROM notes n JOIN bars b ON n.score_id = b.score_id AND n.start_tick >= b.start_tick AND n.start_tick < b.end_tick", "bars"))
def p10(spark, sf):
    bars = d.bars(spark, sf)
    rows = tl.locate(d.notes(spark, sf).withColumn("tick", F.col("start_tick").cast("double")), bars.select("score_id", "index", "start_tick", "end_tick")).where("measure is not null")
    rows = rows.join(bars.select("score_id", F.col("index").alias("measure"), "denominator"), ["score_id", "measure"])
    beat = F.floor((F.col("tick") - F.col("measure_start")) / tl.pulse(F.lit(480), F.col("denominator"))) + 1
    return rows.select("score_id", "note_ord", F.concat_ws(".", (F.col("measure") + 1).cast("string"), beat.cast("long").cast("string")).alias("position"))


@query("p11_loop_range", d.with_sql("SELECT score_id, min(start_tick) AS loop_start, max(start_tick + duration) AS loop_end FROM notes WHERE note_ord % 5 = 2 GROUP BY 1", "notes"))
def p11(spark, sf):
    notes = d.notes(spark, sf)
    chosen = notes.where("note_ord % 5 = 2").select("score_id", "note_ord")
    picked = notes.join(chosen, ["score_id", "note_ord"], "left_semi")
    return picked.groupBy("score_id").agg(F.min("start_tick").alias("loop_start"), F.max(F.col("start_tick") + F.col("duration")).alias("loop_end"))


_PIECES = "SELECT n.score_id, n.note_ord, b.idx AS measure, greatest(CAST(n.start_tick AS DOUBLE), b.start_tick) AS piece_start, least(CAST(n.start_tick + n.duration AS DOUBLE), b.end_tick) - greatest(CAST(n.start_tick AS DOUBLE), b.start_tick) AS piece_ticks, n.start_tick < b.start_tick AS tied FROM notes n JOIN bars b ON n.score_id = b.score_id AND n.start_tick < b.end_tick AND n.start_tick + n.duration > b.start_tick"


@query("p12_split_at_barlines", d.with_sql(_PIECES, "bars"))
def p12(spark, sf):
    bars = d.bars(spark, sf).select("score_id", F.col("index").alias("measure"), F.col("start_tick").alias("w_start"), F.col("end_tick").alias("w_end"))
    rows = tl.overlaps(d.notes(spark, sf), bars)
    return rows.select("score_id", "note_ord", "measure", F.greatest(F.col("start_tick").cast("double"), "w_start").alias("piece_start"), F.col("ov").alias("piece_ticks"), (F.col("start_tick") < F.col("w_start")).alias("tied"))


@query("j01_as_of_key", d.with_sql("SELECT score_id, note_ord, (SELECT arg_max(fifths, ord) FROM ks WHERE ks.score_id = n.score_id AND tick <= n.start_tick) AS fifths, (SELECT arg_max(mode, ord) FROM ks WHERE ks.score_id = n.score_id AND tick <= n.start_tick) AS mode FROM notes n", "ks"))
def j01(spark, sf):
    keys = tl.change_lists(d.key_signatures(spark, sf), ["fifths", "mode"], "keys")
    rows = d.notes(spark, sf).join(keys, "score_id", "left").withColumn("k", tl.as_of(F.col("keys"), F.col("start_tick")))
    return rows.select("score_id", "note_ord", "k.fifths", "k.mode")


@query("j02_tick_to_measure", d.with_sql("SELECT n.score_id, n.note_ord, coalesce(b.idx, -1) AS measure FROM notes n LEFT JOIN bars b ON n.score_id = b.score_id AND n.start_tick >= b.start_tick AND n.start_tick < b.end_tick", "bars"))
def j02(spark, sf):
    rows = tl.locate(d.notes(spark, sf).select("score_id", "note_ord", F.col("start_tick").cast("double").alias("tick")), d.bars(spark, sf))
    return rows.select("score_id", "note_ord", F.coalesce("measure", F.lit(-1)).cast("long").alias("measure"))


@query("j03_overlap_join", d.with_sql("SELECT n.score_id, n.note_ord, w.measure, w.w, least(CAST(n.start_tick + greatest(n.duration, 1) AS DOUBLE), w.w_end) - greatest(CAST(n.start_tick AS DOUBLE), w.w_start) AS ov FROM notes n JOIN win w ON n.score_id = w.score_id AND n.start_tick < w.w_end AND w.w_start < n.start_tick + greatest(n.duration, 1)", "win"))
def j03(spark, sf):
    return tl.overlaps(d.notes(spark, sf), d.beats(spark, sf)).select("score_id", "note_ord", "measure", "w", "ov")


@query("p24_key_and_meter_label", d.with_sql("SELECT score_id, tick, (SELECT arg_max(fifths, ord) FROM ks WHERE ks.score_id = t.score_id AND ks.tick <= t.tick) AS fifths, CAST((SELECT arg_max(numerator, ord) FROM ts WHERE ts.score_id = t.score_id AND ts.tick <= t.tick) AS VARCHAR) || '/' || CAST((SELECT arg_max(denominator, ord) FROM ts WHERE ts.score_id = t.score_id AND ts.tick <= t.tick) AS VARCHAR) AS meter, CAST(floor(coalesce((SELECT arg_max(bpm, ord) FROM tp WHERE tp.score_id = t.score_id AND tp.tick <= t.tick), (SELECT arg_min(bpm, ord) FROM tp WHERE tp.score_id = t.score_id)) + 0.5) AS BIGINT) AS bpm FROM (SELECT score_id, CAST(k * 1000 AS BIGINT) AS tick FROM len, (SELECT unnest(range(0, 6)) k) r) t", "ks", "ts", "tp"))
def p24(spark, sf):
    rows = d.notes(spark, sf).select("score_id").distinct().select("score_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5000).cast("long"), F.lit(1000).cast("long"))).alias("tick"))
    for frame, cols, name in ((d.key_signatures(spark, sf), ["fifths", "mode"], "keys"), (d.time_signatures(spark, sf), ["numerator", "denominator"], "sigs"), (d.tempos(spark, sf), ["bpm"], "tempos")):
        rows = rows.join(tl.change_lists(frame, cols, name), "score_id", "left")
    at = lambda c: tl.as_of(F.col(c), F.col("tick"))
    return rows.select("score_id", "tick", at("keys")["fifths"].alias("fifths"), F.concat_ws("/", at("sigs")["numerator"].cast("string"), at("sigs")["denominator"].cast("string")).alias("meter"), half_up(at("tempos")["bpm"]).alias("bpm"))


@query("w01_tumbling_windows", d.with_sql("SELECT score_id, measure, w, w_start, w_end FROM win", "win"))
def w01(spark, sf):
    return d.beats(spark, sf)


@query("w01_half_measure_windows", d.with_sql("SELECT score_id, idx AS measure, CAST(h AS BIGINT) AS w, start_tick + h * (end_tick - start_tick) / 2 AS w_start, least(start_tick + (h + 1) * (end_tick - start_tick) / 2, end_tick) AS w_end FROM bars, (SELECT unnest(range(0, 2)) h) r", "bars"))
def w01_half(spark, sf):
    return d.beats(spark, sf, "half")


@query("w05_inter_onset_intervals", d.with_sql("SELECT score_id, note_ord, start_tick - lag(start_tick, 1) OVER w AS ioi1, start_tick - lag(start_tick, 2) OVER w AS ioi2 FROM notes WINDOW w AS (PARTITION BY score_id ORDER BY start_tick, note_ord)", "notes"))
def w05(spark, sf):
    w = Window.partitionBy("score_id").orderBy("start_tick", "note_ord")
    gap = lambda k: F.col("start_tick") - F.lag("start_tick", k).over(w)
    return d.notes(spark, sf).select("score_id", "note_ord", gap(1).alias("ioi1"), gap(2).alias("ioi2"))


@query("w06_cumulative_durations", d.with_sql("SELECT score_id, track_ord, note_ord, CAST(sum(duration) OVER (PARTITION BY score_id, track_ord ORDER BY note_ord) AS BIGINT) AS upto FROM notes", "notes"))
def w06(spark, sf):
    w = Window.partitionBy("score_id", "track_ord").orderBy("note_ord").rowsBetween(Window.unboundedPreceding, 0)
    return d.notes(spark, sf).select("score_id", "track_ord", "note_ord", F.sum("duration").over(w).alias("upto"))


@query("w07_reading_order", d.with_sql("SELECT score_id, note_ord, CAST(row_number() OVER (PARTITION BY score_id ORDER BY start_tick, pitch DESC, note_ord) AS BIGINT) AS place FROM notes", "notes"))
def w07(spark, sf):
    w = Window.partitionBy("score_id").orderBy("start_tick", F.desc("pitch"), "note_ord")
    return d.notes(spark, sf).select("score_id", "note_ord", F.row_number().over(w).cast("long").alias("place"))


@query("w09_signature_changes", d.with_sql("SELECT score_id, idx AS measure, numerator, denominator FROM bars QUALIFY lag(numerator) OVER (PARTITION BY score_id ORDER BY idx) IS DISTINCT FROM numerator OR lag(denominator) OVER (PARTITION BY score_id ORDER BY idx) IS DISTINCT FROM denominator", "bars"))
def w09(spark, sf):
    w = Window.partitionBy("score_id").orderBy("index")
    rows = d.bars(spark, sf).withColumn("was", F.lag(F.struct("numerator", "denominator")).over(w))
    return rows.where(~F.col("was").eqNullSafe(F.struct("numerator", "denominator"))).select("score_id", F.col("index").alias("measure"), "numerator", "denominator")


@query("w10_increasing_bar_numbers", d.with_sql("SELECT score_id, note_ord, pitch AS printed FROM (SELECT *, max(pitch) OVER (PARTITION BY score_id ORDER BY note_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM notes) t WHERE top IS NULL OR pitch > top", "notes"))
def w10(spark, sf):
    w = Window.partitionBy("score_id").orderBy("note_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = d.notes(spark, sf).withColumn("top", F.max("pitch").over(w))
    return rows.where("top is null or pitch > top").select("score_id", "note_ord", F.col("pitch").alias("printed"))


@query("w12_beam_groups", d.with_sql("SELECT score_id, measure, w, CAST(count(*) AS BIGINT) AS notes, min(note_ord) AS first_note FROM (SELECT n.score_id, n.note_ord, w.measure, w.w FROM notes n JOIN win w ON n.score_id = w.score_id AND n.start_tick >= w.w_start AND n.start_tick < w.w_end WHERE n.duration < 480) t GROUP BY 1, 2, 3 HAVING count(*) > 1", "win"))
def w12(spark, sf):
    short = d.notes(spark, sf).where("duration < 480").select("score_id", "note_ord", "start_tick", F.lit(1).alias("duration"))
    rows = tl.overlaps(short, d.beats(spark, sf)).where("start_tick >= w_start")
    return rows.groupBy("score_id", "measure", "w").agg(F.count("*").alias("notes"), F.min("note_ord").alias("first_note")).where("notes > 1")


@query("o01_canonical_sort", d.with_sql("SELECT score_id, note_ord, CAST(row_number() OVER (PARTITION BY score_id, track_ord ORDER BY start_tick, pitch DESC, note_ord) - 1 AS BIGINT) AS place, track_ord FROM notes", "notes"))
def o01(spark, sf):
    w = Window.partitionBy("score_id", "track_ord").orderBy("start_tick", F.desc("pitch"), "note_ord")
    return d.notes(spark, sf).select("score_id", "note_ord", (F.row_number().over(w) - 1).cast("long").alias("place"), "track_ord")


@query("o08_groups_of_four_measures", d.with_sql("SELECT score_id, CAST(idx // 4 AS BIGINT) AS line, min(start_tick) AS start_tick, max(end_tick) AS end_tick, CAST(count(*) AS BIGINT) AS measures FROM bars GROUP BY 1, 2", "bars"))
def o08(spark, sf):
    return d.bars(spark, sf).groupBy("score_id", F.expr("index div 4").alias("line")).agg(F.min("start_tick").alias("start_tick"), F.max("end_tick").alias("end_tick"), F.count("*").alias("measures"))


@query("j17_next_on_same_string", d.with_sql("SELECT score_id, voice, note_ord, lead(note_ord) OVER (PARTITION BY score_id, voice ORDER BY start_tick, note_ord) AS next_note FROM notes", "notes"))
def j17(spark, sf):
    w = Window.partitionBy("score_id", "voice").orderBy("start_tick", "note_ord")
    return d.notes(spark, sf).select("score_id", "voice", "note_ord", F.lead("note_ord").over(w).alias("next_note"))


_PC = "CASE CAST(pitch % 12 AS INTEGER) WHEN 0 THEN 'C' WHEN 1 THEN 'C#' WHEN 2 THEN 'D' WHEN 3 THEN 'D#' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'F#' WHEN 7 THEN 'G' WHEN 8 THEN 'G#' WHEN 9 THEN 'A' WHEN 10 THEN 'A#' ELSE 'B' END"


@query("p18_distinct_warnings", d.with_sql(f"SELECT score_id, string_agg(name, ',' ORDER BY first) AS warnings FROM (SELECT score_id, {_PC} AS name, min(note_ord) AS first FROM notes GROUP BY 1, 2) t GROUP BY 1", "notes"))
def p18(spark, sf):
    rows = d.notes(spark, sf).select("score_id", "note_ord", F.regexp_replace(midi_name(F.col("pitch")), r"-?\d+$", "").alias("name"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("note_ord", "name"))), lambda x: x["name"])
    return rows.groupBy("score_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("warnings"))


@query("p19_low_confidence", "SELECT event_id, value FROM events WHERE value < 0.5")
def p19(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where("value < 0.5").select("event_id", "value")


@query("a03_distinct_pitches", d.with_sql("SELECT score_id, string_agg(CAST(pitch AS VARCHAR), ',' ORDER BY pitch) AS pitches FROM (SELECT DISTINCT score_id, pitch FROM notes) t GROUP BY 1", "notes"))
def a03(spark, sf):
    return d.notes(spark, sf).groupBy("score_id").agg(F.array_join(F.array_sort(F.collect_set("pitch")), ",").alias("pitches"))


@query("a11_upper_median", d.with_sql("SELECT score_id, list_sort(list(pitch))[len(list(pitch)) // 2 + 1] AS mid FROM notes GROUP BY 1", "notes"))
def a11(spark, sf):
    items = F.sort_array(F.collect_list("pitch"))
    return d.notes(spark, sf).groupBy("score_id").agg(items.alias("p")).select("score_id", F.get("p", F.expr("size(p) div 2")).alias("mid"))


@query("a10_mode_first_seen", d.with_sql("SELECT score_id, arg_min(pitch, k) AS mode FROM (SELECT score_id, pitch, -count(*) * 1000000 + min(note_ord) AS k FROM notes GROUP BY 1, 2) t GROUP BY 1", "notes"))
def a10(spark, sf):
    per = d.notes(spark, sf).groupBy("score_id", "pitch").agg(F.count("*").alias("n"), F.min("note_ord").alias("first"))
    return per.groupBy("score_id").agg(F.min_by("pitch", F.struct(-F.col("n"), F.col("first"))).alias("mode"))


@query("a25_mean_pitch_clef", d.with_sql("SELECT score_id, track_ord, round(avg(pitch), 6) AS mean_pitch, CASE WHEN avg(pitch) < 55 THEN 'F' ELSE 'G' END AS clef FROM notes GROUP BY 1, 2", "notes"))
def a25(spark, sf):
    return d.notes(spark, sf).groupBy("score_id", "track_ord").agg(F.avg("pitch").alias("m")).select("score_id", "track_ord", F.round("m", 6).alias("mean_pitch"), F.when(F.col("m") < 55, "F").otherwise("G").alias("clef"))


@query("a21_bounding_box", d.with_sql("SELECT score_id, track_ord, min(start_tick) AS x0, max(start_tick + duration) AS x1, min(pitch) AS y0, max(pitch) AS y1 FROM notes GROUP BY 1, 2", "notes"))
def a21(spark, sf):
    return d.notes(spark, sf).groupBy("score_id", "track_ord").agg(F.min("start_tick").alias("x0"), F.max(F.col("start_tick") + F.col("duration")).alias("x1"), F.min("pitch").alias("y0"), F.max("pitch").alias("y1"))


@query("a22_conditional_counts", d.with_sql("SELECT score_id, CAST(count(*) FILTER (WHERE duration > 480) AS BIGINT) AS long_notes, CAST(count(*) FILTER (WHERE pitch < 45) AS BIGINT) AS low_notes FROM notes GROUP BY 1", "notes"))
def a22(spark, sf):
    return d.notes(spark, sf).groupBy("score_id").agg(F.count_if(F.col("duration") > 480).alias("long_notes"), F.count_if(F.col("pitch") < 45).alias("low_notes"))


@query("f05_key_names", "SELECT CAST(f AS INTEGER) AS fifths, m AS mode, CASE WHEN m = 'minor' THEN list_extract(['Ab','Eb','Bb','F','C','G','D','A','E','B','F#','C#','G#','D#','A#'], CAST(f + 8 AS INTEGER)) ELSE list_extract(['Cb','Gb','Db','Ab','Eb','Bb','F','C','G','D','A','E','B','F#','C#'], CAST(f + 8 AS INTEGER)) END || ' ' || m AS name FROM (SELECT unnest(range(-7, 8)) f) a, (SELECT unnest(['major', 'minor']) m) b")
def f05(spark, sf):
    rows = spark.range(-7, 8).select(F.col("id").cast("int").alias("fifths"), F.explode(F.array(F.lit("major"), F.lit("minor"))).alias("mode"))
    return rows.select("fifths", "mode", key_name(F.col("fifths"), F.col("mode")).alias("name"))


@query("f01_pitch_class_octave", "SELECT p AS pitch, CAST(((p % 12) + 12) % 12 AS INTEGER) AS pc, CAST(floor(p / 12.0) - 1 AS INTEGER) AS octave FROM (SELECT unnest(range(-24, 140)) p) t")
def f01(spark, sf):
    from ..functions.theory import octave

    return spark.range(-24, 140).select(F.col("id").alias("pitch"), pitch_class(F.col("id")).alias("pc"), octave(F.col("id")).alias("octave"))
