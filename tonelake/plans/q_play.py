"""Playback, layout and audio queries."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..batches import records, table
from ..functions import theory as th
from ..operators import audio, layout
from ..operators import playback as pb
from ..operators import timeline as tl
from . import derived as d
from .registry import query

_SEG = ", seg AS (SELECT score_id, tick, bpm, lead(tick) OVER (PARTITION BY score_id ORDER BY tick, ord) AS nxt FROM tp)"


def _sec(tick: str, sid: str) -> str:
    return f"(SELECT coalesce(sum((least(coalesce(g.nxt, {tick}), {tick}) - g.tick) / 480.0 * (60.0 / g.bpm)), 0) FROM seg g WHERE g.score_id = {sid} AND g.tick < {tick})"


def _tied(spark, sf):
    return d.notes(spark, sf).withColumn("tied_from_previous", F.col("note_ord") % 4 == 3)


@query("j09_tie_merge", d.with_sql(""", g AS (SELECT *, count(*) FILTER (WHERE note_ord % 4 <> 3) OVER (PARTITION BY score_id, pitch ORDER BY start_tick, note_ord) AS struck FROM notes),
 f AS (SELECT *, CASE WHEN note_ord % 4 = 3 AND max(start_tick + duration) OVER (PARTITION BY score_id, pitch, struck ORDER BY start_tick, note_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_tick - 2 THEN 0 ELSE 1 END AS fresh FROM g),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY score_id, pitch ORDER BY start_tick, note_ord) AS chain FROM f)
 SELECT score_id, pitch, min(start_tick) AS start_tick, max(start_tick + duration) AS end_tick, arg_min(velocity, note_ord) AS velocity FROM c GROUP BY score_id, pitch, chain""", "notes"))
def j09(spark, sf):
    return pb.sounding(_tied(spark, sf)).select("score_id", "pitch", "start_tick", "end_tick", "velocity")


@query("c06_note_events", d.with_sql("", "tp").rstrip() + _SEG + f" SELECT score_id, pitch, round({_sec('n.start_tick', 'n.score_id')}, 6) AS t, round(({_sec('(n.start_tick + n.duration)', 'n.score_id')}) - ({_sec('n.start_tick', 'n.score_id')}), 6) AS dur, round(pow(greatest(1, velocity) / 127.0, 1.3), 6) AS gain FROM notes n")
def c06(spark, sf):
    rows = pb.note_events(d.notes(spark, sf).withColumn("tied_from_previous", F.lit(False)), d.tempos(spark, sf))
    return rows.select("score_id", F.col("pitch").cast("long").alias("pitch"), F.round("t", 6).alias("t"), F.round("dur", 6).alias("dur"), F.round("gain", 6).alias("gain"))


_IN_FORCE = "(SELECT arg_max(ts.{0}, ts.ord) FROM ts WHERE ts.score_id = m.score_id AND ts.tick <= m.tick)"
_CLICKS = f""", mk AS (SELECT score_id, CAST(0 AS DOUBLE) AS tick, length FROM len
  UNION ALL SELECT score_id, tick + step, length FROM (SELECT m.*, CAST(least(480.0, 1920.0 / {_IN_FORCE.format("denominator")}) AS DOUBLE) AS step FROM mk m) z WHERE tick + step <= length),
 mm AS (SELECT m.*, {_IN_FORCE.format("tick")} AS origin, CAST(1920.0 * {_IN_FORCE.format("numerator")} / {_IN_FORCE.format("denominator")} AS DOUBLE) AS whole FROM mk m)"""


@query("c06_metronome", d.with_sql(_CLICKS + _SEG + f" SELECT w.score_id, round({_sec('w.tick', 'w.score_id')}, 6) AS t, CASE WHEN (w.tick - origin) % whole = 0 THEN 'accent' ELSE 'click' END AS kind FROM mm w", "ts", "tp"))
def c06_clicks(spark, sf):
    ends = tl.score_lengths(d.notes(spark, sf)).withColumnRenamed("length", "end_tick")
    return pb.clicks(ends, d.time_signatures(spark, sf), d.tempos(spark, sf)).select("score_id", F.round("t", 6).alias("t"), "kind")


def _chords(spark, sf):
    p = d.printed(spark, sf)
    from ..operators.chords import printed_events

    return printed_events(p, d.bars(spark, sf)).select("score_id", "tick", "duration", "name")


@query("c05_strums")
def c05(spark, sf):
    return pb.strums(d.notes(spark, sf), d.bars(spark, sf), _chords(spark, sf))


@query("c05_chord_events")
def c05_events(spark, sf):
    return pb.chord_events(pb.strums(d.notes(spark, sf), d.bars(spark, sf), _chords(spark, sf)), d.tempos(spark, sf))


@query("j19_active_chord", d.with_sql("SELECT n.score_id, n.note_ord, (SELECT arg_max(text, ord) FROM printed p WHERE p.score_id = n.score_id AND p.tick <= n.start_tick + 1) AS chord FROM notes n", "printed"))
def j19(spark, sf):
    lists = tl.change_lists(d.printed(spark, sf), ["text"], "chords")
    rows = d.notes(spark, sf).join(lists, "score_id", "left")
    before = F.filter("chords", lambda c: c["tick"] <= F.col("start_tick") + 1)
    return rows.select("score_id", "note_ord", F.when(F.size(before) > 0, F.element_at(before, -1)["text"]).alias("chord"))


@query("c08_measure_widths", d.with_sql("SELECT b.score_id, b.idx AS \"index\", CAST(greatest(96, coalesce(o.n, 0) * 34 + 32) + CASE WHEN lag(numerator) OVER w IS DISTINCT FROM numerator OR lag(denominator) OVER w IS DISTINCT FROM denominator THEN 20 ELSE 0 END AS BIGINT) AS width FROM bars b LEFT JOIN (SELECT b2.score_id, b2.idx, count(DISTINCT start_tick_n) AS n FROM (SELECT score_id, start_tick AS start_tick_n FROM notes) n JOIN bars b2 ON n.score_id = b2.score_id AND start_tick_n >= b2.start_tick AND start_tick_n < b2.end_tick GROUP BY 1, 2) o ON o.score_id = b.score_id AND o.idx = b.idx WINDOW w AS (PARTITION BY b.score_id ORDER BY b.idx)", "bars"))
def c08(spark, sf):
    return layout.widths(d.bars(spark, sf), d.notes(spark, sf)).select("score_id", "index", "width")


#: A page 800 wide: 754 for measures; lines by recursion, then onsets, ends and starts of measures.
_PAGE = """, ons AS (SELECT DISTINCT b.score_id, b.idx, n.start_tick AS tick FROM notes n JOIN bars b ON n.score_id = b.score_id AND n.start_tick >= b.start_tick AND n.start_tick < b.end_tick),
 mt AS (SELECT b.*, coalesce(o.n, 0) AS n, lag(numerator) OVER w IS DISTINCT FROM numerator OR lag(denominator) OVER w IS DISTINCT FROM denominator AS fresh
  FROM bars b LEFT JOIN (SELECT score_id, idx, count(*) AS n FROM ons GROUP BY 1, 2) o ON o.score_id = b.score_id AND o.idx = b.idx WINDOW w AS (PARTITION BY b.score_id ORDER BY b.idx)),
 wd AS (SELECT *, greatest(96, n * 34 + 32) + CASE WHEN fresh THEN 20 ELSE 0 END AS width, CASE WHEN fresh THEN 40 ELSE 20 END AS inset FROM mt),
 br AS (SELECT score_id, idx, width AS used, CAST(0 AS BIGINT) AS line FROM wd WHERE idx = 0
  UNION ALL SELECT w.score_id, w.idx, CASE WHEN b.used + w.width > 754 THEN w.width ELSE b.used + w.width END, CASE WHEN b.used + w.width > 754 THEN b.line + 1 ELSE b.line END FROM br b JOIN wd w ON w.score_id = b.score_id AND w.idx = b.idx + 1),
 st AS (SELECT wd.*, br.line, CAST(754 AS DOUBLE) / sum(width) OVER (PARTITION BY wd.score_id, line) AS k, line = max(line) OVER (PARTITION BY wd.score_id) AS ends FROM wd JOIN br ON wd.score_id = br.score_id AND wd.idx = br.idx),
 sw AS (SELECT *, width * CASE WHEN ends THEN least(k, 1.25) ELSE k END AS w0 FROM st),
 od AS (SELECT o.score_id, o.idx, o.tick, inset + (o.tick - start_tick) / (end_tick - start_tick) * (w0 - 12 - inset) AS ideal, row_number() OVER (PARTITION BY o.score_id, o.idx ORDER BY o.tick) AS i FROM ons o JOIN sw ON o.score_id = sw.score_id AND o.idx = sw.idx),
 ox AS (SELECT a.score_id, a.idx, a.tick, max(b.ideal + (a.i - b.i) * CAST(27.2 AS DOUBLE)) AS dx FROM od a JOIN od b ON a.score_id = b.score_id AND a.idx = b.idx AND b.i <= a.i GROUP BY 1, 2, 3),
 fw AS (SELECT sw.*, greatest(w0, coalesce(r.reach + 12, 0)) AS w FROM sw LEFT JOIN (SELECT score_id, idx, max(dx) AS reach FROM ox GROUP BY 1, 2) r ON r.score_id = sw.score_id AND r.idx = sw.idx),
 pg AS (SELECT *, 36 + coalesce(sum(w) OVER (PARTITION BY score_id, line ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, CAST(42 + line * 186 AS BIGINT) AS staff_top FROM fw)"""


def _page(spark, sf):
    return layout.placed(d.bars(spark, sf), d.notes(spark, sf), 800)


@query("c08_tab_layout", d.with_sql(_PAGE + ' SELECT score_id, idx AS "index", CAST(line AS INTEGER) AS line, round(x, 4) AS x, round(w, 4) AS w, staff_top FROM pg', "bars"))
def c08_layout(spark, sf):
    return _page(spark, sf).select("score_id", "index", "line", F.round("x", 4).alias("x"), F.round("w", 4).alias("w"), "staff_top")


@query("f38_note_positions", d.with_sql(_PAGE + " SELECT n.score_id, n.note_ord, round(pg.x + ox.dx, 4) AS x, CAST(staff_top + n.note_ord % 6 * 16 AS BIGINT) AS y FROM notes n JOIN ox ON ox.score_id = n.score_id AND ox.tick = n.start_tick JOIN pg ON pg.score_id = ox.score_id AND pg.idx = ox.idx", "bars"))
def f38(spark, sf):
    notes = d.notes(spark, sf).withColumn("string", F.col("note_ord") % 6)
    return layout.note_positions(_page(spark, sf), notes).withColumn("x", F.round("x", 4))


@query("o07_line_breaks", d.with_sql(""", wd AS (SELECT score_id, idx, CAST(100 + (idx * 37 + score_id) % 90 AS BIGINT) AS width FROM bars),
 br AS (SELECT score_id, idx, width AS used, 0 AS line FROM wd WHERE idx = 0
  UNION ALL SELECT w.score_id, w.idx, CASE WHEN b.used + w.width > 600 THEN w.width ELSE b.used + w.width END, CASE WHEN b.used + w.width > 600 THEN b.line + 1 ELSE b.line END FROM br b JOIN wd w ON w.score_id = b.score_id AND w.idx = b.idx + 1)
 SELECT score_id, idx AS "index", line FROM br""", "bars"))
def o07(spark, sf):
    w = d.bars(spark, sf).select("score_id", "index", ((F.col("index") * 37 + F.col("score_id")) % 90 + 100).cast("long").alias("width"))
    return layout.lines(w, 600).select("score_id", "index", "line")


@query("o06_voice_lanes")
def o06(spark, sf):
    rows = d.notes(spark, sf).select("score_id", F.expr("start_tick div 1920").alias("measure"), F.col("start_tick").alias("start"), F.col("duration").alias("dur"), F.col("note_ord").alias("ord"))
    return layout.lanes(rows)


@query("f34_tick_to_x", d.with_sql("SELECT score_id, note_ord, round(CAST(CASE WHEN start_tick <= 0 THEN 10.0 WHEN start_tick <= 1000 THEN 10 + start_tick * 0.05 WHEN start_tick <= 9000 THEN 60 + (start_tick - 1000) * 0.0125 ELSE 160.0 END AS DOUBLE), 6) AS x FROM notes", "notes"))
def f34(spark, sf):
    pts = F.array(*[F.struct(F.lit(float(t)).alias("tick"), F.lit(float(x)).alias("x")) for t, x in ((0, 10), (1000, 60), (9000, 160))])
    return d.notes(spark, sf).select("score_id", "note_ord", F.round(layout.interpolate(pts, F.col("start_tick").cast("double"), "tick", "x"), 6).alias("x"))


@query("f39_find_system", d.with_sql("SELECT n.score_id, n.note_ord, coalesce(b.idx // 4, (SELECT max(idx) // 4 FROM bars z WHERE z.score_id = n.score_id)) AS system FROM (SELECT score_id, note_ord, start_tick * 2 AS t FROM notes) n LEFT JOIN bars b ON n.score_id = b.score_id AND n.t >= b.start_tick AND n.t < b.end_tick", "bars"))
def f39(spark, sf):
    bars = d.bars(spark, sf)
    rows = tl.locate(d.notes(spark, sf).select("score_id", "note_ord", (F.col("start_tick") * 2).cast("double").alias("tick")), bars)
    last = bars.groupBy("score_id").agg(F.expr("max(index) div 4").alias("last"))
    return rows.join(last, "score_id").select("score_id", "note_ord", F.coalesce(F.expr("measure div 4"), "last").alias("system"))


@query("c08_active_entries", d.with_sql("SELECT p.score_id, p.tick, n.note_ord FROM (SELECT score_id, CAST(k * 777 AS BIGINT) AS tick FROM len, (SELECT unnest(range(0, 12)) k) r) p JOIN notes n ON n.score_id = p.score_id AND n.start_tick <= p.tick AND n.start_tick + n.duration > p.tick", "len"))
def c08_active(spark, sf):
    n = d.notes(spark, sf)
    entries = n.select("score_id", F.col("start_tick").alias("start"), (F.col("start_tick") + F.col("duration")).alias("end"), "note_ord")
    points = n.select("score_id").distinct().select("score_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: (k * 777).cast("long"))).alias("tick"))
    return layout.active_at(entries, points).select("score_id", "tick", "note_ord")


@query("f27_norm_box", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 10) / 10.0 WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 700) / 700.0 END AS x FROM events")
def f27(spark, sf):
    i = F.col("event_id")
    box = F.struct(F.when(i % 2 == 0, i % 10 / 10).otherwise((i % 700).cast("double")).alias("x"), F.when(i % 2 == 0, 0.5).otherwise(50.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    size = F.when(i % 3 == 0, F.lit(None).cast("double")).otherwise(700.0)
    made = layout.norm_box(F.col("box"), size, F.lit(100.0))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", box.alias("box")).select("event_id", made["x"].alias("x"))


@query("f31_gain", "SELECT CAST(v AS BIGINT) AS v, round(pow(greatest(1, v) / 127.0, 1.3), 9) AS gain FROM (SELECT unnest(range(0, 128)) v) t")
def f31(spark, sf):
    return spark.range(128).select(F.col("id").alias("v"), F.round(th.gain(F.col("id")), 9).alias("gain"))


@query("f29_hz_to_midi", "SELECT CAST(h AS BIGINT) AS hz, round(69 + 12 * log2(h / 440.0), 9) AS midi FROM (SELECT unnest(range(30, 4500, 7)) h) t")
def f29(spark, sf):
    return spark.range(30, 4500, 7).select(F.col("id").alias("hz"), F.round(th.hz_midi(F.col("id")), 9).alias("midi"))


@query("f28_estimate_bpm", d.with_sql(""", io AS (SELECT score_id, start_tick * 0.0021 - lag(start_tick * 0.0021, 1) OVER w AS a, start_tick * 0.0021 - lag(start_tick * 0.0021, 2) OVER w AS b FROM notes WINDOW w AS (PARTITION BY score_id ORDER BY note_ord)),
 gp AS (SELECT score_id, a AS g FROM io WHERE a > 0.05 UNION ALL SELECT score_id, b FROM io WHERE b < 2),
 sc AS (SELECT score_id, bpm, avg(cos(2 * pi() * g * bpm / 60) + 0.5 * cos(4 * pi() * g * bpm / 60)) - abs(bpm - 110) / 5000.0 AS s FROM gp, (SELECT unnest(range(60, 181)) bpm) r GROUP BY 1, 2)
 SELECT score_id, CAST(bpm AS INTEGER) AS bpm FROM sc QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY round(s, 9) DESC, bpm) = 1""", "notes"))
def f28(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("score_id").orderBy("note_ord")
    sec = F.col("start_tick") * F.lit(0.0021)
    io = d.notes(spark, sf).select("score_id", (sec - F.lag(sec, 1).over(w)).alias("a"), (sec - F.lag(sec, 2).over(w)).alias("b"))
    gaps = io.select("score_id", F.explode(F.array_compact(F.array(F.when(F.col("a") > 0.05, F.col("a")), F.when(F.col("b") < 2, F.col("b"))))).alias("g"))
    rows = gaps.select("score_id", "g", F.explode(F.sequence(F.lit(60), F.lit(180))).alias("bpm"))
    turn = F.lit(2 * math.pi) * F.col("g") * F.col("bpm") / 60
    fit = rows.groupBy("score_id", "bpm").agg((F.avg(F.cos(turn) + 0.5 * F.cos(2 * turn))).alias("s"))
    fit = fit.withColumn("s", F.round(F.col("s") - F.abs(F.col("bpm") - 110) / 5000, 9))
    return fit.groupBy("score_id").agg(F.max_by("bpm", F.struct("s", -F.col("bpm"))).cast("int").alias("bpm"))


@query("w04_median_filter", d.with_sql("SELECT score_id, note_ord, list_sort(v)[len(v) // 2 + 1] AS mid FROM (SELECT score_id, note_ord, list(pitch) OVER (PARTITION BY score_id ORDER BY note_ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM notes) t", "notes"))
def w04(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("score_id").orderBy("note_ord").rowsBetween(-2, 2)
    rows = d.notes(spark, sf).select("score_id", "note_ord", F.sort_array(F.collect_list("pitch").over(w)).alias("v"))
    return rows.select("score_id", "note_ord", F.get("v", F.expr("size(v) div 2")).alias("mid"))


def _tone(midi: list[int], rate: int = 22050) -> bytes:
    x = np.concatenate([0.5 * np.sin(2 * np.pi * 440 * 2 ** ((m - 69) / 12) * np.arange(rate // 2) / rate) for m in midi])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


@query("c07_transcribe_audio", "SELECT CAST(s AS BIGINT) AS score_id, CAST(k AS INTEGER) AS note_ord, CAST(57 + (s * 5 + k * 4) % 24 AS INTEGER) AS pitch FROM (SELECT unnest(range(0, 6)) s) a, (SELECT unnest(range(0, 4)) k) b")
def c07(spark, sf):
    """Synthetic tones, written as WAV and read back."""
    rows = [(s, bytearray(_tone([57 + (s * 5 + k * 4) % 24 for k in range(4)]))) for s in range(6)]
    return audio.transcribe_all(spark.createDataFrame(rows, "score_id long, wav binary")).select("score_id", "note_ord", "pitch")


# A start is the largest of the starts so far, each moved on by a sixteenth a note: a running maximum.
@query("f30_quantize_without_overlap", d.with_sql(""", q AS (SELECT score_id, note_ord, CAST(floor(start_tick / 900.0::DOUBLE * 110 * 480 / 60 / 120 + 0.5) AS BIGINT) * 120 AS spot,
  greatest(120, CAST(floor(((start_tick + duration) / 900.0::DOUBLE - start_tick / 900.0::DOUBLE) * 110 * 480 / 60 / 120 + 0.5) AS BIGINT) * 120) AS size FROM notes),
 m AS (SELECT *, max(spot - note_ord * 120) OVER (PARTITION BY score_id ORDER BY note_ord) + note_ord * 120 AS start_tick FROM q),
 n AS (SELECT *, lead(start_tick) OVER (PARTITION BY score_id ORDER BY note_ord) AS nxt FROM m)
 SELECT score_id, CAST(note_ord AS INTEGER) AS note_ord, CAST(start_tick AS BIGINT) AS start_tick, CAST(CASE WHEN nxt < start_tick + size THEN greatest(120, nxt - start_tick) ELSE size END AS BIGINT) AS duration FROM n""", "notes"))
def f30(spark, sf):
    seq = F.sort_array(F.collect_list(F.struct("note_ord", "start_tick", "duration", "pitch")))
    rows = d.notes(spark, sf).groupBy("score_id").agg(seq.alias("n"))

    def run(batches):
        schema = pa.schema([("score_id", pa.int64()), ("note_ord", pa.int32()), ("start_tick", pa.int64()), ("duration", pa.int64())])
        for part in records(batches):
            out = []
            for r in part:
                q = audio.quantize([(x["start_tick"] / 900, (x["start_tick"] + x["duration"]) / 900, x["pitch"], 1.0) for x in r["n"]], 110)
                out += [(r["score_id"], i, x["start"], x["duration"]) for i, x in enumerate(q)]
            yield table(out, schema)

    return rows.mapInArrow(run, "score_id long, note_ord int, start_tick long, duration long")


_BOXES = """, bx AS (SELECT score_id, note_ord // 128 AS page, note_ord AS ord, start_tick AS start, note_ord % 16 / 16.0::DOUBLE AS x, note_ord // 16 % 8 / 8.0::DOUBLE AS y, 0.03125::DOUBLE AS w, 0.03125::DOUBLE AS h FROM notes),
 ck AS (SELECT score_id, i AS click, i % 2 AS page, i * 37 % 64 / 64.0::DOUBLE AS fx, i * 23 % 64 / 64.0::DOUBLE AS fy FROM len, (SELECT unnest(range(0, 12)) i) z),
 pr AS (SELECT ck.score_id, click, start, ord, x, y, w, h, fx, fy, abs(y + h / 2 - fy) AS dy, abs(x + w / 2 - fx) AS dx FROM ck JOIN bx USING (score_id, page)),
 rw AS (SELECT *, first_value(y + h / 2) OVER o AS mid, first_value(h) OVER o AS rh FROM pr WINDOW o AS (PARTITION BY score_id, click ORDER BY dy, start, ord)),
 hit AS (SELECT score_id, click, min(start) AS tick FROM rw WHERE fx BETWEEN x AND x + w AND fy BETWEEN y AND y + h GROUP BY 1, 2),
 nr AS (SELECT score_id, click, start AS tick FROM rw WHERE abs(y + h / 2 - mid) <= greatest(rh, 0.02) * 1.5 QUALIFY row_number() OVER (PARTITION BY score_id, click ORDER BY dx, start, ord) = 1)"""


@query("c08_tick_at_click", d.with_sql(_BOXES + " SELECT nr.score_id, nr.click, coalesce(hit.tick, nr.tick) AS tick FROM nr LEFT JOIN hit USING (score_id, click)", "notes", "len"))
def c08_clicks(spark, sf):
    """Notes laid out sixteen to a row and eight rows to a page, and twelve clicks a score."""
    n = F.col("note_ord")
    boxes = d.notes(spark, sf).select(
        "score_id", F.expr("note_ord div 128").alias("page"), n.alias("ord"), F.col("start_tick").alias("start"), (n % 16 / 16.0).alias("x"), (F.expr("note_ord div 16") % 8 / 8.0).alias("y"), F.lit(0.03125).alias("w"), F.lit(0.03125).alias("h"),
    )
    i = F.col("click")
    clicks = boxes.select("score_id").distinct().select("score_id", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")).alias("click"))
    clicks = clicks.select("score_id", "click", (i % 2).alias("page"), (i * 37 % 64 / 64.0).alias("fx"), (i * 23 % 64 / 64.0).alias("fy"))
    return layout.tick_at_point(boxes, clicks)
