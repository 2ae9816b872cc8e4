"""Chord queries: histograms, candidates, detection, printed chords, strumming, diagrams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chord_names as cn
from ..functions.theory import pitch_class
from ..operators import chords as ch
from ..operators import timeline as tl
from . import derived as d
from .registry import query

_OV = """, ov AS (SELECT n.score_id, n.note_ord, n.pitch, w.measure, w.w, w.w_start, w.w_end,
 greatest(CAST(n.start_tick AS DOUBLE), w.w_start) AS a, least(CAST(n.start_tick + greatest(n.duration, 1) AS DOUBLE), w.w_end) AS b
 FROM notes n JOIN win w ON n.score_id = w.score_id AND n.start_tick < w.w_end AND w.w_start < n.start_tick + greatest(n.duration, 1))"""


def _sql(body: str) -> str:
    return d.with_sql("", "win").rstrip() + _OV + body


@query("a01_pitch_class_histogram", d.with_sql("SELECT n.score_id, b.idx AS measure, n.pitch % 12 AS pc, sum(least(CAST(n.start_tick + greatest(n.duration, 1) AS DOUBLE), b.end_tick) - greatest(CAST(n.start_tick AS DOUBLE), b.start_tick)) AS ticks FROM notes n JOIN bars b ON n.score_id = b.score_id AND n.start_tick < b.end_tick AND b.start_tick < n.start_tick + greatest(n.duration, 1) GROUP BY 1, 2, 3", "bars"))
def a01(spark, sf):
    rows = tl.overlaps(d.notes(spark, sf), d.beats(spark, sf, "measure"))
    return rows.groupBy("score_id", "measure", pitch_class(F.col("pitch")).cast("long").alias("pc")).agg(F.sum("ov").alias("ticks"))


@query("a02_window_bass", _sql(" SELECT score_id, measure, w, min(pitch) FILTER (WHERE b - a >= (w_end - w_start) * 0.2 OR b - a >= 1) AS bass FROM ov GROUP BY 1, 2, 3"))
def a02(spark, sf):
    return ch.profiles(d.notes(spark, sf), d.beats(spark, sf)).select("score_id", "measure", "w", "bass")


@query("a04_presence_gates", _sql(" SELECT score_id, measure, w, sum(b - a) AS total, CAST(count(DISTINCT pitch % 12) AS INTEGER) AS distinct_pcs FROM ov GROUP BY 1, 2, 3, w_end - w_start HAVING sum(b - a) >= 0.3 * (w_end - w_start) AND count(DISTINCT pitch % 12) >= 2"))
def a04(spark, sf):
    p = ch.profiles(d.notes(spark, sf), d.beats(spark, sf))
    p = p.withColumn("total", F.aggregate("hist", F.lit(0.0), lambda a, x: a + x)).withColumn("distinct_pcs", F.size(F.filter("hist", lambda x: x > 0)))
    return p.where((F.col("total") >= (F.col("w_end") - F.col("w_start")) * 0.3) & (F.col("distinct_pcs") >= 2)).select("score_id", "measure", "w", "total", "distinct_pcs")


@query("a07_overlap_time", _sql(""" , mk AS (SELECT score_id, measure, w, a AS t, 1 AS dd FROM ov UNION ALL SELECT score_id, measure, w, b, -1 FROM ov),
 rn AS (SELECT *, sum(dd) OVER (PARTITION BY score_id, measure, w ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live, lead(t) OVER (PARTITION BY score_id, measure, w ORDER BY t, dd) AS nt FROM mk)
 SELECT score_id, measure, w, coalesce(sum(nt - t) FILTER (WHERE live >= 2), 0) AS together FROM rn GROUP BY 1, 2, 3"""))
def a07(spark, sf):
    return ch.profiles(d.notes(spark, sf), d.beats(spark, sf)).select("score_id", "measure", "w", "together")


@query("a09_slash_bass", _sql(""" , pt AS (SELECT score_id, measure, w, pitch, w_end - w_start AS wl, sum(b - a) AS held, max(CASE WHEN b - a >= (w_end - w_start) * 0.2 OR b - a >= 1 THEN 1 ELSE 0 END) AS firm FROM ov GROUP BY 1, 2, 3, 4, 5),
 bs AS (SELECT score_id, measure, w, min(pitch) FILTER (WHERE firm = 1) AS bass FROM pt GROUP BY 1, 2, 3)
 SELECT p.score_id, p.measure, p.w, b.bass % 12 AS slash FROM pt p JOIN bs b USING (score_id, measure, w) GROUP BY 1, 2, 3, 4 HAVING max(CASE WHEN p.pitch = b.bass AND p.held >= 0.5 * p.wl THEN 1 ELSE 0 END) = 1 AND min(CASE WHEN p.pitch <> b.bass THEN p.pitch - b.bass ELSE 99 END) >= 3"""))
def a09(spark, sf):
    p = ch.profiles(d.notes(spark, sf), d.beats(spark, sf)).where("bass is not null")
    held = F.element_at("held", F.array_position("pitches", F.col("bass")).cast("int")) >= (F.col("w_end") - F.col("w_start")) * 0.5
    clear = F.forall("pitches", lambda x: (x == F.col("bass")) | (x - F.col("bass") >= 3))
    return p.where(held & clear).select("score_id", "measure", "w", F.pmod("bass", F.lit(12)).alias("slash"))


_TEMPLATES_SQL = ", ".join(f"({i}, '{q}', [{', '.join(map(str, t))}])" for i, (q, t) in enumerate(cn.TEMPLATES.items()))
_SCORED = f""" , hh AS (SELECT score_id, measure, w, pitch % 12 AS pc, sum(b - a) AS v FROM ov GROUP BY 1, 2, 3, 4),
 tt AS (SELECT score_id, measure, w, sum(v) AS total FROM hh GROUP BY 1, 2, 3),
 bs AS (SELECT score_id, measure, w, min(pitch) FILTER (WHERE b - a >= (w_end - w_start) * 0.2 OR b - a >= 1) % 12 AS bass FROM ov GROUP BY 1, 2, 3),
 tpl AS (SELECT * FROM (VALUES {_TEMPLATES_SQL}) v(qi, quality, ivs)),
 cand AS (SELECT CAST(r AS INTEGER) root, qi, quality, ivs, CAST(r * 17 + qi AS INTEGER) AS cand_ord FROM tpl, (SELECT unnest(range(0, 12)) r) z),
 iv AS (SELECT cand_ord, root, quality, len(ivs) AS k, unnest(ivs) AS i FROM cand),
 hs AS (SELECT h.score_id, h.measure, h.w, h.pc, h.v / t.total AS v FROM hh h JOIN tt t USING (score_id, measure, w)),
 sc AS (SELECT t.score_id, t.measure, t.w, i.cand_ord, i.root, i.quality,
   1.5 * sum(coalesce(h.v, 0)) - 0.5 - 0.01 * max(i.k)
   - sum(CASE WHEN coalesce(h.v, 0) > 0.02 THEN 0 WHEN i.i = 0 THEN 0.45 WHEN i.i = 7 THEN CASE WHEN i.quality IN ('dim','aug','m7b5','dim7') THEN 0.3 ELSE 0.1 END WHEN i.quality IN ('sus2','sus4') OR i.i IN (3, 4) THEN 0.3 ELSE 0.35 END)
   - CASE WHEN i.quality IN ('sus2','sus4','add9','6','m6','9','m9') AND max(CASE WHEN i.i = CASE i.quality WHEN 'sus4' THEN 5 WHEN '6' THEN 9 WHEN 'm6' THEN 9 ELSE 2 END THEN coalesce(h.v, 0) ELSE 0 END) < 0.6 * max(CASE WHEN i.i = 0 THEN coalesce(h.v, 0) ELSE 0 END) THEN 0.3 ELSE 0 END
   + CASE WHEN bs.bass IS NULL THEN 0 WHEN bs.bass = i.root THEN 0.15 WHEN max(CASE WHEN (i.root + i.i) % 12 = bs.bass THEN 1 ELSE 0 END) = 1 THEN 0.04 ELSE -0.05 END AS score
   FROM tt t JOIN bs USING (score_id, measure, w) CROSS JOIN iv i LEFT JOIN hs h ON h.score_id = t.score_id AND h.measure = t.measure AND h.w = t.w AND h.pc = (i.root + i.i) % 12
   GROUP BY t.score_id, t.measure, t.w, i.cand_ord, i.root, i.quality, bs.bass)"""


def _judged(spark, sf):
    return ch.judged(ch.profiles(d.notes(spark, sf), d.beats(spark, sf)))


# The shift keeps scores that are round numbers away from the edges of the steps.
@query("a05_candidate_scores", _sql(_SCORED + " SELECT score_id, measure, w, CAST(count(*) AS BIGINT) AS candidates, CAST(sum(CAST(floor(score * 1000000 + 0.37) AS BIGINT) * (cand_ord + 1)) AS BIGINT) AS checksum, max(CAST(floor(score * 1000000 + 0.37) AS BIGINT)) AS best FROM sc GROUP BY 1, 2, 3"))
def a05(spark, sf):
    """All 204 scores of each window, in millionths, summed up by candidate."""
    steps = F.transform("scores", lambda x: F.floor(x * 1000000 + 0.37))
    rows = _judged(spark, sf).select("score_id", "measure", "w", steps.alias("steps"))
    return rows.select("score_id", "measure", "w", F.size("steps").cast("long").alias("candidates"), F.aggregate(F.transform("steps", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"), F.array_max("steps").alias("best"))


@query("a06_best_candidate", _sql(_SCORED + " SELECT score_id, measure, w, root, quality FROM sc QUALIFY row_number() OVER (PARTITION BY score_id, measure, w ORDER BY round(score, 9) DESC, cand_ord) = 1"))
def a06(spark, sf):
    near = F.transform("scores", lambda x: F.round(x, 9))
    rows = _judged(spark, sf).select("score_id", "measure", "w", near.alias("s"))
    at = (F.array_position("s", F.array_max("s")) - 1).cast("int")
    names = F.array(*[F.lit(q) for q in ch.QUALITIES])
    return rows.select("score_id", "measure", "w", F.floor(at / len(ch.QUALITIES)).cast("int").alias("root"), F.get(names, F.pmod(at, F.lit(len(ch.QUALITIES)))).alias("quality"))


@query("c02_detect_chords")
def c02(spark, sf):
    return ch.detect(d.notes(spark, sf), d.bars(spark, sf), d.key_signatures(spark, sf), "half")


@query("c02_detect_chords_by_beat")
def c02_beat(spark, sf):
    return ch.detect(d.notes(spark, sf), d.bars(spark, sf), d.key_signatures(spark, sf), "beat")


_PRINTED = """, nx AS (SELECT score_id, tick, lead(tick) OVER (PARTITION BY score_id ORDER BY tick) AS nxt FROM (SELECT DISTINCT score_id, tick FROM printed) u),
 fin AS (SELECT l.score_id, coalesce((SELECT end_tick FROM bars b WHERE b.score_id = l.score_id AND l.t >= b.start_tick AND l.t < b.end_tick), (SELECT max(end_tick) FROM bars b WHERE b.score_id = l.score_id)) AS stop FROM (SELECT score_id, max(tick) t FROM printed GROUP BY 1) l),
 shown AS (SELECT p.score_id, p.ord, CAST(p.tick AS DOUBLE) AS tick, greatest(1.0, coalesce(CAST(n.nxt AS DOUBLE), greatest(f.stop, p.tick + 1.0)) - p.tick) AS duration, p.text AS name, p.quality FROM printed p JOIN nx n USING (score_id, tick) JOIN fin f USING (score_id))"""


@query("j04_printed_chord_until_next", d.with_sql("", "printed", "bars").rstrip() + _PRINTED + " SELECT score_id, ord, tick, duration, name FROM shown")
def j04(spark, sf):
    return ch.printed_events(d.printed(spark, sf), d.bars(spark, sf)).select("score_id", "ord", "tick", "duration", "name")


@query("j05_inferred_outside_printed", d.with_sql("", "printed", "win").rstrip() + _PRINTED + " SELECT w.score_id, w.w_start AS tick FROM win w WHERE w.w = 0 AND NOT EXISTS (SELECT 1 FROM printed p JOIN bars b ON p.score_id = b.score_id AND p.tick >= b.start_tick AND p.tick < b.end_tick WHERE b.score_id = w.score_id AND b.idx = w.measure)")
def j05(spark, sf):
    bars = d.bars(spark, sf)
    covered = tl.locate(d.printed(spark, sf).select("score_id", F.col("tick").cast("double").alias("tick")), bars).where("measure is not null").select("score_id", "measure")
    return tl.windows(bars).where("w = 0").join(covered, ["score_id", "measure"], "left_anti").select("score_id", F.col("w_start").alias("tick"))


def _inferred(spark, sf):
    """A stand-in for inferred chords: the first window of every second measure."""
    return d.beats(spark, sf).where("w = 0 and measure % 2 = 0").select("score_id", F.col("w_start").alias("tick"), (F.col("w_end") - F.col("w_start")).alias("duration"), F.lit("N").alias("name"), F.lit(0).alias("root"), F.lit("").alias("quality"))


_MERGED = _PRINTED + """, inf AS (SELECT score_id, measure, w_start AS tick, w_end - w_start AS duration, 'N' AS name FROM win WHERE w = 0 AND measure % 2 = 0),
 mg AS (SELECT i.score_id, i.tick, i.duration, i.name, false AS printed FROM inf i WHERE NOT EXISTS (SELECT 1 FROM printed p JOIN bars b ON p.score_id = b.score_id AND p.tick >= b.start_tick AND p.tick < b.end_tick WHERE b.score_id = i.score_id AND b.idx = i.measure)
 UNION ALL SELECT score_id, tick, duration, name, true FROM shown)"""


@query("c03_merge_printed_chords", d.with_sql("", "printed", "win").rstrip() + _MERGED + " SELECT score_id, tick, duration, name, printed FROM mg")
def c03(spark, sf):
    bars = d.bars(spark, sf)
    shown = ch.printed_events(d.printed(spark, sf), bars)
    return ch.merged(_inferred(spark, sf), shown, bars).select("score_id", "tick", "duration", "name", "printed")


@query("c04_strum_chart", d.with_sql("", "printed", "win").rstrip() + _MERGED + " SELECT w.score_id, CAST(w.measure // 4 AS BIGINT) AS line, w.w_start AS tick, coalesce((SELECT arg_min(name, m.tick) FROM mg m WHERE m.score_id = w.score_id AND m.tick >= w.w_start AND m.tick < w.w_end), (SELECT arg_max(name, m.tick) FROM mg m WHERE m.score_id = w.score_id AND m.printed AND m.tick < w.w_start AND m.tick + m.duration > w.w_start)) AS chord FROM win w")
def c04(spark, sf):
    bars = d.bars(spark, sf)
    both = ch.merged(_inferred(spark, sf), ch.printed_events(d.printed(spark, sf), bars), bars)
    return ch.strum_cells(bars, both)


@query("u01_union_sorted", d.with_sql("", "printed", "win").rstrip() + _MERGED + " SELECT score_id, tick, name, CAST(row_number() OVER (PARTITION BY score_id ORDER BY tick, printed) AS BIGINT) AS place FROM mg")
def u01(spark, sf):
    bars = d.bars(spark, sf)
    both = ch.merged(_inferred(spark, sf), ch.printed_events(d.printed(spark, sf), bars), bars)
    return both.select("score_id", "tick", "name", F.row_number().over(Window.partitionBy("score_id").orderBy("tick", "printed")).cast("long").alias("place"))


@query("w02_merge_adjacent", d.with_sql("SELECT score_id, min(note_ord) AS first_note, CAST(count(*) AS BIGINT) AS notes, sum(duration) AS duration, voice FROM (SELECT *, sum(fresh) OVER (PARTITION BY score_id ORDER BY note_ord) AS island FROM (SELECT *, CASE WHEN voice = lag(voice) OVER (PARTITION BY score_id ORDER BY note_ord) THEN 0 ELSE 1 END AS fresh FROM notes) a) b GROUP BY score_id, island, voice", "notes"))
def w02(spark, sf):
    w = Window.partitionBy("score_id").orderBy("note_ord")
    rows = d.notes(spark, sf).withColumn("fresh", F.when(F.col("voice") == F.lag("voice").over(w), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    return rows.groupBy("score_id", "island", "voice").agg(F.min("note_ord").alias("first_note"), F.count("*").alias("notes"), F.sum("duration").alias("duration")).drop("island")


@query("a23_chord_preview", d.with_sql("SELECT score_id, string_agg(text, ' ' ORDER BY ord) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY ord) AS k FROM (SELECT *, lag(text) OVER (PARTITION BY score_id ORDER BY ord) AS was FROM printed) a WHERE was IS DISTINCT FROM text) b WHERE k <= 5 GROUP BY 1", "printed"))
def a23(spark, sf):
    w = Window.partitionBy("score_id").orderBy("ord")
    runs = d.printed(spark, sf).withColumn("was", F.lag("text").over(w)).where(~F.col("was").eqNullSafe(F.col("text")))
    ordered = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ord", "text"))), 1, 5), lambda x: x["text"])
    return runs.groupBy("score_id").agg(F.array_join(ordered, " ").alias("preview"))


@query("f09_parse_chord_names", d.with_sql("SELECT DISTINCT text, CASE text WHEN 'C' THEN 0 WHEN 'Dm' THEN 2 WHEN 'G7' THEN 7 WHEN 'Bb' THEN 10 WHEN 'F#m' THEN 6 WHEN 'Am7' THEN 9 ELSE 3 END AS root, quality FROM printed", "printed"))
def f09(spark, sf):
    rows = cn.over_distinct(d.printed(spark, sf).select("text").distinct(), "text", cn.describe, cn.DESCRIBED)
    return rows.select("text", "text_x.root", "text_x.quality")


@query("f13_chord_diagrams")
def f13(spark, sf):
    from ..model import STANDARD

    rows = cn.over_distinct(d.printed(spark, sf).select("text").distinct(), "text", cn.shape(STANDARD), cn.SHAPED)
    return rows.select("text", F.array_join("text_x.frets", ",").alias("frets"), "text_x.base", F.array_join("text_x.pitches", ",").alias("pitches"))


@query("a08_concentrated_windows", _sql(""" , hh AS (SELECT score_id, measure, w, pitch % 12 AS pc, sum(b - a) AS v FROM ov GROUP BY 1, 2, 3, 4),
 hs AS (SELECT *, v / sum(v) OVER (PARTITION BY score_id, measure, w) AS s FROM hh)
 SELECT score_id, measure, w FROM hs GROUP BY 1, 2, 3 HAVING sum(CASE WHEN pc IN (0, 4, 7) THEN v ELSE 0 END) >= 0.75 * sum(v) AND count(*) FILTER (WHERE pc IN (0, 4, 7) AND s > 0.02) = 3"""))
def a08(spark, sf):
    """Windows whose sound is nearly all one major triad on C, the first candidate but for its quality's place."""
    major = ch.QUALITIES.index("")
    return _judged(spark, sf).where(F.get("concentrated", F.lit(major))).select("score_id", "measure", "w")


@query("f14_shape_details")
def f14(spark, sf):
    """Base fret, barre and fingers of shapes in three tunings."""
    from ..model import TUNINGS

    names = spark.createDataFrame([(n,) for n in ("C", "F#m", "Bb7", "Dsus2", "Em7b5", "G/B", "Am/D")], "name string")
    out = None
    for label in ("Standard (EADGBE)", "Drop D", "DADGAD"):
        one = cn.over_distinct(names, "name", cn.shape(TUNINGS[label]), cn.SHAPED).select(F.lit(label).alias("tuning"), "name", F.array_join("name_x.frets", ",").alias("frets"), "name_x.base", F.array_join("name_x.fingers", ",").alias("fingers"), F.array_join("name_x.barre", ",").alias("barre"))
        out = one if out is None else out.unionByName(one)
    return out
