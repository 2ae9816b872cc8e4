"""Queries on systems of staves, laid out from ``events``.

Sixteen notes of a score are a system of two staves, four a bar.  What is read
beside them follows from numbers of the score and the system and holds the
awkward cases: open last bars, courtesy signatures, long rests, slashes, clefs
and meters that were not read, changes inside a system.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, systems
from ..session import written
from . import derived as d
from .q_omr import METER_COLUMNS, METERS, with_tables
from .registry import query

_TABLES = """base AS (SELECT score_id, CAST(note_ord // 16 AS INTEGER) system, CAST(track_ord AS INTEGER) part, CAST(note_ord // 4 % 4 AS INTEGER) place, CAST(note_ord AS INTEGER) ord, pitch, duration, velocity, voice,
  CAST(120 + 160 * (note_ord // 4 % 4) + 40 * (note_ord % 4) AS DOUBLE) x FROM notes),
size AS (SELECT score_id, system, max(place) + 1 AS n FROM base GROUP BY 1, 2),
tone AS (SELECT score_id, system, place, CAST(sum(pitch) AS BIGINT) s FROM base GROUP BY 1, 2, 3),
staves AS (SELECT z.score_id, z.system, p.part, 100.0 AS music_start, 100.0 + 160 * n + CASE WHEN (score_id + system) % 5 = 1 THEN 60 ELSE 0 END AS edge, n, n - CASE WHEN (score_id + system) % 5 = 0 THEN 1 ELSE 0 END AS bars,
  CASE WHEN part = 1 AND score_id % 2 = 1 THEN 'bass' ELSE 'treble' END AS clef, (score_id + system + part) % 4 > 0 AS clef_found, part = 1 AND score_id % 3 = 0 AS lower, part = 0 AND (score_id + system) % 3 = 0 AS octave_down,
  CAST((score_id + system // 3) % 5 - 2 + CASE WHEN system % 4 = 2 AND part = 0 THEN 1 ELSE 0 END AS INTEGER) AS fifths, CASE WHEN system % 6 = 0 AND score_id % 3 > 0 THEN CAST(2 + (score_id + system) % 3 AS INTEGER) END AS numerator, score_id % 4 = 0 AS from_sign, (score_id + system) % 9 = 0 AS unreadable
  FROM size z, (SELECT unnest([0, 1]) part) p),
events2 AS (SELECT score_id, system, part, place, ord, x, voice = 2 AS rest, CAST(duration * 2 AS INTEGER) AS ticks, CAST(pitch % 9 - 4 AS INTEGER) AS step, velocity FROM base),
marks AS (SELECT t.score_id, t.system, p.part, t.place FROM tone t, (SELECT unnest([0, 1]) part) p WHERE t.s % 7 = p.part),
longs AS (SELECT t.score_id, t.system, p.part, t.place, CAST(2 + t.s % 5 AS INTEGER) AS count FROM tone t, (SELECT unnest([0, 1]) part) p WHERE t.s % 3 = 0),
threes AS (SELECT t.score_id, t.system, p.part, t.place FROM tone t, (SELECT unnest([0, 1]) part) p WHERE t.s % 13 = 0),
signs AS (SELECT score_id, system, part, 110.0 + 160 * n AS x0, 140.0 + 160 * n AS x1, CAST(n - 1 AS INTEGER) AS barline, CAST(3 + score_id % 2 AS INTEGER) AS numerator, CAST(score_id % 3 AS INTEGER) AS fifths FROM staves WHERE (score_id + system) % 5 = 1
 UNION ALL SELECT score_id, system, part, 262.0, 270.0, 0, CASE WHEN score_id % 2 = 0 THEN CAST(2 + system % 3 AS INTEGER) END, CASE WHEN score_id % 3 > 0 THEN CAST(system % 7 - 3 AS INTEGER) END FROM staves WHERE (score_id + system) % 7 = 3 AND (score_id + system) % 5 <> 1 AND n > 2),"""

# Cells by counting, staff by staff.
_CELLS = _TABLES + """
spot AS (SELECT e.*, least(e.place, s.bars) AS cell, EXISTS (FROM threes t WHERE t.score_id = e.score_id AND t.system = e.system AND t.part = e.part AND t.place = e.place) AND e.ord % 4 < 3 AS triplet FROM events2 e JOIN staves s USING (score_id, system, part)),
held AS (SELECT score_id, system, part, cell, count(*) n, count(*) FILTER (WHERE NOT rest) heads FROM spot GROUP BY ALL),
grid AS (SELECT s.score_id, s.system, s.part, s.n AS width, s.bars, k.cell, coalesce(h.n, 0) AS n, coalesce(h.heads, 0) AS heads,
  (SELECT 3 * count(*) FROM marks m WHERE m.score_id = s.score_id AND m.system = s.system AND m.part = s.part AND least(m.place, s.bars) = k.cell) AS slashes,
  (SELECT max_by(count, place) FROM longs m WHERE m.score_id = s.score_id AND m.system = s.system AND m.part = s.part AND least(m.place, s.bars) = k.cell) AS long
  FROM staves s JOIN (SELECT unnest(range(0, 5)) AS cell) k ON k.cell <= s.bars LEFT JOIN held h ON h.score_id = s.score_id AND h.system = s.system AND h.part = s.part AND h.cell = k.cell),
kept0 AS (SELECT * FROM grid WHERE NOT (cell = bars AND (bars = width AND (score_id + system) % 5 <> 1 OR n = 0 AND slashes < 2 AND long IS NULL OR bars > 0 AND slashes < 2 AND long IS NULL AND heads = 0 AND 160 <= greatest(90, CASE WHEN bars > 1 THEN 88 ELSE 0 END)))),
rowed AS (SELECT *, slashes >= 2 AND heads = 0 AS slash, CASE WHEN long > 1 AND n <= 2 AND n = heads AND NOT (slashes >= 2 AND heads = 0) THEN long ELSE 1 END AS reps FROM kept0),
cells AS MATERIALIZED (SELECT *, CAST(coalesce(sum(reps) OVER (PARTITION BY score_id, system, part ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS bar, CASE WHEN slash AND n = 0 THEN slashes ELSE 0 END AS slash_count FROM rowed)"""


def tables(spark, sf) -> dict:
    """What was read of every system, as the operators take it."""
    # Notes are put in order once and written: else every table below would sort them again, several in one task.
    base = written(d.notes(spark, sf).selectExpr(
        "score_id", "CAST(note_ord DIV 16 AS INT) AS system", "CAST(track_ord AS INT) AS part", "CAST(note_ord DIV 4 % 4 AS INT) AS place", "CAST(note_ord AS INT) AS event_ord", "pitch", "duration", "velocity", "voice",
        "CAST(120 + 160 * (note_ord DIV 4 % 4) + 40 * (note_ord % 4) AS DOUBLE) AS x",
    ))
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("part")
    places = written(base.groupBy("score_id", "system", "place").agg(F.sum("pitch").alias("s")))
    tone = places.select("score_id", "system", "place", "s", both)
    size = written(places.groupBy("score_id", "system").agg((F.max("place") + 1).alias("n"))).select("score_id", "system", "n", both)
    k = "(score_id + system)"
    staves = size.selectExpr(
        "score_id", "CAST(system DIV 3 AS INT) AS page", "system", "part", "100D AS music_start", f"100D + 160 * n + CASE WHEN {k} % 5 = 1 THEN 60 ELSE 0 END AS right", "10D AS space",
        "CASE WHEN part = 1 AND score_id % 2 = 1 THEN 'bass' ELSE 'treble' END AS clef", "(score_id + system + part) % 4 > 0 AS clef_found", "part = 1 AND score_id % 3 = 0 AS lower", f"part = 0 AND {k} % 3 = 0 AS octave_down",
        "CAST((score_id + system DIV 3) % 5 - 2 + CASE WHEN system % 4 = 2 AND part = 0 THEN 1 ELSE 0 END AS INT) AS fifths", f"CASE WHEN system % 6 = 0 AND score_id % 3 > 0 THEN CAST(2 + {k} % 3 AS INT) END AS numerator",
        "CASE WHEN system % 6 = 0 AND score_id % 3 > 0 THEN 4 END AS denominator", "score_id % 4 = 0 AS from_sign", f"{k} % 9 = 0 AS unreadable",
    )
    bars = size.selectExpr("score_id", "system", "part", f"explode(sequence(1, 4)) AS i", f"n - CASE WHEN {k} % 5 = 0 THEN 1 ELSE 0 END AS bars").where("i <= bars").selectExpr("score_id", "system", "part", "100D + 160 * i AS x")
    at = lambda rows, *more: rows.selectExpr("score_id", "system", "part", *more)
    late = at(size.where(f"{k} % 5 = 1"), "110D + 160 * n AS x0", "140D + 160 * n AS x1", "CAST(n - 1 AS INT) AS barline", "CAST(3 + score_id % 2 AS INT) AS numerator", "4 AS denominator", "false AS from_sign", "CAST(score_id % 3 AS INT) AS fifths", "false AS unreadable")
    within = at(size.where(f"{k} % 7 = 3 AND {k} % 5 <> 1 AND n > 2"), "262D AS x0", "270D AS x1", "0 AS barline", "CASE WHEN score_id % 2 = 0 THEN CAST(2 + system % 3 AS INT) END AS numerator", "CASE WHEN score_id % 2 = 0 THEN 4 END AS denominator", "false AS from_sign", "CASE WHEN score_id % 3 > 0 THEN CAST(system % 7 - 3 AS INT) END AS fifths", "false AS unreadable")
    return {
        "staves": staves, "barlines": bars,
        "events": base.selectExpr("score_id", "system", "part", "event_ord", "x", "voice = 2 AS rest", "false AS whole_rest", "CAST(duration * 2 AS INT) AS ticks", "velocity / 128D AS confidence"),
        "heads": base.where("voice <> 2").selectExpr("score_id", "system", "part", "event_ord", "event_ord AS head_ord", "x", "CAST(pitch % 9 - 4 AS INT) AS step", "CASE WHEN event_ord % 7 = 0 THEN CAST(pitch % 3 - 1 AS INT) END AS accidental", "velocity % 3 > 0 AS tied", "velocity % 2 = 0 AND event_ord % 16 > 12 AS tie_out", "CAST(duration * 2 AS INT) AS ticks", "velocity / 128D AS confidence"),
        "slashes": at(tone.where("s % 7 = part"), "explode(array(130D + 160 * place, 170D + 160 * place, 210D + 160 * place)) AS x"),
        "rests": at(tone.where("s % 3 = 0"), "150D + 160 * place AS x0", "200D + 160 * place AS x1", "CAST(2 + s % 5 AS INT) AS count"),
        "signatures": late.unionByName(within),
        "tuplets": at(tone.where("s % 13 = 0"), "120D + 160 * place AS x0", "200D + 160 * place AS x1", "3 AS n"),
    }


def _laid(t: dict) -> systems.Cells:
    return systems.lay_out(*(t[k] for k in ("staves", "barlines", "events", "slashes", "rests", "signatures", "tuplets")))


@query("c17_cells", with_tables(_CELLS + "\nSELECT score_id, system, part, CAST(cell AS INTEGER) AS cell, bar, CAST(reps AS INTEGER) AS bars_here, slash, CAST(slash_count AS INTEGER) AS slash_count FROM cells"))
def c17_cells(spark, sf):
    """Bars of every staff: cells between barlines, long rests as many bars, slashes, courtesy cells dropped."""
    return _laid(tables(spark, sf)).cells.select("score_id", "system", "part", "cell", "bar", "bars_here", "slash", "slash_count")


@query("c17_events_in_bars", with_tables(_CELLS + "\nSELECT s.score_id, s.system, s.part, s.ord AS event_ord, c.bar, s.triplet FROM spot s JOIN cells c ON c.score_id = s.score_id AND c.system = s.system AND c.part = s.part AND c.cell = s.cell WHERE NOT c.slash AND c.reps = 1"))
def c17_events(spark, sf):
    """Chords and rests with the bar they stand in, and which of them stand under a triplet."""
    return _laid(tables(spark, sf)).events.select("score_id", "system", "part", "event_ord", "bar", "triplet")


# Systems one after another: what each decides from what the one before left.
_WALK = _CELLS + """,
barrows AS (SELECT score_id, system, part, bar, CAST(sum(CASE WHEN rest IS NULL THEN NULL WHEN triplet THEN floor(ticks * 2 / 3 + 0.5) ELSE ticks END) AS INTEGER) AS ticks, CAST(max(slash_count) AS INTEGER) AS slashes
  FROM (SELECT c.score_id, c.system, c.part, c.bar, s.rest, s.ticks, s.triplet, CASE WHEN c.slash_count > 0 THEN c.slash_count END AS slash_count, count(*) FILTER (WHERE NOT s.rest) OVER (PARTITION BY c.score_id, c.system, c.part, c.bar) AS heads
    FROM cells c LEFT JOIN spot s ON NOT c.slash AND c.reps = 1 AND c.score_id = s.score_id AND c.system = s.system AND c.part = s.part AND c.cell = s.cell) x WHERE heads > 0 OR slash_count > 0 GROUP BY 1, 2, 3, 4),
told AS (SELECT g.*, coalesce(c.bar, (SELECT sum(reps) FROM cells w WHERE w.score_id = g.score_id AND w.system = g.system AND w.part = g.part), 0) AS begins
  FROM signs g LEFT JOIN cells c ON c.score_id = g.score_id AND c.system = g.system AND c.part = g.part AND c.cell = g.barline + 1 WHERE g.part = 0 AND (g.numerator IS NOT NULL OR g.fifths IS NOT NULL)),
counted AS (SELECT score_id, system, max(total) AS bars FROM (SELECT score_id, system, part, sum(reps) AS total FROM cells GROUP BY ALL) x GROUP BY 1, 2),
systems AS (SELECT DISTINCT score_id, system, numerator IS NOT NULL AS printed, -1 AS nominal, true AS unsigned FROM staves WHERE part = 0),
""" + METERS + """,
guesses AS (SELECT score_id, """ + METER_COLUMNS + """ FROM named WHERE top IS NOT NULL),
sys0 AS (SELECT s.score_id, s.system, coalesce(c.bars, 0) AS bars, s.numerator AS own, s.from_sign, s.unreadable,
  CASE WHEN s.clef_found OR t.clef_found THEN s.fifths END AS readkey,
  (SELECT first(numerator ORDER BY begins, x0) FROM told o WHERE o.score_id = s.score_id AND o.system = s.system AND o.begins >= coalesce(c.bars, 0) AND numerator IS NOT NULL) AS next_top,
  (SELECT first(fifths ORDER BY begins, x0) FROM told o WHERE o.score_id = s.score_id AND o.system = s.system AND o.begins >= coalesce(c.bars, 0) AND fifths IS NOT NULL) AS next_key,
  EXISTS (FROM told o WHERE o.score_id = s.score_id AND o.system = s.system AND o.begins >= coalesce(c.bars, 0)) AS late, EXISTS (FROM told o WHERE o.score_id = s.score_id AND o.system = s.system AND o.begins < coalesce(c.bars, 0)) AS inside,
  g.numerator AS gnum, g.denominator AS gden, g.bars AS agree, g.total, g.low_confidence AS low
  FROM staves s JOIN staves t ON t.score_id = s.score_id AND t.system = s.system AND t.part = 1 AND s.part = 0 LEFT JOIN counted c ON c.score_id = s.score_id AND c.system = s.system LEFT JOIN guesses g ON g.score_id = s.score_id AND g.system = s.system),
sys AS MATERIALIZED (SELECT *, (SELECT max(begins) FROM told o WHERE o.score_id = sys0.score_id AND o.system = sys0.system AND begins BETWEEN 1 AND bars - 1 AND numerator IS NOT NULL) AS mid_at,
  (SELECT any_value(numerator) FROM told o WHERE o.score_id = sys0.score_id AND o.system = sys0.system AND begins BETWEEN 1 AND bars - 1 AND numerator IS NOT NULL) AS mid_top,
  (SELECT max(begins) FROM told o WHERE o.score_id = sys0.score_id AND o.system = sys0.system AND begins BETWEEN 1 AND bars - 1 AND fifths IS NOT NULL) AS key_at,
  (SELECT any_value(fifths) FROM told o WHERE o.score_id = sys0.score_id AND o.system = sys0.system AND begins BETWEEN 1 AND bars - 1 AND fifths IS NOT NULL) AS mid_key,
  coalesce(last_value(readkey IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY system), first_value(readkey IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY system ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS skey,
  system > 0 AND (own IS NOT NULL OR unreadable) AS starts FROM sys0),
seen AS MATERIALIZED (SELECT *, lead(skey) OVER w AS key1, lead(skey, 2) OVER w AS key2, lead(starts) OVER w AS starts1, lag(next_top) OVER w AS pend_top, lag(next_key) OVER w AS pend_key, coalesce(lag(late) OVER w, false) AS pend FROM sys WINDOW w AS (PARTITION BY score_id ORDER BY system)),
walk AS (
 SELECT -1 AS system, score_id, 4 AS num, 4 AS den, false AS known, true AS trusted, NULL::INTEGER AS key, CAST(0 AS BIGINT) AS tick, CAST(0 AS BIGINT) AS measure, 4 AS enum, 4 AS eden, false AS efirst, false AS mfirst FROM (SELECT DISTINCT score_id FROM seen) q
 UNION ALL
 SELECT system, score_id, coalesce(mid_top, num2), CASE WHEN mid_top IS NOT NULL THEN 4 ELSE den2 END, known2 OR mid_top IS NOT NULL, trusted2, key2n, CAST(tick + first_bars * (1920 * num2 // den2) + rest_bars * 480 * coalesce(mid_top, 0) AS BIGINT), CAST(measure + greatest(bars, 1) AS BIGINT), num2, den2, NOT known AND known2, NOT known2 AND mid_top IS NOT NULL FROM (
  SELECT *, CASE WHEN mid_at IS NOT NULL THEN mid_at ELSE greatest(bars, 1) END AS first_bars, CASE WHEN mid_at IS NOT NULL THEN bars - mid_at ELSE 0 END AS rest_bars,
   CASE WHEN override THEN gnum WHEN top IS NOT NULL THEN top WHEN takes THEN gnum ELSE num END AS num2, CASE WHEN override THEN gden WHEN top IS NOT NULL THEN 4 WHEN takes THEN gden ELSE den END AS den2, known OR top IS NOT NULL OR takes AS known2 FROM (
   SELECT *, coalesce(own IS NOT NULL AND NOT from_sign AND top <> 4 AND NOT low AND agree >= 4 AND agree >= 0.75 * total AND 1920 * gnum // gden <> 480 * top, false) OR coalesce(pend_top IS NOT NULL AND own IS NULL AND top <> 4 AND NOT low AND agree >= 4 AND agree >= 0.75 * total AND 1920 * gnum // gden <> 480 * top, false) AS override,
    CASE WHEN top IS NULL THEN trusted WHEN own IS NOT NULL THEN from_sign OR NOT unreadable ELSE NOT unreadable END AS trusted2,
    top IS NULL AND gnum IS NOT NULL AND 1920 * gnum // gden <> 1920 * num // den AND (NOT low OR system = 0 OR NOT trusted) AND (NOT known OR NOT trusted OR pend OR unreadable OR inside OR coalesce(key <> key2n, false)) AS takes FROM (
    SELECT n.*, w.num, w.den, w.known, w.trusted, w.key, w.tick, w.measure, coalesce(n.own, n.pend_top) AS top,
     CASE WHEN n.system = 0 THEN CASE WHEN n.skey <> n.key1 AND n.key1 = n.key2 AND NOT n.starts1 THEN n.key1 ELSE n.skey END WHEN n.pend_key IS NOT NULL THEN n.pend_key WHEN n.starts OR n.key1 = n.skey THEN n.skey ELSE w.key END AS key2n
    FROM walk w JOIN seen n ON n.score_id = w.score_id AND n.system = w.system + 1) a) b) c),
bars2 AS MATERIALIZED (SELECT w.score_id, w.system, m.i AS bar, p.measure + m.i AS measure, CASE WHEN s.mid_at IS NOT NULL AND m.i >= s.mid_at THEN s.mid_top ELSE w.enum END AS numerator, CASE WHEN s.mid_at IS NOT NULL AND m.i >= s.mid_at THEN 4 ELSE w.eden END AS denominator,
  CASE WHEN s.key_at IS NOT NULL AND m.i >= s.key_at THEN s.mid_key ELSE w.key END AS fifths, (w.efirst AND m.i = 0) OR (w.mfirst AND m.i = s.mid_at) AS told
  FROM walk w JOIN seen s ON s.score_id = w.score_id AND s.system = w.system JOIN walk p ON p.score_id = w.score_id AND p.system = w.system - 1 JOIN (SELECT unnest(range(0, 64)) AS i) m ON m.i < greatest(s.bars, 1)),
mrows AS MATERIALIZED (SELECT *, CAST(coalesce(sum(1920 * numerator // denominator) OVER (PARTITION BY score_id ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_tick FROM bars2)"""


def _score(spark, sf) -> systems.Score:
    return systems.assemble(**tables(spark, sf))


@query("c18_measures", with_tables(_WALK + "\nSELECT score_id, system, CAST(bar AS INTEGER) AS bar, measure, start_tick, CAST(numerator AS INTEGER) AS numerator, CAST(denominator AS INTEGER) AS denominator, CAST(fifths AS INTEGER) AS fifths FROM mrows"))
def c18_measures(spark, sf):
    """Measures of assembled scores with the meter and key in force."""
    return _score(spark, sf).measures.select("score_id", "system", "bar", "measure", "start_tick", "numerator", "denominator", "fifths")


@query("c18_signatures", with_tables(_WALK + """, l AS (SELECT *, lag((numerator, denominator)) OVER w AS pm, lag(fifths) OVER w AS pk, row_number() OVER w AS r FROM mrows WINDOW w AS (PARTITION BY score_id ORDER BY measure))
SELECT score_id, start_tick AS tick, numerator || '/' || denominator AS sign FROM l WHERE r = 1 OR pm <> (numerator, denominator) OR told UNION ALL SELECT score_id, start_tick, 'key ' || fifths FROM l WHERE r = 1 OR pk <> fifths"""))
def c18_signatures(spark, sf):
    """Change points of meter and key of assembled scores."""
    s = _score(spark, sf)
    return s.time_signatures.selectExpr("score_id", "tick", "concat(numerator, '/', denominator) AS sign").unionByName(s.key_signatures.selectExpr("score_id", "tick", "concat('key ', fifths) AS sign"))


# Clefs, octaves and accidentals are looked up head by head; starts of bars that fit are running sums.
@query("c18_notes", with_tables(_WALK + """,
clefs AS (SELECT score_id, system, part, coalesce(CASE WHEN clef_found THEN clef END, CASE WHEN NOT lower THEN (SELECT arg_max(o.clef, o.system) FROM staves o WHERE o.score_id = s.score_id AND o.part = s.part AND o.system < s.system AND o.clef_found) END, clef) AS clef,
  (SELECT avg(CASE WHEN o.octave_down THEN 1 ELSE 0 END) FROM staves o WHERE o.score_id = s.score_id AND o.part = s.part AND o.clef = 'treble') AS eight FROM staves s),
onbar AS MATERIALIZED (SELECT s.*, c.bar, m.measure, m.start_tick, 1920 * m.numerator // m.denominator AS nominal, m.fifths, CASE WHEN l.clef = 'bass' THEN 22 ELSE 34 END + s.step AS degree, CASE WHEN l.clef = 'treble' AND l.eight >= 0.5 THEN -12 ELSE 0 END AS shift,
  CASE WHEN s.triplet THEN CAST(floor(s.ticks * 2 / 3 + 0.5) AS INTEGER) ELSE s.ticks END AS size FROM spot s JOIN cells c ON c.score_id = s.score_id AND c.system = s.system AND c.part = s.part AND c.cell = s.cell AND NOT c.slash AND c.reps = 1
  JOIN mrows m ON m.score_id = s.score_id AND m.system = s.system AND m.bar = c.bar JOIN clefs l ON l.score_id = s.score_id AND l.system = s.system AND l.part = s.part),
timed AS (SELECT *, sum(size) OVER (PARTITION BY score_id, part, measure) AS total, coalesce(sum(size) OVER (PARTITION BY score_id, part, measure ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS within FROM onbar),
keyed AS (SELECT *, CASE WHEN ord % 7 = 0 THEN CAST(abs(hash(0)) * 0 + pitchmod AS INTEGER) END AS accidental, velocity % 3 > 0 AS tied, row_number() OVER (PARTITION BY score_id, part, degree ORDER BY measure, x, ord) AS r, degree % 7 AS letter,
  CASE WHEN list_position([3, 0, 4, 1, 5, 2, 6], degree % 7) <= fifths THEN 1 WHEN list_position([6, 2, 5, 1, 4, 0, 3], degree % 7) <= -fifths THEN -1 ELSE 0 END AS signed FROM (SELECT t.*, b.pitch % 3 - 1 AS pitchmod FROM timed t JOIN base b ON b.score_id = t.score_id AND b.ord = t.ord WHERE NOT t.rest) y),
chain AS (
 SELECT score_id, part, degree, r, measure, ord, accidental AS held, CAST(NULL AS INTEGER) AS carried, coalesce(accidental, signed) AS alter FROM keyed k WHERE r = 1
 UNION ALL
 SELECT score_id, part, degree, r, measure, ord, held, carried, coalesce(held, signed) FROM (
  SELECT k.*, CASE WHEN k.measure = w.measure THEN w.carried WHEN k.measure = w.measure + 1 THEN w.alter END AS carried,
   coalesce(k.accidental, CASE WHEN k.measure = w.measure THEN w.held END, CASE WHEN k.tied THEN CASE WHEN k.measure = w.measure THEN w.carried WHEN k.measure = w.measure + 1 THEN w.alter END END) AS held
  FROM chain w JOIN keyed k ON k.score_id = w.score_id AND k.part = w.part AND k.degree = w.degree AND k.r = w.r + 1) n),
sounds AS MATERIALIZED (SELECT k.*, greatest(0, least(127, least(127, greatest(0, (k.degree // 7 + 1) * 12 + [0, 2, 4, 5, 7, 9, 11][k.letter + 1] + c.alter)) + shift)) AS sound FROM keyed k JOIN chain c ON c.score_id = k.score_id AND c.part = k.part AND c.ord = k.ord),
opens AS (SELECT score_id, system + 1 AS system, part, max_by(sound, ord) AS sound, max_by(step, ord) AS step FROM sounds WHERE velocity % 2 = 0 AND ord % 16 > 12 GROUP BY ALL),
closes AS (SELECT s.score_id, s.part, s.ord FROM sounds s JOIN opens o ON o.score_id = s.score_id AND o.system = s.system AND o.part = s.part WHERE (o.sound = s.sound OR o.step = s.step) AND s.ord = (SELECT min(f.ord) FROM sounds f WHERE f.score_id = s.score_id AND f.system = s.system AND f.part = s.part))
SELECT s.score_id, s.part, s.ord AS head_ord, s.measure, CAST(s.sound AS INTEGER) AS pitch, s.tied OR c.ord IS NOT NULL AS tied, CASE WHEN abs(s.total - s.nominal) <= 1 THEN CAST(s.start_tick + s.within AS BIGINT) END AS start_tick
FROM sounds s LEFT JOIN closes c ON c.score_id = s.score_id AND c.part = s.part AND c.ord = s.ord""".replace("CAST(abs(hash(0)) * 0 + pitchmod AS INTEGER)", "CAST(pitchmod AS INTEGER)")))
def c18_notes(spark, sf):
    """Notes of assembled scores: sounding pitch, ties over lines, and where they start in bars whose lengths fit."""
    return _score(spark, sf).notes.select("score_id", "part", "head_ord", "measure", "pitch", "tied", F.when(F.col("how").isin("fits", "rests"), F.col("start_tick")).alias("start_tick"))
