"""Queries on page images, over small engraved pages drawn here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import assembly, omr
from . import derived as d
from .registry import query


def engraved(steps: list[int], top: int = 100, gap: int = 10) -> np.ndarray:
    """A staff of one or more bars with four quarter notes each, on ``steps`` from the middle line."""
    bars = -(-len(steps) // 4)
    width = 80 + 200 * bars
    a = np.full((300, width, 4), 255, np.uint8)
    black = lambda x0, y0, x1, y1: a[int(y0) : int(y1) + 1, int(x0) : int(x1) + 1, :3].fill(0)
    for i in range(5):
        black(40, top + gap * i, width - 40, top + gap * i + 1)
    for b in range(1, bars + 1):
        black(40 + 200 * b - 1, top, 40 + 200 * b, top + 41)
    y, x = np.mgrid[0:300, 0:width]
    for k, s in enumerate(steps):
        cx, cy = 40 + 200 * (k // 4) + 35 + 42 * (k % 4), top + 20.5 - s * gap / 2
        a[((x - cx) / 6.5) ** 2 + ((y - cy) / 5) ** 2 <= 1, :3] = 0
        black(cx + 5, cy - 30, cx + 6, cy)
    return a


def _pages(spark):
    rows = []
    for s in range(6):
        a = engraved([(s + k * 3) % 8 - 4 for k in range(8)])
        rows.append((s, 0, a.shape[1], a.shape[0], bytearray(a.tobytes())))
    return spark.createDataFrame(rows, "score_id long, page int, width int, height int, rgba binary")


@query("c12_read_pages", "SELECT CAST(s AS BIGINT) AS score_id, CAST(k * 480 AS BIGINT) AS start_tick, CAST(((34 + (s + k * 3) % 8 - 4) // 7 + 1) * 12 + [0, 2, 4, 5, 7, 9, 11][(34 + (s + k * 3) % 8 - 4) % 7 + 1] AS INTEGER) AS pitch, CAST(480 AS BIGINT) AS duration FROM (SELECT unnest(range(0, 6)) s) a, (SELECT unnest(range(0, 8)) k) b")
def c12(spark, sf):
    return omr.recognise(_pages(spark)).select("score_id", "start_tick", "pitch", "duration")


@query("c10_staff_lines", "SELECT CAST(s AS BIGINT) AS score_id, CAST(k AS INTEGER) AS line, CAST(100 + 10 * k AS BIGINT) AS y FROM (SELECT unnest(range(0, 6)) s) a, (SELECT unnest(range(0, 5)) k) b")
def c10(spark, sf):
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for sid, w, h, data in zip(b["score_id"], b["width"], b["height"], b["rgba"]):
                for staff in omr.staves(omr.binary(omr.grey(np.frombuffer(data, np.uint8).reshape(h, w, 4)))):
                    rows += [(sid, k, int(y)) for k, y in enumerate(staff.lines)]
            yield pd.DataFrame(rows, columns=["score_id", "line", "y"])

    return _pages(spark).mapInPandas(run, "score_id long, line int, y long").select("score_id", F.col("line"), "y")


_HEADS = """heads AS (SELECT score_id, CAST(track_ord AS INTEGER) part, start_tick // 960 AS measure, CAST(start_tick AS DOUBLE) x, CAST(note_ord AS INTEGER) head_ord,
 CAST(28 + pitch % 5 AS INTEGER) degree, CASE WHEN note_ord % 7 = 0 THEN CAST(pitch % 3 - 1 AS INTEGER) END accidental, velocity % 3 > 0 AS tied, CAST(score_id % 15 - 7 AS INTEGER) fifths FROM notes)"""


def with_tables(tables: str) -> str:
    return d.with_sql("", "notes").rstrip() + ",\n" + tables


def _heads(spark, sf):
    return d.notes(spark, sf).selectExpr(
        "score_id", "CAST(track_ord AS INT) AS part", "start_tick DIV 960 AS measure", "CAST(start_tick AS DOUBLE) AS x", "CAST(note_ord AS INT) AS head_ord",
        "CAST(28 + pitch % 5 AS INT) AS degree", "CASE WHEN note_ord % 7 = 0 THEN CAST(pitch % 3 - 1 AS INT) END AS accidental", "velocity % 3 > 0 AS tied", "CAST(score_id % 15 - 7 AS INT) AS fifths",
    )


# The oracle walks every line of a part head by head and remembers what was set in the measure and what the one before ended with.
@query("c16_pitches_of_heads", with_tables(_HEADS + """, keyed AS (SELECT *, row_number() OVER (PARTITION BY score_id, part, degree ORDER BY measure, x, head_ord) AS r, degree % 7 AS letter,
  CASE WHEN list_position([3, 0, 4, 1, 5, 2, 6], degree % 7) <= fifths THEN 1 WHEN list_position([6, 2, 5, 1, 4, 0, 3], degree % 7) <= -fifths THEN -1 ELSE 0 END AS signed FROM heads),
walk AS (
 SELECT k.score_id, k.part, k.degree, k.r, k.measure, k.head_ord, k.letter, accidental AS held, CAST(NULL AS INTEGER) AS carried, coalesce(accidental, signed) AS alter FROM keyed k WHERE r = 1
 UNION ALL
 SELECT n.score_id, n.part, n.degree, n.r, n.measure, n.head_ord, n.letter, n.held, n.carried, coalesce(n.held, n.signed) FROM (
  SELECT k.*, CASE WHEN k.measure = w.measure THEN w.carried WHEN k.measure = w.measure + 1 THEN w.alter END AS carried,
   coalesce(k.accidental, CASE WHEN k.measure = w.measure THEN w.held END, CASE WHEN k.tied THEN CASE WHEN k.measure = w.measure THEN w.carried WHEN k.measure = w.measure + 1 THEN w.alter END END) AS held
  FROM walk w JOIN keyed k ON k.score_id = w.score_id AND k.part = w.part AND k.degree = w.degree AND k.r = w.r + 1) n)
SELECT score_id, part, head_ord, CAST(alter AS INTEGER) AS alter, CAST((degree // 7 + 1) * 12 + [0, 2, 4, 5, 7, 9, 11][letter + 1] + alter AS INTEGER) AS pitch FROM walk"""))
def c16_heads(spark, sf):
    """Sounding pitches of printed heads: key, accidentals until the barline, ties over barlines."""
    return assembly.resolve_pitches(_heads(spark, sf)).select("score_id", "part", "head_ord", "alter", "pitch")


@query("c17_fit_bars")
def c17(spark, sf):
    """Bars of four events made to fill a measure of 4/4."""
    events = d.notes(spark, sf).selectExpr(
        "score_id", "0 AS part", "note_ord DIV 4 AS measure", "CAST(note_ord AS INT) AS event_ord", "CAST(duration AS INT) AS ticks", "velocity / 128D AS confidence",
        "voice = 2 AND note_ord % 3 = 0 AS rest", "false AS whole_rest", "note_ord % 16 < 3 AS triplet", "1920 AS bar", "note_ord < 4 AS short_ok",
    )
    return assembly.fit_bars(events)


_CELLS = """cells AS (SELECT score_id, CAST(note_ord // 16 AS INTEGER) system, CAST(track_ord AS INTEGER) part, CAST(note_ord // 4 % 4 AS INTEGER) bar, CAST(sum(pitch) AS BIGINT) s FROM notes GROUP BY ALL),
barrows AS (SELECT score_id, system, part, bar, CASE WHEN s % 6 > 0 THEN CASE WHEN s % 4 = 0 THEN 480 * (score_id % 5 + 2) ELSE 1440 END END ticks, CASE WHEN s % 6 = 0 THEN 2 + s % 3 END slashes FROM cells),
systems AS (SELECT DISTINCT score_id, system, (score_id + system) % 4 = 0 printed, 1920 nominal, (score_id + system) % 2 = 0 unsigned FROM cells)"""


def _barrows(spark, sf):
    cell = ["score_id", F.expr("CAST(note_ord DIV 16 AS INT)").alias("system"), F.col("track_ord").cast("int").alias("part"), F.expr("CAST(note_ord DIV 4 % 4 AS INT)").alias("bar")]
    return d.notes(spark, sf).groupBy(*cell).agg(F.sum("pitch").alias("s")).selectExpr(
        "score_id", "system", "part", "bar", "CASE WHEN s % 6 > 0 THEN CASE WHEN s % 4 = 0 THEN 480 * (score_id % 5 + 2) ELSE 1440 END END AS ticks", "CASE WHEN s % 6 = 0 THEN CAST(2 + s % 3 AS INT) END AS slashes",
    )


# The oracle gives every system its pool by a join of ranges and counts the bars themselves.
METERS = """kept AS (SELECT b.*, CASE WHEN ticks IS NULL THEN 1 ELSE 0 END AS kind, CASE WHEN ticks IS NULL THEN slashes * 480 ELSE ticks END AS size FROM barrows b
 WHERE ticks IS NULL OR NOT ((system = 0 AND bar = 0) OR (system = (SELECT max(system) FROM systems s WHERE s.score_id = b.score_id)
  AND bar = (SELECT max(bar) FROM barrows o WHERE o.score_id = b.score_id AND o.system = b.system AND o.part = b.part)))),
member AS (SELECT p.score_id, p.system AS pool, k.system FROM systems p JOIN systems k ON k.score_id = p.score_id AND k.system BETWEEN p.system AND p.system + 3
 WHERE NOT EXISTS (SELECT 1 FROM systems x WHERE x.score_id = p.score_id AND x.system > p.system AND x.system <= k.system AND x.printed)
  AND 3 > (SELECT greatest(count(*) FILTER (WHERE kind = 0), count(*) FILTER (WHERE kind = 1)) FROM kept e WHERE e.score_id = p.score_id AND e.system >= p.system AND e.system < k.system)),
pooled AS (SELECT m.pool, k.*, count(*) FILTER (WHERE kind = 0) OVER w AS notes_n, count(*) FILTER (WHERE kind = 1) OVER w AS marks_n FROM member m JOIN kept k ON k.score_id = m.score_id AND k.system = m.system WINDOW w AS (PARTITION BY m.score_id, m.pool)),
tally AS (SELECT score_id, pool, size, count(*) AS n, min((system, part, bar)) AS spot FROM pooled WHERE kind = CASE WHEN notes_n < 3 AND marks_n >= 3 THEN 1 ELSE 0 END GROUP BY 1, 2, 3),
led AS (SELECT *, sum(n) OVER (PARTITION BY score_id, pool) AS total, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS rival FROM tally WINDOW w AS (PARTITION BY score_id, pool ORDER BY n DESC, spot)),
best AS (SELECT l.*, s.unsigned, n >= 3 AND 5 * n >= 3 * total AS strong FROM led l JOIN systems s ON s.score_id = l.score_id AND s.system = l.pool WHERE r = 1 AND size <> nominal),
named AS (SELECT *, CASE WHEN strong THEN CASE WHEN size % 480 = 0 AND size // 480 BETWEEN 2 AND 7 THEN size // 480 WHEN size % 240 = 0 AND size // 240 BETWEEN 5 AND 13 THEN size // 240 END
 WHEN unsigned AND CASE WHEN total < 3 THEN n = 2 ELSE (total <= 4 AND n >= 2 AND 5 * n >= 3 * total) OR (n >= 4 AND n >= 2 * rival AND 5 * n >= 2 * total) END
 THEN CASE size WHEN 960 THEN 2 WHEN 1440 THEN 3 WHEN 1920 THEN 4 WHEN 720 THEN 3 WHEN 2160 THEN 9 WHEN 2880 THEN 12 END END AS top FROM best)"""
METER_COLUMNS = "CAST(pool AS INTEGER) AS system, CAST(top AS INTEGER) AS numerator, CAST(CASE WHEN size = 480 * top THEN 4 ELSE 8 END AS INTEGER) AS denominator, CAST(n AS BIGINT) AS bars, CAST(total AS BIGINT) AS total, NOT strong AS low_confidence"


@query("c34_infer_meters", with_tables(f"{_CELLS},\n{METERS}\nSELECT score_id, {METER_COLUMNS} FROM named WHERE top IS NOT NULL"))
def c34_meters(spark, sf):
    """Meters that systems without a trusted signature add up to."""
    rows = _barrows(spark, sf)
    systems = rows.select("score_id", "system").distinct().selectExpr("*", "(score_id + system) % 4 = 0 AS printed", "1920L AS nominal", "(score_id + system) % 2 = 0 AS unsigned")
    return assembly.infer_meters(rows, systems)
