"""Queries on pages that are drawn from ``events``: one page a score, eight symbols a staff.

What is drawn follows from a score's rows, in Spark; the SQL says what was drawn.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import glyphs, omr
from . import derived as d
from .registry import query

SPACE, LEFT, FIRST, WIDE = 10, 40, 130, 62
TOP, STAFF = 70, 140
PAGE = "score_id long, page int, width int, height int, rgba binary"


@cache
def drawing(kind: str, space: float) -> np.ndarray:
    """A symbol's drawing, made once a worker."""
    return glyphs.drawn(kind, space)


@cache
def head(high: float) -> np.ndarray:
    """A head, from 8 rows above to 8 below the row it begins in; ``high``: how far into that row its middle is."""
    yy, xx = np.mgrid[-8:9, -9:10]
    return (xx / 6.5) ** 2 + ((yy - high) / 5) ** 2 <= 1


def painted(ink: np.ndarray) -> np.ndarray:
    """Opaque pixels, black where there is ink and white elsewhere."""
    return np.where(ink, np.uint32(omr.BLACK), np.uint32(omr.WHITE)).view(np.uint8).reshape(*ink.shape, 4)


def listed(rows: pd.DataFrame | dict, *columns: str) -> list[tuple]:
    """Rows as tuples of plain values."""
    return list(zip(*[np.asarray(rows[c]).tolist() for c in columns]))


def draw(rows: pd.DataFrame | dict, clefs: bool = True) -> np.ndarray:
    """Pixels of one score's page; ``rows`` in order: staff, slot, kind (0 to 8), step, arc."""
    score, d_, n = int(np.ravel(rows["score_id"])[0]), SPACE, int(max(rows["staff"])) + 1
    right = FIRST + WIDE * 8 + 20
    ink = np.zeros((TOP + STAFF * n + 40, right + 40), bool)
    for s in range(n):
        top = TOP + STAFF * s
        for line in range(5):
            ink[top + d_ * line : top + d_ * line + 2, LEFT:right] = True
        ink[top : top + 4 * d_ + 2, right - 2 : right] = True
        if s % (score % 4 + 1):  # joined to the staff above
            ink[top - STAFF : top + 4 * d_ + 2, LEFT : LEFT + 3] = True
        if clefs:
            _put(ink, drawing("treble" if score % 2 == 0 else "bass", d_), 80, top + 2 * d_ + 1)
    items = listed(rows, "staff", "slot", "kind", "step", "arc")
    place = lambda staff, slot, step: (FIRST + WIDE * slot, TOP + STAFF * staff + 2 * d_ + 0.5 - step * d_ / 2)
    for (staff, slot, kind, step, arc), after in zip(items, [*items[1:], None]):
        (x, y), middle = place(staff, slot, step), TOP + STAFF * staff + 2 * d_ + 1
        if kind <= 4:
            ink[int(y) - 8 : int(y) + 9, x - 9 : x + 10] |= head(y - int(y))
            up = step < 0
            if up:
                ink[int(y) - 32 : int(y) + 1, x + 5 : x + 7] = True
            else:
                ink[int(y) : int(y) + 33, x - 6 : x - 4] = True
            if kind in (1, 2, 3):
                shape = drawing(("sharp", "flat", "natural")[kind - 1], d_)
                _put(ink, shape, x - 18, y if kind != 2 else y + 0.6 * d_ - shape.shape[0] / 2)
            if kind == 4:
                _put(ink, drawing("dot", d_), x + 14, y - (d_ / 2 if step % 2 == 0 else 0))
            if arc:
                (x1, y1), sign = place(after[0], after[1], after[3]), 1 if up else -1
                t = np.linspace(0, 1, 200)
                px, py = x + 8 + t * (x1 - x - 16), y + t * (y1 - y) + sign * (8 + 32 * t * (1 - t))
                for i in range(6):
                    ink[py.astype(int) + i // 2, px.astype(int) + i % 2] = True
        elif kind in (5, 6):
            _put(ink, drawing(("quarter_rest", "eighth_rest")[kind - 5], d_), x, middle)
        else:  # on the middle line, or under the line above
            a, b = (middle - 6, middle) if kind == 7 else (middle - d_, middle - d_ + 6)
            ink[a:b, x - 7 : x + 7] = True
    return painted(ink)


def _put(ink: np.ndarray, shape: np.ndarray, x: float, y: float) -> None:
    """Lay a drawing with its middle on a place."""
    h, w = shape.shape
    y0, x0 = int(round(y - h / 2)), int(round(x - w / 2))
    ink[y0 : y0 + h, x0 : x0 + w] |= shape


# One row a symbol: an arc leads to the next symbol of the staff if both are heads and the next has no accidental.
DRAWN_SQL = """slots AS (SELECT score_id, note_ord // 8 AS staff, note_ord % 8 AS slot, pitch % 9 AS kind, (pitch // 3) % 3 * 2 - 2 AS step, velocity FROM notes),
drawn AS (SELECT *, coalesce(kind <= 4 AND velocity % 2 = 0 AND lead(kind) OVER w IN (0, 4), false) AS arc, lead(step) OVER w AS after FROM slots WINDOW w AS (PARTITION BY score_id, staff ORDER BY slot))"""


def drawn(spark, sf):
    from pyspark.sql import Window

    row = Window.partitionBy("score_id", "staff").orderBy("slot")
    slots = d.notes(spark, sf).selectExpr("score_id", "CAST(note_ord DIV 8 AS INT) AS staff", "CAST(note_ord % 8 AS INT) AS slot", "CAST(pitch % 9 AS INT) AS kind", "CAST(pitch DIV 3 % 3 * 2 - 2 AS INT) AS step", "velocity")
    after = F.lead("kind").over(row)
    return slots.withColumn("arc", F.coalesce((F.col("kind") <= 4) & (F.col("velocity") % 2 == 0) & after.isin(0, 4), F.lit(False)))


def dealt(rows):
    """One row a score with ``rows`` in arrays, in order of their first columns, dealt over tasks: what its page is drawn from."""
    columns = [c for c in rows.columns if c != "score_id"]
    # A few rows become megabytes: the number of partitions is given, or they would be put together before they grow.
    # They are dealt by a hash of the key: dealt by the key itself, as they already are, they would stay in the few partitions they are in.
    spark = rows.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = rows.groupBy("score_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("r")).select("score_id", F.lit(0).alias("page"), *[F.col(f"r.{c}").alias(c) for c in columns])
    return whole.repartition(n, F.xxhash64("score_id"))


def _drawn(rgba: np.ndarray) -> list[tuple]:
    return [(rgba.shape[1], rgba.shape[0], rgba.tobytes())]


def drawn_pages(rows, draw):
    """One page a score, by a function from its rows to pixels."""
    return omr.by_page(dealt(rows), _drawn, PAGE, draw, most=1)


def pages(spark, sf):
    """One page a score."""
    return drawn_pages(drawn(spark, sf), draw)


def _symbols(spark, sf):
    slot = F.floor((F.col("x") - (FIRST - 25)) / WIDE).cast("int")
    return glyphs.symbols(dealt(drawn(spark, sf)), draw).withColumn("slot", slot)


@query("c12_symbols", d.with_sql("""SELECT score_id, CAST(staff AS INTEGER) AS staff, CAST(slot AS INTEGER) AS slot, sign AS kind, CAST(CASE WHEN sign IN ('solid', 'sharp', 'flat', 'natural') THEN step END AS INTEGER) AS step FROM (
 SELECT score_id, staff, slot, step, unnest(CASE kind WHEN 0 THEN ['solid'] WHEN 1 THEN ['solid', 'sharp'] WHEN 2 THEN ['solid', 'flat'] WHEN 3 THEN ['solid', 'natural'] WHEN 4 THEN ['solid', 'dot'] WHEN 5 THEN ['quarter_rest'] WHEN 6 THEN ['eighth_rest'] WHEN 7 THEN ['half_rest'] ELSE ['whole_rest'] END) AS sign FROM drawn
 UNION ALL SELECT DISTINCT score_id, staff, -1, 0, CASE WHEN score_id % 2 = 0 THEN 'treble' ELSE 'bass' END FROM drawn UNION ALL SELECT DISTINCT score_id, staff, 8, 0, 'barline' FROM drawn) u""", "notes").replace("\nSELECT score_id, CAST(staff", ",\n" + DRAWN_SQL + "\nSELECT score_id, CAST(staff"))
def c12_symbols(spark, sf):
    """Every symbol of a page with its place: heads, accidentals, dots, rests, clefs, barlines."""
    step = F.when(F.col("kind").isin("solid", "sharp", "flat", "natural"), F.col("step"))
    return _symbols(spark, sf).select("score_id", "staff", "slot", "kind", step.alias("step"))


@query("c13_ties", d.with_sql("SELECT score_id, CAST(staff AS INTEGER) AS staff, CAST(slot + 1 AS INTEGER) AS slot, CAST(after AS INTEGER) AS step FROM drawn WHERE arc AND after = step", "notes").replace("\nSELECT score_id, CAST(staff", ",\n" + DRAWN_SQL + "\nSELECT score_id, CAST(staff"))
def c13_ties(spark, sf):
    """Heads at the end of a tie; arcs between different places are slurs and tie nothing."""
    return _symbols(spark, sf).where("tied").select("score_id", "staff", "slot", "step")


@query("c11_systems_of_staves", d.with_sql("SELECT score_id, CAST(staff AS INTEGER) AS staff, CAST(staff // (score_id % 4 + 1) AS INTEGER) AS system, CAST(staff % (score_id % 4 + 1) AS INTEGER) AS part FROM (SELECT DISTINCT score_id, note_ord // 8 AS staff FROM notes) x", "notes"))
def c11_systems(spark, sf):
    """Staves joined into systems of one to four by the ink between them."""
    return glyphs.barlines(dealt(drawn(spark, sf)), draw).select("score_id", "staff", "system", "part")
