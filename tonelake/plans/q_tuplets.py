"""Tuplets on pages that are drawn from ``events``: nine heads a staff in groups of three, with brackets, digits and things that look like them."""

from __future__ import annotations

from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import assembly, tuplets
from . import derived as d
from .q_pages import SPACE, _put, dealt, drawn_pages, head, listed, painted
from .registry import query

LEFT, FIRST, WIDE, BETWEEN = 40, 110, 34, 24
TOP, STAFF = 110, 170
#: Groups, by kind: bracket and 3, beam and 3, hooked line without a digit, bracket and 5, beam, whole bracket with a 3 beyond it over a beam, beam under an arc.
TRIPLETS, BEAMED = (0, 1, 5), (1, 4, 5, 6)


@cache
def drawing(n: int, space: float) -> np.ndarray:
    """A digit's drawing, made once a worker."""
    return tuplets.drawn_digit(n, space)


def draw(rows: pd.DataFrame | dict) -> np.ndarray:
    """Pixels of one score's page; ``rows``: note_ord, step, kind, whole (a group of three), up, slope, the last four the same in a group."""
    items = sorted(listed(rows, "note_ord", "step", "kind", "whole", "up", "slope"), key=lambda r: r[0])
    n = items[-1][0] // 9 + 1
    right = FIRST + WIDE * 9 + BETWEEN * 3
    ink = np.zeros((TOP + STAFF * n + 40, right + 40), bool)
    for s in range(n):
        top = TOP + STAFF * s
        for line in range(5):
            ink[top + SPACE * line : top + SPACE * line + 2, LEFT:right] = True
        ink[top : top + 4 * SPACE + 2, right - 2 : right] = True
    for group, part in groupby(items, key=lambda r: r[0] // 3):
        part = list(part)
        _, _, kind, whole, up, slope = part[0]
        middle = TOP + STAFF * (group // 3) + 2 * SPACE + 0.5
        side = -1 if up else 1
        beam = bool(whole) and kind in BEAMED
        xs = [FIRST + WIDE * (r[0] % 9) + BETWEEN * (r[0] % 9 // 3) for r in part]
        stem = [x + 5 if up else x - 6 for x in xs]
        for x, sx, r in zip(xs, stem, part):
            y = middle - r[1] * SPACE / 2
            ink[int(y) - 8 : int(y) + 9, x - 9 : x + 10] |= head(y - int(y))
            end = middle + side * 45 if beam else y + side * 35
            a, b = sorted((y, end))
            ink[int(a) : int(b) + 1, sx : sx + 2] = True
        if beam:
            a, b = sorted((middle + side * 45, middle + side * 40))
            ink[int(a) : int(b), stem[0] : stem[-1] + 2] = True
        if not whole:
            continue
        kind, x0, x1 = int(kind), xs[0] - 8, xs[-1] + 8
        centre, at = (x0 + x1) / 2, middle + side * 64
        if kind in (0, 2, 3, 5):
            columns = np.arange(x0, x1 + 1)
            rows_at = np.rint(at + slope * (columns - centre)).astype(int)
            shown = slice(None) if kind in (2, 5) else np.abs(columns - centre) > 10
            for i in range(2):
                ink[rows_at[shown] + i, columns[shown]] = True
            for x in (x0, x0 + 1, x1 - 1, x1):
                y = int(rows_at[x - x0])
                a, b = sorted((y, y - side * 8))
                ink[a : b + 2, x] = True
        if kind in (0, 3):
            _put(ink, drawing(3 if kind == 0 else 5, SPACE), centre, at)
        elif kind == 5:
            _put(ink, drawing(3, SPACE), centre, at + side * 13)
        elif kind == 1:
            _put(ink, drawing(3, SPACE), (stem[0] + stem[-1] + 1) / 2, middle + side * 58)
        elif kind == 6:
            t = np.linspace(0, 1, 300)
            px, py = x0 + t * (x1 - x0), middle + side * (54 + 28 * t * (1 - t))
            for i in range(4):
                ink[py.astype(int) + i // 2, px.astype(int) + i % 2] = True
    return painted(ink)


DRAWN_SQL = """marked AS (SELECT score_id, note_ord, note_ord // 9 AS staff, CAST(pitch // 3 % 3 * 2 - 2 AS INTEGER) AS step,
 max(CASE WHEN note_ord % 3 = 0 THEN pitch % 7 END) OVER g AS kind, count(*) OVER g = 3 AS whole FROM notes WINDOW g AS (PARTITION BY score_id, note_ord // 3)),
lengths AS (SELECT *, CASE WHEN whole AND kind IN (1, 4, 5, 6) THEN 240 ELSE 480 END * CASE WHEN whole AND kind IN (0, 1, 5) THEN 2 ELSE 3 END // 3 AS ticks FROM marked)"""


def _sql(body: str) -> str:
    return d.with_sql("\x00", "notes").replace("\n\x00", ",\n" + DRAWN_SQL + "\n" + body)


def drawn(spark, sf) -> DataFrame:
    group = Window.partitionBy("score_id", F.expr("note_ord DIV 3"))
    first = lambda e: F.max(F.when(F.col("note_ord") % 3 == 0, F.expr(e))).over(group)
    return d.notes(spark, sf).select(
        "score_id", "note_ord", F.expr("CAST(pitch DIV 3 % 3 * 2 - 2 AS INT)").alias("step"), first("pitch % 7").alias("kind"),
        (F.count("*").over(group) == 3).alias("whole"), first("velocity % 2 = 0").alias("up"), first("(velocity % 5 - 2) * 0.03D").alias("slope"),
    )


def pages(spark, sf) -> DataFrame:
    """One page a score."""
    return drawn_pages(drawn(spark, sf), draw)


@query("c31_tuplets", _sql("""SELECT score_id, CAST(staff AS INTEGER) AS staff, CAST(note_ord % 9 AS INTEGER) AS head, step, whole AND kind IN (1, 4, 5, 6) AS beamed,
 CAST(CASE WHEN whole AND kind IN (0, 1, 5) THEN 3 WHEN whole AND kind = 3 THEN 5 END AS INTEGER) AS number, CASE WHEN whole AND kind IN (0, 3, 5) THEN 'bracket' WHEN whole AND kind = 1 THEN 'bare' END AS mark FROM marked"""))
def c31(spark, sf):
    """Every head of every page: beamed or not, and the number and kind of mark of its tuplet."""
    return tuplets.tuplets(dealt(drawn(spark, sf)), draw).select("score_id", "staff", "head", "step", "beamed", "number", "mark")


@query("c31_tuplets_fit_bars", _sql("""SELECT score_id, CAST(staff AS BIGINT) AS measure, CAST(note_ord % 9 AS INTEGER) AS event_ord,
 CAST(sum(ticks) OVER (PARTITION BY score_id, staff ORDER BY note_ord) - ticks AS INTEGER) AS start, CAST(ticks AS INTEGER) AS length, 'fits' AS how FROM lengths"""))
def c31_bars(spark, sf):
    """Bars filled with the flags that were read: a staff is a bar, as long as what was drawn on it; a triplet takes two thirds."""
    kind = F.col("kind")
    quarter = F.when(F.col("whole") & kind.isin(*BEAMED), 240).otherwise(480)
    true = F.when(F.col("whole") & kind.isin(*TRIPLETS), quarter * 2 / 3).otherwise(quarter).cast("int")
    bars = drawn(spark, sf).groupBy("score_id", F.expr("note_ord DIV 9").alias("measure")).agg(F.sum(true).cast("int").alias("bar"))
    read = tuplets.tuplets(dealt(drawn(spark, sf)), draw).select(
        "score_id", F.lit(0).alias("part"), F.col("staff").cast("long").alias("measure"), F.col("head").alias("event_ord"), F.when(F.col("beamed"), 240).otherwise(480).alias("ticks"),
        F.lit(0.9).alias("confidence"), F.lit(False).alias("rest"), F.lit(False).alias("whole_rest"), F.coalesce(F.col("number") == 3, F.lit(False)).alias("triplet"), F.lit(False).alias("short_ok"),
    )
    return assembly.fit_bars(read.join(bars, ["score_id", "measure"])).select("score_id", "measure", "event_ord", "start", "length", "how")
