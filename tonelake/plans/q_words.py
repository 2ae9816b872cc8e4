"""Chord words on pages that are drawn from ``events``: eight places a staff with words, accents, marcatos, dots, stems, or nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import words
from . import derived as d
from .q_pages import dealt, drawn_pages, listed, painted
from .registry import query

LEFT, FIRST, WIDE = 40, 80, 70
TOP, STAFF = 70, 120
HIGH = 14
#: Strokes (x0, y0, x1, y1) of plain letters; each fills its width and height.
LETTERS = {
    "C": (10, [(0, 0, 10, 2), (0, 12, 10, 14), (0, 0, 2, 14)]),
    "A": (10, [(0, 0, 10, 2), (0, 0, 2, 14), (8, 0, 10, 14), (0, 7, 10, 9)]),
    "G": (10, [(0, 0, 10, 2), (0, 12, 10, 14), (0, 0, 2, 14), (8, 7, 10, 14)]),
    "D": (10, [(0, 0, 10, 2), (0, 12, 10, 14), (0, 0, 2, 14), (8, 0, 10, 14)]),
    "m": (12, [(0, 5, 12, 7), (0, 5, 2, 14), (5, 5, 7, 14), (10, 5, 12, 14)]),
    "7": (8, [(0, 0, 8, 2), (6, 0, 8, 14)]),
}
DRAWN = ("C", "Am", "G7", "Dm7")
#: Columns between the letters of a word.
GAP = 2


def draw(rows: pd.DataFrame | dict) -> np.ndarray:
    """Pixels of one score's page; ``rows``: staff, slot, kind (0 to 3 words, 4 accent, 5 marcato, 6 dot, 7 a stem from below), shift to the right, drop."""
    n, right = int(max(rows["staff"])) + 1, FIRST + WIDE * 8
    ink = np.zeros((TOP + STAFF * n, right + 40), bool)
    for s in range(n):
        for line in range(5):
            y = TOP + STAFF * s + 10 * line
            ink[y : y + 2, LEFT:right] = True
    for staff, slot, kind, shift, drop in listed(rows, "staff", "slot", "kind", "shift", "drop"):
        x, y = FIRST + WIDE * slot + shift, TOP + STAFF * staff - 40 + drop
        if kind < 4:
            for c in DRAWN[kind]:
                width, strokes = LETTERS[c]
                for x0, y0, x1, y1 in strokes:
                    ink[y + y0 : y + y1, x + x0 : x + x1] = True
                x += width + GAP
        elif kind in (4, 5):
            for k in range(14):
                a, b = k * 5 // 14, 11 - k * 5 // 14
                for e in (a, b - 1):
                    if kind == 4:
                        ink[y + e : y + e + 2, x + k] = True
                    else:
                        ink[y + 13 - k, x + e : x + e + 2] = True
        elif kind == 6:
            ink[y + 8 : y + 12, x : x + 4] = True
        else:
            ink[y : TOP + STAFF * staff + 20, x : x + 2] = True
    return painted(ink)


def drawn(spark, sf):
    return d.notes(spark, sf).selectExpr("score_id", "CAST(note_ord DIV 8 AS INT) AS staff", "CAST(note_ord % 8 AS INT) AS slot", "CAST(pitch % 8 AS INT) AS kind", "CAST(velocity % 23 AS INT) AS shift", "CAST(velocity % 4 AS INT) AS drop")


def pages(spark, sf):
    """One page a score."""
    return drawn_pages(drawn(spark, sf), draw)


@query("c14_word_boxes", d.with_sql("""SELECT score_id, CAST(staff AS INTEGER) AS staff, CAST(x AS INTEGER) AS x0, CAST(x + [10, 24, 20, 34][kind + 1] AS INTEGER) AS x1, CAST(y AS INTEGER) AS y0, CAST(y + 14 AS INTEGER) AS y1, CAST([1, 2, 2, 3][kind + 1] AS INTEGER) AS letters
FROM (SELECT score_id, note_ord // 8 AS staff, pitch % 8 AS kind, 80 + 70 * (note_ord % 8) + velocity % 23 AS x, 70 + 120 * (note_ord // 8) - 40 + velocity % 4 AS y FROM notes) p WHERE kind < 4""", "notes"))
def c14(spark, sf):
    """Boxes of all words and the letters in each; accents, marcatos, dots and stems are none."""
    return words.words(dealt(drawn(spark, sf)), draw).select("score_id", "staff", "x0", "x1", "y0", "y1", F.col("letters"))
