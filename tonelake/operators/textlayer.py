"""The text layer of a page: chord symbols, printed numbers, keys and tempos.

Items and systems are rows; an item meets the systems of its page whose band
it falls into.  Only the joining of runs that make up one symbol looks at a
band's items in order, and a band holds a few dozen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chord_names import over_distinct
from ..functions.marks import SYMBOL, TEMPO, exact_symbol, tempo_mark

# Glyphs of notation fonts that stand for characters.
GLYPHS = {"": "♭", "": "", "": "♯", "¨": "♭", "‹": "m", "Œ": "m", "„": "a", "ˆ": "d", "Š": "j"}
UNKNOWN = r"[\p{Cc}-�]"
_RUN = "score_id long, page int, system int, text string, x0 double, x1 double, y double, h double, font string"


def decoded(s: Column) -> Column:
    for glyph, to in GLYPHS.items():
        s = F.replace(s, F.lit(glyph), F.lit(to))
    return s


def runs(items: DataFrame) -> DataFrame:
    """Items with their horizontal extent and readable text."""
    return items.where("length(str) > 0").select("score_id", "page", "ord", decoded(F.col("str")).alias("text"), F.col("x").cast("double").alias("x0"), (F.col("x") + F.col("w")).cast("double").alias("x1"), F.col("y").cast("double").alias("y"), F.col("h").cast("double").alias("h"), "font")


def tokens(found: DataFrame) -> DataFrame:
    """Runs cut at white space, each part with its share of the width."""
    parts = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    n = F.greatest(F.lit(1), F.length("text"))
    rows = found.select("*", F.posexplode(parts).alias("k", "part"))
    # Where the k-th part starts: behind k parts and the gaps between them.
    lead = F.coalesce(F.length(F.regexp_substr("text", F.concat(F.lit(r"^\s*(?:\S+\s+){"), F.col("k").cast("string"), F.lit("}")))), F.lit(0))
    width = F.col("x1") - F.col("x0")
    left = F.col("x0") + width * lead / n
    return rows.select(*[c for c in found.columns if c not in ("text", "x0", "x1")], F.col("part").alias("text"), left.alias("x0"), (left + width * F.length("part") / n).alias("x1"))


def bands(found: DataFrame, systems: DataFrame) -> DataFrame:
    """Runs in the chord band above each system's first staff.

    ``systems`` has ``(score_id, page, system, left, right, top, bottom,
    staff_space, free_top)``; ``free_top`` is the lowest ink above it.
    """
    s = systems.select("score_id", "page", "system", F.col("left").alias("s_left"), F.col("right").alias("s_right"), F.col("top").alias("s_top"), F.col("bottom").alias("s_bottom"), F.col("staff_space").alias("ss"), F.greatest(F.coalesce("free_top", F.lit(float("-inf"))), F.col("top") - 6.5 * F.col("staff_space")).alias("band_top"))
    return found.join(s, ["score_id", "page"]).where("x1 >= s_left and x0 <= s_right")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one symbol joined; rows come band by band from left to right, and only the band at hand is held."""
    columns = ["score_id", "page", "system", "text", "x0", "x1", "y", "h", "font"]
    band, held, done = None, [], []
    for p in batches:
        for score, page, system, text, x0, x1, y, h, font, ss in zip(*(p[c].to_list() for c in (*columns, "ss"))):
            if (score, page, system) != band:
                done += held
                band, held = (score, page, system), []
            near = next((o for o in reversed(held) if -0.6 * ss <= x0 - o[5] <= 0.3 * ss and abs(y - o[6]) <= 0.7 * ss), None)
            if near is None:
                held.append([score, page, system, text, x0, x1, y, h, font])
            else:
                near[3:] = near[3] + text, near[4], max(near[5], x1), max(near[6], y), max(near[7], h), near[8] or font
        yield pd.DataFrame(done, columns=columns)
        done = []
    yield pd.DataFrame(held, columns=columns)


def chords(items: DataFrame, systems: DataFrame) -> DataFrame:
    """``(score_id, page, system, x, text, root, quality, bass)`` of the chord bands.

    Single capitals set larger than the symbols, or in another font, are
    rehearsal marks.
    """
    band = bands(tokens(runs(items)), systems).where("y >= band_top and y <= s_top + 0.5 * ss and h <= 3 * ss")
    key = ["score_id", "page", "system"]
    joined = band.repartition(*key).sortWithinPartitions(*key, "x0", "ord").mapInPandas(_merge, _RUN)
    read = over_distinct(joined, "text", exact_symbol, SYMBOL.replace("text string", "shown string")).where("text_x is not null")
    whole = Window.partitionBy("score_id", "page", "system")
    sizes = F.sort_array(F.collect_list(F.when(F.length("text") > 1, F.col("h"))).over(whole))
    usual = F.get(sizes, F.expr("size(sizes) div 2"))
    fonts = read.where("length(text) > 1 and font is not null").groupBy("score_id", "page", "system", "font").agg(F.count("*").alias("n"))
    main = fonts.groupBy("score_id", "page", "system").agg(F.max_by("font", F.struct("n", "font")).alias("main"))
    rows = read.withColumn("sizes", sizes).withColumn("usual", usual).join(main, ["score_id", "page", "system"], "left")
    mark = F.col("text").rlike("^[A-G]$") & (F.coalesce(F.col("h") >= 1.3 * F.col("usual"), F.lit(False)) | F.coalesce(F.col("font") != F.col("main"), F.lit(False)))
    return rows.where(~mark).select("score_id", "page", "system", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("text_x.shown").alias("text"), "text_x.root", "text_x.quality", "text_x.bass")


def numbers(items: DataFrame, systems: DataFrame) -> DataFrame:
    """Printed numbers below a system's last staff or above its first."""
    rows = bands(runs(items), systems).where(F.trim("text").rlike(r"^\d{1,3}$"))
    zone = F.when((F.col("y") > F.col("s_bottom")) & (F.col("y") <= F.col("s_bottom") + 4.5 * F.col("ss")), "below").when((F.col("y") >= F.col("band_top")) & (F.col("y") <= F.col("s_top") + 0.5 * F.col("ss")), "above")
    return rows.withColumn("zone", zone).where("zone is not null").select("score_id", "page", "system", F.col("x0").alias("x"), F.trim("text").cast("int").alias("n"), "zone")


def keys(items: DataFrame, systems: DataFrame) -> DataFrame:
    """``(score_id, page, system, fifths)`` from accidentals in a chain at the start of the staff."""
    near = bands(runs(items), systems).where(F.trim("text").rlike("^[♭♯]") & (F.length(F.trim("text")) <= 2))
    near = near.where("x0 >= s_left and y >= s_top - 1.5 * ss and y <= s_bottom + 2.5 * ss")
    order = Window.partitionBy("score_id", "page", "system").orderBy("x0", "ord")
    kind = F.substring(F.trim("text"), 1, 1)
    rows = near.withColumns({"kind": kind, "gap": F.col("x0") - F.lag("x0").over(order), "first": F.first(kind).over(order), "from": F.first("x0").over(order) - F.col("s_left")})
    broken = (F.col("kind") != F.col("first")) | (F.coalesce("gap", F.lit(0.0)) > 2.2 * F.col("ss"))
    rows = rows.withColumn("cut", F.sum(F.when(broken, 1).otherwise(0)).over(order)).where("cut = 0 and from <= 6.5 * ss")
    n = rows.groupBy("score_id", "page", "system").agg(F.count("*").alias("n"), F.first("first").alias("kind")).where("n <= 7")
    return n.select("score_id", "page", "system", F.when(F.col("kind") == "♭", -F.col("n")).otherwise(F.col("n")).cast("int").alias("fifths"))


def tempos(items: DataFrame, systems: DataFrame) -> DataFrame:
    """Tempo marks, each at the first system below it."""
    read = over_distinct(runs(items), "text", tempo_mark, TEMPO).where("text_x is not null")
    s = systems.select("score_id", "page", "system", F.col("top").alias("s_top"), F.col("staff_space").alias("ss"), F.col("left").alias("s_left"))
    rows = read.join(s, ["score_id", "page"]).where("s_top >= y - 0.5 * ss")
    first = Window.partitionBy("score_id", "page", "ord").orderBy("system")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1")
    x = F.when(F.col("y") >= F.col("s_top") - 6.5 * F.col("ss"), (F.col("x0") + F.col("x1")) / 2).otherwise(F.col("s_left") + 3.5 * F.col("ss"))
    return rows.select("score_id", "page", "system", x.alias("x"), F.col("text_x.bpm").alias("bpm"), F.col("text_x.unit").alias("unit"))


def cell_ticks(marks: DataFrame, cells: DataFrame) -> DataFrame:
    """Marks ``(…, x)`` in the barline cells of their system, on the nearest beat.

    ``cells`` has ``(score_id, page, system, x0, x1, measure, tick, length, beat_ticks)``.
    """
    c = cells.select("score_id", "page", "system", F.col("x0").alias("c0"), F.col("x1").alias("c1"), "measure", "tick", "length", "beat_ticks")
    rows = marks.join(c, ["score_id", "page", "system"]).where("x >= c0 and x < c1")
    part = (F.col("x") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    beats = F.floor(part * F.col("length") / F.col("beat_ticks") + 0.5)
    most = F.ceil(F.col("length") / F.col("beat_ticks")) - 1
    return rows.withColumn("at", F.col("tick") + F.greatest(F.lit(0), F.least(beats, most)) * F.col("beat_ticks")).drop("c0", "c1", "tick", "length", "beat_ticks")
