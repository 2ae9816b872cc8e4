"""Tab layout: widths, line breaks, positions; and following a source page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pixels.
COLUMN, LEAD, TRAIL, METER, LEAST = 34, 20, 12, 20, 96
SIDE, LABEL, LEAST_LINE = 10, 26, 240
LINE_GAP, TOP, ABOVE_STAFF, CHORD_ROW, DIAGRAM_ROW, STEMS, BELOW, BETWEEN = 16, 8, 12, 22, 92, 44, 6, 22
#: Least distance of two onsets, and how far the last line may be stretched.
ONSET_GAP, LAST_STRETCH = COLUMN * 0.8, 1.25


def widths(bars: DataFrame, notes: DataFrame) -> DataFrame:
    """``(score_id, index, width, show_meter, onsets)`` of each measure."""
    from .timeline import locate

    spots = locate(notes.select("score_id", F.col("start_tick").cast("double").alias("tick")).distinct(), bars).where("measure is not null")
    onsets = spots.groupBy("score_id", F.col("measure").alias("index")).agg(F.count("*").alias("onsets"))
    by_index = Window.partitionBy("score_id").orderBy("index")
    fresh = ~F.lag(F.struct("numerator", "denominator")).over(by_index).eqNullSafe(F.struct("numerator", "denominator"))
    rows = bars.withColumn("show_meter", fresh).join(onsets, ["score_id", "index"], "left").fillna(0, ["onsets"])
    width = F.greatest(F.lit(LEAST), F.col("onsets") * COLUMN + LEAD + TRAIL) + F.when(F.col("show_meter"), METER).otherwise(0)
    return rows.select("score_id", "index", "start_tick", "end_tick", "onsets", "show_meter", width.cast("long").alias("width"))


def lines(measured: DataFrame, available: int) -> DataFrame:
    """Adds ``line``: greedy breaking, an ordered fold over a score's measures (at most 10,001)."""
    items = F.sort_array(F.collect_list(F.struct("index", "width")))

    def step(acc: Column, x: Column) -> Column:
        breaks = (acc["sum"] > 0) & (acc["sum"] + x["width"] > available)
        line = F.when(breaks, acc["line"] + 1).otherwise(acc["line"])
        total = F.when(breaks, x["width"]).otherwise(acc["sum"] + x["width"])
        return F.struct(line.alias("line"), total.alias("sum"), F.concat(acc["out"], F.array(F.struct(x["index"].alias("index"), line.alias("line")))).alias("out"))

    zero = F.struct(F.lit(0).alias("line"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<index:bigint,line:int>>").alias("out"))
    placed = measured.groupBy("score_id").agg(items.alias("items")).select("score_id", F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias("x"))
    return measured.join(placed.select("score_id", "x.index", "x.line"), ["score_id", "index"])


def placed(bars: DataFrame, notes: DataFrame, width: int, strings: int = 6, chord_row: bool = True, diagrams: bool = False) -> DataFrame:
    """``(score_id, index, start_tick, end_tick, line, x, w, staff_top, points)`` of measures on a page ``width`` wide.

    Measures stretch to fill their line, the last line by a quarter at most.
    ``points`` are the ``(tick, x)`` of a measure's start, onsets and end,
    ascending in both; onsets keep a least distance, and a measure in which
    they need more room than it has grows and shifts those after it.
    """
    from .timeline import locate

    room = max(LEAST_LINE, width - 2 * SIDE - LABEL)
    rows = lines(widths(bars, notes), room)
    own = Window.partitionBy("score_id", "line")
    stretch = room / F.sum("width").over(own)
    final_line = F.col("line") == F.max("line").over(Window.partitionBy("score_id"))
    rows = rows.withColumn("lead", F.when(F.col("show_meter"), LEAD + METER).otherwise(LEAD).cast("double"))
    rows = rows.withColumn("w", F.col("width") * F.when(final_line, F.least(stretch, F.lit(LAST_STRETCH))).otherwise(stretch))

    ticks = notes.select("score_id", F.col("start_tick").cast("double").alias("tick")).distinct()
    spots = locate(ticks, bars).where("measure is not null").select("score_id", F.col("measure").alias("index"), "tick")
    in_order = Window.partitionBy("score_id", "index").orderBy("tick")
    spots = spots.join(rows, ["score_id", "index"]).withColumn("i", F.row_number().over(in_order))
    ideal = F.col("lead") + (F.col("tick") - F.col("start_tick")) / (F.col("end_tick") - F.col("start_tick")) * (F.col("w") - TRAIL - F.col("lead"))
    # An onset lies at its share of the measure, or so many gaps behind the onset that pushes it furthest.
    spots = spots.withColumn("dx", F.max(ideal - F.col("i") * ONSET_GAP).over(in_order) + F.col("i") * ONSET_GAP)
    onsets = spots.groupBy("score_id", "index").agg(F.max("dx").alias("reach"), F.sort_array(F.collect_list(F.struct("tick", "dx"))).alias("onsets_at"))

    rows = rows.join(onsets, ["score_id", "index"], "left").withColumn("reach", F.coalesce("reach", F.col("lead") - ONSET_GAP))
    rows = rows.withColumn("w", F.greatest("w", F.col("reach") + TRAIL))
    before = F.sum("w").over(own.orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("x", SIDE + LABEL + F.coalesce(before, F.lit(0.0)))
    none = F.array().cast("array<struct<tick:double,dx:double>>")
    at = lambda tick, dx: F.array(F.struct(tick.alias("tick"), dx.alias("dx")))
    opens = F.when(F.coalesce(F.get("onsets_at", F.lit(0))["tick"] > F.col("start_tick"), F.lit(True)), at(F.col("start_tick"), F.col("lead"))).otherwise(none)
    closes = at(F.col("end_tick"), F.greatest(F.col("w") - TRAIL, F.col("reach") + ONSET_GAP / 2))
    points = F.transform(F.concat(opens, F.coalesce("onsets_at", none), closes), lambda p: F.struct(p["tick"].alias("tick"), (F.col("x") + p["dx"]).alias("x")))

    rows_above = CHORD_ROW * chord_row + DIAGRAM_ROW * diagrams + ABOVE_STAFF
    height = rows_above + (strings - 1) * LINE_GAP + STEMS + BELOW
    top = (TOP + F.col("line") * (height + BETWEEN) + rows_above).cast("long")
    return rows.select("score_id", "index", "start_tick", "end_tick", "line", "x", "w", top.alias("staff_top"), points.alias("points"))


def note_positions(measured: DataFrame, notes: DataFrame) -> DataFrame:
    """``(score_id, note_ord, x, y)`` of fingered notes on the measures of :func:`placed`.

    Notes without a string, and those that no measure holds, give no row.
    """
    from .timeline import locate

    at = locate(notes.where("string is not null").select("score_id", "note_ord", "string", F.col("start_tick").cast("double").alias("tick")), measured)
    page = measured.select("score_id", F.col("index").alias("measure"), "staff_top", "points")
    y = F.col("staff_top") + F.col("string") * LINE_GAP
    return at.join(page, ["score_id", "measure"]).select("score_id", "note_ord", interpolate(F.col("points"), F.col("tick"), "tick", "x").alias("x"), y.alias("y"))


def click_tick(points: Column, x: Column, start: Column, end: Column, ppq: int = 480) -> Column:
    """Tick of a click at ``x`` in a measure: on the grid of sixteenths, inside the measure."""
    grid = ppq / 4
    return F.greatest(start, F.least(end - grid, F.floor(interpolate(points, x, "x", "tick") / grid + 0.5) * grid))


def interpolate(points: Column, at: Column, source: str, target: str) -> Column:
    """Piecewise-linear ``target`` at ``source`` along ``array<struct>``, flat beyond the ends."""
    after = F.filter(points, lambda p: p[source] >= at)
    before = F.filter(points, lambda p: p[source] < at)
    a, b = F.element_at(before, -1), F.get(after, 0)
    middle = F.when(b[source] == a[source], b[target]).otherwise(a[target] + (at - a[source]) / (b[source] - a[source]) * (b[target] - a[target]))
    return F.when(F.size(before) == 0, F.element_at(points, 1)[target]).when(F.size(after) == 0, F.element_at(points, -1)[target]).otherwise(middle)


def norm_box(box: Column, width: Column, height: Column) -> Column:
    """Boxes as fractions of the page; null where pixels have no page size."""
    inside = (box["x"] <= 1) & (box["y"] <= 1) & (box["w"] <= 1) & (box["h"] <= 1)
    scaled = F.struct((box["x"] / width).alias("x"), (box["y"] / height).alias("y"), (box["w"] / width).alias("w"), (box["h"] / height).alias("h"))
    plain = F.struct(*[box[c].cast("double").alias(c) for c in "xywh"])
    return F.when(inside, plain).when((width > 0) & (height > 0), scaled)


def lanes(groups: DataFrame) -> DataFrame:
    """Voices for overlapping notes of a measure, ``(score_id, measure, start, dur, ord)``.

    An ordered fold per measure: a note joins a lane whose last group it
    equals in time, else the first lane that is free, else a new one.
    """
    items = F.sort_array(F.collect_list(F.struct("start", (-F.col("dur")).alias("neg"), "ord")))

    def step(acc: Column, x: Column) -> Column:
        dur = -x["neg"]
        same = F.array_position(F.transform(acc["lanes"], lambda v: (v["start"] == x["start"]) & (v["dur"] == dur)), F.lit(True))
        free = F.array_position(F.transform(acc["lanes"], lambda v: v["start"] + v["dur"] <= x["start"]), F.lit(True))
        lane = F.when(same > 0, same).when(free > 0, free).otherwise(F.size(acc["lanes"]) + 1).cast("int")
        own = F.struct(x["start"].alias("start"), dur.alias("dur"))
        grown = F.when(lane > F.size(acc["lanes"]), F.concat(acc["lanes"], F.array(own))).otherwise(F.transform(acc["lanes"], lambda v, i: F.when(i + 1 == lane, own).otherwise(v)))
        return F.struct(grown.alias("lanes"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), lane.alias("lane")))).alias("out"))

    zero = F.struct(F.array().cast("array<struct<start:bigint,dur:bigint>>").alias("lanes"), F.array().cast("array<struct<ord:bigint,lane:int>>").alias("out"))
    rows = groups.groupBy("score_id", "measure").agg(items.alias("items"))
    return rows.select("score_id", "measure", F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias("x")).select("score_id", "measure", "x.ord", "x.lane")


def active_at(entries: DataFrame, points: DataFrame) -> DataFrame:
    """Entries ``(score_id, start, end, ...)`` that are active at ``(score_id, tick)``."""
    from .timeline import overlaps

    spans = entries.select("score_id", F.col("start").alias("start_tick"), (F.col("end") - F.col("start")).alias("duration"), F.struct(*[c for c in entries.columns if c != "score_id"]).alias("entry"))
    at = points.select("score_id", "tick", F.col("tick").cast("double").alias("w_start"), (F.col("tick") + 0.000001).alias("w_end"))
    return overlaps(spans, at).select("score_id", "tick", "entry.*")


def tick_at_point(boxes: DataFrame, clicks: DataFrame) -> DataFrame:
    """``(score_id, click, tick)`` of clicks ``(score_id, click, page, fx, fy)`` on a source page.

    ``boxes`` has ``(score_id, page, ord, start, x, y, w, h)`` of notes.  A
    click in a box is that note, the earliest of several; any other is the
    note nearest by x among those of the row nearest by y.  A click on a page
    without boxes gives no row.
    """
    rows = clicks.join(boxes, ["score_id", "page"])
    mid, dy = F.col("y") + F.col("h") / 2, F.abs(F.col("y") + F.col("h") / 2 - F.col("fy"))
    own = Window.partitionBy("score_id", "click")
    rows = rows.withColumn("row", F.min(F.struct(dy.alias("dy"), "start", "ord", mid.alias("mid"), "h")).over(own))
    inside = F.col("fx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("fy").between(F.col("y"), F.col("y") + F.col("h"))
    beside = F.abs(mid - F.col("row.mid")) <= F.greatest(F.col("row.h"), F.lit(0.02)) * 1.5
    hit = F.min(F.when(inside, F.struct("start", "ord")))["start"]
    near = F.min(F.when(beside, F.struct(F.abs(F.col("x") + F.col("w") / 2 - F.col("fx")).alias("dx"), "start", "ord")))["start"]
    return rows.groupBy("score_id", "click").agg(F.coalesce(hit, near).alias("tick"))
