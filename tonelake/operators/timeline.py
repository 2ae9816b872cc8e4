"""The timeline: change points, measures, windows, and joins on ticks.

Change points are sparse, so a score's list travels with its rows as an
array; lookups in it need one hash join by ``score_id`` and no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULT_PPQ

#: Where :func:`measures` stops if nothing else is said; queries do not stop.
MAX_MEASURES = 10_001
#: Measures of a run that are made at once, so no array grows with a score's length.
CHUNK = 4096


def change_lists(changes: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``(score_id, name)``: each score's change points in list order."""
    items = F.sort_array(F.collect_list(F.struct("ord", "tick", *columns)))
    return changes.groupBy("score_id").agg(items.alias(name))


def as_of(items: Column, tick: Column) -> Column:
    """The last item in list order at or before ``tick``, else the first, else null."""
    before = F.filter(items, lambda x: x["tick"] <= tick)
    return F.when(F.size(before) > 0, F.element_at(before, -1)).when(F.size(items) > 0, F.element_at(items, 1))


def score_lengths(notes: DataFrame) -> DataFrame:
    return notes.groupBy("score_id").agg(F.coalesce(F.max(F.col("start_tick") + F.col("duration")), F.lit(0)).cast("long").alias("length"))


def pulse(ppq: Column, denominator: Column) -> Column:
    return F.least(ppq.cast("double"), ppq * 4 / denominator)


def measure_ticks(ppq: Column, numerator: Column, denominator: Column) -> Column:
    return ppq * 4 * numerator / denominator


def measures(lengths: DataFrame, time_signatures: DataFrame, ppq: int = DEFAULT_PPQ, most: int | None = MAX_MEASURES) -> DataFrame:
    """``(score_id, index, start_tick, end_tick, numerator, denominator)``; at most ``most`` a score, all of them if None.

    A signature takes effect at the first measure that starts at or after it.
    Between two changes measures are a regular grid, so the fold runs over the
    changes and the grid is a sequence.  A score of no length has one measure.
    """
    lists = change_lists(time_signatures, ["numerator", "denominator"], "items")
    plain = F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).cast("long").alias("tick"), F.lit(4).alias("numerator"), F.lit(4).alias("denominator")))
    rows = lengths.select("score_id", F.greatest(F.col("length"), F.lit(1)).cast("double").alias("total")).join(lists, "score_id", "left")
    shaped = F.transform(F.coalesce("items", plain), lambda x: F.struct(x["tick"].cast("double").alias("tick"), x["numerator"].cast("int").alias("numerator"), x["denominator"].cast("int").alias("denominator")))
    rows = rows.withColumn("items", shaped)
    # An item that a later one in the list covers from its own tick on never counts.
    live = F.filter("items", lambda x, i: ~F.exists(F.slice(F.col("items"), i + 2, F.size("items")), lambda y: y["tick"] <= x["tick"]))
    rows = rows.withColumn("first", as_of(F.col("items"), F.lit(0.0))).withColumn("later", F.filter(live, lambda x: x["tick"] > 0))

    def state(at: Column, index: Column, sig: Column, runs: Column) -> Column:
        return F.struct(at.alias("at"), index.alias("index"), sig.alias("sig"), runs.alias("runs"))

    def run(s: Column, count: Column) -> Column:
        return F.struct(s["at"].alias("at"), s["index"].alias("index"), count.alias("count"), s["sig"]["numerator"].alias("numerator"), s["sig"]["denominator"].alias("denominator"))

    def size(sig: Column) -> Column:
        return F.lit(float(ppq * 4)) * sig["numerator"] / sig["denominator"]

    def step(s: Column, x: Column) -> Column:
        count = F.ceil((x["tick"] - s["at"]) / size(s["sig"])).cast("long")
        grown = F.concat(s["runs"], F.array(run(s, count)))
        return F.when(count <= 0, state(s["at"], s["index"], x, s["runs"])).otherwise(state(s["at"] + count * size(s["sig"]), s["index"] + count, x, grown))

    none = F.array().cast("array<struct<at:double,index:bigint,count:bigint,numerator:int,denominator:int>>")
    start = state(F.lit(0.0), F.lit(0).cast("long"), F.col("first"), none)
    done = F.aggregate("later", start, step)
    rows = rows.withColumn("fold", done)
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - F.col("fold.at")) / size(F.col("fold.sig")))).cast("long")
    runs = F.concat(F.col("fold.runs"), F.array(run(F.col("fold"), last)))
    rows = rows.select("score_id", "total", F.explode(runs).alias("r")).select("score_id", "total", "r.*").where("count > 0 and at < total")
    length = F.lit(float(ppq * 4)) * F.col("numerator") / F.col("denominator")
    shown = F.least(F.col("count"), F.ceil((F.col("total") - F.col("at")) / length).cast("long"), *([] if most is None else [F.lit(most) - F.col("index")]))
    rows = rows.select("score_id", "index", "at", "numerator", "denominator", length.alias("len"), (shown - 1).alias("last")).where("last >= 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(CHUNK).cast("long"))).alias("begin"))
    rows = rows.select("*", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + (CHUNK - 1), F.col("last")))).alias("i"))
    return rows.select(
        "score_id", (F.col("index") + F.col("i")).cast("long").alias("index"),
        (F.col("at") + F.col("i") * F.col("len")).alias("start_tick"), (F.col("at") + (F.col("i") + 1) * F.col("len")).alias("end_tick"),
        "numerator", "denominator",
    )


def windows(bars: DataFrame, resolution: str = "beat", ppq: int = DEFAULT_PPQ) -> DataFrame:
    """``(score_id, measure, w, w_start, w_end)``: tumbling windows of each measure.

    ``beat`` is one pulse, ``half`` half a measure, ``measure`` all of it; a
    measure's last window is cut off at its end.
    """
    length = F.col("end_tick") - F.col("start_tick")
    step = {"beat": pulse(F.lit(ppq), F.col("denominator")), "half": length / 2, "measure": length}[resolution]
    step = F.when(step <= 0, length).otherwise(step)
    rows = bars.select("score_id", F.col("index").alias("measure"), "start_tick", "end_tick", step.alias("step"))
    count = F.ceil((F.col("end_tick") - 1e-6 - F.col("start_tick")) / F.col("step")).cast("long")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0)))).alias("w"))
    start = F.col("start_tick") + F.col("w") * F.col("step")
    return rows.select("score_id", "measure", "w", start.alias("w_start"), F.least(start + F.col("step"), F.col("end_tick")).alias("w_end"))


def overlaps(notes: DataFrame, spans: DataFrame, start: str = "w_start", end: str = "w_end", bucket: int = 7680) -> DataFrame:
    """Notes joined with the spans they sound in, with ``ov`` ticks in common.

    Both sides go to the tick buckets they touch, so the join is an equi-join
    on score and bucket; a pair is kept in the first bucket both touch.  Notes
    count for at least one tick.
    """
    stop = F.col("start_tick") + F.greatest(F.col("duration"), F.lit(1))
    touch = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    left = notes.withColumn("note_end", stop).withColumn("bucket", touch(F.col("start_tick"), F.col("note_end") - 1))
    right = spans.withColumn("bucket", touch(F.col(start), F.greatest(F.col(end) - 1e-6, F.col(start))))
    common = F.least(F.col("note_end").cast("double"), F.col(end)) - F.greatest(F.col("start_tick").cast("double"), F.col(start))
    joined = left.join(right, ["score_id", "bucket"]).withColumn("ov", common).where("ov > 0")
    first = F.greatest(F.floor(F.col("start_tick") / bucket), F.floor(F.col(start) / bucket))
    return joined.where(F.col("bucket") == first).drop("bucket")


def locate(points: DataFrame, bars: DataFrame, tick: str = "tick", bucket: int = 7680) -> DataFrame:
    """Adds ``measure`` and ``measure_start`` of the measure that holds ``tick``; null if none."""
    a = points.withColumn("_b", F.floor(F.col(tick) / bucket))
    touched = F.explode(F.sequence(F.floor(F.col("start_tick") / bucket), F.floor((F.col("end_tick") - 1e-6) / bucket)))
    b = bars.select(F.col("score_id").alias("_s"), F.col("index").alias("measure"), F.col("start_tick").alias("measure_start"), F.col("end_tick").alias("measure_end"), touched.alias("_c"))
    inside = (F.col("score_id") == F.col("_s")) & (F.col("_b") == F.col("_c")) & (F.col(tick) >= F.col("measure_start")) & (F.col(tick) < F.col("measure_end"))
    return a.join(b, inside, "left").drop("_s", "_b", "_c")


def seconds_at(tempos: Column, tick: Column, ppq: Column) -> Column:
    """Seconds up to ``tick``: tempos by tick, none counted before the first; 120 bpm if none."""
    ordered = F.sort_array(F.transform(tempos, lambda x: F.struct(x["tick"].cast("double").alias("tick"), x["ord"].alias("ord"), x["bpm"].alias("bpm"))))

    n = F.size(ordered)
    indexed = F.transform(ordered, lambda x, i: F.struct(x["tick"].alias("tick"), x["bpm"].alias("bpm"), F.when(i + 1 < n, F.get(ordered, i + 1)["tick"]).alias("next")))
    upto = lambda x: F.when(x["next"].isNotNull() & (x["next"] < tick), x["next"]).otherwise(tick)
    total = F.aggregate(indexed, F.lit(0.0), lambda a, x: a + F.when((x["tick"] < tick) & (upto(x) > x["tick"]), (upto(x) - x["tick"]) / ppq * (60.0 / x["bpm"])).otherwise(0.0))
    return F.when(tempos.isNull() | (F.size(tempos) == 0), tick / ppq * 0.5).otherwise(total)


def ticks_at(tempos: Column, seconds: Column, ppq: Column) -> Column:
    """The inverse of :func:`seconds_at`; time before the first tempo stands at its tick."""
    ordered = F.sort_array(F.transform(tempos, lambda x: F.struct(x["tick"].cast("double").alias("tick"), x["ord"].alias("ord"), x["bpm"].alias("bpm"))))
    marked = F.transform(ordered, lambda x: F.struct(x["tick"].alias("tick"), x["bpm"].alias("bpm"), seconds_at(tempos, x["tick"], ppq).alias("sec")))
    before = F.filter(marked, lambda x: x["sec"] <= seconds)
    base = F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.element_at(marked, 1))
    return F.when(tempos.isNull() | (F.size(tempos) == 0), seconds * 2.0 * ppq).when(seconds <= 0, F.lit(0.0)).otherwise(base["tick"] + (seconds - base["sec"]) * base["bpm"] / 60.0 * ppq)
