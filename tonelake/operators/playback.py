"""Playback event tables: sounding notes, strummed chords, metronome clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chord_names import SHAPED, over_distinct, shape
from ..functions.theory import gain
from ..model import DEFAULT_PPQ, STANDARD
from . import timeline as tl

# Fixed values.
STRING_GAP = 0.015
VOICE = 0.85
LIGHT = 0.7
EVENT = ["score_id", "t", "dur", "pitch", "gain", "kind"]


def sounding(notes: DataFrame, slack: int = 2) -> DataFrame:
    """Tied notes joined: a chain of ties is an island of one pitch.

    A tied note goes on from the note of its pitch that was struck last, if
    that one's chain ended no earlier than ``slack`` ticks before.  Ends only
    count from the last note that is not tied on: within such a run starts
    ascend, so what was too early for one note is too early for all after it,
    and the running end decides as the chain's own would.
    """
    by_pitch = Window.partitionBy("score_id", "pitch").orderBy("start_tick", "note_ord")
    tied = F.coalesce("tied_from_previous", F.lit(False))
    rows = notes.withColumn("struck", F.count_if(~tied).over(by_pitch))
    before = Window.partitionBy("score_id", "pitch", "struck").orderBy("start_tick", "note_ord").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start_tick") + F.col("duration")
    rows = rows.withColumn("fresh", F.when(tied & (F.max(end).over(before) >= F.col("start_tick") - slack), 0).otherwise(1))
    rows = rows.withColumn("chain", F.sum("fresh").over(by_pitch))
    return rows.groupBy("score_id", "pitch", "chain").agg(F.min("start_tick").alias("start_tick"), F.max(end).alias("end_tick"), F.min_by("velocity", F.struct("start_tick", "note_ord")).alias("velocity")).drop("chain")


def _seconds(rows: DataFrame, tempos: DataFrame, ppq: int) -> tuple[DataFrame, callable]:
    rows = rows.join(tl.change_lists(tempos, ["bpm"], "tempos"), "score_id", "left")
    return rows, lambda c: tl.seconds_at(F.col("tempos"), c.cast("double"), F.lit(float(ppq)))


def note_events(notes: DataFrame, tempos: DataFrame, ppq: int = DEFAULT_PPQ) -> DataFrame:
    rows, at = _seconds(sounding(notes), tempos, ppq)
    t = at(F.col("start_tick"))
    return rows.select("score_id", t.alias("t"), (at(F.col("end_tick")) - t).alias("dur"), F.col("pitch").cast("int"), gain(F.col("velocity")).alias("gain"), F.lit("note").alias("kind"))


def clicks(ends: DataFrame, time_signatures: DataFrame | None, tempos: DataFrame, ppq: int = DEFAULT_PPQ) -> DataFrame:
    """A click a pulse from tick 0 up to ``ends (score_id, end_tick)`` and with it.

    A pulse is of the signature in force at the click before, so a change
    between two clicks counts from the next on.  Accents are counted in whole
    measures from the signature's own tick.  Without signatures it is 4/4.
    """
    rows = ends.select("score_id", F.col("end_tick").cast("double").alias("limit"))
    plain = F.array(F.struct(F.lit(0.0).alias("tick"), F.lit(4).alias("numerator"), F.lit(4).alias("denominator")))
    if time_signatures is None:
        rows = rows.withColumn("items", plain)
    else:
        rows = rows.join(tl.change_lists(time_signatures, ["numerator", "denominator"], "items"), "score_id", "left")
        shaped = F.transform("items", lambda x: F.struct(x["tick"].cast("double").alias("tick"), x["numerator"].cast("int").alias("numerator"), x["denominator"].cast("int").alias("denominator")))
        rows = rows.withColumn("items", F.coalesce(shaped, plain))
    # An item that a later one in the list covers from its own tick on never counts.
    live = F.filter("items", lambda x, i: ~F.exists(F.slice(F.col("items"), i + 2, F.size("items")), lambda y: y["tick"] <= x["tick"]))
    rows = rows.withColumn("first", tl.as_of(F.col("items"), F.lit(0.0))).withColumn("later", F.filter(live, lambda x: (x["tick"] > 0) & (x["tick"] <= F.col("limit"))))

    def step_of(sig: Column) -> Column:
        return tl.pulse(F.lit(ppq), sig["denominator"])

    def run(s: Column, count: Column) -> Column:
        return F.struct(s["at"].alias("at"), count.alias("count"), step_of(s["sig"]).alias("step"), s["sig"].alias("sig"))

    def step(s: Column, x: Column) -> Column:
        count = F.greatest(F.lit(0).cast("long"), F.ceil((x["tick"] - s["at"]) / step_of(s["sig"])).cast("long"))
        return F.struct((s["at"] + count * step_of(s["sig"])).alias("at"), x.alias("sig"), F.concat(s["runs"], F.array(run(s, count))).alias("runs"))

    none = F.array().cast("array<struct<at:double,count:bigint,step:double,sig:struct<tick:double,numerator:int,denominator:int>>>")
    rows = rows.withColumn("fold", F.aggregate("later", F.struct(F.lit(0.0).alias("at"), F.col("first").alias("sig"), none.alias("runs")), step))
    last = F.floor((F.col("limit") - F.col("fold.at")) / step_of(F.col("fold.sig"))).cast("long") + 1
    rows = rows.select("score_id", F.explode(F.concat("fold.runs", F.array(run(F.col("fold"), last)))).alias("r")).where("r.count > 0")
    rows = rows.select("score_id", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r.count") - 1)).alias("k"))
    rows = rows.withColumn("tick", F.col("r.at") + F.col("k") * F.col("r.step"))
    whole = (F.col("tick") - F.col("r.sig.tick")) % (ppq * 4.0 * F.col("r.sig.numerator") / F.col("r.sig.denominator")) == 0
    rows, at = _seconds(rows.select("score_id", "tick", whole.alias("whole")), tempos, ppq)
    return rows.select("score_id", at(F.col("tick")).alias("t"), F.lit(0.02).alias("dur"), F.lit(0).alias("pitch"), F.lit(1.0).alias("gain"), F.when(F.col("whole"), "accent").otherwise("click").alias("kind"))


def strums(notes: DataFrame, bars: DataFrame, chords: DataFrame, slash: DataFrame | None = None, ppq: int = DEFAULT_PPQ, chord_gain: float = 0.45) -> DataFrame:
    """``(score_id, tick, name, gain, stop)``: when and how loud a chord is strummed.

    Measures with notes get a light pattern, on their first beat and on
    changes; empty ones and those in ``slash`` get every beat, the first
    accented.  ``stop`` is the next strum or the chord's end.
    """
    beats = tl.windows(bars, "beat", ppq).withColumn("tick", F.col("w_start"))
    spans = chords.select("score_id", F.col("tick").alias("start_tick"), (F.col("duration") - 1).alias("duration"), "name")
    shifted = beats.select("score_id", "measure", "w", "tick", (F.col("tick") + 1).alias("at"), (F.col("tick") + 1.000001).alias("until"))
    active = tl.overlaps(spans.withColumn("duration", F.col("duration") + 1), shifted, "at", "until")
    active = active.groupBy("score_id", "measure", "w", "tick").agg(F.max(F.struct("start_tick", "name", "note_end")).alias("c"))
    melody = tl.overlaps(notes.select("score_id", "start_tick", F.lit(1).alias("duration")), bars.select("score_id", F.col("index").alias("measure"), F.col("start_tick").alias("w_start"), F.col("end_tick").alias("w_end")))
    melody = melody.where("start_tick >= w_start").select("score_id", "measure").distinct().withColumn("light", F.lit(True))
    rows = beats.select("score_id", "measure", "w", "tick").join(active, ["score_id", "measure", "w", "tick"], "left").join(melody, ["score_id", "measure"], "left")
    if slash is not None:
        rows = rows.join(slash.select("score_id", "measure").distinct().withColumn("slash", F.lit(True)), ["score_id", "measure"], "left")
    else:
        rows = rows.withColumn("slash", F.lit(None).cast("boolean"))
    light = F.coalesce(F.col("light"), F.lit(False)) & ~F.coalesce(F.col("slash"), F.lit(False))
    changed = ~F.lag("c").over(Window.partitionBy("score_id", "measure").orderBy("w")).eqNullSafe(F.col("c"))
    rows = rows.withColumn("hit", F.col("c").isNotNull() & (~light | (F.col("w") == 0) | changed)).withColumn("soft", light).where("hit")
    level = F.lit(chord_gain) * F.when(F.col("w") == 0, 1.0).otherwise(0.85) * F.when(F.col("soft"), LIGHT).otherwise(1.0)
    after = F.lead("tick").over(Window.partitionBy("score_id").orderBy("tick"))
    return rows.select("score_id", "tick", F.col("c.name").alias("name"), level.alias("gain"), F.least(F.coalesce(after, F.col("c.note_end").cast("double")), F.col("c.note_end").cast("double")).alias("stop")).where("stop > tick")


def chord_events(strummed: DataFrame, tempos: DataFrame, tuning: tuple[int, ...] = STANDARD, ppq: int = DEFAULT_PPQ) -> DataFrame:
    """The strings of each strum, low to high, a gap apart and rising in gain."""
    rows = over_distinct(strummed, "name", shape(tuning), SHAPED).where("name_x is not null")
    rows, at = _seconds(rows.withColumnRenamed("tick", "struck"), tempos, ppq)
    t = at(F.col("struck"))
    rows = rows.withColumns({"t0": t, "len": at(F.col("stop")) - t})
    rows = rows.select("score_id", "t0", "len", "gain", F.size("name_x.pitches").alias("n"), F.posexplode("name_x.pitches").alias("k", "pitch"))
    off: Column = F.col("k") * STRING_GAP
    ramp = F.when(F.col("n") > 1, 0.8 + 0.2 * F.col("k") / (F.col("n") - 1)).otherwise(1.0)
    return rows.select("score_id", (F.col("t0") + off).alias("t"), F.greatest(F.lit(0.05), F.col("len") - off).alias("dur"), "pitch", (F.col("gain") * ramp * VOICE).alias("gain"), F.lit("chord").alias("kind"))


def play_events(notes: DataFrame, bars: DataFrame, tempos: DataFrame, chords: DataFrame | None = None, metronome: bool = False, time_signatures: DataFrame | None = None, ppq: int = DEFAULT_PPQ) -> DataFrame:
    """All events of a score, ``(score_id, t, dur, pitch, gain, kind)``; the metronome clicks up to the last note's or strum's end."""
    out = note_events(notes, tempos, ppq)
    ends = bars.select("score_id", F.lit(0.0).alias("end_tick")).unionByName(notes.select("score_id", (F.col("start_tick") + F.col("duration")).cast("double").alias("end_tick")))
    if chords is not None:
        strummed = strums(notes, bars, chords, ppq=ppq)
        out = out.unionByName(chord_events(strummed, tempos, ppq=ppq))
        heard = over_distinct(strummed, "name", shape(STANDARD), SHAPED).where("name_x is not null")
        ends = ends.unionByName(heard.select("score_id", F.col("stop").cast("double").alias("end_tick")))
    if metronome:
        out = out.unionByName(clicks(ends.groupBy("score_id").agg(F.max("end_tick").alias("end_tick")), time_signatures, tempos, ppq))
    return out.select(*EVENT)
