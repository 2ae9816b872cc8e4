"""From printed symbols to notes: sounding pitches and the lengths that fill a bar.

Symbols are rows: heads with the line or space they stand on, accidentals and
ties; and a bar's chords and rests with the lengths their shapes say.  Pitches
are windows over those rows.  Lengths depend on a whole bar, so a bar is one
row, fitted on its own in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import floor, inf, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lengths in sixteenths that a bar may be filled with, what a repair may do to a length, how much surer
# than the next a repair must be, and the confidence of a rest.
UNITS = (1, 2, 3, 4, 6, 7, 8, 12, 14, 16, 24)
REPAIRS = (2.0, 0.5, 1.5, 2 / 3)
SURER = 0.04
REST = 0.9
LEAST_RATIO, MOST_RATIO = 0.48, 2.05
SHARPS, FLATS = (3, 0, 4, 1, 5, 2, 6), (6, 2, 5, 1, 4, 0, 3)  # letters from C in the order of a signature
SEMITONES = (0, 2, 4, 5, 7, 9, 11)


def _signature(letter: Column, fifths: Column) -> Column:
    """What a key does to a letter."""
    place = lambda order: F.array_position(F.array(*[F.lit(x) for x in order]), letter)
    return F.when(place(SHARPS) <= fifths, 1).when(place(FLATS) <= -fifths, -1).otherwise(0)


def resolve_pitches(heads: DataFrame) -> DataFrame:
    """Adds ``alter``, ``letter``, ``octave`` and ``pitch`` to heads.

    ``heads``: score_id, part, measure (counted over the score), x, head_ord,
    degree (7 x octave + letter from C), accidental (1, 0, -1 or null), tied
    (to the measure before), fifths.  An accidental holds on its degree until
    the barline.  A tied head without one takes what its degree last was in the
    measure before, over any number of barlines, and hands it to those after
    it; where that measure has no such head, the key decides.  Null ``tied``
    is no tie, null ``fifths`` no signature; equal x go by ``head_ord``.
    """
    line = ["score_id", "part", "degree"]
    in_bar = Window.partitionBy(*line, "measure").orderBy("x", "head_ord").rowsBetween(Window.unboundedPreceding, 0)
    letter = F.pmod(F.col("degree"), F.lit(7)).cast("int")
    seen = (
        heads.withColumn("_letter", letter)
        .withColumn("_key", _signature(F.col("_letter"), F.coalesce("fifths", F.lit(0))))
        .withColumn("_own", F.last("accidental", ignorenulls=True).over(in_bar).cast("int"))
        .withColumn("_held", F.max(F.coalesce("tied", F.lit(False))).over(in_bar))
    )
    # What a degree is at the end of a measure: set there, or handed on along a chain of ties to the next that sets it.
    at_end = F.struct("x", "head_ord")
    ends = seen.groupBy(*line, "measure").agg(*[F.max_by(c, at_end).alias(c) for c in ("_own", "_held", "_key")])
    by_measure = Window.partitionBy(*line).orderBy("measure")
    follows = F.coalesce(F.lag("measure").over(by_measure) == F.col("measure") - 1, F.lit(False))
    ends = ends.withColumn("_follows", follows).withColumn("_set", F.when(F.col("_own").isNotNull(), F.col("_own")).when(~(F.col("_held") & F.col("_follows")), F.col("_key")))
    ends = ends.withColumn("_end", F.last("_set", ignorenulls=True).over(by_measure.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select(*line, "measure", F.when(F.col("_follows"), F.lag("_end").over(by_measure)).alias("_carried"))
    alter = F.coalesce("_own", F.when(F.col("_held"), F.col("_carried")), "_key")
    octave = F.floor(F.col("degree") / 7).cast("int")
    semitone = F.element_at(F.array(*[F.lit(x) for x in SEMITONES]), F.col("_letter") + 1)
    sound = F.least(F.lit(127), F.greatest(F.lit(0), (octave + 1) * 12 + semitone + F.col("alter")))
    return (
        seen.join(ends, [*line, "measure"])
        .withColumn("alter", alter.cast("int"))
        .select(*heads.columns, "alter", F.col("_letter").alias("letter"), octave.alias("octave"), sound.cast("int").alias("pitch"))
    )


def _triplet(ticks: list[float], bar: int) -> range | None:
    """The first three equal lengths in a row that fill the bar as a triplet."""
    spare = sum(ticks) - bar
    return next((range(i, i + 3) for i in range(len(ticks) - 2) if len(set(ticks[i : i + 3])) == 1 and abs(spare - ticks[i]) <= 1), None)


def _repair(ticks: list[float], sure: list[float], bar: int, ppq: int) -> tuple[int, int] | None:
    """``(place, length)`` of the one length whose change fills the bar, if it is clearly the least sure of those that could."""
    gap = bar - sum(ticks)
    could = []
    for i, v in enumerate(ticks):
        for exact in (v * f for f in REPAIRS):
            new = floor(exact + 0.5)
            if abs(new - v - gap) <= 1 and abs(new - exact) <= 1 and new >= ppq / 4 and new % (ppq / 8) == 0:
                could.append((sure[i], len(could), i, new))
    could.sort()
    if not could or (len(could) > 1 and could[1][0] - could[0][0] < SURER):
        return None
    return could[0][2:]


@lru_cache(4096)
def _snap(units: tuple[float, ...], sure: tuple[float, ...], target: int) -> tuple[int, ...] | None:
    """Lengths out of ``UNITS`` that add up to ``target`` with the least change of ratios, sure lengths changing least."""
    reach: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for u, s in zip(units, sure):
        ahead: dict[int, tuple[float, tuple[int, ...]]] = {}
        for c in reversed(UNITS):  # of equal costs the one with the longer last length
            ratio = c / max(0.5, u)
            if LEAST_RATIO <= ratio <= MOST_RATIO:
                for total, (cost, taken) in reach.items():
                    now = cost + (0.2 + s) * abs(log(ratio))
                    if total + c <= target and now < ahead.get(total + c, (inf,))[0]:
                        ahead[total + c] = (now, (*taken, c))
        reach = ahead
    return reach[target][1] if units and target in reach else None


def fit_bar(ticks: list[int], sure: list[float], rest: list[bool], triplet: list[bool], bar: int, ppq: int = 480, short_ok: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """How a bar was read, and ``(start, length)`` of each of its events.

    Lengths that fill the bar stay (``fits``); so do bars of rests alone
    (``rests``) and bars that are short (``short``).  Else, in this order: three
    equal ones become a triplet (``triplet``), one length is halved, doubled,
    dotted or undotted (``repaired``), all are moved to lengths that fill the
    bar (``snapped``), or what crosses the barline is cut (``clipped``).
    Events marked as triplets take two thirds.  No event: ``rests``, no rows.
    """
    sixteenth, third = ppq // 4, ppq // 6
    now: list[float] = [floor(v * 2 / 3 + 0.5) if t else v for v, t in zip(ticks, triplet)]
    grid = [third if t else sixteenth for t in triplet]
    sure = [REST if r else s for r, s in zip(rest, sure)]
    total, how = sum(now), "fits"
    wrong = abs(total - bar) > 1 and total > 0
    if all(rest):
        wrong, how = False, "rests"
    elif wrong and any(triplet) and total < bar:
        wrong, how = False, "short"
    if wrong:
        if (three := _triplet(now, bar)) is not None:
            for i in three:
                now[i], grid[i] = now[i] * 2 / 3, third
            how = "triplet"
        elif not (short_ok and total < bar) and (change := _repair(now, sure, bar, ppq)) is not None:
            now[change[0]] = change[1]
            how = "repaired"
        elif total < bar:
            how = "short"
        else:
            free = [i for i, t in enumerate(triplet) if not t]
            left = (bar - sum(v for v, t in zip(now, triplet) if t)) / sixteenth
            new = _snap(tuple(now[i] / sixteenth for i in free), tuple(sure[i] for i in free), int(left)) if left == int(left) and left > 0 else None
            how = "clipped" if new is None else "snapped"
            for i, u in zip(free, new or ()):
                now[i] = u * sixteenth
    placed, at = [], 0
    for v, g in zip(now, grid):
        size = max(g, floor(v / g + 0.5) * g)
        start, length = at, size
        if wrong and at + size > bar:
            start = at if at < bar else max(0, bar - g)
            length = max(g, bar - start)
        placed.append((start, length))
        at += size
    return how, placed


FITTED = "score_id long, part int, measure long, event_ord int, start int, length int, how string"


def fit_bars(events: DataFrame, ppq: int = 480) -> DataFrame:
    """Start and length of every chord and rest of a bar, and how the bar was read.

    ``events``: score_id, part, measure, event_ord, ticks (as the shapes say),
    confidence, rest, whole_rest, triplet, bar (the measure's length), short_ok
    (a pickup or last bar).  A whole rest lasts the bar and counts only where it
    stands alone.  Null flags are false and a null confidence 0; events without
    ticks or bar are left out, as are whole rests beside others.  Events of a
    bar that share ``event_ord`` stand in the order of their other fields.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    event = F.struct("event_ord", F.col("ticks").cast("int").alias("ticks"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), flag("rest"), flag("whole_rest"), flag("triplet"))
    rows = events.where("ticks is not null and bar is not null")
    bars = rows.groupBy("score_id", "part", "measure").agg(F.sort_array(F.collect_list(event)).alias("events"), F.max("bar").cast("int").alias("bar"), F.max(F.coalesce("short_ok", F.lit(False))).alias("short_ok"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, part, measure, found, bar, short_ok in zip(b["score_id"], b["part"], b["measure"], b["events"], b["bar"], b["short_ok"]):
                found = list(found)
                if len(found) > 1:
                    found = [e for e in found if not e["whole_rest"]]
                column = lambda c: [e[c] for e in found]  # noqa: E731, B023
                rest = [e["rest"] or e["whole_rest"] for e in found]
                ticks = [bar if e["whole_rest"] else e["ticks"] for e in found]
                how, placed = fit_bar(ticks, column("confidence"), rest, column("triplet"), int(bar), ppq, bool(short_ok))
                out += [(sid, part, measure, e["event_ord"], start, length, how) for e, (start, length) in zip(found, placed)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FITTED.split(", ")])

    return bars.mapInPandas(run, FITTED)


# Meters a short piece may be given, by quarters a bar.
SIMPLE = ((2.0, 2, 4), (3.0, 3, 4), (4.0, 4, 4), (1.5, 3, 8), (4.5, 9, 8), (6.0, 12, 8))


def infer_meters(bars: DataFrame, systems: DataFrame, ppq: int = 480) -> DataFrame:
    """Meters that the bars of a system and those after it add up to, where they differ from the one in force.

    ``bars``: score_id, system, part, bar (from 0 in the system), ticks (null
    without notes), slashes (in a bar of slashes alone).  ``systems``: score_id,
    system (gapless), printed (shows a signature), nominal (ticks of the meter
    in force), unsigned (no signature to trust, so less proof will do).

    A system asks its own bars and, while fewer than three are at hand, up to
    three more systems without a printed signature.  The first bar of a score
    and the last of every part may be short and do not count.  Bars of slashes
    count a quarter a slash, where notes tell too little.  Returns score_id,
    system, numerator, denominator, bars (that agree), total, low_confidence.
    """
    key = ["score_id", "system"]
    last = systems.groupBy("score_id").agg(F.max("system").alias("_last"), F.min("system").alias("_first"))
    part = Window.partitionBy(*key, "part")
    ends = (F.col("system") == F.col("_last")) & (F.col("bar") == F.max("bar").over(part))
    slashes = F.col("ticks").isNull() & F.col("slashes").between(2, 7)
    counted = (
        bars.join(last, "score_id")
        .withColumn("_ends", ends)
        .withColumn("kind", F.when(slashes, 1).when(F.col("ticks").isNotNull() & ~F.col("_ends") & ~((F.col("system") == F.col("_first")) & (F.col("bar") == 0)), 0))
        .where("kind is not null")
        .select(*key, "kind", F.when(F.col("kind") == 1, F.col("slashes") * ppq).otherwise(F.col("ticks")).cast("long").alias("size"), F.struct("system", "part", "bar").alias("at"))
    )
    # Sizes are counted a system first, so a pool adds up a few rows and not its bars.
    sizes = counted.groupBy(*key, "kind", "size").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    held = sizes.groupBy(*key).agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("notes"), F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("marks"))
    member = systems.select(*key, F.coalesce("printed", F.lit(False)).alias("printed")).join(held, key, "left").fillna(0, ["notes", "marks"])
    member = member.withColumn("pool", F.explode(F.sequence(F.col("system") - 3, F.col("system"))))
    pool = Window.partitionBy("score_id", "pool").orderBy("system")
    before = lambda c: F.coalesce(F.sum(c).over(pool.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stopped = F.max(F.col("printed") & (F.col("system") > F.col("pool"))).over(pool.rowsBetween(Window.unboundedPreceding, 0))
    member = member.withColumn("_had", F.greatest(before("notes"), before("marks"))).withColumn("_stopped", stopped).where("_had < 3 and not _stopped").select(*key, "pool")

    seen = sizes.join(member, key).groupBy("score_id", "pool", "kind", "size").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    one = Window.partitionBy("score_id", "pool")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).over(one)
    seen = seen.withColumn("_use", F.when((of(0) < 3) & (of(1) >= 3), 1).otherwise(0)).where("kind = _use")
    rank = one.orderBy(F.desc("n"), "at")
    best = seen.withColumn("total", F.sum("n").over(one)).withColumn("_rival", F.coalesce(F.lead("n").over(rank), F.lit(0))).withColumn("_rank", F.row_number().over(rank)).where("_rank = 1")
    best = best.withColumnRenamed("pool", "system").join(systems.select(*key, "nominal", F.coalesce("unsigned", F.lit(False)).alias("unsigned")), key).where("size <> nominal")

    n, total, size = F.col("n"), F.col("total"), F.col("size")
    strong = (total >= 3) & (n >= 3) & (n >= 0.6 * total)
    clear = F.when(total < 3, (total == 2) & (n == 2)).otherwise(((total <= 4) & (n >= 2) & (n >= 0.6 * total)) | ((n >= 4) & (n >= 2 * F.col("_rival")) & (n >= 0.4 * total)))
    meter = lambda a, b: F.struct(a.cast("int").alias("numerator"), F.lit(b).alias("denominator"))
    quarters, eighths = F.expr(f"size div {ppq}"), F.expr(f"size div {ppq // 2}")
    whole = F.when((size % ppq == 0) & quarters.between(2, 7), meter(quarters, 4)).when((size % ppq != 0) | ~quarters.between(2, 7), F.when((size % (ppq // 2) == 0) & eighths.between(5, 13), meter(eighths, 8)))
    simple = F.coalesce(*[F.when(size == int(q * ppq), meter(F.lit(a), b)) for q, a, b in SIMPLE])
    found = best.withColumn("_meter", F.when(strong, whole).when(F.col("unsigned") & clear, simple)).where("_meter is not null")
    return found.select(*key, "_meter.numerator", "_meter.denominator", n.alias("bars"), "total", (~strong).alias("low_confidence"))
