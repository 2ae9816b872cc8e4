"""From systems of staves to a score: cells between barlines, and what a system hands on to the next.

What was read of every staff is rows.  Cells are laid out within a staff, and
the state that runs through a score (meter, key, clef, ties, time) is a scan
over systems.  Each system is a function of that state: it sets a value, keeps
it, or sets it unless the bars have that length already.  Such functions compose
to one of the same kind, "the last that sets", so a scan is one window over a
score's systems and no score is walked in Python.  The sounding pitches, the
lengths of a bar and the meters that bars add up to come from
:mod:`~tonelake.operators.assembly`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import assembly

STAFF = ["score_id", "system", "part"]
SYSTEM = ["score_id", "system"]
# Diatonic numbers of the middle line, and what a way of fitting a bar leaves of a note's confidence.
MIDDLE = {"treble": 34, "bass": 22}
LEFT = {"clipped": 0.6, "snapped": 0.7, "repaired": 0.7, "short": 0.8, "triplet": 0.8}
OVERRIDDEN = 0.7
#: A courtesy cell at a staff's end is at most so many staff spaces, or this share of the median bar, wide.
COURTESY_SPACES, COURTESY_SHARE = 9.0, 0.55

STAVES = "score_id long, page int, system int, part int, music_start double, right double, space double, clef string, clef_found boolean, lower boolean, octave_down boolean, fifths int, numerator int, denominator int, from_sign boolean, unreadable boolean"
BARLINES = "score_id long, system int, part int, x double"
EVENTS = "score_id long, system int, part int, event_ord int, x double, rest boolean, whole_rest boolean, ticks int, confidence double"
HEADS = "score_id long, system int, part int, event_ord int, head_ord int, x double, step int, accidental int, tied boolean, tie_out boolean, ticks int, confidence double"
SLASHES = "score_id long, system int, part int, x double"
RESTS = "score_id long, system int, part int, x0 double, x1 double, count int"
SIGNATURES = "score_id long, system int, part int, x0 double, x1 double, barline int, numerator int, denominator int, from_sign boolean, fifths int, unreadable boolean"
TUPLETS = "score_id long, system int, part int, x0 double, x1 double, n int"
LABELS = "score_id long, system int, x double, left double, text string, confidence double"


def _listed(**kinds: tuple[DataFrame, str, str, str | None]) -> DataFrame:
    """A staff's few marks of all kinds in one array, ``found``, each kind from left to right; a kind is ``(rows, left, right, number)``."""
    every = None
    for kind, (rows, x0, x1, n) in kinds.items():
        part = rows.where(f"{x0} is not null").select(*STAFF, F.lit(kind).alias("kind"), F.col(x0).cast("double").alias("x0"), F.col(x1).cast("double").alias("x1"), (F.col(n) if n else F.lit(None)).cast("int").alias("n"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*STAFF).agg(F.sort_array(F.collect_list(F.struct("kind", "x0", "x1", "n"))).alias("found"))


def _slot(bars: Column, x: Column) -> Column:
    """The cell of a place: how many barlines stand at it or before."""
    return F.size(F.filter(bars, lambda b: b["x0"] <= x))


@dataclass
class Cells:
    """``cells`` (one row a cell that is a bar), ``events`` (with ``bar`` and ``triplet``) and signature ``changes`` (with ``bar``)."""

    cells: DataFrame
    events: DataFrame
    changes: DataFrame


def lay_out(staves: DataFrame, barlines: DataFrame, events: DataFrame, slashes: DataFrame, rests: DataFrame, signatures: DataFrame, tuplets: DataFrame) -> Cells:
    """Bars of every staff from what stands between its barlines.

    A bar counts from 0 within its system.  A rest of many measures is as many
    bars, if nothing but one or two stray heads stands with it; two or more
    slashes without heads are a bar of slashes, whose events go; what follows
    the last barline is a bar only if something of music stands there and it is
    no courtesy signature.  Rests inside a signature are pieces of its glyphs.
    Staves without barlines are one cell; null places are left out; of several
    long rests in a cell the rightmost counts.
    """
    d = F.col("space")
    found = _listed(bars=(barlines, "x", "x", None), marks=(slashes, "x", "x", None), rests=(rests, "x0", "x1", "count"), signs=(signatures, "x0", "x1", "barline"), threes=(tuplets.where("n = 3"), "x0", "x1", None))
    staff = staves.select(*STAFF, "music_start", "right", "space").join(found, STAFF, "left")
    for kind in ("bars", "marks", "rests", "signs", "threes"):
        staff = staff.withColumn(kind, F.expr(f"coalesce(filter(found, f -> f.kind = '{kind}'), filter(array(named_struct('kind', '', 'x0', 0D, 'x1', 0D, 'n', 0)), f -> false))"))
    staff = written(staff.drop("found"))
    inside = lambda spans, edge: F.exists(spans, lambda s: (F.col("x") >= s["x0"] - edge * d) & (F.col("x") <= s["x1"] + edge * d))
    placed = events.where("x is not null").join(staff, STAFF).where(~(F.coalesce("rest", F.lit(False)) & inside(F.col("signs"), 0.5)))
    placed = written(placed.select(*events.columns, _slot(F.col("bars"), F.col("x")).alias("cell"), inside(F.col("threes"), 0.3).alias("triplet")))

    held = placed.groupBy(*STAFF, "cell").agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce("rest", F.lit(False)), 0).otherwise(1)).alias("heads"))
    n_bars = F.size("bars")
    cell = staff.withColumn("cell", F.explode(F.sequence(F.lit(0), n_bars))).join(held, [*STAFF, "cell"], "left").fillna(0, ["n", "heads"])
    in_cell = lambda items, x: F.filter(items, lambda i: _slot(F.col("bars"), x(i)) == F.col("cell"))
    cell = cell.withColumn("slashes", F.size(in_cell(F.col("marks"), lambda i: i["x0"])))
    cell = cell.withColumn("_long", F.transform(in_cell(F.col("rests"), lambda i: (i["x0"] + i["x1"]) / 2), lambda i: i["n"]))
    cell = cell.withColumn("long", F.get("_long", F.size("_long") - 1))
    at = lambda i: F.get("bars", i)["x0"]
    widths = F.sort_array(F.filter(F.transform("bars", lambda b, i: b["x0"] - F.get("bars", i - 1)["x0"]), lambda w: w.isNotNull()))
    median = F.coalesce(F.get(widths, F.floor((n_bars - 1) / 2).cast("int")), F.lit(0.0))
    closed = (n_bars > 0) & (at(n_bars - 1) >= F.col("right") - 2.5 * d)
    has_bar = (F.col("slashes") >= 2) | F.col("long").isNotNull()
    declared = F.exists("signs", lambda s: s["n"] >= n_bars - 1)
    narrow = F.col("right") - at(n_bars - 1) <= F.greatest(COURTESY_SPACES * d, COURTESY_SHARE * median)
    courtesy = (n_bars > 0) & ~has_bar & (((F.col("heads") == 0) & (declared | narrow)) | (declared & F.col("heads").between(1, 3) & narrow))
    last = F.col("cell") == n_bars
    cell = cell.where(~(last & F.coalesce(closed | ((F.col("n") == 0) & ~has_bar) | courtesy, F.lit(False))))

    slash = (F.col("slashes") >= 2) & (F.col("heads") == 0)
    stray = (F.col("n") <= 2) & (F.col("n") == F.col("heads"))
    before = Window.partitionBy(*STAFF).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell = (
        cell.withColumn("slash", slash)
        .withColumn("bars_here", F.when((F.col("long") > 1) & stray & ~slash, F.col("long")).otherwise(1))
        .withColumn("bar", F.coalesce(F.sum("bars_here").over(before), F.lit(0)).cast("int"))
        .withColumn("slash_count", F.when(slash & (F.col("n") == 0), F.col("slashes")).otherwise(0))
    )
    x0 = F.when(F.col("cell") == 0, F.col("music_start")).otherwise(at(F.col("cell") - 1))
    x1 = F.coalesce(at(F.col("cell")), "right")
    cells = written(cell.select(*STAFF, "cell", "bar", "bars_here", "slash", "slash_count", x0.alias("x0"), x1.alias("x1")))
    kept = placed.join(cells.where("not slash and bars_here = 1").select(*STAFF, "cell", "bar"), [*STAFF, "cell"]).drop("cell")
    whole = cells.groupBy(*STAFF).agg(F.sum("bars_here").cast("int").alias("length"))
    told = signatures.where("numerator is not null or fifths is not null or unreadable").withColumn("cell", F.col("barline") + 1)
    changes = told.join(cells.select(*STAFF, "cell", "bar"), [*STAFF, "cell"], "left").join(whole, STAFF, "left")
    changes = changes.select(*STAFF, F.coalesce("bar", "length", F.lit(0)).alias("bar"), "x0", "numerator", "denominator", "from_sign", "fifths", "unreadable")
    return Cells(cells, written(kept), written(changes))


def _first(condition: Column, value: Column, order: Column) -> Column:
    """Aggregate: ``value`` where ``condition`` holds first."""
    return F.min(F.when(condition, F.struct(order.alias("o"), value.alias("v")))).getField("v")


def _ticks(meter: Column, ppq: int) -> Column:
    return (meter["numerator"] * (4 * ppq) / meter["denominator"]).cast("int")


def _meter(numerator: Column, denominator: Column) -> Column:
    return F.when(numerator.isNotNull(), F.struct(numerator.cast("int").alias("numerator"), denominator.cast("int").alias("denominator")))


def system_rows(staves: DataFrame, laid: Cells) -> DataFrame:
    """One row a system: its printed signature, key as read, number of bars, and what its end announces to the next."""
    per = staves.groupBy(*SYSTEM).agg(
        F.min("page").alias("page"), _first(F.col("numerator").isNotNull(), F.struct("numerator", "denominator", F.coalesce("from_sign", F.lit(False)).alias("from_sign")), F.col("part")).alias("own"),
        F.max(F.coalesce("unreadable", F.lit(False))).alias("unreadable"), F.max(F.coalesce("clef_found", F.lit(False))).alias("clef_found"),
    )
    votes = staves.groupBy(*SYSTEM, F.coalesce("fifths", F.lit(0)).alias("fifths")).agg(F.count("*").alias("n"), F.min("part").alias("at"))
    read = votes.groupBy(*SYSTEM).agg(F.max_by("fifths", F.struct("n", -F.col("at"))).alias("read"))
    count = laid.cells.groupBy(*STAFF).agg(F.sum("bars_here").alias("n")).groupBy(*SYSTEM).agg(F.max("n").cast("int").alias("bars"))
    told = laid.changes.groupBy(*SYSTEM).agg(F.min("part").alias("part"))
    changes = laid.changes.join(told, STAFF).join(count, SYSTEM, "left").withColumn("late", F.col("bar") >= F.coalesce("bars", F.lit(0)))
    order = F.struct("bar", "x0")
    ends = changes.groupBy(*SYSTEM).agg(
        F.max("late").alias("late"), F.max(~F.col("late")).alias("within"), F.max(F.coalesce("unreadable", F.lit(False))).alias("blurred"),
        _first(F.col("late") & F.col("numerator").isNotNull(), F.struct("numerator", "denominator", F.coalesce("from_sign", F.lit(False)).alias("from_sign")), order).alias("next_meter"),
        _first(F.col("late") & F.col("fifths").isNotNull(), F.col("fifths"), order).alias("next_key"),
    )
    out = per.join(read, SYSTEM).join(count, SYSTEM, "left").join(ends, SYSTEM, "left")
    return out.fillna(False, ["late", "within", "blurred"]).withColumn("bars", F.coalesce("bars", F.lit(0))).withColumn("read", F.when(F.col("clef_found"), F.col("read")))


def keys(systems: DataFrame) -> DataFrame:
    """Adds ``key``: the signature a system starts in.

    A system without a clef has no key of its own and keeps the one before it.
    A key that differs from the one in force counts where the next system
    agrees, where a new piece starts (a printed meter), or where the system
    before announced it.
    """
    line = Window.partitionBy("score_id").orderBy("system")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = systems.withColumn("_n", F.row_number().over(line)).withColumn("_all", F.count("*").over(whole))
    rows = rows.withColumn("_key", F.coalesce(F.last("read", ignorenulls=True).over(upto), F.first("read", ignorenulls=True).over(whole), F.lit(0)))
    rows = rows.withColumn("_starts", (F.col("_n") > 1) & (F.col("own").isNotNull() | F.col("unreadable")))
    ahead, second = F.lead("_key").over(line), F.lead("_key", 2).over(line)
    outvoted = (F.col("_all") >= 3) & (F.col("_key") != ahead) & (ahead == second) & ~F.lead("_starts").over(line)
    sets = F.when(F.col("_n") == 1, F.when(outvoted, ahead).otherwise(F.col("_key"))).otherwise(F.coalesce(F.lag("next_key").over(line), F.when(F.col("_starts") | (ahead == F.col("_key")), F.col("_key"))))
    return rows.withColumn("_sets", sets).withColumn("key", F.last("_sets", ignorenulls=True).over(upto)).drop("_n", "_all", "_key", "_starts", "_sets")


def measures(systems: DataFrame, laid: Cells, candidates: DataFrame, ppq: int = 480) -> DataFrame:
    """One row a measure of the score: where it starts, its meter, its key, and what a system decided.

    ``systems`` from :func:`keys`, ``candidates`` from
    :func:`~tonelake.operators.assembly.infer_meters`.  A printed meter sets the
    one in force, as does one announced by the system before; bars that
    plainly disagree with printed digits override them.  Where none is printed,
    the meter that bars add up to is taken while no meter is known, where the one
    known was not read well, and where something announces a change; a guess
    from few bars only in the first system or after a badly read one.  A system
    without bars is one empty measure.
    """
    line = Window.partitionBy("score_id").orderBy("system")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    told = laid.changes.groupBy(*SYSTEM).agg(F.min("part").alias("part"))
    within = laid.changes.join(told, STAFF).where("bar > 0").groupBy(*SYSTEM, "bar").agg(
        F.max_by(_meter(F.col("numerator"), F.col("denominator")), F.when(F.col("numerator").isNotNull(), F.col("x0"))).alias("meter"), F.max_by("fifths", F.when(F.col("fifths").isNotNull(), F.col("x0"))).alias("set_key"),
    )
    within = within.join(systems.select(*SYSTEM, F.col("bars").alias("_bars")), SYSTEM).where("bar < _bars").drop("_bars")
    changed = within.where("meter is not null").select(*SYSTEM).distinct().withColumn("mid", F.lit(True))
    guess = candidates.select(*SYSTEM, _meter(F.col("numerator"), F.col("denominator")).alias("guess"), F.col("bars").alias("agree"), "total", "low_confidence")
    rows = systems.join(guess, SYSTEM, "left").join(changed, SYSTEM, "left").fillna(False, ["mid"])
    rows = rows.withColumn("_n", F.row_number().over(line)).withColumn("printed", F.coalesce("own", F.lag("next_meter").over(line)))
    has = F.col("printed").isNotNull()
    rows = rows.withColumn("_trust", F.when(has, F.col("printed.from_sign") | ~F.col("unreadable")))
    rows = rows.withColumn("_trusted", F.coalesce(F.last("_trust", ignorenulls=True).over(past), F.lit(True)))
    may = F.col("guess").isNotNull() & ~has & (~F.col("low_confidence") | (F.col("_n") == 1) | ~F.col("_trusted"))
    rows = rows.withColumn("_may", may).withColumn("_sets", has | F.col("mid") | (may & (_ticks(F.col("guess"), ppq) != 4 * ppq)))
    rows = rows.withColumn("_known", F.coalesce(F.max("_sets").over(past), F.lit(False)))
    event = F.coalesce(F.lag("late").over(line), F.lit(False)) | F.coalesce(F.lag("key").over(line) != F.col("key"), F.lit(False)) | F.col("unreadable") | F.col("within")
    digits = has & ~F.col("printed.from_sign") & ~((F.col("printed.numerator") == 4) & (F.col("printed.denominator") == 4))
    plain = _meter(F.col("printed.numerator"), F.col("printed.denominator"))
    over = digits & F.col("guess").isNotNull() & ~F.col("low_confidence") & (F.col("agree") >= 4) & (F.col("agree") >= 0.75 * F.col("total")) & (_ticks(F.col("guess"), ppq) != _ticks(plain, ppq))
    rows = rows.withColumn("overrides", F.coalesce(over, F.lit(False)))
    rows = rows.withColumn("_guessed", F.col("_may") & (~F.col("_known") | event | ~F.col("_trusted")))
    rows = rows.withColumn("_in_force", F.when(F.col("overrides"), F.col("guess")).when(has, plain).when(F.col("_guessed"), F.col("guess")))
    rows = rows.withColumn("overridden", F.coalesce(F.last(F.when(has, F.col("overrides")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))

    # All that sets a meter, in order.  A guess is nothing new where the bars have its length already, whichever meter that was.
    first = rows.where("_in_force is not null").select(*SYSTEM, F.lit(0).alias("bar"), F.col("_in_force").alias("meter"), (~has).alias("unless"))
    sets = first.unionByName(within.where("meter is not null").select(*SYSTEM, "bar", "meter", F.lit(False).alias("unless")))
    along = Window.partitionBy("score_id").orderBy("system", "bar")
    sets = sets.withColumn("_had", F.coalesce(F.lag(_ticks(F.col("meter"), ppq)).over(along), F.lit(4 * ppq))).where(~F.col("unless") | (F.col("_had") != _ticks(F.col("meter"), ppq)))
    sets = sets.withColumn("_earliest", F.row_number().over(along) == 1).select(*SYSTEM, "bar", F.col("meter").alias("set_meter"), "_earliest", F.col("unless").alias("inferred"))

    every = rows.select(*SYSTEM, "page", "key", "overridden", "overrides", "printed", "guess", "agree", "low_confidence", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bars"), F.lit(1)) - 1)).alias("bar"))
    every = every.join(sets, [*SYSTEM, "bar"], "left").join(within.select(*SYSTEM, "bar", "set_key"), [*SYSTEM, "bar"], "left")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    common = F.struct(F.lit(4).alias("numerator"), F.lit(4).alias("denominator"))
    every = every.withColumn("meter", F.coalesce(F.last("set_meter", ignorenulls=True).over(upto), common))
    every = every.withColumn("fifths", F.last(F.when(F.col("bar") == 0, F.col("key")).otherwise(F.col("set_key")), ignorenulls=True).over(upto)).withColumn("length", _ticks(F.col("meter"), ppq))
    every = every.withColumn("measure", (F.row_number().over(along) - 1).cast("long")).withColumn("start_tick", F.coalesce(F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = (F.col("measure") == 0) | (F.col("measure") == F.count("*").over(whole) - 1)
    return every.select(*SYSTEM, "page", "bar", "measure", "start_tick", "length", "meter.numerator", "meter.denominator", "fifths", "overridden", ends.alias("short_ok"),
        F.coalesce(F.col("_earliest"), F.lit(False)).alias("first_known"), F.coalesce(F.col("inferred") & (F.col("bar") == 0), F.lit(False)).alias("inferred"), (F.col("overrides") & (F.col("bar") == 0)).alias("overrides"), "printed", "agree", "low_confidence")


def signatures_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(time_signatures, key_signatures)`` of the rows of :func:`measures`: one row where a value changes, and at tick 0."""
    along = Window.partitionBy("score_id").orderBy("measure")
    same = lambda *cs: F.coalesce(F.struct(*cs) == F.lag(F.struct(*cs)).over(along), F.lit(False))
    times = rows.withColumn("_same", same("numerator", "denominator")).where(~F.col("_same") | F.col("first_known"))
    changes = rows.withColumn("_same", same("fifths")).where(~F.col("_same"))
    return times.select("score_id", F.col("start_tick").alias("tick"), "numerator", "denominator"), changes.select("score_id", F.col("start_tick").alias("tick"), "fifths")


def clefs(staves: DataFrame) -> DataFrame:
    """``(score_id, system, part, clef)``: the clef found, else the part's last one, else the one assumed; a lower staff of a grand staff keeps its own."""
    past = Window.partitionBy("score_id", "part").orderBy("system").rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(F.coalesce("clef_found", F.lit(False)), F.col("clef"))
    carried = F.when(~F.coalesce("lower", F.lit(False)), F.last(found, ignorenulls=True).over(past))
    return staves.select(*STAFF, F.coalesce(found, carried, "clef", F.lit("treble")).alias("clef"))


def octaves(staves: DataFrame, guitar: bool = False) -> DataFrame:
    """``(score_id, system, part, shift)``: semitones from written to sounding.

    A treble clef sounds an octave lower where at least half of its part's
    treble clefs show an 8, or everywhere in guitar music but beside a bass clef
    or in a grand staff.
    """
    read = F.coalesce("clef", F.lit("treble"))
    votes = staves.where(read == "treble").groupBy("score_id", "part").agg(F.avg(F.coalesce("octave_down", F.lit(False)).cast("int")).alias("eight"))
    now = clefs(staves).join(staves.select(*STAFF, F.coalesce("lower", F.lit(False)).alias("lower")), STAFF).join(votes, ["score_id", "part"], "left")
    system = Window.partitionBy(*SYSTEM)
    keyboard = F.max((F.col("clef") == "bass") | F.col("lower")).over(system)
    down = (F.col("eight") >= 0.5) & (F.col("eight") > 0) | (F.lit(guitar) & ~keyboard)
    return now.withColumn("_keyboard", keyboard).select(*STAFF, F.when((F.col("clef") == "treble") & down, -12).otherwise(0).alias("shift"))


def ties_over_lines(heads: DataFrame) -> DataFrame:
    """``(score_id, system, part, head_ord)`` of heads that end a tie which left the line before.

    ``heads`` with ``pitch``: the last head that starts such a tie in its
    system waits for the first onset of the part's next system, whose first head
    of that pitch or place takes it.  A part that is silent there ends the wait.
    """
    out = heads.where("tie_out").groupBy(*STAFF).agg(F.max_by(F.struct("pitch", "step"), F.struct("measure", "event_ord", "head_ord")).alias("open"))
    out = out.select("score_id", (F.col("system") + 1).alias("system"), "part", "open")
    first = heads.groupBy(*STAFF).agg(F.min(F.struct("measure", "event_ord")).alias("onset"))
    met = heads.join(first, STAFF).where(F.struct("measure", "event_ord") == F.col("onset")).join(out, STAFF).where((F.col("open.pitch") == F.col("pitch")) | (F.col("open.step") == F.col("step")))
    return met.groupBy(*STAFF).agg(F.min("head_ord").alias("head_ord"))


def place_chords(labels: DataFrame, staves: DataFrame, laid: Cells, rows: DataFrame, ppq: int = 480) -> DataFrame:
    """``(score_id, measure, tick, text, confidence)`` of printed chord words, on the nearest beat of their measure.

    The word's middle decides the cell, its left edge the place in it.  Over a
    rest of many measures the first word stands at its start and others are
    spread along it.  Of words on one tick the first of the highest confidence stays.
    """
    top = staves.groupBy(*SYSTEM).agg(F.min("part").alias("part"))
    spans = laid.cells.join(top, STAFF).join(staves.select(*STAFF, "space"), STAFF)
    lines = spans.groupBy(*SYSTEM).agg(F.sort_array(F.collect_list(F.struct("cell", "x0", "x1", "bar", "bars_here", "space"))).alias("cells"))
    place = F.greatest(F.lit(1), F.size(F.filter("cells", lambda c: (c["cell"] == 0) | (c["x0"] <= F.col("x")))))
    here = labels.where("x is not null").join(lines, SYSTEM).withColumn("c", F.element_at("cells", place))
    left = F.coalesce("left", F.col("x") - 0.25 * F.col("c.space") * F.length("text"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(0.999), (left - F.col("c.x0")) / F.greatest(F.lit(1.0), F.col("c.x1") - F.col("c.x0"))))
    nth = F.row_number().over(Window.partitionBy(*SYSTEM, "c.cell").orderBy("x", "left", "text"))
    here = here.withColumn("share", share).withColumn("nth", nth)
    long, step = F.col("c.bars_here") > 1, F.least(F.col("c.bars_here") - 1, F.floor(F.col("share") * F.col("c.bars_here")))
    here = here.withColumn("bar", (F.col("c.bar") + F.when(long & (F.col("nth") > 1), step).otherwise(0)).cast("int"))
    here = here.withColumn("part_of", F.when(long, F.when(F.col("nth") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("share") * F.col("c.bars_here") - step))).otherwise(F.col("share")))
    at = here.select(*SYSTEM, "bar", "x", "part_of", "text", "confidence").join(rows.select(*SYSTEM, "bar", "measure", "start_tick", "length", "denominator"), [*SYSTEM, "bar"])
    beat = F.least(F.lit(ppq), (4 * ppq / F.col("denominator")).cast("int"))
    beats = F.greatest(F.lit(1), F.floor(F.col("length") / beat + 0.5))
    tick = F.col("start_tick") + F.least(beats - 1, F.floor(F.col("part_of") * beats + 0.5)) * beat
    best = Window.partitionBy("score_id", "tick").orderBy(F.desc("confidence"), "x", "text")
    return at.withColumn("tick", tick.cast("long")).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("score_id", "measure", "tick", "text", "confidence")


@dataclass
class Score:
    notes: DataFrame
    measures: DataFrame
    time_signatures: DataFrame
    key_signatures: DataFrame
    slash_measures: DataFrame
    warnings: DataFrame


def bars_for_meters(laid: Cells) -> DataFrame:
    """What :func:`~tonelake.operators.assembly.infer_meters` asks of bars: the ticks in each, or its slashes."""
    size = F.when(F.col("triplet"), F.floor(F.col("ticks") * 2 / 3 + 0.5)).otherwise(F.col("ticks"))
    sums = laid.events.where("not coalesce(whole_rest, false)").groupBy(*STAFF, "bar").agg(F.sum(size).cast("int").alias("ticks"), F.max(~F.coalesce("rest", F.lit(False))).alias("sounds")).where("sounds").drop("sounds")
    slashes = laid.cells.where("slash_count > 0").select(*STAFF, "bar", F.col("slash_count").alias("slashes"))
    return sums.join(slashes, [*STAFF, "bar"], "full")


def assemble(staves: DataFrame, barlines: DataFrame, events: DataFrame, heads: DataFrame, slashes: DataFrame, rests: DataFrame, signatures: DataFrame, tuplets: DataFrame, ppq: int = 480, guitar: bool = False) -> Score:
    """A score from what was read of its systems (tables as ``STAVES``, ``BARLINES``, ... say).

    Systems are numbered over all pages of a score without gaps.  Notes come
    with measure, part, sounding pitch, tick, length, confidence and whether
    they continue a tie; warnings are rows of text in reading order.  A score
    without any events has its measures and a warning.
    """
    laid = lay_out(staves, barlines, events, slashes, rests, signatures, tuplets)
    systems = written(keys(system_rows(staves, laid)))
    asked = systems.select(*SYSTEM, F.col("own").isNotNull().alias("printed"), F.lit(-1).alias("nominal"), F.lit(True).alias("unsigned"))
    rows = written(measures(systems, laid, written(assembly.infer_meters(bars_for_meters(laid), asked, ppq)), ppq))

    place = rows.select(*SYSTEM, "bar", "measure", "start_tick", "length", "fifths", "short_ok", "overridden")
    placed = written(laid.events.join(place, [*SYSTEM, "bar"]))
    fitted = assembly.fit_bars(placed.select("score_id", "part", "measure", "event_ord", "ticks", "confidence", "rest", "whole_rest", "triplet", F.col("length").cast("int").alias("bar"), "short_ok"), ppq).select("score_id", "part", "measure", "event_ord", "start", F.col("length").alias("_fitted"), "how")
    fitted = written(fitted)
    middle = F.when(F.col("clef") == "bass", MIDDLE["bass"]).otherwise(MIDDLE["treble"])
    sounding = heads.join(placed.select(*STAFF, "event_ord", "measure", "start_tick", "length", "fifths", "overridden", F.col("ticks").alias("_ticks"), "triplet"), [*STAFF, "event_ord"]).join(clefs(staves), STAFF)
    sounding = assembly.resolve_pitches(sounding.withColumn("degree", middle + F.col("step")))
    sounding = written(sounding).join(octaves(staves, guitar), STAFF).withColumn("pitch", F.greatest(F.lit(0), F.least(F.lit(127), F.col("pitch") + F.col("shift"))))
    closing = ties_over_lines(sounding).withColumn("_closes", F.lit(True))
    notes = sounding.join(fitted, ["score_id", "part", "measure", "event_ord"]).join(closing, [*STAFF, "head_ord"], "left")
    grid = F.when(F.col("triplet"), ppq // 6).otherwise(ppq // 4)
    size = F.floor(F.coalesce("ticks", "_ticks") * F.col("_fitted") / F.greatest(F.col("_ticks"), F.lit(1)) / grid + 0.5) * grid
    duration = F.greatest(grid, F.least(size, F.greatest(grid, F.col("length") - F.col("start"))))
    left = F.coalesce(*[F.when(F.col("how") == k, v) for k, v in LEFT.items()], F.lit(1.0))
    sure = F.greatest(F.lit(0.05), F.least(F.when(F.col("overridden"), OVERRIDDEN).otherwise(1.0), F.coalesce("confidence", F.lit(0.0)) * left))
    notes = notes.select("score_id", "system", "part", "measure", "event_ord", "head_ord", "pitch", (F.col("start_tick") + F.col("start")).alias("start_tick"), duration.cast("long").alias("duration"), sure.alias("confidence"), (F.coalesce("tied", F.lit(False)) | F.coalesce("_closes", F.lit(False))).alias("tied"), "how")

    marked = laid.cells.where("slash").select(*SYSTEM, "bar").distinct()
    slashed = marked.join(place, [*SYSTEM, "bar"]).select("score_id", "measure", F.col("start_tick").alias("tick"), "length")
    times, key_rows = signatures_of(rows)
    return Score(notes, rows, times, key_rows, slashed, _warnings(staves, rows, systems, fitted, slashed, sounding, closing))


def _warnings(staves: DataFrame, rows: DataFrame, systems: DataFrame, fitted: DataFrame, slashed: DataFrame, heads: DataFrame, closing: DataFrame) -> DataFrame:
    """``(score_id, ord, text)``: what a reader should look at again; ``ord`` counts from 0."""
    page = lambda: (F.col("page") + 1).cast("string")
    meter = lambda: F.concat(F.col("numerator").cast("string"), F.lit("/"), F.col("denominator").cast("string"))
    line = lambda df, order, at, text: df.select("score_id", F.lit(order).alias("a"), at.cast("long").alias("b"), text.alias("text"))
    blurred = systems.where("unreadable or blurred").groupBy("score_id", "page").agg(F.min("system").alias("system"))
    first = rows.where("bar = 0")
    guess = F.concat(F.lit("Page "), page(), F.lit(": "), F.col("agree").cast("string"), F.when(F.col("low_confidence"), F.lit(" measures add up to ")).otherwise(F.lit(" consecutive measures add up to ")), meter(), F.when(F.col("low_confidence"), F.lit("; time signature guessed (low confidence).")).otherwise(F.lit("; time signature inferred.")))
    printed = F.concat(F.lit("Page "), page(), F.lit(": Printed time signature "), F.col("printed.numerator").cast("string"), F.lit("/"), F.col("printed.denominator").cast("string"), F.lit(" disagrees with bar lengths; using "), meter())
    missing = staves.where("not coalesce(clef_found, false)").groupBy("score_id", "page").agg(F.min("system").alias("system"))
    bars = fitted.select("score_id", "part", "measure", "how").distinct().groupBy("score_id", "how").count()
    count = F.col("n").cast("string")
    wrong = bars.where("how in ('triplet', 'repaired', 'snapped', 'clipped', 'short')").groupBy("score_id").agg(F.sum("count").alias("n"))
    clipped = bars.where("how = 'clipped'").select("score_id", F.col("count").alias("n"))
    marks = slashed.groupBy("score_id").agg(F.countDistinct("measure").alias("n"))
    opened = heads.where("tie_out").select(*STAFF).distinct().groupBy("score_id").agg(F.count("*").alias("opened"))
    closed = closing.groupBy("score_id").agg(F.count("*").alias("closed"))
    lost = opened.join(closed, "score_id", "left").withColumn("n", F.col("opened") - F.coalesce("closed", F.lit(0))).where("n > 0")
    none = systems.select("score_id").distinct().join(heads.select("score_id").distinct(), "score_id", "left_anti")
    said = [
        line(blurred, 0, F.col("system"), F.concat(F.lit("Page "), page(), F.lit(": a time signature could not be read; check the meter."))),
        line(first.where("inferred"), 0, F.col("system"), guess), line(first.where("overrides"), 0, F.col("system"), printed),
        line(missing, 0, F.col("system"), F.concat(F.lit("Page "), page(), F.lit(": no clef was found on at least one staff."))),
        line(wrong, 1, F.lit(0), F.concat(count, F.lit(" measure(s) did not add up to the time signature; durations were adjusted. Check rhythms."))),
        line(clipped, 2, F.lit(0), F.concat(count, F.lit(" measure(s) could not be fitted to the time signature and were clipped at the barline."))),
        line(marks, 3, F.lit(0), F.concat(count, F.lit(" chord-slash measure(s) were found; they have no notes."))),
        line(lost, 4, F.lit(0), F.concat(count, F.lit(" tie(s) running off the end of a line had no matching note at the start of the next line."))),
        line(none, 5, F.lit(0), F.lit("No notes were recognized. Try a cleaner, higher-resolution scan.")),
    ]
    out = said[0]
    for s in said[1:]:
        out = out.unionByName(s)
    return out.select("score_id", (F.row_number().over(Window.partitionBy("score_id").orderBy("a", "b", "text")) - 1).cast("int").alias("ord"), "text")
