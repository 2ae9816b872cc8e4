"""Edits as projections and joins, library tables, undo history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MAX_FRET, STANDARD

HISTORY = 100


def fret_on(pitch: Column, string: Column, tuning=STANDARD, capo: int = 0, max_fret: int = MAX_FRET) -> Column:
    fret = pitch - F.get(F.array(*[F.lit(p) for p in tuning]), string)
    return F.when((fret >= capo) & (fret <= max_fret), fret)


def apply_patch(notes: DataFrame, patches: DataFrame, tuning=STANDARD, capo: int = 0) -> DataFrame:
    """Notes after user patches ``(score_id, note_ord, new_pitch, new_string, new_fret, new_start, new_duration)``.

    A new spot locks the note and, unless a pitch comes with it, sets the
    pitch.  A new pitch drops the spelling; without a new spot a locked note
    keeps its string where the pitch can be played on it, else it is freed.
    """
    rows = notes.join(patches, ["score_id", "note_ord"], "left")
    spot = F.col("new_string").isNotNull()
    open_ = F.get(F.array(*[F.lit(p) for p in tuning]), F.col("new_string"))
    pitch = F.coalesce("new_pitch", F.when(spot, open_ + F.col("new_fret")), "pitch")
    moved = pitch != F.col("pitch")
    fret = fret_on(pitch, F.col("string"), tuning, capo)
    kept = F.col("tab_locked") & F.col("string").isNotNull() & fret.isNotNull()
    return rows.select(
        "score_id", "note_ord", pitch.alias("pitch"),
        F.coalesce("new_start", "start_tick").alias("start_tick"), F.coalesce("new_duration", "duration").alias("duration"),
        F.when(spot, F.col("new_string")).when(moved & kept, F.col("string")).when(~moved, F.col("string")).alias("string"),
        F.when(spot, F.col("new_fret")).when(moved & kept, fret).when(~moved, F.col("fret")).alias("fret"),
        F.when(spot, True).when(moved, kept).otherwise(F.col("tab_locked")).alias("tab_locked"),
        (moved | spot & moved).alias("respelled"),
    )


def set_guitar(notes: DataFrame, tuning: tuple[int, ...]) -> DataFrame:
    """Frees locked notes whose spot no longer sounds their pitch."""
    wrong = F.col("tab_locked") & F.col("string").isNotNull() & ~(F.get(F.array(*[F.lit(p) for p in tuning]), F.col("string")) + F.col("fret")).eqNullSafe(F.col("pitch"))
    return notes.withColumns({c: F.when(~wrong, F.col(c)) for c in ("string", "fret")} | {"tab_locked": F.col("tab_locked") & ~wrong})


def transpose(notes: DataFrame, semitones: int) -> DataFrame:
    return notes.withColumn("pitch", F.greatest(F.lit(0), F.least(F.lit(127), F.col("pitch") + semitones)))


def delete(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(ids, keys, "left_anti")


def upsert(entries: DataFrame, saved: DataFrame) -> DataFrame:
    """Library summaries after ``saved``; creation time and, if none is given, thumbnail and preview stay."""
    a, b = entries.alias("a"), saved.alias("b")
    rows = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    new = F.col("b.id").isNotNull()
    return rows.select(
        F.coalesce("b.id", "a.id").alias("id"), F.when(new, F.col("b.name")).otherwise(F.col("a.name")).alias("name"),
        F.coalesce("a.created_at", "b.saved_at").alias("created_at"), F.coalesce("b.saved_at", "a.updated_at").alias("updated_at"),
        F.coalesce("b.thumbnail", "a.thumbnail").alias("thumbnail"), F.coalesce("b.preview", "a.preview").alias("preview"),
    )


def capped_history(versions: DataFrame, cap: int = HISTORY) -> DataFrame:
    """The latest ``cap`` versions ``(score_id, version)`` of each score."""
    latest = Window.partitionBy("score_id").orderBy(F.desc("version"))
    return versions.withColumn("age", F.row_number().over(latest)).where(F.col("age") <= cap).drop("age")


def debounced(edits: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Edits ``(score_id, at)`` that no other follows within ``seconds``: the ones that are saved."""
    later = F.lead("at").over(Window.partitionBy("score_id").orderBy("at", "edit"))
    gap = F.unix_micros(later) - F.unix_micros("at")
    return edits.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > int(seconds * 1e6))).drop("gap")
