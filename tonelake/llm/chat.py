"""Chat formatting: one rendering of a dialogue for each of its participants.

In the rendering for a participant that speaker is the assistant, all others
are users under their own names, and system turns stay system turns.  The mask
holds the character spans the assistant wrote, the only ones to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
END = "<|end|>\n"


def _safe(text: Column) -> Column:
    """Markers inside a text or a name are broken up, so they can't be forged."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def numbered(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, part, n, speaker, text)``: turns in order, in bounded parts.

    Turns are ordered by turn, role and text.  Positions are counted in ranges
    of 64 turn numbers and added up over ranges, so that a conversation with a
    large share of all rows is spread over many tasks.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / 64).cast("long"))
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    rows = rows.withColumn("at", F.row_number().over(inside))
    rows = rows.join(sizes, rows["conv_id"].eqNullSafe(sizes["c"]) & (rows["range"] == sizes["r"]))
    n = F.col("before") + F.col("at") - 1
    return rows.select("conv_id", F.floor(n / part_turns).cast("long").alias("part"), n.alias("n"), "speaker", "text")


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part of ``part_turns`` turns.

    ``(conv_id, participant, part, n_turns, text, n_chars, mask, target_chars)``;
    ``mask`` is the spans of the participant's own words with their end mark,
    ``start:end`` joined by commas, counted in characters of ``text``.
    Participants are the distinct speakers other than ``system`` of the whole
    conversation; one without any has no rows.  Null roles speak as
    ``unknown``, null texts are empty, null turns come first, and rows of a
    null ``conv_id`` are one conversation.
    """
    rows = numbered(turns, part_turns)
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("n", "speaker", "text"))).alias("turns"))
    who = turns.select(F.col("conv_id").alias("c"), F.coalesce("role", F.lit("unknown")).alias("participant")).where("participant <> 'system'").distinct()
    rows = parts.join(who, parts["conv_id"].eqNullSafe(who["c"]))

    def head(t: Column) -> Column:
        other = F.concat(F.lit("<|user name="), _safe(t["speaker"]), F.lit("|>\n"))
        return F.when(t["speaker"] == "system", "<|system|>\n").when(t["speaker"] == F.col("participant"), "<|assistant|>\n").otherwise(other)

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_safe(t["text"]), F.lit(END)).alias("body"), (t["speaker"] == F.col("participant")).alias("own")))
    rows = rows.select("conv_id", "participant", "part", pieces.alias("pieces"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        span = F.concat_ws(":", start.cast("string"), stop.cast("string"))
        return F.struct(
            stop.alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            (acc["own"] + F.when(p["own"], stop - start).otherwise(0)).alias("own"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("own"))
    rows = rows.withColumn("mask", F.aggregate("pieces", zero, step))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return rows.select(
        "conv_id", "participant", "part", F.size("pieces").cast("long").alias("n_turns"), text.alias("text"),
        F.col("mask.at").cast("long").alias("n_chars"), F.array_join("mask.spans", ",").alias("mask"), F.col("mask.own").cast("long").alias("target_chars"),
    )
