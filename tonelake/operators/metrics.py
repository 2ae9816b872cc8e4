"""Accuracy of recognised scores against their truth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prf(matched: Column, truth: Column, found: Column) -> Column:
    """``struct<precision, recall, f1>``; two empty sides agree."""
    p = F.when(found > 0, matched / found).otherwise(F.when(truth == 0, 1.0).otherwise(0.0))
    r = F.when(truth > 0, matched / truth).otherwise(F.when(found == 0, 1.0).otherwise(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def candidates(truth: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """Pairs of equal pitch with onsets within ``tolerance``: an equi-join on pitch and tick bucket."""
    t = truth.select("score_id", "pitch", F.col("note_ord").alias("t"), F.col("start_tick").alias("t_start"), F.col("duration").alias("t_dur"))
    f = found.select("score_id", "pitch", F.col("note_ord").alias("f"), F.col("start_tick").alias("f_start"), F.col("duration").alias("f_dur"))
    width = max(1, tolerance)
    t = t.withColumn("b", F.explode(F.sequence(F.floor(F.col("t_start") / width) - 1, F.floor(F.col("t_start") / width) + 1)))
    f = f.withColumn("b", F.floor(F.col("f_start") / width))
    return t.join(f, ["score_id", "pitch", "b"]).withColumn("off", F.abs(F.col("t_start") - F.col("f_start"))).where(F.col("off") <= tolerance).drop("b")


def match_notes(truth: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """One-to-one matches ``(score_id, t, f, off)``, nearest onsets first.

    Greedy choice is sequential, but only notes of one pitch compete: a score's
    pitches are dealt over tasks, and what is kept in memory is one of them.
    """

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used_t, used_f = None, set(), set()
        for p in batches:
            keep = []
            for i, (score, pitch, t, f) in enumerate(zip(p["score_id"], p["pitch"], p["t"], p["f"])):
                if (score, pitch) != key:
                    key, used_t, used_f = (score, pitch), set(), set()
                if t not in used_t and f not in used_f:
                    used_t.add(t)
                    used_f.add(f)
                    keep.append(i)
            yield p.iloc[keep][["score_id", "t", "f", "off"]]

    dealt = candidates(truth, found, tolerance).select("score_id", "pitch", "off", "t", "f").repartition("score_id", "pitch")
    return dealt.sortWithinPartitions("score_id", "pitch", "off", "t", "f").mapInPandas(greedy, "score_id long, t long, f long, off long")


def best_offset(truth: DataFrame, found: DataFrame, bucket: int) -> DataFrame:
    """``(score_id, offset)``: the commonest bucketed onset difference of equal pitches, the smaller on ties."""
    pairs = truth.select("score_id", "pitch", F.col("start_tick").alias("a")).join(found.select("score_id", "pitch", F.col("start_tick").alias("b")), ["score_id", "pitch"])
    hist = pairs.groupBy("score_id", F.floor((F.col("a") - F.col("b")) / bucket + 0.5).alias("k")).agg(F.count("*").alias("n"))
    top = Window.partitionBy("score_id").orderBy(F.desc("n"), F.abs("k"), "k")
    return hist.withColumn("r", F.row_number().over(top)).where("r = 1").select("score_id", (F.col("k") * bucket).cast("long").alias("offset"))


def used_once(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset match: the k-th of equal items on one side meets the k-th on the other."""
    place = lambda o: F.row_number().over(Window.partitionBy(*keys).orderBy(o))
    a = truth.withColumn("k", place("ord"))
    b = found.withColumn("k", place("ord")).withColumnRenamed("ord", "found_ord")
    return a.join(b.select(*keys, "k", "found_ord"), [*keys, "k"]).drop("k")


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def unreliable_pages(labels: DataFrame, least: float = 0.75, few: int = 4) -> DataFrame:
    """Pages ``(score_id, page)`` whose share of confident labels is below ``least``; pages of fewer than ``few`` labels are judged together."""
    per = labels.groupBy("score_id", "page").agg(F.count("*").alias("n"), F.count_if("confident").alias("ok"))
    small = per.where(F.col("n") < few).groupBy("score_id").agg(F.sum("n").alias("all"), F.sum("ok").alias("good"))
    big = per.where((F.col("n") >= few) & (F.col("ok") < least * F.col("n"))).select("score_id", "page")
    pooled = per.where(F.col("n") < few).join(small, "score_id").where(F.col("good") < least * F.col("all")).select("score_id", "page")
    return big.unionByName(pooled)
