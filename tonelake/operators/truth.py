"""Ground truth from MusicXML, and a recognised piece's score against it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.notation import KINDS, plain_quality, root_pc
from ..sources.musicxml import sanitized, xml_text
from ..sources.score import rounded
from . import metrics as mt

MEASURE = "index int, start_tick long, length long, fifths int, numerator int, denominator int, slash boolean, chords array<struct<root:string,quality:string,bass:string>>"


def _number(el: ET.Element | None, path: str, default: float = 0.0) -> float:
    found = el.find(path) if el is not None else None
    try:
        return float((found.text or "").strip()) if found is not None else default
    except ValueError:
        return default


def _named(el: ET.Element | None, kind: str) -> str | None:
    step = el.findtext(f"{kind}-step") if el is not None else None
    if not step:
        return None
    alter = rounded(_number(el, f"{kind}-alter"))
    return step.strip() + ("#" * alter if alter > 0 else "b" * -alter)


def _harmony(el: ET.Element) -> dict | None:
    root = _named(el.find("root"), "root")
    if root is None:
        return None
    kind = el.find("kind")
    shown = kind.get("text") if kind is not None else None
    plain = (kind.text or "").strip() if kind is not None else ""
    return {"root": root, "quality": KINDS.get(plain, plain) if shown is None else shown, "bass": _named(el.find("bass"), "bass")}


def measures(xml: str | bytes, ppq: int = 480) -> list[dict]:
    """Key, meter, chords, slash marks and length of each measure of the first part."""
    text = sanitized(xml_text(xml) if isinstance(xml, bytes) else xml)
    root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text).encode("utf-8"), ET.XMLParser(encoding="utf-8"))
    out, divisions, beats, kind, fifths, start, slashing = [], 1.0, 4, 4, 0, 0, False
    part = root.find("part")
    for i, m in enumerate(part.findall("measure") if part is not None else []):
        at = reach = 0.0
        slash, chords = slashing, []
        for el in m:
            if el.tag == "attributes":
                divisions = _number(el, "divisions") or divisions
                if el.findtext("time/beats") and _number(el, "time/beat-type"):
                    beats, kind = sum(int(x) for x in re.findall(r"\d+", el.findtext("time/beats"))) or 4, int(_number(el, "time/beat-type"))
                fifths = int(_number(el, "key/fifths", fifths))
                style = el.find("measure-style/slash")
                if style is not None and style.get("type") in ("start", "stop"):
                    slashing, slash = style.get("type") == "start", True
            elif el.tag == "harmony":
                chords += [h for h in [_harmony(el)] if h]
            elif el.tag == "backup":
                at = max(0.0, at - _number(el, "duration"))
            elif el.tag == "forward" or (el.tag == "note" and el.find("grace") is None):
                if el.find("chord") is None:
                    at += _number(el, "duration")
                    reach = max(reach, at)
                slash |= (el.findtext("notehead") or "").strip() == "slash"
        nominal = rounded(divisions * 4 * beats / kind)
        length = rounded((nominal if m.get("implicit") != "yes" and reach < nominal else reach) * ppq / divisions)
        out.append({"index": i, "start_tick": start, "length": length, "fifths": fifths, "numerator": beats, "denominator": kind, "slash": slash, "chords": chords})
        start += length
    return out


def truth_tables(files: DataFrame) -> DataFrame:
    """Measures of ``(score_id, xml)`` files, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"score_id": s, **m} for s, x in zip(b["score_id"], b["xml"]) for m in measures(x)], columns=["score_id", "index", "start_tick", "length", "fifths", "numerator", "denominator", "slash", "chords"])

    return files.select("score_id", "xml").mapInPandas(run, f"score_id long, {MEASURE}")


def chord_scores(truth: DataFrame, read: DataFrame) -> DataFrame:
    """``(score_id, exact, root, total)`` over measures with chords.

    ``read`` has ``(score_id, measure, ord, root, quality, bass)``; a measure
    counts where both sides hold the same sequence.
    """
    form = lambda r, q, b: F.struct(root_pc(r).alias("pc"), plain_quality(q).alias("q"), root_pc(b).alias("bass"))
    want = truth.where(F.size("chords") > 0).select("score_id", F.col("index").alias("measure"), "chords")
    want = want.select("score_id", "measure", F.posexplode("chords").alias("ord", "c")).groupBy("score_id", "measure").agg(F.sort_array(F.collect_list(F.struct("ord", form(F.col("c.root"), F.col("c.quality"), F.col("c.bass")).alias("x")))).alias("want"))
    got = read.groupBy("score_id", "measure").agg(F.sort_array(F.collect_list(F.struct("ord", form(F.col("root"), F.col("quality"), F.col("bass")).alias("x")))).alias("got"))
    rows = want.join(got, ["score_id", "measure"], "left")
    roots = lambda c: F.transform(c, lambda v: v["x"]["pc"])
    full = lambda c: F.transform(c, lambda v: F.concat_ws("|", v["x"]["pc"].cast("string"), v["x"]["q"], F.coalesce(v["x"]["bass"].cast("string"), F.lit("-"))))
    same = lambda f: F.coalesce(f(F.col("want")) == f(F.col("got")), F.lit(False))
    return rows.groupBy("score_id").agg(F.count_if(same(full)).alias("exact"), F.count_if(same(roots)).alias("root"), F.count("*").alias("total"))


def piece_scores(truth: DataFrame, found: DataFrame, tolerance: int = 60) -> DataFrame:
    """Precision, recall and F1 of notes, after the best offset, per score."""
    shifted = found.join(mt.best_offset(truth, found, tolerance), "score_id", "left")
    shifted = shifted.withColumn("start_tick", F.col("start_tick") + F.coalesce("offset", F.lit(0))).drop("offset")
    matched = mt.match_notes(truth, shifted, tolerance).groupBy("score_id").agg(F.count("*").alias("m"))
    sizes = truth.groupBy("score_id").agg(F.count("*").alias("t")).join(found.groupBy("score_id").agg(F.count("*").alias("f")), "score_id", "full_outer").join(matched, "score_id", "left").fillna(0)
    x: Column = mt.prf(F.col("m"), F.col("t"), F.col("f"))
    return sizes.select("score_id", x.alias("x")).select("score_id", "x.*")


def least_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(score_id, ord, mate)``: the assignment of least total distance between places on a line.

    Both sides hold ``(score_id, ord, at)``, equally many a score.  Two pairs
    that cross are never nearer than the same four places paired in order, so
    the k-th place of one side meets the k-th of the other, equal places by
    ``ord``: windows and a join, where :func:`least_cost` takes a matrix.
    """
    ranked = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("score_id").orderBy("at", "ord")))
    return ranked(left).join(ranked(right).select("score_id", "_r", F.col("ord").alias("mate")), ["score_id", "_r"]).select("score_id", "ord", "mate")


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns of least total cost, infinite costs left out.

    Shortest augmenting paths with potentials; the matrix is padded to a square.
    """
    n = max(cost.shape)
    finite = np.isfinite(cost)
    top = float(np.abs(cost[finite]).sum()) + 1.0 if finite.any() else 1.0
    c = np.full((n, n), top)
    c[: cost.shape[0], : cost.shape[1]] = np.where(finite, cost, top)
    u, v, owner = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        owner[n], col = row, n
        slack, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[col] >= 0:
            done[col] = True
            r = owner[col]
            red = c[r] - u[r] - v[:n]
            better = ~done[:n] & (red < slack)
            slack[better], back[better] = red[better], col
            to = int(np.where(done[:n], np.inf, slack).argmin())
            step = slack[to]
            u[owner[done]] += step
            v[done] -= step
            slack[~done[:n]] -= step
            col = to
        while col != n:
            owner[col], col = owner[back[col]], back[col]
    return sorted((int(owner[j]), j) for j in range(cost.shape[1]) if 0 <= owner[j] < cost.shape[0] and finite[owner[j], j])
