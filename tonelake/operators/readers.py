"""Chord symbols from a reader that is given: strips of pages, calls with limits, answers to ticks, and what was read before where it fails.

The reader is any function ``(payload bytes, measures) -> [(measure, beat, symbol)]``;
the engine itself calls no service.
"""

from __future__ import annotations

import queue
import struct
import threading
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chord_names import over_distinct
from ..functions.marks import SYMBOL, read_symbol
from ..session import written
from .tuplets import drawn_digit

Reader = Callable[[bytes, int], list]


class ReaderError(Exception):
    """A failure of a kind: ``auth``, ``rate``, ``network``, ``api``, or another word."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(text or "an unexpected error occurred")
        self.kind = kind


@dataclass
class Limits:
    """At most ``at_once`` calls in a task, ``seconds`` for each; a failure of one of the kinds in ``stops`` ends a task's calls."""

    at_once: int = 3
    seconds: float = 25.0
    stops: tuple[str, ...] = ("auth",)


@dataclass
class Calls:
    """The calls of one task.

    A call beyond its time has failed (``timeout``), and what it may answer
    later is not used; it keeps its place, so that no more than ``at_once`` ever
    run.  Where no place is left, or a failure of a stopping kind was seen, the
    rest is ``skipped``, in this batch and those after it.
    """

    reader: Reader
    limits: Limits = field(default_factory=Limits)
    stopped: str | None = None
    hung: list[threading.Thread] = field(default_factory=list)

    def _fail(self, kind: str, text: str) -> tuple[None, str, str]:
        if kind in self.limits.stops and self.stopped is None:
            self.stopped = text
        return None, kind, text

    def _outcome(self, value) -> tuple[list | None, str | None, str | None]:
        if isinstance(value, Exception) and isinstance(getattr(value, "kind", None), str):  # a reader sent with its own copy of the class counts too
            return self._fail(value.kind, str(value))
        if isinstance(value, BaseException):
            return self._fail("other", str(value) or "an unexpected error occurred")
        try:
            return [_answer(v) for v in value], None, None
        except (TypeError, ValueError):
            return self._fail("answer", "the answer has another form")

    def all(self, items: list[tuple[bytes, int]]) -> list[tuple[list | None, str | None, str | None]]:
        """``(answers, kind of failure, message)`` of each, in order."""
        out: list = [None] * len(items)
        done: queue.SimpleQueue = queue.SimpleQueue()
        running: dict[int, tuple[threading.Thread, float]] = {}

        def call(i: int) -> None:
            try:
                done.put((i, self.reader(*items[i])))
            except BaseException as e:  # whatever a reader does, the import goes on
                done.put((i, e))

        following = 0
        while following < len(items) or running:
            self.hung = [t for t in self.hung if t.is_alive()]
            while following < len(items) and self.stopped is None and len(running) + len(self.hung) < self.limits.at_once:
                t = threading.Thread(target=call, args=(following,), daemon=True)
                running[following] = (t, time.monotonic() + self.limits.seconds)
                t.start()
                following += 1
            if not running:
                if self.stopped is None:
                    self.stopped = "the reader does not answer"
                break
            try:
                i, value = done.get(timeout=max(0.0, min(end for _, end in running.values()) - time.monotonic()))
                if i in running:
                    running.pop(i)
                    out[i] = self._outcome(value)
            except queue.Empty:
                for i, (t, end) in list(running.items()):
                    if end <= time.monotonic():
                        running.pop(i)
                        self.hung.append(t)
                        out[i] = self._fail("timeout", f"no answer within {self.limits.seconds:g} seconds")
        return [o or (None, "skipped", self.stopped) for o in out]


def _answer(v) -> tuple[int | None, float | None, str | None]:
    """Measure, beat and symbol of an answer; what has another type is null."""
    measure, beat, symbol = v
    number = lambda n: isinstance(n, (int, float)) and not isinstance(n, bool) and np.isfinite(n)
    return int(measure) if number(measure) and measure == int(measure) and abs(measure) < 2**31 else None, float(beat) if number(beat) else None, symbol if isinstance(symbol, str) else None


CALLED = "score_id long, system int, answers array<struct<measure:int,beat:double,symbol:string>>, failure string, message string"


def called(systems: DataFrame, reader: Reader, limits: Limits = Limits(), tasks: int | None = None) -> DataFrame:
    """A row a system: what the reader answered, or how it failed.

    ``systems``: score_id, system, payload, measures.  ``tasks`` bounds the
    tasks, and so the calls at one time; null payloads fail without a call.  The
    result is a table in the shared folder: a system is asked once however
    often the rows are used, and again only if its task is lost before.
    """
    rows = systems.select("score_id", "system", "payload", F.col("measures").cast("int").alias("measures"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Calls(reader, limits)
        for b in batches:
            asked = [i for i, p in enumerate(b["payload"]) if p is not None]
            got = dict(zip(asked, calls.all([(bytes(b["payload"].iloc[i]), int(b["measures"].iloc[i])) for i in asked])))
            rows = [(sid, s, *got.get(i, (None, "strip", "there is no strip of the system"))) for i, (sid, s) in enumerate(zip(b["score_id"], b["system"]))]
            rows = [(sid, s, None if a is None else [dict(zip(("measure", "beat", "symbol"), v)) for v in a], k, m) for sid, s, a, k, m in rows]
            yield pd.DataFrame(rows, columns=["score_id", "system", "answers", "failure", "message"])

    return written((rows.repartition(tasks) if tasks else rows).mapInPandas(run, CALLED))


# Fixed value: how sure a reader's symbol is.
SURE = 0.95


@dataclass
class Read:
    chords: DataFrame
    systems: DataFrame
    warnings: DataFrame
    settled: DataFrame


def read_chords(systems: DataFrame, earlier: DataFrame, reader: Reader, limits: Limits = Limits(), tasks: int | None = None) -> Read:
    """Chord symbols of a reader over those read before.

    ``systems``: score_id, system (both not null, one row each), text_layer
    (its chords are exact: not asked), payload, and cells, an array in order of
    (measure, tick, length, beat_ticks).  ``earlier``: score_id, measure, tick,
    text, confidence.  Other columns are not used.

    Answers go to the nearest beat of their cell, counted from 1; those without
    such a cell or a readable symbol, and repeats on a tick, are left out.  In the
    measures of systems that were answered, answers (even none) stand for
    earlier chords; all others keep theirs.

    Returns ``chords`` (score_id, measure, tick, text, confidence, source:
    ``reader``, ``text`` or ``earlier``), ``systems`` (score_id, system, source,
    failure, message), at most one of ``warnings`` a score, and the score_id of
    ``settled`` scores, asked and answered throughout.
    """
    text = F.coalesce(F.col("text_layer"), F.lit(False))
    known = systems.select("score_id", F.col("system").cast("int").alias("system"), text.alias("text_layer"), F.coalesce("cells", F.expr("array()")).alias("cells"), "payload")
    answered = called(known.where("not text_layer").select("score_id", "system", "payload", F.size("cells").alias("measures")), reader, limits, tasks)
    known = known.drop("payload").join(answered, ["score_id", "system"], "left")
    source = F.when(F.col("text_layer"), "text").when(F.col("answers").isNotNull(), "reader").otherwise("earlier")
    known = known.withColumn("source", source)

    items = known.where("source = 'reader'").select("score_id", "system", "cells", F.posexplode("answers").alias("pos", "a")).where("a.measure between 1 and size(cells) and a.symbol is not null")
    items = items.select("score_id", "system", "pos", F.element_at("cells", F.col("a.measure")).alias("c"), F.col("a.beat").alias("beat"), F.col("a.symbol").alias("symbol"))
    items = over_distinct(items, "symbol", read_symbol, SYMBOL).where("symbol_x is not null")
    beats = F.greatest(F.lit(1), F.coalesce(F.floor(F.try_divide(F.col("c.length"), F.col("c.beat_ticks")) + 0.5), F.lit(1)))
    nth = F.least(beats - 1, F.greatest(F.lit(0), F.floor(F.coalesce("beat", F.lit(1.0)) - 0.5)))
    placed = items.select("score_id", "system", "pos", F.col("c.measure").cast("long").alias("measure"), (F.col("c.tick") + nth * F.col("c.beat_ticks")).cast("long").alias("tick"), F.col("symbol_x.text").alias("text"))
    first = placed.groupBy("score_id", "system", "tick", "text").agg(F.min_by("measure", "pos").alias("measure"))
    new = first.select("score_id", "measure", "tick", "text", F.lit(SURE).alias("confidence"), F.lit("reader").alias("source"))

    covered = known.select("score_id", "source", F.explode("cells.measure").alias("measure")).groupBy("score_id", F.col("measure").cast("long").alias("measure")).agg(F.max(F.col("source") == "reader").alias("_read"), F.max(F.col("source") == "text").alias("_text"))
    old = earlier.select("score_id", F.col("measure").cast("long").alias("measure"), F.col("tick").cast("long").alias("tick"), "text", F.col("confidence").cast("double").alias("confidence")).join(covered, ["score_id", "measure"], "left")
    kept = old.where("not coalesce(_read, false)").select("score_id", "measure", "tick", "text", "confidence", F.when(F.col("_text"), "text").otherwise("earlier").alias("source"))

    sums = known.where("not text_layer").groupBy("score_id").agg(F.count("*").alias("n"), F.count("failure").alias("failed"), F.min_by("message", F.when(F.col("failure").isNotNull(), F.col("system"))).alias("why"))
    part = F.when(F.col("failed") < F.col("n"), F.format_string(" for %d of %d systems", "failed", "n")).otherwise("")
    those = F.when(F.col("failed") < F.col("n"), " for those systems").otherwise("")
    message = F.concat(F.lit("The reader could not read the chord symbols"), part, F.lit(": "), "why", F.lit(". The chord labels read before were used"), those, F.lit("."))
    return Read(new.unionByName(kept), known.select("score_id", "system", "source", "failure", "message"), sums.where("failed > 0").select("score_id", message.alias("message")), sums.where("failed = 0").select("score_id"))


# Margins of a strip in staff spaces (sides, above, under), and its greatest width in pixels.
SIDES, ABOVE, UNDER = 1.5, 6.0, 2.0
WIDEST = 1568
RED = (224, 0, 0)


def png(rgb: np.ndarray) -> bytes:
    """An image file of ``(height, width, 3)`` bytes."""
    h, w, _ = rgb.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def strip(rgba: np.ndarray, left: float, right: float, top: float, bottom: float, space: float, cells: list[tuple[float, float]]) -> np.ndarray | None:
    """A system cut out with its chord band, each cell marked in red under it by ticks and its number from 1; none where nothing is left of it."""
    d = space if space > 0 else 10.0
    x0, x1 = max(0, int(np.floor(left - round(SIDES * d)))), min(rgba.shape[1], int(np.ceil(right + round(SIDES * d))))
    y0, y1 = max(0, int(np.floor(top - ABOVE * d))), min(rgba.shape[0], int(np.ceil(bottom + UNDER * d)))
    if x1 - x0 < 8 or y1 - y0 < 8 or not cells:
        return None
    cut = rgba[y0:y1, x0:x1].astype(np.float32)
    out = (cut[..., :3] * (cut[..., 3:] / 255) + 255 - cut[..., 3:]).astype(np.uint8)
    under = int(bottom - y0)
    for x in {int(e - x0) for c in cells for e in c}:
        if 0 <= x < out.shape[1]:
            out[under : under + int(1.6 * d), x : x + 2] = RED
    for n, (a, b) in enumerate(cells, 1):
        at = int((a + b) / 2 - x0 - 0.5 * d * len(str(n)))
        for c in str(n):
            shape = _figure(int(c), d)
            where = out[under + int(0.2 * d) :, max(0, at) :][: shape.shape[0], : shape.shape[1]]
            where[shape[: where.shape[0], : where.shape[1]]] = RED
            at += int(1.1 * d)
    k = min(1.0, WIDEST / out.shape[1])
    if k < 1:  # the mean of the pixels that fall together
        for axis in (0, 1):
            n = max(1, round(out.shape[axis] * k))
            cuts = (np.arange(n) * out.shape[axis]) // n
            size = np.diff(np.r_[cuts, out.shape[axis]]).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
            out = (np.add.reduceat(out.astype(np.uint32), cuts, axis) / size + 0.5).astype(np.uint8)
    return out


def _figure(n: int, d: float) -> np.ndarray:
    """0, 1 and 8 beside the digits tuplets know: a ring, a bar, and two rings over each other."""
    if n == 1:
        return np.ones((int(1.4 * d), max(2, int(0.2 * d))), bool)
    if n not in (0, 8):
        return drawn_digit(n, d)
    h, w = int(1.4 * d), int(0.9 * d)
    y, x = np.mgrid[0:h, 0:w]
    ring = lambda y0, y1: np.abs(np.hypot((y - (y0 + y1 - 1) / 2) / ((y1 - y0) / 2), (x - (w - 1) / 2) / (w / 2)) - 0.8) <= 0.2
    return ring(0, h) if n == 0 else ring(0, h // 2 + 1) | ring(h // 2, h)


STRIPS = "score_id long, system int, payload binary"


def strips(pages: DataFrame, systems: DataFrame) -> DataFrame:
    """A PNG strip of each system; null where there is none.

    ``pages``: score_id, page, width, height, rgba.  ``systems``: score_id,
    system, page, left, right, top, bottom, space, and cells with x0 and x1.  A
    page's systems travel with it, so a page is sent once.
    """
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("left", "right", "top", "bottom", "space")], F.transform("cells", lambda c: F.struct(c["x0"].cast("double").alias("x0"), c["x1"].cast("double").alias("x1"))).alias("cells"), F.col("system").cast("int").alias("system"))
    wanted = systems.groupBy("score_id", "page").agg(F.collect_list(box).alias("boxes"))
    rows = wanted.join(pages.select("score_id", "page", "width", "height", "rgba"), ["score_id", "page"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, boxes, w, h, data in zip(b["score_id"], b["boxes"], b["width"], b["height"], b["rgba"]):
                for s in boxes:
                    cut = None if data is None else strip(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 4), s["left"], s["right"], s["top"], s["bottom"], s["space"], [(c["x0"], c["x1"]) for c in s["cells"]])
                    rows.append((sid, s["system"], None if cut is None else png(cut)))
            yield pd.DataFrame(rows, columns=["score_id", "system", "payload"])

    return rows.mapInPandas(run, STRIPS)
