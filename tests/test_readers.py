"""Chord readers that answer, fail and hang; strips; answers laid over earlier symbols."""

import struct
import threading
import time
import zlib

import numpy as np
import pytest

from tonelake.operators import readers
from tonelake.operators.readers import Calls, Limits, ReaderError

SYSTEMS = "score_id long, system int, text_layer boolean, payload binary, cells array<struct<measure:int,tick:long,length:int,beat_ticks:int>>, text string"
EARLIER = "score_id long, measure long, tick long, text string, confidence double, system string"


def test_at_most_so_many_at_once():
    now, most, lock = 0, 0, threading.Lock()

    def reader(payload, measures):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.02)
        with lock:
            now -= 1
        return [(measures, 1, payload.decode())]

    out = Calls(reader).all([(str(i).encode(), i) for i in range(20)])
    assert most == 3 and [o[0] for o in out] == [[(i, 1.0, str(i))] for i in range(20)]


def test_a_stopping_failure_ends_the_calls_of_a_task():
    asked = []

    def reader(payload, measures):
        asked.append(payload)
        raise ReaderError("auth", "the key was rejected")

    calls = Calls(reader, Limits(at_once=1))
    first = calls.all([(b"a", 1)] * 5)
    assert first == [(None, "auth", "the key was rejected")] + [(None, "skipped", "the key was rejected")] * 4
    assert calls.all([(b"a", 1)]) == [(None, "skipped", "the key was rejected")] and len(asked) == 1


def test_other_failures_do_not():
    def reader(payload, measures):
        if payload == b"rate":
            raise ReaderError("rate", "too many calls")
        if payload == b"bug":
            return 1 / 0
        return {b"none": None, b"odd": [(1, 2)], b"text": "C"}.get(payload, [])

    out = Calls(reader).all([(p, 1) for p in (b"rate", b"bug", b"none", b"odd", b"text", b"ok")])
    assert [o[1] for o in out] == ["rate", "other", "answer", "answer", "answer", None] and out[1][2] == "division by zero" and out[5][0] == []


def test_calls_that_hang_keep_their_places():
    go, running, most, lock = threading.Event(), 0, 0, threading.Lock()

    def reader(payload, measures):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        try:
            if payload == b"hang":
                go.wait(20)
            return [(1, 1, "C")]
        finally:
            with lock:
                running -= 1

    calls = Calls(reader, Limits(at_once=2, seconds=0.1))
    start = time.monotonic()
    out = calls.all([(b"hang", 1), (b"ok", 1), (b"ok", 1), (b"hang", 1), (b"ok", 1)])
    assert [o[1] for o in out] == ["timeout", None, None, "timeout", "skipped"] and most == 2 and time.monotonic() - start < 5
    go.set()
    # What was skipped for want of places stays skipped; one late call alone stops nothing.
    assert calls.all([(b"ok", 1)])[0][1] == "skipped"
    go.clear()
    calls = Calls(reader, Limits(at_once=2, seconds=0.1))
    assert [o[1] for o in calls.all([(b"hang", 1), *[(b"ok", 1)] * 4])] == ["timeout", None, None, None, None]
    go.set()


@pytest.mark.parametrize("measure, want", [(2, 2), (2.0, 2), (2.5, None), (True, None), ("2", None), (float("nan"), None), (10**12, None)])
def test_answers_of_other_types(measure, want):
    assert readers._answer((measure, None, 3)) == (want, None, None)


def cells(first, n=2):
    return [(first + k, (first + k) * 960, 960, 240) for k in range(n)]


def answering(payload, measures):
    if payload == b"fail":
        raise ReaderError("rate", "too many calls")
    if payload == b"none":
        return []
    return [(1, 1, "Am"), (1, 1.2, "Am"), (2, 99, "G7"), (2, -4, "F"), (3, 1, "C"), (0, 1, "C"), (1, 2, "not a chord"), (1, None, "Dm"), (2, 2.5, "E7")]


def test_answers_over_earlier_symbols(spark):
    """Answered systems stand for earlier symbols, failed ones keep theirs; text layers are not asked; other columns do not matter."""
    big = 2**53 + 1
    rows = [(big, 0, False, b"a", cells(0), "x"), (big, 1, None, b"fail", cells(2), "x"), (big, 2, True, b"fail", cells(4), "x"), (big, 3, False, b"none", cells(6), "x"), (big, 4, False, None, cells(8), "x"), (7, 0, False, b"a", cells(0, 1), "x"), (8, 0, False, b"a", None, None)]
    old = [(big, m, m * 960, "C", 0.5, "s") for m in (0, 3, 4, 7, 8, 99)] + [(7, 5, 4800, "D", None, None)]
    read = readers.read_chords(spark.createDataFrame(rows, SYSTEMS), spark.createDataFrame(old, EARLIER), answering)
    got = {(r.score_id, r.measure, r.tick, r.text, r.source) for r in read.chords.collect()}
    new = {(big, 0, 0, "Am", "reader"), (big, 0, 0, "Dm", "reader"), (big, 1, 1680, "G7", "reader"), (big, 1, 960, "F", "reader"), (big, 1, 1440, "E7", "reader")}
    assert got == new | {(big, 3, 2880, "C", "earlier"), (big, 4, 3840, "C", "text"), (big, 8, 7680, "C", "earlier"), (big, 99, 95040, "C", "earlier")} | {(7, 0, 0, "Am", "reader"), (7, 0, 0, "Dm", "reader"), (7, 5, 4800, "D", "earlier")}
    assert read.chords.count() == len(got)
    assert {(r.score_id, r.system): (r.source, r.failure) for r in read.systems.collect()} == {(big, 0): ("reader", None), (big, 1): ("earlier", "rate"), (big, 2): ("text", None), (big, 3): ("reader", None), (big, 4): ("earlier", "strip"), (7, 0): ("reader", None), (8, 0): ("reader", None)}
    assert [(r.score_id, r.message) for r in read.warnings.collect()] == [(big, "The reader could not read the chord symbols for 2 of 4 systems: too many calls. The chord labels read before were used for those systems.")]
    assert {r.score_id for r in read.settled.collect()} == {7, 8}


def test_no_systems(spark):
    read = readers.read_chords(spark.createDataFrame([], SYSTEMS), spark.createDataFrame([(1, 0, 0, "C", 0.5, None)], EARLIER), answering)
    assert [tuple(r) for r in read.chords.collect()] == [(1, 0, 0, "C", 0.5, "earlier")]
    assert read.systems.collect() == read.warnings.collect() == read.settled.collect() == []


def test_strips(spark):
    page = np.full((300, 2000, 4), 255, np.uint8)
    page[150:191:10, 100:1900, :3] = 0
    rows = [(1, 0, 2000, 300, bytearray(page.tobytes()))]
    pages = spark.createDataFrame(rows, "score_id long, page int, width int, height int, rgba binary")
    systems = spark.createDataFrame([(1, 0, 0, 100, 1900, 150, 191, 10.0, [(100, 1000), (1000, 1900)]), (1, 1, 0, 5000, 5001, 150, 191, 10.0, [(0, 1)]), (1, 2, 9, 100, 1900, 150, 191, 10.0, [(0, 1)])], "score_id long, system int, page int, left int, right int, top int, bottom int, space double, cells array<struct<x0:int,x1:int>>")
    got = {r.system: r.payload for r in readers.strips(pages, systems).collect()}
    assert got[1] is None and got[2] is None
    data = bytes(got[0])
    w, h = struct.unpack(">II", data[16:24])
    assert w == readers.WIDEST and h == round((191 + 20 - 90) * readers.WIDEST / 1830)
    at = data.index(b"IDAT")
    pixels = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)
    red = (pixels[..., 0] > 150) & (pixels[..., 1] < 120)
    assert red[:80].sum() == 0 and red.sum() > 50  # marks stand under the staff
    # A cell's number stands under its middle.
    k = readers.WIDEST / 1830
    assert all(red[:, int((x - 85 - 12) * k) : int((x - 85 + 12) * k)].any() for x in (550, 1450))


@pytest.mark.parametrize("n", range(10))
def test_figures_differ(n):
    assert all(readers._figure(n, 12).shape != (f := readers._figure(m, 12)).shape or (readers._figure(n, 12) != f).any() for m in range(n))
