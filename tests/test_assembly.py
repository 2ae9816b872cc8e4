"""Pitches and bars out of symbols, against plain loops."""

import itertools
import math
import random

import pytest

from tonelake.operators import assembly as a

HEADS = "score_id long, part int, measure long, x double, head_ord int, degree int, accidental int, tied boolean, fifths int, letter_hint string"


def looped(rows):
    """Alterations by reading the heads of each part measure by measure."""
    out, ended = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[4])):
        sid, part, measure, _, n, degree, accidental, tied, fifths, _ = r
        now = ended.setdefault((sid, part, measure), {})
        was = ended.get((sid, part, measure - 1), {})
        held, alter = now.get(degree, (None, None))
        fifths = fifths or 0
        key = 1 if degree % 7 in a.SHARPS[: max(0, fifths)] else -1 if degree % 7 in a.FLATS[: max(0, -fifths)] else 0
        if accidental is not None:
            held = alter = accidental
        elif held is not None:
            alter = held
        elif tied and degree in was:
            held = alter = was[degree][1]
        else:
            alter = key
        now[degree] = (held, alter)
        out[(sid, part, measure, n)] = alter
    return out


def test_pitches_follow_accidentals_and_ties(spark):
    rng = random.Random(7)
    rows = []
    for sid, part in itertools.product(range(3), range(2)):
        for measure in range(40):
            if rng.random() < 0.1:
                continue
            for n in range(rng.randint(1, 6)):
                rows.append((sid, part, measure, float(rng.randint(0, 4)), n, 28 + rng.randint(0, 2), rng.choice([None] * 6 + [1, 0, -1]), rng.choice([True, True, False, None]), rng.choice([-3, 0, None, 4]), "x"))
    got = a.resolve_pitches(spark.createDataFrame(rows, HEADS))
    assert got.columns[-4:] == ["alter", "letter", "octave", "pitch"] and "letter_hint" in got.columns
    found = {(r["score_id"], r["part"], r["measure"], r["head_ord"]): r for r in got.collect()}
    assert {k: r["alter"] for k, r in found.items()} == looped(rows)
    assert all(r["pitch"] == 60 + (0, 2, 4)[r["letter"]] + r["alter"] and r["octave"] == 4 for r in found.values())
    assert a.resolve_pitches(spark.createDataFrame([], HEADS)).count() == 0


def test_a_tie_carries_over_many_barlines_but_no_gap(spark):
    rows = [(1, 0, m, 0.0, 0, 31, 1 if m == 0 else None, m > 0, -1, "") for m in (0, 1, 2, 4)]
    got = {r["measure"]: r["alter"] for r in a.resolve_pitches(spark.createDataFrame(rows, HEADS)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 4: 0}


def fit(ticks, bar, sure=None, **more):
    n = len(ticks)
    return a.fit_bar(ticks, sure or [1.0] * n, more.pop("rest", [False] * n), more.pop("triplet", [False] * n), bar, **more)


def test_bars():
    assert fit([480] * 4, 1920) == ("fits", [(0, 480), (480, 480), (960, 480), (1440, 480)])
    assert fit([480] * 3, 1920, short_ok=True) == fit([480] * 3, 1920) == ("short", [(0, 480), (480, 480), (960, 480)])
    assert fit([240, 240, 240, 480, 480, 480], 1920) == ("triplet", [(0, 160), (160, 160), (320, 160), (480, 480), (960, 480), (1440, 480)])
    assert fit([480, 480, 480, 240], 1920, [0.9, 0.9, 0.9, 0.5])[0] == "repaired"
    assert fit([480, 960, 480, 480], 1920, [0.9, 0.4, 0.9, 0.9]) == ("repaired", [(0, 480), (480, 480), (960, 480), (1440, 480)])
    assert fit([1920], 1440) == ("snapped", [(0, 1440)])
    assert fit([1920] * 3, 960) == ("clipped", [(0, 960), (840, 120), (840, 120)])
    assert fit([480, 480], 1920, rest=[True, True])[0] == "rests" and fit([], 1920) == ("rests", [])
    assert fit([240, 240, 240, 480, 960], 1920, triplet=[True] * 3 + [False] * 2) == ("fits", [(0, 160), (160, 160), (320, 160), (480, 480), (960, 960)])


@pytest.mark.parametrize("seed", range(40))
def test_snapping_costs_least(seed):
    rng = random.Random(seed)
    units = tuple(rng.randint(1, 16) for _ in range(rng.randint(1, 4)))
    sure = tuple(rng.random() for _ in units)
    target = rng.randint(1, sum(units))
    cost = lambda taken: sum((0.2 + s) * abs(math.log(c / u)) for c, u, s in zip(taken, units, sure))
    ok = [t for t in itertools.product(a.UNITS, repeat=len(units)) if sum(t) == target and all(0.48 <= c / u <= 2.05 for c, u in zip(t, units))]
    got = a._snap(units, sure, target)
    assert (got is None) == (not ok)
    if ok:
        assert got in ok and cost(got) == pytest.approx(min(map(cost, ok)))


def test_bars_as_rows(spark):
    schema = "score_id long, part int, measure long, event_ord int, ticks int, confidence double, rest boolean, whole_rest boolean, triplet boolean, bar int, short_ok boolean, length string"
    rows = [(1, 0, 0, i, 480, 0.9, None, None, None, 1920, None, "x") for i in range(4)]
    rows += [(1, 0, 0, 4, 0, 0.9, True, True, None, 1920, None, "x"), (1, 0, 1, 0, 0, None, True, True, False, 1440, False, "x"), (1, 0, 2, 0, None, 1.0, False, False, False, 1440, False, "x")]
    got = sorted(tuple(r) for r in a.fit_bars(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0, 0, i, 480 * i, 480, "fits") for i in range(4)] + [(1, 0, 1, 0, 0, 1440, "rests")]
    assert a.fit_bars(spark.createDataFrame([], schema)).count() == 0


def test_query_of_bars(spark):
    from tonelake.plans import derived as d
    from tonelake.plans import registry

    want, bars = [], {}
    for n in d.notes(spark, "/root/testdata/sf0.001").orderBy("score_id", "note_ord").collect():
        bars.setdefault((n["score_id"], n["note_ord"] // 4), []).append(n)
    for (sid, measure), ns in bars.items():
        rest, triplet = [n["voice"] == 2 and n["note_ord"] % 3 == 0 for n in ns], [n["note_ord"] % 16 < 3 for n in ns]
        how, placed = a.fit_bar([n["duration"] for n in ns], [n["velocity"] / 128 for n in ns], rest, triplet, 1920, short_ok=measure == 0)
        want += [(sid, 0, measure, n["note_ord"], *p, how) for n, p in zip(ns, placed)]
    got = [tuple(r) for r in registry.queries()["c17_fit_bars"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and len({g[-1] for g in got}) >= 4


BARS = "score_id long, system int, part int, bar int, ticks long, slashes int"
SYSTEMS = "score_id long, system int, printed boolean, nominal long, unsigned boolean"
LOW = {960: (2, 4), 1440: (3, 4), 1920: (4, 4), 720: (3, 8), 2160: (9, 8), 2880: (12, 8)}


def looped_meters(bars, systems):
    out = []
    scores = sorted({s[0] for s in systems})
    for sid in scores:
        own = sorted(s for s in systems if s[0] == sid)
        for _, first, _, nominal, unsigned in own:
            sizes, marks = [], []
            for _, k, printed, _, _ in own:
                if k < first or k > first + 3:
                    continue
                if max(len(sizes), len(marks)) >= 3 or (k > first and printed):
                    break
                rows = sorted(b for b in bars if b[0] == sid and b[1] == k)
                for _, _, part, bar, ticks, slashes in rows:
                    final = k == own[-1][1] and bar == max(b[3] for b in rows if b[2] == part)
                    if ticks is None and slashes is not None and 2 <= slashes <= 7:
                        marks.append(480 * slashes)
                    elif ticks is not None and not final and not (k == own[0][1] and bar == 0):
                        sizes.append(ticks)
            if len(sizes) < 3 <= len(marks):
                sizes = marks
            if not sizes:
                continue
            best = max(sizes, key=sizes.count)
            n, total = sizes.count(best), len(sizes)
            rival = max([sizes.count(x) for x in sizes if x != best], default=0)
            if best == nominal:
                continue
            if total >= 3 and n >= 3 and n >= 0.6 * total:
                if best % 480 == 0 and 2 <= best // 480 <= 7:
                    out.append((sid, first, best // 480, 4, n, total, False))
                elif best % 240 == 0 and 5 <= best // 240 <= 13:
                    out.append((sid, first, best // 240, 8, n, total, False))
            elif unsigned and best in LOW:
                if (total == 2 and n == 2) if total < 3 else (total <= 4 and n >= 2 and n >= 0.6 * total) or (n >= 4 and n >= 2 * rival and n >= 0.4 * total):
                    out.append((sid, first, *LOW[best], n, total, True))
    return sorted(out)


def test_meters_that_bars_add_up_to(spark):
    rng = random.Random(3)
    bars, systems = [], []
    for sid in range(60):
        usual = rng.choice([1440, 1680, 1920, 960, 2160, 3600, 700, 720])
        for k in range(rng.randint(1, 5)):
            systems.append((sid, k, rng.choice([True, False, False, None]), rng.choice([1920, 1440]), rng.choice([True, False, None])))
            for part in range(rng.randint(0, 2)):
                for bar in range(rng.randint(1, 4)):
                    slash = rng.random() < 0.25
                    bars.append((sid, k, part, bar, None if slash else usual if rng.random() < 0.75 else rng.choice([1920, 480]), rng.randint(1, 4) if slash else None))
    got = a.infer_meters(spark.createDataFrame(bars, BARS), spark.createDataFrame(systems, SYSTEMS))
    want = looped_meters(bars, systems)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10 and {w[-1] for w in want} == {True, False}
    assert a.infer_meters(spark.createDataFrame([], BARS), spark.createDataFrame([], SYSTEMS)).count() == 0
