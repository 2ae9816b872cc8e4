"""Queries over whole scores, against loops over all their notes."""

from collections import Counter, defaultdict

import pytest

from tonelake.operators.playback import LIGHT
from tonelake.plans import derived as d
from tonelake.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def notes(spark):
    return d.notes(spark, SF).orderBy("score_id", "note_ord").collect()


def test_abc_tunes_hold_all_notes(spark, notes):
    at, want = Counter(), []
    d_major = (61, 62, 64, 66, 67, 69, 71, 73, 74, 76, 78, 79, 81, 83)  # of CDEFGABcdefgab
    for n in notes:
        length = (n["duration"] // 240 + 1) * 240
        want.append((n["score_id"], d_major[n["pitch"] % 14], at[n["score_id"]], length))
        at[n["score_id"]] += length
    assert sorted(tuple(r) for r in QUERIES["s07_abc_tunes"](spark, SF).collect()) == sorted(want)


def test_least_cost_assignment_takes_all_notes(spark, notes):
    starts, got = defaultdict(list), defaultdict(list)
    for n in notes:
        starts[n["score_id"]].append(n["start_tick"])
    for r in QUERIES["j13_least_cost_assignment"](spark, SF).collect():
        got[r["score_id"]].append((r["note"], r["mate"]))
    assert {s: len(p) for s, p in got.items()} == {s: len(a) for s, a in starts.items()}
    for s, pairs in got.items():
        a = starts[s]
        assert sorted(i for i, _ in pairs) == sorted(j for _, j in pairs) == list(range(len(a)))
        # On a line, sorted onsets matched in their order cost least.
        assert sum(abs(a[i] - a[j] - s % 300) for i, j in pairs) == len(a) * (s % 300)


def test_strums_are_light_where_notes_are(spark, notes):
    starts, bars = defaultdict(list), defaultdict(list)
    for n in notes:
        starts[n["score_id"]].append(n["start_tick"])
    for b in d.bars(spark, SF).collect():
        bars[b["score_id"]].append((b["start_tick"], b["end_tick"]))
    wrong = total = 0
    for r in QUERIES["c05_strums"](spark, SF).collect():
        x, y = next((x, y) for x, y in bars[r["score_id"]] if x <= r["tick"] < y)
        light = any(x <= t < y for t in starts[r["score_id"]])
        wrong += all(abs(r["gain"] - 0.45 * g * (LIGHT if light else 1.0)) > 1e-9 for g in (1.0, 0.85))
        total += 1
    assert total and wrong == 0
