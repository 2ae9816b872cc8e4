"""Ground truth and scores."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import truth

def bar(inside="", beats=None, **mark):
    shown = "".join(f' {k}="{v}"' for k, v in mark.items())
    return f"<measure{shown}>{inside}" + (f"<note><duration>{beats}</duration></note>" if beats else "") + "</measure>"


def chord(step, kind, alter=None, text=None, bass=None):
    root = f"<root-step>{step}</root-step>" + (f"<root-alter>{alter}</root-alter>" if alter else "")
    shown = f' text="{text}"' if text else ""
    return f"<harmony><root>{root}</root><kind{shown}>{kind}</kind>" + (f"<bass><bass-step>{bass}</bass-step></bass>" if bass else "") + "</harmony>"


def slashes(kind):
    return f'<attributes><measure-style><slash type="{kind}"/></measure-style></attributes>'


START = "<attributes><divisions>2</divisions><key><fifths>2</fifths></key><time><beats>2</beats><beat-type>4</beat-type></time></attributes>"
XML = "<score-partwise><part id='gtr'>" + bar(START + chord("E", "minor-seventh", text="m7"), 4) + bar(slashes("start") + chord("A", "dominant", text="7", bass="C"), 4) + bar("", 4) + bar(slashes("stop") + chord("F", "major", alter=1) + chord("D", "major"), 4) + bar("", 4) + "</part></score-partwise>"


def test_truth_measures():
    m = truth.measures(XML)
    assert [x["length"] // 480 for x in m] == [2] * 5 and [x["slash"] for x in m] == [False, True, True, True, False]
    assert m[0]["chords"] == [{"root": "E", "quality": "m7", "bass": None}] and m[1]["chords"] == [{"root": "A", "quality": "7", "bass": "C"}]
    assert [c["root"] for c in m[3]["chords"]] == ["F#", "D"] and m[0]["fifths"] == 2 and m[4]["chords"] == []


def test_chord_scores(spark):
    t = truth.truth_tables(spark.createDataFrame([(1, XML)], "score_id long, xml string"))
    read = spark.createDataFrame([(1, 0, 0, "E", "min7", None), (1, 1, 0, "A", "maj7", None), (1, 3, 0, "Gb", "", None), (1, 3, 1, "D", "", None)], "score_id long, measure int, ord int, root string, quality string, bass string")
    assert tuple(truth.chord_scores(t, read).first()) == (1, 2, 3, 3)


def test_piece_scores(spark):
    rows = spark.createDataFrame([(1, 60 + i % 5, i, i * 480, 480) for i in range(20)], "score_id long, pitch long, note_ord long, start_tick long, duration long")
    late = rows.withColumn("start_tick", F.col("start_tick") + 960).where("note_ord < 15")
    r = truth.piece_scores(rows, late).first()
    assert (r["precision"], r["recall"]) == (1.0, 0.75)


@pytest.mark.parametrize("seed", range(6))
def test_least_cost(seed):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 20, (rng.integers(1, 6), rng.integers(1, 6))).astype(float)
    pairs = truth.least_cost(c)
    small, large = sorted(c.shape)
    full = c if c.shape[0] <= c.shape[1] else c.T
    best = min(sum(full[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert len(pairs) == small and sum(c[i, j] for i, j in pairs) == best
    assert truth.least_cost(np.array([[np.inf, 1.0], [np.inf, np.inf]])) == [(0, 1)]
