"""A score whose chords cannot be found keeps what it had, and the others go on."""

import pytest
from pyspark.sql import functions as F

from tonelake.operators import chords
from tonelake.plans import derived as d

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    few = lambda t: t.where("score_id < 4").persist()
    return few(d.notes(spark, SF)), few(d.bars(spark, SF)), few(d.key_signatures(spark, SF))


def shown(df):
    return sorted(repr(tuple(r)) for r in df.select(*[c.split()[0] for c in chords.CHORDS.split(", ")]).collect())


def test_without_failures_nothing_changes(given):
    found, warnings = chords.detect_or_keep(*given)
    assert shown(found) == shown(chords.detect(*given)) != [] and warnings.collect() == []


@pytest.mark.parametrize("at_once", [1000, 7])
def test_one_bad_score(given, at_once):
    rows = chords._ordered(*given, "beat", 480).toPandas().sort_values(["score_id", "w_start"], ignore_index=True)
    whole = [r for p in chords._choose(iter([rows])) for r in p.to_dict("records")]
    bad = rows.copy()
    ids = sorted(set(r["score_id"] for r in whole))
    broken = bad.index[(bad["score_id"] == ids[1])]
    bad.loc[broken, "hist"] = None
    parts = (bad.iloc[k : k + at_once] for k in range(0, len(bad), at_once))
    got = [r for p in chords._guarded(parts) for r in p.to_dict("records")]
    errors = [r for r in got if r["error"]]
    assert [r["score_id"] for r in errors] == [ids[1]] and errors[0]["error"].startswith("Chord detection failed: ")
    key = lambda r: (r["score_id"], r["tick"], r["duration"], r["name"])
    assert [key(r) for r in got if not r["error"]] == [key(r) for r in whole if r["score_id"] != ids[1]]


def test_earlier_chords_stay(spark, given, monkeypatch):
    """A histogram that is no list of numbers: the job goes on, the score keeps its earlier chords."""
    notes, bars, keys = given
    real = chords._ordered
    monkeypatch.setattr(chords, "_ordered", lambda *a: real(*a).withColumn("hist", F.when(F.col("score_id") != 1, F.col("hist"))))
    earlier = spark.createDataFrame([(1, 0.0, 960.0, "Am", 9, "m", None, [57, 60]), (2, 0.0, 960.0, "G", 7, "", None, [55])], chords.CHORDS)
    found, warnings = chords.detect_or_keep(notes, bars, keys, earlier)
    assert [(r["tick"], r["name"]) for r in found.where("score_id = 1").collect()] == [(0.0, "Am")] and found.where("score_id = 2 and duration = 960 and name = 'G' and pitches = array(55)").count() == 0
    assert [r["score_id"] for r in warnings.collect()] == [1] and found.where("score_id = 3").count() > 0
