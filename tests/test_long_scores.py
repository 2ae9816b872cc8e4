"""Scores of more than 10,001 measures."""

from pyspark.sql import functions as F

from tonelake.plans import derived as d
from tonelake.plans import registry
from tonelake.sinks.musicxml import bars_of, write_musicxml
from tonelake.sources.musicxml import read_musicxml
from tonelake.sources.score import Note, Score, Track


def test_no_measure_is_left_out(spark, tmp_path):
    # 3/4, then 7/8: 75,000 notes, one every 240 ticks, reach past measure 10,700.
    n = 75_000
    rows = spark.range(n).select(
        F.when(F.col("id") < n - 60, F.col("id") * 45).otherwise(F.element_at(F.array(F.lit(8), F.lit(12), F.lit(15)), (F.col("id") % 3 + 1).cast("int")) + F.col("id") * 45).alias("event_id"),
        F.timestamp_seconds("id").alias("ts"), F.lit(1).cast("long").alias("user_id"),
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    ends = d.bars(spark, str(tmp_path)).agg(F.count("*"), F.countDistinct("index"), F.max("index"), F.max("end_tick")).first()
    length = d.notes(spark, str(tmp_path)).agg(F.max(F.col("start_tick") + F.col("duration"))).first()[0]
    assert ends[0] == ends[1] == ends[2] + 1 > 10_001 and ends[3] >= length
    # The last sixty notes are a C major triad, far beyond measure 10,000.
    found = registry.queries()["a08_concentrated_windows"](spark, str(tmp_path)).agg(F.max("measure")).first()[0]
    assert found > 10_001


def test_musicxml_holds_all_bars():
    notes = [Note(60 + i % 5, 1440 * i, 1440) for i in range(12_000)]
    back = read_musicxml(write_musicxml(Score([Track("t", "T", 0, notes)], [{"tick": 0, "numerator": 3, "denominator": 4}])))
    assert [(n.pitch, n.start, n.duration) for n in back.tracks[0].notes] == [(n.pitch, n.start, n.duration) for n in notes]


def test_bars_end_in_a_meter_of_no_length():
    score = Score([Track("t", "T", 0, [Note(60, 0, 4000)])], [{"tick": 0, "numerator": 4, "denominator": 4}, {"tick": 1920, "numerator": 0, "denominator": 4}])
    assert [b[:2] for b in bars_of(score)] == [(0.0, 1920.0), (1920.0, 3840.0), (3840.0, 5760.0)]
