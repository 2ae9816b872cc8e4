"""Golden cases of the music operators."""

import pytest
from pyspark.sql import functions as F

from tonelake.functions import chord_names as cn
from tonelake.functions import marks, theory
from tonelake.model import STANDARD, TUNINGS
from tonelake.operators import audio, chords, edits, layout, metrics, playback, tab
from tonelake.operators import timeline as tl
from tonelake.sinks.ascii_tab import grid_unit, render
from tonelake.sinks.musicxml import note_pieces

Q, BAR = 480, 1920
NOTE = "score_id long, track_ord int, note_ord int, pitch int, start_tick long, duration long, velocity int, voice int"


def notes(spark, rows, sid=1):
    return spark.createDataFrame([(sid, 0, i, p, s, d, 90, 0) for i, (p, s, d) in enumerate(rows)], NOTE)


def sigs(spark, rows=((0, 4, 4),), sid=1):
    return spark.createDataFrame([(sid, i, t, n, d) for i, (t, n, d) in enumerate(rows)], "score_id long, ord int, tick long, numerator int, denominator int")


def keys(spark, fifths=0, sid=1):
    return spark.createDataFrame([(sid, 0, 0, fifths, "major")], "score_id long, ord int, tick long, fifths int, mode string")


def bars(spark, length, rows=((0, 4, 4),)):
    return tl.measures(spark.createDataFrame([(1, length)], "score_id long, length long"), sigs(spark, rows))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# ---- theory


def test_names(spark):
    r = one(spark, theory.name_midi(F.lit("C4")), theory.name_midi(F.lit("Bb2")), theory.midi_name(F.lit(61), True), theory.name_midi(F.lit("Fx")), theory.name_midi(F.lit("H2")), theory.name_midi(F.lit(" e-1 ")))
    assert tuple(r) == (60, 46, "Db4", 67, None, 4)


def test_spelling_and_keys(spark):
    r = one(spark, theory.spell(F.lit(61), F.lit(-2)), theory.spell(F.lit(61), F.lit(2)), theory.key_name(F.lit(-3), F.lit("minor")), theory.key_fifths(F.lit("A"), F.lit("minor")), theory.key_fifths(F.lit("?"), F.lit("major")))
    assert (tuple(r[0]), tuple(r[1]), r[2], r[3], r[4]) == (("D", -1, 4), ("C", 1, 4), "C minor", 0, 0)
    r = one(spark, theory.note_value(F.lit(720), F.lit(480)), theory.value_ticks(F.lit(4), F.lit(1), F.lit(False), F.lit(480)), theory.half_up(F.lit(-2.5)), theory.pitch_class(F.lit(-3)))
    assert (r[0]["base"], r[0]["dots"], r[1], r[2], r[3]) == (4, 1, 720, -2, 9)
    r = one(spark, theory.alterations(F.lit(-2)), theory.diatonic_midi(F.lit(35), F.lit(0)), theory.diatonic_midi(F.lit(33), F.lit(1)))
    assert list(r[0]) == [0, 0, -1, 0, 0, 0, -1] and r[1] == 72


# ---- timeline


def test_measures(spark):
    assert bars(spark, 9 * Q, ((0, 4, 4),)).count() == 3
    assert [r["start_tick"] for r in bars(spark, 5000, ((0, 4, 4), (500, 3, 4))).orderBy("index").collect()] == [0, 1920, 3360, 4800]
    # Two changes on one tick: the later in the list holds; an empty score has one measure.
    assert [r["numerator"] for r in bars(spark, 4000, ((0, 4, 4), (1920, 3, 4), (1920, 2, 4))).orderBy("index").collect()] == [4, 2, 2, 2]
    assert bars(spark, 0).count() == 1
    assert bars(spark, 1920 * 20_000).count() == 10_001


def test_measures_of_unordered_lists(spark):
    got = bars(spark, 4000, ((960, 3, 4), (0, 2, 4))).orderBy("index").collect()
    assert {r["numerator"] for r in got} == {2}


def test_pulse_and_windows(spark):
    assert tuple(one(spark, *[tl.pulse(F.lit(480), F.lit(d)) for d in (2, 4, 8)])) == (480, 480, 240)
    rows = tl.windows(bars(spark, 3840, ((0, 2, 2),))).orderBy("w_start").collect()
    assert [r["w_start"] for r in rows][:4] == [0, 480, 960, 1440] and len(rows) == 8


def test_seconds(spark):
    t = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("tick"), F.lit(b).alias("bpm")) for i, (k, b) in enumerate([(0, 120.0), (960, 60.0), (2400, 200.0)])])
    for tick in (0, 100, 960, 1500, 2400, 5000):
        sec = tl.seconds_at(t, F.lit(float(tick)), F.lit(480.0))
        assert one(spark, tl.ticks_at(t, sec, F.lit(480.0)))[0] == pytest.approx(tick)
    late = F.array(F.struct(F.lit(0).alias("ord"), F.lit(480).alias("tick"), F.lit(60.0).alias("bpm")))
    assert tuple(one(spark, tl.seconds_at(late, F.lit(400.0), F.lit(480.0)), tl.seconds_at(late, F.lit(960.0), F.lit(480.0)))) == (0.0, 1.0)


# ---- chords


def block(*groups):
    return [(p, i * BAR, BAR) for i, g in enumerate(groups) for p in g]


def found(spark, rows, resolution="measure", fifths=0):
    n = notes(spark, rows)
    got = chords.detect(n, tl.measures(tl.score_lengths(n), sigs(spark)), keys(spark, fifths), resolution).orderBy("tick").collect()
    return got


@pytest.mark.parametrize("pitches,name", [((60, 64, 67), "C"), ((57, 60, 64), "Am"), ((55, 59, 62, 65), "G7"), ((62, 66, 69, 73), "Dmaj7"), ((60, 65, 67), "Csus4"), ((60, 62, 67), "Csus2"), ((52, 60, 67), "C/E"), ((40, 47), "E5")])
def test_chord_names(spark, pitches, name):
    assert [r["name"] for r in found(spark, block(pitches))] == [name]


def test_chord_details(spark):
    assert [r["name"] for r in found(spark, block((58, 62, 65)), fifths=-2)] == ["Bb"]
    slash = found(spark, block((52, 60, 67)))[0]
    assert (slash["root"], slash["bass"]) == (0, 4)
    two = found(spark, block((60, 64, 67), (57, 60, 64)), "beat")
    assert [(r["name"], r["tick"], r["duration"]) for r in two] == [("C", 0, BAR), ("Am", BAR, BAR)]
    assert found(spark, block((60,))) == []
    assert [r["name"] for r in found(spark, [(p, i * Q // 2, Q // 2) for i, p in enumerate((60, 64, 67, 72))])] == ["C"]
    assert [r["name"] for r in found(spark, [(36, 0, BAR), (64, 0, 960), (67, 0, 960), (72, 0, 960)])] == ["C"]


@pytest.mark.parametrize("resolution", ["half", "beat"])
def test_noise_before_chords(spark, resolution):
    rows = [(p, i * Q, Q) for i, p in enumerate((60, 62, 64, 65, 67, 69, 71, 72))]
    for i, g in enumerate(((60, 64, 67), (57, 60, 64), (53, 57, 60), (55, 59, 62))):
        rows += [(p, (2 + i) * BAR, BAR) for p in g]
    assert [r["name"] for r in found(spark, rows, resolution)] == ["C", "Am", "F", "G"]


PRINTED = "score_id long, ord int, tick long, text string, root string, quality string"


def test_printed_chords(spark):
    p = spark.createDataFrame([(1, 0, 0, "Bbmaj7", "Bb", "maj7"), (1, 1, 1920, "Ebm6/F", "Eb", "m6"), (1, 2, 2880, "Gm7", "G", "m7"), (1, 3, 2880, "?", "H", "")], PRINTED)
    got = chords.printed_events(p, bars(spark, 3840)).orderBy("tick").collect()
    assert [(r["name"], r["duration"], r["root"]) for r in got] == [("Bbmaj7", 1920, 10), ("Ebm6/F", 960, 3), ("Gm7", 960, 7)]
    inferred = spark.createDataFrame([(1, float(i * 1920), 1920.0, "C", 0, "") for i in range(3)], "score_id long, tick double, duration double, name string, root int, quality string")
    shown = chords.printed_events(spark.createDataFrame([(1, 0, 1920, "Dm", "D", "m")], PRINTED), bars(spark, 5760))
    assert [r["name"] for r in chords.merged(inferred, shown, bars(spark, 5760)).orderBy("tick").collect()] == ["C", "Dm", "C"]


# ---- names and shapes


def test_diagrams():
    assert cn.frets_of("C") == [0, 1, 0, 2, 3, -1] and cn.frets_of("Am") == [0, 1, 2, 2, 0, -1]
    assert cn.frets_of("G") == [3, 0, 0, 0, 2, 3] and cn.frets_of("F") == [1, 1, 2, 3, 3, 1]
    assert cn.diagram(cn.frets_of("F#m")) | {"fingers": None} == {"frets": [2, 2, 2, 4, 4, 2], "base": 2, "barre": (2, 0, 5), "fingers": None}
    assert cn.voicing("C") == [48, 52, 55, 60, 64] and cn.voicing("nonsense") is None


@pytest.mark.parametrize("quality", [q for q in cn.TEMPLATES])
def test_shapes_hold_only_chord_tones(quality):
    for r, root in enumerate(theory.FLATS):
        frets = cn.frets_of(root + quality)
        if quality == "m9" and frets is None:
            continue
        pcs = {(p + f) % 12 for p, f in zip(STANDARD, frets) if f >= 0}
        assert r in pcs and len(pcs) >= 2 and pcs <= {(r + t) % 12 for t in cn.TEMPLATES[quality]}


def test_shapes_in_other_tunings():
    frets = cn.frets_of("D", TUNINGS["Drop D"])
    assert {(p + f) % 12 for p, f in zip(TUNINGS["Drop D"], frets) if f >= 0} == {2, 6, 9}
    low = cn.frets_of("C/D")
    strings = [(p, f) for p, f in zip(STANDARD, low) if f >= 0]
    assert (strings[-1][0] + strings[-1][1]) % 12 == 2


@pytest.mark.parametrize("name,tones,required", [("maj9", [0, 2, 4, 7, 11], [0, 2, 4, 11]), ("m7b5", [0, 3, 6, 10], [0, 3, 6, 10]), ("7#9", [0, 3, 4, 7, 10], [0, 3, 4, 10]), ("7alt", [0, 3, 4, 8, 10], [0, 3, 4, 8, 10]), ("9sus4", [0, 2, 5, 7, 10], [0, 2, 5, 10]), ("5", [0, 7], [0, 7]), ("11", [0, 2, 4, 5, 7, 10], [0, 5, 10]), ("", [0, 4, 7], [0, 4, 7]), ("mmaj7", [0, 3, 7, 11], [0, 3, 11])])
def test_qualities(name, tones, required):
    q = cn.Quality.parse(name)
    assert (q.tones, q.required) == (tones, required)
    assert cn.Quality.parse("xyz") is None and cn.Quality.parse("maj5") is None


def test_simplify():
    assert [cn.simplify(x) for x in ("D7b9b5", "Am11", "Gmadd2", "C6/9", "Hm", "Bdim7/D")] == ["D7", "Am7", "Gm", "C6", None, "Bdim7/D"]
    assert cn.parse("C6/9/E") == (0, "69", 4) and cn.parse("Caug7") is not None


def test_printed_symbols():
    assert marks.exact_symbol("Ebm6/F")[:4] == ("Ebm6/F", "Eb", "m6", "F") and marks.exact_symbol("Coda") is None
    assert marks.read_symbol("07")[0] == "C7" and marks.read_symbol("Bpmaj7")[0] == "Bbmaj7" and marks.read_symbol("C7")[4] == 1.0
    assert marks.split_symbols("Em9Am9") == ["Em9", "Am9"] and marks.split_symbols("Em9") is None
    assert [marks.other_kind(x) for x in ("12", "Swing", "z", "rit.")] == ["rehearsal", "tempo", "rehearsal", "tempo"]
    assert marks.tempo_mark("half note = 100-120") == (220.0, "half", False, 0.95) and marks.tempo_mark("12") is None


# ---- fingering


def fingered(spark, rows, guitar=tab.Guitar(), **columns):
    n = notes(spark, rows)
    for c, v in columns.items():
        n = n.withColumn(c, v)
    return tab.assign_tab(n, tl.measures(tl.score_lengths(n), sigs(spark)), guitar).orderBy("note_ord").collect()


def test_scale_and_chord(spark):
    scale = (48, 50, 52, 53, 55, 57, 59, 60, 62, 64, 65, 67, 69, 71, 72)
    got = fingered(spark, [(p, i * Q, Q) for i, p in enumerate(scale)])
    assert all(STANDARD[r["string"]] + r["fret"] == r["pitch"] and r["fret"] <= 12 for r in got)
    assert all(b["string"] <= a["string"] and abs(a["fret"] - b["fret"]) <= 9 for a, b in zip(got, got[1:]))
    got = fingered(spark, [(p, 0, Q) for p in (48, 52, 55, 60)])
    pressed = [r["fret"] for r in got if r["fret"]]
    assert len({r["string"] for r in got}) == 4 and max(pressed) - min(pressed) <= 4


def test_locks_range_and_polyphony(spark):
    low = F.col("note_ord") == 0
    got = fingered(spark, [(52, 0, Q), (64, 0, Q)], string=F.when(low, 3), fret=F.when(low, 2), tab_locked=low)
    assert (got[0]["string"], got[0]["fret"]) == (3, 2) and got[1]["string"] != 3
    got = fingered(spark, [(60, i * Q, Q) for i in range(4)] + [(96, 4 * Q, Q)])
    assert got[4]["pitch"] < 96 and got[4]["transposed"] and got[0]["warnings"] == ["Note C7 at measure 2 transposed down an octave"]
    assert [(r["string"], r["fret"]) for r in fingered(spark, [(38, 0, Q)], tab.Guitar(TUNINGS["Drop D"]))] == [(5, 0)]
    got = fingered(spark, [(40, 0, Q), (42, Q, Q), (47, 2 * Q, Q)], tab.Guitar(capo=2))
    assert all(r["fret"] >= 2 for r in got) and (got[1]["string"], got[1]["fret"]) == (5, 2) and "E2" in got[0]["warnings"][0]
    seven = fingered(spark, [(p, 0, Q) for p in (40, 47, 52, 56, 59, 64, 67)])
    assert sum(r["string"] is not None for r in seven) == 6 and "dropped" in seven[0]["warnings"][0]


def test_tied_notes_stay(spark):
    got = fingered(spark, [(64, 0, Q), (64, Q, Q)], tied_from_previous=F.col("note_ord") == 1)
    assert got[0]["string"] == got[1]["string"] and got[0]["fret"] == got[1]["fret"]


def test_ascii_tab():
    rows = [{"start": i * Q, "string": s, "fret": 0} for i, s in enumerate((0, 1, 2, 3, 4, 5, 0, 1))]
    text = render(rows, [(0, BAR), (BAR, 2 * BAR)], title="Test", per_line=1)
    assert "Test" in text and "Tuning: E A D G B E" in text and all(f"{x}|" in text for x in "eBGDAE")
    assert [x for x in text.split("\n") if x.startswith("e|")][0].startswith("e|0") and len([x for x in text.split("\n") if x.startswith("E|")]) == 2
    text = render([{"start": 0, "string": 4, "fret": 2}, {"start": 0, "string": 3, "fret": 4}], [(0, BAR)], tab.Guitar(capo=2), chords=[(0, "Bm")])
    lines = text.split("\n")
    assert "Capo: 2" in text and next(x for x in lines if x.strip() == "Bm").index("Bm") == 2 and next(x for x in lines if x.startswith("A|")).startswith("A|0")
    text = render([{"start": 0, "string": 0, "fret": 5, "articulations": ["hammer"]}, {"start": Q // 4, "string": 0, "fret": 12}], [(0, BAR)])
    assert "5h12" in next(x for x in text.split("\n") if x.startswith("e|"))
    assert grid_unit(480, [0, 160, 320]) == 40 and note_pieces(720, 480) == [(720, 4, 1, False)]


# ---- edits and accuracy


def test_library_upsert(spark):
    have = spark.createDataFrame([("a", "A", 1, 1, "t", None), ("b", "B", 2, 2, None, "p")], "id string, name string, created_at long, updated_at long, thumbnail string, preview string")
    new = spark.createDataFrame([("a", "A2", 9, None, "q"), ("c", "C", 9, None, None)], "id string, name string, saved_at long, thumbnail string, preview string")
    got = {r["id"]: tuple(r)[1:] for r in edits.upsert(have, new).collect()}
    assert got == {"a": ("A2", 1, 9, "t", "q"), "b": ("B", 2, 2, None, "p"), "c": ("C", 9, 9, None, None)}


def test_matching(spark):
    truth, read = notes(spark, [(60, 0, Q), (60, Q, Q)]), notes(spark, [(60, 10, Q), (62, Q, Q)])
    assert metrics.match_notes(truth, read, 60).count() == 1 and metrics.match_notes(truth, read, 5).count() == 0
    crowd = notes(spark, [(60, 5, Q), (60, 8, Q)])
    assert metrics.match_notes(notes(spark, [(60, 0, Q)]), crowd, 60).count() == 1
    moved = truth.withColumn("start_tick", F.col("start_tick") - 1920)
    assert metrics.best_offset(truth, moved, 60).first()["offset"] == 1920
    r = one(spark, metrics.prf(F.lit(2), F.lit(4), F.lit(2)), metrics.prf(F.lit(0), F.lit(0), F.lit(0)), metrics.prf(F.lit(0), F.lit(3), F.lit(0)))
    assert [(x["precision"], x["recall"]) for x in r][0] == (1.0, 0.5) and r[1]["f1"] == 1.0 and r[2]["f1"] == 0.0
    assert metrics.lcs([1, 2, 3, 4], [2, 4, 5]) == 2


# ---- playback, layout, audio


def test_strums_and_voices(spark):
    n = notes(spark, [(72, 0, Q), (72, BAR, Q)])
    c = spark.createDataFrame([(1, 0.0, 2.0 * BAR, "C"), (1, 2.0 * BAR, 2.0 * BAR, "G")], "score_id long, tick double, duration double, name string")
    grid = bars(spark, 4 * BAR)
    hits = [r["tick"] for r in playback.strums(n, grid, c).orderBy("tick").collect()]
    assert [sum(i * BAR <= t < (i + 1) * BAR for t in hits) for i in range(4)] == [1, 1, 4, 4]
    tempos = spark.createDataFrame([(1, 0, 0, 120.0)], "score_id long, ord int, tick long, bpm double")
    first = playback.chord_events(playback.strums(n, grid, c), tempos).orderBy("t").limit(5).collect()
    assert [r["pitch"] for r in first] == [48, 52, 55, 60, 64]
    assert all(0.012 <= b["t"] - a["t"] <= 0.02 and b["gain"] > a["gain"] for a, b in zip(first, first[1:]))
    every = playback.play_events(n.withColumn("tied_from_previous", F.lit(False)), grid, tempos, c, metronome=True)
    # The click at the end tick is heard too.
    assert every.where("kind = 'accent'").count() == 5 and every.where("kind = 'note'").count() == 2


def test_ties_sound_once(spark):
    n = notes(spark, [(60, 0, 480), (60, 481, 480), (60, 2000, 10)]).withColumn("tied_from_previous", F.col("note_ord") > 0)
    assert [(r["start_tick"], r["end_tick"]) for r in playback.sounding(n).orderBy("start_tick").collect()] == [(0, 961), (2000, 2010)]


def test_voice_lanes(spark):
    rows = spark.createDataFrame([(1, 0, 0, 960, 0), (1, 0, 0, 960, 1), (1, 0, 480, 480, 2), (1, 0, 960, 480, 3)], "score_id long, measure long, start long, dur long, ord long")
    assert [r["lane"] for r in layout.lanes(rows).orderBy("ord").collect()] == [1, 1, 2, 1]


def test_transcription():
    import numpy as np

    rate = 44100
    x = np.concatenate([0.5 * np.sin(2 * np.pi * f * np.arange(rate // 2) / rate) for f in (220, 277.18, 329.63, 440)])
    got, _ = audio.transcribe(x, rate)
    assert [n["pitch"] for n in got] == [57, 61, 64, 69]
    assert audio.transcribe(np.zeros(rate), rate) == ([], 120.0) and audio.transcribe(np.zeros(10), rate)[0] == []
    assert audio.upper_median([1, 2, 3, 4]) == 3 and audio.estimate_bpm([i * 0.5 for i in range(20)]) == 120


def test_a_score_that_cannot_be_fingered_stays_as_it_is(spark):
    from tonelake.operators import tab

    notes = spark.createDataFrame([(1, 0, 0, 60, 0, 480, 1, 3)], "score_id long, track_ord int, note_ord int, pitch int, start_tick long, duration long, string int, fret int")
    bars_of = spark.createDataFrame([(1, 1920)], "score_id long, end_tick long")
    r = tab.assign_tab(notes, bars_of, tab.Guitar(tuning=())).first()
    assert (r["pitch"], r["string"], r["fret"]) == (60, 1, 3) and r["warnings"][0].startswith("Fingering failed")


def test_clicks_on_a_page(spark):
    from tonelake.operators import layout

    boxes = spark.createDataFrame([(1, 0, 0, 0, 0.1, 0.1, 0.1, 0.1), (1, 0, 1, 480, 0.15, 0.1, 0.1, 0.1), (1, 0, 2, 960, 0.8, 0.12, 0.1, 0.1), (1, 0, 3, 1440, 0.1, 0.6, 0.1, 0.1)], "score_id long, page int, ord int, start long, x double, y double, w double, h double")
    clicks = spark.createDataFrame([(1, 0, 0, 0.16, 0.15), (1, 1, 0, 0.9, 0.3), (1, 2, 0, 0.9, 0.9), (1, 3, 7, 0.1, 0.1)], "score_id long, click int, page int, fx double, fy double")
    assert {r["click"]: r["tick"] for r in layout.tick_at_point(boxes, clicks).collect()} == {0: 0, 1: 960, 2: 1440}


def test_tab_layout(spark):
    notes = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 480, 0), (1, 2, 480, None), (1, 3, 4000, 5)], "score_id long, note_ord int, start_tick long, string int")
    bars_of = spark.createDataFrame([(1, 0, 0.0, 1920.0, 4, 4), (1, 1, 1920.0, 3840.0, 4, 4), (1, 2, 3840.0, 5280.0, 3, 4)], "score_id long, index long, start_tick double, end_tick double, numerator int, denominator int")
    page = layout.placed(bars_of, notes, 400)
    # 354 for measures of 120, 96 and 116: all in one line, stretched by 354 / 332.
    rows = {r["index"]: r for r in page.collect()}
    k = 354 / 332
    assert [rows[i]["line"] for i in range(3)] == [0, 0, 0] and [rows[i]["w"] for i in range(3)] == pytest.approx([120 * k, 96 * k, 116 * k])
    assert [rows[i]["x"] for i in range(3)] == pytest.approx([36, 36 + 120 * k, 36 + 216 * k])
    assert [tuple(p) for p in rows[0]["points"]] == [(0, 76), (480, pytest.approx(76 + 27.2)), (1920, pytest.approx(36 + 120 * k - 12))]
    assert [p["tick"] for p in rows[1]["points"]] == [1920, 3840] and [p["tick"] for p in rows[2]["points"]] == [3840, 4000, 5280]
    at = {r["note_ord"]: (r["x"], r["y"]) for r in layout.note_positions(page, notes).collect()}
    inner = 116 * k - 12 - 40
    assert at == {0: (76, 42 + 32), 1: (pytest.approx(103.2), 42), 3: (pytest.approx(36 + 216 * k + 40 + 160 / 1440 * inner), 42 + 80)}
    click = page.select("index", layout.click_tick(F.col("points"), F.lit(100.0), F.col("start_tick"), F.col("end_tick")).alias("t"))
    # 24 of 27.2 pixels into a quarter: tick 423.5, so 480 on the grid; left of the other measures.
    assert {r["index"]: r["t"] for r in click.collect()} == {0: 480, 1: 1920, 2: 3840}


def test_crowded_measures_grow(spark):
    notes = spark.createDataFrame([(1, i, i * 10, 0) for i in range(16)], "score_id long, note_ord int, start_tick long, string int")
    bars_of = spark.createDataFrame([(1, 0, 0.0, 1920.0, 4, 4), (1, 1, 1920.0, 3840.0, 4, 4)], "score_id long, index long, start_tick double, end_tick double, numerator int, denominator int")
    rows = {r["index"]: r for r in layout.placed(bars_of, notes, 300).collect()}
    # The first line holds 596 squeezed into 254; sixteen onsets need 40 + 15 * 27.2 + 12.
    assert rows[0]["w"] == pytest.approx(460) and (rows[0]["line"], rows[1]["line"]) == (0, 1) and rows[1]["x"] == 36
    assert rows[1]["w"] == pytest.approx(120) and rows[1]["staff_top"] - rows[0]["staff_top"] == 186


def test_ties_go_on_from_the_note_struck_last(spark):
    import random

    rng = random.Random(5)
    rows = [(1, i, rng.choice((60, 61)), rng.randrange(60) * 40, rng.choice((40, 120, 900)), 64, rng.random() < 0.6) for i in range(120)]
    # A long note and a short one over it: the tied note after them does not go on from the long one.
    rows += [(2, 0, 60, 0, 1920, 64, False), (2, 1, 60, 240, 240, 64, False), (2, 2, 60, 960, 240, 64, True)]
    n = spark.createDataFrame(rows, "score_id long, note_ord long, pitch int, start_tick long, duration long, velocity int, tied_from_previous boolean")
    want, last = [], {}
    for score, _, pitch, start, size, _, tied in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        chain = last.get((score, pitch))
        if tied and chain and chain[3] >= start - 2:
            chain[3] = max(chain[3], start + size)
        else:
            last[score, pitch] = chain = [score, pitch, start, start + size]
            want.append(chain)
    got = [[r["score_id"], r["pitch"], r["start_tick"], r["end_tick"]] for r in playback.sounding(n).collect()]
    assert sorted(got) == sorted(want) and [2, 60, 960, 1200] in got


def test_short_notes_are_heard():
    import numpy as np

    rate = 44100
    tone = lambda hz, sec: 0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * sec)) / rate)
    x = np.concatenate([tone(220, 0.5), tone(392, 0.09), tone(220, 0.5)])
    got, _ = audio.transcribe(x, rate, 120)
    assert [n["pitch"] for n in got] == [57, 67, 57]


def test_clicks_follow_the_signature_in_force(spark):
    ends = spark.createDataFrame([(1, 4000), (2, 959), (3, 0)], "score_id long, end_tick long")
    meters = spark.createDataFrame([(1, 0, 0, 3, 4), (1, 1, 1600, 6, 8), (1, 2, 9000, 2, 2), (2, 0, 0, 2, 2)], "score_id long, ord int, tick long, numerator int, denominator int")
    tempos = spark.createDataFrame([(s, 0, 0, 125.0) for s in (1, 2, 3)], "score_id long, ord int, tick long, bpm double")  # 1,000 ticks a second
    got = {}
    for r in playback.clicks(ends, meters, tempos).orderBy("t").collect():
        got.setdefault(r["score_id"], []).append((round(r["t"] * 1000), r["kind"]))
    assert got[2] == [(0, "accent"), (480, "click")] and got[3] == [(0, "accent")]
    # Quarters until the one that finds 6/8 in force, eighths from there; measures of 6/8 count from tick 1600, which no click meets.
    assert got[1] == [(0, "accent"), (480, "click"), (960, "click"), (1440, "accent")] + [(t, "click") for t in range(1920, 4001, 240)]
