"""Chord detection, printed chords, strum charts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chord_names import TEMPLATES, chord_name
from ..functions.theory import pitch_class
from ..session import written
from . import timeline as tl

QUALITIES = tuple(TEMPLATES)
# Fixed values.
CHARACTERISTIC = {"sus2": 2, "sus4": 5, "add9": 2, "6": 9, "m6": 9, "9": 2, "m9": 2}
EXTENDED = ("maj7", "m7", "7", "m7b5", "dim7", "sus2", "sus4", "add9", "6", "m6", "9", "m9")
WEAK_FIFTH = ("dim", "aug", "m7b5", "dim7")
LEAST_SCORE, PRESENT = 0.35, 0.02


def profiles(notes: DataFrame, wins: DataFrame) -> DataFrame:
    """One row per window that has notes.

    ``hist`` is the 12 bins of sounding ticks, ``pitches`` the distinct
    pitches, ``held`` the ticks of each, ``bass`` the lowest pitch that
    overlaps enough, ``together`` the ticks with two or more notes sounding.
    """
    pairs = tl.overlaps(notes, wins)
    pairs = pairs.withColumn("a", F.greatest(F.col("start_tick").cast("double"), "w_start")).withColumn("b", F.least(F.col("note_end").cast("double"), "w_end"))
    key = ["score_id", "measure", "w", "w_start", "w_end"]
    # Two levels: pitches first, so that a window's bins are sums of few rows.
    by_pitch = pairs.groupBy(*key, "pitch").agg(
        F.sum("ov").alias("ticks"), F.collect_list(F.struct("a", "b")).alias("spans"),
        F.max((F.col("ov") >= (F.col("w_end") - F.col("w_start")) * 0.2) | (F.col("ov") >= 1)).alias("firm"),
    )
    bins = [F.coalesce(F.sum(F.when(pitch_class(F.col("pitch")) == i, F.col("ticks"))), F.lit(0.0)) for i in range(12)]
    rows = by_pitch.groupBy(*key).agg(
        F.array(*bins).alias("hist"), F.sort_array(F.collect_list(F.struct("pitch", "ticks"))).alias("held"),
        F.min(F.when(F.col("firm"), F.col("pitch"))).alias("bass"), F.flatten(F.collect_list("spans")).alias("spans"),
    )
    return rows.select(*key, "hist", F.transform("held", lambda x: x["pitch"]).alias("pitches"), F.transform("held", lambda x: x["ticks"]).alias("held"), "bass", together(F.col("spans")).alias("together"))


def together(spans: Column) -> Column:
    """Ticks during which at least two of ``array<struct<a, b>>`` overlap."""
    marks = F.flatten(F.transform(spans, lambda s: F.array(F.struct(s["a"].alias("t"), F.lit(1).alias("d")), F.struct(s["b"].alias("t"), F.lit(-1).alias("d")))))

    def step(acc: Column, m: Column) -> Column:
        return F.struct((acc["n"] + m["d"]).alias("n"), m["t"].alias("t"), (acc["sum"] + F.when(acc["n"] >= 2, m["t"] - acc["t"]).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.sort_array(marks), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("t"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


class _Candidates:
    """The 204 candidates (root, quality) in order, as arrays a batch of windows is judged with."""

    def __init__(self) -> None:
        pairs = [(root, q) for root in range(12) for q in QUALITIES]
        most = max(map(len, TEMPLATES.values()))
        self.tones = np.array([[(pc - root) % 12 in {t % 12 for t in TEMPLATES[q]} for pc in range(12)] for root, q in pairs], float)
        self.at, self.lost = np.zeros((most, len(pairs)), int), np.zeros((most, len(pairs)))
        for c, (root, q) in enumerate(pairs):
            for k, iv in enumerate(TEMPLATES[q]):
                self.at[k, c] = (root + iv) % 12
                self.lost[k, c] = 0.45 if iv == 0 else (0.3 if q in WEAK_FIFTH else 0.1) if iv == 7 else 0.3 if q in ("sus2", "sus4") or iv in (3, 4) else 0.35
        self.root = np.array([root for root, _ in pairs])
        self.marked = np.array([q in CHARACTERISTIC for _, q in pairs])
        self.mark = np.array([(root + CHARACTERISTIC.get(q, 0)) % 12 for root, q in pairs])
        self.size = np.array([0.01 * len(TEMPLATES[q]) for _, q in pairs])
        self.low = np.zeros((13, len(pairs)))  # by bass, the last row without one
        for bass in range(12):
            self.low[bass] = np.where(self.root == bass, 0.15, np.where(self.tones[:, bass] > 0, 0.04, -0.05))
        # Thirds (or what stands for them) and fifths, as masks of pitch classes.
        thirds = [{3, 4} | ({2} if q == "sus2" else {5} if q == "sus4" else set()) for _, q in pairs]
        masked = lambda wanted: np.array([[(pc - root) % 12 in w & {t % 12 for t in TEMPLATES[q]} for pc in range(12)] for (root, q), w in zip(pairs, wanted)])
        self.third, self.fifth = masked(thirds), masked([{6, 7, 8}] * len(pairs))

    def _sums(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sound inside and outside each candidate; bins are added in order, so sums are the same whatever the batch."""
        match, non = np.zeros((len(hist), len(self.root))), np.zeros((len(hist), len(self.root)))
        for pc in range(12):
            match += hist[:, pc, None] * self.tones[:, pc]
            non += hist[:, pc, None] * (1 - self.tones[:, pc])
        return match, non

    def scores(self, hist: np.ndarray, bass: np.ndarray) -> np.ndarray:
        """``(windows, 204)`` scores of normalised histograms; ``bass`` -1 if none."""
        match, non = self._sums(hist)
        s, there = match - 0.5 * non, hist > PRESENT
        for at, lost in zip(self.at, self.lost):
            s -= np.where(there[:, at], 0.0, lost)
        s -= np.where(self.marked & (hist[:, self.mark] < 0.6 * hist[:, self.root]), 0.3, 0.0)
        return s - self.size + self.low[bass]

    def concentrated(self, hist: np.ndarray, ticks: np.ndarray) -> np.ndarray:
        """``(windows, 204)``: nearly all sound is the candidate's, with its root, third and fifth.

        Three quarters are told by ``ticks``, whose sums are exact: sums of the shares ``hist`` miss the limit by rounding.
        """
        match, non = self._sums(ticks)
        there = hist > PRESENT
        count = lambda mask: there.astype(int) @ mask.T.astype(int)
        return (match >= 3 * non) & (count(self.tones > 0) >= 3) & there[:, self.root] & (count(self.third) > 0) & (count(self.fifth) > 0)


_ALL = _Candidates()
_TRIADS = np.array([c for c in range(len(_ALL.root)) if QUALITIES[c % len(QUALITIES)] in ("", "m")])


def _ticks(p: pd.DataFrame) -> np.ndarray:
    return np.stack(p["hist"].to_numpy()).astype(float)


def _shares(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised histograms, their totals, the lowest firm pitch (-1 if none) and its class, of a batch of windows."""
    hist = _ticks(p)
    total = np.zeros(len(p))
    for pc in range(12):
        total = total + hist[:, pc]
    bass = p["bass"].fillna(-1).to_numpy(float).astype(int)
    return hist / np.where(total > 0, total, 1.0)[:, None], total, bass, np.where(bass < 0, -1, bass % 12)


def judged(rows: DataFrame) -> DataFrame:
    """``(score_id, measure, w, scores, concentrated)`` of :func:`profiles`: one number and one flag for each of the 204 candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                share, _, _, bass = _shares(p)
                yield p[["score_id", "measure", "w"]].assign(scores=list(_ALL.scores(share, bass)), concentrated=list(_ALL.concentrated(share, _ticks(p))))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("score_id", "measure", "w", "hist", "bass").mapInPandas(run, f"score_id {kinds['score_id']}, measure {kinds['measure']}, w {kinds['w']}, scores array<double>, concentrated array<boolean>")


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ordered pass over windows, score by score: argmax, preference for triads, hysteresis, merging.

    A batch is judged at once; from one window to the next only the last
    choice and the event that may go on are kept.
    """
    quality_of = lambda c: QUALITIES[c % len(QUALITIES)]
    score, before, last_w, event = None, None, None, None
    columns = ["score_id", "tick", "duration", "name", "root", "quality", "bass", "pitches"]
    for p in batches:
        if not len(p):
            continue
        share, total, bass, bass_pc = _shares(p)
        start, end = p["w_start"].to_numpy(float), p["w_end"].to_numpy(float)
        length, sounding = end - start, p["together"].to_numpy(float)
        usable = ~((total < length * 0.3) | ((share > 0).sum(1) < 2) | (length <= 0))
        scores, firm = _ALL.scores(share, bass_pc), _ALL.concentrated(share, _ticks(p))
        best, triad = scores.argmax(1), _TRIADS[scores[:, _TRIADS].argmax(1)]
        ids, flats, pitches_of, held_of = p["score_id"].to_list(), p["flats"].to_list(), p["pitches"].to_list(), p["held"].to_list()
        done = []
        for k in range(len(p)):
            if ids[k] != score:
                done += [event] if event else []
                score, before, last_w, event = ids[k], None, None, None
            if last_w is not None and start[k] != last_w:  # windows without notes are rejected windows
                before = None
            last_w = end[k]
            s, choice = scores[k], int(best[k])
            if not usable[k] or s[choice] < LEAST_SCORE:
                before = None
                continue
            if quality_of(choice) in EXTENDED and s[triad[k]] >= s[choice] - 0.15 * abs(s[choice]):
                choice = int(triad[k])
            if before is not None and before != choice and s[before] >= s[choice] - 0.1 * abs(s[choice]):
                choice = before
            if sounding[k] < length[k] * 0.1 and not firm[k, choice]:
                before = None
                continue
            before = choice
            root, quality = choice // len(QUALITIES), quality_of(choice)
            pitches, held, low = list(pitches_of[k]), list(held_of[k]), int(bass[k])
            deep = low >= 0 and held[pitches.index(low)] >= length[k] * 0.5 and all(x - low >= 3 for x in pitches if x != low)
            slash = int(bass_pc[k]) if deep else None
            name = chord_name(root, quality, slash, bool(flats[k]))
            if event and event[3] == name and event[1] + event[2] == start[k]:
                event[2] += length[k]
                event[7] = sorted({*event[7], *pitches})
            else:
                done += [event] if event else []
                event = [score, start[k], length[k], name, root, quality, slash if "/" in name else None, pitches]
        yield _events(done, columns)
    yield _events([event] if event else [], columns)


def _events(rows: list, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.assign(bass=out["bass"].astype("Int64"))


CHORDS = "score_id long, tick double, duration double, name string, root int, quality string, bass int, pitches array<int>"


def _guarded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """:func:`_choose` score by score, with ``error``: a score that fails is one row that says why, and the others go on."""

    def scores() -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for p in batches:
            for sid, part in p.groupby("score_id", sort=False):
                if held and held[0]["score_id"].iloc[0] != sid:
                    yield pd.concat(held)
                    held = []
                held.append(part)
        if held:
            yield pd.concat(held)

    for p in scores():
        try:
            out = pd.concat(list(_choose(iter([p])))).assign(error=None)
        except Exception as e:  # a score that holds nonsense is a row, not a failed job
            none = dict.fromkeys(("tick", "duration", "name", "root", "quality", "bass", "pitches"))
            out = pd.DataFrame([{"score_id": p["score_id"].iloc[0], **none, "error": f"Chord detection failed: {e or type(e).__name__}"}])
            out = out.assign(root=out["root"].astype("Int64"), bass=out["bass"].astype("Int64"), tick=out["tick"].astype(float), duration=out["duration"].astype(float))
        yield out


def _ordered(notes: DataFrame, bars: DataFrame, keys: DataFrame, resolution: str, ppq: int) -> DataFrame:
    rows = profiles(notes, tl.windows(bars, resolution, ppq))
    rows = rows.join(tl.change_lists(keys, ["fifths"], "keys"), "score_id", "left")
    rows = rows.withColumn("flats", F.coalesce(tl.as_of(F.col("keys"), F.col("w_start"))["fifths"] < 0, F.lit(False))).drop("keys")
    return rows.repartition("score_id").sortWithinPartitions("score_id", "w_start")


def detect_or_keep(notes: DataFrame, bars: DataFrame, keys: DataFrame, earlier: DataFrame | None = None, resolution: str = "beat", ppq: int = 480) -> tuple[DataFrame, DataFrame]:
    """``(chords, warnings)``: as :func:`detect`, but a score whose windows cannot be judged keeps its ``earlier`` chords and gets a warning ``(score_id, text)``.

    The pass is run once and written to the shared folder, as both results read it.
    """
    seen = written(_ordered(notes, bars, keys, resolution, ppq).mapInPandas(_guarded, f"{CHORDS}, error string"))
    bad = seen.where("error is not null").select("score_id", F.col("error").alias("text"))
    chords = seen.where("error is null").drop("error")
    if earlier is not None:
        chords = chords.unionByName(earlier.select(*chords.columns).join(bad.select("score_id"), "score_id", "left_semi"))
    return chords, bad


def detect(notes: DataFrame, bars: DataFrame, keys: DataFrame, resolution: str = "beat", ppq: int = 480) -> DataFrame:
    """Chords inferred from notes.

    Windows, overlaps and histograms are joins and sums; only the ordered pass
    over the windows, one row each, reads a partition in order.
    """
    return _ordered(notes, bars, keys, resolution, ppq).mapInPandas(_choose, CHORDS)


def printed_events(printed: DataFrame, bars: DataFrame) -> DataFrame:
    """Printed chords as events: each holds until the next later tick or the end of the last measure with one."""
    rows = printed.withColumn("tick", F.col("tick").cast("double"))
    last = rows.groupBy("score_id").agg(F.max("tick").alias("tick"))
    ends = bars.groupBy("score_id").agg(F.max("end_tick").alias("score_end"))
    stop = tl.locate(last, bars).join(ends, "score_id").select("score_id", F.coalesce("measure_end", "score_end").alias("stop"))
    nexts = rows.select("score_id", "tick").distinct().withColumn("next", F.lead("tick").over(Window.partitionBy("score_id").orderBy("tick")))
    rows = rows.join(nexts, ["score_id", "tick"]).join(stop, "score_id")
    pc = lambda c: F.when(F.substring(c, 1, 1).isin(list("CDEFGAB")), F.pmod(F.element_at(F.create_map(*[F.lit(x) for kv in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for x in kv]), F.substring(c, 1, 1)) + F.when(F.substring(c, 2, 1) == "#", 1).when(F.substring(c, 2, 1) == "b", -1).otherwise(0), F.lit(12)))
    until = F.coalesce("next", F.greatest(F.col("stop"), F.col("tick") + 1))
    return rows.select("score_id", "ord", "tick", F.greatest(F.lit(1.0), until - F.col("tick")).alias("duration"), F.col("text").alias("name"), pc(F.col("root")).cast("int").alias("root"), "quality").where("root is not null")


def merged(inferred: DataFrame, shown: DataFrame, bars: DataFrame) -> DataFrame:
    """Inferred chords outside measures with a printed one, and the printed ones."""
    spots = tl.locate(shown, bars).where("measure is not null").select("score_id", "measure").distinct()
    kept = tl.locate(inferred, bars).join(spots, ["score_id", "measure"], "left_anti")
    columns = ["score_id", "tick", "duration", "name", "root", "quality"]
    return kept.select(*columns, F.lit(False).alias("printed")).unionByName(shown.select(*columns, F.lit(True).alias("printed")))


def strum_cells(bars: DataFrame, chords: DataFrame, ppq: int = 480) -> DataFrame:
    """``(score_id, line, tick, chord)``: per beat the first chord that starts in it, else the latest printed one that still sounds."""
    cells = tl.windows(bars, "beat", ppq).select("score_id", "measure", F.expr("measure div 4").alias("line"), F.col("w_start").alias("tick"), F.col("w_start"), F.col("w_end"))
    spans = chords.select("score_id", F.col("tick").alias("start_tick"), F.col("duration"), "name", "printed")
    hits = tl.overlaps(spans, cells.select("score_id", "w_start", "w_end"))
    own = F.min(F.when(F.col("start_tick") >= F.col("w_start"), F.struct("start_tick", "name")))
    held = F.max(F.when(F.col("printed") & (F.col("start_tick") < F.col("w_start")), F.struct("start_tick", "name")))
    found = hits.groupBy("score_id", F.col("w_start").alias("tick")).agg(F.coalesce(own, held).getField("name").alias("chord"))
    return cells.select("score_id", "line", "tick").join(found, ["score_id", "tick"], "left")
