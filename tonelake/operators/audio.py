"""Melody transcription from samples: framing, pitch, notes, tempo.

Frames are numpy views; the pitch of a frame is found by the normalised
square difference function of McLeod and Wyvill's published method, through
an FFT.  A recording is one task: each stage needs the one before whole.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
FRAME, STEP = 2048, 512
CLEAR, LOW_HZ, HIGH_HZ = 0.9, 30.0, 4500.0
LEAST_SEC = 0.04
RATE = 44100
PPQ, GRID = 480, 120


def wav_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1, the mean of the channels, and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - (b[:, 2] >> 7 << 24)) / 2.0**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(1), rate


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at the rate ``to``, along straight lines; frames are that many samples long at one rate only."""
    if rate == to or not len(x):
        return x
    return np.interp(np.arange(len(x) * to // rate) * (rate / to), np.arange(len(x)), x)


def pitch(frames: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Hz and clarity of each frame; the first key maximum near the largest decides."""
    n = frames.shape[1]
    spectrum = np.fft.rfft(frames, 2 * n, axis=1)
    auto = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :n]
    squares = np.cumsum(frames**2, axis=1)
    energy = np.empty_like(auto)
    energy[:, 0] = 2 * squares[:, -1]
    energy[:, 1:] = squares[:, -1:] - squares[:, : n - 1] + squares[:, n - 2 :: -1][:, : n - 1]
    nsdf = np.divide(2 * auto, energy, out=np.zeros_like(auto), where=energy > 1e-12)
    hz, clear = np.zeros(len(frames)), np.zeros(len(frames))
    for i, d in enumerate(nsdf):
        rises = np.flatnonzero((d[:-1] <= 0) & (d[1:] > 0)) + 1
        falls = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
        keys = []
        for a in rises:
            stop = falls[falls > a]
            b = stop[0] if len(stop) else n
            k = a + int(d[a:b].argmax())
            if 0 < k < n - 1:
                keys.append(k)
        if not keys:
            continue
        top = max(d[k] for k in keys)
        k = next(k for k in keys if d[k] >= 0.9 * top)
        left, mid, right = d[k - 1 : k + 2]
        bend = left - 2 * mid + right
        shift = 0.5 * (left - right) / bend if bend else 0.0
        hz[i], clear[i] = rate / (k + shift), min(1.0, mid - 0.25 * (left - right) * shift)
    return hz, clear


def upper_median(values) -> float:
    s = sorted(values)
    return s[len(s) // 2]


def estimate_bpm(onsets: list[float]) -> int:
    """The tempo of 60 to 180 whose beat the onset intervals fit best; 120 with too few."""
    if len(onsets) < 3:
        return 120
    one = [b - a for a, b in zip(onsets, onsets[1:]) if b - a > 0.05]
    two = [b - a for a, b in zip(onsets, onsets[2:]) if b - a < 2]
    gaps = np.array(one + two)
    if not len(gaps):
        return 120
    bpm = np.arange(60, 181)
    turn = 2 * np.pi * gaps[None, :] * bpm[:, None] / 60
    fit = (np.cos(turn) + 0.5 * np.cos(2 * turn)).sum(1) / len(gaps) - np.abs(bpm - 110) / 5000
    return int(bpm[fit.argmax()])


def segments(midi: np.ndarray, exact: np.ndarray, rms: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges of notes: cut at silence, at jumps in energy and at lasting changes of pitch."""
    n, out, start = len(midi), [], None
    jump = max(0.1 * rms.max(initial=0.0), 0.005)
    for f in range(n):
        if midi[f] < 0:
            if start is not None:
                out.append((start, f))
            start = None
            continue
        if start is None:
            start = f
            continue
        louder = rms[f] - rms[f - 1] > jump and rms[f] > 1.5 * rms[f - 1]
        other = midi[f] != midi[start] and (abs(exact[f] - midi[start]) > 0.6 or midi[f] != midi[f - 1])
        lasts = other and (midi[f : f + 3] == midi[f]).sum() >= min(3, n - f)
        if louder or lasts:
            out.append((start, f))
            start = f
    return out + ([(start, n)] if start is not None else [])


def quantize(notes: list[tuple[float, float, int, float]], bpm: float) -> list[dict]:
    """Sixteenths that do not overlap: each note moves clear of the one before as that was moved."""
    out: list[dict] = []
    ticks = lambda s: int(s * bpm * PPQ / 60 / GRID + 0.5) * GRID
    for a, b, midi, clear in notes:
        start, size = ticks(a), max(GRID, ticks(b - a))
        if out:
            last = out[-1]
            start = max(start, last["start"] + GRID)
            if start < last["start"] + last["duration"]:
                last["duration"] = max(GRID, start - last["start"])
        out.append({"start": start, "duration": size, "pitch": midi, "confidence": clear})
    return out


def transcribe(samples: np.ndarray, rate: int, bpm: float | None = None) -> tuple[list[dict], float]:
    """Quantised notes of a melody and its tempo."""
    x = np.asarray(samples, np.float64)
    if len(x) < FRAME:
        return [], bpm or 120.0
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::STEP]
    rms = np.sqrt((frames**2).mean(1))
    loud = rms > max(0.01, 0.05 * rms.max())
    exact, clear = np.full(len(frames), np.nan), np.zeros(len(frames))
    for at in range(0, len(frames), 256):
        part = np.flatnonzero(loud[at : at + 256]) + at
        if len(part):
            hz, clear[part] = pitch(frames[part], rate)
            ok = (clear[part] > CLEAR) & (hz > LOW_HZ) & (hz < HIGH_HZ)
            exact[part[ok]] = 69 + 12 * np.log2(hz[ok] / 440)
    midi = np.full(len(frames), -1)
    for f in np.flatnonzero(~np.isnan(exact)):
        near = exact[max(0, f - 2) : f + 3]
        midi[f] = int(math.floor(upper_median(near[~np.isnan(near)]) + 0.5))
    least = max(1, math.ceil(LEAST_SEC * rate / STEP))
    sec = lambda f: (f * STEP + FRAME / 2) / rate
    raw = [(sec(a), sec(b), int(upper_median(midi[a:b])), float(min(1.0, clear[a:b].mean()))) for a, b in segments(midi, exact, rms) if b - a >= least]
    tempo = bpm or float(estimate_bpm([r[0] for r in raw]))
    return quantize(raw, tempo), tempo


NOTES = "score_id long, note_ord int, pitch int, start_tick long, duration long, confidence double, bpm double"


def transcribe_all(recordings: DataFrame) -> DataFrame:
    """Notes of ``(score_id, wav)`` recordings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sid, data in zip(b["score_id"], b["wav"]):
                notes, bpm = transcribe(resampled(*wav_samples(data)), RATE)
                rows += [(sid, i, n["pitch"], n["start"], n["duration"], n["confidence"], bpm) for i, n in enumerate(notes)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NOTES.split(", ")])

    return recordings.select("score_id", F.col("wav")).mapInPandas(run, NOTES)
