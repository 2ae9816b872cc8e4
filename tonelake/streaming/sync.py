"""Keeping a video and the transport in step, as a state machine over an event log.

The transport leads: its commands drive the video, and drift is corrected.
The video's own controls drive the transport.  What the machine caused itself
comes back as an echo within a while and is not taken for a user's action.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds.
DRIFT, JUMP, SETTLE, ECHO, LOADING = 0.25, 1.5, 1.0, 1.5, 2.5


def nearest_rate(rates: list[float], want: float) -> float:
    return min(rates, key=lambda r: abs(r - want)) if rates else 1.0


@dataclass
class Sync:
    """State between events; times in seconds."""

    start: float = 0.0
    settled: float = 0.0
    video_echo: tuple[str, float] | None = None
    echoes: list[tuple[str, float]] = field(default_factory=list)
    parked: bool = False
    last: float = 0.0
    played: tuple[float, float] | None = None

    def _seek_video(self, now: float, to: float) -> tuple[str, float]:
        self.last, self.settled = to, now + SETTLE
        return "video_seek", to

    def _video(self, now: float, state: str) -> tuple[str, None]:
        self.video_echo = (state, now + ECHO)
        return f"video_{'play' if state == 'playing' else 'pause'}", None

    def _transport(self, now: float, kind: str, to: float | None = None) -> tuple[str, float | None]:
        self.echoes = [e for e in self.echoes if e[1] > now] + [(kind, now + ECHO)]
        return f"transport_{kind}", to

    def _join(self, now: float, vt: float) -> list:
        self.parked, self.played = False, (max(0.0, vt - self.start), now)
        return [self._transport(now, "play", self.played[0])]

    def on_transport(self, now: float, kind: str, sec: float, playing: bool) -> list:
        moves = ("play", "seek")
        self.echoes = [e for e in self.echoes if e[1] > now]
        echo = next((e for e in self.echoes if e[0] == kind or (e[0] in moves and kind in moves)), None)
        if echo:
            self.echoes.remove(echo)
            return []
        self.parked = False
        if kind == "play":
            self.played = (sec, now)
            return [self._seek_video(now, self.start + sec), self._video(now, "playing")]
        if kind == "seek":
            return [self._seek_video(now, self.start + sec)] + ([self._video(now, "playing")] if playing else [])
        self.played = None
        return [self._video(now, "paused")]

    def on_video(self, now: float, state: str, vt: float, playing: bool) -> list:
        if self.video_echo and now < self.video_echo[1] and self.video_echo[0] == state:
            self.video_echo = None
            return []
        if state == "playing" and not playing:
            if vt >= self.start:
                return self._join(now, vt)
            self.parked = True
            return [self._transport(now, "seek", 0.0)]
        if state in ("paused", "ended"):
            self.parked = False
            return [self._transport(now, "pause")] if playing else []
        return []

    def _scrub(self, now: float, vt: float, playing: bool, running: bool) -> list:
        self.settled, self.last = now + SETTLE, vt
        to = vt - self.start
        if to < 0:
            self.parked = True
            return ([self._transport(now, "pause")] if playing else []) + [self._transport(now, "seek", 0.0)]
        if self.parked and not playing and running:
            return self._join(now, vt)
        self.parked = False
        return [self._transport(now, "seek", to)]

    def on_tick(self, now: float, vt: float, state: str, sec: float, playing: bool) -> list:
        running, was = state == "playing", self.last
        if now < self.settled:
            self.last = vt
            return []
        if self.parked:
            self.last = vt
            if running and vt >= self.start:
                return self._join(now, vt)
            return self._scrub(now, vt, playing, running) if abs(vt - was) > JUMP and not running else []
        if not playing:
            if abs(vt - was) > JUMP:
                return self._scrub(now, vt, playing, running)
            self.last = vt
            return []
        if self.played and sec == self.played[0] and now - self.played[1] < LOADING:
            self.last = vt
            return []
        if not running:
            return []
        off = vt - (self.start + sec)
        self.last = vt
        if abs(off) > JUMP:
            return self._scrub(now, vt, playing, running)
        if abs(off) > DRIFT:
            return [self._seek_video(now, self.start + sec)]
        return []

    def step(self, e: dict) -> list:
        if e["kind"] == "tick":
            return self.on_tick(e["now"], e["video"], e["state"], e["sec"], e["playing"])
        if e["kind"] == "video":
            return self.on_video(e["now"], e["state"], e["video"], e["playing"])
        return self.on_transport(e["now"], e["kind"], e["sec"], e["playing"])

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Sync:
        d = json.loads(text)
        pair = lambda x: tuple(x) if x else None
        return cls(**{**d, "video_echo": pair(d["video_echo"]), "echoes": [tuple(x) for x in d["echoes"]], "played": pair(d["played"])})


EVENT = "session long, n long, now double, kind string, video double, state string, sec double, playing boolean"
COMMAND = "session long, n long, command string, value double"


def _run(machine: Sync, session: int, events: Iterable[dict]) -> list[tuple]:
    return [(session, e["n"], c, v) for e in events for c, v in machine.step(e)]


def replay(events: DataFrame) -> DataFrame:
    """Commands for logged events, one session a task, in order of ``n``."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n", kind="stable")
        return pd.DataFrame(_run(Sync(), int(p["session"].iloc[0]), p.to_dict("records")), columns=["session", "n", "command", "value"])

    return events.groupBy("session").applyInPandas(one, COMMAND)


def follow(events: DataFrame) -> DataFrame:
    """The same over a stream of events; a session's machine is kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Sync.load(state.get[0]) if state.exists else Sync()
        p = pd.concat(list(batches)).sort_values("n", kind="stable")
        rows = _run(machine, int(key[0]), p.to_dict("records"))
        state.update((machine.dump(),))
        yield pd.DataFrame(rows, columns=["session", "n", "command", "value"])

    return events.groupBy("session").applyInPandasWithState(one, COMMAND, "machine string", "append", GroupStateTimeout.NoTimeout)


def saves(edits: DataFrame, quiet: str = "1 second") -> DataFrame:
    """Streaming autosave: an edit burst ``(score_id, at)`` ends when ``quiet`` passes without an edit."""
    return edits.withWatermark("at", quiet).groupBy("score_id", F.session_window("at", quiet)).agg(F.count("*").alias("edits"), F.max("at").alias("saved_edit"))
