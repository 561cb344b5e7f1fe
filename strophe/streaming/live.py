"""Live refreshes of a stream of notes, keyed by session.

Every ``step`` seconds of a session a refresh looks at the notes of the last 24
seconds and merges tempo and beats into what is committed, as the batch replay
does (``tracking.Refresher`` is the same code).  A session is a candidate until
its notes cover enough of some window; after that it asks for a pause when its
last five seconds are nearly empty.  State holds those seconds of notes and the
last minute of tempo and beats, so it does not grow with a session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strophe.operators.kernels import first_window
from strophe.operators.sessions import PAUSE_BELOW, STEP_S, WINDOW_S
from strophe.operators.tracking import CONTEXT_S, Refresher

KEPT_S = 60.0
ROWS = "at_s double, candidate boolean, valid_from double, coverage double, pause boolean, bpm double, tempo_points int, meter int, beats int, last_beat_s double"


class Live:
    """One session: notes come in by start, refreshes go out in order."""

    def __init__(self, state: dict | None = None, step: float = STEP_S):
        s = state or {}
        self.step, self.at = step, s.get("at", 0.0)
        self.notes = [tuple(n) for n in s.get("notes", [])]
        self.valid = s.get("valid")
        self.refresher = Refresher([tuple(p) for p in s.get("tempo", [])], s.get("beats"), s.get("memory"))

    def state(self) -> dict:
        r, oldest = self.refresher, self.at - KEPT_S
        return {
            "at": self.at,
            "notes": [n for n in self.notes if n[1] > self.at - CONTEXT_S],
            "valid": self.valid,
            "tempo": [p for p in r.tempo if p[0] >= oldest],
            "beats": [b for b in r.beats if b["time_s"] >= oldest],
            "memory": r.memory_state(),
        }

    def take(self, rows: list[tuple[float, float, int]]) -> list[tuple]:
        """Notes (start, end, pitch) of a batch; a row for each refresh up to
        the latest start."""
        self.notes = sorted(self.notes + rows)
        out = []
        while self.notes and self.at + self.step <= self.notes[-1][0]:
            self.at += self.step
            out.append(self.refresh())
        return out

    def refresh(self) -> tuple:
        now = self.at
        seen = [(a, min(b, now), p) for a, b, p in self.notes if a <= now and b > a]
        start, end, pitch = (np.array([n[i] for n in seen], float if i < 2 else int) for i in range(3))
        self.refresher.take(start, end, pitch, now)
        if self.valid is None:
            self.valid = first_window(start, end, now)[0]
        lo = max(0.0, now - WINDOW_S)
        covered, reach = 0.0, lo
        for a, b, _ in seen:
            covered += max(0.0, b - max(a, reach))
            reach = max(reach, b)
        coverage = covered / (now - lo)
        tempo, beats = self.refresher.tempo, self.refresher.beats
        pause = self.valid is not None and now >= WINDOW_S and coverage < PAUSE_BELOW
        return (now, self.valid is None, self.valid, coverage, pause, tempo[-1][1] if tempo else None, len(tempo), max((b["beat_in_bar"] for b in beats[-12:]), default=None), len(beats), beats[-1]["time_s"] if beats else None)


def refreshes(notes: DataFrame, step: float = STEP_S) -> DataFrame:
    """session_id and ``ROWS`` for each refresh, from a stream of (session_id,
    start_s, end_s, midi_note).  Counts are of what state holds; rows with a
    null are left out, and rows of one batch may come in any order."""
    kind = notes.schema["session_id"].dataType.simpleString()
    names = ["session_id", *(c.split()[0] for c in ROWS.split(", "))]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = Live(json.loads(state.get[0]) if state.exists else None, step)
        pdf = pd.concat(list(frames))
        out = live.take(list(zip(pdf["start_s"].tolist(), pdf["end_s"].tolist(), pdf["midi_note"].astype(int).tolist(), strict=True)))
        state.update((json.dumps(live.state()),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=names)

    whole = notes.select("session_id", "start_s", "end_s", "midi_note").na.drop()
    return whole.groupBy("session_id").applyInPandasWithState(run, f"session_id {kind}, {ROWS}", "state string", "append", GroupStateTimeout.NoTimeout)
