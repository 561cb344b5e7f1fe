"""Recording sessions from a stream of signal blocks and commands.

In mode "auto" a device's blocks start a session after 0.6 s of signal and end
it after 3 s of silence, and sessions under 20 s are dropped; mode "on" records
until told otherwise, "off" not at all.  "pause" closes the session and ignores
blocks captured in the next 3 s; then the device is in mode "auto".  State is
one small row a device, so it does not grow with a session.  ``segment`` is the
plain machine; ``sessions`` runs it in a stream, keyed by device.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MODES, LABELS = ("on", "off", "auto"), ("human", "non_human", "none")


@dataclass
class Limits:
    threshold_db: float = -48.0
    trigger_s: float = 0.6
    end_silence_s: float = 3.0
    least_s: float = 20.0
    pre_roll_s: float = 2.0
    cooldown_s: float = 3.0


@dataclass
class Machine:
    """Times of an open session, runs of signal and silence so far, and what
    commands have set."""

    start_s: float = -1.0
    signal_s: float = 0.0
    silence_s: float = 0.0
    last_s: float = 0.0
    seen_s: float = -1.0
    ring_s: float = 0.0
    resume_s: float = 0.0
    mode: str = "auto"
    opened: str = "auto"
    label: str = "none"

    def take(self, at: float, length: float, level_db: float, limits: Limits) -> tuple | None:
        """Feed a block; the session that it closes, if any."""
        if at <= self.seen_s:
            return None
        self.seen_s = at
        if self.mode == "off" or at < self.resume_s:
            self.signal_s = self.ring_s = 0.0
            return None
        signal = level_db >= limits.threshold_db
        self.signal_s = self.signal_s + length if signal else 0.0
        self.silence_s = 0.0 if signal else self.silence_s + length
        if self.start_s < 0:
            self.ring_s = min(limits.pre_roll_s, self.ring_s + length)
            if self.mode == "on" or self.signal_s >= limits.trigger_s - 1e-9:
                self.start_s, self.opened = max(0.0, at + length - self.ring_s), self.mode
                self.last_s, self.silence_s, self.ring_s = at + length, 0.0, 0.0
            return None
        if signal:
            self.last_s = at + length
        return self.close(limits) if self.mode == "auto" and self.silence_s >= limits.end_silence_s - 1e-9 else None

    def command(self, at: float, what: str, limits: Limits) -> tuple | None:
        """A mode, a label or "pause"; anything else that names a mode means
        "auto".  A mode ends a cooldown; a label counts from the next close."""
        if what in LABELS or what.startswith("label:"):
            name = what.removeprefix("label:")
            self.label = name if name in LABELS else "none"
            return None
        if what == "pause":
            self.mode, self.resume_s = "auto", at + limits.cooldown_s
        else:
            self.mode, self.resume_s = what if what in MODES else "auto", 0.0
        return self.close(limits) if what in ("pause", "off") else None

    def close(self, limits: Limits) -> tuple | None:
        """End an open session at its last signal; short automatic ones are
        dropped.  A closed session's label goes with it."""
        done = (self.start_s, self.last_s, self.opened, self.label)
        self.signal_s, self.silence_s, self.ring_s = 0.0, 0.0, 0.0
        if self.start_s < 0:
            return None
        self.start_s, self.label = -1.0, "none"
        return done if done[2] != "auto" or done[1] - done[0] >= limits.least_s else None


def _feed(machine: Machine, rows: Iterable[tuple], limits: Limits) -> list[tuple]:
    out = []
    for at, length, level, what in rows:
        out.append(machine.command(at, what, limits) if isinstance(what, str) else machine.take(at, length, level, limits))
    return [x for x in out if x]


def segment(blocks: list[tuple], limits: Limits | None = None) -> list[tuple[float, float]]:
    """(start, end) of the sessions of (time, length, level) blocks and (time,
    None, None, command) rows; what is open at the end closes."""
    limits, machine = limits or Limits(), Machine()
    rows = sorted(((*b, None)[:4] for b in blocks), key=lambda r: (r[0], r[3] is None))
    done = [*_feed(machine, rows, limits), machine.close(limits)]
    return [x[:2] for x in done if x]


STATE = ", ".join(f"{f.name} {'double' if f.type == 'float' else 'string'}" for f in fields(Machine))


def sessions(blocks: DataFrame, limits: Limits | None = None, event_time: str | None = None, forget_s: float = 3600.0) -> DataFrame:
    """device, start_s, end_s, mode, label of closed sessions from a stream of
    (device, at_s, length_s, level_db) and, if there is such a column, rows
    with a ``command``; rows out of order inside of a batch are sorted, later
    blocks are dropped as late.

    With ``event_time``, a column that has a watermark, silence counts also
    where no blocks come: an automatic session closes once the watermark is
    ``end_silence_s`` past its device's last row, and after ``forget_s`` any
    open session closes and the device has no state left (it is in mode "auto"
    again).  Without it a device's state stays.
    """
    limits = limits or Limits()
    if event_time is not None:
        return _timed_sessions(blocks, limits, event_time, forget_s)
    what = F.col("command") if "command" in blocks.columns else F.lit(None)
    rows = blocks.select("device", "at_s", "length_s", "level_db", what.cast("string").alias("command")).where("device is not null and at_s is not null")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(*state.get) if state.exists else Machine()
        pdf = pd.concat(list(frames))
        pdf = pdf.assign(is_block=pdf["command"].isna()).sort_values(["at_s", "is_block"], kind="stable")
        done = _feed(machine, pdf[["at_s", "length_s", "level_db", "command"]].itertuples(index=False), limits)
        state.update(astuple(machine))
        yield pd.DataFrame([(key[0], *x) for x in done], columns=["device", "start_s", "end_s", "mode", "label"])

    kind = blocks.schema["device"].dataType.simpleString()
    return rows.groupBy("device").applyInPandasWithState(run, f"device {kind}, start_s double, end_s double, mode string, label string", STATE, "append", GroupStateTimeout.NoTimeout)


def _timed_sessions(blocks: DataFrame, limits: Limits, event_time: str, forget_s: float) -> DataFrame:
    what = F.col("command") if "command" in blocks.columns else F.lit(None)
    rows = blocks.select("device", event_time, "at_s", "length_s", "level_db", what.cast("string").alias("command")).where("device is not null and at_s is not null")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, last_ms = state.get if state.exists else (*astuple(Machine()), 0)
        machine, done = Machine(*held), []
        if state.hasTimedOut:
            waiting = machine.start_s >= 0 and machine.mode == "auto"
            done = [x for x in (machine.close(limits),) if x]
            if not waiting or forget_s <= limits.end_silence_s:
                state.remove()
                yield pd.DataFrame([(key[0], *x) for x in done], columns=["device", "start_s", "end_s", "mode", "label"])
                return
        else:
            pdf = pd.concat(list(frames))
            pdf = pdf.assign(is_block=pdf["command"].isna()).sort_values(["at_s", "is_block"], kind="stable")
            done = _feed(machine, pdf[["at_s", "length_s", "level_db", "command"]].itertuples(index=False), limits)
            last_ms = max(last_ms, round(pdf[event_time].max().timestamp() * 1000))
        state.update((*astuple(machine), last_ms))
        wait = limits.end_silence_s if machine.start_s >= 0 and machine.mode == "auto" else forget_s
        state.setTimeoutTimestamp(max(last_ms + round(1000 * wait), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x) for x in done], columns=["device", "start_s", "end_s", "mode", "label"])

    kind = blocks.schema["device"].dataType.simpleString()
    return rows.groupBy("device").applyInPandasWithState(run, f"device {kind}, start_s double, end_s double, mode string, label string", f"{STATE}, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)
