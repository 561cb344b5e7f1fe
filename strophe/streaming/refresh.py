"""Live analysis of sessions with a clock: tempo, beats, keys and chords.

Notes come with an event time and a watermark.  A timer of each session runs
its refreshes every ``step`` seconds of session time as the watermark passes
them, so a session that falls silent is still refreshed, pauses when its last
five seconds are nearly empty, ends after ``idle_s`` without a note, and then
has no state left.  Every refresh sees all notes begun by then, whatever the
batches were: rows in another cut give the same refreshes.

State is typed, by key: a clock, and lists of notes (24 s), tempo, beats, keys
and chords (60 s each).  A refresh sends what it has changed: for each kind of
item, the time from which old items go and the items from there on.
``current`` makes tables of such rows, ``keep`` upserts them batch by batch
into a committed part and a mutable tail, and ``replayed`` is the same run over
a table of whole sessions.

Rows with a null, a negative length or a time that isn't finite, and refreshes
that fail, are sent as rows with ``error``; the session goes on.  After a jump
of the watermark by more than ``backlog_s`` only the last refresh due is made
(quality "reduced"), where that is asked for.  Notes of an ended session begin
it anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strophe.operators import contexts as C
from strophe.operators.sessions import STEP_S
from strophe.operators.timing import human_score
from strophe.operators.tracking import CONTEXT_S, Refresher
from strophe.plans.lineage import checkpoint, remove
from strophe.streaming.live import KEPT_S, ROWS, Live

ITEM = "start_s double, end_s double, name string, key string, function string, value double, confidence double, number int"
ITEM_NAMES = [c.split()[0] for c in ITEM.split(", ")]
CHANGE = f"kind string, cut_s double, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"
SHAPE = f"{ROWS}, key string, chord string, function string, quality string, ended boolean, error string, changes array<struct<{CHANGE.replace('kind string', 'kind:string').replace('cut_s double', 'cut_s:double').replace('items array', 'items:array')}>>"
NAMES = [*(c.split()[0] for c in ROWS.split(", ")), "key", "chord", "function", "quality", "ended", "error", "changes"]
KINDS = ("tempo", "beat", "key", "chord")

#: Typed state: lists of items by kind, and one clock.
LISTS = {
    "notes": "start_s double, end_s double, midi_note int, confidence double",
    "tempo": "time_s double, bpm double, confidence double",
    "beats": "time_s double, strength double, beat_in_bar int, is_downbeat boolean",
    "keys": "start_s double, end_s double, key string, confidence double",
    "chords": "start_s double, end_s double, chord string, key string, function string, confidence double",
}
CLOCK = "origin_ms long, at double, heard double, valid double, stable int, rival int, runs int"
BEAT = ("time_s", "strength", "beat_in_bar", "is_downbeat")


def _item(kind: str, x: tuple) -> dict:
    start, end, name, key, function, value, sure, number = (x[0], x[0], None, None, None, None, None, None)
    if kind == "tempo":
        value, sure = x[1:]
    elif kind == "beat":
        value, number = x[1], x[2]
    elif kind == "key":
        end, name, sure = x[1:]
    else:
        end, name, key, function, sure = x[1:]
    return dict(zip(ITEM_NAMES, (float(start), float(end), name, key, function, value, sure, number), strict=True))


class Session(Live):
    """One session's refreshes; ``ended`` says "paused" or "idle" once over."""

    def __init__(self, step: float = STEP_S, idle_s: float = 30.0, backlog_s: float = math.inf):
        super().__init__(None, step)
        self.idle_s, self.backlog_s = idle_s, backlog_s
        self.all: list[tuple] = []
        self.keys: list[tuple] = []
        self.chords: list[tuple] = []
        self.heard, self.ended = 0.0, None

    def hear(self, rows: list[tuple]) -> None:
        """Notes (start, end, pitch, confidence) in any order."""
        if not self.all and not self.at:
            # nothing happens before the context of the first note begins
            first = min(r[0] for r in rows) - CONTEXT_S
            self.at = max(0.0, math.floor(first / self.step) * self.step)
        self.all = sorted(self.all + rows)
        self.heard = max(self.heard, max(r[1] for r in rows))

    def held(self) -> dict[str, list[tuple]]:
        return {
            "tempo": [(float(t), float(v), float(c)) for t, v, c in self.refresher.tempo],
            "beat": [(float(b["time_s"]), float(b["strength"]), int(b["beat_in_bar"]), bool(b["is_downbeat"])) for b in self.refresher.beats],
            "key": self.keys,
            "chord": self.chords,
        }

    def advance(self, upto: float) -> Iterator[tuple]:
        """The refreshes due by ``upto``, until the session ends."""
        if upto - self.at > self.backlog_s + self.step:
            self.at += math.floor((upto - self.at) / self.step - 1) * self.step
            quality = "reduced"
        else:
            quality = "full"
        while not self.ended and self.at + self.step <= upto:
            self.at += self.step
            before = self.held()
            try:
                summary, error = self.look(), None
            except Exception as e:  # one bad refresh is reported, the session goes on
                summary, error, quality = (self.at, *[None] * 9), f"{type(e).__name__}: {e}", "reduced"
            if summary[4]:
                self.ended = "paused"
            elif self.at - self.heard >= self.idle_s:
                self.ended = "idle"
            key, chord = self.keys[-1] if self.keys else None, self.chords[-1] if self.chords else None
            yield (*summary, key and key[2], chord and chord[2], chord and chord[4], quality, self.ended is not None, error, self.changes(before, self.held()))
            self.forget()

    def look(self) -> tuple:
        now = self.at
        self.notes = [n[:3] for n in self.all]
        out = self.refresh()
        seen = [n for n in self.all if n[0] <= now and n[1] > n[0]]
        start, end, sure = (np.array([n[i] for n in seen], float) for i in (0, 1, 3))
        begin, keys, chords = C.context(start, np.minimum(end, now), np.array([n[2] for n in seen], int), sure, now)
        cut = max(begin, now - C.MUTABLE_S, 0.0)
        self.keys = C.spliced(self.keys, keys, cut, now, C.key_gap)
        self.chords = C.spliced(self.chords, chords, cut, now, C.chord_gap)
        return out

    def changes(self, before: dict, after: dict) -> list[dict]:
        """What differs, from the first item that does."""
        out = []
        for kind in KINDS:
            pairs = zip_longest(before[kind], after[kind])
            first = next((i for i, (a, b) in enumerate(pairs) if a != b), None)
            if first is not None:
                old, new = before[kind][first:], after[kind][first:]
                out.append({"kind": kind, "cut_s": min(x[0] for x in old[:1] + new[:1]), "items": [_item(kind, x) for x in new]})
        return out

    def forget(self) -> None:
        """Drop what no refresh will see again."""
        oldest, r = self.at - KEPT_S, self.refresher
        self.all = [n for n in self.all if n[1] > self.at - CONTEXT_S]
        r.tempo, r.beats = [p for p in r.tempo if p[0] >= oldest], [b for b in r.beats if b["time_s"] >= oldest]
        self.keys, self.chords = ([s for s in x if s[1] >= oldest] for x in (self.keys, self.chords))


def _bad(a: float, b: float, pitch: float) -> str | None:
    if any(x is None or not math.isfinite(x) for x in (a, b, pitch)):
        return "a note without times or pitch"
    return "a note of negative length" if b < a else None


class LiveSessions(StatefulProcessor):
    """``Session`` by key, with typed state and an event-time timer."""

    def __init__(self, step: float, idle_s: float, backlog_s: float, column: str):
        self.options, self.step, self.column = (step, idle_s, backlog_s), step, column

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.lists = {k: handle.getListState(k, shape) for k, shape in LISTS.items()}

    def _load(self) -> tuple[int | None, Session]:
        s, clock = Session(*self.options), self.clock.get()
        if clock is None:
            return None, s
        origin, s.at, s.heard, s.valid, *memory = clock
        held = {k: [tuple(x) for x in v.get()] for k, v in self.lists.items()}
        s.all, s.keys, s.chords = held["notes"], held["keys"], held["chords"]
        s.refresher = type(s.refresher)(held["tempo"], [dict(zip(BEAT, b, strict=True)) for b in held["beats"]], memory)
        return origin, s

    def _store(self, origin: int, s: Session) -> None:
        held, m = s.held(), s.refresher.memory
        self.clock.update((origin, float(s.at), float(s.heard), None if s.valid is None else float(s.valid), m.stable, m.rival, m.runs))
        for name, rows in (("notes", s.all), ("tempo", held["tempo"]), ("beats", held["beat"]), ("keys", s.keys), ("chords", s.chords)):
            self.lists[name].clear() if not rows else self.lists[name].put(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        good, wrong, origin = [], [], None
        for pdf in rows:
            for at, a, b, p, c in zip(pdf[self.column], *(pdf[k] for k in ("start_s", "end_s", "midi_note", "confidence")), strict=True):
                why = _bad(a, b, p)
                if why:
                    wrong.append((None if a is None or not math.isfinite(a) else float(a), *[None] * 12, "full", False, why, []))
                    continue
                origin = round(at.timestamp() * 1000 - a * 1000) if origin is None else origin
                good.append((float(a), float(b), int(p), 0.0 if c is None or math.isnan(c) else float(c)))
        if good:
            known, s = self._load()
            s.hear(good)
            self._store(origin if known is None else known, s)
            if known is None:
                self.handle.registerTimer(origin + round(1000 * (s.at + self.step)))
        if wrong:
            yield _frame(key[0], wrong)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        origin, s = self._load()
        if origin is None:
            return
        out = list(s.advance((timerValues.getCurrentWatermarkInMs() - origin) / 1000))
        if s.ended:
            self.clock.clear()
            for v in self.lists.values():
                v.clear()
        else:
            self._store(origin, s)
            self.handle.registerTimer(origin + round(1000 * (s.at + self.step)))
        if out:
            yield _frame(key[0], out)

    def close(self) -> None:
        pass


def _frame(session, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session, *r) for r in rows], columns=["session_id", *NAMES])


def live_sessions(notes: DataFrame, event_time: str, step: float = STEP_S, idle_s: float = 30.0, backlog_s: float = math.inf) -> DataFrame:
    """session_id and ``SHAPE`` for every refresh of a stream of (session_id,
    event_time, start_s, end_s, midi_note, confidence) with a watermark on its
    event time, the moment a note begins.  Sessions without an id are left out.

    Needs the RocksDB state store.
    """
    kind = notes.schema["session_id"].dataType.simpleString()
    rows = notes.where("session_id is not null").select("session_id", event_time, "start_s", "end_s", "midi_note", "confidence")
    return rows.groupBy("session_id").transformWithStateInPandas(LiveSessions(step, idle_s, backlog_s, event_time), f"session_id {kind}, {SHAPE}", "Append", "EventTime")


class _Still(Refresher):
    """No tempo and no beats."""

    def take(self, *_) -> None:
        pass


def replayed(notes: DataFrame, step: float = STEP_S, idle_s: float = 30.0, timing: bool = True) -> DataFrame:
    """The same rows for a table of whole sessions, each until it ends; without
    ``timing`` there are keys and chords only."""
    kind = notes.schema["session_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        good, wrong = [], []
        for a, b, p, c in zip(*(pdf[k] for k in ("start_s", "end_s", "midi_note", "confidence")), strict=True):
            why = _bad(a, b, p)
            if why:
                wrong.append((None if a is None or not math.isfinite(a) else float(a), *[None] * 12, "full", False, why, []))
            else:
                good.append((float(a), float(b), int(p), 0.0 if c is None or math.isnan(c) else float(c)))
        s = Session(step, idle_s)
        if not timing:
            s.refresher = _Still()
        if good:
            s.hear(good)
            wrong += s.advance(math.inf)
        return _frame(pdf["session_id"].iloc[0], wrong)

    tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = notes.where("session_id is not null").select("session_id", "start_s", "end_s", "midi_note", "confidence")
    return rows.repartition(tasks, "session_id").groupBy("session_id").applyInPandas(run, f"session_id {kind}, {SHAPE}")


def current(refreshes: DataFrame, kind: str | None = None) -> DataFrame:
    """session_id, kind, at_s and ``ITEM``: the items that no later refresh
    has replaced."""
    x = refreshes.where("changes is not null").select("session_id", "at_s", F.inline("changes"))
    return _items(x if kind is None else x.where(F.col("kind") == kind))


def _items(changes: DataFrame) -> DataFrame:
    later = Window.partitionBy("session_id", "kind").orderBy("at_s").rowsBetween(1, Window.unboundedFollowing)
    x = changes.withColumn("gone", F.min("cut_s").over(later)).select("session_id", "kind", "at_s", "gone", F.inline("items"))
    return x.where("gone is null or start_s < gone").drop("gone")


def tempo(items: DataFrame) -> DataFrame:
    """session_id, time_s, bpm, confidence of ``current`` items."""
    return items.where("kind = 'tempo'").select("session_id", F.col("start_s").alias("time_s"), F.col("value").alias("bpm"), "confidence")


def beats(items: DataFrame) -> DataFrame:
    """session_id, time_s, strength, beat_in_bar, is_downbeat, likewise."""
    return items.where("kind = 'beat'").select("session_id", F.col("start_s").alias("time_s"), F.col("value").alias("strength"), F.col("number").alias("beat_in_bar"), (F.col("number") == 1).alias("is_downbeat"))


def keys(items: DataFrame) -> DataFrame:
    """session_id, start_s, end_s, key, confidence, likewise."""
    return items.where("kind = 'key'").select("session_id", "start_s", "end_s", F.col("name").alias("key"), "confidence")


def chords(items: DataFrame) -> DataFrame:
    """session_id, start_s, end_s, chord, key, function, confidence, likewise."""
    return items.where("kind = 'chord'").select("session_id", "start_s", "end_s", F.col("name").alias("chord"), "key", "function", "confidence")


def keep(folder: str, mutable_s: float = KEPT_S):
    """A function for ``foreachBatch`` that upserts refreshes into ``folder``:
    ``committed`` grows by items no refresh can change any more, and ``tail``
    holds the rest, a version for each batch.

    A batch that runs again overwrites its own folders and reads the version
    before it, so it gives the same tables.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("changes is not null").select("session_id", "at_s", "ended", F.inline("changes"))
        fresh = fresh.select("session_id", "kind", "at_s", "cut_s", "items", "ended")
        before = _version(spark, folder, "tail", number - 1)
        # the version before comes as one change of each kind, older than all of the batch
        shape = F.struct(*ITEM_NAMES)
        if before is not None:
            old = before.groupBy("session_id", "kind").agg(F.array_sort(F.collect_list(shape)).alias("items"))
            old = old.select("session_id", "kind", F.lit(-1.0).alias("at_s"), F.lit(float("inf")).alias("cut_s"), "items", F.lit(False).alias("ended"))
            fresh = fresh.union(old)
        # a session's last refresh says what can still change
        last = fresh.groupBy("session_id").agg(F.max("at_s").alias("last_s"), F.max("ended").alias("over"))
        now = _items(fresh.drop("ended")).join(last, "session_id")
        done = F.col("over") | (F.col("end_s") < F.col("last_s") - mutable_s)
        now = now.withColumn("done", done).select("session_id", "kind", *ITEM_NAMES, "done").persist()
        try:
            now.where("done").drop("done").write.mode("overwrite").parquet(f"{folder}/committed/batch={number}")
            now.where("not done").drop("done").write.mode("overwrite").parquet(f"{folder}/tail/batch={number}")
        finally:
            now.unpersist()
        if number > 1:
            remove(spark, f"{folder}/tail/batch={number - 2}")

    return upsert


def _version(spark: SparkSession, folder: str, part: str, number: int) -> DataFrame | None:
    """A batch's version of the tail, or the last one before it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    have = [int(x.getPath().getName().removeprefix("batch=")) for x in files.listStatus(path) if x.getPath().getName().startswith("batch=")]
    best = max((n for n in have if n <= number), default=None)
    return None if best is None else spark.read.parquet(f"{folder}/{part}/batch={best}")


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, kind and ``ITEM`` as ``keep`` has left them."""
    tail = _version(spark, folder, "tail", 1 << 62)
    return spark.read.parquet(f"{folder}/committed").drop("batch").unionByName(tail)


def scores(refreshes: DataFrame, notes: DataFrame) -> DataFrame:
    """``timing.human_score`` of sessions' notes with the tempo and beats that
    the refreshes have left."""
    items = checkpoint(current(refreshes).where("kind in ('tempo', 'beat')"))
    return human_score(notes, tempo(items).withColumn("event_id", F.xxhash64("time_s")), beats(items))
