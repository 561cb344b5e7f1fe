"""MIDI files as rows, and rows as MIDI files.

Reading gives one row for each channel message, with its tick; seconds and
note pairs are then DataFrame steps.  Writing encodes a session's events in
their order (tick, kind).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PPQ = 480
MESSAGES = "path string, ppq int, seq long, tick long, kind string, pitch int, velocity int, tempo_us long, text string"


def vlq(n: int) -> bytes:
    """A variable-length quantity."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def _read_vlq(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        n, at = n << 7 | b & 127, at + 1
        if b < 128:
            return n, at


def messages(data: bytes) -> tuple[int, list[tuple]]:
    """ppq and (tick, kind, pitch, velocity, tempo_us, text) of all tracks,
    merged in the order of ticks."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    ppq, at, found = int.from_bytes(data[12:14], "big"), 8 + int.from_bytes(data[4:8], "big"), []
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        if data[at : at + 4] == b"MTrk":
            i, end, tick, status = at + 8, at + 8 + size, 0, 0
            while i < end:
                step, i = _read_vlq(data, i)
                tick += step
                if data[i] & 128:
                    status, i = data[i], i + 1
                if status == 0xFF:
                    kind = data[i]
                    n, i = _read_vlq(data, i + 1)
                    body, i = data[i : i + n], i + n
                    if kind == 0x51:
                        found.append((tick, "tempo", None, None, int.from_bytes(body, "big"), None))
                    elif kind == 0x06:
                        found.append((tick, "marker", None, None, None, body.decode("latin-1")))
                    elif kind == 0x2F:
                        found.append((tick, "end", None, None, None, None))
                elif status in (0xF0, 0xF7):
                    n, i = _read_vlq(data, i)
                    i += n
                elif status >> 4 in (0xC, 0xD):
                    i += 1
                else:
                    a, b = data[i], data[i + 1]
                    i += 2
                    if status >> 4 in (8, 9):
                        found.append((tick, "on" if status >> 4 == 9 and b else "off", a, b, None, None))
        at += 8 + size
    return ppq, sorted(found, key=lambda m: m[0])


def parsed(files: DataFrame) -> DataFrame:
    """Messages of MIDI files (path, content); a damaged file has one row of
    kind ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ppq", "seq", "tick", "kind", "pitch", "velocity", "tempo_us", "text"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    ppq, found = messages(data)
                except (ValueError, IndexError, TypeError) as e:
                    ppq, found = 0, [(0, "error", None, None, None, str(e))]
                rows = [(path, ppq, i, *m) for i, m in enumerate(found)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, MESSAGES)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``parsed`` for all MIDI files of a folder."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.mid").load(folder).select("path", "content"))


def timed(found: DataFrame) -> DataFrame:
    """Messages with time_s: the sum of steps at the tempo then in force
    (500,000 us a quarter before any)."""
    w = Window.partitionBy("path").orderBy("tick", "seq")
    held = F.coalesce(F.last("tempo_us", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(500_000))
    step = (F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0))) * held / F.col("ppq") / 1e6
    return found.withColumn("step", step).withColumn("time_s", F.sum("step").over(w)).drop("step")


def notes(times: DataFrame) -> DataFrame:
    """path, start_s, end_s, midi_note, velocity: the k-th note-on of a pitch
    that is open with the first note-off after it, first in first out; notes
    still open end with the file; a note-off without an open note is ignored."""
    w = Window.partitionBy("path", "pitch").orderBy("tick", "seq")
    n = times.where(F.col("kind").isin("on", "off"))
    # a note-off counts only while notes are open: the walk of +1 and -1 kept from going under 0
    walk = F.sum(F.when(F.col("kind") == "on", 1).otherwise(-1)).over(w)
    n = n.withColumn("walk", walk).withColumn("low", F.least(F.lit(0), F.min("walk").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    n = n.withColumn("before", F.coalesce(F.lag("low").over(w), F.lit(0))).where((F.col("kind") == "on") | (F.col("low") == F.col("before")))
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("path", "pitch", "kind").orderBy("tick", "seq")))
    on, off = n.where("kind = 'on'"), n.where("kind = 'off'").select("path", "pitch", "k", F.col("time_s").alias("end_s"))
    last = times.groupBy("path").agg(F.max("time_s").alias("duration_s"))
    return on.join(off, ["path", "pitch", "k"], "left").join(last, "path").select("path", F.col("time_s").alias("start_s"), F.coalesce("end_s", "duration_s").alias("end_s"), F.col("pitch").alias("midi_note"), "velocity")


def tempo_points(times: DataFrame) -> DataFrame:
    """path, time_s, bpm, confidence: the tempo that a file sets."""
    return times.where("kind = 'tempo'").select("path", "time_s", (F.lit(60_000_000.0) / F.col("tempo_us")).alias("bpm"), F.lit(1.0).alias("confidence"))


def beats(times: DataFrame) -> DataFrame:
    """path, time_s, strength, beat_in_bar, is_downbeat from BEAT and DOWNBEAT
    markers; a marker without a number has 0."""
    label = F.upper("text")
    number = F.coalesce(F.regexp_extract(label, r"(?:^|\s)(\d+)\s*$", 1).try_cast("int"), F.lit(0))
    return times.where((F.col("kind") == "marker") & label.rlike("^(?:DOWN)?BEAT")).select("path", "time_s", F.lit(1.0).alias("strength"), number.alias("beat_in_bar"), F.startswith(label, F.lit("DOWNBEAT")).alias("is_downbeat"))


#: Order of events at one tick.
ORDER = {"tempo": 1, "marker": 2, "off": 3, "on": 4}


def _message(kind: str, pitch: int, velocity: int, tempo_us: int, text: str) -> bytes:
    if kind == "tempo":
        return b"\xff\x51\x03" + int(tempo_us).to_bytes(3, "big")
    if kind == "marker":
        return b"\xff\x06" + vlq(len(text.encode("latin-1"))) + text.encode("latin-1")
    strength = max(1, min(127, velocity)) if kind == "on" else 0
    return bytes([0x90 if kind == "on" else 0x80, max(0, min(127, pitch)), strength])


class _Track:
    """A type-0 file whose events come in order."""

    def __init__(self, ppq: int):
        self.ppq, self.body, self.last = ppq, bytearray(b"\x00\xff\x58\x04\x04\x02\x18\x08"), 0

    def put(self, tick: int, *event) -> None:
        self.body += vlq(tick - self.last) + _message(*event)
        self.last = tick

    def file(self) -> bytes:
        track = bytes(self.body) + b"\x00\xff\x2f\x00"
        return b"MThd" + (6).to_bytes(4, "big") + (0).to_bytes(2, "big") + (1).to_bytes(2, "big") + self.ppq.to_bytes(2, "big") + b"MTrk" + len(track).to_bytes(4, "big") + track


def encode(events: list[tuple[int, str, int, int, int, str]], ppq: int = PPQ) -> bytes:
    """A type-0 file from (tick, kind, pitch, velocity, tempo_us, text)."""
    track = _Track(ppq)
    for e in sorted(events, key=lambda e: (e[0], ORDER[e[1]])):
        track.put(*e)
    return track.file()


def files(events: DataFrame, ppq: int = PPQ) -> DataFrame:
    """session_id, midi: a file for each session from event rows (session_id,
    tick, kind, pitch, velocity, tempo_us, text).

    Rows come sorted, so a task holds one session's track and a few finished
    files at a time, however many events or sessions there are.
    """
    turn = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("kind"))
    own = [F.coalesce("pitch", F.lit(0)).alias("pitch"), F.coalesce("velocity", F.lit(96)).alias("velocity"), F.coalesce("tempo_us", F.lit(500_000)).alias("tempo_us"), F.coalesce("text", F.lit("")).alias("text")]
    rows = events.select("session_id", "tick", turn.alias("turn"), "kind", *own).repartition("session_id").sortWithinPartitions("session_id", "tick", "turn", "pitch", "velocity", "tempo_us", "text").drop("turn")
    session = events.schema["session_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, track, done = None, None, None, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], kind), pa.array([f for _, f in done], pa.binary())], names=["session_id", "midi"])
            done.clear()
            return made

        for rows in batches:
            kind = rows.schema.field(0).type
            for s, *event in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if track is None or s != now:
                    if track is not None:
                        done.append((now, track.file()))
                    now, track = s, _Track(ppq)
                track.put(*event)
            if sum(len(f) for _, f in done) > 1 << 20:
                yield batch()
        if track is not None:
            done.append((now, track.file()))
            yield batch()

    return rows.mapInArrow(run, f"session_id {session}, midi binary")


def note_events(notes_with_ticks: DataFrame) -> DataFrame:
    """Event rows from notes (session_id, midi_note, velocity, start_tick,
    end_tick); a note lasts a tick at least."""
    base = lambda kind, tick: notes_with_ticks.select("session_id", tick.cast("long").alias("tick"), F.lit(kind).alias("kind"), F.col("midi_note").alias("pitch"), "velocity", F.lit(None).cast("long").alias("tempo_us"), F.lit(None).cast("string").alias("text"))
    return base("on", F.col("start_tick")).unionByName(base("off", F.greatest(F.col("end_tick"), F.col("start_tick") + 1)))
