"""Sessions as files: MIDI with tempo and beats, chord sheets, labelled copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.music import thousandths
from strophe.operators.tempo import ticks
from strophe.sources import midi

HEADER = "start_time,end_time,chord_name,key"


def midi_events(notes: DataFrame, tempo: DataFrame, beats: DataFrame, default_bpm: float = 120.0) -> DataFrame:
    """Event rows (see ``midi.files``) of sessions: the tempo, which its first
    point sets at tick 0 too, a marker for each beat, and the notes (midi_note,
    velocity, start_s, end_s).  Sessions without tempo have ``default_bpm``.
    Points at one time follow by event_id, if there is one."""
    ids = notes.select("session_id").union(beats.select("session_id")).union(tempo.select("session_id")).distinct()
    turn = F.col("event_id").cast("long") if "event_id" in tempo.columns else F.lit(0).cast("long")
    t = tempo.select("session_id", "time_s", "bpm", turn.alias("event_id"))
    none = lambda kind: F.lit(None).cast(kind)
    bare = ids.join(t.select("session_id"), "session_id", "left_anti").select("session_id", F.lit(0.0).alias("time_s"), F.lit(float(default_bpm)).alias("bpm"), none("long").alias("event_id"))
    first = t.groupBy("session_id").agg(F.min(F.struct("time_s", "event_id", "bpm")).alias("p")).where("p.time_s > 0").select("session_id", F.lit(0.0).alias("time_s"), "p.bpm", none("long").alias("event_id"))
    whole = t.unionByName(first).unionByName(bare)
    us = F.rint(60_000_000 / F.greatest("bpm", F.lit(1.0))).cast("long")
    label = F.concat(F.when(F.col("is_downbeat"), "DOWNBEAT ").otherwise("BEAT "), F.col("beat_in_bar").cast("string"))
    moved = whole.select("session_id", F.col("time_s").alias("at_s"), F.lit("tempo").alias("kind"), none("int").alias("pitch"), none("int").alias("velocity"), us.alias("tempo_us"), none("string").alias("text"), none("double").alias("end_s"))
    marks = beats.select("session_id", F.col("time_s").alias("at_s"), F.lit("marker").alias("kind"), none("int").alias("pitch"), none("int").alias("velocity"), none("long").alias("tempo_us"), label.alias("text"), none("double").alias("end_s"))
    own = notes.select("session_id", F.col("start_s").alias("at_s"), F.lit("on").alias("kind"), F.col("midi_note").alias("pitch"), "velocity", none("long").alias("tempo_us"), none("string").alias("text"), "end_s")
    # rows go through with their times: nothing is joined to them again
    timed = ticks(whole, moved.unionByName(marks).unionByName(own))
    ends = timed.where("kind = 'on'").select("session_id", F.col("end_s").alias("at_s"), F.col("pitch").alias("midi_note"), "velocity", F.col("tick").alias("start_tick"))
    ends = ticks(whole, ends).withColumnRenamed("tick", "end_tick")
    return timed.where("kind <> 'on'").select("session_id", "tick", "kind", "pitch", "velocity", "tempo_us", "text").unionByName(midi.note_events(ends))


def sheets(chords: DataFrame) -> DataFrame:
    """session_id, csv: the chord sheet of each session as one text with BOM,
    header and lines in order."""
    field = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    line = F.concat(thousandths(F.col("start_s")), F.lit(","), thousandths(F.col("end_s")), F.lit(","), field("chord"), F.lit(","), field("key"))
    g = chords.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", line.alias("line")))).alias("a"))
    return g.select("session_id", F.concat(F.lit("﻿" + HEADER + "\r\n"), F.array_join(F.col("a.line"), "\r\n"), F.lit("\r\n")).alias("csv"))


def complete(staged: DataFrame) -> DataFrame:
    """Staged files (session_id, part, path) that can be committed: those of
    sessions that have both a MIDI file and a chord sheet; of a part given
    twice the last path counts."""
    w = Window.partitionBy("session_id")
    has = lambda part: F.max((F.col("part") == part).cast("int")).over(w) == 1
    x = staged.withColumn("ok", has("midi") & has("chords")).where("ok").drop("ok")
    return x.groupBy("session_id", "part").agg(F.max("path").alias("path"))


def uncommitted(staged: DataFrame, archive: DataFrame) -> DataFrame:
    """``complete`` sessions' files that the archive (session_id, part) lacks,
    so that a retry after a failure commits each once."""
    return complete(staged).join(archive.select("session_id", "part").distinct(), ["session_id", "part"], "left_anti")


def labelled_copies(files: DataFrame, labels: DataFrame) -> DataFrame:
    """files (session_id, ...) of sessions labelled human or non_human, with the
    label; write with ``partitionBy("label")``."""
    return files.join(labels.where(F.col("label").isin("human", "non_human")).select("session_id", "label"), "session_id")


def write_labelled(files: DataFrame, labels: DataFrame, folder: str) -> None:
    labelled_copies(files, labels).write.mode("append").partitionBy("label").parquet(f"{folder.rstrip('/')}/labels")


def write_table(rows: DataFrame, folder: str) -> None:
    """A manifest or feature table as CSV files with header, by session."""
    rows.sortWithinPartitions(*[c for c in ("session_id", "path") if c in rows.columns]).write.mode("overwrite").option("header", True).csv(folder)
