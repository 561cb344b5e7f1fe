"""What a view of a stretch of a session shows: ranges, ticks, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pitch_range(notes: DataFrame, from_s: float, to_s: float) -> DataFrame:
    """session_id, visible, lowest, highest: notes that touch the stretch and
    the octaves that hold them (two at least, up to pitch 120)."""
    g = notes.where((F.col("end_s") >= from_s) & (F.col("start_s") <= to_s)).groupBy("session_id").agg(F.count("*").alias("visible"), F.min("midi_note").alias("a"), F.max("midi_note").alias("b"))
    low = (F.floor(F.greatest(F.lit(24), F.col("a") - 3) / 12) * 12).cast("int")
    high = (F.ceil(F.least(F.lit(108), F.col("b") + 4) / 12) * 12).cast("int")
    return g.select("session_id", "visible", low.alias("lowest"), F.least(F.lit(120), F.greatest(low + 24, high)).alias("highest"))


def tempo_range(tempo: DataFrame, from_s: float, to_s: float) -> DataFrame:
    """session_id, low_bpm, high_bpm: the bpm in the stretch with 4 around,
    12 wide at least."""
    g = tempo.where(F.col("time_s").between(from_s, to_s)).groupBy("session_id").agg((F.min("bpm") - 4).alias("a"), (F.max("bpm") + 4).alias("b"))
    half = F.greatest(F.lit(6.0), (F.col("b") - F.col("a")) / 2)
    middle = (F.col("a") + F.col("b")) / 2
    return g.select("session_id", (middle - half).alias("low_bpm"), (middle + half).alias("high_bpm"))


def mini_roll(notes: DataFrame, at_s: float, seconds: float = 12.0) -> DataFrame:
    """session_id, low, high: the pitches of the last seconds with 2 around,
    12 wide at least."""
    g = notes.where((F.col("end_s") >= at_s - seconds) & (F.col("start_s") <= at_s)).groupBy("session_id").agg((F.min("midi_note") - 2).alias("low"), (F.max("midi_note") + 2).alias("high"))
    return g.select("session_id", "low", F.greatest("high", F.col("low") + 12).alias("high"))


def lag_alert(latency_s: Column, most: float = 5.0) -> Column:
    return latency_s > most


def latency(captured_s: Column, now_s: Column) -> Column:
    """Seconds since the latest analysed block; null before any."""
    return F.when(captured_s.isNotNull(), F.greatest(F.lit(0.0), now_s - captured_s))


def latency_text(latency_s: Column) -> Column:
    return F.when(latency_s.isNull(), "-").otherwise(F.concat(F.format_string("%.1f s", latency_s), F.when(lag_alert(latency_s), " !").otherwise("")))


def visible_beats(beats: DataFrame, from_s: float, to_s: float) -> DataFrame:
    """Beats inside of a stretch, ends included."""
    return beats.where(F.col("time_s").between(from_s, to_s))


def visible_chords(chords: DataFrame, from_s: float, to_s: float, at_s: float, width: float = 1000.0) -> DataFrame:
    """Chord segments of a stretch that are two pixels wide or more, with x0, x1
    (pixels of ``width``) and active, whether the playhead is in them."""
    per_s = width / max(1e-9, to_s - from_s)
    x = chords.where((F.col("end_s") >= from_s) & (F.col("start_s") <= to_s))
    x = x.withColumn("x0", (F.greatest("start_s", F.lit(from_s)) - from_s) * per_s).withColumn("x1", (F.least("end_s", F.lit(to_s)) - from_s) * per_s)
    return x.where("x1 - x0 >= 2").withColumn("active", (F.col("start_s") <= at_s) & (F.lit(at_s) < F.col("end_s")))


def viewport(playhead: Column, span: Column) -> Column:
    """A struct of from_s, to_s and tick_s: ``span`` seconds up to a second
    after the playhead."""
    end = F.greatest(span, playhead + 1.0)
    tick = F.when(span <= 15, 1).when(span <= 90, 5).when(span <= 240, 15).otherwise(30)
    return F.struct((end - span).alias("from_s"), end.alias("to_s"), tick.alias("tick_s"))


def zoomed(span: Column, closer: Column) -> Column:
    """The span after a step of zoom in or out, within 6 to 600 s."""
    return F.greatest(F.lit(6.0), F.least(F.lit(600.0), span * F.when(closer, 0.82).otherwise(1.22)))


def spectrum_crop(columns: Column, start_s: Column, end_s: Column, from_s: Column, to_s: Column) -> Column:
    """The part of a spectrum's columns (an array over start_s to end_s) that a
    stretch shows; empty without overlap."""
    a, b = F.greatest(start_s, from_s), F.least(end_s, to_s)
    n = F.size(columns)
    place = lambda t: (t - start_s) / F.greatest(F.lit(1e-9), end_s - start_s) * n
    first = F.floor(place(a)).cast("int")
    return F.when(b > a, F.slice(columns, first + 1, F.greatest(F.lit(1), F.ceil(place(b)).cast("int") - first))).otherwise(F.slice(columns, 1, 0))
