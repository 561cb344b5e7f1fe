"""Onset groups: notes struck together.

A group holds the notes up to 35 ms after its first.  Groups do not chain, so
they are found by a fold; as a gap over 35 ms always starts a group, the fold
runs inside of gap islands only, which a window function cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.arrays import scan_blocks

SPAN = 0.035


def onset_groups(notes: DataFrame, span: float = SPAN) -> DataFrame:
    """notes with ``anchor``, the first start of their group."""
    w = Window.partitionBy("session_id").orderBy("start_s", "midi_note", "event_id")
    gap = F.col("start_s") - F.lag("start_s").over(w)
    cut = notes.withColumn("cut", F.when(gap <= span, 0).otherwise(1)).withColumn("island", F.sum("cut").over(w))
    fields = [c for c in notes.columns if c not in ("session_id", "start_s", "midi_note", "event_id")]
    packed = cut.groupBy("session_id", "island").agg(F.array_sort(F.collect_list(F.struct("start_s", "midi_note", "event_id", *fields))).alias("a"))
    def step(at, x):
        anchor = F.when(at.isNull() | (x["start_s"] - at > span), x["start_s"]).otherwise(at)
        return anchor, F.array(anchor)

    anchors = scan_blocks(F.col("a"), F.lit(None).cast("double"), F.array().cast("array<double>"), step)
    out = packed.select("session_id", F.explode(F.arrays_zip("a", anchors.alias("anchor"))).alias("x"))
    return out.select("session_id", *[F.col(f"x.a.{c}").alias(c) for c in notes.columns if c != "session_id"], F.col("x.anchor").alias("anchor"))


def group_times(groups: DataFrame) -> DataFrame:
    """session_id, anchor, size, onset_s (median start), spread_s."""
    return groups.groupBy("session_id", "anchor").agg(F.count("*").alias("size"), F.median("start_s").alias("onset_s"), (F.max("start_s") - F.min("start_s")).alias("spread_s"))


def density(groups: DataFrame) -> DataFrame:
    """session_id, onsets, onsets_per_s over the session's duration."""
    return groups.groupBy("session_id").agg(F.countDistinct("anchor").alias("onsets"), (F.countDistinct("anchor") / F.greatest(F.max("end_s"), F.lit(1e-9))).alias("onsets_per_s"))


def polyphony(groups: DataFrame) -> DataFrame:
    """session_id, polyphonic: four groups of different pitches, or a triad
    whose second longest note lasts a second."""
    g = groups.groupBy("session_id", "anchor").agg(
        F.countDistinct("midi_note").alias("pitches"),
        F.countDistinct(F.col("midi_note") % 12).alias("classes"),
        F.sort_array(F.collect_list(F.col("end_s") - F.col("start_s")), asc=False).alias("lengths"),
    )
    triad = (F.col("pitches") >= 2) & (F.col("classes") >= 3) & (F.try_element_at("lengths", F.lit(2)) >= 1.0)
    return g.groupBy("session_id").agg((F.coalesce(F.bool_or(triad), F.lit(False)) | (F.sum((F.col("pitches") >= 2).cast("int")) >= 4)).alias("polyphonic"))


def chord_onset_metrics(groups: DataFrame) -> DataFrame:
    """session_id, exact_ratio, polyphonic_ratio, median_spread_s; nulls under
    twelve groups of several notes."""
    g = group_times(groups)
    multi = F.col("size") >= 2
    n = F.sum(multi.cast("int"))
    enough = n >= 12
    return g.groupBy("session_id").agg(
        F.when(enough, 100.0 * F.avg(F.when(multi, (F.col("spread_s") < 0.0015).cast("double")))).alias("exact_ratio"),
        F.when(enough, 100.0 * n / F.count("*")).alias("polyphonic_ratio"),
        F.when(enough, F.median(F.when(multi, F.col("spread_s")))).alias("median_spread_s"),
    )


def unique_starts(notes: DataFrame, least: int = 4) -> DataFrame:
    """session_id, starts, sparse: different starts at three digits, and
    whether these are fewer than ``least``."""
    g = notes.groupBy("session_id").agg(F.countDistinct(F.bround("start_s", 3)).alias("starts"))
    return g.withColumn("sparse", F.col("starts") < least)


def strongest(levels: DataFrame, level: str, k: int = 12) -> DataFrame:
    """levels (session_id, frame, pitch, ...) less all but the ``k`` strongest
    of each frame, of equals the lower pitch."""
    w = Window.partitionBy("session_id", "frame").orderBy(F.desc(level), "pitch")
    return levels.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
