"""What happens to a recorded session: validation, automatic pause, closing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.kernels import first_window

# Fixed values of the session rules, in seconds and shares.
WINDOW_S, PAUSE_BELOW, LEAD_S, LEAST_S, STEP_S = 5.0, 0.10, 0.2, 20.0, 1.5


def validated(notes: DataFrame, full: bool = True) -> DataFrame:
    """session_id, duration_s, valid_from and valid_at: the start of the first
    stretch that notes cover enough, and when that is known; nulls without one.
    ``full`` asks for a whole window."""
    kind = notes.schema["session_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        end = float(pdf["end_s"].max())
        begin, at, _ = first_window(pdf["start_s"].to_numpy(), pdf["end_s"].to_numpy(), end, full)
        return pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]], "duration_s": [end], "valid_from": [begin], "valid_at": [at]})

    whole = notes.where("start_s is not null and end_s is not null").select("session_id", "start_s", "end_s")
    return whole.groupBy("session_id").applyInPandas(run, f"session_id {kind}, duration_s double, valid_from double, valid_at double")


def islands(notes: DataFrame) -> DataFrame:
    """session_id, lo, hi: stretches under notes."""
    w = Window.partitionBy("session_id").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = notes.withColumn("fresh", F.when(reach.isNull() | (F.col("start_s") > reach), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(w))
    return x.groupBy("session_id", "island").agg(F.min("start_s").alias("lo"), F.max("end_s").alias("hi")).drop("island")


def refresh_coverage(notes: DataFrame, step: float = STEP_S, size: float = WINDOW_S) -> DataFrame:
    """session_id, at_s, coverage: at each refresh up to the session's end, the
    share of the last ``size`` seconds (fewer at the start) under notes."""
    last = notes.groupBy("session_id").agg(F.floor(F.max("end_s") / step).cast("int").alias("last"))
    times = last.where("last > 0").select("session_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("k"))
    k = F.sequence(F.greatest(F.lit(1), F.floor(F.col("lo") / step).cast("int")), F.ceil((F.col("hi") + size) / step).cast("int"))
    parts = islands(notes).join(last, "session_id").select("session_id", "lo", "hi", "last", F.explode(k).alias("k")).where("k <= last")
    begin, end = F.greatest(F.lit(0.0), F.col("k") * step - size), F.col("k") * step
    inside = F.greatest(F.lit(0.0), F.least(F.col("hi"), end) - F.greatest(F.col("lo"), begin))
    sums = parts.groupBy("session_id", "k").agg(F.sum(inside).alias("inside"))
    return times.join(sums, ["session_id", "k"], "left").select("session_id", (F.col("k") * step).alias("at_s"), (F.coalesce("inside", F.lit(0.0)) / F.least(F.lit(size), F.col("k") * step)).alias("coverage"))


def auto_pause(notes: DataFrame) -> DataFrame:
    """session_id, pause_s: the first refresh of a validated session at which
    the last five seconds are covered by less than a tenth; null without one."""
    v = validated(notes).select("session_id", "valid_at")
    low = refresh_coverage(notes).join(v, "session_id").where((F.col("at_s") >= WINDOW_S) & (F.col("at_s") >= F.col("valid_at")) & (F.col("coverage") < PAUSE_BELOW))
    return v.join(low.groupBy("session_id").agg(F.min("at_s").alias("pause_s")), "session_id", "left").select("session_id", "pause_s")


def closing(notes: DataFrame, automatic: bool = True) -> DataFrame:
    """session_id, lead_s, duration_s, fate of sessions that end: what goes
    before the first valid note (less 0.2 s), the length that stays, and
    "archived", "short" (automatic ones under 20 s, before or after) or
    "empty" (automatic ones without a valid stretch)."""
    v = validated(notes, full=False)
    if not automatic:
        return v.select("session_id", F.lit(0.0).alias("lead_s"), "duration_s", F.lit("archived").alias("fate"))
    lead = F.greatest(F.lit(0.0), F.coalesce("valid_from", F.lit(0.0)) - LEAD_S)
    fate = F.when((F.col("duration_s") < LEAST_S) | (F.col("valid_from").isNotNull() & (F.col("duration_s") - lead < LEAST_S)), "short").when(F.col("valid_from").isNull(), "empty").otherwise("archived")
    return v.select("session_id", lead.alias("lead_s"), (F.col("duration_s") - lead).alias("duration_s"), fate.alias("fate"))


def closed_notes(notes: DataFrame, closings: DataFrame) -> DataFrame:
    """Notes of archived sessions without the lead-in, in the archive's time."""
    x = notes.join(closings.where("fate = 'archived'").select("session_id", "lead_s"), "session_id").where("end_s > lead_s")
    return x.withColumn("start_s", F.greatest(F.lit(0.0), F.col("start_s") - F.col("lead_s"))).withColumn("end_s", F.col("end_s") - F.col("lead_s")).drop("lead_s")


def closed_points(points: DataFrame, closings: DataFrame) -> DataFrame:
    """Tempo points or beats (time_s), likewise."""
    x = points.join(closings.where("fate = 'archived'").select("session_id", "lead_s"), "session_id").where("time_s >= lead_s")
    return x.withColumn("time_s", F.col("time_s") - F.col("lead_s")).drop("lead_s")


def resampled(values: np.ndarray, k: int) -> np.ndarray:
    """k values at even steps from the first to the last (places cut off)."""
    return values[np.linspace(0, len(values) - 1, k).astype(int)] if len(values) and k else values[:0]
