"""Signal blocks and note onsets as envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TAPS = ((-2, 0.18), (-1, 0.58), (0, 1.0), (1, 0.58), (2, 0.18))


def onset_envelope(notes: DataFrame, rate: int = 22_050, hop: int = 128) -> DataFrame:
    """session_id, frame, strength: an impulse for each frame with a start,
    spread over five frames; frames before 0 are cut off."""
    frames = notes.select("session_id", F.rint(F.col("start_s") * rate / hop).cast("long").alias("at")).distinct()
    taps = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in TAPS]))
    x = frames.select("session_id", "at", taps.alias("t")).select("session_id", (F.col("at") + F.col("t.o")).alias("frame"), F.col("t.w").alias("w"))
    return x.where("frame >= 0").groupBy("session_id", "frame").agg(F.sum("w").alias("strength"))


def block_level(blocks: DataFrame, samples: str = "samples", threshold_db: float = -48.0) -> DataFrame:
    """blocks with level_db (of the root mean square) and is_signal."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples)
    level = 20.0 * F.log10(F.greatest(F.sqrt(mean + 1e-12), F.lit(1e-6)))
    return blocks.withColumn("level_db", level).withColumn("is_signal", F.col("level_db") >= threshold_db)


def normalised(blocks: DataFrame, samples: str = "samples") -> DataFrame:
    """Samples divided by their peak where that is over 1; is_silent below 1e-5."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return blocks.withColumn("peak", peak).withColumn(samples, F.when(F.col("peak") > 1, F.transform(samples, lambda x: x / F.col("peak"))).otherwise(F.col(samples))).withColumn("is_silent", F.coalesce(F.col("peak") < 1e-5, F.lit(True)))


def level_runs(frames: DataFrame, rate: float, floor_db: float = -46.0, least_s: float = 0.075) -> DataFrame:
    """session_id, pitch, start_s, end_s, confidence: unbroken runs of frames
    (session_id, pitch, frame, level_db) above a level, of 75 ms or more; the
    confidence grows with the run's median level."""
    w = Window.partitionBy("session_id", "pitch").orderBy("frame")
    x = frames.where(F.col("level_db") > floor_db).withColumn("run", F.col("frame") - F.row_number().over(w))
    g = x.groupBy("session_id", "pitch", "run").agg((F.min("frame") / rate).alias("start_s"), ((F.max("frame") + 1) / rate).alias("end_s"), F.median("level_db").alias("db"))
    sure = F.greatest(F.lit(0.05), F.least(F.lit(1.0), (F.col("db") + 46.0) / 34.0))
    return g.where(F.col("end_s") - F.col("start_s") >= least_s).select("session_id", "pitch", "start_s", "end_s", sure.alias("confidence"))


def probable_runs(frames: DataFrame, on: float = 0.30, tolerance: int = 11, least: int = 10, peak: float = 0.58) -> DataFrame:
    """session_id, pitch, first, stop, confidence: frames (session_id, pitch,
    frame, probability) of ``on`` or more, split where ``tolerance`` frames or
    more lie between two; of more than ``least`` frames that reach ``peak``.  The
    confidence is the mean over all frames from first to stop."""
    w = Window.partitionBy("session_id", "pitch").orderBy("frame")
    x = frames.withColumn("active", F.col("probability") >= on).withColumn("before", F.last(F.when(F.col("active"), F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("active") & (F.col("before").isNull() | (F.col("frame") - F.col("before") > tolerance))
    x = x.withColumn("run", F.sum(fresh.cast("int")).over(w)).where("run > 0")
    ends = x.withColumn("stop", F.max(F.when(F.col("active"), F.col("frame"))).over(Window.partitionBy("session_id", "pitch", "run"))).where("frame <= stop")
    g = ends.groupBy("session_id", "pitch", "run").agg(F.min("frame").alias("first"), (F.first("stop") + 1).alias("stop"), F.max("probability").alias("top"), F.sum("probability").alias("total"))
    return g.where((F.col("stop") - F.col("first") > least) & (F.col("top") >= peak)).select("session_id", "pitch", "first", "stop", (F.col("total") / (F.col("stop") - F.col("first"))).alias("confidence"))


def spectrograms(blocks: DataFrame, key: str, samples: str = "samples") -> DataFrame:
    """key, band, column, level of each block's preview (zeros if it is short),
    in batches of blocks."""
    import numpy as np
    import pandas as pd

    from strophe.operators.kernels import spectrogram

    kind = blocks.schema[key].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for k, x in zip(pdf[key], pdf[samples], strict=True):
                m = spectrogram(np.asarray(x if x is not None else [], float))
                band, column = np.indices(m.shape)
                yield pd.DataFrame({key: k, "band": band.ravel(), "column": column.ravel(), "level": m.ravel()})

    return blocks.select(key, samples).mapInPandas(run, f"{key} {kind}, band int, column int, level double")
