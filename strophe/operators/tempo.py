"""Tempo: jump segments, pooled deviation, means, summaries, folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JUMP_BPM, JUMP_RATIO, LEAST_SECONDS = 8.0, 0.08, 10.0


def by_time():
    return Window.partitionBy("session_id").orderBy("time_s", "event_id")


def fold_to(value: Column, reference: Column) -> Column:
    """The octave (x 1, 0.5, 2) within 45..210 nearest to the reference, the
    first of equals; clipped if none is inside."""
    tries = F.array(*[F.struct(F.abs(F.log2(value * m / F.greatest(reference, F.lit(1.0)))).alias("far"), F.lit(i).alias("order"), (value * m).alias("bpm")) for i, m in enumerate((0.5, 1.0, 2.0))])
    inside = F.filter(tries, lambda x: (x["bpm"] >= 45.0) & (x["bpm"] <= 210.0))
    return F.when(F.size(inside) > 0, F.array_min(inside)["bpm"]).otherwise(F.greatest(F.lit(45.0), F.least(F.lit(210.0), value)))


def jump_segments(tempo: DataFrame, jump_bpm: float = JUMP_BPM, jump_ratio: float = JUMP_RATIO) -> DataFrame:
    """tempo with ``segment`` (from 0): a new one starts where the step from the
    previous point is at least max(jump_bpm, ratio * the smaller)."""
    before = F.lag("bpm").over(by_time())
    jump = F.abs(F.col("bpm") - before) >= F.greatest(F.lit(jump_bpm), jump_ratio * F.least(F.abs(F.col("bpm")), F.abs(before)))
    flagged = tempo.withColumn("jump", F.coalesce(jump.cast("int"), F.lit(0)))
    return flagged.withColumn("segment", F.sum("jump").over(by_time()).cast("int")).drop("jump")


def segment_statistics(segments: DataFrame) -> DataFrame:
    """Per segment: points, duration (span plus the median positive spacing)
    and population variance of the bpm."""
    w = Window.partitionBy("session_id", "segment").orderBy("time_s", "event_id")
    step = F.col("time_s") - F.lag("time_s").over(w)
    spaced = segments.withColumn("step", F.when(step > 1e-6, step))
    return spaced.groupBy("session_id", "segment").agg(
        F.count("*").alias("points"),
        F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.max("time_s") - F.min("time_s") + F.coalesce(F.median("step"), F.lit(0.0))).alias("duration_s"),
        F.var_pop("bpm").alias("variance"),
    )


def pooled_std(tempo: DataFrame) -> DataFrame:
    """session_id, bpm_std: variance inside of segments, weighted by duration;
    segments under ten seconds count only where there is but one."""
    stats = segment_statistics(jump_segments(tempo))
    many = F.count("*").over(Window.partitionBy("session_id")) > 1
    used = stats.withColumn("weight", F.when(many & (F.col("duration_s") < LEAST_SECONDS), 0.0).otherwise(F.col("duration_s")))
    weight = F.sum("weight")
    return used.groupBy("session_id").agg(F.when(weight <= 1e-9, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("variance")) / weight))).alias("bpm_std"))


def causal_mean(tempo: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Mean bpm of the last ``seconds`` (both ends included) in the segment."""
    mean = F.expr(f"avg(bpm) over (partition by session_id, segment order by time_s range between {float(seconds)}D preceding and current row)")
    return jump_segments(tempo).withColumn("bpm_mean", mean)


def summary(tempo: DataFrame) -> DataFrame:
    """session_id, average_bpm, min_bpm, max_bpm, bpm_std, mode."""
    plain = tempo.groupBy("session_id").agg(F.avg("bpm").alias("average_bpm"), F.min("bpm").alias("min_bpm"), F.max("bpm").alias("max_bpm"))
    mode = F.when(F.col("max_bpm") - F.col("min_bpm") < 0.05, "constant-grid locked").otherwise("incremental segmented")
    return plain.join(pooled_std(tempo), "session_id").withColumn("mode", mode)


def current_bpm(tempo: DataFrame, playhead: float) -> DataFrame:
    """The last point's bpm up to the playhead, or the average."""
    seen = F.when(F.col("time_s") <= playhead + 0.05, F.col("time_s"))
    return tempo.groupBy("session_id").agg(F.coalesce(F.max_by("bpm", seen), F.avg("bpm")).alias("bpm"))


def dedup_rounded(tempo: DataFrame, reference: float, digits: int = 4) -> DataFrame:
    """One point for each rounded time: nearest to the reference in octaves,
    then the more confident, then the later."""
    far = F.abs(F.log2(F.col("bpm") / F.lit(reference)))
    w = Window.partitionBy("session_id", F.bround("time_s", digits)).orderBy(far, F.desc("confidence"), F.desc("event_id"))
    return tempo.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def last_k(tempo: DataFrame, k: int = 12) -> DataFrame:
    """The latest k points of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("time_s"), F.desc("event_id"))
    return tempo.withColumn("recent", F.row_number().over(w)).where(F.col("recent") <= k)


def filtered(t: DataFrame, name: str, widest: int) -> DataFrame:
    """t with ``name``, the median of the ``widest`` points around (fewer,
    still odd, in a session of fewer); edge values repeat beyond the ends.
    Needs ``n``, the session's points, and ``i``, the place from 0."""
    reach = widest // 2
    half = F.greatest(F.lit(0), F.floor(F.least(F.lit(widest), F.floor(F.col("n") / 2) * 2 - 1) / 2).cast("int"))
    own = F.least(F.col("i"), F.lit(reach))
    near = t.withColumn("near", F.collect_list("bpm").over(by_time().rowsBetween(-reach, reach)))
    values = F.transform(F.sequence(-half, half), lambda d: F.element_at("near", F.greatest(F.lit(1), F.least(F.size("near"), own + d + 1)).cast("int")))
    return near.withColumn(name, F.element_at(F.array_sort(values), half + 1)).drop("near")


def score_features(tempo: DataFrame) -> DataFrame:
    """step_median, step_p90, stable_ratio, high_frequency and low_frequency
    of each session, relative to its average bpm."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    average = F.greatest(F.avg("bpm").over(Window.partitionBy("session_id")), F.lit(1.0))
    step = F.abs(F.col("bpm") - F.lag("bpm").over(by_time()))
    t = tempo.withColumn("n", n).withColumn("average", average).withColumn("step", step).withColumn("i", F.row_number().over(by_time()) - 1)
    t = filtered(t, "baseline", 11).withColumn("baseline", F.when(F.col("n") >= 5, F.col("baseline")))
    a = F.first("average")
    return t.groupBy("session_id").agg(
        F.coalesce(F.median("step") / a, F.lit(0.0)).alias("step_median"),
        F.coalesce(F.percentile("step", 0.9) / a, F.lit(0.0)).alias("step_p90"),
        F.coalesce(F.avg(F.when(F.col("step").isNotNull(), (F.col("step") <= F.greatest(F.lit(0.35), F.col("average") * 0.004)).cast("double"))), F.lit(1.0)).alias("stable_ratio"),
        F.coalesce(F.stddev_pop(F.col("bpm") - F.col("baseline")) / a, F.lit(0.0)).alias("high_frequency"),
        F.coalesce(F.stddev_pop("baseline") / a, F.lit(0.0)).alias("low_frequency"),
    )


def ticks(tempo: DataFrame, times: DataFrame, ppq: int = 480) -> DataFrame:
    """times (session_id, at_s, ...) with ``tick``: the integral of a
    piecewise constant tempo, its first value holding from 0, half to even."""
    w = Window.partitionBy("session_id").orderBy("time_s", "event_id")
    begin = F.when(F.lag("time_s").over(w).isNull(), 0.0).otherwise(F.col("time_s"))
    pieces = tempo.withColumn("from_s", begin)
    pieces = pieces.withColumn("to_s", F.lead("from_s").over(w))
    done = F.coalesce(F.sum((F.col("to_s") - F.col("from_s")) * F.col("bpm") * ppq / 60.0).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = F.lag("from_s").over(w).isNull()
    piece = F.struct("from_s", "bpm", done.alias("done"))
    own = [c for c in times.columns if c not in ("session_id", "at_s")]
    # pieces and times in one window: a time takes the last piece that begins before it, the first piece at the latest;
    # what else a time has goes through with it
    t = times.select("session_id", F.col("at_s").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.struct(F.lit(0).alias("_"), *own).alias("own"))
    p = pieces.select("session_id", F.when(first, F.lit(float("-inf"))).otherwise(F.col("from_s")).alias("at"), F.lit(1).alias("kind"), F.col("event_id").cast("long").alias("turn"), F.lit(None).cast(t.schema["own"].dataType).alias("own"), piece.alias("piece"))
    t = t.withColumn("piece", F.lit(None).cast(p.schema["piece"].dataType))
    before = Window.partitionBy("session_id").orderBy("at", "kind", "turn").rowsBetween(Window.unboundedPreceding, 0)
    x = p.unionByName(t).withColumn("piece", F.last("piece", ignorenulls=True).over(before)).where("kind = 0 and piece is not null")
    return x.select("session_id", *[F.col(f"own.{c}").alias(c) for c in own], F.col("at").alias("at_s"), F.rint(F.col("piece.done") + F.greatest(F.lit(0.0), F.col("at") - F.col("piece.from_s")) * F.col("piece.bpm") * ppq / 60.0).cast("long").alias("tick"))


#: Ratios between metric levels that a tempo may be mistaken for.
METRIC = (0.5, 2 / 3, 0.75, 1.0, 4 / 3, 1.5, 2.0)


def _median(x: list[float]) -> float:
    x = sorted(x)
    m = len(x) // 2
    return x[m] if len(x) % 2 else (x[m - 1] + x[m]) / 2


class TempoFollower:
    """Follows one tempo level; a new level needs three points that agree."""

    def __init__(self, level: float):
        self.level, self.waiting = level, []

    def unfolded(self, bpm: float) -> float:
        far = [abs(math.log2(bpm / max(self.level, 1.0) / m)) for m in METRIC]
        m = METRIC[far.index(min(far))]
        slack = 1.12 if m in (0.5, 2.0) else 1.04
        return bpm / m if min(far) <= math.log2(slack) and 45 <= bpm / m <= 210 else bpm

    def take(self, i: int, bpm: float, out: list[float]) -> None:
        seen = self.unfolded(bpm)
        if abs(seen - self.level) <= max(4.0, 0.04 * self.level):
            out.append(seen)
            self.level, self.waiting = 0.85 * self.level + 0.15 * seen, []
            return
        middle = _median([v for _, v in self.waiting]) if self.waiting else seen
        agrees = self.waiting and abs(seen - middle) <= max(3.0, 0.03 * middle)
        self.waiting = [*self.waiting, (i, seen)] if agrees else [(i, seen)]
        out.append(self.level)
        if len(self.waiting) >= 3:
            for j, v in self.waiting:
                out[j] = v
            self.level, self.waiting = _median([v for _, v in self.waiting]), []


def _runs(values: list[float]) -> list[list[int]]:
    """Neighbours within max(2, 2.5 %) of their run's median so far."""
    out: list[list[int]] = []
    for i, v in enumerate(values):
        if out:
            middle = _median([values[k] for k in out[-1]])
            if abs(v - middle) <= max(2.0, 0.025 * middle):
                out[-1].append(i)
                continue
        out.append([i])
    return out


def _bridge(times: list[float], values: list[float], brief) -> bool:
    """Give inner runs that ``brief`` accepts the mean of their neighbours'
    medians, where those agree."""
    runs, changed = _runs(values), False
    for left, run, right in zip(runs, runs[1:], runs[2:]):
        a, b = _median([values[k] for k in left]), _median([values[k] for k in right])
        if brief(left, run, right) and abs(a - b) <= max(3.0, 0.015 * (a + b)):
            for k in run:
                values[k] = (a + b) / 2
            changed = True
    return changed


def smooth(times: list[float], bpm: list[float], anchor: float | None = None) -> list[float]:
    """Follow the level, flatten single wobbles, bridge brief runs."""
    if not bpm:
        return []
    follower = TempoFollower(anchor or _median(bpm[:3]))
    out: list[float] = []
    for i, v in enumerate(bpm):
        follower.take(i, v, out)
    for i in range(2, len(out) - 2):
        near = [out[i - 2], out[i - 1], out[i + 1], out[i + 2]]
        if max(near) - min(near) <= 1.5 and abs(out[i] - _median(near)) <= 8.0:
            out[i] = _median(near)
    _bridge(times, out, lambda _, run, __: len(run) <= 2 or times[run[-1]] - times[run[0]] <= 2.1)
    return out


def repair(times: list[float], bpm: list[float], longest: float = 3.5) -> list[float]:
    """Bridge excursions of up to ``longest`` seconds, in at most two passes."""
    out = list(bpm)
    if len(out) >= 3:
        for _ in range(2):
            if not _bridge(times, out, lambda left, run, right: times[run[-1]] - times[run[0]] <= longest and times[right[0]] - times[left[-1]] <= longest + 4.0):
                break
    return out


def repeated_levels(estimates: list[float], reference: float) -> list[float]:
    """Medians of the clusters of two or more estimates, if these are two."""
    slack, clusters = max(2.0, 0.025 * reference), []
    for v in sorted(estimates):
        if clusters and abs(v - sum(clusters[-1]) / len(clusters[-1])) <= slack:
            clusters[-1].append(v)
        else:
            clusters.append([v])
    often = [_median(c) for c in clusters if len(c) > 1]
    return often if len(often) == 2 else []


def smoothed(tempo: DataFrame, repaired: bool = False) -> DataFrame:
    """session_id, event_id, time_s, bpm after ``smooth`` (and ``repair``);
    points without a time or a tempo are left out."""

    def run(pdf):
        pdf = pdf.sort_values(["time_s", "event_id"])
        t = pdf["time_s"].tolist()
        values = smooth(t, pdf["bpm"].tolist())
        return pdf.assign(bpm=repair(t, values) if repaired else values)

    whole = tempo.where("time_s is not null and bpm is not null")
    return whole.select("session_id", "event_id", "time_s", "bpm").groupBy("session_id").applyInPandas(run, "session_id long, event_id long, time_s double, bpm double")
