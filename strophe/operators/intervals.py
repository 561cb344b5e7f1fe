"""Interval algebra on notes and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(notes: DataFrame, start: float, end: float) -> DataFrame:
    """session_id, coverage: the share of [start, end) under any note."""
    if end <= start:
        raise ValueError("an empty window")
    cut = notes.where((F.col("end_s") > start) & (F.col("start_s") < end)).select("session_id", F.greatest(F.col("start_s"), F.lit(start)).alias("a"), F.least(F.col("end_s"), F.lit(end)).alias("b"))
    reach = F.max("b").over(Window.partitionBy("session_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("a"), F.coalesce(reach, F.col("a"))))
    return cut.withColumn("new", new).groupBy("session_id").agg((F.sum("new") / F.lit(end - start)).alias("coverage"))


def merge_notes(existing: DataFrame, detected: DataFrame, window_start: float, context: float = 2.0) -> DataFrame:
    """Notes that end before the replaced part, and newly detected ones
    (shifted) that end in it."""
    cut = 0.0 if window_start <= 0 else window_start + context
    moved = detected.withColumn("start_s", F.col("start_s") + window_start).withColumn("end_s", F.col("end_s") + window_start)
    return existing.where(F.col("end_s") <= cut).unionByName(moved.where(F.col("end_s") > cut))


def visible(notes: DataFrame, elapsed: float) -> DataFrame:
    """Notes begun by ``elapsed``, ended there at the latest."""
    return notes.where((F.col("start_s") <= elapsed) & (F.col("end_s") > F.col("start_s"))).withColumn("end_s", F.least("end_s", F.lit(elapsed)))


def rebase(notes: DataFrame, offset: float) -> DataFrame:
    """Times from ``offset`` on; notes that end before it go."""
    return notes.where(F.col("end_s") > offset).withColumn("start_s", F.greatest(F.lit(0.0), F.col("start_s") - offset)).withColumn("end_s", F.col("end_s") - offset)


def spans(notes: DataFrame) -> DataFrame:
    """notes once for every second they touch, with that ``second``; joins of
    times and notes then meet by session and second, in linear work."""
    return notes.where("end_s >= start_s").withColumn("second", F.explode(F.sequence(F.floor("start_s"), F.floor("end_s"))))


def active_at(notes: DataFrame, times: DataFrame) -> DataFrame:
    """For each time (session_id, time_s): the number of notes sounding, their
    lowest pitch, and the sorted pitch classes."""
    left, right = times.withColumn("second", F.floor("time_s")).alias("t"), spans(notes).alias("n")
    on = (F.col("t.session_id") == F.col("n.session_id")) & (F.col("t.second") == F.col("n.second")) & (F.col("n.start_s") <= F.col("t.time_s")) & (F.col("t.time_s") < F.col("n.end_s"))
    return left.join(right, on, "left").groupBy("t.session_id", "t.time_s").agg(
        F.count("n.event_id").alias("sounding"), F.min("n.midi_note").alias("lowest"), F.array_join(F.array_sort(F.collect_set(F.col("n.midi_note") % 12)), " ").alias("classes")
    )


def segment_at(times: DataFrame, segments: DataFrame, value: str, unknown: str = "Unknown") -> DataFrame:
    """times (session_id, time_s, ...) with ``value`` of the segment around;
    else of the session's last segment, else ``unknown``.  Segments do not
    overlap; both sides go through one window, so no pairs are made."""
    cols = [c for c in times.columns if c not in ("session_id", "time_s")]
    types = dict(times.dtypes)
    s = segments.select("session_id", F.col("start_s").alias("time_s"), F.lit(0).alias("kind"), F.struct("start_s", "end_s", F.col(value).alias("v")).alias("seg"), *[F.lit(None).cast(types[c]).alias(c) for c in cols])
    t = times.select("session_id", "time_s", F.lit(1).alias("kind"), F.lit(None).cast(s.schema["seg"].dataType).alias("seg"), *cols)
    w = Window.partitionBy("session_id").orderBy("time_s", "kind")
    x = s.unionByName(t).withColumn("near", F.last("seg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("final", F.max("seg").over(Window.partitionBy("session_id"))).where("kind = 1")
    inside = F.when(F.col("time_s") < F.col("near.end_s"), F.col("near.v"))
    return x.select("session_id", "time_s", *cols, F.coalesce(inside, F.col("final.v"), F.lit(unknown)).alias(value))


def _clipped(existing: list[dict], updated: list[dict], cutoff: float, duration: float) -> list[dict]:
    old = [s | {"end_s": min(s["end_s"], cutoff)} for s in existing if s["start_s"] < min(s["end_s"], cutoff)]
    new = [s | {"start_s": max(s["start_s"], cutoff)} for s in updated if s["end_s"] > max(s["start_s"], cutoff)]
    out = [s | {"start_s": max(0.0, s["start_s"]), "end_s": min(duration, s["end_s"])} for s in sorted(old + new, key=lambda s: (s["start_s"], s["end_s"]))]
    return [s for s in out if s["end_s"] > s["start_s"]]


def merge_segments(existing: list[dict], updated: list[dict], cutoff: float, duration: float, same: tuple[str, ...], filler: dict | None = None) -> list[dict]:
    """Segments before ``cutoff`` from ``existing``, then from ``updated``,
    without overlap or gap up to ``duration``.

    Without ``filler`` a gap extends what precedes it (the first segment is
    pulled back to 0); with it a gap becomes a segment with those values and
    confidence 0.  Neighbours equal in ``same`` become one, their confidence
    weighted by duration.
    """
    out: list[dict] = []

    def gap(to: float, like: dict) -> None:
        at = out[-1]["end_s"] if out else 0.0
        if to <= at:
            return
        if filler is not None:
            out.append(like | filler | {"start_s": at, "end_s": to, "confidence": 0.0})
        elif out:
            out[-1] = out[-1] | {"end_s": to}

    for s in _clipped(existing, updated, cutoff, duration):
        first = not out
        gap(s["start_s"], out[-1] if out else s)
        at = out[-1]["end_s"] if out else 0.0
        s = s | {"start_s": 0.0 if first and filler is None else max(s["start_s"], at)}
        if s["end_s"] <= s["start_s"]:
            continue
        last = out[-1] if out else None
        if last and all(last[k] == s[k] for k in same):
            a, b = last["end_s"] - last["start_s"], s["end_s"] - s["start_s"]
            out[-1] = s | {"start_s": last["start_s"], "confidence": (last["confidence"] * a + s["confidence"] * b) / max(a + b, 1e-9)}
        else:
            out.append(s)
    if out:
        gap(duration, out[-1])
    return out


def merge_keys(existing, updated, cutoff, duration):
    return merge_segments(existing, updated, cutoff, duration, ("key",))


def merge_chords(existing, updated, cutoff, duration):
    return merge_segments(existing, updated, cutoff, duration, ("chord", "key"), {"chord": "N", "function": ""})


def _merged(existing: DataFrame, updated: DataFrame, columns: tuple[str, ...], fold, cutoff: float) -> DataFrame:
    import pandas as pd

    kind = existing.schema["session_id"].dataType.simpleString()
    names = ["start_s", "end_s", "confidence", *columns]

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        both = [x[names].to_dict("records") for x in (old, new)]
        end = max((s["end_s"] for s in both[0] + both[1]), default=0.0)
        out = pd.DataFrame(fold(*both, cutoff, end), columns=names)
        out.insert(0, "session_id", (old if len(old) else new)["session_id"].iloc[0])
        return out

    texts = ", ".join(f"{c} string" for c in columns)
    return existing.groupBy("session_id").cogroup(updated.groupBy("session_id")).applyInPandas(run, f"session_id {kind}, start_s double, end_s double, confidence double, {texts}")


def merged_keys(existing: DataFrame, updated: DataFrame, cutoff: float) -> DataFrame:
    """``merge_keys`` for every session, up to its latest end."""
    return _merged(existing, updated, ("key",), merge_keys, cutoff)


def merged_chords(existing: DataFrame, updated: DataFrame, cutoff: float) -> DataFrame:
    """``merge_chords`` for every session, up to its latest end."""
    names = tuple(c for c in ("chord", "key", "function") if c in existing.columns and c in updated.columns)
    return _merged(existing, updated, names, merge_chords, cutoff)
