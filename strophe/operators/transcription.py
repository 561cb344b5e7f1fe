"""Notes and onsets from samples: spectral transcription and model windows.

Audio comes as rows (session_id, block, samples) of equal blocks at ``RATE``;
the last of a session may be shorter.  A frame belongs to the block where it
lies and needs samples around it, so every block is given a margin of its
neighbours by one shuffle on (session, block); sessions of any length are
spread over tasks.

* ``pitch_levels``: a constant-Q transform with harmonic masks, levels
  relative to the session's loudest cell, the strongest pitches of a frame
  without replicas at harmonics.
* ``spectral_notes``: runs of those frames as notes, cut where a level jumps.
* ``flux`` and ``percussive_onsets``: spectral flux and its peaks.
* ``model_frames``: overlapping windows for a note model, trimmed and joined.
* ``transcribe``: the model if there is one, else the spectrum.

Defined cases: null samples are silence; blocks without a session, number or
samples are left out; a missing block is silence; a session under 2,048 samples
or with no sample of 1e-5 has no notes; repeated blocks count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.kernels import WINDOW_FRAMES, WINDOW_SAMPLES
from strophe.operators.tracking import envelope, peaks, tempo_track

# Fixed values of the transcription.
RATE, HOP, LOW, BINS = 22_050, 512, 36, 72
FLOOR_DB, BELOW_PEAK_DB, TOP_DB, REPLICA_DB, RISE_DB = -46.0, 31.0, 70.0, 9.0, 7.5
HARMONICS, VOICES, MASK, LEAST_S = (12, 19, 24, 28, 31, 36), 12, 17, 0.075
FLUX_HOP, FLUX_SIZE, BANDS = 128, 2048, 128
OVERLAP = 30 * 256

Q = 1 / (2 ** (1 / 12) - 1)
#: Samples of the longest filter, to either side of a frame.
REACH = int(np.ceil(Q * RATE / (440 * 2 ** ((LOW - 69) / 12)) / 2))
#: Frames to either side: of the masks, and of the smoothing and closing.
AROUND, NEAR = MASK // 2, 5


def _filters() -> list[np.ndarray]:
    """A windowed complex tone for each pitch, for the root of its length."""
    out = []
    for k in range(BINS):
        f = 440 * 2 ** ((LOW + k - 69) / 12)
        n = int(np.ceil(Q * RATE / f)) | 1
        w = np.hanning(n + 2)[1:-1]
        out.append(w / w.sum() * np.sqrt(n) * np.exp(-2j * np.pi * f / RATE * (np.arange(n) - n // 2)))
    return out


_FILTERS: list[np.ndarray] = []


def _octaves() -> list[np.ndarray]:
    """The filters of each twelve pitches side by side, [samples, 24]: real
    parts, then imaginary ones, all around the same middle."""
    out = []
    for k in range(0, BINS, 12):
        own = _filters()[k : k + 12]
        wide = np.zeros((len(own[0]), 12), complex)
        for i, f in enumerate(own):
            at = len(own[0]) // 2 - len(f) // 2
            wide[at : at + len(f), i] = f
        out.append(np.hstack([wide.real, wide.imag]))
    return out


def constant_q(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Magnitudes [BINS, count] of frames around samples first, first + HOP, ..."""
    if not _FILTERS:
        _FILTERS.extend(_octaves())
    x = np.pad(samples, REACH + 1)
    centres = first + REACH + 1 + HOP * np.arange(count)
    found = []
    for wide in _FILTERS:
        parts = sliding_window_view(x, len(wide))[centres - len(wide) // 2] @ wide
        found.append(np.hypot(parts[:, :12], parts[:, 12:]).T)
    return np.vstack(found)


def _median(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    if size == 3 and axis == 1:
        p = np.pad(x, ((0, 0), (1, 1)), mode="edge")
        a, b, c = p[:, :-2], p[:, 1:-1], p[:, 2:]
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
    half = size // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(x.ndim)]
    return np.partition(sliding_window_view(np.pad(x, pad, mode="edge"), size, axis=axis), half, axis=-1)[..., half]


def harmonic(cq: np.ndarray) -> np.ndarray:
    """Magnitudes with what is longer than broad kept (a soft mask)."""
    along, across = _median(cq, MASK, 1), _median(cq, MASK, 0)
    return cq * along / (along + across + 1e-9)


def voices(level: np.ndarray) -> np.ndarray:
    """Active cells of levels [BINS, frames]: local maxima near the frame's
    peak, the VOICES loudest, without replicas of a much louder pitch."""
    edge = np.full((1, level.shape[1]), -80.0)
    above, below = np.vstack([edge, level[:-1]]), np.vstack([level[1:], edge])
    on = (level >= above) & (level > below) & (level > FLOOR_DB) & (level > level.max(axis=0) - BELOW_PEAK_DB)
    out = np.zeros_like(on)
    for t in np.flatnonzero(on.any(axis=0)):
        found = np.flatnonzero(on[:, t])
        kept: list[int] = []
        for p in found[np.argsort(-level[found, t], kind="stable")][:VOICES].tolist():
            if not any(p - q in HARMONICS and level[q, t] > level[p, t] + REPLICA_DB for q in kept):
                kept.append(p)
        out[kept, t] = True
    return out


def closed(on: np.ndarray) -> np.ndarray:
    """Cells with holes of one or two frames filled."""
    p = np.pad(on, ((0, 0), (2, 2)))
    wide = p[:, 1:-1] | p[:, :-2] | p[:, 2:]
    return wide[:, 1:-1] & wide[:, :-2] & wide[:, 2:]


def _samples(x) -> np.ndarray:
    return np.nan_to_num(np.asarray(x, float)) if x is not None else np.zeros(0)


def with_margins(blocks: DataFrame, margin: int) -> DataFrame:
    """session_id, block, place, size, samples: for every block the parts of its own
    and its neighbours' samples within ``margin`` of it, with their places
    (0 is the block's first sample); ``size`` is the session's block length."""
    one = blocks.where("session_id is not null and block is not null and samples is not null").groupBy("session_id", "block").agg(F.max("samples").alias("samples"))
    length = one.groupBy("session_id").agg(F.max(F.size("samples")).alias("size"))
    x = one.join(length, "session_id").where("size > 0")
    reach = F.ceil(F.lit(margin) / F.col("size")).cast("int")
    x = x.withColumn("to", F.explode(F.sequence(-reach, reach)))
    place = -F.col("to") * F.col("size")
    # what lies within the margin: the end of an earlier block, the beginning of a later one
    begin = F.greatest(F.lit(0), -margin - place)
    end = F.least(F.size("samples"), F.col("size") + margin - place)
    part = F.slice("samples", begin + 1, F.greatest(F.lit(0), end - begin))
    return x.select("session_id", (F.col("block") + F.col("to")).alias("block"), (place + begin).alias("place"), "size", F.when(F.col("to") == 0, F.size("samples")).alias("own"), part.alias("samples"))


def _per_block(blocks: DataFrame, margin: int, run: Callable[[int, np.ndarray, int, int], list[tuple]], shape: str) -> DataFrame:
    """Rows of ``run(block, samples, own, size)`` for each block: its samples
    with ``margin`` of them before and after."""
    kind = blocks.schema["session_id"].dataType.simpleString()
    names = ["session_id", *(c.split()[0] for c in shape.split(", "))]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["own"].dropna()
        if own.empty:  # beside a session's end
            return pd.DataFrame([], columns=names)
        size = int(pdf["size"].iloc[0])
        x = np.zeros(size + 2 * margin)
        for at, part in zip(pdf["place"].astype(int) + margin, pdf["samples"], strict=True):
            x[at : at + len(part)] = _samples(part)
        return pd.DataFrame([(pdf["session_id"].iloc[0], *r) for r in run(int(pdf["block"].iloc[0]), x, int(own.iloc[0]), size)], columns=names)

    return with_margins(blocks, margin).groupBy("session_id", "block").applyInPandas(each, f"session_id {kind}, {shape}")


def _frames(block: int, own: int, size: int, hop: int) -> tuple[int, int]:
    """The first frame of a block, and how many lie in it."""
    first = -(-block * size // hop)
    return first, max(0, (block * size + own - 1) // hop - first + 1)


def pitch_levels(blocks: DataFrame) -> DataFrame:
    """session_id, frame, pitch, level_db, rise_db: active pitches of every
    frame of HOP samples, their level and how much it has risen in a frame."""
    margin = REACH + HOP * (AROUND + NEAR + 1)

    def spectrum(block: int, x: np.ndarray, own: int, size: int) -> list[tuple]:
        first, count = _frames(block, own, size, HOP)
        if not count:
            return []
        # the masks need more frames than are kept, the session's first frame has none before it
        lead = min(first, AROUND + NEAR)
        cq = harmonic(constant_q(x, margin + (first - lead) * HOP - block * size, lead + count + AROUND + NEAR))
        keep = min(first, NEAR)
        cq = cq[:, lead - keep : lead + count + NEAR].astype(np.float32)
        return [(block, first - keep, keep, count, float(cq[:, keep : keep + count].max()), float(np.abs(x).max()), own, cq.tobytes())]

    cells = _per_block(blocks, margin, spectrum, "block long, first int, lead int, count int, top double, peak double, own int, cq binary")
    # one window, not a join of the cells with their own sums, which would find them twice
    session = Window.partitionBy("session_id")
    cells = cells.withColumns({"loudest": F.max("top").over(session), "peak": F.max("peak").over(session), "length": F.sum("own").over(session)})
    cells = cells.where("length >= 2048 and peak >= 1e-5 and loudest > 1e-9")
    kind = blocks.schema["session_id"].dataType.simpleString()
    shape = f"session_id {kind}, frame int, pitch int, level_db double, rise_db double"

    def active(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                cq = np.frombuffer(r.cq, np.float32).reshape(BINS, -1).astype(float)
                level = np.maximum(20 * np.log10(np.maximum(cq, 1e-5 * r.loudest) / r.loudest), -TOP_DB)
                level = _median(level, 3, 1)
                on = closed(voices(level))[:, r.lead : r.lead + r.count]
                rise = np.diff(level, axis=1, prepend=level[:, :1])[:, r.lead : r.lead + r.count]
                pitch, frame = np.nonzero(on)
                yield pd.DataFrame({"session_id": r.session_id, "frame": (r.first + r.lead + frame).astype(np.int32), "pitch": (pitch + LOW).astype(np.int32), "level_db": level[:, r.lead : r.lead + r.count][pitch, frame], "rise_db": rise[pitch, frame]})

    return cells.select("session_id", "first", "lead", "count", "cq", "loudest").mapInPandas(active, shape)


def spectral_notes(levels: DataFrame) -> DataFrame:
    """session_id, start_s, end_s, midi_note, confidence: unbroken runs of
    ``pitch_levels``, cut where a level has jumped by RISE_DB, three frames or
    more after the note's start."""
    w = Window.partitionBy("session_id", "pitch").orderBy("frame")
    x = levels.withColumn("run", F.col("frame") - F.row_number().over(w))
    # the jumps of a run that cut it, in order: each at least three frames after the last
    runs = x.groupBy("session_id", "pitch", "run").agg(F.min("frame").alias("first"), F.array_sort(F.collect_list(F.when(F.col("rise_db") > RISE_DB, F.col("frame")))).alias("jumps"))
    begin = F.array(F.col("first"))
    cuts = F.aggregate("jumps", begin, lambda done, j: F.when(j - F.element_at(done, -1) >= 3, F.array_append(done, j)).otherwise(done))
    x = x.join(runs.select("session_id", "pitch", "run", cuts.alias("cuts")), ["session_id", "pitch", "run"])
    x = x.withColumn("note", F.array_max(F.filter("cuts", lambda c: c <= F.col("frame"))))
    g = x.groupBy("session_id", "pitch", "note").agg((F.max("frame") + 1).alias("stop"), F.median("level_db").alias("db"))
    sure = F.greatest(F.lit(0.05), F.least(F.lit(1.0), (F.col("db") + 46.0) / 34.0))
    start, end = F.col("note") * HOP / RATE, F.col("stop") * HOP / RATE
    return g.where(end - start >= LEAST_S).select("session_id", start.alias("start_s"), end.alias("end_s"), F.col("pitch").alias("midi_note"), sure.alias("confidence"))


def _bands() -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, each of unit area."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FLUX_SIZE, 1 / RATE)
    up, down = (f[None] - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def flux(blocks: DataFrame) -> DataFrame:
    """session_id, frame, flux: how much the bands' levels rise from the frame
    before, on average; frames of FLUX_HOP samples."""
    margin = FLUX_SIZE // 2 + FLUX_HOP
    bands = _bands()

    def run(block: int, x: np.ndarray, own: int, size: int) -> list[tuple]:
        first, count = _frames(block, own, size, FLUX_HOP)
        if not count:
            return []
        centre = margin + first * FLUX_HOP - block * size
        seen = sliding_window_view(x, FLUX_SIZE)[centre - FLUX_SIZE // 2 - FLUX_HOP :: FLUX_HOP][: count + 1]
        level = 10 * np.log10(np.maximum(1e-10, np.abs(np.fft.rfft(seen * np.hanning(FLUX_SIZE), axis=1)) ** 2 @ bands.T))
        rise = np.maximum(0, np.diff(level, axis=0)).mean(axis=1)
        return list(zip(range(first, first + count), rise.tolist(), strict=True))

    return _per_block(blocks, margin, run, "frame int, flux double")


def percussive_onsets(blocks: DataFrame) -> DataFrame:
    """session_id, onset_s: peaks of the flux.  A click raises it as soon as it
    enters a window, half a window before its own frame."""
    kind = blocks.schema["session_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("frame")["flux"].to_numpy()
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "onset_s": (peaks(x, wait=5) + FLUX_SIZE // FLUX_HOP // 2) * FLUX_HOP / RATE})

    return flux(blocks).groupBy("session_id").applyInPandas(run, f"session_id {kind}, onset_s double")


def onset_evidence(notes: DataFrame, onsets: DataFrame, least: int = 4) -> DataFrame:
    """session_id, onset_s, percussive: starts of notes, and for sessions of
    fewer than ``least`` different ones (three digits) the percussive onsets,
    too.  Sessions may have either only."""
    starts = notes.groupBy("session_id", F.bround("start_s", 3).alias("at")).agg(F.min("start_s").alias("onset_s"))
    counts = starts.groupBy("session_id").agg(F.count("*").alias("n"))
    sparse = onsets.join(counts, "session_id", "left").where(F.coalesce("n", F.lit(0)) < least)
    return starts.select("session_id", "onset_s", F.lit(False).alias("percussive")).union(sparse.select("session_id", "onset_s", F.lit(True)))


def evidence_tempo(evidence: DataFrame) -> DataFrame:
    """session_id, time_s, bpm, confidence of ``onset_evidence``."""
    kind = evidence.schema["session_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["onset_s"].to_numpy())
        return pd.DataFrame(tempo_track(envelope(at, float(at.max()) + 0.5)), columns=["time_s", "bpm", "confidence"]).assign(session_id=pdf["session_id"].iloc[0])

    return evidence.groupBy("session_id").applyInPandas(run, f"time_s double, bpm double, confidence double, session_id {kind}")


def model_frames(blocks: DataFrame, model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """session_id, frame, note, onset (arrays): frames of a note model.

    ``model`` takes windows [n, WINDOW_SAMPLES] and gives note and onset values
    [n, WINDOW_FRAMES, pitches].  Windows overlap by OVERLAP samples; half of
    the frames that lie in the overlap go on either side, and frames beyond the
    audio are cut off.  It runs where the windows are, one after another.
    """
    step, trim = WINDOW_SAMPLES - OVERLAP, OVERLAP // 256 // 2
    kept = WINDOW_FRAMES - 2 * trim
    kind = blocks.schema["session_id"].dataType.simpleString()
    one = blocks.where("session_id is not null and block is not null and samples is not null").groupBy("session_id", "block").agg(F.max("samples").alias("samples"))
    length = one.groupBy("session_id").agg(F.max(F.size("samples")).alias("size"), F.max_by(F.size("samples"), "block").alias("last"), F.max("block").alias("blocks"))
    length = length.select("session_id", "size", (F.col("blocks") * F.col("size") + F.col("last")).alias("length")).where("length > 0")
    begin = F.col("block") * F.col("size") + OVERLAP // 2  # the audio begins after half an overlap of silence
    first = F.greatest(F.lit(0), F.floor((begin - WINDOW_SAMPLES) / step).cast("int") + 1)
    last = F.floor((begin + F.size("samples") - 1) / step).cast("int")
    parts = one.join(length, "session_id").where(F.size("samples") > 0)
    parts = parts.withColumn("window", F.explode(F.sequence(first, last))).select("session_id", "window", "length", (begin - F.col("window") * step).alias("place"), "samples")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(WINDOW_SAMPLES, np.float32)
        for at, part in zip(pdf["place"].astype(int), pdf["samples"], strict=True):
            part = _samples(part)
            lo, hi = max(0, at), min(WINDOW_SAMPLES, at + len(part))
            if hi > lo:
                x[lo:hi] = part[lo - at : hi - at]
        note, onset = (np.asarray(y)[0, trim:-trim] for y in model(x[None]))
        frame = int(pdf["window"].iloc[0]) * kept + np.arange(kept)
        inside = frame < int(pdf["length"].iloc[0]) * (RATE // 256) // RATE
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "frame": frame[inside].astype(np.int32), "note": list(note[inside].astype(float)), "onset": list(onset[inside].astype(float))})

    return parts.groupBy("session_id", "window").applyInPandas(run, f"session_id {kind}, frame int, note array<double>, onset array<double>")


def transcribe(blocks: DataFrame, model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """session_id, start_s, end_s, midi_note, confidence of audio: by the model
    (``kernels.note_events`` of its frames) if there is one, else by the
    spectrum."""
    if model is None:
        return spectral_notes(pitch_levels(blocks))
    from strophe.operators.kernels import note_events

    return note_events(model_frames(blocks, model)).select("session_id", "start_s", "end_s", "midi_note", "confidence")


def rendered(notes: DataFrame, seconds: float, block_s: float = 0.5, gain: float = 0.2) -> DataFrame:
    """session_id, block, samples: notes (session_id, start_s, end_s,
    midi_note) as decaying tones with four harmonics, up to ``seconds``."""
    size = int(RATE * block_s)
    count = int(np.ceil(seconds * RATE / size))
    kind = notes.schema["session_id"].dataType.simpleString()
    within = F.least(F.lit(count - 1), F.floor(F.col("end_s") / block_s).cast("int"))
    each = notes.where("start_s >= 0 and end_s > start_s").withColumn("block", F.explode(F.sequence(F.floor(F.col("start_s") / block_s).cast("int"), F.greatest(within, F.floor(F.col("start_s") / block_s).cast("int")))))
    each = each.where(F.col("block") < count).select("session_id", "block", "start_s", "end_s", "midi_note")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        t = (block * size + np.arange(size)) / RATE
        x = np.zeros(size)
        for a, b, p in zip(pdf["start_s"], pdf["end_s"], pdf["midi_note"], strict=True):
            f, s = 440 * 2 ** ((p - 69) / 12), t - a
            loud = np.where((s >= 0) & (t < b), np.exp(-1.5 * np.maximum(s, 0)) * np.minimum(1, np.maximum(s, 0) / 0.005), 0.0)
            for h in range(1, 5):
                if h * f < RATE / 2:
                    x += gain * loud * np.sin(2 * np.pi * h * f * s) / h**2
        return pd.DataFrame({"session_id": [pdf["session_id"].iloc[0]], "block": [block], "samples": [x.astype(np.float32)]})

    return each.groupBy("session_id", "block").applyInPandas(run, f"session_id {kind}, block int, samples array<float>")
