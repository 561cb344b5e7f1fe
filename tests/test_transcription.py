"""Transcription of rendered chords, clicks, and model windows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import transcription as A
from strophe.operators.kernels import WINDOW_FRAMES, WINDOW_SAMPLES

BLOCKS = "session_id long, block int, samples array<float>"
NOTES = "session_id long, start_s double, end_s double, midi_note int"


def cut(session, x, size):
    return [(session, i // size, [float(v) for v in x[i : i + size]]) for i in range(0, len(x), size)]


def test_chords_come_back(spark):
    chords = [(0.5, (48, 55, 64)), (1.5, (53, 57, 72)), (2.5, (50, 62, 65)), (3.5, (60,))]
    rows = [(s, t, t + 0.8, p) for s in (1, 2) for t, ps in chords for p in ps if s == 1 or t < 2]
    audio = A.rendered(spark.createDataFrame(rows, NOTES), 4.5)
    found = A.transcribe(audio).collect()
    for s, t, _, p in rows:
        own = [n for n in found if n["session_id"] == s and n["midi_note"] == p and abs(n["start_s"] - t) <= 0.05]
        assert own, (s, t, p)
    wanted = {(s, p) for s, _, _, p in rows}
    strong = [n for n in found if n["confidence"] > 0.5]
    assert sum((n["session_id"], n["midi_note"]) in wanted for n in strong) >= 0.75 * len(strong)


def test_blocks_of_any_length_give_the_same_frames(spark):
    rng = np.random.default_rng(0)
    t = np.arange(40_000) / A.RATE
    x = 0.3 * np.sin(2 * np.pi * 220 * t) * (t > 0.4) + 0.2 * np.sin(2 * np.pi * 660 * t) * (t > 0.9) + 0.001 * rng.normal(size=len(t))
    got = []
    for size in (40_000, 11_025, 5_000):
        levels = A.pitch_levels(spark.createDataFrame(cut(1, x, size), BLOCKS))
        got.append({(r["frame"], r["pitch"]): r["level_db"] for r in levels.collect()})
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(abs(other[k] - v) < 1e-3 for k, v in got[0].items())
    fluxes = [[r["flux"] for r in A.flux(spark.createDataFrame(cut(1, x, size), BLOCKS)).orderBy("frame").collect()] for size in (40_000, 5_000)]
    assert np.allclose(*fluxes) and len(fluxes[0]) == -(-len(x) // A.FLUX_HOP)


def test_silence_and_odd_rows(spark):
    rows = [(1, 0, [0.0] * 4000), (2, 0, [0.5] * 100), (3, None, [0.5] * 4000), (None, 0, [0.5] * 4000), (4, 0, None), (5, 0, []), (6, 0, [None] * 3000)]
    assert A.transcribe(spark.createDataFrame(rows, BLOCKS)).count() == 0
    assert A.percussive_onsets(spark.createDataFrame(rows[:1] + rows[2:6], BLOCKS)).count() == 0


def test_closed_and_voices():
    on = np.array([[1, 0, 0, 1, 1, 0, 0, 0, 1]], bool)
    assert A.closed(on).tolist() == [[True, True, True, True, True, False, False, False, True]]
    level = np.full((40, 1), -60.0)
    level[[3, 15, 20], 0] = [-2.0, -14.0, -20.0]  # 15 lies an octave above 3 and is 12 dB weaker
    assert np.flatnonzero(A.voices(level)[:, 0]).tolist() == [3, 20]
    level[15] = -8.0
    assert np.flatnonzero(A.voices(level)[:, 0]).tolist() == [3, 15, 20]


def test_repeated_notes_are_cut(spark):
    rows = [(1, f, 60, -10.0, 9.0 if f in (1, 5, 20, 22) else 0.0) for f in range(40)] + [(1, f, 60, -10.0, 0.0) for f in (50, 51)]
    got = A.spectral_notes(spark.createDataFrame(rows, "session_id long, frame int, pitch int, level_db double, rise_db double")).orderBy("start_s").collect()
    frames = [(round(r["start_s"] * A.RATE / A.HOP), round(r["end_s"] * A.RATE / A.HOP)) for r in got]
    assert frames == [(0, 5), (5, 20), (20, 40)]  # 22 comes too soon, 50 to 51 is too short


def test_clicks_without_notes_give_a_tempo(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(A.RATE * 14)
    for t in np.arange(0.5, 13.5, 0.5):
        at = int(t * A.RATE)
        x[at : at + 200] += rng.normal(size=200) * np.exp(-np.arange(200) / 40)
    audio = spark.createDataFrame(cut(1, x, A.RATE // 4), BLOCKS)
    onsets = A.percussive_onsets(audio)
    at = sorted(r["onset_s"] for r in onsets.collect())
    assert len(at) == 26 and np.abs(np.array(at) - np.arange(0.5, 13.5, 0.5)).max() < 0.02
    none = spark.createDataFrame([], NOTES)
    few = spark.createDataFrame([(1, 0.5, 1.0, 60), (2, 0.0, 1.0, 60)], NOTES)
    tempo = A.evidence_tempo(A.onset_evidence(none, onsets)).collect()
    assert tempo and all(abs(r["bpm"] - 120) < 2 for r in tempo)
    merged = A.onset_evidence(few, onsets).groupBy("session_id", "percussive").count().collect()
    assert {(r[0], r[1], r[2]) for r in merged} == {(1, False, 1), (1, True, 26), (2, False, 1)}
    many = spark.createDataFrame([(1, k / 2, k / 2 + 0.4, 60) for k in range(4)], NOTES)
    assert A.onset_evidence(many, onsets).where("percussive").count() == 0


@pytest.mark.parametrize("size", [9_000, 22_050])
def test_identity_model(spark, size):
    """Every frame comes from the samples that lie there."""
    x = np.random.default_rng(2).uniform(size=100_000).astype(np.float32)

    def model(windows):
        # a frame's pitches: its first two samples
        f = windows[:, : WINDOW_FRAMES * 256 - 256 * (WINDOW_FRAMES * 256 > WINDOW_SAMPLES)]
        f = np.pad(f, ((0, 0), (0, WINDOW_FRAMES * 256 - f.shape[1]))).reshape(len(windows), WINDOW_FRAMES, 256)
        return f[:, :, :2], f[:, :, 2:4]

    got = A.model_frames(spark.createDataFrame(cut(1, x, size), BLOCKS), model).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(len(x) * 86 // A.RATE))
    # windows begin half an overlap before their first kept frame
    step, kept = WINDOW_SAMPLES - A.OVERLAP, WINDOW_FRAMES - 30
    for r in got:
        w, k = divmod(r["frame"], kept)
        at = w * step + (k + 15) * 256 - A.OVERLAP // 2
        assert np.allclose(r["note"], x[at : at + 2]) and np.allclose(r["onset"], x[at + 2 : at + 4])


def test_transcription_by_a_model(spark):
    def model(windows):
        note = np.zeros((len(windows), WINDOW_FRAMES, 88))
        note[:, 40:80, 39] = 0.9
        onset = np.zeros_like(note)
        onset[:, 40, 39] = 0.9
        return note, onset

    audio = spark.createDataFrame(cut(1, np.ones(30_000), 10_000), BLOCKS)
    (note,) = A.transcribe(audio, model).collect()
    assert note["midi_note"] == 60 and note["start_s"] == pytest.approx(25 * 256 / A.RATE, abs=0.01)
    assert A.transcribe(audio.where(F.lit(False)), model).count() == 0


def test_constant_q_by_octaves():
    """The same magnitudes as by one filter after another, in well under their time."""
    x = np.random.default_rng(7).normal(0, 0.1, 40_000)
    first, count = 9000, 40
    filters = A._filters()
    padded = np.pad(x, A.REACH + 1)
    centres = first + A.REACH + 1 + A.HOP * np.arange(count)
    A.constant_q(x, first, count)
    began = time.process_time()
    got = A.constant_q(x, first, count)
    middle = time.process_time()
    want = np.stack([np.abs(np.lib.stride_tricks.sliding_window_view(padded, len(f))[centres - len(f) // 2] @ f) for f in filters])
    assert got == pytest.approx(want, abs=1e-12) and middle - began < 0.5 * (time.process_time() - middle)
    assert A._median(want, 3, 1) == pytest.approx(np.median(np.lib.stride_tricks.sliding_window_view(np.pad(want, ((0, 0), (1, 1)), mode="edge"), 3, axis=1), axis=-1))


def test_spectra_are_found_once(spark):
    """Cells and what is loudest among them come from one pass over the blocks."""
    blocks = spark.createDataFrame([(1, 0, [0.1] * 4096)], "session_id long, block int, samples array<float>")
    assert A.pitch_levels(blocks)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
