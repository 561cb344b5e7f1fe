"""Sequential operators on small cases with known answers."""

import math

import pytest

from strophe.operators.beats import MeterMemory, merge_beats
from strophe.operators.intervals import merge_chords, merge_keys
from strophe.operators.tempo import repair, repeated_levels, smooth
from strophe.sources import audio, midi
from strophe.streaming.session import Limits, segment


def test_short_excursion_is_repaired():
    times = [float(i) for i in range(31)]
    bpm = [86.0 if 18 <= t <= 20 else 150.0 for t in times]
    assert repair(times, bpm) == [150.0] * 31


def test_lasting_step_stays():
    times = [float(i) for i in range(20)]
    bpm = [90.0] * 10 + [112.0] * 10
    out = smooth(times, bpm)
    assert out[:9] == pytest.approx([90.0] * 9) and out[-8:] == pytest.approx([112.0] * 8)


def test_metric_double_is_folded():
    times = [float(i) for i in range(12)]
    assert smooth(times, [100.0] * 5 + [200.0] * 2 + [100.0] * 5) == pytest.approx([100.0] * 12)


def test_levels():
    assert repeated_levels([80, 81, 120, 121, 150], 100) == [80.5, 120.5]
    assert repeated_levels([80, 81, 82], 100) == []
    assert smooth([], []) == [] and repair([], []) == []


def seg(start, end, key, **more):
    return {"start_s": start, "end_s": end, "key": key, "confidence": 0.5} | more


def test_key_merge_extends_over_gaps():
    out = merge_keys([seg(0, 20, "C")], [seg(8, 19, "C"), seg(19, 30, "G")], 18, 30)
    assert [(s["start_s"], s["end_s"], s["key"]) for s in out] == [(0, 19, "C"), (19, 30, "G")]


def test_chord_merge_fills_gaps():
    a = seg(0, 20, "k", chord="C", function="I")
    b = seg(22, 30, "k", chord="G", function="V")
    out = merge_chords([a], [b], 18, 30)
    assert [(s["start_s"], s["end_s"], s["chord"]) for s in out] == [(0, 18, "C"), (18, 22, "N"), (22, 30, "G")]
    assert merge_chords([], [], 18, 30) == []


def test_meter_needs_confirmation():
    m = MeterMemory()
    assert [m.see(4) for _ in range(3)][-1] == (4, False) and m.stable == 4
    assert [m.see(3)[0] for _ in range(7)] == [4] * 7
    assert m.see(3) == (3, True)
    assert m.see(None) == (3, False)


def test_beats_keep_their_phase():
    old = [{"time_s": i * 0.5, "beat_in_bar": i % 4 + 1, "is_downbeat": i % 4 == 0} for i in range(10)]
    new = [{"time_s": 5.0 + i * 0.5, "beat_in_bar": 1, "is_downbeat": True} for i in range(5)]
    out = merge_beats(old, new, 17.0, 4)
    assert [b["beat_in_bar"] for b in out] == [i % 4 + 1 for i in range(15)]
    assert merge_beats(old, [], 17.0, 4) == old


def test_sessions():
    blocks = [(i * 0.25, 0.25, -20.0 if 4 <= i < 104 else -80.0) for i in range(140)]
    (a, b), = segment(blocks)
    assert a == 0.0 and b == 26.0
    assert segment([(i * 0.25, 0.25, -20.0 if i < 40 else -80.0) for i in range(80)]) == []
    assert segment([], Limits()) == []


def test_midi_round_trip():
    events = [(0, "tempo", 0, 0, 500_000, ""), (0, "on", 60, 96, 0, ""), (480, "off", 60, 0, 0, ""), (480, "on", 200, 300, 0, ""), (481, "off", 200, 0, 0, ""), (0, "marker", 0, 0, 0, "DOWNBEAT")]
    ppq, found = midi.messages(midi.encode(events))
    assert ppq == 480
    assert [(m[0], m[1], m[2]) for m in found if m[1] in ("on", "off")] == [(0, "on", 60), (480, "off", 60), (480, "on", 127), (481, "off", 127)]
    with pytest.raises(ValueError):
        midi.messages(b"junk")


def test_midi_files_in_spark(spark, tmp_path):
    (tmp_path / "s1_transcription.mid").write_bytes(midi.encode([(0, "tempo", 0, 0, 1_000_000, ""), (0, "off", 60, 0, 0, ""), (240, "on", 60, 90, 0, ""), (480, "on", 60, 80, 0, ""), (720, "off", 60, 0, 0, "")]))
    rows = sorted(map(tuple, midi.notes(midi.timed(midi.read(spark, str(tmp_path)))).select("start_s", "end_s", "velocity").collect()))
    assert rows == [(0.5, 1.5, 90), (1.0, 1.5, 80)]


def test_wav():
    data = audio.encode([0.0, 2.0, -2.0] * 7350)
    assert math.isclose(audio.duration(data), 1.0) and audio.duration(b"") == 0.0
