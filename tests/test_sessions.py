"""Live refreshes, closing of sessions, exports, and what views show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import display as D
from strophe.operators import grouping as G
from strophe.operators import harmony as H
from strophe.operators import kernels as K
from strophe.operators import sessions as Z
from strophe.operators import tempo as T
from strophe.operators import timing as X
from strophe.operators import tracking as Y
from strophe.sources import audio, chords, export, midi, settings
from strophe.streaming.live import Live, refreshes

NOTES = "session_id long, event_id long, start_s double, end_s double, midi_note int, confidence double"


def grid(session, begin, end, step=0.5, length=0.3, pitch=60):
    return [(session, 1000 * session + i, float(t), float(t) + length, pitch + i % 3, 0.9) for i, t in enumerate(np.arange(begin, end, step))]


def test_live_refreshes_are_the_replays():
    rows = [r[2:5] for r in grid(1, 0.25, 31)]
    whole, parts = Live(), Live()
    out = whole.take(rows)
    again = []
    for k in range(0, len(rows), 7):  # state goes through its stored form between batches
        again += parts.take(rows[k : k + 7])
        parts = Live(parts.state())
    assert [r[0] for r in out] == [r[0] for r in again] == [1.5 * k for k in range(1, 21)]
    assert [r[5] for r in out] == pytest.approx([r[5] for r in again])
    run = Y.Refresher()
    a, b, p = (np.array([r[i] for r in rows]) for i in range(3))
    for at in np.arange(1.5, 30.1, 1.5):
        seen = a <= at
        run.take(a[seen], np.minimum(b[seen], at), p[seen], at)
    assert out[-1][5] == pytest.approx(run.tempo[-1][1]) and out[-1][9] == pytest.approx(run.beats[-1]["time_s"])
    assert out[0][1] and not out[-1][1] and out[-1][2] == 0.25


def test_live_asks_for_a_pause():
    rows = [r[2:5] for r in grid(1, 0, 12) + grid(1, 30, 31)]
    out = Live().take(rows)
    first = next(r for r in out if r[4])
    assert first[0] == 16.5  # the first refresh whose last 5 s have less than half a second of notes


def test_live_in_a_stream(spark, tmp_path):
    rows = [(r[0], r[2], r[3], r[4]) for r in grid(1, 0, 20) + grid(2, 0, 8)] + [(3, None, 1.0, 60)]
    schema = "session_id long, start_s double, end_s double, midi_note int"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = refreshes(stream).writeStream.outputMode("append").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("live").groupBy("session_id").agg(F.count("*").alias("n"), F.max("at_s").alias("at")).orderBy("session_id").collect()
    assert [tuple(r) for r in got] == [(1, 13, 19.5), (2, 5, 7.5)]


def test_pause_and_closing(spark):
    rows = grid(1, 0, 12) + grid(1, 30, 32) + grid(2, 8, 40) + grid(3, 0, 5) + [(4, 1, 0.0, 0.01, 60, 0.9), (4, 2, 30.0, 30.01, 60, 0.9)]
    notes = spark.createDataFrame(rows, NOTES)
    assert {r["session_id"]: r["pause_s"] for r in Z.auto_pause(notes).collect()} == {1: 16.5, 2: None, 3: None, 4: None}
    c = {r["session_id"]: r for r in Z.closing(notes).collect()}
    assert {i: r["fate"] for i, r in c.items()} == {1: "archived", 2: "archived", 3: "short", 4: "empty"}
    assert c[2]["lead_s"] == pytest.approx(7.8) and c[2]["duration_s"] == pytest.approx(39.8 - 7.8)
    closed = Z.closed_notes(notes, Z.closing(notes)).groupBy("session_id").agg(F.min("start_s").alias("a")).orderBy("session_id").collect()
    assert [r["session_id"] for r in closed] == [1, 2] and closed[1]["a"] == pytest.approx(0.2)
    points = spark.createDataFrame([(2, 1.0, 120.0), (2, 10.0, 121.0), (3, 1.0, 90.0)], "session_id long, time_s double, bpm double")
    assert [(r["session_id"], round(r["time_s"], 6)) for r in Z.closed_points(points, Z.closing(notes)).collect()] == [(2, 2.2)]
    assert {r["fate"] for r in Z.closing(notes, automatic=False).collect()} == {"archived"}
    cover = {(r["session_id"], r["at_s"]): r["coverage"] for r in Z.refresh_coverage(notes).collect()}
    assert cover[1, 1.5] == pytest.approx(0.6) and cover[1, 21.0] == 0 and cover[2, 6.0] == 0


def test_export_and_back(spark, tmp_path):
    notes = spark.createDataFrame([(7, 1, 0.5, 1.0, 60, 0.9), (7, 2, 1.5, 2.0, 64, 0.9), (8, 3, 0.0, 1.0, 200, 0.9)], NOTES).withColumn("velocity", F.lit(300))
    tempo = spark.createDataFrame([(7, 1, 1.0, 120.0), (7, 2, 2.0, 60.0)], "session_id long, event_id long, time_s double, bpm double")
    beats = spark.createDataFrame([(7, 0.5, 1, True), (7, 1.0, 2, False)], "session_id long, time_s double, beat_in_bar int, is_downbeat boolean")
    events = export.midi_events(notes, tempo, beats)
    assert [tuple(r) for r in events.where("kind = 'tempo' and session_id = 7").orderBy("tick").select("tick", "tempo_us").collect()] == [(0, 500000), (960, 500000), (1920, 1000000)]
    made = midi.files(events)
    times = midi.timed(midi.parsed(made.select(F.col("session_id").cast("string").alias("path"), F.col("midi").alias("content"))))
    assert [(r["path"], round(r["start_s"], 3), round(r["end_s"], 3), r["midi_note"], r["velocity"]) for r in midi.notes(times).orderBy("path", "start_s").collect()] == [("7", 0.5, 1.0, 60, 127), ("7", 1.5, 2.0, 64, 127), ("8", 0.0, 1.0, 127, 127)]
    assert [(round(r["time_s"], 3), r["beat_in_bar"], r["is_downbeat"]) for r in midi.beats(times).orderBy("time_s").collect()] == [(0.5, 1, True), (1.0, 2, False)]
    assert [(r["path"], round(r["time_s"], 3), round(r["bpm"], 3)) for r in midi.tempo_points(times).orderBy("path", "time_s").collect()] == [("7", 0.0, 120.0), ("7", 1.0, 120.0), ("7", 2.0, 60.0), ("8", 0.0, 120.0)]


def test_sheets(spark, tmp_path):
    rows = [(1, 2.0, 4.0, "G7", "C major"), (1, 0.0, 2.0, 'a"b,c', "C major")]
    (row,) = export.sheets(spark.createDataFrame(rows, "session_id long, start_s double, end_s double, chord string, key string")).collect()
    assert row["csv"].encode() == b'\xef\xbb\xbfstart_time,end_time,chord_name,key\r\n0.000,2.000,"a""b,c",C major\r\n2.000,4.000,G7,C major\r\n'
    (tmp_path / "x_chords.csv").write_bytes(b"\xef\xbb\xbfstart_time,end_time,chord_name,key\n0.000,2.000,C,C major\n2.000,3.000,F,C major\n3.500,4.000,A,A minor\n")
    (tmp_path / "bad_chords.csv").write_text("start_time,end_time,chord_name,key\nx,2,C,C major\n")
    read = chords.read(spark, str(tmp_path))
    assert sorted((r["start_s"], r["chord"]) for r in read.collect()) == [(0.0, "C"), (2.0, "F"), (3.5, "A")]
    assert sorted((r["start_s"], r["end_s"], r["key"]) for r in chords.keys(read).collect()) == [(0.0, 3.0, "C major"), (3.5, 4.0, "A minor")]


def test_staged_files_and_labels(spark):
    staged = spark.createDataFrame([("a", "midi", "1"), ("a", "chords", "2"), ("a", "audio", "3"), ("b", "midi", "4"), ("b", "audio", "5")], "session_id string, part string, path string")
    archive = spark.createDataFrame([("a", "audio")], "session_id string, part string")
    assert sorted(r["path"] for r in export.uncommitted(staged, archive).collect()) == ["1", "2"]
    labels = spark.createDataFrame([("a", "human"), ("b", "none")], "session_id string, label string")
    assert {r["session_id"] for r in export.labelled_copies(staged, labels).collect()} == {"a"}


def test_written_tables(spark, tmp_path):
    staged = spark.createDataFrame([("a", "midi", "1"), ("b", "midi", "2")], "session_id string, part string, path string")
    export.write_labelled(staged, spark.createDataFrame([("a", "human"), ("b", "non_human")], "session_id string, label string"), str(tmp_path))
    assert sorted((r["label"], r["path"]) for r in spark.read.parquet(str(tmp_path / "labels")).collect()) == [("human", "1"), ("non_human", "2")]
    export.write_table(staged, str(tmp_path / "manifest"))
    assert spark.read.option("header", True).csv(str(tmp_path / "manifest")).count() == 2


def test_settings_files(spark, tmp_path):
    path = str(tmp_path / "settings.json")
    assert settings.load(spark, path)["trigger_seconds"] == 0.6
    settings.save(spark, {"device_name": "mixer é", "recording_mode": "on", "unknown": 1}, path)
    got = settings.load(spark, path)
    assert got["device_name"] == "mixer é" and got["recording_mode"] == "on" and got["keep_running_in_tray"] is True and len(got) == 10
    (tmp_path / "damaged.json").write_text("{broken")
    assert settings.load(spark, str(tmp_path / "damaged.json"))["recording_mode"] == "auto"


def test_wav_durations(spark):
    wav = audio.encode(np.zeros(22_050), 22_050)
    long = b"RIFF" + (0).to_bytes(4, "little") + b"WAVE" + wav[12:36] + b"LIST" + (100_000).to_bytes(4, "little") + bytes(100_000) + wav[36:]
    files = spark.createDataFrame([("a", bytearray(wav)), ("b", bytearray(long)), ("c", bytearray(b"junk")), ("d", None), ("e", bytearray(wav[:30]))], "path string, content binary")
    assert {r["path"]: r["duration_s"] for r in audio.durations(files).collect()} == {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0, "e": 0.0}


def test_monophonic_sessions_have_no_chords(spark):
    triads = [(1, 10 * i + k, 2.0 * i, 2.0 * i + 1.9, p, 0.9) for i in range(20) for k, p in enumerate((60, 64, 67))]
    single = [(2, i, 0.5 * i, 0.5 * i + 0.4, 60 + (0, 4, 7)[i % 3], 0.9) for i in range(80)]
    notes = spark.createDataFrame(triads + single, NOTES)
    frames = H.chroma(notes)
    got = H.chord_segments(frames, H.key_segments(frames), G.polyphony(G.onset_groups(notes))).collect()
    assert {(r["chord"], r["function"]) for r in got if r["session_id"] == 1} == {("C", "I")}
    mono = [r for r in got if r["session_id"] == 2]
    keys = [r for r in H.key_segments(frames).collect() if r["session_id"] == 2]
    assert {r["chord"] for r in mono} == {"N"} and len(mono) == len(keys) and mono[0]["confidence"] == keys[0]["confidence"]


def test_settled_keys():
    window = lambda *names: [(4.0 * i, n, 0.5) for i, n in enumerate(names)]
    one = H.settled_keys(window("C major", "G major", "C major", "C major"), ("C major", 0.5), 20.0)
    assert one == [(0.0, 20.0, "C major", 0.5)]
    two = H.settled_keys(window("C major", "C major", "C major", "G major", "G major"), ("C major", 0.5), 20.0)
    assert [r[:3] for r in two] == [(0.0, 12.0, "C major"), (12.0, 20.0, "G major")]
    assert H.settled_keys([], ("Unknown", 0.0), 1.0) == [(0.0, 1.0, "Unknown", 0.0)]


def test_model_frames_become_notes(spark):
    note, onset = np.zeros((120, 88)), np.zeros((120, 88))
    note[20:60, 39], onset[20, 39] = 0.9, 0.95
    rows = [(1, f, note[f].tolist(), onset[f].tolist()) for f in range(120)] + [(2, f, note[f].tolist(), [0.0] * 88) for f in range(120)]
    got = K.note_events(spark.createDataFrame(rows, "session_id long, frame int, note array<double>, onset array<double>")).orderBy("session_id").collect()
    assert [(r["session_id"], r["midi_note"]) for r in got] == [(1, 60), (2, 60)]
    assert all(r["start_s"] == pytest.approx(float(K.frame_time(20))) and r["confidence"] == pytest.approx(0.9) for r in got)


def test_views(spark):
    beats = spark.createDataFrame([(1, t) for t in (9.0, 10.0, 20.0, 40.0, 41.0)], "session_id long, time_s double")
    assert D.visible_beats(beats, 10.0, 40.0).count() == 3
    one = spark.createDataFrame([(list(range(10)), 0.0, 10.0)], "c array<int>, a double, b double")
    crop = lambda x, y: one.select(D.spectrum_crop(F.col("c"), F.col("a"), F.col("b"), F.lit(x), F.lit(y)).alias("v")).first()["v"]
    assert crop(2.0, 5.0) == [2, 3, 4] and crop(-5.0, 2.0) == [0, 1] and crop(20.0, 30.0) == []
    t = spark.createDataFrame([(1.0, 8.0), (None, 8.0), (9.0, 8.5)], "c double, n double").select(D.latency_text(D.latency(F.col("c"), F.col("n"))).alias("t")).collect()
    assert [r["t"] for r in t] == ["7.0 s !", "-", "0.0 s"]
    assert Z.resampled(np.arange(10), 4).tolist() == [0, 3, 6, 9] and len(Z.resampled(np.arange(0), 4)) == 0


def test_ticks_at_borders(spark):
    tempo = spark.createDataFrame([(1, 1, 1.0, 120.0), (1, 2, 2.0, 60.0), (1, 3, 2.0, 30.0)], "session_id long, event_id long, time_s double, bpm double")
    at = spark.createDataFrame([(1, i, t) for i, t in enumerate((-1.0, 0.0, 1.0, 2.0, 3.0))] + [(2, 9, 1.0), (1, 5, None)], "session_id long, event_id long, at_s double")
    got = {r["event_id"]: r["tick"] for r in T.ticks(tempo, at.na.drop()).collect()}
    assert got == {0: 0, 1: 0, 2: 960, 3: 1920, 4: 2160}


def test_empty_tables(spark):
    notes = spark.createDataFrame([], NOTES)
    tempo = spark.createDataFrame([], "session_id long, event_id long, time_s double, bpm double, confidence double")
    beats = spark.createDataFrame([], "session_id long, time_s double")
    frames = H.chroma(notes)
    for out in (G.onset_groups(notes), X.human_score(notes, tempo, beats), H.key_segments(frames), H.chord_segments(frames, H.key_segments(frames), G.polyphony(G.onset_groups(notes))), Z.auto_pause(notes), Z.closing(notes), Y.replay(notes), T.ticks(tempo, notes.select("session_id", "event_id", F.col("end_s").alias("at_s"))), G.unique_starts(notes), X.articulation(notes, beats), K.valid_windows(notes)):
        assert out.count() == 0


def test_null_rows_leave_other_sessions_alone(spark):
    rows = grid(1, 0, 30) + [(2, 500 + 3 * i + k, 2.0 * i, 2.0 * i + 1.9, p, 0.9) for i in range(15) for k, p in enumerate((60, 64, 67))]
    odd = [(None, 9001, 1.0, 2.0, 60, 0.9), (99, 9002, None, 2.0, 60, 0.9), (99, 9003, 1.0, None, 60, 0.9), (99, 9004, 1.0, 2.0, None, None), (98, 9005, None, None, None, None)]
    points = [(s, i, float(i), 120.0 + i % 3, 0.9) for s in (1, 2) for i in range(30)]
    odd_points = [(99, 1, None, 120.0, 0.5), (99, 2, 1.0, None, None), (None, 3, 1.0, 100.0, 0.5)]
    kind = "session_id long, event_id long, time_s double, bpm double, confidence double"
    beat_rows = [(s, 0.5 * i) for s in (1, 2) for i in range(60)]

    def results(n, p, b):
        notes, tempo, beats = spark.createDataFrame(n, NOTES), spark.createDataFrame(p, kind), spark.createDataFrame(b, "session_id long, time_s double")
        frames = H.chroma(notes)
        keys = H.key_segments(frames)
        outs = [X.human_score(notes, tempo, beats), keys, H.chord_segments(frames, keys, G.polyphony(G.onset_groups(notes))), Z.auto_pause(notes), Z.closing(notes), Y.tempo_tracks(notes), T.smoothed(tempo, repaired=True), K.valid_windows(notes), G.unique_starts(notes), T.ticks(tempo, notes.select("session_id", "event_id", F.col("end_s").alias("at_s")))]
        return [sorted(str(r) for r in out.where("session_id in (1, 2)").collect()) for out in outs]

    plain = results(rows, points, beat_rows)
    assert plain == results(rows + odd, points + odd_points, beat_rows + [(99, None), (None, 1.0)]) and all(plain)


def test_dense_streams_are_grouped(spark):
    """A session whose gaps are all short is one island: groups still begin
    with the first note after the span."""
    starts = [0.02 * i for i in range(3000)]
    notes = spark.createDataFrame([(1, i, t, t + 0.01, 60, 0.9) for i, t in enumerate(starts)], NOTES)
    got = [r["anchor"] for r in G.onset_groups(notes).orderBy("start_s").collect()]
    want, at = [], None
    for t in starts:
        at = t if at is None or t - at > 0.035 else at
        want.append(at)
    assert got == want


def test_exported_rows_keep_their_times(spark):
    """Rows whose order differs from one reading to the next, as that of
    shuffled rows may, all get their own ticks."""
    rows = [(i % 5, i, i / 10.0, i / 10.0 + 0.5, 36 + i % 72, 96) for i in range(1000)]
    kind = "session_id long, event_id long, start_s double, end_s double, midi_note int, velocity int"
    notes = spark.createDataFrame(rows, kind).mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), kind)
    tempo = spark.createDataFrame([(s, 0, 0.0, 60.0) for s in range(5)], "session_id long, event_id long, time_s double, bpm double")
    beats = spark.createDataFrame([], "session_id long, time_s double, beat_in_bar int, is_downbeat boolean")
    got = [tuple(r) for r in export.midi_events(notes, tempo, beats).where("kind in ('on', 'off')").select("session_id", "kind", "pitch", "tick").collect()]
    want = [(s, kind, p, round(480 * t)) for s, _, a, b, p, _ in rows for kind, t in (("on", a), ("off", b))]
    assert sorted(got) == sorted(want)


def test_files_are_made_row_by_row(spark):
    """A session's events go through in small batches, never as one value."""
    rows = [(s, 10 * i, kind, 60 + i % 7, 90, None, None) for s in (1, 2, 3) for i in range(40) for kind in ("on", "off")] + [(2, 5, "tempo", None, None, 400_000, None), (2, 20, "marker", None, None, None, "BEAT 1")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = midi.files(spark.createDataFrame(rows, "session_id long, tick long, kind string, pitch int, velocity int, tempo_us long, text string"))
        assert "collect_list" not in made._jdf.queryExecution().toString()
        got = {r["session_id"]: bytes(r["midi"]) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    other = (None, None, None, 0, 96, 500_000, "")
    assert got == {s: midi.encode(sorted(tuple(o if v is None else v for v, o in zip(r, other))[1:] for r in rows if r[0] == s)) for s in (1, 2, 3)}
