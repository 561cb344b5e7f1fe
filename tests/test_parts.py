"""Small operators that no query shows by itself, and the display snapshot."""

import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions import music as M
from strophe.operators import beats as B
from strophe.operators import harmony as H
from strophe.operators import sessions as Z
from strophe.operators import signal as S
from strophe.operators import tracking as Y
from strophe.sources import archive
from strophe.streaming import closing as L
from strophe.streaming import refresh as R
from tests.test_refresh import song, table


def test_detected_meters(spark):
    rows = [(1, k % 4 + 1) for k in range(9)] + [(2, k % 5 + 1) for k in range(9)] + [(3, 1), (3, 3), (4, None)]
    got = B.detected_meters(spark.createDataFrame(rows, "session_id long, beat_in_bar int")).collect()
    assert dict(map(tuple, got)) == {1: 4, 2: None, 3: 3, 4: None}


def test_normalised_and_silent(spark):
    rows = [(1, [0.5, -2.0]), (2, [0.5, -0.25]), (3, [0.0, 1e-6]), (4, []), (5, None)]
    got = {r["id"]: r for r in S.normalised(spark.createDataFrame(rows, "id int, samples array<double>")).collect()}
    assert got[1]["samples"] == [0.25, -1.0] and got[2]["samples"] == [0.5, -0.25]
    assert [got[i]["is_silent"] for i in range(1, 6)] == [False, False, True, True, True]


def test_pulse(spark):
    got = spark.createDataFrame([(-1.0,), (0.0,), (0.1,)], "age double").select(M.pulse(F.col("age"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.0, 1.0, math.exp(-0.65)])


def test_resampled():
    assert Z.resampled(np.arange(10), 4).tolist() == [0, 3, 6, 9]
    assert Z.resampled(np.arange(5), 4).tolist() == [0, 1, 2, 4]  # places are cut off, not rounded
    assert len(Z.resampled(np.arange(0), 4)) == len(Z.resampled(np.arange(4), 0)) == 0


@pytest.mark.parametrize("second, same", [(120, True), (150, False)])
def test_agreement_of_parts(second, same):
    starts = np.concatenate([np.arange(0.25, 15, 0.5), np.arange(15.25, 30, 60 / second)])
    env = Y.envelope(starts, 30.0)
    pooled = np.pad(env, (0, -len(env) % Y.POOL)).reshape(-1, Y.POOL).max(axis=1)
    agrees, found = Y.agreement(pooled, Y.RATE / Y.POOL, 120.0)
    assert agrees == same and all(45 <= v <= 210 for v in found)
    assert Y.agreement(np.zeros(500), 43.0, 120.0) == (True, [])


def test_level_runs_at_their_limits(spark):
    """The floor of -46 dB and the shortest run of 75 ms."""
    rate = 100.0
    rows = [(1, 60, f, -45.9) for f in range(8)] + [(1, 60, f, -45.9) for f in range(20, 27)] + [(1, 61, f, -46.0) for f in range(20)]
    got = S.level_runs(spark.createDataFrame(rows, "session_id long, pitch int, frame int, level_db double"), rate).collect()
    assert [(r["pitch"], r["start_s"], r["end_s"]) for r in got] == [(60, 0.0, 0.08)] and got[0]["confidence"] == 0.05


def test_probable_runs_at_their_limits(spark):
    """Over ten frames, a peak of 0.58, and holes of ten."""
    p = {**{f: 0.3 for f in range(6)}, **{f: 0.58 for f in range(16, 22)}, **{f: 0.9 for f in range(40, 50)}, **{f: 0.5 for f in range(70, 90)}}
    rows = [(1, 60, f, p.get(f, 0.0)) for f in range(100)]
    got = S.probable_runs(spark.createDataFrame(rows, "session_id long, pitch int, frame int, probability double")).collect()
    assert [(r["first"], r["stop"]) for r in got] == [(0, 22)]  # ten frames are too few, twenty of 0.5 too weak


def test_catalog(spark, tmp_path):
    for i, name in enumerate(["a_transcription.mid", "a_chords.csv", "a_audio.wav", "b_tempo.mid", "c_audio.wav", "note.txt", "x_y_transcription.mid"]):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    got = archive.catalog(archive.files(spark, str(tmp_path))).collect()
    assert [r["session_id"] for r in got] == ["x_y", "b", "a"]
    assert got[2]["chords_path"].endswith("a_chords.csv") and got[2]["audio_path"].endswith("a_audio.wav") and got[1]["audio_path"] is None


def test_snapshot(spark):
    rows = song(1, 20, 1, begin=8.0) + song(2, 12, 2) + [(3, None, 1.0, 1.1, 60, 0.5)]
    log = R.replayed(table(spark, rows), idle_s=8.0)
    early = log.where("session_id <> 2 or at_s <= 9")
    got = {r["session_id"]: r for r in L.snapshot(early).collect()}
    assert got[3]["state"] == "waiting" and got[3]["items"] == [] and got[3]["key"] is None and got[3]["at_s"] == 0
    assert got[2]["state"] == "live" and got[2]["at_s"] == 9.0 and got[2]["key"]
    one = got[1]
    ended = log.where("session_id = 1 and ended").first()
    assert one["state"] == "paused" and one["at_s"] == pytest.approx(ended["at_s"] - (ended["valid_from"] - 0.2)) and ended["valid_from"] > 7
    spans = [(i["start_s"], i["end_s"]) for i in one["items"] if i["kind"] == "chord"]
    assert spans[0][0] == 0 and max(b for _, b in spans) == pytest.approx(one["at_s"])
    assert L.snapshot(log.where("false")).count() == 0


def test_thousandths(spark):
    """As C prints them: of the exact value, half to even."""
    values = [k / 2000 for k in range(4001)] + [k / 16_000 for k in range(1, 8000, 7)] + [-0.0, -0.0005, -1.0005, 1234567.0625, 999.9995, 1e11 + 0.0625]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(M.thousandths(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{v:.3f}" for v in values]


def test_sheet_lines_at_half_thousandths(spark, tmp_path):
    """Times such as 1.0005, a little under the half, as their SQL has them."""
    import duckdb

    from strophe.queries import QUERIES, SQL

    duck = duckdb.connect()
    duck.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_microseconds(cast(i * 25_000_000 as bigint)) as ts, i % 3 as user_id, 'view' as event_type, i % 7 / 20 as value, '{{\"k\": 1}}' as props from range(1, 3000) as g(i)) to '{tmp_path}/events.parquet' (format parquet)")
    duck.sql(f"create view events as from '{tmp_path}/events.parquet'")
    ours = sorted(tuple(r) for r in QUERIES["chord_sheet_lines"](spark, str(tmp_path)).select("session_id", "i", "line").collect())
    assert ours == sorted(duck.sql(f"select session_id, i, line from ({SQL['chord_sheet_lines']})").fetchall())


@pytest.mark.parametrize("name", ["label_bars", "beat_strength"])
def test_beats_are_not_broadcast(spark, name):
    """Beats are made from few rows, so they would look small to Spark."""
    from strophe.queries import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df._jdf.queryExecution().toRdd().count()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _plain_chord(v, tonic, major):
    """One chroma vector's chord by plain loops over the templates."""
    if v.sum() < 1e-7 or v.max() < 0.14 or (v >= max(0.055, v.max() * 0.16)).sum() < 2:
        return "N", 0, 0.0
    scale, tries = {(tonic + s) % 12 for s in (H.MAJOR_SCALE if major else H.MINOR_SCALE)}, []
    for root in range(12):
        for k, (suffix, intervals, tension) in enumerate(H.TEMPLATES):
            tones = {(root + i) % 12 for i in intervals}
            score = sum(x * (1.0 if i in tones else -0.42) - 0.075 * (i in tones and x < 0.055) for i, x in enumerate(v)) + 0.09 * (root in scale) + tension - 0.025 * max(0, len(tones) - 3)
            tries.append((round(float(score), 12), -(root * 16 + k), H.NAMES[root] + suffix, root))
    best = max(tries)
    return best[2], best[3], min(1.0, max(0.0, (best[0] + 0.2) / 1.2))


def test_chords_of_many_vectors():
    """The same chords as by plain loops, in a small part of their time."""
    rng = np.random.default_rng(5)
    v = rng.random((400, 12)) ** 4
    v /= v.sum(axis=1, keepdims=True)
    v[::50], v[1::40] = 0.0, 1 / 12
    root, major = rng.integers(0, 12, len(v)), rng.random(len(v)) < 0.5
    began = time.process_time()
    chord, at, sure = H.best_chords(v, root, major)
    middle = time.process_time()
    want = [_plain_chord(v[i], int(root[i]), bool(major[i])) for i in range(len(v))]
    assert list(zip(chord, at, strict=True)) == [w[:2] for w in want] and sure == pytest.approx([w[2] for w in want], abs=1e-9)
    assert middle - began < 0.2 * (time.process_time() - middle)


@pytest.mark.parametrize(("size", "hop"), [(96, 32), (10, 5), (7, 3)])
def test_windows_are_sums_of_blocks(spark, size, hop):
    rng, rows = np.random.default_rng(6), []
    for session in (1, 2):
        for frame in [*range(3, 40), *range(150, 171 + session)]:
            rows += [(session, frame, int(p), float(rng.random())) for p in rng.choice(12, 3, replace=False)]
    df = H.windows(spark.createDataFrame(rows, "session_id long, frame int, pitch_class int, weight double"), size, hop)
    # no frame by frame sums over a sliding range of frames
    assert "RangeFrame" not in df._jdf.queryExecution().toString()
    got = {(r["session_id"], r["k"]): r for r in df.collect()}
    for session in (1, 2):
        n = 171 + session
        x = np.zeros((n, 12))
        for s, frame, p, w in rows:
            if s == session:
                x[frame, p] += w
        assert sorted(k for s, k in got if s == session) == list(range((n - 1) // hop + 1))
        for k in range((n - 1) // hop + 1):
            r = got[session, k]
            assert r["frames"] == n and r["chroma"] == pytest.approx(x[k * hop : k * hop + size].mean(axis=0).tolist()) and r["whole"] == pytest.approx(x.sum(axis=0).tolist())


def test_incomplete_vectors_have_no_chord(spark):
    rows = [(1, [0.5, 0.0, 0.0, 0.0, 0.3, 0.0, 0.0, 0.2] + [0.0] * 4, 0, True), (2, None, 0, True), (3, [0.5], 0, True), (4, [0.1] * 12, None, True), (5, [None] * 12, 0, None)]
    got = H.classify_chord(spark.createDataFrame(rows, "vec_id long, chroma array<double>, root int, is_major boolean")).orderBy("vec_id").collect()
    assert [r["chord"] for r in got] == ["C", None, None, None, None] and got[0]["chord_root"] == 0 and got[1]["chord_confidence"] is None
