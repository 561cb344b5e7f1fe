"""Live analysis with a clock: against whole-session operators and replays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strophe.operators import contexts as C
from strophe.operators import grouping as G
from strophe.operators import harmony as H
from strophe.streaming import refresh as R
from strophe.streaming.session import sessions

SHAPE = "session_id long, at timestamp, start_s double, end_s double, midi_note int, confidence double"
ORIGIN = pd.Timestamp("2024-01-01", tz="UTC")


def at(seconds):
    return (ORIGIN + pd.Timedelta(seconds=seconds)).to_pydatetime()


def song(session, seconds=30.0, seed=0, begin=0.0):
    """Triads, a few scales and rests, in two keys."""
    rng = np.random.default_rng(seed)
    rows, t = [], begin
    while t < begin + seconds:
        root = int(rng.choice([0, 5, 7, 9])) + (3 if t > begin + seconds / 2 else 0)
        for i in [(0, 4, 7), (0, 3, 7), (0,), (0, 7)][int(rng.integers(0, 4))]:
            rows.append((session, at(t), round(t, 3), round(t + float(rng.uniform(0.3, 1.2)), 3), 48 + root + i, round(float(rng.uniform(0.2, 1)), 2)))
        t += float(rng.choice([0.25, 0.5, 1.0]))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


@pytest.mark.parametrize("seed", range(3))
def test_contexts_are_the_whole_session_operators(spark, seed):
    rows = song(1, 40, seed)
    notes = table(spark, rows).withColumn("event_id", F.monotonically_increasing_id())
    frames = H.chroma(notes)
    keys = H.key_segments(frames)
    want_keys = sorted(tuple(r) for r in keys.select("start_s", "end_s", "key", "confidence").collect())
    chords = H.chord_segments(frames, keys, G.polyphony(G.onset_groups(notes)))
    want = sorted(tuple(r) for r in chords.select("start_s", "end_s", "chord", "key", "function", "confidence").collect())
    a, b, p, c = (np.array([r[i] for r in rows], kind) for i, kind in ((2, float), (3, float), (4, int), (5, float)))
    mine = C.chroma(a, b, p, c, float(b.max()))
    got_keys = C.key_segments(mine)
    got = C.chord_segments(mine, got_keys, C.polyphonic(a, b, p))
    assert [k[:3] for k in got_keys] == [k[:3] for k in want_keys] and np.allclose([k[3] for k in got_keys], [k[3] for k in want_keys])
    assert [k[:5] for k in got] == [k[:5] for k in want] and np.allclose([k[5] for k in got], [k[5] for k in want])


def test_spliced_segments():
    old = [(0.0, 4.0, "C major", 0.5), (4.0, 10.0, "G major", 0.2)]
    new = [(5.0, 9.0, "G major", 0.6), (9.0, 12.0, "A minor", 0.3)]
    got = C.spliced(old, new, 6.0, 12.0, C.key_gap)
    assert [g[:3] for g in got] == [(0.0, 4.0, "C major"), (4.0, 9.0, "G major"), (9.0, 12.0, "A minor")]
    assert got[1][3] == pytest.approx((2 * 0.2 + 3 * 0.6) / 5)
    assert C.spliced([], [(2.0, 3.0, "C major", 0.5)], 0.0, 4.0, C.key_gap) == [(0.0, 4.0, "C major", 0.5)]
    got = C.spliced([(0.0, 1.0, "C", "C major", "I", 0.5)], [(2.0, 3.0, "F", "C major", "IV", 0.4)], 2.0, 4.0, C.chord_gap)
    assert [g[:5] for g in got] == [(0.0, 1.0, "C", "C major", "I"), (1.0, 2.0, "N", "C major", ""), (2.0, 3.0, "F", "C major", "IV"), (3.0, 4.0, "N", "C major", "")]
    assert C.spliced([], [], 0.0, 1.0, C.key_gap) == []


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, folder, batches, sink, **options):
    """Feed batches of rows as files, one a trigger."""
    for k, rows in enumerate(batches):
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("at", "0 seconds")
    out = R.live_sessions(stream, "at", **options).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    q = (out.foreachBatch(sink) if callable(sink) else out.format("memory").queryName(sink)).start()
    assert q.awaitTermination(300)
    return q


def comparable(rows):
    """Without nulls' kinds and with rounded numbers."""
    clean = lambda x: round(x, 9) if isinstance(x, float) else [clean(y) for y in x] if isinstance(x, (list, tuple)) else x
    return sorted((clean(list(r)) for r in rows), key=str)


CLOCKS = [(99, at(t), float(t), t + 0.1, 60, 0.5) for t in (40, 80, 120)]


@pytest.mark.parametrize("cut", [1000, 25])
def test_stream_is_the_replay(rocks, tmp_path, cut):
    rows = sorted(song(1, 26, 1) + song(2, 14, 2) + song(3, 9, 3, begin=12.0), key=lambda r: r[1])
    batches = [rows[i : i + cut] for i in range(0, len(rows), cut)] + [[c] for c in CLOCKS]
    run(rocks, tmp_path, batches, f"live{cut}")
    got = rocks.table(f"live{cut}").where("session_id < 99")
    want = R.replayed(table(rocks, rows))
    assert comparable(got.collect()) == comparable(want.collect())
    ended = {r["session_id"]: (r["at_s"], r["pause"]) for r in got.where("ended").collect()}
    assert set(ended) == {1, 2, 3} and all(pause for _, pause in ended.values())  # by silence alone, no note follows
    items = R.current(got).persist()
    keys, chords = R.keys(items), R.chords(items)
    for s, x in (("key", keys), ("chord", chords)):
        gaps = [(a["session_id"], a["end_s"], b["start_s"]) for a, b in zip(x.orderBy("session_id", "start_s").collect(), x.orderBy("session_id", "start_s").collect()[1:], strict=False) if a["session_id"] == b["session_id"]]
        assert gaps and all(abs(e - b) < 1e-9 for _, e, b in gaps), s
    last = got.where("ended").select("session_id", "key", "chord").collect()
    assert {(r["session_id"], r["key"]) for r in last} == {(r["session_id"], r["key"]) for r in keys.groupBy("session_id").agg(F.max_by("key", "start_s").alias("key")).collect()}
    notes = table(rocks, rows).withColumn("event_id", F.monotonically_increasing_id())
    score = comparable(R.scores(got, notes).collect())
    assert score == comparable(R.scores(want, notes).collect()) and len(score) == 3


def test_silence_ends_sessions_and_their_state(rocks, tmp_path):
    """A session too sparse to pause ends after 30 s; nothing is kept."""
    rows = [(1, at(0), 0.0, 0.2, 60, 0.9)]
    clocks = [(99, at(t), float(t), t + 0.1, 60, 0.5) for t in (20, 40, 45)]
    q = run(rocks, tmp_path, [rows, *[[c] for c in clocks]], "silent")
    (end,) = rocks.table("silent").where("session_id = 1 and ended").collect()
    assert end["at_s"] == 31.5 and end["candidate"] and not end["pause"]
    custom = q.lastProgress["stateOperators"][0]["customMetrics"]
    assert custom.get("numValueStateVars", 1) >= 1
    again = rocks.table("silent").where("session_id = 1").agg(F.max("at_s")).first()[0]
    assert again == 31.5


def test_bad_rows_and_failing_refreshes(rocks, tmp_path, monkeypatch):
    good = song(1, 12, 4)
    bad = [(1, at(3), 3.0, 2.0, 60, 0.5), (1, at(4), 4.0, None, 60, 0.5), (1, at(5), 5.0, float("nan"), 60, 0.5), (None, at(5), 5.0, 6.0, 60, 0.5)]
    out = R.replayed(table(rocks, good + bad)).collect()
    assert sorted(r["error"] for r in out if r["error"]) == ["a note of negative length", "a note without times or pitch", "a note without times or pitch"]
    plain = R.replayed(table(rocks, good)).collect()
    assert comparable(r for r in out if not r["error"]) == comparable(plain)
    s = R.Session()
    s.hear([r[2:] for r in good])
    look, calls = s.look, []

    def failing():
        calls.append(s.at)
        if s.at == 4.5:
            raise ValueError("bad block")
        return look()

    monkeypatch.setattr(s, "look", failing)
    rows = [dict(zip(R.NAMES, r, strict=True)) for r in s.advance(9.0)]
    assert [r["error"] for r in rows] == [None, None, "ValueError: bad block", None, None, None]
    assert rows[-1]["key"] == [r["key"] for r in plain if r["at_s"] == 9.0][0]


def test_backlog_is_shed():
    s = R.Session(backlog_s=12.0)
    s.hear([r[2:] for r in song(1, 60, 5)])
    (row,) = [dict(zip(R.NAMES, r, strict=True)) for r in s.advance(50.0)]
    assert row["at_s"] == 49.5 and row["quality"] == "reduced" and row["bpm"]
    assert [r[0] for r in s.advance(53.0)] == [51.0, 52.5]


def test_kept_tables_do_not_depend_on_batches(rocks, tmp_path):
    rows = sorted(song(1, 100, 6) + song(2, 20, 7), key=lambda r: r[1])
    clocks = [[(99, at(t), float(t), t + 0.1, 60, 0.5)] for t in (140, 180)]
    found = []
    for cut in (400, 80):
        folder = tmp_path / str(cut)
        upsert = R.keep(f"{folder}/kept")

        def twice(batch, number, upsert=upsert):
            upsert(batch, number)
            upsert(batch, number)  # as after a failure between the write and the commit

        run(rocks, folder, [rows[i : i + cut] for i in range(0, len(rows), cut)] + clocks, twice)
        found.append(comparable(R.kept(rocks, f"{folder}/kept").where("session_id < 99").collect()))
    assert found[0] == found[1]
    want = R.current(R.replayed(table(rocks, rows))).drop("at_s")
    assert found[0] == comparable(want.collect()) and len({r[1] for r in found[0]}) == 4


def test_silent_devices_close(spark, tmp_path):
    """A device that stops sending closes its session by time, and is forgotten."""
    shape = "device string, at timestamp, at_s double, length_s double, level_db double"
    block = lambda d, t, level=-20.0: (d, at(t), float(t), 0.5, level)
    batches = [[block("a", t / 2) for t in range(60)], [block("b", 31.0, -90.0)], [block("b", 40.0, -90.0)], [block("b", 41.0, -90.0)]]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
    q = sessions(stream, event_time="at", forget_s=5.0).writeStream.outputMode("append").format("memory").queryName("silent_devices").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    assert [(r["device"], r["start_s"], r["end_s"], r["mode"]) for r in spark.table("silent_devices").collect()] == [("a", 0.0, 30.0, "auto")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
